"""Current rows of the append-only corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, arrived: str = "ingested_at", keep: list[str] | None = None) -> DataFrame:
    """One row per key: the columns of the latest row. Of rows with one time, the largest
    in the order of ``keep`` holds. Aggregated on the map side, so hot keys don't pile up."""
    keep = [c for c in keep or df.columns if c not in (key, arrived)]
    last = F.max(F.struct(F.col(arrived).alias("_at"), *[F.col(c) for c in keep])).alias("_last")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, F.col("_last._at").alias(arrived), *[F.col(f"_last.{c}").alias(c) for c in keep])


def present(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def has_text(col: Column) -> Column:
    return F.length(F.trim(F.coalesce(col, F.lit("")))) > 0
