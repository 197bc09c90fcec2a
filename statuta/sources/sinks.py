"""File sinks: JSON lines, CSV with spelled nulls, texts by label, resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """The given columns as strings, nulls spelled ``null``, sorted across files if asked."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in columns])
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_terms(df: DataFrame, path: str, label: str, term: str) -> None:
    """One folder of text per label, the longest terms first."""
    rows = df.select(label, F.col(term).alias("value")).where("value is not null").distinct()
    rows.repartition(label).sortWithinPartitions(label, F.desc(F.length("value")), "value").write.mode("overwrite").partitionBy(label).text(path)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The work whose key isn't done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, for partial results that were appended to."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def write_json(df: DataFrame, path: str) -> None:
    """A table of one row, such as a summary, as one JSON document."""
    df.limit(2).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


INDEX_PARTS = ("passages", "entities", "links", "references", "postings")


def write_index(parts: dict[str, DataFrame], path: str) -> None:
    """The tables of a retrieval index, a Parquet folder each; postings lie by term."""
    for name, rows in parts.items():
        (rows.repartition("term").sortWithinPartitions("term") if name == "postings" else rows).write.mode("overwrite").parquet(f"{path}/{name}")


def open_index(spark, path: str, dense: bool = False) -> dict[str, DataFrame]:
    """The tables of an index. A missing part is an error, as are vectors that don't match
    their passages one to one where a dense index is asked for."""
    from statuta.sources.files import list_files

    names = [*INDEX_PARTS, *(["vectors"] if dense else [])]
    missing = [n for n in names if not list_files(spark, f"{path}/{n}")]
    if missing:
        raise FileNotFoundError(f"the index lacks {', '.join(missing)}")
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if dense and parts["vectors"].count() != parts["passages"].count():
        raise ValueError("the index has another number of vectors than of passages")
    return parts
