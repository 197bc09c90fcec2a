"""Dense scoring: a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors multiplied at once; more are handled block after block.
BLOCK = 1024


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.vstack([np.asarray(r, np.float64) for r in rows])
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


def _blocks(queries: DataFrame, key: str, vector: str, extra: list[str]) -> Iterator[list]:
    """The query rows, BLOCK at a time, as they arrive."""
    rows = queries.select(key, vector, *extra).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(key).toLocalIterator(prefetchPartitions=False)
    now: list = []
    for row in rows:
        now.append(tuple(row))
        if len(now) == BLOCK:
            yield now
            now = []
    if now:
        yield now


def similarities(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int | None = None, label: str | None = None, mode: str = "all", least: float | None = None) -> DataFrame:
    """``query_id, item, label, similarity``: cosines of every query with every other vector
    of at least ``least``, cut inside the task: per query the best ``k`` (ties with the k-th
    stay); with ``mode`` "same" only of the query's own label, with "per_label" the best of
    each label. Null vectors are left out. A batch sends at most k (or one per label) rows
    per query and task batch."""
    extra = [label] if label else []
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, item {kind}" + "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in extra) + ", similarity double"
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector, *extra)
    context, out = queries.sparkSession.sparkContext, None
    for block in _blocks(queries, key, vector, extra if mode == "same" else []):
        own = np.array([r[2] for r in block], dtype=object) if mode == "same" else None
        shared = context.broadcast((np.array([r[0] for r in block]), _unit(pd.Series([r[1] for r in block])), own))

        def score(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix, labels = shared.value
            for part in parts:
                if not len(part):
                    continue
                cosine = matrix @ _unit(part[vector]).T
                cosine[ids[:, None] == part[key].to_numpy()[None, :]] = -np.inf
                if least is not None:
                    cosine[cosine < least] = -np.inf
                theirs = part[label].to_numpy(dtype=object) if label else None
                if mode == "same":
                    cosine[labels[:, None] != theirs[None, :]] = -np.inf
                if mode == "per_label":
                    keep = np.zeros(cosine.shape, bool)
                    codes, names = pd.factorize(theirs, use_na_sentinel=False)
                    for i in range(len(names)):
                        columns = np.flatnonzero(codes == i)
                        keep[np.arange(ids.size), columns[cosine[:, columns].argmax(axis=1)]] = True
                else:
                    keep = np.ones(cosine.shape, bool)
                    if k is not None and cosine.shape[1] > k:
                        keep = cosine >= np.partition(cosine, -k, axis=1)[:, -k][:, None]
                q, v = np.nonzero(keep & np.isfinite(cosine))
                yield pd.DataFrame({"query_id": ids[q], "item": part[key].to_numpy()[v], **{c: part[c].to_numpy()[v] for c in extra}, "similarity": cosine[q, v]})

        piece = rows.mapInPandas(score, schema)
        out = piece if out is None else out.unionByName(piece)
    return queries.sparkSession.createDataFrame([], schema) if out is None else out


def cosine_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item")
    return similarities(queries, vectors, key, vector, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def activation(queries: DataFrame, vectors: DataFrame, key: str, vector: str, label: str, least: float) -> DataFrame:
    """Per query and label the best similarity of at least ``least``."""
    return similarities(queries, vectors, key, vector, None, label, "per_label", least).groupBy("query_id", label).agg(F.max("similarity").alias("activation"))


def mine(candidates: DataFrame, seeds: DataFrame, key: str, vector: str, label: str, count: str | None = None, top: int = 10, least: float = 0.35) -> DataFrame:
    """``candidate, score, best_seed, status``: candidates scored by the seeds of their own
    label: .75 of the best similarity, .25 of the mean of the best ``top``, and a bonus for
    frequency of at most .08 (ln(1 + n) / 50, a count of 0 counting as 1). Scores under
    ``least`` are left out; from .72 on a candidate is suggested, else it is for review."""
    near = similarities(candidates, seeds, key, vector, top, label, "same")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item")
    best = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    per = best.groupBy("query_id").agg(F.max("similarity").alias("_best"), F.avg("similarity").alias("_mean"), F.min_by("item", "_r").alias("best_seed"))
    bonus = F.lit(0.0)
    if count:
        per = per.join(candidates.select(F.col(key).alias("query_id"), F.col(count).alias("_n")), "query_id")
        bonus = F.least(F.lit(0.08), F.log1p(F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))) / 50)
    score = 0.75 * F.col("_best") + 0.25 * F.col("_mean") + bonus
    return per.select(F.col("query_id").alias("candidate"), score.alias("score"), "best_seed").where(F.col("score") >= least).withColumn("status", F.when(F.col("score") >= 0.72, "suggested").otherwise("review"))
