"""References to records that do not exist.

Keys are dictionary-encoded as integers inside hash ranges; per range and month a
compressed bitmap holds the keys referred to and the keys that have arrived, and
the orphans are the bits of reference AND-NOT parent. Only the surviving keys are
decoded and joined back to the referring records.

What crosses the network is one row per distinct (key, month), summed on the map
side, so a key that a third of all records refer to costs no more than any other.
The join back is left to AQE, which broadcasts the orphan keys only when their
measured size allows and otherwise splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.bitmaps import Bitmap

#: Keys and months a range holds on average; a range is one task's work.
RANGE_ROWS = 500_000
ORPHAN_SCHEMA = "space string, target_key string, orphan_kind string, target_first timestamp"


def references(df: DataFrame, src_table: str, src_field: str, record: str, key: Column, space: Column, arrived: str = "ingested_at") -> DataFrame:
    """One row per referring record: its key, the key's name space and the time the
    record first arrived. Null and empty keys refer to nothing; a record without an
    id or an arrival time can't be placed and is left out."""
    rows = df.select(F.col(record).alias("record_id"), key.alias("target_key"), space.alias("space"), F.col(arrived).alias("at"))
    rows = rows.where(F.col("record_id").isNotNull() & F.col("at").isNotNull())
    first = rows.groupBy("record_id").agg(F.min("at").alias("first_at"), F.collect_set(F.struct("target_key", "space")).alias("keys"))
    return (
        first.select(F.lit(src_table).alias("src_table"), F.lit(src_field).alias("src_field"), "record_id", "first_at", F.explode("keys").alias("k"))
        .select("src_table", "src_field", "record_id", "first_at", "k.target_key", "k.space")
        .where(F.col("target_key").isNotNull() & (F.col("target_key") != ""))
    )


def targets(df: DataFrame, space: str, key: str, arrived: str = "ingested_at", deleted: str | None = None) -> DataFrame:
    """One row per existing key: first arrival, and whether the latest row is deleted
    (of rows with one latest time, a deletion counts only if all of them carry it)."""
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    rows = df.select(F.lit(space).alias("space"), F.col(key).alias("target_key"), F.col(arrived).alias("at"), gone.alias("gone")).where(F.col(key).isNotNull())
    return rows.groupBy("space", "target_key").agg(F.min("at").alias("target_first"), F.max(F.struct(F.col("at"), (~F.col("gone")).alias("alive"))).alias("last")).select(
        "space", "target_key", "target_first", (~F.col("last.alive")).alias("gone")
    )


def ranges_for(*tables: DataFrame) -> int:
    """Ranges for so many source rows (counted from the files' footers), at least as many as
    there are shuffle partitions."""
    rows = sum(t.count() for t in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def orphan_keys(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """The keys with at least one orphan reference, by kind. A ``late`` key is a
    candidate: its records are compared with the exact arrival time afterwards. Each range
    of the key hash is one partition, placed by its number."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    wanted = refs.groupBy("space", "target_key", month("first_at").alias("period")).agg(F.min("first_at").alias("ref_first"))
    rows = wanted.select("space", "target_key", "period", F.lit(True).alias("is_ref"), F.lit(None).cast("timestamp").alias("target_first"), F.lit(False).alias("gone")).unionByName(
        parents.select("space", "target_key", month("target_first").alias("period"), F.lit(False).alias("is_ref"), "target_first", "gone")
    )
    number = F.pmod(F.xxhash64("space", "target_key"), F.lit(ranges)).cast("int")
    return rows.repartitionById(ranges, number).mapInPandas(_and_not, ORPHAN_SCHEMA)


def _and_not(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    names = rows["space"] + "\x1f" + rows["target_key"]
    ids, dictionary = pd.factorize(names, sort=False)
    is_ref = rows["is_ref"].to_numpy(bool)
    gone = rows["gone"].fillna(False).to_numpy(bool)
    period = rows["period"].fillna(0).to_numpy(np.int64)
    exists, deleted = Bitmap.of(ids[~is_ref]), Bitmap.of(ids[~is_ref & gone])
    missing, removed, late = Bitmap({}), Bitmap({}), Bitmap({})
    # months backwards, so that each arrival enters the bitmap of later ones once
    order = np.argsort(period, kind="stable")[::-1]
    cuts = np.flatnonzero(np.diff(period[order])) + 1
    not_before = Bitmap({})
    for at in np.split(order, cuts):
        own = is_ref[at]
        not_before |= Bitmap.of(ids[at[~own]])
        referred = Bitmap.of(ids[at[own]])
        missing |= referred.and_not(exists)
        removed |= referred & deleted
        late |= (referred & not_before).and_not(deleted)
    first = pd.Series(rows["target_first"].to_numpy()[~is_ref], index=ids[~is_ref])
    for kind, bits in (("missing", missing), ("deleted", removed), ("late", late)):
        found = bits.decode()
        if found.size:
            parts = pd.Series(dictionary[found]).str.split("\x1f", n=1, expand=True)
            when = first.reindex(found).to_numpy() if kind == "late" else np.full(found.size, np.datetime64("NaT", "us"))
            yield pd.DataFrame({"space": parts[0], "target_key": parts[1], "orphan_kind": kind, "target_first": when})


def orphans(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """Every orphan reference: ``src_table, src_field, record_id, target_key,
    orphan_kind, period``, the kind being the first of missing, deleted, late that
    holds. Empty inputs give no rows; repeated rows of a record count once; extra
    columns of the sources are never read."""
    bad = orphan_keys(refs, parents, ranges)
    hit = refs.join(bad, ["space", "target_key"])
    late = (F.col("orphan_kind") != "late") | (F.col("target_first") > F.col("first_at"))
    return hit.where(late).select("src_table", "src_field", "record_id", "target_key", "orphan_kind", F.date_format("first_at", "yyyy-MM").alias("period"))


def corpus_references(units: DataFrame, mentions: DataFrame) -> DataFrame:
    """The three reference fields of the corpus tables."""
    unit = F.lit("unit")
    kind = F.coalesce(F.col("resolution.target_type"), unit)
    return (
        references(units, "units", "parent_id", "unit_id", F.col("parent_id"), unit)
        .unionByName(references(mentions, "ref_mentions", "target_id", "mention_id", F.col("resolution.target_id"), kind))
        .unionByName(references(mentions, "ref_mentions", "source_unit_id", "mention_id", F.col("source_unit_id"), unit))
    )


def corpus_targets(units: DataFrame, attachments: DataFrame, register: DataFrame) -> DataFrame:
    return (
        targets(units, "unit", "unit_id", deleted="deleted_at")
        .unionByName(targets(attachments, "attachment", "attachment_id"))
        .unionByName(targets(register, "document", "document_id"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per source table, field, kind and month, with the distinct keys."""
    return found.groupBy("src_table", "src_field", "orphan_kind", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("target_key").alias("n_keys"))
