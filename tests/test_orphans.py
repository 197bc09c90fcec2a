from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.operators import orphans as op
from statuta.operators.bitmaps import Bitmap

IDS = st.lists(st.integers(0, 300_000), max_size=60)


@settings(max_examples=60, deadline=None)
@given(IDS, IDS)
def test_bitmaps_behave_like_sets(a, b):
    x, y = Bitmap.of(np.array(a, np.int64)), Bitmap.of(np.array(b, np.int64))
    assert x.and_not(y).decode().tolist() == sorted(set(a) - set(b))
    assert (x & y).decode().tolist() == sorted(set(a) & set(b))
    assert (x | y).decode().tolist() == sorted(set(a) | set(b))


def test_dense_container_round_trip():
    ids = np.arange(0, 140_000, 2)
    assert Bitmap.of(ids).decode().tolist() == ids.tolist()
    assert len(Bitmap.of(ids).and_not(Bitmap.of(ids[:-1]))) == 1


UNITS = "unit_id string, parent_id string, ingested_at timestamp, deleted_at timestamp, space string"
MENTIONS = "mention_id string, source_unit_id string, resolution struct<status string, target_id string, target_type string>, ingested_at timestamp, first_at string"


def day(n, month=3):
    return datetime(2025, month, n)


def run(spark, units, mentions, attachments=(), register=()):
    u, m = spark.createDataFrame(units, UNITS), spark.createDataFrame(mentions, MENTIONS)
    a = spark.createDataFrame(list(attachments), "attachment_id string, ingested_at timestamp")
    d = spark.createDataFrame(list(register), "document_id string, ingested_at timestamp")
    return sorted(map(tuple, op.orphans(op.corpus_references(u, m), op.corpus_targets(u, a, d), ranges=3).collect()))


def test_kinds_copies_and_clashing_columns(spark):
    units = [
        ("a", None, day(1), None, "x"), ("a", None, day(9), day(9), "x"),  # deleted by its latest row
        ("b", "a", day(2), None, "x"), ("b", "a", day(2), None, "x"),  # an exact copy
        ("c", "d", day(3), None, "x"), ("d", "", day(4), None, "x"),  # c's parent came later, the same month
        ("e", "f", day(5), None, "x"), ("f", None, day(1), day(2), "x"), ("f", None, day(6), None, "x"),  # brought back
        ("g", "nowhere", day(20, 2), None, "x"), (None, "nowhere", day(1), None, "x"),
    ]
    mentions = [
        ("m1", "b", ("r", "att", "attachment"), day(1), "x"), ("m2", "", ("r", "att", "attachment"), day(9), "x"),
        ("m3", None, None, day(1), "x"), ("m4", "b", ("r", "zz", "document"), day(9), "x"), ("m5", "b", ("r", "a", None), day(9), "x"), ("m6", "b", ("r", "c", "document"), day(9), "x"),
    ]
    got = run(spark, units, mentions, [("att", day(5))], [("reg", day(1)), (None, None)])
    assert got == sorted(
        [
            ("units", "parent_id", "b", "a", "deleted", "2025-03"),
            ("units", "parent_id", "c", "d", "late", "2025-03"),
            ("units", "parent_id", "g", "nowhere", "missing", "2025-02"),
            ("ref_mentions", "target_id", "m1", "att", "late", "2025-03"),
            ("ref_mentions", "source_unit_id", "m1", "b", "late", "2025-03"),
            ("ref_mentions", "target_id", "m4", "zz", "missing", "2025-03"),
            ("ref_mentions", "target_id", "m5", "a", "deleted", "2025-03"),
            ("ref_mentions", "target_id", "m6", "c", "missing", "2025-03"),
        ]
    )


def test_empty_tables(spark):
    assert run(spark, [], []) == []
