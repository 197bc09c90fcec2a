"""Greedy operators on spans of one sentence: overlap removal, pairing, merging.

They are sequential by definition, so each runs over one sentence's bounded arrays in an
Arrow UDF. Null arrays count as empty; spans with null ends or no length are left out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "struct<span_start:int,span_end:int,label:string,source:string,confidence:double>"
SPANS = f"array<{SPAN}>"
_SPANS = T.ArrayType(
    T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType())])
)
_COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("tp", "fp", "fn")])


def _clean(spans) -> list[dict]:
    out = []
    for s in spans if spans is not None else []:
        s = s if isinstance(s, dict) else s.asDict()
        if s["span_start"] is not None and s["span_end"] is not None and s["span_start"] < s["span_end"]:
            conf = s["confidence"]
            out.append({**s, "confidence": 1.0 if conf is None or conf != conf or conf == 0 else conf})
    return out


def overlap(a: dict, b: dict) -> int:
    return max(0, min(a["span_end"], b["span_end"]) - max(a["span_start"], b["span_start"]))


def sweep(spans: list[dict]) -> list[dict]:
    """From the left, longer and surer first; spans that begin before the last kept end are dropped."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["span_start"], s["span_start"] - s["span_end"], -s["confidence"], s["label"] or "")):
        if not kept or s["span_start"] >= kept[-1]["span_end"]:
            kept.append(s)
    return kept


def merge(first: list[dict], second: list[dict], across_labels: bool = False) -> list[dict]:
    """Two taggers' spans. Each span of the first is paired with the unused span of the
    second of its label that overlaps most (ties: the longer); of a pair the longer stays,
    with source both and the larger confidence. Then, in order of source (both, first,
    second), confidence and length, spans that overlap a kept one are dropped, within a
    label or across all."""
    used: set[int] = set()
    pool = []
    for a in sorted(first, key=lambda s: (s["span_start"], s["span_end"])):
        best = max(
            (i for i, b in enumerate(second) if i not in used and b["label"] == a["label"] and overlap(a, b)),
            key=lambda i: (overlap(a, second[i]), second[i]["span_end"] - second[i]["span_start"], -i),
            default=None,
        )
        if best is None:
            pool.append((1, a))
            continue
        used.add(best)
        b = second[best]
        longer = b if b["span_end"] - b["span_start"] > a["span_end"] - a["span_start"] else a
        pool.append((0, {**longer, "source": "both", "confidence": max(a["confidence"], b["confidence"])}))
    pool += [(2, b) for i, b in enumerate(second) if i not in used]
    kept: list[dict] = []
    for _, s in sorted(pool, key=lambda x: (x[0], -x[1]["confidence"], x[1]["span_start"] - x[1]["span_end"], x[1]["span_start"])):
        if not any(overlap(s, k) and (across_labels or s["label"] == k["label"]) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s["span_start"], s["span_end"], s["label"] or ""))


def pair_relaxed(predicted: list[dict], gold: list[dict]) -> tuple[int, int, int]:
    """True positives, false positives and false negatives when overlapping spans of one
    label are paired greedily, the largest overlap first."""
    pairs = sorted(((-overlap(p, g), i, j) for i, p in enumerate(predicted) for j, g in enumerate(gold) if p["label"] == g["label"] and overlap(p, g)))
    a: set[int] = set()
    b: set[int] = set()
    for _, i, j in pairs:
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
    return len(a), len(predicted) - len(a), len(gold) - len(b)


@F.pandas_udf(_SPANS)
def _sweep(spans: pd.Series) -> pd.Series:
    return spans.map(lambda s: sweep(_clean(s)))


def _merge_udf(across: bool):
    @F.pandas_udf(_SPANS)
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([merge(_clean(a), _clean(b), across) for a, b in zip(first, second)])

    return run


@F.pandas_udf(_COUNTS)
def _relaxed(predicted: pd.Series, gold: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pair_relaxed(_clean(p), _clean(g)) for p, g in zip(predicted, gold)], columns=["tp", "fp", "fn"])


def non_overlapping(spans: Column) -> Column:
    return _sweep(spans)


def hybrid(first: Column, second: Column, across_labels: bool = False) -> Column:
    return _merge_udf(across_labels)(first, second)


def relaxed_counts(predicted: Column, gold: Column) -> Column:
    return _relaxed(predicted, gold)
