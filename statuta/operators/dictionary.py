"""Greedy dictionary matching: longest surface first, then alphabetical; a claimed
character blocks all later surfaces. Texts are scanned once by an automaton built from
the dictionary, whose size is checked before it is sent to the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Surfaces a dictionary may hold; it is sent to every executor.
MOST_SURFACES = 1_000_000


def greedy(text: str, machine) -> list[tuple[int, int, str]]:
    """Chosen (start, end, surface) in order of place; a surface must stand between non-word
    characters. Comparison is by lower case."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = []
    for last, surface in machine.iter(low):
        start, end = last + 1 - len(surface), last + 1
        if (start == 0 or not (low[start - 1].isalnum() or low[start - 1] == "_")) and (end == len(low) or not (low[end].isalnum() or low[end] == "_")):
            hits.append((-(end - start), surface, start, end))
    taken = bytearray(len(low))
    chosen = []
    for _, surface, start, end in sorted(hits):
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            chosen.append((start, end, surface))
    return sorted(chosen)


def match(texts: DataFrame, key: str, text: str, surfaces: DataFrame, surface: str) -> DataFrame:
    """``key, surface, span_start, span_end``. Null and empty texts and surfaces match nothing."""
    words = surfaces.select(F.lower(F.trim(surface)).alias("s")).where("s <> ''").distinct().limit(MOST_SURFACES + 1).toPandas()["s"].tolist()
    if len(words) > MOST_SURFACES:
        raise ValueError(f"the dictionary has more than {MOST_SURFACES} surfaces; match it in parts")
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kind = texts.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in shared.value:
            machine.add_word(word, word)
        if not shared.value:
            return
        machine.make_automaton()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, value in enumerate(batch.column(1).to_pylist()):
                rows += [(ids[i], s, a, b) for a, b, s in greedy(value, machine)] if value else []
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=[key, "surface", "span_start", "span_end"])

    return texts.select(key, text).mapInArrow(scan, f"{key} {kind}, surface string, span_start int, span_end int")
