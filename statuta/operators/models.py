"""Boundaries of models: encoders and taggers plugged in as callables. The engine ships none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], "list[list[float]]"]
Tagger = Callable[[list[str]], "list[list[tuple[int, int, str, float]]]"]


def encode(df: DataFrame, key: str, text: str, load: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """``key, embedding``: the model is loaded once per task and called on batches of texts.
    Null texts are left out. A batch with a wrong number of vectors is an error."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            for low in range(0, len(part), batch):
                piece = part.iloc[low : low + batch]
                vectors = model(piece[text].tolist())
                if len(vectors) != len(piece):
                    raise ValueError("the encoder returned another number of vectors than of texts")
                yield pd.DataFrame({key: piece[key].to_numpy(), "embedding": list(vectors)})

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Offsets and texts of windows of words; the whole text if it has few enough."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    if len(words) <= size:
        return [(0, text)] if words else []
    out = []
    for first in range(0, len(words), size - overlap):
        last = min(first + size, len(words))
        out.append((words[first][0], text[words[first][0] : words[last - 1][1]]))
        if last == len(words):
            break
    return out


def tag(df: DataFrame, key: str, text: str, load: Callable[[], Tagger], size: int = 220, overlap: int = 40, batch: int = 16, least: float = 0.0) -> DataFrame:
    """``key, span_start, span_end, label, confidence``: long texts are tagged in overlapping
    windows, spans are shifted back, and of one span and label the surest is kept. A failing
    batch is divided until the failing text stands alone; that text has no spans."""
    kind = df.schema[key].dataType.simpleString()

    def safe(model: Tagger, texts: list[str]) -> list[list]:
        try:
            return model(texts)
        except Exception:
            if len(texts) == 1:
                return [[]]
            middle = len(texts) // 2
            return safe(model, texts[:middle]) + safe(model, texts[middle:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            jobs = [(k, at, piece) for k, value in zip(part[key], part[text]) for at, piece in windows(value, size, overlap)]
            best: dict[tuple, float] = {}
            for low in range(0, len(jobs), batch):
                group = jobs[low : low + batch]
                for (k, at, _), spans in zip(group, safe(model, [p for _, _, p in group])):
                    for a, b, label, confidence in spans:
                        if confidence >= least and a < b:
                            best[k, at + a, at + b, label] = max(confidence, best.get((k, at + a, at + b, label), 0.0))
            yield pd.DataFrame([(*s, c) for s, c in best.items()], columns=[key, "span_start", "span_end", "label", "confidence"])

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, span_start int, span_end int, label string, confidence double")
