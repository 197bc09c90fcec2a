"""Bounded conversation memory, folded over turns: in batch and as a stream.

Per conversation the memory keeps the last rewritten question, at most ``most`` distinct
entities and documents, the newest last, and the number of turns. Turns are folded in
their order; null turns come first, repeated turns count once (the first row holds).
The fold is the same function in both modes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "turns bigint, last_question string, entities array<string>, documents array<string>"
EMPTY = (0, None, [], [])


def remember(kept: list[str], new: list[str] | None, most: int) -> list[str]:
    """Distinct, newest last, at most ``most``; a value seen again moves to the end."""
    out = list(kept)
    for value in new if new is not None else []:
        if value is None or value == "":
            continue
        if value in out:
            out.remove(value)
        out.append(value)
    return out[-most:]


def fold(state: tuple, turn: dict, most: int) -> tuple:
    turns, question, entities, documents = state
    return (turns + 1, turn["question"] or question, remember(entities, turn["entities"], most), remember(documents, turn["documents"], most))


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    ordered = pdf.sort_values("turn", kind="stable", na_position="first").drop_duplicates("turn", keep="first")
    for row in ordered.to_dict("records"):
        yield {k: (None if isinstance(v, float) and pd.isna(v) else v) for k, v in row.items()}


def batch(turns: DataFrame, most: int = 8) -> DataFrame:
    """``conversation`` and the memory after its last turn. One conversation is folded in
    one task, turn by turn; its state is bounded."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state = EMPTY
        for row in _rows(pdf):
            state = fold(state, row, most)
        return pd.DataFrame([[key[0], *state]], columns=["conversation", "turns", "last_question", "entities", "documents"])

    rows = turns.where(F.col("conversation").isNotNull()).select("conversation", "turn", "question", "entities", "documents")
    return rows.groupBy("conversation").applyInPandas(run, f"conversation string, {STATE}")


def stream(turns: DataFrame, most: int = 8, forget_after: str | None = None) -> DataFrame:
    """The memory after each micro-batch, for streaming ``turns``. State is kept in the
    checkpointed state store; with ``forget_after`` (a duration such as ``"1 hour"``) it is
    dropped after so long a silence."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else EMPTY
        now = (now[0], now[1], list(now[2]), list(now[3]))
        parts = list(pdfs)
        for row in _rows(pd.concat(parts, ignore_index=True)) if parts else ():
            now = fold(now, row, most)
        state.update(now)
        if forget_after:
            state.setTimeoutDuration(forget_after)
        yield pd.DataFrame([[key[0], *now]], columns=["conversation", "turns", "last_question", "entities", "documents"])

    rows = turns.where(F.col("conversation").isNotNull()).select("conversation", "turn", "question", "entities", "documents")
    return rows.groupBy("conversation").applyInPandasWithState(run, f"conversation string, {STATE}", STATE, "update", timeout)
