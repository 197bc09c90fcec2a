"""Finite automata compiled to tables and run over many texts in lock-step.

A rule set is written as a step function on small tuples; ``compile`` explores the
reachable tuples and stores the transitions in one table. Texts run side by side,
one symbol of each per vector operation. A long text is cut into chunks: each chunk
is first turned into its state-transition function (the state reached from every
state), the functions are composed by a parallel prefix scan, which gives the state
at each chunk's start, and then all chunks run side by side like short texts.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass

import numpy as np

CHUNK = 4096
#: Steps after which lanes of a transition function that met are merged.
MERGE_EVERY = 16


@dataclass(frozen=True)
class Automaton:
    table: np.ndarray  # states x symbols
    states: list[Hashable]

    def attribute(self, of: Callable[[Hashable], int], kind=np.int8) -> np.ndarray:
        return np.array([of(s) for s in self.states], kind)


def compile_automaton(step: Callable[[Hashable, int], Hashable], start: Hashable, symbols: int) -> Automaton:
    """All states reachable from ``start``, which gets number 0."""
    number, order, rows = {start: 0}, [start], []
    for state in order:  # grows while it is read
        row = []
        for symbol in range(symbols):
            then = step(state, symbol)
            if then not in number:
                number[then] = len(order)
                order.append(then)
            row.append(number[then])
        rows.append(row)
    return Automaton(np.array(rows, np.int32), order)


def _walk(table: np.ndarray, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, state: np.ndarray, sign: int, out: np.ndarray) -> None:
    """Run lanes side by side, writing the state before each symbol."""
    order = np.argsort(-lengths, kind="stable")
    first, lengths, state = first[order], lengths[order], state[order].astype(np.int32)
    flat, width = table.ravel(), table.shape[1]
    steps = int(lengths[0]) if lengths.size else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    at = first.copy()
    for t in range(steps):
        k = active[t]
        here = at[:k]
        now = state[:k]
        out[here] = now
        state[:k] = flat[now * width + symbols[here]]
        at[:k] += sign


def _functions(table: np.ndarray, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, sign: int) -> np.ndarray:
    """Chunk by state: the state after the chunk. Lanes that meet are merged."""
    size, width = table.shape
    chunks = first.size
    lane_chunk = np.repeat(np.arange(chunks), size)
    lane_state = np.tile(np.arange(size), chunks)
    lane_of = np.arange(chunks * size)
    flat = table.ravel()
    for t in range(int(lengths.max())):
        live = lengths[lane_chunk] > t
        at = first[lane_chunk] + sign * t
        lane_state = np.where(live, flat[lane_state * width + symbols[np.where(live, at, 0)]], lane_state)
        if t % MERGE_EVERY == 0 and lane_state.size > chunks:
            merged, inverse = np.unique(lane_chunk * size + lane_state, return_inverse=True)
            lane_of = inverse[lane_of]
            lane_chunk, lane_state = merged // size, merged % size
    return lane_state[lane_of].reshape(chunks, size)


def prefix_compose(functions: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition within runs of equal ``group`` (Hillis-Steele):
    row i becomes f_i after f_{i-1} after ... the first of its group."""
    out, distance = functions.copy(), 1
    while distance < len(out):
        same = np.flatnonzero(group[distance:] == group[:-distance]) + distance
        if not same.size:
            break
        out[same] = np.take_along_axis(out[same], out[same - distance], axis=1)
        distance *= 2
    return out


def run(machine: Automaton, symbols: np.ndarray, offsets: np.ndarray, reverse: bool = False, chunk: int = CHUNK) -> np.ndarray:
    """The state before each symbol of each text, read forwards or backwards; every
    text starts in state 0."""
    out = np.zeros(symbols.size, np.int32)
    lengths = np.diff(offsets)
    texts = np.flatnonzero(lengths)
    if not texts.size:
        return out
    sign = -1 if reverse else 1
    pieces = -(-lengths[texts] // chunk)
    text_of = np.repeat(texts, pieces)
    index = np.arange(text_of.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(chunk, lengths[text_of] - index * chunk)
    first = offsets[text_of + 1] - 1 - index * chunk if reverse else offsets[text_of] + index * chunk
    state = np.zeros(text_of.size, np.int64)
    followed = np.flatnonzero(text_of[:-1] == text_of[1:])
    if followed.size:
        functions = _functions(machine.table, symbols, first[followed], size[followed], sign)
        state[followed + 1] = prefix_compose(functions, text_of[followed])[:, 0]
    _walk(machine.table, symbols, first, size, state, sign, out)
    return out
