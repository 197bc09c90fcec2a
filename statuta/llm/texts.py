"""Arrays of code points for batches of texts, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points handled at once; a longer single text is a batch of its own.
BATCH_POINTS = 2_000_000


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the offset of each text (one more
    than there are texts)."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(raw, np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of the list with about BATCH_POINTS code points each."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if total and total + n > BATCH_POINTS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
