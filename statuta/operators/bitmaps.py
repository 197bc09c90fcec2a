"""Compressed bitmaps over integer ids: containers of 2^16 ids, kept as sorted
uint16 arrays while sparse and as 8 KiB bit fields once dense."""

from __future__ import annotations

import numpy as np

SPARSE_LIMIT = 4096
SPAN = 1 << 16


class Bitmap:
    """An immutable set of non-negative integers."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self.containers = containers

    @classmethod
    def of(cls, ids: np.ndarray) -> "Bitmap":
        ids = np.unique(np.asarray(ids, dtype=np.int64))
        high = ids >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack((part & 0xFFFF).astype(np.uint16)) for part in np.split(ids, cuts) if part.size})

    def and_not(self, other: "Bitmap") -> "Bitmap":
        return self._merge(other, lambda a, b: a & ~b, keep_left=True)

    def __and__(self, other: "Bitmap") -> "Bitmap":
        return self._merge(other, lambda a, b: a & b, keep_left=False)

    def __or__(self, other: "Bitmap") -> "Bitmap":
        out = dict(other.containers)
        for key, left in self.containers.items():
            out[key] = _squeeze(_bits(left) | _bits(out[key])) if key in out else left
        return Bitmap(out)

    def _merge(self, other: "Bitmap", op, keep_left: bool) -> "Bitmap":
        out = {}
        for key, left in self.containers.items():
            right = other.containers.get(key)
            if right is None:
                if keep_left:
                    out[key] = left
                continue
            merged = op(_bits(left), _bits(right))
            if merged.any():
                out[key] = _squeeze(merged)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [(key << 16) + _values(c).astype(np.int64) for key, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return int(sum(_values(c).size for c in self.containers.values()))


def _pack(values: np.ndarray) -> np.ndarray:
    return values if values.size <= SPARSE_LIMIT else _bits(values)


def _bits(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint8:
        return container
    flags = np.zeros(SPAN, np.uint8)
    flags[container] = 1
    return np.packbits(flags)


def _values(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container)).astype(np.uint16)


def _squeeze(bits: np.ndarray) -> np.ndarray:
    return _pack(_values(bits))
