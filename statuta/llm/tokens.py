"""Encoding of a corpus with a public byte-level BPE tokenizer.

The words of each batch are made distinct, sorted and walked depth-first as a trie of
their bytes. A node's state is the last token of the encoding of its prefix. The last
token of a longer prefix is the token that ends there and is compatible with the state
at the place where it begins: byte-pair encoding leaves two neighbours apart exactly
if it leaves their concatenation apart. So every shared prefix is encoded once, and a
word's tokens are read off by walking back over the states.

Nothing is shuffled. Null and empty texts have the empty list of ids; blank texts are
encoded like any other. Special tokens are never produced. The vocabulary's path is a
parameter and must exist on every executor.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept encoded between batches of a task.
KEPT_WORDS = 300_000
#: Texts are split into words in pieces of about so many characters.
PIECE = 1 << 20


class Encoder:
    """Byte-pair encoding by states of a prefix trie."""

    def __init__(self, path: str = VOCABULARY):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(PATTERN)
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.by_end: dict[int, list[int]] = {}
        for token in self.ranks:  # lengths of tokens by their last two bytes
            self.by_end.setdefault(self._end(token), []).append(len(token))
        self.by_end = {k: sorted(set(v), reverse=True) for k, v in self.by_end.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _end(token: bytes) -> int:
        return token[-1] if len(token) == 1 else token[-1] << 8 | token[-2] | 0x10000

    def merge(self, word: bytes) -> list[int]:
        """Plain byte-pair encoding, for the compatibility of two tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        key = (first, second)
        if key not in self.apart:
            self.apart[key] = self.merge(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
        return self.apart[key]

    def _itself(self, token: int) -> bool:
        key = (-1, token)
        if key not in self.apart:
            self.apart[key] = self.merge(self.bytes_of[token]) == [token]
        return self.apart[key]

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """All words by one depth-first walk over their trie."""
        out, before, states = {}, b"", [-1]
        for raw, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                states.append(self._last(raw, end, states))
            tokens, at = [], len(raw)
            while at:
                tokens.append(states[at])
                at -= len(self.bytes_of[states[at]])
            out[word] = tuple(reversed(tokens))
            before = raw
        return out

    def _last(self, raw: bytes, end: int, states: list[int]) -> int:
        lengths = self.by_end.get(raw[end - 1] << 8 | raw[end - 2] | 0x10000, ()) if end > 1 else ()
        for length in (*lengths, 1):
            if length <= end:
                token = self.ranks.get(raw[end - length : end])
                if token is not None and (self._itself(token) if length == end else self.compatible(states[end - length], token)):
                    return token
        raise AssertionError("every byte is a token")

    def words(self, text: str) -> list[str]:
        if len(text) <= PIECE:
            return self.split.findall(text)
        out, at = [], 0
        while at < len(text):  # cut before a space that a letter follows: no word spans it
            cut = at + PIECE
            found = re.compile(r"(?<=[^\s])(?= [^\s])").search(text, min(cut, len(text)))
            stop = found.start() if found else len(text)
            out += self.split.findall(text[at:stop])
            at = stop
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of its words."""
        split = [self.words(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = set(chain.from_iterable(split))
        self.known.update(self.encode_words(list(new)))
        look = self.known.__getitem__
        return [list(map(look, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def encode_table(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``key, ids``, one row per row of ``df``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 500):
                rows = machine.encode([t or "" for t in texts[low : low + 500]])
                flat = [list(chain.from_iterable(r)) for r in rows]
                cuts = np.concatenate([[0], np.cumsum([len(r) for r in flat])]).astype(np.int32)
                values = pa.array(np.fromiter(chain.from_iterable(flat), np.int32, int(cuts[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)), pa.ListArray.from_arrays(pa.array(cuts), values)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def count_table(df: DataFrame, keys: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``keys, n_tokens``, one row per row of ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            sizes: list[int] = []
            for low in range(0, len(texts), 500):
                sizes += [sum(map(len, r)) for r in machine.encode([t or "" for t in texts[low : low + 500]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text)).mapInArrow(count, f"{schema}, n_tokens bigint")
