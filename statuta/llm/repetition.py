"""Repetition inside single documents, by divergence from language references.

Three passes over the texts, none of which shuffles them:

1. References: per language the shares of its ``common`` most frequent words (all others
   together), and of character classes, over all its documents.
2. Each document's Jensen-Shannon distances from the reference of its language. A text of
   few words is far from any reference, so the distances are compared with those of
   documents of the same length: per language and length (quarters of a power of two of
   its words) the median and lower quartile are the matched reference. A text that says
   things again has the variety of a shorter one and stands out; ``excess`` is its distance
   above the median in units of median minus quartile.
3. Documents whose excess in words or classes reaches the limit are counted exactly.

Guards: a text of fewer than LEAST_WORDS words, or of a language of which no length up to
its own has LEAST_DOCUMENTS documents, can't be judged by divergence and is counted exactly
too.

The exact count (``repeated``): a word sequence is a repeat if it is said earlier in the
text and has at least WORDS words, characters of scripts without spaces weighing PIECE of
a word each; so are sentences and lines of at least two words that are said again whole,
and anything stuttered in a row. All repeated windows of least weight together cover the
maximal repeats of that weight. Case, spacing, marks, disguised forms and numbers that
begin a sentence are left out of the comparison; numbers inside one are part of it. The
share is that of the letters of repeated words among all letters.

Null, empty and blank texts, and texts without letters, have share 0 and no distance.
Copies of a key are measured row by row. Null languages share one reference, as do the
languages beyond the MOST_LANGUAGES most frequent ones; regional tags count as their
language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.texts import points, slices

#: Least length of a scattered repeat, in words, and what a character without spaces weighs, in eighths of a word.
WORDS, PIECE = 5, 5
LEAST_SHARE = 0.35
#: Excess over documents of the same language and length from which a document is counted.
WORD_EXCESS, CLASS_EXCESS = 3.0, 8.0
LEAST_WORDS, LEAST_DOCUMENTS = 12, 20
#: Languages with a reference of their own; with the common words of each, the bound of what is sent to executors.
MOST_LANGUAGES, COMMON = 500, 2000
#: Distances closer than this to the median never count as excess.
_LEAST_SPREAD = 0.002

_DENSE = "฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_WORD = r"(?:(?![{0}])[^\W\d_])+".format(_DENSE)
_TOKEN = re.compile(rf"[{_DENSE}]|{_WORD}|\d+")
_PLAIN = re.compile(r"[^\W\d_]+|\d+")  # where no script without spaces occurs
_DENSE_ANY = re.compile(f"[{_DENSE}]")
_BREAK = re.compile(r"[\n\r!?…。！？।;]+|\.(?!\d)")
_UNSEEN = re.compile("[\xad\u200b\u200c\u200d\u2060\ufeff]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CLASSES = ("letter", "capital", "mark", "digit", "space", "stop", "sign", "other")


def _tokens(text: str) -> tuple[list[str], list[int], bool]:
    """Words and numbers of a text, the bounds of its sentences among them, and whether a
    script without spaces occurs."""
    folded = text if text.isascii() else unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    dense = bool(_DENSE_ANY.search(folded))
    split = (_TOKEN if dense else _PLAIN).findall
    tokens: list[str] = []
    bounds = [0]
    for part in _BREAK.split(folded.lower()):
        found = split(part)
        first = 0
        while first < len(found) and found[first][0].isdigit():
            first += 1
        if first < len(found):
            tokens += found[first:]
            bounds.append(len(tokens))
    return tokens, bounds, dense


def _weight(token: str) -> int:
    return 0 if token[0].isdigit() else PIECE if _DENSE_ANY.match(token) else 8


def _codes(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ids, equal for equal windows."""
    with np.errstate(over="ignore"):
        keys = (ids + np.uint64(1)) * _MIX
        keys ^= keys >> np.uint64(29)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(ids.size, _BASE)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(keys * _MIX * power[:-1], dtype=np.uint64)])
        return (sums[ends] - sums[starts]) * power[ids.size - starts]


def repeated(text: str) -> tuple[int, int]:
    """Letters that repeat something, and all letters."""
    return _repeated(*_tokens(text))


def _repeated(tokens: list[str], bounds: list[int], dense: bool) -> tuple[int, int]:
    n = len(tokens)
    if n < 2:
        return 0, sum(map(len, tokens))
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.uint64, n)
    kinds = list(numbers)
    sizes = np.fromiter((0 if t[0].isdigit() else len(t) for t in kinds), np.int64, len(kinds))[ids.astype(np.int64)]
    weights = np.fromiter(map(_weight, kinds), np.int64, len(kinds))[ids.astype(np.int64)]
    least = WORDS * 8
    until = np.concatenate([[0], np.cumsum(weights)])
    edge = np.zeros(n + 1, np.int64)  # where covered stretches begin and end

    def cover(starts: np.ndarray, ends: np.ndarray) -> None:
        code = _codes(ids, starts, ends)
        order = np.argsort(code, kind="stable")  # of equal codes the first in the text comes first
        again = order[1:][code[order[1:]] == code[order[:-1]]]
        edge[:] += np.bincount(starts[again], minlength=n + 1) - np.bincount(ends[again], minlength=n + 1)

    if until[-1] > least:
        # the shortest heavy enough window that begins at each place, and where weights differ the one that ends there
        first = np.arange(n)
        last = np.searchsorted(until, until[:-1] + least)
        cover(first[last <= n], last[last <= n])
        if weights.min() != weights.max():
            ends = np.arange(1, n + 1)
            begins = np.searchsorted(until, until[1:] - least, side="right") - 1
            fits = until[1:] >= least
            cover(begins[fits], ends[fits])
    seen: set[tuple[str, ...]] = set()
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= 2 and until[high] - until[low] < least:
            sentence = tuple(tokens[low:high])
            if sentence in seen:
                edge[low] += 1
                edge[high] -= 1
            seen.add(sentence)
    # in a row, whatever the length: longer periods are windows said before
    for step in range(1, min(-(-least // PIECE) - 1 if dense else WORDS - 1, n - 1) + 1):
        same = np.concatenate([[False], ids[step:] == ids[:-step], [False]])
        change = np.flatnonzero(same[1:] != same[:-1])
        for low, high in zip(change[::2], change[1::2]):
            if high - low >= step:
                edge[low + step] += 1
                edge[high + step] -= 1
    covered = np.cumsum(edge[:n]) > 0
    return int(sizes[covered].sum()), int(sizes.sum())


def repeated_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_letters, repeated_share``, one row per row of ``df`` with a key."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [repeated(t) if t else (0, 0) for t in batch.column(1).to_pylist()]
            again, total = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
            share = np.divide(again, total, out=np.zeros(total.size), where=total > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(share)], names=[key, "n_letters", "repeated_share"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(key).isNotNull()).select(key, text).mapInArrow(measure, f"{key} {kind}, n_letters bigint, repeated_share double")


def jensen_shannon(counts: list[dict], shares: list[dict]) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of histograms from the shares of their references.
    Items a reference doesn't name are put together, against its share of None. Neither
    the histograms nor the references may be empty."""
    sizes = np.fromiter(map(len, counts), np.int64, len(counts))
    owner = np.repeat(np.arange(sizes.size), sizes)
    n = np.fromiter((k for c in counts for k in c.values()), np.float64, owner.size)
    q = np.fromiter((get(item, -1.0) for c, get in zip(counts, (s.get for s in shares)) for item in c), np.float64, owner.size)
    p = n / np.bincount(owner, n, sizes.size)[owner]
    other = q < 0
    rest = np.bincount(owner[other], p[other], sizes.size)
    p = np.concatenate([p[~other], rest])
    q = np.concatenate([q[~other], np.fromiter((s.get(None, 0.0) for s in shares), np.float64, len(shares))])
    owner = np.concatenate([owner[~other], np.arange(sizes.size)])

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(2 * np.maximum(x, 1e-300) / np.maximum(p + q, 1e-300)), 0.0)

    bits = np.bincount(owner, part(p) + part(q), sizes.size)
    known = np.bincount(owner, q, sizes.size)  # what only the reference has differs wholly
    return np.sqrt(np.maximum((bits + 1 - known) / 2, 0.0))


def _class_table() -> np.ndarray:
    order = {name: i for i, name in enumerate(_CLASSES)}
    of = {"Ll": "letter", "Lo": "letter", "Lm": "letter", "Lu": "capital", "Lt": "capital"}
    first = {"M": "mark", "N": "digit", "Z": "space", "P": "sign", "S": "sign"}
    table = np.empty(0x10000, np.int64)
    for cp in range(0x10000):
        ch = chr(cp)
        category = unicodedata.category(ch)
        table[cp] = order["stop" if ch in ".!?…。！？।" else "space" if ch.isspace() else of.get(category) or first.get(category[0], "other")]
    return table


_TABLE: list[np.ndarray] = []


def _class_counts(values: list[str]) -> np.ndarray:
    """Characters per text and class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    out = np.zeros((len(values), len(_CLASSES)), np.int64)
    for low, high in slices(values):
        cps, offsets = points(values[low:high])
        owner = np.repeat(np.arange(high - low), np.diff(offsets))
        cell = owner * len(_CLASSES) + _TABLE[0][np.minimum(cps, 0xFFFF)]
        out[low:high] = np.bincount(cell, minlength=(high - low) * len(_CLASSES)).reshape(high - low, -1)
    return out


def _tag(language: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(F.replace(F.col(language), F.lit("_"), F.lit("-")), "-", 1))), F.lit("?"))


def _tagged(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``key, tag, text``; the rarest languages beyond MOST_LANGUAGES are put together."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), _tag(language).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tags = [r.tag for r in rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(MOST_LANGUAGES + 1).collect()]
    if len(tags) > MOST_LANGUAGES:
        rows = rows.withColumn("tag", F.when(F.col("tag").isin(tags[:MOST_LANGUAGES]), F.col("tag")).otherwise(F.lit("?")))
    return rows


def references(tagged: DataFrame, common: int = COMMON) -> dict[str, tuple[dict, dict]]:
    """Per language the shares of its common words (None: all others) and of its character
    classes. At most MOST_LANGUAGES times ``common`` and a few rows are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words: dict[str, Counter] = {}
            classes: dict[str, np.ndarray] = {}
            for tag, value, row in zip(tags, values, _class_counts(values)):
                words.setdefault(tag, Counter()).update(_tokens(value)[0])
                classes[tag] = classes.get(tag, 0) + row
            rows = [(tag, "word", w, n) for tag, c in words.items() for w, n in c.items()]
            rows += [(tag, "all", "", sum(c.values())) for tag, c in words.items()]
            rows += [(tag, "class", name, int(n)) for tag, c in classes.items() for name, n in zip(_CLASSES, c)]
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.int64())], names=["tag", "kind", "item", "n"])

    counted = tagged.select("tag", "text").mapInArrow(count, "tag string, kind string, item string, n bigint").groupBy("tag", "kind", "item").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("tag", "kind").orderBy(F.desc("n"), "item")  # cut before its shuffle by the group limit
    best = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= common)
    out: dict[str, tuple[dict, dict]] = {}
    totals: dict[str, int] = {}
    for r in best.select("tag", "kind", "item", "n").collect():
        own = out.setdefault(r.tag, ({}, {}))
        if r.kind == "all":
            totals[r.tag] = r.n
        else:
            own[r.kind == "class"][r.item] = r.n
    for tag, (words, classes) in out.items():
        whole, size = totals.get(tag) or 1, sum(classes.values()) or 1
        rest = whole - sum(words.values())
        for item in words:
            words[item] /= whole
        words[None] = rest / whole
        for item in classes:
            classes[item] /= size
    return out


def _measure(values: list[str], tags: list[str], shares: dict) -> Iterator[tuple]:
    """Place, tokens, length, and both distances of each text with words."""
    for low, high in slices(values):
        found = [_tokens(v) for v in values[low:high]]
        at = [i for i, (tokens, _, _) in enumerate(found) if tokens and all(shares.get(tags[low + i], ((), ())))]
        if not at:
            continue
        classes = _class_counts([values[low + i] for i in at])
        own = [shares[tags[low + i]] for i in at]
        word = jensen_shannon([Counter(found[i][0]) for i in at], [words for words, _ in own])
        cls = jensen_shannon([dict(zip(_CLASSES, row)) for row in classes], [kinds for _, kinds in own])
        for i, w, c in zip(at, word.tolist(), cls.tolist()):
            yield low + i, found[i], len(found[i][0]), w, c


def _length(n: int) -> int:
    return int(4 * log2(n))


def distances(tagged: DataFrame, shares: dict) -> DataFrame:
    """``key, tag, length, n_words, word_distance, class_distance`` of the texts with words."""
    shared = tagged.sparkSession.sparkContext.broadcast(shares)
    kind = tagged.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_pylist()
            rows = [(i, tags[i], _length(n), n, w, c) for i, _, n, w, c in _measure(batch.column(2).to_pylist(), tags, shared.value)]
            if rows:
                at, tag, length, n, word, cls = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(tag), pa.array(length, pa.int32()), pa.array(n, pa.int32()), pa.array(word), pa.array(cls)], names=["key", "tag", "length", "n_words", "word_distance", "class_distance"])

    return tagged.select("key", "tag", "text").mapInArrow(run, f"key {kind}, tag string, length int, n_words int, word_distance double, class_distance double")


def matched(measured: DataFrame) -> dict[tuple[str, int], tuple]:
    """Per language and length: median and spread of both distances. Long texts are often
    long because they repeat, and could be most of their length; as a longer text has no
    less variety than a shorter one, a median counts only as far as those of shorter texts
    go down. Lengths with fewer than LEAST_DOCUMENTS documents have the figures of the next
    shorter one. The table is languages by lengths, of which there are four per doubling."""
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5], 1000).alias(c)
    rows = measured.groupBy("tag", "length").agg(F.count(F.lit(1)).alias("n"), quartiles("word_distance"), quartiles("class_distance")).collect()
    out: dict[tuple[str, int], tuple] = {}
    best: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (r.tag, r.length)):
        if r.n >= LEAST_DOCUMENTS:
            now = [(q[1], max(q[1] - q[0], _LEAST_SPREAD)) for q in (r.word_distance, r.class_distance)]
            best[r.tag] = tuple(min(pair) for pair in zip(now, best.get(r.tag, now)))
        if r.tag in best:
            out[r.tag, r.length] = (*best[r.tag][0], *best[r.tag][1])
    return out


def _excess(known: tuple | None, word: float, cls: float) -> tuple[float, float] | None:
    if known is None:
        return None
    middle, spread, class_middle, class_spread = known
    return (word - middle) / spread, (cls - class_middle) / class_spread


def divergence(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``key, word_distance, class_distance, word_excess, class_excess``, one row per row
    with a key: null where a guard holds."""
    tagged = _tagged(df, key, text, language)
    shares = references(tagged)
    measured = distances(tagged, shares)
    base = matched(measured)
    spark = df.sparkSession
    rows = [(t, length, *map(float, figures)) for (t, length), figures in base.items()]
    known = spark.createDataFrame(rows, "tag string, length int, m double, s double, cm double, cs double")
    enough = F.col("n_words") >= LEAST_WORDS
    out = measured.join(F.broadcast(known), ["tag", "length"], "left")  # languages by lengths
    out = out.select("key", "word_distance", "class_distance", F.when(enough, (F.col("word_distance") - F.col("m")) / F.col("s")).alias("word_excess"), F.when(enough, (F.col("class_distance") - F.col("cm")) / F.col("cs")).alias("class_excess"))
    wordless = tagged.select("key").join(out.select("key"), "key", "left_anti")
    return out.unionByName(wordless, allowMissingColumns=True).withColumnRenamed("key", key)


def found(df: DataFrame, key: str, text: str, language: str, least: float = LEAST_SHARE) -> DataFrame:
    """``key, repeated_share`` of the documents with at least that share: those whose
    divergence from their language at their length is in excess (or can't be judged),
    counted exactly."""
    tagged = _tagged(df, key, text, language)
    shares = references(tagged)
    base = matched(distances(tagged, shares))
    shared = df.sparkSession.sparkContext.broadcast((shares, base))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = shared.value
        for batch in batches:
            tags, rows = batch.column(1).to_pylist(), []
            for i, tokens, n, word, cls in _measure(batch.column(2).to_pylist(), tags, known):
                excess = _excess(lengths.get((tags[i], _length(n))), word, cls) if n >= LEAST_WORDS else None
                if excess is None or excess[0] >= WORD_EXCESS or excess[1] >= CLASS_EXCESS:
                    again, total = _repeated(*tokens)
                    if total and again / total >= least:
                        rows.append((i, again / total))
            if rows:
                at, share = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(share)], names=[key, "repeated_share"])

    return tagged.select("key", "tag", "text").mapInArrow(run, f"{key} {kind}, repeated_share double")
