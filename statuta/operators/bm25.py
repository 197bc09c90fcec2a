"""BM25: postings, document frequencies and search by blocks of documents and queries.
Query-term multiplicity is ignored; only scores over 0 count."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.session import cut

#: Queries scored at once; distinct texts a task holds at once; documents, and cells of
#: documents and terms, multiplied at once.
BLOCK, SLAB, CHUNK, CELLS = 2048, 200_000, 2048, 1 << 22
#: A term goes into the matrix product if it is in so large a share of documents times queries.
FREQUENT = 0.01


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, term, tf, dl``: one row per document and term. The document length travels
    with the posting, so no join is needed for it. Documents are placed by key once;
    this and every later grouping by document stays where they are."""
    words = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), tx.tokens(F.col(text)).alias("words")).repartition("doc")
    return words.select("doc", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return docs.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tx.tokens(F.col(text)))).alias("avgdl"))


def idf(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf`` with idf = ln(1 + (N - df + .5) / (df + .5))."""
    counted = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.join(F.broadcast(stats), how="cross").select("term", "df", weight.alias("idf"))  # stats: one row


def bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, bag``: the sorted words of every document as one text."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.array_join(F.array_sort(tx.tokens(F.col(text))), " ").alias("bag"))


def search(queries: DataFrame, docs: DataFrame, key: str, text: str, doc_key: str, doc_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``q, doc, score, rank``: the best ``k`` documents of every query, ties by document.
    Queries and documents without words match nothing."""
    return search_bags(queries, cut(bags(docs, doc_key, doc_text)), key, text, k, k1, b)


def search_bags(queries: DataFrame, held: DataFrame, key: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As ``search``, over ``bags`` that were written before, as they are read three times.

    All queries go to every task, their terms by number. Documents of one bag lie in one
    task and are scored once. A task sends on its best ``k`` per query and slab; neither
    postings nor pairs of query and document are shuffled."""
    spark = held.sparkSession
    words = F.split("bag", " ")
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("bag") == "", 0).otherwise(F.size(words))).alias("avgdl"))
    n, mean = stats.first()
    terms = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), F.explode(tx.tokens(F.col(text))).alias("term"))
    asked = terms.groupBy("q").agg(F.sort_array(F.collect_set("term")).alias("terms")).toArrow()
    said = spark.createDataFrame([(w,) for w in sorted({w for ws in asked["terms"].to_pylist() for w in ws})], "term string")
    known = idf(held.select(F.explode(F.array_distinct(words)).alias("term")), stats).join(F.broadcast(said), "term", "left_semi").toPandas()
    kind = f"array<struct<s: double, doc: {held.schema['doc'].dataType.simpleString()}>>"
    shared = spark.sparkContext.broadcast(_Queries(asked, known, n))
    placed = held.where("bag <> ''").repartition(max(1, spark.sparkContext.defaultParallelism), "bag")
    hits = placed.mapInArrow(_scorer(shared, mean or 1.0, k, k1, b), f"q {queries.schema[key].dataType.simpleString()}, hits {kind}")
    best = hits.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    return best.select("q", F.posexplode("hits").alias("i", "hit")).select("q", "hit.doc", (-F.col("hit.s")).alias("score"), (F.col("i") + 1).alias("rank"))


class _Queries:
    """The queries with known terms, and their terms by number."""

    def __init__(self, asked: pa.Table, known, n: int):
        self.ids = {term: i for i, term in enumerate(known["term"])}
        self.idf, self.share = known["idf"].to_numpy(float), known["df"].to_numpy(float) / max(n, 1)
        own = [[self.ids[w] for w in ws if w in self.ids] for ws in asked["terms"].to_pylist()]
        kept = [i for i, x in enumerate(own) if x]
        self.names = asked["q"].combine_chunks().take(pa.array(kept, pa.int64()))
        self.starts = np.cumsum([0, *(len(own[i]) for i in kept)])
        self.terms = np.array([t for i in kept for t in own[i]], np.int64)


class _Slab:
    """Distinct bags with the terms that queries ask for, and the documents of each."""

    def __init__(self, ids: dict[str, int]):
        self.ids, self.index, self.parts, self.docs, self.codes = ids, {}, [], [], []

    def add(self, docs: list, texts: list[str]) -> None:
        index, first = self.index, len(self.index)
        self.codes += [index.setdefault(x, len(index)) for x in texts]
        self.docs += docs
        words = [x.split(" ") for x in islice(index, first, None)]
        length = np.fromiter(map(len, words), np.int64, len(words))
        term = np.fromiter((self.ids.get(w, -1) for ws in words for w in ws), np.int32, length.sum())
        row = np.repeat(np.arange(first, first + len(words), dtype=np.int32), length)
        size = np.repeat(length, length)
        term, row, size = (x[term >= 0] for x in (term, row, size))
        new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(row, prepend=-1))  # equal words are neighbours
        self.parts.append((row[new], term[new], np.diff(new, append=len(term)), size[new]))

    def close(self, idf: np.ndarray, mean: float, k1: float, b: float) -> None:
        self.row, self.term, tf, size = (np.concatenate(x) for x in zip(*self.parts))
        self.weight = idf[self.term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
        self.size, codes = len(self.index), np.array(self.codes)
        docs = np.array(self.docs) if isinstance(self.docs[0], int) else np.array(self.docs, object)
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(codes[order], kind="stable")]
        self.count = np.bincount(codes)
        self.first = np.cumsum(self.count) - self.count
        self.rank = np.empty(len(docs), np.int64)  # of the documents, as they lie by bag
        self.docs = docs[order]
        self.rank[np.argsort(self.docs, kind="stable")] = np.arange(len(docs))
        self.index = self.parts = self.codes = None

    def chunk(self, start: int, end: int, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and weights of some bags, of terms with a column."""
        low, high = np.searchsorted(self.row, (start, end))
        c = column[self.term[low:high]]
        return self.row[low:high][c >= 0] - start, c[c >= 0], self.weight[low:high][c >= 0]


class _Best:
    """Per query the bags whose rounded score may be one of the ``k`` best so far."""

    def __init__(self, least: np.ndarray, k: int, error: float):
        self.least, self.k, self.sure = least, k, np.float32(1 - error)
        self.score, self.bag, self.n = np.zeros((len(least), 4 * k), np.float32), np.zeros((len(least), 4 * k), np.int32), np.zeros(len(least), np.int64)

    def raise_to(self, scores: np.ndarray) -> None:
        if scores.shape[1] >= self.k:
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            np.maximum(self.least, kth * self.sure, out=self.least)

    def add(self, scores: np.ndarray, start: int) -> None:
        if not self.n.any():
            self.raise_to(scores)
        q, d = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        if len(q) and (self.n + np.bincount(q, minlength=len(self.n))).max() > self.score.shape[1]:
            self.tighten()
            held = scores[q, d] >= self.least[q]
            q, d = q[held], d[held]
        self._put(q, d + start, scores[q, d])

    def tighten(self) -> tuple[np.ndarray, np.ndarray]:
        self.raise_to(self.score)
        q, at = np.nonzero((self.score >= self.least[:, None]) & (self.score > 0))
        bag, score = self.bag[q, at], self.score[q, at]
        self.score[:], self.n[:] = 0, 0
        self._put(q, bag, score)
        return q, bag

    def _put(self, q: np.ndarray, bag: np.ndarray, score: np.ndarray) -> None:
        more = np.bincount(q, minlength=len(self.n))
        if (lacks := (self.n + more).max() - self.score.shape[1]) > 0:
            wider = ((0, 0), (0, max(lacks, self.score.shape[1])))
            self.score, self.bag = np.pad(self.score, wider), np.pad(self.bag, wider)
        at = self.n[q] + np.arange(len(q)) - (np.cumsum(more) - more)[q]
        self.score[q, at], self.bag[q, at] = score, bag
        self.n += more


def _score_block(slab: _Slab, asked: _Queries, first: int, last: int, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, bag and exact score of all that may be among the ``k`` best. Single precision
    chooses, with a margin over its error; double precision decides. ``least`` rises."""
    starts, size = asked.starts[first : last + 1] - asked.starts[first], last - first
    terms = asked.terms[asked.starts[first] : asked.starts[last]]
    used, local = np.unique(terms, return_inverse=True)
    of = np.repeat(np.arange(size), np.diff(starts))
    frequent = asked.share[used] * np.bincount(local) / size >= FREQUENT
    column = np.full(len(asked.idf), -1)
    column[used] = np.arange(len(used))
    place = np.cumsum(frequent) - 1
    holds = np.zeros((size, int(frequent.sum())), np.float32)
    holds[of[frequent[local]], place[local[frequent[local]]]] = 1
    by_term = np.split(of[np.argsort(local, kind="stable")], np.cumsum(np.bincount(local))[:-1])
    most = int(np.diff(starts).max())
    step = max(1, min(CHUNK, CELLS // (len(used) + 1)))
    best = _Best(least, k, (most + 8) * 4e-7)
    for start in range(0, slab.size, step):
        end = min(slab.size, start + step)
        row, c, weight = slab.chunk(start, end, column)
        many = frequent[c]
        cells = np.zeros((end - start, holds.shape[1]), np.float32)
        cells[row[many], place[c[many]]] = weight[many]
        scores = holds @ cells.T
        row, c, weight = row[~many], c[~many], weight[~many].astype(np.float32)
        order = np.argsort(c, kind="stable")
        row, c, weight = row[order], c[order], weight[order]
        bounds = np.flatnonzero(np.diff(c, prepend=-1))
        for low, high in zip(bounds, [*bounds[1:], len(c)]):
            scores[by_term[c[low]][:, None], row[low:high]] += weight[low:high]
        best.add(scores, start)
    q, bag = best.tighten()
    order = np.argsort(bag, kind="stable")
    q, bag = q[order], bag[order]
    padded = np.full((size, most), len(used))
    padded[of, np.arange(len(terms)) - starts[of]] = local
    exact = np.zeros(len(q))
    for start in range(0, slab.size, step):
        low, high = np.searchsorted(bag, (start, start + step))
        if low < high:
            row, c, weight = slab.chunk(start, min(slab.size, start + step), column)
            cells = np.zeros((step, len(used) + 1))
            cells[row, c] = weight
            each = cells[(bag[low:high] - start)[:, None], padded[q[low:high]]]
            each.sort(axis=1)  # equal weights of other terms are an equal score, to the last digit
            exact[low:high] = each.sum(axis=1)
    return q, bag, exact


def _first(q: np.ndarray, size: int) -> np.ndarray:
    """Where each query begins in a sorted list of queries."""
    return np.searchsorted(q, np.arange(size))


def _documents(slab: _Slab, q: np.ndarray, bag: np.ndarray, score: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place in ``slab.docs`` and score of the best ``k`` documents of every query."""
    order = np.lexsort((-score, q))
    q, bag, score = q[order], bag[order], score[order]
    count = np.minimum(slab.count[bag], k)
    before = np.cumsum(count) - count
    inside = before - before[_first(q, size).clip(max=len(q) - 1)][q] < k
    border = np.full(size, np.inf)
    np.minimum.at(border, q[inside], score[inside])
    kept = score >= border[q]
    q, bag, score, count = q[kept], bag[kept], score[kept], count[kept]
    doc = np.repeat(slab.first[bag] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    q, score = np.repeat(q, count), np.repeat(score, count)
    order = np.lexsort((slab.rank[doc], -score, q))
    q, doc, score = q[order], doc[order], score[order]
    kept = np.arange(len(q)) - _first(q, size)[q] < k
    return q[kept], doc[kept], score[kept]


def _scorer(shared, mean: float, k: int, k1: float, b: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        least = np.zeros(len(asked.names), np.float32)
        slab = _Slab(asked.ids)
        for batch in batches:
            kind = batch.schema.field(0).type
            slab.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(slab.index) >= SLAB or len(slab.docs) >= 10 * SLAB:
                yield from scored(slab, asked, least, kind)
                slab = _Slab(asked.ids)
        if slab.docs:
            yield from scored(slab, asked, least, kind)

    def scored(slab: _Slab, asked: _Queries, least: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        slab.close(asked.idf, mean, k1, b)
        for first in range(0, len(asked.names), BLOCK):
            last = min(len(asked.names), first + BLOCK)
            q, bag, exact = _score_block(slab, asked, first, last, k, least[first:last])
            if len(q):
                q, doc, exact = _documents(slab, q, bag, exact, last - first, k)
                found, at = np.unique(q, return_index=True)
                hits = pa.StructArray.from_arrays([pa.array(-exact), pa.array(slab.docs[doc], kind)], names=["s", "doc"])
                offsets = pa.array(np.append(at, len(q)), pa.int32())
                yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(first + found)), pa.ListArray.from_arrays(offsets, hits)], names=["q", "hits"])

    return score
