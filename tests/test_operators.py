import math
import random
import types

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import bm25, datasets, dense, dictionary, fusion, graph, grids, mentions, metrics, rerank, spans, validity
from statuta.operators.corpus import latest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, given_, want",
    [
        (tx.match_key, "  Điều 5: Xe-máy! ", "dieu 5 xe may"), (tx.match_key, None, None), (tx.tokens, None, []), (tx.tokens, "?!", []), (tx.point_key, "điểm đ", "ddiemdd"),
        (tx.document_number, "35 / 2024/tt–bgtvt", "35/2024/TT-BGTVT"), (tx.none_if_null, " NaN ", None), (tx.truth, "Yes", True), (tx.truth, "?", None),
        (tx.dates, "từ ngày 1 tháng 2 năm 2024 và 31/2/2024, 05/06/2023", ["2023-06-05", "2024-02-01"]), (tx.numbers, "1.234.567,5 và 3,2 hay 2.5.1", ["1234567.5", "3.2", "2.5.1"]),
        (tx.slug, "Đường  bộ", "duong_bo"), (lambda c: F.length(tx.slug(c)), "xe " * 60, 89),
    ],
)
def test_text_functions(spark, f, given_, want):
    assert one(spark, f, given_) == want


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], "k string, ingested_at int, v string")
    assert sorted((r.k, r.v) for r in latest(df, "k").collect()) == [("a", "y"), ("b", "w")]
    assert latest(df.limit(0), "k").collect() == []


def test_bm25_small_case(spark):
    docs = spark.createDataFrame([("d1", "xe tải xe"), ("d2", "xe máy"), ("d3", None), ("d4", ""), (None, "xe")], "id string, text string")
    asked = spark.createDataFrame([("q1", "Xe tải?"), ("q2", "không có"), (None, "xe"), ("q3", None)], "id string, text string")
    rows = bm25.search(asked, docs, "id", "text", "id", "text", 5).collect()
    assert [(r.q, r.doc, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [("q1", "d1", 1), ("q1", "d2", 2)]
    assert bm25.search(asked.limit(0), docs, "id", "text", "id", "text", 5).collect() == []
    assert bm25.search(asked, docs.limit(0), "id", "text", "id", "text", 5).collect() == []


@pytest.mark.parametrize("block, slab, chunk, frequent", [(3, 7, 4, 0.01), (2048, 10**6, 2048, 2.0), (5, 40, 64, 0.0)])
def test_bm25_in_blocks_is_the_full_ranking(monkeypatch, block, slab, chunk, frequent):
    for name, value in (("BLOCK", block), ("SLAB", slab), ("CHUNK", chunk), ("FREQUENT", frequent)):
        monkeypatch.setattr(bm25, name, value)
    rng, words, k = random.Random(5), [f"w{i:02d}" for i in range(12)], 6
    docs = {f"d{i:03d}": sorted(rng.choices(words, weights=range(1, 13), k=rng.randint(1, 5))) for i in range(90)}
    asked = {f"q{i}": sorted(rng.sample([*words, "unknown"], 4)) for i in range(11)}
    df = {w: sum(w in d for d in docs.values()) for w in words}
    weight = {w: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    score = lambda q, d: sum(sorted(weight[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q if w in d))
    want = {q: [(doc, round(-s, 9)) for s, doc in sorted((-score(ws, d), doc) for doc, d in docs.items()) if s][:k] for q, ws in asked.items()}

    known = pd.DataFrame({"term": words, "df": [df[w] for w in words], "idf": [weight[w] for w in words]})
    shared = types.SimpleNamespace(value=bm25._Queries(pa.table({"q": list(asked), "terms": list(asked.values())}), known, len(docs)))
    batches = pa.table({"doc": list(docs), "bag": [" ".join(d) for d in docs.values()]}).to_batches(max_chunksize=8)
    got = {q: [] for q in asked}
    for batch in bm25._scorer(shared, mean, k, 1.5, 0.75)(iter(batches)):
        for row in batch.to_pylist():
            got[row["q"]] += [(h["s"], h["doc"]) for h in row["hits"]]
    assert {q: [(doc, round(-s, 9)) for s, doc in sorted(hits)[:k]] for q, hits in got.items()} == want


def test_fusion_rules(spark):
    rows = [("q", "a", 1.0, 5.0, 1.0), ("q", "b", None, None, 9.0), ("q", "c", 0.5, 1.0, None), ("one", "z", 3.0, None, None), ("none", "y", None, None, None)]
    df = spark.createDataFrame(rows, "q string, i string, dense double, bm25 double, graph double")
    out = {(r.q, r.i): (round(r.score, 4), r["rank"]) for r in fusion.fuse(df, "q", "i", {"dense": 0.5, "bm25": 0.3, "graph": 0.2}).collect()}
    assert out == {("q", "a"): (0.8, 1), ("q", "b"): (0.13, 2), ("one", "z"): (0.5, 1)}  # the weakest candidate c has score 0


def test_expand_adds_edges_up(spark):
    seeds = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0)], "q string, i string, score double")
    edges = spark.createDataFrame([("a", "c", 0.5), ("a", "c", 0.25), ("b", "c", 9.0)], "source string, target string, weight double")
    assert [tuple(r) for r in fusion.expand(seeds, edges, "q", "i", n_seeds=1).collect()] == [("q", "c", 1.5)]


def test_dense_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(40)] + [(99, None, 1)]
    df = spark.createDataFrame(vectors, "id long, v array<float>, label int")
    got = {(r.query_id, r["rank"]): r.item for r in dense.cosine_topk(df.where("id < 3"), df, "id", "v", 4).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    for q in range(3):
        order = sorted((v for v in vectors if v[0] != q and v[1]), key=lambda v: (-cosine(vectors[q][1], v[1]), v[0]))
        assert [got[q, k + 1] for k in range(4)] == [v[0] for v in order[:4]]
    assert dense.cosine_topk(df.limit(0), df, "id", "v", 4).collect() == []


SURFACES = ["xe", "xe tải", "tải nhẹ", "xe tải nhẹ hạng", "đường"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["xe", "tải", "nhẹ", "Đường", "xeđ", ","]), max_size=8).map(" ".join))
def test_greedy_dictionary_against_brute_force(text):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for s in SURFACES:
        machine.add_word(s, s)
    machine.make_automaton()
    low, taken, want = text.lower(), set(), []
    for s in sorted(SURFACES, key=lambda s: (-len(s), s)):
        at = low.find(s)
        while at >= 0:
            span = range(at, at + len(s))
            edge = lambda i: not (0 <= i < len(low)) or not low[i].isalnum()
            if edge(at - 1) and edge(at + len(s)) and not taken & set(span):
                taken |= set(span)
                want.append((at, at + len(s), s))
            at = low.find(s, at + 1)
    assert dictionary.greedy(text, machine) == sorted(want)


def test_dictionary_table(spark):
    texts = spark.createDataFrame([("a", "Xe tải, đường.", "x"), ("b", None, "x"), ("c", "", "x")], "id string, text string, surface string")
    words = spark.createDataFrame([("xe tải",), ("xe",), (None,), ("",), ("xe",)], "s string")
    assert [tuple(r) for r in dictionary.match(texts, "id", "text", words, "s").collect()] == [("a", "xe tải", 0, 6)]
    assert dictionary.match(texts, "id", "text", words.limit(0), "s").collect() == []


def test_decisions(spark):
    rows = [("a", "t1", 0.95), ("a", "t2", 0.94), ("b", "t1", 0.95), ("b", "t1", 0.9), ("c", "t", 0.7), ("d", "t", 0.2)]
    df = spark.createDataFrame(rows, "k string, t string, s double")
    got = {r.k: (r.status, r.target) for r in mentions.best_candidates(df, "k", "t", "s").collect()}
    assert got == {"a": ("ambiguous", "t1"), "b": ("resolved", "t1"), "c": ("ambiguous", "t"), "d": ("unresolved", "t")}


def test_every_mention_type_is_resolved(spark):
    paths = {"d.a5": ("dieu", "Chương 1 > Điều 5"), "d.a5.k2": ("khoan", "Chương 1 > Điều 5 > Khoản 2"), "d.a5.k2.d": ("diem", "Điều 5 > Khoản 2 > Điểm d"), "d.a5.k2.dd": ("diem", "Điều 5 > Khoản 2 > Điểm đ"), "d.a7.k1": ("khoan", "Điều 7 > Khoản 1")}
    units = spark.createDataFrame([("d", i, *v) for i, v in paths.items()] + [("e", "e.a5", "dieu", "Điều 5")], "document_id string, unit_id string, unit_type string, path_text string")
    files = [("p", "p.2", "appendix_form", "Phụ lục II", "Danh mục", "p/a.docx"), ("p", "p.m3", "form", "Mẫu số 03", "y", "p/mau_so_03.docx"), ("p", "p.m4", "form", "Mẫu số 4", "y", "p/b"), ("p", "p.m4b", "form", "Mẫu số 04", "y", None), ("o", "o.7", "form", "Mẫu số 07", "y", None)]
    attachments = spark.createDataFrame(files, "package_id string, attachment_id string, attachment_kind string, label string, title string, source_file string")
    documents = spark.createDataFrame([("d", "1/2024/TT-BVĐ"), ("e", "2/2024/NĐ-CP"), (None, "3/2024/TT-X")], "document_id string, document_number string")
    asked = [
        ("document", "2/2024/NĐ-CP", "Nghị định số 2/2024/NĐ-CP", "e", "resolved"), ("document", "9/2024/NĐ-CP", "Nghị định số 9/2024/NĐ-CP", None, "unresolved_missing_document"),
        ("appendix", "II", "Phụ lục II", "p.2", "resolved"), ("appendix", "X", "Phụ lục X", None, "unresolved_missing_attachment"),
        ("form", "3", "Mẫu số 3", "p.m3", "resolved"), ("form", "4", "Mẫu số 4", "p.m4", "ambiguous"), ("form", "07", "Mẫu số 07", None, "unresolved"),
        ("article", "5", "Điều 5", "d.a5", "resolved"), ("article", "7", "Điều 7", "d.a7.k1", "ambiguous"), ("article", "5", "Điều 5 của 2/2024/NĐ-CP", "e.a5", "resolved"), ("article", "5", "Điều 5 của 9/2024/NĐ-CP", None, "unresolved_missing_document"),
        ("clause", "2", "khoản 2 Điều 5", "d.a5.k2", "resolved"), ("clause", "2", "khoản 2 Điều này", "d.a5.k2", "resolved"), ("clause", "9", "khoản 9 Điều 5", None, "unresolved"),
        ("point", "đ", "điểm đ khoản 2 Điều 5", "d.a5.k2.dd", "resolved"), ("point", "d", "điểm d khoản 2 Điều 5", "d.a5.k2.d", "resolved"), (None, None, None, None, "unresolved"),
    ]
    rows = [(f"m{i:02}", kind, "p", "d", label, raw, "Điều 5 > Khoản 1") for i, (kind, label, raw, _, _) in enumerate(asked)]
    df = spark.createDataFrame(rows, "mention_id string, mention_type string, package_id string, document_id string, label string, raw string, source_path_text string")
    got = {r.mention_id: (r.target, r.status) for r in mentions.resolve(df, units, attachments, documents).collect()}
    assert got == {f"m{i:02}": (target, status) for i, (_, _, _, target, status) in enumerate(asked)}


def test_cooccurrence_keeps_rules(spark):
    links = [("p", "a", 1.0), ("p", "b", 2.0), ("p", "b", 1.0), ("p", "zero", 0.0), ("r", "a", 0.01), ("r", "b", 5.0), *[(f"h{i}", "hub", 1.0) for i in range(5)], ("p", "hub", 1.0)]
    df = spark.createDataFrame(links, "passage string, entity string, weight double")
    rows = graph.cooccurrence(df, most_entities=2, most_degree=4).collect()
    assert [(r.source, r.target, round(r.weight, 6)) for r in rows] == [("a", "b", 0.698135)]
    assert graph.cooccurrence(df.limit(0)).collect() == []


def test_cooccurrence_without_caps_is_whole(spark):
    links = [(f"h{i}", e, 1.0) for i in range(2501) for e in ("hub", "rim")] + [("long", f"e{i:02}", 1.0) for i in range(45)]
    df = spark.createDataFrame(links, "passage string, entity string, weight double")
    got = {(r.source, r.target): round(r.weight, 6) for r in graph.cooccurrence(df).collect()}
    want = {(f"e{i:02}", f"e{j:02}"): 0.693147 for i in range(45) for j in range(i + 1, 45)}
    assert got == want | {("hub", "rim"): 7.824846}  # ln(2502)


def test_override_cascade(spark):
    units = spark.createDataFrame([("d", "1", "2", "a", "doc"), ("d", "1", "2", "b", "doc"), ("d", "1", "3", None, "doc"), ("d", "2", None, None, "doc")], "document_id string, article string, clause string, point string, valid_from string")
    over = spark.createDataFrame([("d", "1", "2", "a", "p"), ("d", "1", "2", "", "c"), ("d", "1", "", "", None)], "document_id string, article string, clause string, point string, new_from string")
    got = {(r.article, r.clause, r.point): r.valid_from for r in validity.override(units, over).collect()}
    assert got == {("1", "2", "a"): "p", ("1", "2", "b"): "c", ("1", "3", None): None, ("2", None, None): "doc"}


def test_best_dates(spark):
    df = spark.createDataFrame([("d", 0.9, "2024-02-01"), ("d", 0.9, "2024-01-01"), ("d", 0.5, "2020-01-01"), ("e", None, "2020-01-01"), ("e", 0.1, None)], "k string, c double, day string")
    assert [tuple(r) for r in validity.best_dates(df, "k", "c", "day").collect()] == [("d", "2024-01-01", 0.9)]


def span(a, b, label="X", source="g", confidence=1.0):
    return {"span_start": a, "span_end": b, "label": label, "source": source, "confidence": confidence}


def test_span_operators(spark):
    first, second = [span(0, 5), span(10, 12)], [span(3, 9, source="m", confidence=0.5), span(4, 6, "Y", "m"), span(11, 12, "Y", "m", 0.3)]
    df = spark.createDataFrame([(first, second), (None, []), ([span(5, 5)], None)], f"a {spans.SPANS}, b {spans.SPANS}")
    merged = df.select(spans.hybrid(F.col("a"), F.col("b")).alias("x"), spans.hybrid(F.col("a"), F.col("b"), True).alias("y"), spans.non_overlapping(F.concat(F.coalesce("a", F.array()), F.coalesce("b", F.array()))).alias("z"), spans.relaxed_counts(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(s.span_start, s.span_end, s.label, s.source) for s in merged[0].x] == [(3, 9, "X", "both"), (4, 6, "Y", "m"), (10, 12, "X", "g"), (11, 12, "Y", "m")]
    assert [(s.span_start, s.span_end) for s in merged[0].y] == [(3, 9), (10, 12)]
    assert [(s.span_start, s.span_end) for s in merged[0].z] == [(0, 5), (10, 12)]
    assert tuple(merged[0].n) == (1, 1, 2) and merged[1].x == [] and merged[2].x == []


def test_grids(spark):
    html = "<table><tr><th>A</th><th colspan=2>B</th></tr><tr><td rowspan='2'>1</td><td>2<br>x</td><td></td></tr><tr><td>3</td></tr><tr></tr></table>"
    assert grids.grid(html) == [["A", "B", "B"], ["1", "2 x", ""], ["1", "3", ""], ["", "", ""]]
    assert grids.grid(None) == grids.grid("no table") == []
    df = spark.createDataFrame([("t", html), ("n", None), ("e", "")], "id string, html string").select("id", grids.html_grid(F.col("html")).alias("g"))
    assert [(r.id, r.row_no, r.content) for r in grids.grid_rows(df, "id", "g").orderBy("row_no").collect()] == [("t", 1, "A: 1 | B: 2 x"), ("t", 2, "A: 1 | B: 3")]


def test_rerank_and_context(spark):
    rows = [("q", "a", 1.0, True, "t" * 9), ("q", "b", 5.0, False, " "), ("q", "c", 0.9, None, "xy"), ("r", "d", 1.0, False, None)]
    df = spark.createDataFrame(rows, "q string, i string, score double, ok boolean, text string")
    got = [(r.q, r.i, r["rank"]) for r in rerank.rerank(df, "q", "i", "score", F.col("ok"), F.lit(None).cast("double"), 5).orderBy("q", "rank").collect()]
    assert got == [("q", "a", 1), ("q", "c", 2), ("r", "d", 1)]
    blocks = rerank.context(df.withColumn("n", F.ascii("i")), "q", "n", "i", "text", 2, 5).collect()
    assert [(r.q, r.context) for r in blocks] == [("q", "[1] a\nttttt...\n\n[2] c\nxy")]


def test_chunks_ngrams_and_split(spark):
    words = "abcdefghij"
    assert one(spark, lambda c: datasets.word_chunks(c, 4, 1), list(words), "array<string>") == ["a b c d", "d e f g", "g h i j"]
    assert one(spark, lambda c: datasets.word_chunks(c, 4, 1), [], "array<string>") == []
    assert one(spark, lambda c: datasets.ngrams(c, 2, 3), ["a", "b"], "array<string>") == ["a b"]
    df = spark.createDataFrame([(f"d{i % 37}",) for i in range(400)] + [(None,)], "document_id string")
    parts = datasets.split(df, "document_id").collect()
    assert len(parts) == 37 and {p.part for p in parts} == {"test", "dev", "train"}
    assert sum(p.n_rows for p in parts if p.part == "test") <= 40


def test_sentence_ngrams_against_brute_force(spark, tmp_path):
    from statuta.plans import graph_queries

    rng, at = random.Random(3), "2025-01-01"
    long = " ".join(f"w{i}" for i in range(17))
    rows = [("a", long, at), ("a", long, at), ("b", "xe", at), ("c", "", at), ("d", None, at), (None, "xe tải", at), ("e", "Xe tải, xe tải", at)]
    rows += [(f"r{i}", " ".join(rng.choice("abc") for _ in range(rng.randrange(20))), at) for i in range(30)]
    spark.createDataFrame(rows, "sentence_id string, text string, ingested_at string").write.parquet(f"{tmp_path}/sentences.parquet")
    want = {}
    for text in {r[0]: r[1] for r in rows if r[0]}.values():
        words = (text or "").replace(",", "").lower().replace("ả", "a").split()
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 14) + 1):
                want[" ".join(words[i:j])] = want.get(" ".join(words[i:j]), 0) + 1
    got = [tuple(r) for r in graph_queries.sentence_ngrams(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert datasets.count_ngrams(spark.createDataFrame([], "w array<string>"), "w", 2, 14).collect() == []


def test_prf_is_zero_safe(spark):
    schema = "u string, label string"
    empty = spark.createDataFrame([], schema)
    gold = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "Y")], schema)
    pred = spark.createDataFrame([("a", "X"), ("c", "X")], schema)
    got = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in metrics.set_prf(pred, gold, ["u"], "label").collect()}
    assert got == {"X": (1, 1, 0, 0.5, 1.0), "Y": (0, 0, 1, 0.0, 0.0)}
    assert metrics.set_prf(empty, empty, ["u"], "label").collect() == []
