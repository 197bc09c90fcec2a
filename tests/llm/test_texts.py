import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import encoding, mixing, ranking, repetition, scripts, sentences, tokens

LONG = "Người lái xe phải dừng lại. " * 2000


def split(text, chunk=4096):
    _, a, b = sentences.boundaries([text], chunk)
    return [text[i:j] for i, j in zip(a, b)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Điều 5. Quy cách biển phụ"],
        ["Trụ sở tại TP. Đắk Lửa, Q. 4.", "Xe có."],
        ["Báo cáo do PGS. TS. N. V. C chủ trì, ThS. T. D phản biện.", "Xe đi..."],
        ["theo Phụ lục V.", "Chủ xe thuộc nhóm 2.5.1.", "Xe có đèn, gương, v.v. và còi."],
        ["Biển ghi “Nguy hiểm! Đi chậm.” phải đặt gần.", "“Chủ xe phải dừng.”", "Người dẫn"],
        ["Thông tin tại https://a.example/t?id=9.4 hoặc b@c.example.", "Xe"],
        ["渡口答复：“我们保持距离。”", "每超一根，隧道。", "标牌写明“停车。左右看。”，边境。"],
        ["標識には「止まれ。見よ。」と記し、国境。", "濃い。"],
        ["Die Sperrung gilt ab dem 23. März.", "Das Schild „Halt. Warten.“ und die."],
        ["क्या डॉ. के. वर्णा का नियम 57 लागू होगा?", "नौ दिन।"],
        ["Плата 27 г.", "Нужно ли п. 9 см. ст. 16 «Стой. Уступи.», и пункт."],
        ["ด่านชายแดนตรวจ", "ทุกเพลาคือ 24.3 เมตร", "เจ้าของ"],
        ["표지판에 “정지. 좌우 확인.”이라고 적고 한다.", "계량소"],
    ],
)
def test_sentences_of_many_scripts(parts):
    assert split(" ".join(parts) if not any(c in parts[0] for c in "。") else "".join(parts)) == parts
    assert split("\r\n ".join(parts) + "\n") == parts


def test_chunks_do_not_change_sentences():
    text = "Xe (xem Mục 2. Bảng 3) “a. B.” đi. Người! " * 50
    assert split(text, 7) == split(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("aA.! \n“”(1Đ​", max_size=25), max_size=5))
def test_sentences_are_ordered_trimmed_and_local(texts):
    number, begin, end = sentences.boundaries(texts)
    for i, text in enumerate(texts):
        mine = list(zip(begin[number == i], end[number == i]))
        alone = list(zip(*sentences.boundaries([text])[1:]))
        assert mine == alone
        assert all(a < b for a, b in mine) and all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))
        assert all(text[a:b].strip() == text[a:b] for a, b in mine)
        assert "".join("".join(text[a:b] for a, b in mine).split()) == "".join(text.split())


def test_sentence_table_with_nulls_copies_and_clashing_columns(spark):
    rows = [("a", "Xe. Người.", 1), ("a", "Xe. Người.", 2), ("b", None, 1), ("c", "", 1), ("d", " \n ", 1), (None, "Xe.", 1), ("e", LONG, 1)]
    df = spark.createDataFrame(rows, "id string, text string, src int").withColumnRenamed("src", "record_id")
    got = sentences.sentences(sentences.split_table(df, "t", "id", "text")).collect()
    assert sum(r.record_id == "a" for r in got) == 2 and sum(r.record_id == "e" for r in got) == 2000
    assert {r.record_id for r in got} == {"a", "e"}
    empty = sentences.sentences(sentences.split_table(df.limit(0), "t", "id", "text"))
    assert empty.collect() == []


SCORES = "question_id string, passage_id string, score_components struct<dense double, bm25 double, graph double, reference double>, q int, item int"


def brute(rows):
    out = {}
    by = {}
    for q, p, c, *_ in rows:
        if q is not None and p is not None:
            own = by.setdefault(q, {}).setdefault(p, [None] * 4)
            for i, v in enumerate(c or [None] * 4):
                if v is not None and v == v and (own[i] is None or v > own[i]):
                    own[i] = v
    for q, items in by.items():
        n = len(items)
        vector = {}
        for p, own in items.items():
            pct = []
            for i, v in enumerate(own):
                below = sum(1 for o in items.values() if v is not None and (o[i] is None or o[i] < v))
                pct.append(below / (n - 1) if v is not None and n > 1 else 0.0)
            vector[p] = sorted(pct)
        order = sorted(items, key=lambda p: ([-x for x in vector[p]], p))
        out |= {(q, k + 1, p) for k, p in enumerate(order)} if isinstance(out, set) else {}
        out = (out if isinstance(out, set) else set()) | {(q, k + 1, p) for k, p in enumerate(order)}
    return out or set()


def test_leximin_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in ("hot",) * 60 + ("a",) * 7 + ("one",):
        vals = [float(v) if rng.random() > 0.3 else None for v in rng.integers(0, 6, 4)]
        rows.append((q, f"p{rng.integers(0, 40):02d}", vals, 1, 1))
    rows += [("nan", "x", [float("nan"), 1.0, None, 2.0], 1, 1), ("nan", "y", [1.0, 1.0, 1.0, 1.0], 1, 1), (None, "x", None, 1, 1), ("nul", "x", None, 1, 1)]
    df = spark.createDataFrame(rows, SCORES)
    scored = ranking.components(df, "question_id", "passage_id", "score_components", ranking.COMPONENTS)
    want = brute(rows)
    ranked = ranking.percentiles(scored)
    assert {tuple(r) for r in ranking.rank_all(ranked).collect()} == want
    assert {tuple(r) for r in ranking.best(ranked, 3).collect()} == {w for w in want if w[1] <= 3}
    nothing = ranking.components(df.limit(0), "question_id", "passage_id", "score_components", ranking.COMPONENTS)
    assert ranking.best(ranking.percentiles(nothing), 3).collect() == []


CLEAN = ["Người điều khiển xe phải dừng lại trước vạch.", "Chủ sở hữu xe cổ được phép trả lại giấy hẹn.", "Đơn vị thi công phải lập biên bản về bề rộng 5 m² đường.", "Die Wache prüft den hinteren Strahler über dem Grenzwert."]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 40] + [(None,), ("",)], "value string")
    return encoding.Model.of(encoding.pair_counts(df))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp437", "mac-roman"])
def test_restores_round_trips(model, wrong):
    for text in CLEAN[:2]:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())
        assert encoding.repair(bad, model)[::2] == (True, text)
        assert encoding.suspects([bad, text], model).tolist() == [True, False]


def test_restores_double_damage_and_fonts(model):
    text = CLEAN[0]
    twice = text
    for _ in range(2):
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in twice.encode())
    assert encoding.repair(twice, model)[2] == text
    inverse = {v: chr(k) for k, v in encoding.TCVN3.items()}
    assert encoding.repair("".join(inverse.get(c, c) for c in text), model) == (True, True, text)


def test_lost_text_is_found_and_sound_text_is_not(model):
    assert encoding.repair("Ng��i đi�u khi�n", model)[:2] == (True, False)
    assert encoding.repair("Ng??i ?i?u khi?n xe", model)[:2] == (True, False)
    for text in [*CLEAN, "Đã dừng chưa? Người lái", "https://a.example/t?id=1", "", " "]:
        assert not encoding.repair(text, model)[0]


def test_encoding_table(spark, model):
    bad = "".join(bytes([b]).decode("latin-1") for b in CLEAN[0].encode())
    df = spark.createDataFrame([("a", bad, 1), ("a", bad, 1), ("b", None, 1), (None, bad, 1), ("c", "", 1), ("d", LONG, 1)], "id string, text string, src int")
    assert [tuple(r) for r in encoding.once(encoding.examine(df, "t", "id", "text", model)).collect()] == [("t", "a", True, CLEAN[0])]
    assert encoding.examine(df.limit(0), "t", "id", "text", model).collect() == []


@pytest.mark.parametrize(
    "given_, plain",
    [
        ("Ｔàｉ ｘế", "Tài xế"), ("Ngườі đi xе", "Người đi xe"), ("хе máy", "xe máy"), ("Biển", "Biển"), ("Ðiều", "Điều"), ("t‌ra c­ứu﻿", "tra cứu"),
        ("BÁO\xa0CÁO", "BÁO CÁO"), ("Phụ lục Ⅻ", "Phụ lục XII"), ("ﬁn", "fin"), ("CT‑TCV", "CT-TCV"), ("ΤS. Ν. V", "TS. N. V"), ("Вoдитeль", "Водитель"), ("한다".encode().decode(), "한다"),
    ],
)
def test_one_form(given_, plain):
    assert scripts.normalize(given_) == plain
    assert scripts.disguised(given_) == (given_ != plain)


@pytest.mark.parametrize("text", ["5 m², ½ ô, 34°C, ±5%, Ø 25 mm, 12 µm", "ст. 16 приложения V, и", "（別表VII。第63欄）", "क्ष्‍म", "चौड़ाई", "« Arrêt »", "Göteryd", "", "  "])
def test_own_script_is_no_disguise(text):
    assert not scripts.disguised(text)


@pytest.mark.parametrize("text", ["МОСКВА", "САМ НЕ ТО", "ışık", "Þór Ðað", "kΩ và μm", "cosφ", "και ο νόμος", "CT検査", "❤️ xe 👩‍👩‍👧"])
def test_letters_of_a_language_are_kept(text):
    assert not scripts.disguised(text) and scripts.normalize(text) == text


@pytest.mark.parametrize(
    "given_, plain",
    [("ρaypal", "paypal"), ("αpple", "apple"), ("ꓮpple", "Apple"), ("xе\U000e0041 máy", "xe máy"), ("a\u2800b", "a b"), ("Dıe Wache", "Die Wache"), ("Москва. Mocква", "Москва. Москва"), ("Яndex", "Яndex"), ("Москва COCHA сосна", "Москва СОСНА сосна"), ("дом COCHA", "дом COCHA"), ("в СОСНУ, COCНУ", "в СОСНУ, СОСНУ")],
)
def test_resolved_script_sets(given_, plain):
    assert scripts.normalize(given_) == plain
    assert scripts.disguised(given_) == (given_ != plain or given_ == "Яndex")


def test_decomposed_hangul_and_kana():
    import unicodedata

    for text in ("한다", "がぎ"):
        assert scripts.normalize(unicodedata.normalize("NFD", text)) == text
        assert scripts.disguised(unicodedata.normalize("NFD", text))


def test_disguise_table(spark, model):
    df = spark.createDataFrame([("a", "хе máy", 1), ("a", "хе máy", 1), ("b", None, 1), ("c", "xe", 1), (None, "хе", 1)], "id string, text string, src int")
    got = encoding.once(scripts.examine(df, "t", "id", "text", model)).collect()
    assert [tuple(r) for r in got] == [("t", "a", True, "xe máy")]
    assert encoding.once(scripts.examine(df, "t", "id", "text", model, everything=True)).count() == 2


def test_tokenizer_against_the_reference_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    theirs = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    machine = tokens.Encoder()
    texts = [*CLEAN, "", "   ", "a  b\n\n c", "<|endoftext|> x", "🙂🙂👩‍👩‍👧" * 9, "x" * 999, LONG, "渡口答复：“我们保持距离。”" * 20, " ' 're'll \t\r\n"]
    ours = [[i for w in words for i in w] for words in machine.encode(texts)]
    assert ours == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), max_size=8))
def test_trie_walk_equals_plain_merging(words):
    machine = tokens.encoder()
    words = [w for w in words if not any("\ud800" <= c < "" for c in w)]
    for word, ids in machine.encode_words(sorted(set(words))).items():
        assert list(ids) == machine.merge(word.encode())


def test_token_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in tokens.encode_table(df, "doc_id", "text").collect()} == {1: [], 2: [], 3: [64, 275]}
    assert tokens.encode_table(df.limit(0), "doc_id", "text").collect() == []


def test_mix_meets_targets_and_caps(spark):
    docs = [(i, "big", 10 + i % 7) for i in range(5000)] + [(10_000 + i, "small", 20) for i in range(50)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "small", 0)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("small", 0.3, 4), ("none", 0.1, 5), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(counted, targets, exact=True)
    rows = {r.source: r for r in report.collect()}
    uses = drawn.collect()
    assert max(r.uses for r in uses if r.source == "small") <= 4 and max(r.uses for r in uses if r.source == "big") == 1
    assert len({r.doc_id for r in uses}) == len(uses) and {r.source for r in uses} == {"big", "small"}
    assert rows["none"].actual_share == 0 and not rows["none"].met
    assert abs(rows["big"].actual_share - 2 / 3) < 0.01 and abs(rows["small"].actual_share - 1 / 3) < 0.01
    for s in ("big", "small"):
        assert rows[s].used_tokens == sum(r.uses * r.n_tokens for r in uses if r.source == s) <= rows[s].budget + 1e-6


def test_exponent_respects_caps():
    have, caps = {"a": 900.0, "b": 100.0, "c": 300.0}, {"a": 1800.0, "b": 200.0, "c": 330.0}
    got, x, even = mixing.fill({"a": 400.0, "b": 200.0, "c": 300.0}, have, caps, 1000.0)
    assert 0 < x <= 1 and even is None and abs(sum(got.values()) - 1000) < 1e-6 and got["c"] <= 330 * (1 + 1e-9) and got["b"] == 200
    assert abs(got["c"] - 330) < 1e-6  # the least exponent that fits
    assert mixing.fill({"a": 400.0, "b": 200.0, "c": 300.0}, have, caps, 950.0)[1] == 0
    full = mixing.fill({"a": 400.0, "b": 200.0, "c": 300.0}, have, caps, 5000.0)[0]
    assert full == caps  # nothing more to give


def test_entropy_is_met_or_reported():
    have = {"a": 9000.0, "b": 1000.0}
    caps = {s: 9 * n for s, n in have.items()}
    got, x, even = mixing.fill({"a": 100.0, "b": 100.0}, have, caps, 2000.0, least_entropy=0.5)
    assert even and 0 < x < 1 and abs(mixing.entropy(got) - 0.5) < 1e-6
    got, x, even = mixing.fill({"a": 1000.0, "b": 1.0}, have, caps, 1010.0, least_entropy=0.69)
    assert even is False and x == 0  # the most even mix there is


def test_mix_of_a_pass_bisects_the_exponent(spark, tmp_path):
    from statuta.llm.queries import QUERIES

    docs = [(f"b{i}", "big", f"xe tải số {i}") for i in range(600)] + [(f"m{i}", "mid", f"cầu đường {i}") for i in range(200)] + [(f"s{i}", "small", f"đường bộ {i}") for i in range(20)] + [("o", "other", "xe")]
    spark.createDataFrame(docs, "doc_id string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("big", 0.35, 2), ("mid", 0.15, 1), ("small", 0.4, 3), ("none", 0.1, 2)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    rows = {r.source: r for r in QUERIES["p7_mix"](spark, str(tmp_path)).collect()}
    total = sum(rows[s].n_tokens for s in ("big", "mid", "small"))
    assert 0 < rows["big"].temperature < 1 and rows["small"].most_uses == 3 and rows["mid"].most_uses == 1
    assert abs(rows["small"].used_tokens - 3 * rows["small"].n_tokens) < 10 and abs(sum(r.used_tokens for r in rows.values()) - total) < 30
    assert rows["big"].met and rows["mid"].met and not rows["small"].met and not rows["none"].met and rows["none"].actual_share == 0
    uses = QUERIES["p7_drawn"](spark, str(tmp_path)).collect()
    assert sum(r.uses * r.n_tokens for r in uses) == sum(r.used_tokens for r in rows.values())
    exact = {r.source: r for r in QUERIES["p7_mix_exact"](spark, str(tmp_path)).collect()}
    assert abs(exact["small"].actual_share - 0.4 / 0.9) < 0.02 and exact["small"].met and exact["big"].met and exact["mid"].met


def test_mix_of_empty_tables(spark):
    counted = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(counted, targets)
    assert drawn.collect() == [] and report.collect() == []


def plain_share(text):
    """Quadratic version for texts of one sentence in words."""
    words = text.lower().split()
    hit = [False] * len(words)
    for i in range(len(words)):
        for n in range(1, repetition.WORDS):
            if i >= 2 * n - 1 and words[i - n + 1 : i + 1] == words[i - 2 * n + 1 : i - n + 1]:
                for j in range(i - n + 1, i + 1):
                    hit[j] = True
        for j in range(i):
            if i + repetition.WORDS <= len(words) and words[i : i + repetition.WORDS] == words[j : j + repetition.WORDS]:
                for k in range(i, i + repetition.WORDS):
                    hit[k] = True
    return sum(len(w) for w, h in zip(words, hit) if h), sum(map(len, words))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["xe", "đi", "người", "đường"]), max_size=30))
def test_repetition_against_brute_force(words):
    assert repetition.repeated(" ".join(words)) == plain_share(" ".join(words))


def test_short_phrases_count():
    five = "mot hai ba bon nam"
    assert repetition.repeated(f"{five} {five}") == (len(five) - 4, 2 * (len(five) - 4))
    scattered = repetition.repeated(f"{five} xe tai {five} duong bo {five}")
    assert scattered[0] == 2 * (len(five) - 4)
    assert repetition.repeated("a b c d a b c d")[0] == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["xe ", "đi ", "路", "車", "線"]), max_size=40))
def test_mixed_scripts_cover_maximal_repeats(parts):
    tokens, bounds, dense = repetition._tokens("".join(parts))
    weight = [repetition._weight(t) for t in tokens]
    hit = [False] * len(tokens)
    for i in range(len(tokens)):
        for j in range(i):
            n = 0
            while i + n < len(tokens) and tokens[i + n] == tokens[j + n]:
                n += 1
            if sum(weight[i : i + n]) >= repetition.WORDS * 8:
                hit[i : i + n] = [True] * n
    for step in range(1, 8 if dense else repetition.WORDS):
        for i in range(step, len(tokens) - step + 1):
            if tokens[i : i + step] == tokens[i - step : i]:
                hit[i : i + step] = [True] * step
    assert repetition._repeated(tokens, bounds, dense)[0] == sum(len(t) for t, h in zip(tokens, hit) if h)


def test_divergence_finds_what_repeats(spark):
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdghklmnprstvx" for b in ("a", "e", "i", "o", "u", "an", "en", "in", "on", "un")]
    usual = [(i, " ".join(rng.choice(words) for _ in range(60)) + ".", "vi") for i in range(60)]
    phrase = " ".join(rng.choice(words) for _ in range(12)) + ". "
    df = spark.createDataFrame([*usual, (100, phrase * 5, "VI"), (101, "đi đi đi đi đi đi", "vi"), (102, None, None), (103, "", "vi"), (None, phrase * 5, "vi")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in repetition.found(df, "doc_id", "text", "lang").collect()} == {100, 101}
    excess = {r.doc_id: r.word_excess for r in repetition.divergence(df, "doc_id", "text", "lang").collect()}
    assert excess[100] >= repetition.WORD_EXCESS and excess[101] is None and excess[102] is None and len(excess) == 64
    assert repetition.found(df.limit(0), "doc_id", "text", "lang").collect() == []


def test_repeats_may_differ_in_dress():
    a, n = repetition.repeated("1. Cấm rẽ trái. 2. CẤM  RẼ TRÁI! 3) cấm rẽ trái")
    assert a * 3 == n * 2
    assert repetition.repeated("車線の幅は十分な車間を保つ。車線の幅は十分な車間を保つ。")[0] > 0


def test_repetition_table(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, " 12 ", 1.0), (4, LONG, 1.0), (None, LONG, 1.0)], "doc_id long, text string, repeated_share double")
    got = {r.doc_id: r.repeated_share for r in repetition.repeated_share(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] > 0.99 and len(got) == 4
    with_lang = df.selectExpr("doc_id", "text", "case when doc_id = 4 then 'vi-VN' end as lang")
    rows = {r.doc_id: r for r in repetition.divergence(with_lang, "doc_id", "text", "lang").collect()}
    assert rows[1].class_distance is None and rows[4].class_distance < 1e-6
