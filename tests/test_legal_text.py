import pytest
from pyspark.sql import functions as F

from statuta.operators import answers, dense, events, mentions, models, outline, splitter, titles


def test_outline_resets_lower_levels(spark):
    text = "Mở đầu\nChương I\nĐiều 1. A\n1. B\na) C\ntiếp\n2. D\r\nChương II\n\n1. E\nĐiều 2. F"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, " \n\xa0", "x"), (None, "Điều 1", "x")], "id long, text string, line string")
    rows = outline.outline(outline.lines(df, "id", "text")).orderBy("doc", "ord").collect()
    got = [(r.ord, r.unit_type, r.label, r.parent_ord, r.path_text) for r in rows]
    assert got == [
        (0, "text", None, None, ""), (1, "chuong", "I", None, "Chương I"), (2, "dieu", "1", 1, "Chương I > Điều 1"), (3, "khoan", "1", 2, "Chương I > Điều 1 > Khoản 1"),
        (4, "diem", "a", 3, "Chương I > Điều 1 > Khoản 1 > Điểm a"), (5, "text", None, 4, "Chương I > Điều 1 > Khoản 1 > Điểm a"), (6, "khoan", "2", 2, "Chương I > Điều 1 > Khoản 2"),
        (7, "chuong", "II", None, "Chương II"), (9, "khoan", "1", 7, "Chương II > Khoản 1"), (10, "dieu", "2", 7, "Chương II > Điều 2"),
    ]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1. Xe tải. Xe máy.", ["1. Xe tải.", "Xe máy."]), ("Trụ sở tại TP. Hà Mộc. Mức 5.000.000 đồng.", ["Trụ sở tại TP. Hà Mộc.", "Mức 5.000.000 đồng."]), ("Theo Điều 5. Xe dừng.", ["Theo Điều 5. Xe dừng."]),
        ("Hồ sơ gồm giấy phép lái xe; bản sao hợp lệ; ảnh", ["Hồ sơ gồm giấy phép lái xe;", "bản sao hợp lệ;", "ảnh"]), ("a; b", ["a; b"]), ("Xe đi. Xe đi. 12.", ["Xe đi."]), ("PGS. TS. Nam đến. ...", ["PGS. TS. Nam đến. ..."]),
        ("Xe. và đi", ["Xe. và đi"]), (None, []), ("", []), (" ?! ", []),
    ],
)
def test_legal_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(splitter.sentences(F.col("x")).alias("s")).first().s == want


def test_sentence_rows_leave_gaps(spark):
    df = spark.createDataFrame([("p", "Xe đi. B. Xe máy đi!", "khoan", "t"), ("r", "a. B. C", "table_row", "t"), ("n", None, None, "t"), ("e", "", "table_row", "t")], "passage_id string, content string, unit_type string, text string")
    rows = splitter.passages_to_sentences(df.drop("text"), "passage_id", "content", "unit_type").orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.sentence_type, r.text) for r in rows] == [("p.s001", "legal_sentence", "Xe đi."), ("p.s003", "legal_sentence", "Xe máy đi!"), ("r.s001", "table_row_sentence", "a. B. C")]


def test_events_and_dated_repeals(spark):
    rows = [
        ("a", "d", "Thông tư này có hiệu lực thi hành kể từ ngày 01 tháng 3 năm 2025. Nghị định số 12/2020/NĐ-CP hết hiệu lực. Bãi bỏ Thông tư về xe số 7/2019/TT-BKL.", "2025-01-10"),
        ("b", "d", "khoản 2 Điều 5 có hiệu lực từ 1/7/2025", None), ("c", "e", "Luật này có hiệu lực sau 45 ngày, kể từ ngày ký", "2025-01-10"), ("f", "e", "Nghị định này có hiệu lực từ ngày 31/02/2025", None), ("g", "e", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, doc string, text string, issued string")
    found = events.extract(df, "id", "text", "issued").join(df.select("id", "doc"), "id")
    got = sorted((r.id, r.event_type, r.target, r.event_date, r.confidence) for r in events.date_repeals(found, "doc").collect())
    assert got == [
        ("a", "document_start", "Thông tư này", "2025-03-01", 0.98), ("a", "repeal", "12/2020/NĐ-CP", "2025-03-01", 0.8), ("a", "repeal", "7/2019/TT-BKL", "2025-03-01", 0.8),
        ("b", "unit_start", "khoản 2 Điều 5", "2025-07-01", 0.93), ("c", "document_start", "Luật này", "2025-02-24", 0.88),
    ]


def test_titles(spark):
    inventory = spark.createDataFrame([("1", "Luật Đường bộ"), ("2", "Nghị định về giấy phép lái xe hạng nặng"), ("3", "Nghị định về giấy phép lái xe hạng nhẹ"), ("4", None)], "k string, t string")
    hints = spark.createDataFrame([("theo Luật đường bộ mới",), ("Nghị định về giấy phép lái xe hạng",), ("cầu phao",), (None,), ("",)], "h string")
    assert [tuple(r) for r in titles.resolve(hints, "h", inventory, "k", "t").collect()] == [("theo Luật đường bộ mới", "1", 1.0)]
    assert titles.resolve(hints.limit(0), "h", inventory, "k", "t").collect() == []


@pytest.mark.parametrize(
    "target, answer, want",
    [
        ("phạt 1.000.000 đồng", "Bị phạt 1.000.000 đồng.", "exact_containment"), ("phạt 2.000.000 đồng", "phạt 1.000.000 đồng", "number_mismatch"), ("được phép", "Không tìm thấy căn cứ", "refusal"),
        ("phạt từ 05 đến 07 triệu", "mức phạt 5 - 7 triệu", "number_subset"), ("được dừng xe", "không được dừng xe tại đây ạ".replace("không được", "không cấp và không có"), "polarity_mismatch"),
        ("kiểm định thiết bị phanh", "thiết bị phanh đã kiểm định", "token_recall"), ("xe", None, "miss"), (None, "x", None), ("", "x", "miss"),
    ],
)
def test_agreement(spark, target, answer, want):
    df = spark.createDataFrame([(target, answer)], "t string, a string")
    assert df.select(answers.agreement(F.col("t"), F.col("a")).alias("x")).first().x == want


def test_model_boundaries(spark):
    df = spark.createDataFrame([(1, "xe tải " * 5), (2, None), (3, "lỗi"), (4, "")], "id long, text string")
    got = {r.id: list(r.embedding) for r in models.encode(df, "id", "text", lambda: lambda ts: [[float(len(t))] for t in ts], 2).collect()}
    assert got == {1: [35.0], 3: [3.0], 4: [0.0]}

    def load():
        def tagger(texts):
            if any("lỗi" in t for t in texts):
                raise RuntimeError
            return [[(t.find("tải"), t.find("tải") + 3, "X", 0.5)] for t in texts]

        return tagger

    rows = models.tag(df, "id", "text", load, size=4, overlap=2).collect()
    assert sorted((r.id, r.span_start, r.span_end) for r in rows) == [(1, 3, 6), (1, 10, 13), (1, 17, 20), (1, 24, 27)]
    with pytest.raises(Exception):
        models.encode(df, "id", "text", lambda: lambda ts: [], 2).collect()


def test_annex_levels(spark):
    text = "I. Chung\n1. Xe\n1.1. Tải\n1.1.2 Nhẹ\na) Điểm\n- gạch\n2. Máy\nB. Khác"
    df = spark.createDataFrame([("a", text), ("b", None)], "id string, text string")
    rows = outline.outline(outline.lines(df, "id", "text"), outline.ANNEX_LEVELS, outline.ANNEX_NAMES).orderBy("ord").collect()
    assert [(r.unit_type, r.label, r.parent_ord) for r in rows] == [("roman", "I", None), ("decimal_1", "1", 0), ("decimal_2", "1.1", 1), ("decimal_3", "1.1.2", 2), ("point", "a", 3), ("bullet", "-", 4), ("decimal_1", "2", 0), ("alpha", "B", 0)]
    assert rows[3].path_text == "Mục I > 1 > 1.1 > 1.1.2"


def test_amendments_and_form_fields(spark):
    df = spark.createDataFrame([("a", "Sửa đổi, bổ sung Điều 5. Thay thế biển. Bãi bỏ Thông tư 7"), ("b", None), ("c", "")], "id string, text string")
    assert sorted((r.action, r.target) for r in mentions.amendments(df, "id", "text").collect()) == [("bãi bỏ", "thông tư"), ("sửa đổi", "điều")]
    forms = spark.createDataFrame([("a", "Mã hồ sơ: ......\nMàu sơn: Phú Sậy 3\nkhông có\n: x"), ("b", None)], "id string, text string")
    assert sorted((r.label, r.value, r.filled) for r in mentions.form_fields(forms, "id", "text").collect()) == [("Màu sơn", "Phú Sậy 3", True), ("Mã hồ sơ", None, False)]


def test_mining(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "A"), (1, [1.0, 0.0], "A"), (2, [0.0, 1.0], "A"), (3, [1.0, 0.0], "B"), (4, None, "A")], "id long, v array<float>, label string")
    got = dense.mine(df.where("id = 0").withColumn("n", F.lit(0)), df, "id", "v", "label", "n").collect()
    assert [(r.candidate, round(r.score, 6)) for r in got] == [(0, 0.888863)]  # a count of 0 counts as 1
