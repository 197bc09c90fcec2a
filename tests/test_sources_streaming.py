import json

import pytest

from statuta.sources import files, sinks
from statuta.streaming import memory

SCHEMA = "conversation string, turn int, question string, entities array<string>, documents array<string>"
TURNS = [
    ("a", 1, "q1", ["x", "y"], ["d1"]), ("a", 2, None, ["x"], None), ("a", 2, "dup", ["zz"], None), ("a", 3, "q3", ["z", "", None, "w"], ["d2", "d1"]),
    ("b", None, "q", None, []), (None, 1, "lost", None, None),
]


def test_jsonl_csv_and_queries(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(path), "a int, b string").collect()] == [(1, "x"), (2, None)]
    assert [r._ord for r in files.read_jsonl_ordered(spark, str(path), "a int, b string").orderBy("_ord").collect()] == [0, 2]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), "a int").collect()
    assert files.read_jsonl(spark, str(bad), "a int", "drop").count() == 1
    assert files.read_jsonl(spark, str(bad), "a int", "keep").cache().where("_corrupt is not null").count() == 1
    table = tmp_path / "t.csv"
    table.write_text("﻿id,when\n1,null\n2, 2024-01-01\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(table), ["id", "when", "more"]).collect()] == [("1", None, None), ("2", "2024-01-01", None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["id"]).collect() == []
    queries = tmp_path / "q.txt"
    queries.write_text('plain\n\n{"query": "a"}\n{"question": "b"}\n{"other": 1}\n')
    assert [r.query for r in files.read_queries(spark, str(queries)).collect()] == ["plain", "a", "b"]


def test_packages_and_sinks(spark, tmp_path):
    for name in ("p2", "p1", "empty"):
        (tmp_path / name).mkdir()
        if name != "empty":
            (tmp_path / name / "units.jsonl").write_text(json.dumps({"id": name}) + "\n")
    assert [p[-2:] for p in files.package_paths(spark, str(tmp_path), "units.jsonl")] == ["p1", "p2"]
    rows = files.read_packages(spark, str(tmp_path), "units.jsonl", "id string")
    assert sorted(tuple(r) for r in rows.collect()) == [("p1", "p1"), ("p2", "p2")]
    sinks.write_csv(rows.selectExpr("id", "cast(null as string) as gone"), str(tmp_path / "out"), ["id", "gone"], ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("gone = 'null'").count() == 2
    sinks.write_jsonl(rows, str(tmp_path / "j"), by=["package_id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    terms = spark.createDataFrame([("A", "x"), ("A", "long"), ("B", None)], "label string, term string")
    sinks.write_terms(terms, str(tmp_path / "terms"), "label", "term")
    assert [r.value for r in spark.read.text(str(tmp_path / "terms" / "label=A")).collect()] == ["long", "x"]
    assert [r.id for r in sinks.remaining(rows, rows.where("id = 'p1'"), "id").collect()] == ["p2"]
    both = files.union_with_defaults([rows.select("id"), rows.withColumn("kind", rows.id)], {"kind": "?"})
    assert both.where("kind = '?'").count() == 2


def test_memory_in_batch_and_stream(spark, tmp_path):
    want = {"a": (3, "q3", ["y", "x", "z", "w"][-3:], ["d2", "d1"]), "b": (1, "q", [], [])}
    got = {r.conversation: (r.turns, r.last_question, r.entities, r.documents) for r in memory.batch(spark.createDataFrame(TURNS, SCHEMA), 3).collect()}
    assert got == want
    assert memory.batch(spark.createDataFrame([], SCHEMA)).collect() == []
    for i, part in enumerate((TURNS[:2], TURNS[3:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        turns = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        query = memory.stream(turns, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "memory"))).trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "memory")).collect()
    last = {c: max((r for r in rows if r.conversation == c), key=lambda r: r.turns) for c in ("a", "b")}
    assert {c: (r.turns, r.last_question, r.entities, r.documents) for c, r in last.items()} == want


def test_discovery_json_and_index(spark, tmp_path):
    root = tmp_path / "root"
    for name, text in (("p1/main/units.jsonl", '{"id":"a"}'), ("p1/hybrid.jsonl", "{}"), ("p2/plain.jsonl", "{}"), ("p2/hybrid.jsonl", "{}"), ("list.json", '[{"id":"x"},{"id":null}]')):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert [p.split("root")[-1] for p in files.units_files(spark, str(root))] == ["/p1/main/units.jsonl"]
    assert [p.split("/")[-2:] for p in files.one_per_package(spark, str(root), ["hybrid.jsonl", "plain.jsonl"])] == [["p1", "hybrid.jsonl"], ["p2", "hybrid.jsonl"]]
    assert [r.id for r in files.read_json(spark, f"{root}/list.json", "id string").collect()] == ["x", None]
    assert files.read_json(spark, f"{root}/none.json", "id string").collect() == [] and files.units_files(spark, str(tmp_path / "empty")) == []
    rows = spark.createDataFrame([("s", None, None, 1, "old"), ("s", None, None, 2, "new"), (None, "", "p", 1, "x"), (None, None, None, 1, "y")], "sentence_id string, source_unit_id string, passage_id string, n int, v string")
    assert {r.row_key: r.v for r in files.keyed_sentences(rows, "n").collect()} == {"s": "new", "p": "x"}
    one = spark.createDataFrame([("t", "d")], "term string, doc string")
    sinks.write_index({name: one for name in sinks.INDEX_PARTS}, f"{tmp_path}/index")
    assert sinks.open_index(spark, f"{tmp_path}/index")["postings"].count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.open_index(spark, f"{tmp_path}/index", dense=True)
