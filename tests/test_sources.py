import json

import pytest

from siltstone.sources import readers, writers
from siltstone.streaming import sessions


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/B.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert readers.pdf_files(spark, str(tmp_path)).count() == 2
    assert readers.pdf_files(spark, str(tmp_path), recursive=False).count() == 1
    store = [{"page_content": "甲", "metadata": {"doc_id": "d", "page_num": 2, "chunk_id": "c"}}, {"page_content": "乙"}]
    rows = readers.json_store(spark, write(tmp_path / "s.json", json.dumps(store, ensure_ascii=False))).orderBy("content").collect()
    assert {(r["content"], r["doc_id"]) for r in rows} == {("甲", "d"), ("乙", None)}
    lines = "\n".join(json.dumps(x) for x in ({"question": "q1", "gt": "r1"}, {"query": " ", "user_input": "q2"}, {"reference": "r"}))
    assert [(r["query"], r["reference"]) for r in readers.test_set(spark, write(tmp_path / "t.jsonl", lines)).orderBy("query").collect()] == [("q1", "r1"), ("q2", None)]
    shapes = "\n".join(json.dumps(x) for x in ({"query": "a", "pos": ["p"], "neg": ["n"]}, {"query": "b", "positive_doc": "p", "negative_doc": ""}, {"query": "c", "positive_doc": "p", "negative_doc": "n"}))
    assert sorted(r["query"] for r in readers.triplets(spark, write(tmp_path / "x.jsonl", shapes)).collect()) == ["a", "c"]
    assert readers.dictionary(spark, write(tmp_path / "d.txt", "一\n\n二\n")).count() == 2
    good = write(tmp_path / "g.json", json.dumps([{"query": "q", "gt": ["a"]}]))
    assert readers.ground_truth(spark, good).first()["gt"] == ["a"]
    with pytest.raises(Exception, match="query and gt"):
        readers.ground_truth(spark, write(tmp_path / "h.json", json.dumps([{"query": "q"}]))).collect()


def test_build_and_write(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "第一段。" * 100, "f.pdf"), ("d", 2, " ", "f.pdf")], "doc_id string, page_num int, content string, file_name string")
    stored = writers.build(pages, str(tmp_path / "lake"), 80, 10)
    ids = [r["chunk_id"] for r in stored.orderBy("chunk_id").collect()]
    assert "d_p1_c1" in ids and len(ids) == len(set(ids)) > 3
    assert spark.read.parquet(str(tmp_path / "lake/bm25/postings")).count() > 0
    writers.json_store(stored, str(tmp_path / "store"))
    assert spark.read.json(str(tmp_path / "store")).select("metadata.chunk_id").count() == len(ids)
    writers.report(spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, recall double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/means")).first()["recall"] == 0.75
    assert readers.front_text(pages).first()["text"].startswith("第一段")


def test_session_window(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "session bigint, turn bigint, role string, text string"
    spark.createDataFrame([(s, t, "user", f"m{t}") for s in (1, 2) for t in range(30)], schema).coalesce(1).write.parquet(str(folder))
    stream = sessions.windowed_history(spark.readStream.schema(schema).parquet(str(folder)))
    query = stream.writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        rows = spark.table("history").collect()
    finally:
        query.stop()
    assert sorted(r["turn"] for r in rows if r["session"] == 1) == list(range(10, 30))


def test_event_windows(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 1.0)], "event_id bigint, ts string, event_type string, value double")
    events.selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = sessions.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        rows = spark.table("counts").collect()
    finally:
        query.stop()
    assert [(r["event_type"], r["n"], r["value"]) for r in rows] == [("a", 2, 3.0)]
