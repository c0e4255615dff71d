import pytest
from pyspark.sql import functions as F

from siltstone.functions import metrics, text
from siltstone.operators import bm25, layout, recognition, vector
from siltstone.sources import readers

B = "block_id bigint, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block_type string, source string, confidence double"


def blocks(spark, *rows):
    return spark.createDataFrame([(i, "d", 1, *map(float, r[:4]), r[4], r[5] if len(r) > 5 else "text", "native", 1.0) for i, r in enumerate(rows)], B)


def test_two_columns_do_not_merge_across(spark):
    left = [(50, 100 + 20 * i, 270, 112 + 20 * i, f"左{i}") for i in range(3)]
    right = [(320, 100 + 20 * i, 550, 112 + 20 * i, f"右{i}") for i in range(3)]
    got = {(r["block_id"], r["paragraph"]) for r in layout.paragraphs(blocks(spark, (50, 40, 550, 60, "题"), *left, *right), "block_id").collect()}
    assert got == {(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (5, 3), (6, 3)}


def test_line_blocks_and_elements(spark):
    words = blocks(spark, (10, 100, 20, 110, "净"), (30, 103, 40, 112, "利润"), (10, 106, 20, 116, "下一行"), (10, 820, 20, 830, " "))
    got = {(r["line"], r["text"], r["block_type"]) for r in layout.line_blocks(words, "block_id").collect()}
    assert got == {(1, "净 利润", "text"), (2, "下一行", "text")}
    page = blocks(spark, (10, 100, 500, 110, "前文一"), (10, 118, 500, 128, "前文二"), (10, 200, 500, 260, "| a |", "table"), (10, 210, 50, 220, "格"), (10, 300, 500, 310, "后文"))
    assert layout.element_markdown(layout.page_elements(page, "block_id")).first()["markdown"] == "前文一\n前文二\n\n| a |\n\n后文"


def test_renderings(spark):
    page = blocks(spark, (10, 10, 500, 20, "头", "header"), (10, 100, 500, 110, "题", "title"), (10, 120, 500, 130, "正\n文"), (10, 140, 500, 150, "|x|", "table"))
    second = page.withColumn("page", F.lit(2)).withColumn("block_id", F.col("block_id") + 10)
    got = [r["markdown"] for r in layout.render(page.unionByName(second), "block_id", "markdown").orderBy("page").collect()]
    assert got[0] == "## Page 1\n\n\n*头*\n\n\n### 题\n\n正 文\n\n|x|\n" and got[1].startswith("\n---\n\n## Page 2\n\n")
    assert {r["block_id"] for r in layout.render(page, "block_id").collect()} == {1, 2, 3}
    assert layout.render(page, "block_id", "json").first()["total_blocks"] == 4
    with pytest.raises(ValueError):
        layout.render(page, "block_id", "other")


def test_recognised_lines_follow_their_highest_top(spark):
    words = blocks(spark, (10, 100, 20, 110, "a"), (30, 95, 40, 105, "b"), (50, 104, 60, 114, "c"), (70, 105.5, 80, 115, "d"), (10, 100, 20, 110, " ")).withColumn("confidence", F.lit(80.0))
    got = [(r["line"], r["text"], r["y0"], r["confidence"]) for r in layout.recognised_lines(words, "block_id").orderBy("line").collect()]
    assert got == [(1, "a b c", 95.0, 0.8), (2, "d", 105.5, 0.8)]


def test_glossary_table(spark):
    page = blocks(spark, (10, 100, 20, 110, "本公司"), (100, 101, 200, 111, "指 甲股份"), (10, 120, 20, 130, "集团"), (100, 121, 200, 131, "指 乙"), (10, 150, 20, 160, "正文"))
    got = [r["markdown"] for r in layout.glossary_rows(layout.tab_rows(page, "block_id")).orderBy("row").collect()]
    assert got == ["| 术语 | 释义 |\n|------|------|\n| 本公司 | 指 甲股份 |", "| 集团 | 指 乙 |", "正文"]


def test_spans(spark):
    rows = [("d", 1, 0, 0, 0, "营业", 1.0, 1.0, 5.0, 9.0, "Song", 10.0, 0), ("d", 1, 0, 0, 1, "收入 ", 5.0, 0.0, 9.0, 8.0, "Song-Bold", 12.0, 2), ("d", 1, 0, 0, 2, "rose", 9.0, 1.0, 15.0, 9.0, "Song", 11.0, 0), ("d", 1, 0, 0, 3, " ", 0.0, 0.0, 0.0, 0.0, "X", 1.0, 0), ("d", 1, 0, 1, 0, " ", 0.0, 0.0, 0.0, 0.0, "X", 1.0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int")
    (r,) = layout.native_blocks(df).collect()
    assert (r["text"], r["font"], r["font_size"], r["is_bold"], r["is_italic"], r["span_count"], r["y0"]) == ("营业收入 rose", "Song", 11.0, True, True, 4, 0.0)
    assert layout.native_blocks(df, merge=False).count() == 3


def test_time_steps(spark):
    steps = [("u", i, s, p) for i, (s, p) in enumerate([("a", 0.9), ("a", 0.5), ("-", 0.9), ("a", 0.7), ("b", 0.8)])] + [("v", 0, "-", 0.3)]
    df = spark.createDataFrame(steps, "g string, i int, s string, p double")
    got = {r["g"]: (r["text"], r["emitted"], round(r["score"], 4)) for r in recognition.collapsed(df, ["g"], ["i"], "s", "p", "-").collect()}
    assert got == {"u": ("aab", 3, 0.8), "v": ("", 0, 0.0)}
    got = spark.range(1).select(recognition.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("x")).first()["x"]
    assert abs(got[0] - 0.5) < 1e-6


def test_metrics_keep_small_and_large_amounts(spark):
    df = spark.createDataFrame([(1e-7, 3e-7), (1.2e17, 0.5e17), (2.675, 1.0), (1.0, 0.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    got = [r[0] for r in df.select(metrics.metric("ratio", [F.col("a"), F.col("b")], 4)).collect()]
    assert got == [0.3333, 2.4, 2.675, None, None, None]
    assert metrics.calculate("ratio", ["2.675", "1"], 2) == 2.68 and metrics.calculate("growth_rate", ["120", "-100"], 2) == 220.0
    row = spark.range(1).select(metrics.formula("growth_rate", [F.lit(3), F.lit(2)]).alias("g"), metrics.formula("sum", [F.lit(1), F.lit(2), F.lit(3)]).alias("s")).first()
    assert tuple(row) == ("(3 - 2) / abs(2) * 100", "1 + 2 + 3")
    for bad in (("other", 1, 2), ("ratio", 3, 2), ("sum", 21, 2), ("sum", 1, 9)):
        with pytest.raises(ValueError):
            metrics.checked(*bad)


def test_selection():
    assert text.selection("1, 3,3,9", 5) == [1, 3] and text.selection("152", 4) == [1, 2] and text.selection("", 4) == []


def test_saved_index_gives_the_same_hits(spark, tmp_path):
    chunks = spark.createDataFrame([("k1", "营业收入 增长 增长"), ("k2", "营业成本"), ("k3", None), ("k4", ""), ("k5", "revenue 2020 rose")], "key string, text string")
    asked = spark.createDataFrame([(1, "营业收入增长"), (2, "2020 revenue"), (3, "")], "query_id bigint, query string")
    want = bm25.search(asked, chunks, "key", "text").collect()
    bm25.save(chunks, "key", "text", str(tmp_path))
    got = bm25.search_index(asked, bm25.load(spark, str(tmp_path))).collect()
    assert sorted(want) == sorted(got) and {r["key"] for r in got if r["query_id"] == 2} == {"k5"}
    assert bm25.search(asked, chunks.limit(0), "key", "text").count() == 0
    filled = bm25.search(asked, chunks.select(F.monotonically_increasing_id().alias("key"), "text"), "key", "text", k=3, include_zero=True)
    assert filled.filter("query_id = 3").count() == 3


def test_vector_ties_and_batches(spark, monkeypatch):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id bigint, vector array<double>")
    want = {(1, i) for i in (1, 2, 4, 5)} | {(2, i) for i in (0, 3, 6, 9)}
    for size in (64 << 20, 1):
        monkeypatch.setattr(vector, "PASS_BYTES", size)
        assert {(r["query_id"], r["key"]) for r in vector.search(asked, df, "id", "v", 4).collect()} == want
    assert vector.search(asked.limit(0), df, "id", "v").count() == 0


def test_missing_files_fail_at_once(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.some_pdf_files(spark, str(tmp_path))
    (tmp_path / "y.PDF").write_bytes(b"%PDF")
    assert readers.some_pdf_files(spark, str(tmp_path)).count() == 1
