import math

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import bm25, evaluation, filters, fusion, layout, memory, rerank, search, tools, vector

CHUNKS = [(1, "海光 信息 芯片 增长 revenue growth"), (2, "芯片 芯片 下降"), (3, "银行 贷款"), (4, None), (5, ""), (6, "增长 增长 增长 银行")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "key bigint, text string")


def test_bm25_against_formula(spark):
    queries = spark.createDataFrame([(1, "芯片增长"), (2, "银行银行"), (3, "zzz"), (4, None)], "query_id bigint, query string")
    got = {(r["query_id"], r["key"]): r["score"] for r in bm25.search(queries, chunks(spark), "key", "text").collect()}
    docs = {k: [c for w in t.split() for c in (list(w) if not w.isascii() else [w])] for k, t in CHUNKS if t is not None}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    raw = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w in {w for d in docs.values() for w in d} for df in [sum(w in d for d in docs.values())]}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    want = {}
    for q, text in ((1, "芯片增长"), (2, "银行银行")):
        for k, d in docs.items():
            s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in text)
            if any(w in d for w in text):
                want[q, k] = round(s, 6)
    assert got == want
    filled = bm25.search(queries, chunks(spark), "key", "text", k=5, include_zero=True)
    assert {r["query_id"]: r["n"] for r in filled.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 5, 3: 5, 4: 5}
    assert bm25.search(queries, chunks(spark).limit(0), "key", "text").count() == 0


def test_vector_against_numpy(spark):
    r = np.random.RandomState(0)
    x = r.randn(60, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "key bigint, vector array<double>").repartition(4)
    queries = table.filter("key in (3, 7)").withColumnRenamed("key", "query_id")
    got = vector.search(queries, table, "key", "vector", k=5, threshold=0.1).collect()
    for q in (3, 7):
        score = np.round(1 - (2 - 2 * x @ x[q]) / math.sqrt(2), 6)
        best = [i for i in np.lexsort((np.arange(60), -score))[:5] if score[i] >= 0.1]
        assert [r["key"] for r in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == best
    assert vector.search(queries.limit(0), table, "key", "vector").count() == 0


def test_fusion_and_balance(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, identity bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, identity bigint, rank int")
    got = [(r["identity"], r["score"]) for r in fusion.fuse([(a, 0.8), (b, 0.2)]).orderBy("rank").collect()]
    assert got == [(11, round(0.8 / 62 + 0.2 / 61, 6)), (10, round(0.8 / 61, 6)), (12, round(0.2 / 62, 6))]
    hits = spark.createDataFrame([(1, 0, r, r) for r in range(1, 5)] + [(1, 1, 1, 9)], "query_id int, sub_query int, rank int, key int")
    assert [r["key"] for r in fusion.balance(hits, 4).orderBy("position").collect()] == [1, 9, 2, 3]


def test_filters(spark):
    hits = spark.createDataFrame([(1, 0, "收入 2020"), (1, 0, "其他"), (1, 1, "其他"), (1, 1, None)], "query_id int, sub_query int, text string")
    soft = filters.soft(hits, filters.all_values(F.array(F.lit("2020"), F.lit(""), F.lit(None).cast("string")), F.lower("text"))).collect()
    assert sorted((r["sub_query"], r["text"] or "") for r in soft) == [(0, "收入 2020"), (1, ""), (1, "其他")]
    assert filters.exclude(hits, F.array(F.lit("其他")), F.col("text")).count() == 2
    assert filters.exclude(hits, F.lit(None).cast("array<string>"), F.col("text")).count() == 4


def test_structured_search(spark):
    store = spark.createDataFrame([(i, f"{w} 报告 {2018 + i % 3} 正文内容", "文件") for i, w in enumerate(["收入", "利润", "收入", "利润", "费用"])], "key bigint, text string, file_name string")
    asked = spark.createDataFrame([(1, ["收入", "利润"], ["2020"], ["费用"], None, 3)], "query_id bigint, sub_queries array<string>, filter_values array<string>, exclude_terms array<string>, required_terms array<string>, top_k int")
    got = search.structured(asked, store).orderBy("position").collect()
    assert [r["key"] for r in got][:1] == [2] and len({r["key"] for r in got}) == len(got) <= 3


def test_rerank(spark):
    rows = [(1, "营业收入增长", 1, "本年营业收入增长明显，公司持续推进精细化管理，利润总额有所提升。" * 2), (1, "营业收入增长", 2, "目录" * 30), (1, "营业收入增长", 3, "银行贷款余额保持平稳，资产质量总体可控，拨备覆盖率处于合理区间之内。")]
    got = rerank.rerank(spark.createDataFrame(rows, "query_id int, query string, key int, text string")).collect()
    assert [(r["key"], r["rank"]) for r in got] == [(1, 1), (3, 2)] and got[0]["score"] == 1.0


def test_expand_and_catalog(spark):
    rows = [("report-1", f"report-1-c{i}", f"chunk-{i}", "海光信息", "2024-12-31", i, "海光.pdf") for i in (1, 2, 3)] + [("", "x", "y", None, None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, content string, company string, report_date string, page_num int, file_name string")
    got = tools.expand(df, df.filter("chunk_id = 'report-1-c2'"), "chunk_id", "doc_id", ["page_num"]).orderBy("distance").collect()
    assert [(r["distance"], r["relation"]) for r in got] == [(-1, "neighbor"), (0, "target"), (1, "neighbor")]
    edge = tools.expand(df, df.filter("chunk_id = 'report-1-c1'"), "chunk_id", "doc_id", ["page_num"], 3, 1)
    assert sorted(r["distance"] for r in edge.collect()) == [0, 1]
    listed = tools.catalog(df, "doc_id", ["company", "report_date", "file_name"], ["page_num"], company="海光", year="2024").collect()
    assert [(r["doc_id"], r["company"]) for r in listed] == [("report-1", "海光信息")]


def test_memory(spark):
    rows = [(1, 1, "user", "海光信息的营业收入是多少"), (1, 2, "assistant", "二十亿元"), (1, 3, "system", "x"), (1, 4, "user", "天气"), (1, 5, "user", "净利润呢"), (1, 6, "assistant", None)]
    m = spark.createDataFrame(rows, "session bigint, turn bigint, role string, text string")
    assert [r["turn"] for r in memory.pairs(m).orderBy("turn").collect()] == [1, 5]
    assert sorted(r["turn"] for r in memory.last_turns(m, 1).collect()) == [5, 6]
    asked = spark.createDataFrame([(9, 1, "海光信息营业收入是多少"), (8, 2, "x")], "query_id bigint, session bigint, query string")
    got = memory.recall(asked, m).collect()
    assert [(r["query_id"], r["key"]) for r in got] == [(9, 1)] and got[0]["score"] > 0.9


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, "a", 9.0, 1, "f"), (1, 2, "a", 5.0, 2, "f"), (1, 3, "z", 0.1, 3, "g")], "query_id bigint, rank int, chunk_id string, score double, key bigint, source string")
    truth = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "query_id bigint, gt array<string>")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(hits, truth).collect()}
    assert (got[1]["recall"], got[1]["precision"], got[1]["noise"]) == (0.5, 0.666667, 0.333333)
    assert (got[2]["recall"], got[2]["noise"], got[3]["recall"]) == (0.0, 0.0, 0.0)
    assert evaluation.auto_labels(hits, 1.0).first()["gt"] == ["a"]
    assert evaluation.hard_negatives(hits, 3).first()["negative"] == 3 and evaluation.hard_negatives(hits, 5).count() == 0


def test_layout(spark):
    rows = [(1, "d", 1, 0.0, 10.0, 100.0, 20.0, "甲", "text", 0.9), (2, "d", 1, 5.0, 25.0, 100.0, 35.0, "乙", "text", 0.5), (3, "d", 1, 0.0, 300.0, 100.0, 310.0, "丙", "table", None), (4, "d", 1, 0.0, 312.0, 100.0, 330.0, "丁", "text", 0.7), (5, "d", 2, 0.0, 11.0, 10.0, 12.0, None, None, None)]
    df = spark.createDataFrame(rows, "block_id bigint, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block_type string, confidence double")
    assert sorted(r[0] for r in layout.outside_tables(df.filter("block_type = 'text'"), df.filter("block_type = 'table'")).select("block_id").collect()) == [1, 2]
    merged = {r["block_id"]: r["paragraph"] for r in layout.paragraphs(df, "block_id").collect()}
    assert merged == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}
    assert {r["block_id"]: r["line"] for r in layout.lines(df, "block_id").collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert layout.unique_boxes(df, "block_id").count() == 5 and layout.paragraphs(df.limit(0), "block_id").count() == 0
