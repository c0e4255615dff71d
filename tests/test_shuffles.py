"""Search over many questions shuffles no pair of question and chunk."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import blocks, bm25, evaluation
from siltstone.plans import catalog

QUESTIONS, CHUNKS = 120, 800


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables in which every question shares a term with every chunk."""
    at = tmp_path_factory.mktemp("many")
    questions = [(i * 100, f"营业收入 {i % 40} 增长 {i}", "a") for i in range(1, QUESTIONS + 1)]
    chunks = [(i, f"f{i % 20}", f"本年营业收入增长 {i % 40} 百万，比 {i} 年公司持续推进精细化管理，利润总额有所提升，资产质量总体可控。", "甲", "题", "乙", "2020", f"c{i}", i % 7, f"d{i % 20}") for i in range(CHUNKS)]
    columns = "row_id bigint, file_name string, content string, company string, title string, broker string, report_date string, chunk_id string, page_num int, doc_id string"
    spark.createDataFrame(chunks, columns).repartition(4).write.parquet(f"{at}/all_documents.parquet")
    spark.createDataFrame(questions, "item_id bigint, query string, reference string").write.parquet(f"{at}/testset.parquet")
    spark.createDataFrame([(1, "利润")], "item_id bigint, question string").write.parquet(f"{at}/heldout_items.parquet")
    return str(at)


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["structured_search", "rerank_max_segment", "retrieval_metrics_avg", "source_list", "hit_dedup", "result_normalised"])
def test_no_pairs(spark, many, name):
    before = shuffled(spark)
    assert catalog.QUERIES[name](spark, many).count() > 0
    assert 0 < shuffled(spark) - before < QUESTIONS * CHUNKS / 2


def test_metrics_of_every_question(spark, small):
    asked = sum(catalog.table(spark, small, t).count() for t in ("testset", "heldout_items"))
    assert catalog.QUERIES["retrieval_metrics_avg"](spark, small).first()["queries"] == asked


def test_sources_of_every_question(spark, small):
    asked = catalog._every_asked(spark, small)
    assert catalog.QUERIES["source_list"](spark, small).select("query_id").distinct().count() == asked.count() > catalog._asked(spark, small).count()


def test_metrics_by_source(spark):
    """Equal to those by arrays: ids that repeat in a query or in another file, ids and files that are null."""
    hits = spark.createDataFrame([(1, 1, "a", "f"), (1, 2, "a", "f"), (1, 3, "z", "g"), (1, 4, "b", "g"), (2, 1, None, "f"), (2, 2, None, "g"), (3, 1, "n", None), (4, 1, None, "h"), (5, 1, "z", "g"), (5, 2, None, "f")], "query_id int, rank int, chunk_id string, source string")
    chunks = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "f"), (None, "f"), ("z", "g"), ("b", "g"), (None, "h"), ("n", None)], "chunk_id string, source string")
    truth = hits.filter("rank = 1").select("query_id", "source").join(chunks.filter("chunk_id is not null"), "source").groupBy("query_id").agg(F.collect_set("chunk_id").alias("gt"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(evaluation.metrics_by_source(hits, chunks)) == rows(evaluation.retrieval_metrics(hits, truth))


def test_blocks_against_sums():
    """Odd bags too: weights of 0 and below, no chunk in common, equal scores, fewer chunks than k."""
    r = np.random.RandomState(1)
    words = [f"w{i}" for i in range(30)]
    idf = {w: float(v) for w, v in zip(words, r.choice([-0.5, 0.0, 0.3, 1.0, 2.5], 30), strict=True)}
    stated = [" ".join(f"{w}:{r.randint(1, 3)}" for w in sorted(r.choice(words[:28], r.randint(1, 9), replace=False))) for _ in range(200)] + ["w29:1", "w28:2"]
    docs = [sorted(r.choice(words[:29], r.randint(0, 6), replace=False)) for _ in range(700)]
    tfs = [[int(r.randint(1, 4)) for _ in d] for d in docs]
    keys = r.permutation(700)
    part = lambda tf, length: tf / (tf + length)
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([max(1, len(d)) for d in docs], pa.int32()), pa.array(docs, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], ["key", "length", "terms", "tfs"])
    want = set()
    for q, bag in enumerate(stated):
        terms = dict((w, int(n)) for w, n in (x.split(":") for x in bag.split(" ")))
        scores = [(-round(sum(terms[w] * idf[w] * part(n, max(1, len(d))) for w, n in zip(d, t, strict=True) if w in terms), 6) + 0.0, int(key)) for key, d, t in zip(keys, docs, tfs, strict=True) if set(d) & set(terms)]
        want |= {(q, key, round(-s, 6) + 0.0) for s, key in sorted(scores)[:10]}
    for shared, size in ((2, 700), (1000, 90), (8, 11)):
        b = blocks.bags(np.arange(len(stated)), pa.array(stated), idf, shared)
        batches = iter([whole.slice(i, size) for i in range(0, 700, size)])
        got = [x for out in blocks.best(b, 10, part)(batches) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert {(q, key, round(s, 6) + 0.0) for q, key, s in got} == want and len(got) == len(want)


def test_search_in_passes(spark, many, monkeypatch):
    asked, chunks = catalog._asked(spark, many), catalog._chunks(spark, many)
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "key", "score", "rank").collect())
    want = rows(bm25.search_index(asked, bm25.index(chunks, "key", "text")))
    monkeypatch.setattr(bm25, "PASS_BAGS", 30)
    assert rows(bm25.search(asked, chunks, "key", "text")) == want and len(want) == QUESTIONS * 10
