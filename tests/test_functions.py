import pytest
from pyspark.sql import functions as F

from siltstone.functions import chunking, metrics, similarity, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Don't 3.14 a-b", ["dont", "314", "ab"]), ("naïve", ["na", "ve"]), ("海光信息2024", ["海", "光", "信", "息", "2024"]), ("", []), (None, None)])
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("发布于2024年3月5日", "2024-03-05"), ("x_20240510", "2024-05-10"), ("2023-1-2", "2023-01-02"), ("1999年1月1日", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, text.report_date(F.lit(raw).cast("string"))) == want


def test_names(spark):
    assert one(spark, text.broker(F.lit("中信证券_银行行业_2024"))) == "中信证券"
    assert one(spark, text.company(F.lit("海光信息2024年报"), F.lit("x"))) == "海光信息"
    assert one(spark, text.title(F.lit("第 1 页\n请务必阅读正文之后的免责条款部分\n半导体行业深度报告\n其他"))) == "半导体行业深度报告"
    assert one(spark, text.title(F.lit("短\n"))) is None


@pytest.mark.parametrize(("raw", "noise"), [("目录" + "正文" * 30, True), ("短", True), (None, True), ("正文内容" * 20, False), ("-+*/" * 20 + "字" * 10, True)])
def test_noise(spark, raw, noise):
    assert one(spark, text.is_noise(F.lit(raw).cast("string"))) is noise


def test_cleaning(spark):
    assert one(spark, text.clean(F.lit(" a  b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, text.before_split(F.lit("甲\n=====\n9 / 219\n乙"))).split() == ["甲", "乙"]
    assert one(spark, text.redacted(F.lit("api_key=abc123 rest"))) == "api_key=*** rest"
    assert one(spark, text.unfenced(F.lit("```json{\"a\":1}```"))) == '{"a":1}'
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")), F.array(F.lit(" "), F.lit("")))
    assert one(spark, text.markdown_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


@pytest.mark.parametrize(("op", "amounts", "precision", "want"), [("growth_rate", [120, 100], 2, 20.0), ("gross_margin", [200, 120], 2, 40.0), ("difference", [5, 7.5], 1, -2.5), ("ratio", [1, 3], 4, 0.3333), ("sum", [0.1, 0.2, 2.045], 2, 2.35), ("ratio", [1, 0], 2, None), ("growth_rate", [-50, -100], 2, 50.0)])
def test_metrics(spark, op, amounts, precision, want):
    assert one(spark, metrics.metric(op, [F.lit(str(a)) for a in amounts], precision)) == want


def test_metric_arguments():
    for bad in (("cube", [1], 2), ("ratio", [1], 2), ("sum", [], 2), ("sum", [1], 9)):
        with pytest.raises((ValueError, IndexError)):
            metrics.metric(bad[0], [F.lit(x) for x in bad[1]] if bad[1] else [], bad[2])


PAGE = "# 财务摘要\n本年收入增长。利润持平，费用下降。\n\n| 项目 | 2023 | 2022 |\n|---|---|---|\n| 收入 | 1 | 2 |\n\n9 / 219\n后续说明文字。"


def test_chunks_keep_tables():
    got = chunking.split_text(PAGE, 30, 5)
    table = "| 项目 | 2023 | 2022 |\n|---|---|---|\n| 收入 | 1 | 2 |"
    assert any(table in c for c in got) and not any("219" in c for c in got)
    assert chunking.split_text(None) == chunking.split_text(" \n") == []
    assert chunking.split_text("长" * 1000) == ["长" * 1000]
    parts = chunking.split_text("一句话。" * 200, 80, 20)
    assert all(len(p) <= 80 for p in parts) and len(parts) > 10


def test_segments():
    assert chunking.segments(PAGE)[0].startswith("# 财务摘要")
    long = chunking.segments("字" * 2000)
    assert len(long) <= 8 and all(len(s) <= 320 for s in long)
    assert chunking.segments(None) == []


def test_windows(spark):
    assert one(spark, chunking.windows(F.lit("a" * 2500), 1000, 200)) == ["a" * 1000, "a" * 1000, "a" * 900, "a" * 100]
    assert one(spark, chunking.windows(F.lit("short"))) == ["short"]


def test_similarity(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, similarity.unit(v)) == [0.6, 0.8]
    assert one(spark, similarity.relevance(F.lit(1.0))) == 1.0
    assert one(spark, F.round(similarity.relevance(F.lit(0.3636)), 3)) == 0.1
    assert one(spark, similarity.char_jaccard(F.lit("abc!"), F.lit("ABD"))) == 0.5
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.sequence_ratio("a", "b")).collect()] == [0.75, 0.0, 0.0]
