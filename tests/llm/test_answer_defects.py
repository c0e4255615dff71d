import pytest

from siltstone.llm.answer_defects import answer_defects, is_copy, is_refusal, language, left_open, row_defect, tiled

Q = "岑岳集团2020年营业收入是多少？"


@pytest.mark.parametrize(
    ("query", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, " \u200b\n", "empty"), (Q, "N/A", "empty"), (Q, "（空）", "empty"), (Q, "……", "empty"),
        (Q, Q, "copy"), (Q, "问题是：" + Q, "copy"), (Q, Q + Q, "copy"), ("What was the revenue of A Group in 2020?", "THE QUESTION IS: WHAT WAS THE REVENUE OF A GROUP IN 2020?", "copy"),
        (Q, "抱歉，我无法回答这个问题。", "refusal"), (Q, "现有资料不足以得出岑岳集团的营业收入，请补充年报原文。", "refusal"), (Q, "文档未披露2020年的营业收入，无从判断。", "refusal"),
        ("What was it?", "I am sorry, but I cannot answer that.", "refusal"), ("What was it?", "The passage does not give the figure.", "refusal"),
        (Q, "否。管理层认为受汇率影响，岑岳集团无法准确预计2020年的营业收入，因此未给出区间。", None), (Q, "未作预测，岑岳集团称难以给出可靠估计。", None),
        (Q, "The company reported 12.5 million for the year.", "other_language"), ("What was the revenue of A in 2020?", "公司当年该指标为39.32百万元。", "other_language"),
        ("What was the revenue of A in 2020?", "Der Betrag lag im Geschäftsjahr bei 5 Millionen und stieg um 7 Prozent.", "other_language"), (Q, "同社の当期の金額は5百万円で、増えました。", "other_language"),
        (Q, "岑岳集团2020年营业收入为5亿元，", "truncated"), (Q, "岑岳集团2020年营业收入为5亿元（其中", "truncated"), (Q, "收入为5亿元，主要…", "truncated"), (Q, "岑岳集团2020年营业收入为12.", "truncated"), ("What was the year?", "The company reported the figure in 2020.", None),
        (Q, "12.5亿元", "bare"), (Q, "岑岳集团2020年营业收入为12.5亿元。", None),
    ],
)
def test_rows(query, answer, defect):
    assert row_defect(query, answer) == defect


@pytest.mark.parametrize(("text", "open_"), [("a (b", 1), ("a (b)", 0), ("```\nx = 1", 1), ("```\nx\n```", 0), ("“引文", 1), ("<b>x", 1), ("<b>x</b><br>", 0), ("要点：\n1. 甲\n2.", 1), ("\\begin{x} y", 1), ("it's fine", 0), ("（半角混用)", 0)])
def test_pushdown(text, open_):
    assert left_open(text) == bool(open_)


def test_tiling_is_disjoint():
    spans = tiled("abcdefXabcdef", "abcdef")
    assert sorted(spans) == [(0, 6), (7, 13)] and not is_copy("收入为5亿元", Q)


def test_languages():
    assert [language(x) for x in ("中文文本内容", "plain English words of the text", "La société a déclaré pour les exercices", "За год показатель вырос", "12.5%")] == ["zh", "en", "fr", "ru", ""]


def test_table(spark):
    good = [(i, f"{c}集团2020年营业收入是多少？", f"{c}集团2020年营业收入为{i}.5亿元，同比变动{i}%，主要系汇率波动所致。") for i, c in enumerate("甲乙丙丁戊己庚辛壬癸子丑寅卯")]
    rows = good + [(100, "午集团2020年营业收入是多少？", "午集团2020年营业收入为9.5亿元，同比变动3%，主要系汇率波"), (101, "未集团2020年营业收入是多少？", "未集团2020年营业收入为9.5亿元，同比变动3%，主要系汇率波动所致"), (102, None, None), (103, None, "很长的回答。" * 20_000), (104, "x", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, q string, a string, defect string")
    assert {tuple(r) for r in answer_defects(df, "id", "q", "a").collect()} == {(100, "truncated"), (102, "empty"), (104, "empty")}
    assert answer_defects(df.limit(0), "id", "q", "a").count() == 0


def test_long_answers():
    long = "Revenue rose in the second quarter as demand recovered. " * 12
    assert is_refusal(long + "Sorry, that is all there is.") and not is_refusal(long)
    q = "what was the revenue of the company"
    assert is_copy(" ".join([q] * 30), q) and not is_copy(long, q)
