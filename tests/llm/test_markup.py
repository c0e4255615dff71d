import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm.markup import MATE, MOST_ODDS, NESTED, PRIOR, TIE, Place, clean, estimated, fitted_odds, languages, markup_languages, minimum_cut, places, without_markup
from siltstone.llm.textform import canonical


@pytest.mark.parametrize(
    ("text", "langs"),
    [
        ("<p>甲</p>", ["html"]), ("a&nbsp;b &amp; c", ["html"]), ("<!-- page 3 -->", ["html"]), ("# 标题\n正文", ["markdown"]), ("**重点**内容", ["markdown"]), ("| a | b |\n| --- | --- |\n| 1 | 2 |", ["markdown"]),
        ("见[说明](../x.pdf)", ["markdown"]), ("```\nx = 1\n```", ["markdown"]), ("- 一\n- 二", ["markdown"]), ("> 引文", ["markdown"]), ("1. 甲\n2. 乙", ["markdown"]),
        ("[[分类:甲]]", ["wiki"]), ("== 标题 ==", ["wiki"]), ("'''粗'''", ["wiki"]), ("{{注释|甲}}", ["wiki"]), ("{| class=\"x\"\n|-\n| 1 || 2\n|}", ["wiki"]),
        ("\\textbf{甲}", ["latex"]), ("$\\Delta r=0.5$", ["latex"]), ("占比5\\%", ["latex"]), ("\\begin{itemize}\n\\item 甲\n\\end{itemize}", ["latex"]), ("| a<br>b | c |", ["html", "markdown"]),
        ("毛利率<20%且费用>30%", []), ("以US$结算，约$5与$6", []), ("R&D与M&A", []), ("公司[注]与{币种}", []), ("annual_report_v2_final", []), ("1#生产线与2#生产线", []), ("*为未经审计数据", []), ("- 5 -", []), ("see note\n37. Management noted", []), ("x = 1 * 2 * 3", []), ("", []),
        ("募集资金情况\n============\n\n正文", ["markdown"]), ("- {| class=\"x\"\n- ! 甲 !! 乙\n- |-\n- | 1 || 2\n- |}", ["markdown", "wiki"]), ("<p>```</p>\n<p>x = 1</p>\n<p>```</p>", ["html", "markdown"]),
    ],
)
def test_languages(text, langs):
    assert languages(text) == langs


@pytest.mark.parametrize("size", [100, 230, 427, 3000, 30_000])
def test_formulas_of_any_length(size):
    body = "+".join(f"a_{{{i}}}x^{i}" for i in range(size))[:size]
    for text in (f"由${body}$得", f"由\n$${body}\n=y$$\n得"):
        assert languages(text) == ["latex"] and body in clean(text)


def test_clean_marks_underlined_headings():
    assert clean("前文。\n募集资金情况\n============\n\n正文") == "前文。\n# 募集资金情况\n\n正文"


def test_clean_keeps_structure():
    out = clean("<h2>标题</h2><p>正文&nbsp;甲</p><ul><li>一</li><li>二</li></ul><table><tr><td>a</td><td>1</td></tr></table>")
    assert out == "## 标题\n正文 甲\n- 一\n- 二\n| a | 1 |"
    assert clean("== 节 ==\n[[甲|乙]]'''粗'''{{注}}") == "## 节\n乙粗"
    assert clean("\\section{甲}\n\\begin{itemize}\n\\item 乙\n\\end{itemize}\n占5\\%，\\textbf{丙}") == "# 甲\n\n-  乙\n\n占5%，丙"
    assert clean("| a | b |\n| --- | --- |\n见[说明](x)，$a_1=2$与`code`") == "| a | b |\n\n见说明，$a_1=2$与`code`"
    assert clean(None) is None and clean("毛利率<20%") == "毛利率<20%"


def test_cut_is_minimal():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 8)
        found, at = [], 0
        for _ in range(n):
            at += r.randint(1, 300)
            found.append(Place(r.choice(["html", "wiki"]), "tag", at, at + 2, "tag", r.choice([-2.0, -0.5, 0.7, 3.0]), -1))
        if n > 3:
            found[0], found[3] = found[0]._replace(mate=3), found[3]._replace(mate=0)
            found[2] = found[2]._replace(parent=r.choice([0, 1]))

        def cost(side):
            import math

            total = sum((-p.weight if s else 0) if p.weight < 0 else (0 if s else p.weight) for p, s in zip(found, side, strict=True))
            last = {}
            for i, p in enumerate(found):
                if p.lang in last and side[i] != side[last[p.lang]]:
                    tie = TIE * math.exp(-(p.start - found[last[p.lang]].end) / 200.0)
                    total += tie if tie > 0.01 else 0
                last[p.lang] = i
                if 0 <= p.mate < i and side[i] != side[p.mate]:
                    total += MATE
                if 0 <= p.parent < i and p.parent != p.mate and side[i] != side[p.parent]:
                    total += NESTED
            return total

        best = min(cost(s) for s in itertools.product([True, False], repeat=n))
        assert cost(minimum_cut(found)) == pytest.approx(best)


def test_places_pair_up():
    found = places("<b>x</b> **y** ```")
    assert found[0].mate == 1 and found[2].mate == 3


def test_table(spark):
    rows = [(1, "<p>a</p> # b", "x"), (2, None, "x"), (3, " ", "x"), (4, "plain", "x"), (5, "＜p＞全角", "x"), (6, "<td>" * 3000 + "字" * 100_000, "x")]
    df = spark.createDataFrame(rows, "id bigint, body string, markup string")
    assert {tuple(r) for r in markup_languages(df, "id", "body").collect()} == {(1, "html"), (5, "html"), (6, "html")}
    assert markup_languages(df.limit(0), "id", "body").count() == 0


def test_prefilter_takes_in_every_construct(spark):
    rows = ["a\n---\nb __bold__ c", "one __two__ three\n\n___\n", "＝＝Title＝＝", "＊＊bold＊＊ and ＊＊more＊＊", "－ one\n－ two\n－ three", "\u3000- one\n\u3000- two\n\u3000- three", "plain words"]
    found = {i for i, t in enumerate(rows) if languages(canonical(t))}
    got = markup_languages(spark.createDataFrame(list(enumerate(rows)), "id bigint, t string"), "id", "t")
    assert {r["row_id"] for r in got.collect()} == found and {1, 2, 3, 4} <= found
    texts = spark.createDataFrame([(t,) for t in rows], "t string").select("t", without_markup(F.col("t")).alias("c")).collect()
    assert all(r["c"] == clean(r["t"]) for r in texts if r["t"] != "plain words")


def test_odds_are_estimated_from_the_texts():
    """Items that stand among items nearly always gain odds; a form that no text shows keeps its prior, and none exceeds the bound."""
    texts = ["".join(f"- 第{i}项内容\n" for i in range(8))] * 100 + ["1. 单独一行"] * 200 + ["毛利率<20%"]
    odds = estimated(texts)
    assert odds["bullet", False] > PRIOR["bullet", False] + 1 and odds["number", False] < PRIOR["number", False]
    assert odds["comment", False] == pytest.approx(PRIOR["comment", False]) and max(map(abs, odds.values())) <= MOST_ODDS
    assert estimated([]) == pytest.approx({k: max(-MOST_ODDS, min(MOST_ODDS, w)) for k, w in PRIOR.items()})


def test_sample_is_bounded(spark):
    rows = [(i, "- 甲\n- 乙\n" * 50, "x") for i in range(200)] + [(900, None, "y"), (901, "", "z")]
    df = spark.createDataFrame(rows, "id bigint, body string, _text string")
    few, many = fitted_odds(df, "id", "body", sample=3), fitted_odds(df, "id", "body", sample=150)
    assert PRIOR["bullet", False] < few["bullet", False] < many["bullet", False]
    assert fitted_odds(df, "id", "body", sample_bytes=1) == fitted_odds(df.limit(0), "id", "body")
