import pytest

from siltstone.llm.scanned_pages import counts_page, flat, has_misread_figure, label, page_defects, paragraphs, skeleton

SCHEMA = "block_id bigint, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block_type string, confidence double, source string, state string"


@pytest.mark.parametrize(("text", "yes"), [("12", 1), ("- 3 -", 1), ("第 4 页 共 20 页", 1), ("Page 3 of 1O", 1), ("vii", 1), ("·7·", 1), ("2 / 9", 1), ("二〇二一年报", 0), ("mid", 0), ("营业收入 12", 0), ("", 0)])
def test_page_counts(text, yes):
    assert counts_page(text) == bool(yes)


@pytest.mark.parametrize(("text", "yes"), [("增长47.l9%", 1), ("20l7年", 1), ("2O22年", 1), ("Rep0rt", 1), ("Zarn!nel", 1), ("合计1,234.5万元", 0), ("A股与B端", 0), ("the 1st and 2nd", 0), ("a@b.com", 0)])
def test_figures(text, yes):
    assert has_misread_figure(text) == bool(yes)


def test_skeleton_folds_alike():
    assert skeleton("Zarn!nel Rep0rt 2O21") == skeleton("Zarninel Report 2021")
    assert flat("营业收\n入 a\nb") == "营业收入 a b"


def block(i, page, y, text, **k):
    return (i, k.get("doc", "d"), page, 56.0, y, k.get("x1", 536.0), y + 12, text, "text", k.get("c", 0.9), "ocr", None)


def pages():
    out, i = [], 0
    for p in range(1, 6):
        head = "某某证券 | 深度研究" if p != 3 else "某某证券 ｜ 深度研 究"
        for y, t in ((20.0, head), (70.0, "The company reported revenue of 12.5 million in the prior period."), (90.0, "营业收入同比增长，管理费用基本持平。"), (810.0, f"{p} / 5")):
            i += 1
            out.append(block(i, p, y, t))
    return out


def test_layout(spark):
    rows = pages() + [block(90, 1, 110.0, "The com-\npany grew"), block(91, 2, 110.0, "profit and reve-"), block(92, 2, 130.0, "nue rose."), block(93, 3, 110.0, "from 2019-\n2023 on"), block(94, 4, 110.0, None), block(95, 4, 120.0, " "), block(96, 5, 300.0, "2016", x1=90.0)]
    got = {}
    for b, d in page_defects(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(d, set()).add(b)
    assert got["running_head"] == {1, 5, 9, 13, 17} and got["page_number"] == {4, 8, 12, 16, 20}
    assert got["split_word"] == {90, 91}
    assert not {94, 95, 96, 93} & set().union(*got.values())


def test_misread_by_context(spark):
    rows = [block(i, 1 + i // 20, 70.0 + i % 20 * 12, f"{n}的营业收入同比增长，净额较上年提升。", doc=f"d{i % 3}") for i, n in enumerate("甲乙丙丁戊己庚辛壬癸" * 6)]
    rows += [block(900, 1, 500.0, "甲的菅业收入同比憎长，净额较上年提升。"), block(901, 1, 520.0, "乙的营业收入同比增长。")]
    got = {b for b, d in page_defects(spark.createDataFrame(rows, SCHEMA)).collect() if d == "misread"}
    assert got == {900}


def test_empty_and_null_places(spark):
    assert page_defects(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None, None, None, "文字", None, None, None, None), (2, "d", 1, 1.0, None, 2.0, None, "x" * 100_000, None, None, "ocr", None)]
    assert page_defects(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_states_follow_sentences():
    base = {"x0": 56, "x1": 536, "type": "text", "margin": False, "returns": False, "count": False}
    got = label([base | {"text": "第一句没有完"}, base | {"text": "接着说完了。"}, base | {"text": "新的一段"}])
    assert got[1] == "body" and got[2] == "break"


def test_paragraphs(spark):
    rows = [r for r in pages() if r[2] != 3 or r[4] in (20.0, 810.0)]
    rows += [block(91, 3, 70.0, "The com-\npany made prof-"), block(92, 3, 90.0, "it of 1O5 and reve-"), block(93, 4, 60.0, "nue rose. All well.")]
    rows += [block(200 + i, 1 + i // 20, 70.0 + i % 20 * 12, f"{n}的营业收入同比增长，净额较上年提升。", doc=f"e{i % 3}") for i, n in enumerate("甲乙丙丁戊己庚辛壬癸" * 6)]
    rows += [block(900, 9, 500.0, "甲的菅业收入同比憎长，净额较上年提升。", doc="e0")]
    got = {}
    for d, p, n, t in sorted(map(tuple, paragraphs(spark.createDataFrame(rows, SCHEMA)).collect())):
        got.setdefault((d, p), []).append(t)
    assert got["d", 3] == ["The company made profit of 105 and revenue"]
    assert got["d", 4][0].startswith("rose. All well.")
    assert got["e0", 9] == ["甲的营业收入同比增长，净额较上年提升。"]
    assert not any("深度研究" in t or "/ 5" in t for ts in got.values() for t in ts)
