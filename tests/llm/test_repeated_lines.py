import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import repeated_lines as repeated
from siltstone.llm.repeated_lines import TAG, keyed_rows, line_keys, log_likelihood, prepared, repeated_lines, without_repeated_lines
from siltstone.llm.repeated_lines import tested_lines as lines_tested
from siltstone.llm.textform import canonical

SCHEMA = "row_id bigint, file_name string, content string, keys string, fid int"


def brute(rows, share=0.2, least=5):
    """The rule of the data, without statistics."""
    key = lambda line: "".join(c for c in re.sub(TAG, "", canonical(line)).lower() if c.isalpha())
    kept = [r for r in rows if r[2] and canonical(r[2]).strip()]
    n, a = Counter(r[1] for r in kept), Counter()
    for r in kept:
        a.update((r[1], k) for k in {key(x) for x in r[2].split("\n")} - {""})
    high = {k for k, v in a.items() if v >= least and v >= share * n[k[0]] and k[0] is not None}
    return {(r[0], i + 1) for r in kept for i, x in enumerate(r[2].split("\n")) if (r[1], key(x)) in high}


def rows():
    out = []
    for i in range(60):
        f = "甲.pdf" if i % 3 else "乙.pdf"
        out.append((i, f, f"第{i}段正文内容各不相同{'子丑寅卯辰巳午未'[i % 8]}{i * 7}\n请阅读声明 {i}\n\n<b>版权所有</b>\nbody{chr(97 + i % 26)}{chr(97 + i // 26)}", None, i))
    out += [(100, "甲.pdf", None, "k", 1), (101, "甲.pdf", " \u3000\n", "k", 1), (102, None, "请阅读声明", "k", 1), (103, "丙.pdf", "请阅读声明\n12 34", "k", 1), (104, "甲.pdf", "请 阅读，声明９", "k", 1)]
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {tuple(r) for r in repeated_lines(df, "row_id", "file_name", "content").collect()}
    assert got == brute(data)
    assert (104, 1) in got and (103, 1) not in got and (102, 1) not in got


def test_reassembly(spark):
    out = {r["row_id"]: r["clean_text"] for r in without_repeated_lines(spark.createDataFrame(rows(), SCHEMA), "row_id", "file_name", "content").collect()}
    assert out[3].split("\n")[0].startswith("第3段") and "声明" not in out[3] and "版权" not in out[3] and len(out) == 65
    assert out[104] == "" and out[100] is None and out[103] == "请阅读声明\n12 34"


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_lines(df, "row_id", "file_name", "content").count() == 0


def test_one_source_only(spark):
    data = [(i, "甲", f"声明\n正文{'abcdefghij'[i]}{i}") for i in range(10)]
    df = spark.createDataFrame(data, "row_id bigint, file_name string, content string")
    assert {tuple(r) for r in repeated_lines(df, "row_id", "file_name", "content").collect()} == {(i, 1) for i in range(10)}


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/all_documents.parquet")
    data = [tuple(r) for r in df.select("row_id", "file_name", "content").collect()]
    assert {tuple(r) for r in repeated_lines(df, "row_id", "file_name", "content").collect()} == brute(data)


def test_keys_tell_order_and_place():
    keys, lines = line_keys([prepared(x) for x in ("ab\nba\n12\nAB 3", "<p>ａb</p>", "")])
    assert lines.tolist() == [4, 1, 1]
    assert keys[0] == keys[3] == keys[4] and keys[0] != keys[1] and keys[2] == 0 == keys[5]
    assert line_keys([])[0].size == 0


def test_long_line():
    keys, _ = line_keys(["字" * 300_000, "字" * 299_999])
    assert keys[0] != keys[1] and np.all(keys != 0)


@pytest.mark.parametrize(("a", "n", "c", "m", "sign"), [(50, 100, 10, 1000, 1), (1, 100, 500, 1000, -1), (5, 5, 0, 0, 1)])
def test_likelihood_sign(spark, a, n, c, m, sign):
    g = spark.range(1).select(log_likelihood(*[F.lit(x) for x in (a, n, c, m)])).first()[0]
    assert g * sign > 0


def contrast():
    """Four sources of 50 rows: a notice of one, a phrase that all use nearly as often, and a notice that all carry."""
    out = []
    for s in range(4):
        for i in range(50):
            lines = [f"正文{chr(0x4E00 + 50 * s + i)}{chr(0x5E00 + i)}", "全体声明"]
            lines += ["本社版权"] if s == 0 and i < 12 else []
            lines += ["单位万元"] if i < (10 if s == 0 else 8) else []
            out.append((100 * s + i, f"{s}", "\n".join(lines)))
    return out


def removed(spark, **rule):
    data = contrast()
    got = repeated_lines(spark.createDataFrame(data, "row_id bigint, file_name string, content string"), "row_id", "file_name", "content", **rule).collect()
    text = {r[0]: r[2].split("\n") for r in data}
    return {(int(text[r["row_id"]][0] != "") and r["row_id"] // 100, text[r["row_id"]][r["line_no"] - 1]) for r in got}


def test_the_likelihood_test_decides(spark):
    """Two lines in a fifth of a source's rows: the one of its own goes, the one that is as common outside stays."""
    own = {(0, "本社版权")}
    everywhere = {(s, "全体声明") for s in range(4)}
    assert removed(spark, common=False) == own
    assert removed(spark) == own | everywhere
    assert removed(spark, fdr=1e-14, common=False) == set()  # beyond its evidence
    assert (0, "单位万元") in removed(spark, fdr=0.9999)


def scattered():
    """A source of 50 rows, 40 sources of one row each and 30 rows without a source, which hold one of its two lines nearly as often."""
    text = lambda i, *lines: "\n".join((f"正文{chr(0x4E00 + i)}{chr(0x5E00 + i)}", *lines))
    out = [(i, "甲", text(i, *["本社版权"] * (i < 12), *["单位万元"] * (i < 10))) for i in range(50)]
    out += [(100 + i, f"单{i}", text(50 + i, *["单位万元"] * (i < 6))) for i in range(40)]
    return out + [(200 + i, None, text(90 + i, *["单位万元"] * (i < 7))) for i in range(30)]


def test_rows_of_few_and_of_no_source_count_outside(spark):
    df = spark.createDataFrame(scattered(), "row_id bigint, file_name string, content string")
    got = {(r["a"], r["n"]): (round(r["g"], 6), r["significant"]) for r in lines_tested(keyed_rows(df, "row_id", "file_name", "content")).collect()}
    g = lambda *x: round(spark.range(1).select(log_likelihood(*[F.lit(v) for v in x])).first()[0], 6)
    assert got == {(12, 50): (g(12, 50, 0, 70), True), (10, 50): (g(10, 50, 13, 70), False)}
    assert {tuple(r) for r in repeated_lines(df, "row_id", "file_name", "content").collect()} == {(i, 2) for i in range(12)}


@pytest.mark.parametrize("strays", [1, 3, 10])
def test_few_rows_outside_lose_no_line(spark, strays):
    """Too few to test against: the share decides, as it does without rows outside."""
    data = [(i, "甲", f"正文{chr(0x4E00 + i)}" + "\n声明" * (i < 10)) for i in range(50)]
    data += [(100 + i, f"单{i}", f"其他{chr(0x5E00 + i)}") for i in range(strays)]
    df = spark.createDataFrame(data, "row_id bigint, file_name string, content string")
    assert {tuple(r) for r in repeated_lines(df, "row_id", "file_name", "content").collect()} == brute(data) == {(i, 2) for i in range(10)}


def test_tested_lines_against_a_binomial_family(spark):
    """The step-up over all tested lines, redone in plain Python."""
    import math

    df = spark.createDataFrame(contrast(), "row_id bigint, file_name string, content string")
    got = lines_tested(keyed_rows(df, "row_id", "file_name", "content"), common=False).collect()
    p = lambda g: 0.5 * math.erfc(math.sqrt(max(g, 0.0) / 2.0)) if g > 0 else 1.0
    ordered = sorted((p(r["g"]), r["significant"]) for r in got)
    last = max((i for i, (v, _) in enumerate(ordered) if v <= 0.01 * (i + 1) / len(ordered)), default=-1)
    assert [s for _, s in ordered] == [i <= last for i in range(len(ordered))] and 0 <= last < len(ordered) - 1


def test_keys_do_not_depend_on_what_is_hashed_together(monkeypatch):
    texts = [f"第{i}行 abc\n{'重复' * (i % 5)}\n{i}" for i in range(200)] + [""]
    want = line_keys(texts)
    monkeypatch.setattr(repeated, "HASHED", 37)
    got = line_keys(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
