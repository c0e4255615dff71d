import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.textform import QUICK_CHECK, canonical, changed, normalise


@pytest.mark.parametrize(
    ("raw", "form"),
    [
        ("７１％ 𝟏𝟔 \ufb01nance", "71% 16 finance"),
        ("下\u2f00阶段 \u2ec5\u2ecb \uf9ca程", "下一阶段 见车 流程"),
        ("\u0441harge approv\u0430l", "charge approval"),
        ("\u0421端用户，\u0391股", "C端用户，A股"),
        ("«Северсвет» 参数β λ-3", "«Северсвет» 参数β λ-3"),
        ("Cafe\u0301 n\u0303", "Café ñ"),
        ("a\u200bb\u00adc\ufeff d\u2060e", "abc de"),
        ("a\u3000b\u00a0c\u2009d\te", "a b c d\te"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("，：；！？（） 。、“”—", "，：；！？（） 。、“”—"),
        ("Ꭺpple օrange ℓoan ſum \u2170 \u2163", "Apple orange loan sum i IV"),
        ("m² x₁ ① ½ ㎡ … ℃", "m² x₁ ① ½ ㎡ … ℃"),
        ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᎴ", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᎴ"),
        ("Հայաստան օր", "Հայաստան օր"),
        ("", ""),
    ],
)
def test_forms(raw, form):
    assert canonical(raw) == form
    assert canonical(form) == form


def test_null():
    assert canonical(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoсеοА中国１ａ％（\u0301\u0303\u200b\u00ad\u3000\u00a0 \n\r.，β\ufb01\u2f00"), max_size=25))
def test_stable_and_composed(raw):
    form = canonical(raw)
    assert canonical(form) == form
    assert unicodedata.normalize("NFC", form) == form


def test_unchanged_text_is_the_same_object():
    text = "普通的报告文字，2021年增长3.5%。" * 50
    assert canonical(text) == text


def test_rows(spark):
    rows = [(1, "正常文字", "x"), (2, "全角１２", None), (3, None, "y"), (4, "\u3000\u200b ", "z"), (5, "", "z"), (6, "a" * 200_000 + "Ａ", "w"), (2, "全角１２", None)]
    df = spark.createDataFrame(rows, "id bigint, body string, row_key string")  # an extra column named like the result's
    assert sorted(r[0] for r in changed(df, "id", "body").collect()) == [2, 6]
    out = {r["id"]: r["canonical"] for r in normalise(df, "body").collect()}
    assert out[2] == "全角12" and out[3] is None and out[5] == "" and out[6].endswith("aA")
    assert changed(df.limit(0), "id", "body").count() == 0


def test_quick_check_passes_no_unstable_character():
    """Over the planes with forms: what normalization changes, quick check finds; what stays apart is normal but for forms that look different."""
    quick = re.compile(QUICK_CHECK)
    for code in (*range(0x20, 0xD800), *range(0xE000, 0x30000)):
        ch = chr(code)
        form = canonical(f"甲{ch}乙")
        if form != f"甲{ch}乙" or not unicodedata.is_normalized("NFC", f"a{ch}"):
            assert quick.search(ch), hex(code)
        assert canonical(form) == form and unicodedata.is_normalized("NFC", form), hex(code)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if kind in ("<wide>", "<narrow>", "<font>", "<small>") and ch not in "，：；！？（）":
            assert ch not in form, hex(code)
