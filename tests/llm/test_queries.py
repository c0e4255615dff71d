import duckdb
import pytest

from siltstone.llm.markup import languages
from siltstone.llm.queries import ORACLES, QUERIES
from siltstone.llm.textform import canonical

COLUMNS = {
    "p1_found": ["row_id", "line_no"], "p2_found": ["table_name", "row_key"], "p3_found": ["block_id", "defect"], "p4_found": ["row_id_a", "row_id_b"], "p5_found": ["item_id", "defect"],
    "p6_found": ["row_id", "markup"], "p7_found": ["spec_id", "doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_single_rows(spark, small, name):
    got = QUERIES[name](spark, small)
    assert got.columns == COLUMNS[name]
    assert all(t == ("string" if c in ("table_name", "defect", "markup", "subject") else "bigint") for c, t in got.dtypes)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))


def test_sql_of_packing(spark, small):
    con = duckdb.connect()
    for t in ("documents", "pack_specs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES["p7_found"](spark, small).collect())) == sorted(con.execute(ORACLES["p7_found"]).fetchall())


def test_cleaned_texts_agree_with_what_was_found(spark, small):
    """The texts that the operators return differ from the input exactly where the found rows say."""
    rows = {r["row_id"]: r["content"] for r in spark.read.parquet(f"{small}/all_documents.parquet").collect()}
    clean = {r["row_id"]: r["clean_text"] for r in QUERIES["p1_clean"](spark, small).collect()}
    gone: dict = {}
    for r in QUERIES["p1_found"](spark, small).collect():
        gone.setdefault(r["row_id"], set()).add(r["line_no"])
    for i, text in rows.items():
        want = text if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in gone.get(i, ()))
        assert clean[i] == want
    blocks = {r["block_id"]: r["text"] for r in spark.read.parquet(f"{small}/text_blocks.parquet").collect()}
    source = {"all_documents": rows, "text_blocks": blocks}
    forms = QUERIES["p2_canonical"](spark, small).collect()
    found = {tuple(r) for r in QUERIES["p2_found"](spark, small).collect()}
    differ = {(r["table_name"], r["row_key"]) for r in forms if r["canonical"] != source[r["table_name"]][r["row_key"]] and r["canonical"].strip()}
    assert len(forms) == len(rows) + len(blocks) and differ == found
    spans = QUERIES["p8_spans"](spark, small).collect()
    assert {(r["doc_id"], r["item_id"]) for r in spans} == {tuple(r) for r in QUERIES["p8_found"](spark, small).collect()} and all(r["start"] < r["end"] for r in spans)


def test_cleaned_markup(spark, small):
    """Rows without markup keep their text, rows with some lose most of it; formulas, code and tables keep their signs."""
    rows = {r["row_id"]: canonical(r["content"]) for r in spark.read.parquet(f"{small}/all_documents.parquet").collect()}
    clean = {r["row_id"]: r["clean_text"] for r in QUERIES["p6_clean"](spark, small).collect()}
    marked = {r["row_id"] for r in QUERIES["p6_found"](spark, small).collect()}
    assert set(clean) == set(rows) and all(canonical(clean[i]) == t for i, t in rows.items() if i not in marked)
    left = [i for i in marked if {"html", "wiki"} & set(languages(clean[i] or ""))]
    assert len(left) <= 0.03 * len(marked)
