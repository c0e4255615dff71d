"""The registered queries over the test tables, and the SQL that checks them.

Search queries take every row of the query tables (evaluation pairs and held-out
questions) whose id is divisible by 100, against all chunks; `source_list` and `retrieval_metrics_avg`
take every row. All other queries run over their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import chunking, metrics, similarity, text
from siltstone.operators import answering, bm25, evaluation, filters, fusion, layout, memory, recognition, rerank, search, tools, vector
from siltstone.runtime import cut, table
from siltstone.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


# --- shared inputs ---------------------------------------------------------------------


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "all_documents").filter("content is not null")
    return t.select(F.col("row_id").alias("key"), F.col("content").alias("text"), "file_name", "company", "title", "broker", "report_date", "chunk_id", "page_num")


#: Added to the ids of questions of held-out items.
HELD_OUT = 1_000_000_000


def _every_asked(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "testset").select(F.col("item_id").alias("query_id"), "query")
    held = table(spark, sf, "heldout_items").select((F.col("item_id") + HELD_OUT).alias("query_id"), F.col("question").alias("query"))
    return own.unionByName(held)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _every_asked(spark, sf).filter("query_id % 100 = 0")


def _hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return bm25.search(_asked(spark, sf), _chunks(spark, sf), "key", "text", k)


def _every_hits(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_every_asked(spark, sf), _chunks(spark, sf), "key", "text")


TOKENS = r"""regexp_extract_all(regexp_replace(lower(trim(replace({0}, chr(10), ' '))), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[a-zA-Z]+|[一-龥]|[0-9]+')"""
_DOCS = f"d AS (SELECT row_id AS key, {TOKENS.format('content')} AS tokens FROM all_documents WHERE content IS NOT NULL)"
_STATS = """
    c AS (SELECT count(*) AS n, avg(len(tokens)) AS average FROM d),
    f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM d) GROUP BY term),
    r AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM f, c),
    i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)
"""
_ASKED = """SELECT item_id AS query_id, query FROM testset WHERE item_id % 100 = 0
      UNION ALL SELECT item_id + 1000000000, question FROM heldout_items WHERE item_id % 100 = 0"""

_EVERY_ASKED = "SELECT item_id AS query_id, query FROM testset UNION ALL SELECT item_id + 1000000000, question FROM heldout_items"


def _hits_sql(asked: str) -> str:
    """The best ten chunks (h) of the questions of a statement."""
    return f"""{_DOCS}, {_STATS},
    q AS ({asked}),
    w AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM q) GROUP BY ALL),
    p AS (SELECT key, length, term, count(*) AS tf FROM (SELECT key, len(tokens) AS length, unnest(tokens) AS term FROM d) GROUP BY ALL),
    s AS (SELECT query_id, key, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))), 6) AS score
          FROM w JOIN i USING (term) JOIN p USING (term), c GROUP BY ALL),
    h AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 10)
"""


_HITS = _hits_sql(_ASKED)
_EVERY_HITS = _hits_sql(_EVERY_ASKED)


# --- text functions ----------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT key, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS token_md5 FROM d")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = bm25.tokenised(_chunks(spark, sf), "key", "text")
    return t.select("key", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("token_md5"))


@query(r"""SELECT row_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(content, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
    '^\s+|\s+$', '', 'g')) AS clean_md5 FROM all_documents""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", F.md5(text.clean(F.col("content"))).alias("clean_md5"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0}, ''), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""SELECT row_id, length(t) < 30 OR regexp_matches(t, '{"|".join(text.NOISE_WORDS)}')
    OR length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(t) < 0.45 AS noise
    FROM (SELECT row_id, {_CLEAN.format("content")} AS t FROM all_documents)""")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.is_noise(F.col("content")).alias("noise"))


@query("""SELECT row_id, coalesce(
    CASE WHEN regexp_matches(file_stem, '20\\d{2}[-/\\.年]\\d{1,2}[-/\\.月]\\d{1,2}') THEN regexp_extract(file_stem, '(20\\d{2})[-/\\.年](\\d{1,2})[-/\\.月](\\d{1,2})', 1) || '-'
      || lpad(regexp_extract(file_stem, '(20\\d{2})[-/\\.年](\\d{1,2})[-/\\.月](\\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(file_stem, '(20\\d{2})[-/\\.年](\\d{1,2})[-/\\.月](\\d{1,2})', 3), 2, '0') END,
    CASE WHEN regexp_matches(file_stem, '20\\d{6}') THEN regexp_extract(file_stem, '(20\\d{2})(\\d{2})(\\d{2})', 1) || '-' || regexp_extract(file_stem, '(20\\d{2})(\\d{2})(\\d{2})', 2) || '-'
      || regexp_extract(file_stem, '(20\\d{2})(\\d{2})(\\d{2})', 3) END) AS date FROM all_documents""")
def regex_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.report_date(F.col("file_stem")).alias("date"))


_ORG = "银行|证券|集团|股份|科技|信息|药业|电子|能源|通信|汽车|工业|软件|智能|航空|半导体"


@query(f"""SELECT row_id, coalesce(
    nullif(regexp_extract(title, '([一-龥A-Za-z]{{2,20}}(?:{_ORG}))', 1), ''), nullif(regexp_extract(title, '([一-龥]{{2,12}})（\\d{{6}}(?:\\.SH|\\.SZ)?）', 1), ''),
    nullif(regexp_extract(title, '([一-龥]{{2,12}})\\(\\d{{6}}(?:\\.SH|\\.SZ)?\\)', 1), ''),
    nullif(regexp_extract(left(content, 3000), '([一-龥A-Za-z]{{2,20}}(?:{_ORG}))', 1), ''), nullif(regexp_extract(left(content, 3000), '([一-龥]{{2,12}})（\\d{{6}}(?:\\.SH|\\.SZ)?）', 1), ''),
    nullif(regexp_extract(left(content, 3000), '([一-龥]{{2,12}})\\(\\d{{6}}(?:\\.SH|\\.SZ)?\\)', 1), '')) AS company FROM all_documents""")
def regex_company(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.company(F.col("title"), F.col("content")).alias("company"))


@query("""SELECT row_id, CASE WHEN regexp_matches(p, '证券|研究所|投顾|基金|资管') AND length(p) BETWEEN 2 AND 20 THEN p
    ELSE nullif(regexp_extract(file_stem, '([一-龥A-Za-z]{2,20}证券)', 1), '') END AS broker
    FROM (SELECT row_id, file_stem, trim(regexp_split_to_array(file_stem, '[_\\-—]+')[1]) AS p FROM all_documents)""")
def broker_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.broker(F.col("file_stem")).alias("broker"))


@query("SELECT row_id, file_name || '::page_' || page_num || '::chunk_' || left(md5(content), 12) AS chunk_key FROM all_documents")
def md5_chunk_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.chunk_key(F.col("file_name"), F.col("page_num"), F.col("content")).alias("chunk_key"))


@query(r"""WITH r AS (SELECT item_id, lower(regexp_replace(coalesce(query, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS raw FROM testset),
    b AS (SELECT *, regexp_replace(raw, '[？?！!，,。.；;：:\s\p{Z}]+', '', 'g') AS bare FROM r)
    SELECT item_id, CASE WHEN regexp_matches(bare, '你是谁|你是什么模型|介绍一下你自己|请介绍你自己|你好|您好|hello|(^|[^\p{L}\p{N}_])hi($|[^\p{L}\p{N}_])|你能做什么')
        OR regexp_matches(raw, '你是谁|你是什么模型|介绍一下你自己|请介绍.*你自己|你好|您好|hello|(^|[^\p{L}\p{N}_])hi($|[^\p{L}\p{N}_])|你能做什么') THEN 'chat'
      WHEN regexp_matches(bare, '这个怎么样|这个呢|那这个呢|那它呢|这个公司怎么样') OR length(bare) <= 2 THEN 'unclear' ELSE 'rag_qa' END AS intent FROM b""")
def route_intent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "testset").select("item_id", text.intent(F.col("query")).alias("intent"))


@query(r"""WITH t AS (SELECT item_id, regexp_replace(coalesce(query, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS q FROM testset),
    f AS (SELECT *, regexp_matches(q, '公司|集团|银行|证券|保险|科技|信息|股份|控股|有限') AND regexp_matches(q, '营收|收入|利润|净利润|归母净利润|毛利率|净利率|同比|环比|估值|PE|PB|ROE|现金流|资产负债率') AS alone FROM t)
    SELECT item_id, alone, q <> '' AND (regexp_matches(q, '它|他|她|这家|那家|该公司|其|这个|那个|前者|后者|那|然后|再|接着|另外|还有|以及|如何|多少|吗')
      OR regexp_matches(q, '对比|比较|分别|各自|汇总|总结|筛选|排除|不包括|除了|排名|前五|前十|top|bottom|比|较|更|多|少') OR length(q) > 15 AND NOT alone) AS rewriting FROM f""")
def rewrite_need(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return table(spark, sf, "testset").select("item_id", text.stands_alone(text.stripped(F.coalesce(q, F.lit("")))).alias("alone"), text.needs_rewriting(q).alias("rewriting"))


@query(r"""SELECT row_id, md5(trim(regexp_replace(regexp_replace(content, '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'), '[\x00-\x08\x0e-\x1b]', '', 'g'))) AS one_line_md5,
    md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(content, chr(160), ' '), '(?m)^\s*=+\s*$', '', 'g'), '(?m)^\s*\d+\s*/\s*\d+\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS before_split_md5,
    md5(replace(trim(regexp_replace(replace(coalesce(title, ''), chr(10), '<br>'), '[ \t]+', ' ', 'g')), '|', '\|')) AS cell_md5 FROM all_documents""")
def clean_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("content")
    forms = {"one_line_md5": text.one_line(t), "before_split_md5": text.before_split(t), "cell_md5": text.cell(F.col("title"))}
    return table(spark, sf, "all_documents").select("row_id", *[F.md5(x).alias(n) for n, x in forms.items()])


@query(r"""SELECT item_id, CASE WHEN length(query) > 12 THEN left(query, 12) || '...' ELSE query END AS short, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS folded,
    left(regexp_replace('api_key=' || item_id || ' ' || query, '(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;&]+', '\1***', 'g'), 1000) AS redacted,
    CASE WHEN contains(reference, '来源') THEN reference ELSE regexp_replace(reference, '\s+$', '') || chr(10) || chr(10) || '来源：' || chr(10) || '- 无' END AS sourced FROM testset""")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    secret = F.concat(F.lit("api_key="), F.col("item_id").cast("string"), F.lit(" "), q)
    return table(spark, sf, "testset").select("item_id", text.truncated(q, 12).alias("short"), text.folded(q).alias("folded"), text.redacted(secret).alias("redacted"), text.with_sources(F.col("reference"), F.lit("- 无")).alias("sourced"))


@query(rf"""WITH l AS (SELECT row_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_CLEAN.format("x")}), lambda x: x <> '')[1:80] AS lines FROM all_documents),
    c AS (SELECT row_id, list_filter(lines, lambda x: length(x) BETWEEN 6 AND 40 AND NOT regexp_full_match(x, '\d{{1,3}}|-\s*\d{{1,3}}\s*-|第\s*\d+\s*页') AND NOT regexp_matches(x, '20\d{{2}}[-/\.年]\d{{1,2}}[-/\.月]\d{{1,2}}|20\d{{6}}')
      AND NOT regexp_matches(x, '请务必阅读正文之后的免责条款部分|风险提示|目录|证券研究报告|行业评级|投资评级') AND NOT regexp_matches(x, '^[一-龥A-Za-z]{{2,20}}(?:证券|研究所|基金|资管)$')) AS c FROM l)
    SELECT row_id, coalesce(list_filter(c, lambda x: regexp_matches(x, '深度|专题|点评|研究|报告|行业|公司|策略|跟踪'))[1], c[1]) AS title FROM c""")
def title_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "all_documents").select("row_id", text.title(F.col("content")).alias("title"))


@query("""SELECT row_id, coalesce(nullif(chunk_id, ''), file_name || '::page_' || page_num || '::chunk_' || left(md5(content), 12)) AS builder_key,
    coalesce(nullif(chunk_id, ''), file_name || '::page_' || page_num || '::chunk_' || (row_number() OVER (PARTITION BY file_name, page_num ORDER BY row_id) - 1)) AS judge_key FROM all_documents""")
def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of chunks by both rules: content, or place in the page, where a chunk has no id."""
    t = table(spark, sf, "all_documents")
    place = (F.row_number().over(Window.partitionBy("file_name", "page_num").orderBy("row_id")) - 1).cast("string")
    at = F.concat("file_name", F.lit("::page_"), F.col("page_num").cast("string"), F.lit("::chunk_"), place)
    none = F.lit(None).cast("string")
    made = text.chunk_key(F.col("file_name"), F.col("page_num"), F.col("content"))
    return t.select("row_id", text.first_key(F.col("chunk_id"), none, made).alias("builder_key"), text.first_key(F.col("chunk_id"), none, at).alias("judge_key"))


@query("""SELECT r_regionkey AS key, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |' AS padded,
    '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |' AS plain FROM region""")
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    row = F.array(F.col("r_regionkey").cast("string"), F.concat(F.lit(" "), F.col("r_name")))
    rows = F.array(F.array(F.lit("key"), F.lit("name")), row)
    blank = F.array(F.lit(""), F.lit(None).cast("string"))
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), text.markdown_table(F.concat(rows, F.array(blank))).alias("padded"), text.plain_table(rows).alias("plain"))


@query("""SELECT doc_id, md5(string_agg(content, chr(10) ORDER BY page_num, content)) AS front_md5 FROM all_documents WHERE page_num <= 3 AND trim(content) <> '' GROUP BY doc_id""")
def front_pages(spark: SparkSession, sf: str) -> DataFrame:
    return readers.front_text(table(spark, sf, "all_documents")).select("doc_id", F.md5("text").alias("front_md5"))


@query("""SELECT row_id, n, md5(w) AS window_md5 FROM (
    SELECT doc_id AS row_id, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 800) END) AS s, s // 800 AS n,
      CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, s + 1, 1000) END AS w FROM documents WHERE text IS NOT NULL)""")
def fixed_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").filter("text is not null")
    return t.select(F.col("doc_id").alias("row_id"), F.posexplode(chunking.windows(F.col("text"))).alias("n", "w")).select("row_id", F.col("n").cast("bigint").alias("n"), F.md5("w").alias("window_md5"))


@query()
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents")
    return t.select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("n", "chunk")).withColumn("n", F.col("n") + 1)


@query()
def markdown_segments(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "all_documents")
    return t.select("row_id", F.posexplode(chunking.pair_segments(F.col("content"))).alias("n", "segment"))


@query(r"""SELECT item_id, CASE WHEN len(u) > 0 THEN round(len(list_intersect(x, y))::DOUBLE / len(u), 6) ELSE 0.0 END AS jaccard FROM (
    SELECT item_id, x, y, list_distinct(list_concat(x, y)) AS u FROM (
      SELECT item_id, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]')) AS x, list_distinct(regexp_extract_all(lower(coalesce(reference, '')), '[\p{L}\p{N}_]')) AS y FROM testset))""")
def char_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "testset")
    return t.select("item_id", F.round(similarity.char_jaccard(F.col("query"), F.coalesce("reference", F.lit(""))), 6).alias("jaccard"))


@query("SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k, length(props) <= 4000 AS small FROM events WHERE (props::JSON ->> '$.k')::BIGINT >= 50")
def json_filters(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.length("props") <= 4000).alias("small"))
    return t.filter("k >= 50")


# --- retrieval ---------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT key, len(tokens) AS length FROM d")
def bm25_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.document_stats(bm25.tokenised(_chunks(spark, sf), "key", "text"))


@query(f"WITH {_DOCS}, {_STATS} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_term_idf(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.term_stats(bm25.tokenised(_chunks(spark, sf), "key", "text")).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_HITS} SELECT * FROM h")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_VECTORS = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS key,
        round(1 - (2 - 2 * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / sqrt(2.0::DOUBLE), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10)"""


@query(f"WITH {_VECTORS} SELECT * FROM v")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector.search(_vector_queries(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_VECTORS} SELECT * FROM v WHERE score >= 0.1")
def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return vector.search(_vector_queries(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", threshold=0.1)


@query(f"""WITH {_HITS}, {_VECTORS},
    e AS (SELECT md5(content) AS m, min(row_id) AS identity FROM all_documents WHERE content IS NOT NULL GROUP BY ALL),
    names AS (SELECT row_id AS key, identity FROM all_documents JOIN e ON md5(content) = m),
    lists AS (SELECT q.query_id, identity, min(rank) AS rank, 0.8::DOUBLE AS weight FROM v JOIN names USING (key) JOIN q ON q.query_id % 1000000000 = v.query_id GROUP BY ALL
      UNION ALL SELECT query_id, identity, min(rank), 0.2::DOUBLE FROM h JOIN names USING (key) GROUP BY ALL),
    fused AS (SELECT query_id, identity AS key, round(sum(weight / (rank + 60)), 6) AS score FROM lists GROUP BY ALL)
    SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fused QUALIFY rank <= 30""")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = _asked(spark, sf).withColumn("key", F.col("query_id") % HELD_OUT).join(vectors, "key", "left").drop("key")
    return search.search(asked, _chunks(spark, sf), vectors, "hybrid", threshold=None)


_PART = "hf AS (SELECT h.*, lower(a.content) AS t, a.* FROM h JOIN all_documents a ON a.row_id = h.key)"


@query(f"""WITH {_HITS}, {_PART}, m AS (SELECT query_id, key, rank, contains(lower(concat_ws(' ', content, company, title)), '2019') AS ok FROM hf)
    SELECT query_id, key, rank FROM m QUALIFY ok OR NOT max(ok) OVER (PARTITION BY query_id)""")
def soft_filter(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    ok = filters.all_values(F.array(F.lit("2019"), F.lit("")), filters.searchable(F.col("text"), F.col("company"), F.col("title")))
    return filters.soft(hits, ok).select("query_id", "key", "rank")


@query(f"WITH {_HITS}, {_PART} SELECT query_id, key, rank FROM hf WHERE NOT contains(t, '子公司') AND NOT contains(t, 'note')")
def hard_exclude(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    return filters.exclude(hits, F.array(F.lit("子公司"), F.lit("Note")), F.col("text")).select("query_id", "key", "rank")


@query(f"""WITH {_HITS}, {_PART}, m AS (SELECT query_id, key, rank, contains(t, '营业收入') AND contains(t, '2020') AS ok FROM hf)
    SELECT query_id, key, rank FROM m QUALIFY ok OR NOT max(ok) OVER (PARTITION BY query_id)""")
def soft_required(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    return filters.soft(hits, filters.all_values(F.array(F.lit("营业收入"), F.lit("2020")), F.lower("text"))).select("query_id", "key", "rank")


@query(f"""WITH {_HITS}, {_PART} SELECT query_id, key, rank FROM hf
    QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(file_name, ''), coalesce(page_num::VARCHAR, ''), coalesce(chunk_id, '') ORDER BY rank) = 1""")
def hit_dedup(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    return fusion.deduplicate(hits, ["file_name", "page_num", "chunk_id"], [F.col("rank")]).select("query_id", "key", "rank")


_ORIGIN = "'文件名: ' || coalesce(file_name, '') || chr(10) || '页码: ' || coalesce(page_num::VARCHAR, '') || chr(10)"


@query(f"""WITH {_HITS}, {_PART} SELECT query_id, md5(string_agg('[片段' || rank || ']' || chr(10) || {_ORIGIN} || '内容: ' || CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END || chr(10),
    chr(10) ORDER BY rank)) AS context_md5 FROM hf GROUP BY query_id""")
def context_render(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    return tools.context(hits).select("query_id", F.md5("context").alias("context_md5"))


@query(f"""WITH {_HITS}, {_PART} SELECT query_id, md5(string_agg('[片段' || rank || ']' || chr(10) || {_ORIGIN} || '子查询: ' || rank % 3 || chr(10) || '内容: ' || content || chr(10), chr(10) ORDER BY rank)) AS fragments_md5
    FROM hf GROUP BY query_id""")
def tool_fragments(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).withColumn("sub_query", F.col("rank") % 3).join(_chunks(spark, sf), "key")
    return tools.fragments(hits, sub_query="sub_query").select("query_id", F.md5("fragments").alias("fragments_md5"))


@query(f"""WITH {_EVERY_HITS}, {_PART}, places AS (SELECT query_id, coalesce(file_name, '') AS file, coalesce(page_num::VARCHAR, '') AS page, min(rank) AS rank FROM hf GROUP BY ALL)
    SELECT query_id, string_agg('- ' || file || '，第' || page || '页', chr(10) ORDER BY rank) AS sources FROM places GROUP BY query_id""")
def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return tools.sources(_every_hits(spark, sf).join(_chunks(spark, sf), "key"))


@query(f"""WITH {_HITS}, {_PART} SELECT query_id, rank - 1 AS id, coalesce(page_num::VARCHAR, '未知') AS page, coalesce(nullif(file_name, ''), '文档') AS pdf, content, score FROM hf""")
def evidence_list(spark: SparkSession, sf: str) -> DataFrame:
    return tools.evidences(_hits(spark, sf).join(_chunks(spark, sf), "key"))


@query(f"""WITH {_HITS}, {_PART} SELECT query_id, rank - 1 AS place, 'doc_' || (rank - 1) AS doc_id, coalesce(chunk_id, 'chunk_' || (rank - 1)) AS chunk_id, coalesce(file_name, '') AS file_name,
    coalesce(page_num::VARCHAR, '') AS page_num, md5(content) AS content_md5, score FROM hf""")
def result_normalised(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    raw = hits.select("query_id", "rank", "score", F.col("text").alias("page_content"), F.struct("chunk_id", "file_name", "page_num").alias("metadata"))
    return tools.normalised(raw, ["rank"], "metadata").withColumn("content_md5", F.md5("content")).drop("content")


@query(f"WITH {_HITS}, {_PART} SELECT query_id, file_name AS value, count(*) AS n FROM hf GROUP BY ALL")
def hit_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return tools.contributions(_hits(spark, sf).join(_chunks(spark, sf), "key"), "file_name")


def _parts(asked: str, sub: str = "2") -> str:
    """Structured search of questions, each with itself and itself after two words as sub-queries; the filter value is 2020, the limit 6."""
    both = f"SELECT query_id * 2 + n AS query_id, CASE WHEN n = 0 THEN query ELSE '营业收入 ' || query END AS query FROM ({asked}), range({sub}) t(n)"
    return f"""{_hits_sql(both)},
    j AS (SELECT query_id // 2 AS own, query_id % 2 AS sub_query, key, rank, contains(lower(concat_ws(' ', content, file_name, company, title, broker, report_date, chunk_id, page_num)), '2020') AS ok,
          coalesce(file_name, '') AS f, coalesce(page_num::VARCHAR, '') AS g, coalesce(chunk_id, '') AS ch FROM h JOIN all_documents ON row_id = key),
    o AS (SELECT * FROM j QUALIFY ok OR NOT max(ok) OVER (PARTITION BY own, sub_query)),
    u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY own, f, g, ch ORDER BY sub_query, rank, key) = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY own, sub_query ORDER BY rank) AS turn FROM u),
    z AS (SELECT own AS query_id, row_number() OVER (PARTITION BY own ORDER BY turn, sub_query) AS position, sub_query, key, rank FROM t QUALIFY position <= 6)"""


def _questions(asked: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return asked.select("query_id", "query", F.array("query", F.concat(F.lit("营业收入 "), "query")).alias("sub_queries"), F.array(F.lit("2020 ")).alias("filter_values"), none.alias("exclude_terms"), none.alias("required_terms"), F.lit(6).alias("top_k"))


@query(f"WITH {_parts(_ASKED)} SELECT query_id, position, sub_query, key, rank FROM z")
def structured_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.structured(_questions(_asked(spark, sf)).drop("query"), _chunks(spark, sf))


_FACTS = f"SELECT * FROM ({_ASKED}) WHERE query_id % 200 = 0"
_OTHERS = f"SELECT * FROM ({_ASKED}) WHERE query_id % 200 <> 0"


@query(f"""SELECT query_id, 'simple' AS search_kind, rank AS position, key FROM (WITH {_hits_sql(_FACTS)} SELECT * FROM h)
    UNION ALL SELECT query_id, 'structured', position, key FROM (WITH {_parts(_OTHERS)} SELECT * FROM z)""")
def report_search(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("query_id") % 200 == 0, "fact").otherwise("compare")
    return search.report_search(_questions(_asked(spark, sf)).withColumn("task_type", kind).withColumn("rewritten_query", F.col("query")), _chunks(spark, sf))


@query(f"""WITH {_HITS}, b AS (SELECT query_id, key, rank, rank % 3 AS sub_query, row_number() OVER (PARTITION BY query_id, rank % 3 ORDER BY rank) AS turn FROM h)
    SELECT query_id, key, sub_query, row_number() OVER (PARTITION BY query_id ORDER BY turn, sub_query) AS position FROM b QUALIFY position <= 5""")
def round_robin_balance(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).withColumn("sub_query", F.col("rank") % 3)
    return fusion.balance(hits, 5).select("query_id", "key", "sub_query", "position")


@query()
def rerank_max_segment(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).select("query_id", "key").join(_chunks(spark, sf).select("key", "text"), "key").join(_asked(spark, sf), "query_id")
    return rerank.rerank(hits)


@query("""WITH p AS (SELECT row_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num NULLS FIRST, row_id) AS at FROM all_documents)
    SELECT t.row_id AS target, n.row_id AS key, n.at - t.at AS distance, CASE WHEN n.at = t.at THEN 'target' ELSE 'neighbor' END AS relation
    FROM p t JOIN p n ON t.doc_id = n.doc_id AND n.at BETWEEN t.at - 1 AND t.at + 1 WHERE t.row_id % 100 = 0""")
def context_expand(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "all_documents")
    return tools.expand(t, t.filter("row_id % 100 = 0"), "row_id", "doc_id", ["page_num", "row_id"])


@query("""SELECT doc_id, row_id, file_name, title, company, broker, report_date FROM all_documents WHERE coalesce(doc_id, '') <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_id) = 1""")
def report_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return tools.catalog(table(spark, sf, "all_documents"), "doc_id", ["row_id", "file_name", "title", "company", "broker", "report_date"], ["row_id"])


@query("""WITH f AS (SELECT doc_id, row_id, file_name, title, company, broker, report_date FROM all_documents WHERE coalesce(doc_id, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_id) = 1)
    SELECT * FROM f WHERE coalesce(starts_with(report_date, '2021'), false) OR contains(lower(concat_ws(' ', company, title, file_name, broker)), '2021') ORDER BY row_id, doc_id LIMIT 20""")
def report_catalog_year(spark: SparkSession, sf: str) -> DataFrame:
    return tools.catalog(table(spark, sf, "all_documents"), "doc_id", ["row_id", "file_name", "title", "company", "broker", "report_date"], ["row_id"], year="2021", limit=20)


@query(f"WITH {_HITS}, {_PART} SELECT query_id, rank, file_name, page_num, chunk_id, left(content, 180) AS snippet FROM hf")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return tools.citations(_hits(spark, sf).join(_chunks(spark, sf), "key"))


@query(f"WITH {_HITS} SELECT query_id, coalesce(score >= 20, true) AS passed FROM h WHERE rank = 1")
def judge_top1(spark: SparkSession, sf: str) -> DataFrame:
    return tools.relevant_enough(_hits(spark, sf), 20.0)


@query(rf"""WITH {_HITS}, t AS (SELECT query_id, regexp_replace(coalesce(query, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS raw FROM q),
    b AS (SELECT *, regexp_replace(lower(raw), '[？?！!，,。.；;：:\s\p{{Z}}]+', '', 'g') AS bare FROM t),
    n AS (SELECT query_id, CASE WHEN regexp_matches(bare, '你是谁|你是什么模型|介绍一下你自己|请介绍你自己|你好|您好|hello|你能做什么') OR regexp_matches(lower(raw), '请介绍.*你自己|(^|[^\p{{L}}\p{{N}}_])hi($|[^\p{{L}}\p{{N}}_])|hello') THEN 'chat'
        WHEN regexp_matches(bare, '这个怎么样|这个呢|那这个呢|那它呢|这个公司怎么样') OR length(bare) <= 2 THEN 'unclear' ELSE 'rag_qa' END AS intent,
      raw <> '' AND (regexp_matches(raw, '它|他|她|这家|那家|该公司|其|这个|那个|前者|后者|那|然后|再|接着|另外|还有|以及|如何|多少|吗|对比|比较|分别|各自|汇总|总结|筛选|排除|不包括|除了|排名|前五|前十|top|bottom|比|较|更|多|少')
        OR length(raw) > 15 AND NOT (regexp_matches(raw, '公司|集团|银行|证券|保险|科技|信息|股份|控股|有限') AND regexp_matches(raw, '营收|收入|利润|毛利率|净利率|同比|环比|估值|PE|PB|ROE|现金流|资产负债率'))) AS rewriting FROM b),
    k AS (SELECT query_id, count(*) AS hits, max(score) FILTER (rank = 1) AS top FROM h GROUP BY ALL)
    SELECT query_id, intent, rewriting, coalesce(hits, 0) AS hits, CASE WHEN intent = 'chat' THEN 'chat' WHEN intent = 'rag_qa' AND coalesce(top >= 60, false) THEN 'answer' ELSE 'fallback' END AS outcome FROM n LEFT JOIN k USING (query_id)""")
def question_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return answering.outcomes(_asked(spark, sf), _hits(spark, sf), 60.0)


@query(f"""WITH {_HITS}, {_PART}, best AS (SELECT query_id FROM h WHERE rank = 1 AND score >= 20), places AS (SELECT query_id, coalesce(file_name, '') AS file, coalesce(page_num::VARCHAR, '') AS page, min(rank) AS rank FROM hf GROUP BY ALL),
    l AS (SELECT query_id, string_agg('- ' || file || '，第' || page || '页', chr(10) ORDER BY rank) AS sources FROM places GROUP BY query_id),
    x AS (SELECT query_id, md5(string_agg('[片段' || rank || ']' || chr(10) || {_ORIGIN} || '内容: ' || CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END || chr(10), chr(10) ORDER BY rank)) AS context_md5 FROM hf GROUP BY query_id)
    SELECT query_id, query, context_md5, sources FROM q JOIN best USING (query_id) JOIN x USING (query_id) JOIN l USING (query_id)""")
def answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).join(_chunks(spark, sf), "key")
    return answering.prompts(_asked(spark, sf), hits, 20.0).select("query_id", "query", F.md5("context").alias("context_md5"), "sources")



# --- metrics -----------------------------------------------------------------------------

_YEARS = """t AS (SELECT year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(20,6))::DECIMAL(20,6) AS total FROM orders GROUP BY ALL),
    y AS (SELECT t.year, t.total, b.total AS previous FROM t LEFT JOIN t b ON b.year = t.year - 1)"""


def _years(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,6)")).cast("decimal(20,6)").alias("total"))
    before = years.select((F.col("year") + 1).alias("year"), F.col("total").alias("previous"))
    return years.join(before, "year", "left")


def _metric(operation: str, precision: int, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        amounts = [F.col("total"), F.col("previous")]
        return _years(spark, sf).select("year", metrics.metric(operation, amounts, precision).alias("value"))

    QUERIES[f"metric_{operation}"] = run
    ORACLES[f"metric_{operation}"] = f"WITH {_YEARS} SELECT year, round({sql}, {precision})::DOUBLE AS value FROM y"


_metric("sum", 2, "total + previous")
_metric("difference", 2, "total - previous")
_metric("ratio", 4, "total::DOUBLE / previous")
_metric("growth_rate", 4, "(total - previous)::DOUBLE / abs(previous) * 100")
_metric("gross_margin", 4, "CASE WHEN total <> 0 THEN (total - previous)::DOUBLE / total * 100 END")


# --- layout ------------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "text_blocks")


@query("""SELECT b.block_id FROM text_blocks b WHERE coalesce(b.block_type, '') <> 'table' AND NOT EXISTS (SELECT 1 FROM text_blocks t WHERE t.block_type = 'table'
    AND t.doc_id IS NOT DISTINCT FROM b.doc_id AND t.page = b.page AND b.x1 + 6 >= t.x0 AND t.x1 + 6 >= b.x0 AND b.y1 + 6 >= t.y0 AND t.y1 + 6 >= b.y0)""")
def spatial_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    t = _blocks(spark, sf)
    return layout.outside_tables(t.filter("coalesce(block_type, '') <> 'table'"), t.filter("block_type = 'table'")).select("block_id")


_SIGNS = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]'))"


@query(f"""WITH b AS (SELECT *, {_SIGNS.format("text")} AS s FROM text_blocks), n AS (SELECT * FROM b WHERE source = 'native'), o AS (SELECT * FROM b WHERE source = 'ocr'),
    m AS (SELECT o.block_id, greatest(0, least(o.x1, n.x1) - greatest(o.x0, n.x0)) * greatest(0, least(o.y1, n.y1) - greatest(o.y0, n.y0)) AS i,
            (o.x1 - o.x0) * (o.y1 - o.y0) + (n.x1 - n.x0) * (n.y1 - n.y0) AS a, len(list_intersect(o.s, n.s)) AS c, len(o.s) + len(n.s) AS l
          FROM o JOIN n ON o.doc_id = n.doc_id AND o.page = n.page)
    SELECT block_id, source FROM n UNION ALL SELECT block_id, source FROM o WHERE confidence > 0.6 AND block_id NOT IN (SELECT block_id FROM m WHERE a - i > 0 AND i / (a - i) > 0.5 AND l - c > 0 AND c::DOUBLE / (l - c) > 0.8)""")
def iou_jaccard_merge(spark: SparkSession, sf: str) -> DataFrame:
    t = _blocks(spark, sf)
    return layout.fuse_sources(t.filter("source = 'native'"), t.filter("source = 'ocr'"), "block_id").select("block_id", "source")


@query("""WITH w AS (SELECT *, max(x1) OVER p + 1 AS width FROM text_blocks WINDOW p AS (PARTITION BY doc_id, page)),
    z AS (SELECT *, CASE WHEN x0 < width / 2 AND x1 > width / 2 OR x1 - x0 > 0.7 * width THEN 'cross' WHEN (x0 + x1) / 2 <= width / 2 THEN 'left' ELSE 'right' END AS zone FROM w),
    c AS (SELECT *, sum((zone = 'left')::INT) OVER p >= 3 AND sum((zone = 'right')::INT) OVER p >= 3 AS two_columns FROM z WINDOW p AS (PARTITION BY doc_id, page))
    SELECT block_id, zone, two_columns, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN NOT two_columns OR zone = 'cross' THEN 0 WHEN zone = 'left' THEN 1 ELSE 2 END, y0, x0, block_id) AS reading_order FROM c""")
def layout_two_column(spark: SparkSession, sf: str) -> DataFrame:
    return layout.columns(_blocks(spark, sf), "block_id").select("block_id", "zone", "two_columns", "reading_order")


@query(r"""SELECT block_id FROM text_blocks WHERE NOT (trim(coalesce(text, '')) = '' OR y1 <= 840 * 0.06 OR y0 >= 840 * (1 - 0.06::DOUBLE)
    OR coalesce(regexp_full_match(trim(text), '\d{1,3}|-\s*\d{1,3}\s*-|第\s*\d+\s*页'), false))""")
def header_footer_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).filter(~F.coalesce(layout.is_head_or_foot(), F.lit(False))).select("block_id")


@query(r"""SELECT block_id, CASE WHEN y0 < 840 * 0.08::DOUBLE THEN 'header' WHEN y0 > 840 * 0.92::DOUBLE THEN 'footer'
    WHEN length(text) < 50 AND (text = upper(text) AND regexp_matches(text, '\p{Lu}') OR regexp_matches(text, '^[一二三四五六七八九十\p{Nd}]+[、\.]') OR regexp_matches(text, '^第[一二三四五六七八九十\p{Nd}]+[章节]')) THEN 'title' ELSE 'text' END AS kind FROM text_blocks""")
def block_type(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("block_id", text.block_type(F.col("text"), F.col("y0"), 840.0).alias("kind"))


_FUSED = """b AS (SELECT *, (x0 + x1) / 2 AS c FROM text_blocks WHERE text IS NOT NULL),
    m AS (SELECT doc_id, page, list_sort(list(c)) AS al, list_sort(coalesce(list(c) FILTER (block_type = 'text'), [])) AS tl FROM b GROUP BY ALL),
    k AS (SELECT *, al[len(al) // 2 + 1] AS middle, tl[len(tl) // 2 + 1] AS own FROM m),
    n AS (SELECT doc_id, page, middle, len(tl) >= 5 AND len(list_filter(tl, lambda x: x < own * 0.8::DOUBLE)) > 2 AND len(list_filter(tl, lambda x: x > own * 1.2::DOUBLE)) > 2 AS many FROM k),
    o AS (SELECT b.*, many, row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY CASE WHEN many AND c >= middle THEN 1 ELSE 0 END, y0, x0, block_id) AS place
      FROM b JOIN n ON b.doc_id IS NOT DISTINCT FROM n.doc_id AND b.page IS NOT DISTINCT FROM n.page)"""


@query(f"WITH {_FUSED} SELECT block_id, coalesce(many, false) AS many_columns, place FROM o")
def fused_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.fused_order(_blocks(spark, sf).filter("text is not null"), "block_id").select("block_id", "many_columns", "place")


_LINE = r"trim(regexp_replace(regexp_replace(text, '[\s\p{{Z}}\x1c-\x1f\x{{85}}]+', ' ', 'g'), '[\x00-\x08\x0e-\x1b]', '', 'g'))".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {_FUSED}, p AS (SELECT doc_id, page, string_agg(CASE WHEN block_type = 'title' THEN chr(10) || '### ' || {_LINE} || chr(10) WHEN block_type = 'table' THEN chr(10) || text || chr(10)
      WHEN block_type IN ('header', 'footer') THEN chr(10) || '*' || {_LINE} || '*' || chr(10) ELSE {_LINE} END, chr(10) ORDER BY place) AS body FROM o GROUP BY ALL)
    SELECT doc_id, page, md5(CASE WHEN page = min(page) OVER (PARTITION BY doc_id) THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) END || '## Page ' || page || chr(10) || chr(10) || body) AS markdown_md5 FROM p""")
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_markdown(_blocks(spark, sf), "block_id").select("doc_id", "page", F.md5("markdown").alias("markdown_md5"))


_SAME = "o.doc_id IS NOT DISTINCT FROM f.doc_id AND o.page IS NOT DISTINCT FROM f.page AND o.n = f.n + 1"


@query(f"""WITH RECURSIVE w AS (SELECT *, max(x1) OVER p + 1 AS width FROM text_blocks WINDOW p AS (PARTITION BY doc_id, page)),
    z AS (SELECT *, CASE WHEN x0 < width / 2 AND x1 > width / 2 OR x1 - x0 > 0.7 * width THEN 0 WHEN (x0 + x1) / 2 <= width / 2 THEN 1 ELSE 2 END AS zone FROM w),
    c AS (SELECT *, sum((zone = 1)::INT) OVER p >= 3 AND sum((zone = 2)::INT) OVER p >= 3 AS two FROM z WINDOW p AS (PARTITION BY doc_id, page)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN zone ELSE 0 END, y0, x0, block_id) AS n FROM c),
    f AS (SELECT doc_id, page, n, block_id, 1 AS paragraph, x0 AS l, y1 AS b FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.page, o.n, o.block_id, CASE WHEN abs(x0 - l) < 40 AND y0 - b <= 12 THEN paragraph ELSE paragraph + 1 END,
        CASE WHEN abs(x0 - l) < 40 AND y0 - b <= 12 THEN least(l, x0) ELSE x0 END, CASE WHEN abs(x0 - l) < 40 AND y0 - b <= 12 THEN greatest(b, y1) ELSE y1 END FROM f JOIN o ON {_SAME})
    SELECT doc_id, page, block_id, paragraph FROM f""")
def paragraph_merge(spark: SparkSession, sf: str) -> DataFrame:
    return layout.paragraphs(_blocks(spark, sf), "block_id")


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_id) AS n FROM text_blocks),
    f AS (SELECT doc_id, page, n, block_id, 1 AS line, y0 AS top FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.page, o.n, o.block_id, CASE WHEN abs(y0 - top) < 5 THEN line ELSE line + 1 END, CASE WHEN abs(y0 - top) < 5 THEN top ELSE y0 END FROM f JOIN o ON {_SAME})
    SELECT doc_id, page, block_id, line FROM f""")
def line_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lines(_blocks(spark, sf), "block_id")


_BARE = r"regexp_replace(text, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g')"


@query(f"""WITH RECURSIVE t AS (SELECT * REPLACE ({_BARE} AS text) FROM text_blocks),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) AS n FROM t WHERE source = 'ocr' AND text <> '' AND confidence >= 0),
    f AS (SELECT doc_id, page, n, text, x0, x1, y1, confidence, 1 AS line, y0 AS top FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.page, o.n, o.text, o.x0, o.x1, o.y1, o.confidence, CASE WHEN abs(y0 - top) < 10 THEN line ELSE line + 1 END, CASE WHEN abs(y0 - top) < 10 THEN least(top, y0) ELSE y0 END FROM f JOIN o ON {_SAME})
    SELECT doc_id, page, line, count(*) AS words, md5(string_agg(text, ' ' ORDER BY n)) AS text_md5, round(min(x0), 6) AS x0, round(min(top), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, round(avg(confidence), 6) AS confidence FROM f GROUP BY ALL""")
def recognised_lines(spark: SparkSession, sf: str) -> DataFrame:
    words = _blocks(spark, sf).filter("source = 'ocr'").withColumn("confidence", F.col("confidence") * 100)
    found = layout.recognised_lines(words, "block_id")
    return found.select("doc_id", "page", "line", "words", F.md5("text").alias("text_md5"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")])


_ROWS = f"""t AS (SELECT * REPLACE ({_BARE} AS text), (y0 + y1) / 2 AS middle FROM text_blocks),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY middle, block_id) AS n FROM t WHERE text <> ''),
    f AS (SELECT doc_id, page, n, block_id, text, x0, 1 AS row, middle AS anchor FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.page, o.n, o.block_id, o.text, o.x0, CASE WHEN abs(middle - anchor) < 5 THEN row ELSE row + 1 END, CASE WHEN abs(middle - anchor) < 5 THEN anchor ELSE middle END FROM f JOIN o ON {_SAME}),
    r AS (SELECT doc_id, page, row, string_agg(text, chr(9) ORDER BY x0, block_id) AS text FROM f GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_ROWS} SELECT doc_id, page, row, md5(text) AS text_md5 FROM r")
def tab_rows(spark: SparkSession, sf: str) -> DataFrame:
    return layout.tab_rows(_blocks(spark, sf), "block_id").select("doc_id", "page", "row", F.md5("text").alias("text_md5"))


@query(rf"""WITH RECURSIVE {_ROWS}, g AS (SELECT *, contains(text, chr(9)) AND contains(text, '的') AS in_table FROM r),
    l AS (SELECT *, coalesce(lag(in_table) OVER (PARTITION BY doc_id, page ORDER BY row), false) AS before FROM g)
    SELECT doc_id, page, row, in_table, md5(CASE WHEN in_table THEN CASE WHEN before THEN '' ELSE '| 术语 | 释义 |' || chr(10) || '|------|------|' || chr(10) END
      || '| ' || regexp_replace(string_split(text, chr(9))[1], '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') || ' | ' || regexp_replace(regexp_replace(text, '^[^\t]*\t', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') || ' |' ELSE text END) AS markdown_md5 FROM l""")
def glossary_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.tab_rows(_blocks(spark, sf), "block_id")
    return layout.glossary_rows(rows, "的").select("doc_id", "page", "row", "in_table", F.md5("markdown").alias("markdown_md5"))


@query(f"""WITH RECURSIVE o AS (SELECT *, greatest(1.0, y1 - y0) AS h, (y0 + y1) / 2 AS m, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_id) AS n FROM text_blocks),
    f AS (SELECT doc_id, page, n, block_id, x0, 1 AS line, [{{'m': m, 'h': h}}] AS refs FROM o WHERE n = 1
      UNION ALL SELECT doc_id, page, n, block_id, x0, CASE WHEN home > 0 THEN home ELSE len(refs) + 1 END, CASE WHEN home > 0 THEN refs ELSE list_append(refs, {{'m': m, 'h': h}}) END
        FROM (SELECT o.doc_id, o.page, o.n, o.block_id, o.x0, o.m, o.h, refs, coalesce(list_position(list_transform(refs, lambda a: abs(o.m - a.m) <= least(o.h, a.h) * 0.5), true), 0) AS home FROM f JOIN o ON {_SAME}))
    SELECT doc_id, page, block_id, line, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, x0, n) AS place FROM f""")
def reading_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_lines(_blocks(spark, sf), "block_id")


@query("SELECT block_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 10, 0), x0, block_id) AS place FROM text_blocks")
def bucket_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.bucket_order(_blocks(spark, sf), "block_id").select("block_id", "place")


@query()
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    return layout.element_markdown(layout.page_elements(_blocks(spark, sf), "block_id"))


@query("""SELECT block_id, count(*) OVER (PARTITION BY doc_id) AS total_blocks, text, block_type FROM text_blocks""")
def block_json(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.block_json(_blocks(spark, sf), "block_id")
    return found.select("block_id", "total_blocks", F.get_json_object("json", "$.text").alias("text"), F.get_json_object("json", "$.block_type").alias("block_type"))


@query(f"""WITH c AS (SELECT block_id, {_LINE} AS t FROM text_blocks WHERE text IS NOT NULL AND coalesce(block_type, '') NOT IN ('header', 'footer'))
    SELECT block_id, s // 30 AS n, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, s + 1, 40) END AS chunk FROM (SELECT block_id, t, unnest(CASE WHEN length(t) <= 40 THEN [0] ELSE range(0, length(t), 30) END) AS s FROM c)""")
def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.block_chunks(_blocks(spark, sf), "block_id", 40, 10).withColumn("n", F.col("n").cast("bigint"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks as spans: one block a page, lines of 20 points, flags by page."""
    t = _blocks(spark, sf).filter("text is not null")
    return t.select("doc_id", "page", F.lit(0).alias("block"), F.floor(F.col("y0") / 20).alias("line"), F.col("block_id").alias("span"), "text", *layout.BOX, F.coalesce("block_type", F.lit("none")).alias("font"), (F.col("y1") - F.col("y0")).alias("size"), (F.col("page") % 32).alias("flags"))


@query(f"""WITH s AS (SELECT doc_id, page, floor(y0 / 20) AS line, block_id AS span, {_BARE} AS text, x0, y0, x1, y1, coalesce(block_type, 'none') AS font, y1 - y0 AS size FROM text_blocks WHERE text IS NOT NULL),
    k AS (SELECT * FROM s WHERE text <> ''), n AS (SELECT doc_id, page, line, count(*) AS span_count FROM s GROUP BY ALL),
    fc AS (SELECT doc_id, page, line, font, count(*) AS c FROM k GROUP BY ALL), ff AS (SELECT doc_id, page, line, font FROM fc QUALIFY row_number() OVER (PARTITION BY doc_id, page, line ORDER BY c DESC, font) = 1),
    g AS (SELECT doc_id, page, line, list_reduce(list(text ORDER BY span), lambda a, b: a || CASE WHEN regexp_matches(right(a, 1), '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(left(b, 1), '[\\x{{4e00}}-\\x{{9fff}}]') THEN '' ELSE ' ' END || b) AS t,
      round(avg(size), 6) AS font_size, round(min(x0), 6) AS x0, round(max(y1), 6) AS y1 FROM k GROUP BY ALL)
    SELECT g.doc_id, g.page, g.line::BIGINT AS line, md5(t) AS text_md5, font, font_size, x0, y1, (g.page % 32) & 16 <> 0 AS is_bold, (g.page % 32) & 2 <> 0 AS is_italic, span_count
    FROM g JOIN ff ON g.doc_id IS NOT DISTINCT FROM ff.doc_id AND g.page = ff.page AND g.line = ff.line JOIN n ON g.doc_id IS NOT DISTINCT FROM n.doc_id AND g.page = n.page AND g.line = n.line""")
def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.native_blocks(_spans(spark, sf))
    return found.select("doc_id", "page", "line", F.md5("text").alias("text_md5"), "font", F.round("font_size", 6).alias("font_size"), F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"), "is_bold", "is_italic", "span_count")


@query("SELECT block_id, round(greatest(x1 - x0, 0), 6) AS width, round(greatest(y1 - y0, 0), 6) AS height, round(greatest(x1 - x0, 0) * greatest(y1 - y0, 0), 6) AS area, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y FROM text_blocks")
def box_measures(spark: SparkSession, sf: str) -> DataFrame:
    m = recognition.measures(*[F.col(c) for c in layout.BOX])
    return _blocks(spark, sf).select("block_id", m.alias("m")).select("block_id", *[F.round(F.col("m")[c], 6).alias(c) for c in ("width", "height", "area", "center_x", "center_y")])


@query("""WITH c AS (SELECT block_id, greatest(0.0, least(x0, 499.0)) AS a, greatest(0.0, least(y0, 699.0)) AS b, greatest(0.0, least(x1, 499.0)) AS c, greatest(0.0, least(y1, 699.0)) AS d, x0, y0, x1, y1 FROM text_blocks)
    SELECT block_id, round(a, 6) AS x0, round(b, 6) AS y0, round(c, 6) AS x1, round(d, 6) AS y1, round(least(x1 - x0, y1 - y0), 6) AS shorter, round((x1 - x0) * 1.6::DOUBLE, 6) AS wider FROM c WHERE x1 > x0 AND y1 > y0""")
def box_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes clipped to an image; their corners, shuffled, put in order, and moved apart."""
    t = _blocks(spark, sf).filter("x1 > x0 and y1 > y0")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    mixed = recognition.corners(F.array(point("x1", "y1"), point("x0", "y1"), point("x0", "y0"), point("x1", "y0")))
    box = recognition.clipped(F.array(*layout.BOX), F.lit(500.0), F.lit(700.0))
    wide = recognition.bounds(recognition.expanded(mixed))
    return t.select("block_id", *[F.round(box[i], 6).alias(c) for i, c in enumerate(layout.BOX)], F.round(recognition.shorter_side(mixed), 6).alias("shorter"), F.round(wide[2] - wide[0], 6).alias("wider"))


@query("""SELECT block_id FROM text_blocks WHERE x1 - x0 >= 6 AND y1 - y0 >= 6 AND (x1 - x0) / greatest(y1 - y0, 1) BETWEEN 0.08::DOUBLE AND 40 AND trim(coalesce(text, '')) <> '' AND confidence >= 0.45::DOUBLE""")
def recognised_texts(spark: SparkSession, sf: str) -> DataFrame:
    return recognition.usable_texts(_blocks(spark, sf)).select("block_id")


@query("SELECT block_id FROM text_blocks WHERE confidence >= 0.45::DOUBLE AND x1 - x0 >= 4 AND y1 - y0 >= 4 AND (x1 - x0) * (y1 - y0) >= 16")
def detected_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return recognition.usable_boxes(_blocks(spark, sf), "confidence").select("block_id")


@query("""WITH s AS (SELECT user_id, left(event_type, 1) AS symbol, value, lag(left(event_type, 1)) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT *, symbol <> 'e' AND symbol IS DISTINCT FROM before AS kept FROM s)
    SELECT user_id, coalesce(string_agg(symbol, '' ORDER BY n) FILTER (kept), '') AS text, count(*) FILTER (kept) AS emitted, coalesce(round(avg(value) FILTER (kept), 6), 0.0) AS score FROM e GROUP BY user_id""")
def collapsed_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").withColumn("symbol", F.substring("event_type", 1, 1))
    return recognition.collapsed(steps, ["user_id"], ["ts", "event_id"], "symbol", "value", "e").withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT doc_id, page FROM text_blocks WHERE source IN ('native', 'ocr')")
def source_pages(spark: SparkSession, sf: str) -> DataFrame:
    t = _blocks(spark, sf)
    return t.filter("source = 'native'").select(*layout.PAGE).union(t.filter("source = 'ocr'").select(*layout.PAGE)).distinct()


@query("""WITH c AS (SELECT doc_id, page, source, count(*) AS n FROM text_blocks GROUP BY ALL),
    s AS (SELECT doc_id, page, source AS main_source FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, source) = 1),
    t AS (SELECT doc_id, page, count(*) AS blocks, round(avg(confidence), 6) AS mean_confidence FROM text_blocks GROUP BY ALL)
    SELECT t.*, main_source FROM t JOIN s ON t.doc_id IS NOT DISTINCT FROM s.doc_id AND t.page = s.page""")
def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_summary(_blocks(spark, sf))


@query()
def unique_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return layout.unique_boxes(_blocks(spark, sf), "block_id")


# --- history -----------------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers of the evaluation set as the messages of 50 sessions."""
    t = table(spark, sf, "testset")
    both = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("text"), F.lit(0).alias("o")), F.struct(F.lit("assistant").alias("role"), F.col("reference").alias("text"), F.lit(1).alias("o"))))
    m = t.select((F.col("item_id") % 50).alias("session"), "item_id", both.alias("m"))
    return m.filter("m.text is not null").select("session", (F.col("item_id") * 2 + F.col("m.o")).alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


_MESSAGES = """m AS (SELECT item_id % 50 AS session, item_id * 2 AS turn, 'user' AS role, query AS text FROM testset WHERE query IS NOT NULL
    UNION ALL SELECT item_id % 50, item_id * 2 + 1, 'assistant', reference FROM testset WHERE reference IS NOT NULL)"""


@query(f"WITH {_MESSAGES} SELECT session, turn, role FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 6")
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return memory.last_turns(_messages(spark, sf), 3).select("session", "turn", "role")


@query(f"""WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM m WINDOW w AS (PARTITION BY session ORDER BY turn))
    SELECT session, turn, md5(text) AS question_md5, md5(t) AS answer_md5 FROM n WHERE role = 'user' AND r = 'assistant'""")
def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return memory.pairs(_messages(spark, sf)).select("session", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(rf"""WITH {_MESSAGES}, u AS (SELECT session, turn, regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM m WHERE role = 'user'),
    l AS (SELECT * FROM u WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 4)
    SELECT session, left(string_agg('用户: ' || left(t, 120), chr(10) ORDER BY turn), 300) AS history FROM l GROUP BY session""")
def rewriting_history(spark: SparkSession, sf: str) -> DataFrame:
    return memory.rewriting_history(_messages(spark, sf))


@query(f"""WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM m WINDOW w AS (PARTITION BY session ORDER BY turn)),
    p AS (SELECT session, turn, text, a FROM n WHERE role = 'user' AND r = 'assistant' QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS i FROM p)
    SELECT session AS query_id, string_agg('[记忆' || i || '] 历史问题：' || CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END || chr(10) || '[记忆' || i || '] 历史回答：' || CASE WHEN length(a) > 180 THEN left(a, 180) || '...' ELSE a END,
      chr(10) || chr(10) ORDER BY i) AS context FROM k GROUP BY session""")
def memory_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last two turns of every session as context."""
    m = _messages(spark, sf)
    w = Window.partitionBy("session").orderBy(F.col("turn").desc())
    last = memory.pairs(m).select("session", F.col("turn").alias("key"), F.row_number().over(w).alias("rank")).filter("rank <= 2")
    return memory.recalled_context(last.withColumn("query_id", F.col("session")), m)


@query()
def memory_recall(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "retrieval_gt").select("query_id", (F.col("query_id") % 50).alias("session"), "query")
    return memory.recall(asked, _messages(spark, sf))


# --- evaluation --------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Hits of the questions, and as truth the chunks of the file of each first hit."""
    hits = _hits(spark, sf).join(_chunks(spark, sf).select("key", "chunk_id", F.col("file_name").alias("source")), "key")
    files = hits.filter("rank = 1").select("query_id", "source")
    chunks = table(spark, sf, "all_documents").select(F.col("file_name").alias("source"), "chunk_id").filter("chunk_id is not null")
    truth = files.join(chunks, "source").groupBy("query_id").agg(F.collect_set("chunk_id").alias("gt"))
    return hits, truth


_JUDGE = """hs AS (SELECT h.*, chunk_id, file_name AS source FROM h JOIN all_documents ON row_id = key),
    g AS (SELECT DISTINCT query_id, a.chunk_id FROM hs JOIN all_documents a ON a.file_name = hs.source WHERE rank = 1 AND a.chunk_id IS NOT NULL),
    n AS (SELECT query_id, count(*) AS gt FROM g GROUP BY ALL),
    x AS (SELECT n.query_id, gt, count(hs.chunk_id) AS retrieved, count(g.chunk_id) AS in_gt, count(DISTINCT g.chunk_id) AS hit
      FROM n LEFT JOIN hs USING (query_id) LEFT JOIN g ON g.query_id = n.query_id AND g.chunk_id = hs.chunk_id GROUP BY ALL),
    metric AS (SELECT query_id, retrieved, hit, round(hit::DOUBLE / gt, 6) AS recall, round(in_gt::DOUBLE / retrieved, 6) AS precision, round(1 - in_gt::DOUBLE / retrieved, 6) AS noise FROM x)"""
_JUDGED = f"{_HITS}, {_JUDGE}"


@query(f"WITH {_JUDGED} SELECT * FROM metric")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.retrieval_metrics(*_judged(spark, sf))


@query(f"WITH {_EVERY_HITS}, {_JUDGE} SELECT count(*) AS queries, coalesce(round(avg(recall), 4), 0.0) AS avg_recall, coalesce(round(avg(precision), 4), 0.0) AS avg_precision, coalesce(round(avg(noise), 4), 0.0) AS avg_noise FROM metric")
def retrieval_metrics_avg(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf).select("key", "chunk_id", F.col("file_name").alias("source"))
    every = table(spark, sf, "all_documents").select("chunk_id", F.col("file_name").alias("source"))
    # Written, since first hits and all hits are read apart.
    hits = cut(_every_hits(spark, sf).join(chunks, "key").select("query_id", "rank", "chunk_id", "source"), "judged")
    return evaluation.averages(evaluation.metrics_by_source(hits, every))


@query(f"""WITH {_JUDGED}, best AS (SELECT query_id, key AS positive, source AS s FROM hs WHERE rank = 1 AND score >= 0.15)
    SELECT query_id, positive, arg_min(key, rank) AS negative FROM hs JOIN best USING (query_id) WHERE source <> s AND query_id IN (SELECT query_id FROM hs GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL""")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.hard_negatives(_judged(spark, sf)[0])


@query(f"WITH {_JUDGED} SELECT query_id, array_to_string(list(chunk_id ORDER BY rank), '|') AS gt FROM (SELECT query_id, chunk_id, min(rank) AS rank FROM hs WHERE score > 30 GROUP BY ALL) GROUP BY query_id")
def gt_auto_label(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.auto_labels(_judged(spark, sf)[0], 30.0).select("query_id", F.array_join("gt", "|").alias("gt"))


_GIVEN = "SELECT query_id, query FROM retrieval_gt WHERE query_id % 100 = 0"


@query(f"""WITH {_hits_sql(_GIVEN)}, hs AS (SELECT query_id, chunk_id FROM h JOIN all_documents ON row_id = key),
    g AS (SELECT query_id, list_distinct(coalesce(gt, [])) AS gt FROM retrieval_gt WHERE query_id % 100 = 0),
    x AS (SELECT g.query_id, gt, list(chunk_id) FILTER (chunk_id IS NOT NULL) AS ids FROM g LEFT JOIN hs USING (query_id) GROUP BY ALL),
    y AS (SELECT query_id, len(gt) AS wanted, coalesce(len(ids), 0) AS retrieved, coalesce(len(list_filter(ids, lambda i: list_contains(gt, i))), 0) AS in_gt, coalesce(len(list_distinct(list_filter(ids, lambda i: list_contains(gt, i)))), 0) AS hit FROM x)
    SELECT query_id, retrieved, hit, CASE WHEN wanted > 0 THEN round(hit::DOUBLE / wanted, 6) ELSE 0.0 END AS recall, CASE WHEN retrieved > 0 THEN round(in_gt::DOUBLE / retrieved, 6) ELSE 0.0 END AS precision,
      CASE WHEN retrieved > 0 THEN round(1 - in_gt::DOUBLE / retrieved, 6) ELSE 0.0 END AS noise FROM y""")
def given_truth_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the questions with a given truth, judged by it."""
    t = table(spark, sf, "retrieval_gt").filter("query_id % 100 = 0")
    hits = bm25.search(t.select("query_id", "query"), _chunks(spark, sf), "key", "text").join(_chunks(spark, sf).select("key", "chunk_id"), "key")
    return evaluation.retrieval_metrics(hits, t.select("query_id", "gt"))


@query("""WITH u AS (SELECT * FROM reranker_triplets WHERE trim(coalesce(query, '')) <> '' AND trim(coalesce(positive_doc, '')) <> '' AND trim(coalesce(negative_doc, '')) <> '')
    SELECT triplet_id, query, positive_doc AS passage, 1 AS label FROM u UNION ALL SELECT triplet_id, query, negative_doc, 0 FROM u""")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.training_pairs(table(spark, sf, "reranker_triplets"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval over the chunk store."""
    return hybrid_rrf(spark, sf)
