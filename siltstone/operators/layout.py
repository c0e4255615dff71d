"""Layout blocks of pages: overlap joins, reading order, paragraphs, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import chunking, text
from siltstone.functions.similarity import char_jaccard, iou
from siltstone.functions.text import is_page_number
from siltstone.operators.tools import ordered_text

PAGE = ("doc_id", "page")
BOX = ("x0", "y0", "x1", "y1")


def is_head_or_foot(height: float = 840.0, share: float = 0.06):
    """Blank, in the margin above or below, or a page number."""
    t = F.col("text")
    return (F.trim(F.coalesce(t, F.lit(""))) == "") | (F.col("y1") <= height * share) | (F.col("y0") >= height * (1 - share)) | is_page_number(t)


def outside_tables(blocks: DataFrame, tables: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Blocks that touch no table box of their page, each box widened by the tolerance.

    Both sides are partitioned by page, which bounds what meets.
    """
    b, t = blocks.alias("b"), tables.select(*PAGE, *BOX).alias("t")
    s = 2 * tolerance
    meets = (F.col("b.x1") + s >= F.col("t.x0")) & (F.col("t.x1") + s >= F.col("b.x0")) & (F.col("b.y1") + s >= F.col("t.y0")) & (F.col("t.y1") + s >= F.col("b.y0"))
    same = F.col("b.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page"))
    return b.join(t, same & meets, "left_anti")


def fuse_sources(native: DataFrame, ocr: DataFrame, key: str, overlap: float = 0.5, alike: float = 0.8, confidence: float = 0.6) -> DataFrame:
    """All native blocks, and the trusted recognised ones that repeat none of them.

    A recognised block repeats a native one of its page if their boxes overlap
    by more than `overlap` and their characters by more than `alike`.
    """
    o, n = ocr.alias("o"), native.alias("n")
    same = (F.col("o.doc_id") == F.col("n.doc_id")) & (F.col("o.page") == F.col("n.page"))
    repeats = same & (iou("o", "n") > overlap) & (char_jaccard(F.col("o.text"), F.col("n.text")) > alike)
    fresh = o.join(n, repeats, "left_anti").filter(F.col("confidence") > confidence)
    return native.unionByName(fresh)


def columns(blocks: DataFrame, key: str, by_column: bool = True, least: int = 3) -> DataFrame:
    """blocks with `zone` (cross, left, right), `two_columns` and `reading_order` on each page."""
    page = Window.partitionBy(*PAGE)
    width = F.max("x1").over(page) + 1
    out = blocks.withColumn("_w", width)
    cross = ((F.col("x0") < F.col("_w") / 2) & (F.col("x1") > F.col("_w") / 2)) | ((F.col("x1") - F.col("x0")) > 0.7 * F.col("_w"))
    out = out.withColumn("zone", F.when(cross, "cross").when((F.col("x0") + F.col("x1")) / 2 <= F.col("_w") / 2, "left").otherwise("right"))
    count = lambda z: F.sum((F.col("zone") == z).cast("int")).over(page)
    out = out.withColumn("two_columns", (count("left") >= least) & (count("right") >= least))
    place = F.when(F.col("two_columns") & F.lit(by_column), F.when(F.col("zone") == "cross", 0).when(F.col("zone") == "left", 1).otherwise(2)).otherwise(0)
    order = Window.partitionBy(*PAGE).orderBy("_place", "y0", "x0", key)
    return out.withColumn("_place", place).withColumn("reading_order", F.row_number().over(order)).drop("_w", "_place")


def _by_page(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_dict("records"):
            if held and (row["doc_id"], row["page"]) != (held[0]["doc_id"], held[0]["page"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _folded(rows: DataFrame, order: list[str], schema: str, fold) -> DataFrame:
    """Each page's rows, in order, through a fold that gives a row for each or for each group; pages are sorted in their partition and streamed one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for page in _by_page(batches):
            yield pd.DataFrame(list(fold(page)), columns=names)

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInPandas(run, schema)


def paragraphs(blocks: DataFrame, key: str, gap: float = 12.0, shift: float = 40.0) -> DataFrame:
    """(doc_id, page, block_id, paragraph): neighbours in reading order merge while the growing box is near, above and aligned.

    On pages with two columns, blocks across both come first, then the left and
    the right column. The box of a paragraph grows with each block, so this is a
    fold over the page and not a comparison of neighbours.
    """

    def fold(page: list[dict]) -> Iterator[tuple]:
        n, left, bottom = 0, 0.0, 0.0
        for b in page:
            near = n > 0 and abs(b["x0"] - left) < shift and b["y0"] - bottom <= gap
            n += not near
            left, bottom = (min(left, b["x0"]), max(bottom, b["y1"])) if near else (b["x0"], b["y1"])
            yield b["doc_id"], b["page"], b["block_id"], n

    rows = columns(blocks, key).select("doc_id", "page", F.col(key).alias("block_id"), *BOX, "reading_order")
    return _folded(rows, ["reading_order"], "doc_id string, page int, block_id bigint, paragraph int", fold)


def lines(words: DataFrame, key: str, step: float = 5.0) -> DataFrame:
    """(doc_id, page, block_id, line): words within `step` of the first word of the line, which never moves."""

    def fold(page: list[dict]) -> Iterator[tuple]:
        n, anchor = 0, 0.0
        for b in page:
            if not n or abs(b["y0"] - anchor) >= step:
                n, anchor = n + 1, b["y0"]
            yield b["doc_id"], b["page"], b["block_id"], n

    rows = words.select("doc_id", "page", F.col(key).alias("block_id"), *BOX)
    return _folded(rows, ["y0", "x0", "block_id"], "doc_id string, page int, block_id bigint, line int", fold)


def line_blocks(words: DataFrame, key: str, step: float = 5.0, height: float = 840.0) -> DataFrame:
    """(doc_id, page, line, text, x0, y0, x1, y1, block_type, source, confidence): words put together to lines, as native blocks."""
    numbered = lines(words, key, step).join(words.select(F.col(key).alias("block_id"), "text", *BOX), "block_id")
    order = F.struct("y0", "x0", "block_id")
    made = numbered.groupBy(*PAGE, "line").agg(text.stripped(ordered_text(F.coalesce("text", F.lit("")), order, " ")).alias("text"), F.min("x0").alias("x0"), F.min_by("y0", order).alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    made = made.filter("text <> ''").withColumn("block_type", text.block_type(F.col("text"), F.col("y0"), height))
    return made.withColumn("source", F.lit("native")).withColumn("confidence", F.lit(1.0))


def recognised_lines(words: DataFrame, key: str, step: float = 10.0, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(doc_id, page, line, words, text, x0, y0, x1, y1, confidence): recognised words, in the order in which they came, as lines.

    words: text, box, confidence from 0 to 100. A word joins the line while its
    top is within `step` of the line's highest top. Words without text or with a
    negative confidence are left out; a line has its words' mean, from 0 to 1.
    """

    def fold(page: list[dict]) -> Iterator[tuple]:
        line: list[dict] = []
        top, n = 0.0, 0
        for b in [*page, None]:
            if line and (b is None or abs(b["y0"] - top) >= step):
                n += 1
                yield page[0]["doc_id"], page[0]["page"], n, len(line), " ".join(x["text"] for x in line), min(x["x0"] for x in line), top, max(x["x1"] for x in line), max(x["y1"] for x in line), sum(x["confidence"] for x in line) / len(line) / 100.0
                line = []
            if b is not None:
                top = min(top, b["y0"]) if line else b["y0"]
                line.append(b)

    sx, sy = map(F.lit, scale)
    kept = words.withColumn("text", text.stripped("text")).filter("text <> '' and confidence >= 0")
    rows = kept.select("doc_id", "page", F.col(key).alias("block_id"), "text", (F.col("x0") * sx).alias("x0"), (F.col("y0") * sy).alias("y0"), (F.col("x1") * sx).alias("x1"), (F.col("y1") * sy).alias("y1"), "confidence")
    return _folded(rows, ["block_id"], "doc_id string, page int, line int, words int, text string, x0 double, y0 double, x1 double, y1 double, confidence double", fold)


def tab_rows(blocks: DataFrame, key: str, step: float = 5.0) -> DataFrame:
    """(doc_id, page, row, text): blocks whose middles are within `step` of the row's first, from left to right with tabs between them."""

    def fold(page: list[dict]) -> Iterator[tuple]:
        row: list[dict] = []
        n = 0
        for b in [*page, None]:
            if row and (b is None or abs(b["middle"] - row[0]["middle"]) >= step):
                n += 1
                yield page[0]["doc_id"], page[0]["page"], n, "\t".join(x["text"] for x in sorted(row, key=lambda x: (x["x0"], x["block_id"])))
                row = []
            if b is not None:
                row.append(b)

    rows = blocks.withColumn("text", text.stripped("text")).filter("text <> ''")
    rows = rows.select("doc_id", "page", F.col(key).alias("block_id"), "text", "x0", ((F.col("y0") + F.col("y1")) / 2).alias("middle"))
    return _folded(rows, ["middle", "block_id"], "doc_id string, page int, row int, text string", fold)


def glossary_rows(rows: DataFrame, mark: str = "指") -> DataFrame:
    """rows of tab_rows with `in_table` and `markdown`: a row with a tab and the mark is one of a table of two columns, whose first row carries the head."""
    page = Window.partitionBy(*PAGE).orderBy("row")
    inside = F.contains("text", F.lit("\t")) & F.contains("text", F.lit(mark))
    cells = F.concat(F.lit("| "), text.stripped(F.substring_index("text", "\t", 1)), F.lit(" | "), text.stripped(F.regexp_replace("text", "^[^\t]*\t", "")), F.lit(" |"))
    head = F.when(F.coalesce(F.lag("in_table").over(page), F.lit(False)), "").otherwise("| 术语 | 释义 |\n|------|------|\n")
    return rows.withColumn("in_table", inside).withColumn("markdown", F.when(F.col("in_table"), F.concat(head, cells)).otherwise(F.col("text")))


def reading_lines(blocks: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """(doc_id, page, block_id, line, place): boxes from top to bottom, each into the first line whose first box is level with it.

    Level: the middles differ by at most `ratio` of the smaller height, heights
    counting 1 at least. `place` counts the page's boxes line by line, from left to right.
    """

    def fold(page: list[dict]) -> Iterator[tuple]:
        found: list[list[dict]] = []
        for b in page:
            b["h"], b["middle"] = max(1.0, b["y1"] - b["y0"]), (b["y0"] + b["y1"]) / 2.0
            home = next((x for x in found if abs(b["middle"] - x[0]["middle"]) <= min(b["h"], x[0]["h"]) * ratio), None)
            if home is None:
                found.append([b])
            else:
                home.append(b)
        ordered = ((n, b) for n, own in enumerate(found, 1) for b in sorted(own, key=lambda x: x["x0"]))
        for place, (n, b) in enumerate(ordered, 1):
            yield b["doc_id"], b["page"], b["block_id"], n, place

    rows = blocks.select("doc_id", "page", F.col(key).alias("block_id"), *BOX)
    return _folded(rows, ["y0", "x0", "block_id"], "doc_id string, page int, block_id bigint, line int, place int", fold)


def bucket_order(blocks: DataFrame, key: str, height: float = 10.0) -> DataFrame:
    """blocks with `place`: by the tops in steps of `height`, halves to the even step, then from left to right."""
    order = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y0") / height), "x0", key)
    return blocks.withColumn("place", F.row_number().over(order))


def fused_order(blocks: DataFrame, key: str) -> DataFrame:
    """blocks with `many_columns` and `place`: the order in which fused pages are read.

    A page has several columns if it has five blocks of text at least, and more
    than two of them lie left of 0.8 and right of 1.2 times the middle one's
    centre. Then the blocks left of the page's middle centre come first.
    """
    page = Window.partitionBy(*PAGE)
    out = blocks.withColumn("_c", (F.col("x0") + F.col("x1")) / 2).withColumn("_t", F.coalesce(F.col("block_type") == "text", F.lit(False)))
    # The upper median by its place in the order, without gathering a page's centres.
    out = out.withColumn("_i", F.row_number().over(page.orderBy("_c"))).withColumn("_j", F.row_number().over(Window.partitionBy(*PAGE, "_t").orderBy("_c")))
    out = out.withColumn("_n", F.count("*").over(page)).withColumn("_m", F.sum(F.col("_t").cast("int")).over(page))
    out = out.withColumn("_all", F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col("_c"))).over(page))
    out = out.withColumn("_own", F.max(F.when(F.col("_t") & (F.col("_j") == F.floor(F.col("_m") / 2) + 1), F.col("_c"))).over(page))
    beside = lambda x: F.sum((F.col("_t") & x).cast("int")).over(page) > 2
    many = (F.col("_m") >= 5) & beside(F.col("_c") < F.col("_own") * 0.8) & beside(F.col("_c") > F.col("_own") * 1.2)
    out = out.withColumn("many_columns", F.coalesce(many, F.lit(False)))
    right = F.col("many_columns") & (F.col("_c") >= F.col("_all"))
    return out.withColumn("_r", right).withColumn("place", F.row_number().over(page.orderBy("_r", "y0", "x0", key))).drop(*[f"_{x}" for x in ("c", "t", "i", "j", "n", "m", "all", "own", "r")])


def page_elements(blocks: DataFrame, key: str) -> DataFrame:
    """(doc_id, page, place, kind, y, content): paragraphs of text and tables of each page by their tops."""
    body = blocks.withColumn("text", text.clean(F.col("text"))).filter("text <> ''")
    tables = body.filter("block_type = 'table'")
    words = outside_tables(body.filter("coalesce(block_type, '') <> 'table'"), tables)
    placed = paragraphs(words, key).join(columns(words, key).select(F.col(key).alias("block_id"), "reading_order", "y0", "text"), "block_id")
    merged = placed.groupBy(*PAGE, "paragraph").agg(F.min("y0").alias("y"), ordered_text(F.col("text"), F.col("reading_order"), "\n").alias("content"), F.min("reading_order").alias("_at"))
    both = merged.select(*PAGE, F.lit("text").alias("kind"), "y", "content", "_at").unionByName(tables.select(*PAGE, F.lit("table").alias("kind"), F.col("y0").alias("y"), F.col("text").alias("content"), F.col(key).alias("_at")))
    place = Window.partitionBy(*PAGE).orderBy("y", F.when(F.col("kind") == "text", 0).otherwise(1), "_at")
    return both.withColumn("place", F.row_number().over(place)).drop("_at")


def element_markdown(elements: DataFrame) -> DataFrame:
    """(doc_id, page, markdown): the elements of each page, empty lines around tables and between texts."""
    w = Window.partitionBy(*PAGE).orderBy("place")
    gap = F.when(F.col("place") == 1, "").otherwise("\n\n")
    pieces = elements.withColumn("_p", F.concat(gap, text.clean(F.col("content")))).withColumn("_n", F.row_number().over(w))
    return pieces.groupBy(*PAGE).agg(text.stripped(ordered_text(F.col("_p"), F.col("_n"), "")).alias("markdown"))


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, text, x0, y0, x1, y1, font, font_size, is_bold, is_italic, span_count): native spans put together to lines.

    spans: doc_id, page, block, line, span, text, box, font, size, flags. Spans
    without text are left out of all but the count; the font is the most frequent, the first in the alphabet of equals.
    """
    line = ["doc_id", "page", "block", "line"]
    rows = spans.withColumn("text", text.stripped("text"))
    counts = rows.groupBy(*line).agg(F.count("*").alias("span_count"))
    kept = rows.filter("text <> ''").withColumn("b", text.is_bold(F.col("flags"), F.col("font"))).withColumn("i", text.is_italic(F.col("flags"), F.col("font")))
    fonts = kept.groupBy(*line, "font").agg(F.count("*").alias("n")).groupBy(*line).agg(F.min_by("font", F.struct(-F.col("n"), "font")).alias("font"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"])
    made = kept.groupBy(*line).agg(text.joined_spans(texts).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("size").alias("font_size"), F.bool_or("b").alias("is_bold"), F.bool_or("i").alias("is_italic"))
    return made.join(fonts, line).join(counts, line).select(*line, "text", *BOX, "font", "font_size", "is_bold", "is_italic", "span_count")


def spans_as_blocks(spans: DataFrame) -> DataFrame:
    """Each native span with text as a block of its own."""
    kept = spans.withColumn("text", text.stripped("text")).filter("text <> ''")
    return kept.select("doc_id", "page", "block", "line", "span", "text", *BOX, "font", F.col("size").alias("font_size"), text.is_bold(F.col("flags"), F.col("font")).alias("is_bold"), text.is_italic(F.col("flags"), F.col("font")).alias("is_italic"))


def native_blocks(spans: DataFrame, merge: bool = True) -> DataFrame:
    """Blocks of native text, by line or, without merging, by span."""
    return spans_to_lines(spans) if merge else spans_as_blocks(spans)


def unique_boxes(blocks: DataFrame, key: str, overlap: float = 0.8) -> DataFrame:
    """(block_id): greedy choice, page by page: a box stays unless one kept before overlaps it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in _by_page(batches):
            kept: list[dict] = []
            for b in page:
                if all(_iou(b, k) <= overlap for k in kept):
                    kept.append(b)
            yield pd.DataFrame({"block_id": [k["block_id"] for k in kept]})

    rows = blocks.select("doc_id", "page", F.col(key).alias("block_id"), *BOX)
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "block_id").mapInPandas(run, "block_id bigint")


def _iou(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    h = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
    return w * h / area if area > 0 else 0.0


def page_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(doc_id, page, markdown): each page under its heading, its blocks in the fused order, styled by type.

    Pages after a document's first begin with a ruler, so that a document is its
    pages in order with line breaks between them; it is never gathered whole.
    """
    kind, plain = F.col("block_type"), text.one_line(F.col("text"))
    styled = (
        F.when(kind == "title", F.concat(F.lit("\n### "), plain, F.lit("\n")))
        .when(kind == "table", F.concat(F.lit("\n"), F.col("text"), F.lit("\n")))
        .when(kind.isin("header", "footer"), F.concat(F.lit("\n*"), plain, F.lit("*\n")))
        .otherwise(plain)
    )
    ordered = fused_order(blocks.filter("text is not null"), key)
    pages = ordered.groupBy(*PAGE).agg(ordered_text(styled, F.col("place"), "\n").alias("body"))
    first = F.min("page").over(Window.partitionBy("doc_id"))
    ruler = F.when(F.col("page") == F.col("first"), "").otherwise("\n---\n\n")
    return pages.withColumn("first", first).select(*PAGE, F.concat(ruler, F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.col("body")).alias("markdown"))


def block_json(blocks: DataFrame, key: str) -> DataFrame:
    """(doc_id, block_id, total_blocks, json): every block as a JSON object, with the number of its document's blocks."""
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"))
    own = F.to_json(F.struct("text", "page", F.array(*BOX).alias("bbox"), "block_type", "source", "confidence"), {"ignoreNullFields": "false"})
    rows = blocks.select("doc_id", F.col(key).alias("block_id"), own.alias("json"))
    return rows.join(total, rows["doc_id"].eqNullSafe(total["doc_id"])).select(rows["doc_id"], "block_id", "total_blocks", "json")


def block_chunks(blocks: DataFrame, key: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(block_id, n, chunk): the clean text of every block that is no head or foot, in fixed windows if it is longer than `size`."""
    kept = blocks.filter("text is not null and coalesce(block_type, '') not in ('header', 'footer')")
    return kept.select(F.col(key).alias("block_id"), F.posexplode(chunking.windows(text.one_line(F.col("text")), size, overlap)).alias("n", "chunk"))


def render(blocks: DataFrame, key: str, output: str = "chunks") -> DataFrame:
    """Blocks as `markdown` by page, `json` by block, or `chunks`."""
    if output == "markdown":
        return page_markdown(blocks, key)
    if output == "json":
        return block_json(blocks, key)
    if output == "chunks":
        return block_chunks(blocks, key)
    raise ValueError(f"unknown output {output!r}")


def page_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks, mean_confidence, main_source): aggregates of a page; the smaller of equally common sources."""
    counts = blocks.groupBy(*PAGE, "source").agg(F.count("*").alias("c"), F.sum("confidence").alias("s"), F.count("confidence").alias("n"))
    main = F.min(F.struct((-F.col("c")).alias("c"), "source"))["source"]
    return counts.groupBy(*PAGE).agg(F.sum("c").alias("blocks"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_confidence"), main.alias("main_source"))
