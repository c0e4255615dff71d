"""Lines repeated across the rows of one source.

Each row's text is split at newlines. Two lines are the same if their keys
agree: the letters of the line in consistent character form, lower case,
without tags and character entities. Lines without letters have no key.

A line is tested within its source against all rows outside by the
log-likelihood ratio, with the Benjamini-Hochberg step-up over all lines that
reach the least support. Of the significant lines, those that stand in the given
share of their source's rows are removed. All rows with text count as outside, those
of sources with few rows and those without a source included. A notice that the
rows outside carry as well, in that share, is in excess nowhere: it stays, or, if
wanted, goes by its share alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.textform import BLANKS, INVISIBLE, QUICK_CHECK, canonical
from siltstone.runtime import cut

#: A row with a character outside this class has text.
NOT_BLANK = f"[^\\s{BLANKS}{INVISIBLE}]"
#: Tags, comments and character entities.
TAG = "<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#\\d{1,6}|#x[0-9a-fA-F]{1,6});"
#: Steps of the statistic for the false-discovery control, and the greatest told apart.
STEP, TOP = 0.1, 1000.0
#: Rows outside can be tested against if a line in the least share, which none of them holds, reaches this statistic (p 0.001).
ENOUGH = 10.83
_LN_SQRT_PI = 0.5723649429247001


_TAG = re.compile(TAG.replace("[^<>]", "[^<>\\n]"))
_QUICK = re.compile(QUICK_CHECK)
_ONE_LINE = str.maketrans("\r\u000b\u000c\u0085\u2028\u2029", "      ")  # only \n parts lines
_LOWER: np.ndarray | None = None


def _lower_letters() -> np.ndarray:
    """For each code of the basic plane its lower-case letter, 0 for all that is no letter."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.zeros(0x10000, np.uint32)
        for code in range(0x10000):
            ch = chr(code)
            if ch.isalpha():
                low = ch.lower()
                _LOWER[code] = ord(low) if len(low) == 1 else code
    return _LOWER


def prepared(text: str) -> str:
    """text in consistent form without tags and entities; its lines keep their places."""
    if _QUICK.search(text):
        text = canonical(text.translate(_ONE_LINE))
    return _TAG.sub("", text) if "<" in text or "&" in text else text


#: Letters hashed together; bounds the memory of a batch of long texts.
HASHED = 1_000_000


def line_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lines): a 64-bit key for every line of all prepared texts, 0 for a line without letters, and the lines of each text.

    The key is a sum over the letters, each mixed with its place in the line;
    the lines of many texts are hashed together.
    """
    upto = np.cumsum([len(t) for t in texts], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(upto // HASHED)) + 1
    parts = [_line_keys(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if b > a]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _line_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _lower_letters()
    letters = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], codes)
    line = np.cumsum(codes == 10)
    at = np.flatnonzero(letters)
    letters, line_of = letters[at].astype(np.uint64), line[at]
    keys = np.zeros(int(line[-1]) + 1 if len(line) else 1, np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        x = (letters << np.uint64(32)) + place.astype(np.uint64)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        keys[line_of[first]] = np.maximum(np.add.reduceat(x ^ (x >> np.uint64(33)), first), np.uint64(1))
    lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    return keys.view(np.int64), lines


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lines = line_keys([prepared(t) for t in batch.column("_text").to_pylist()])
        offsets = np.concatenate(([0], np.cumsum(lines))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, keys)], ["row_id", "fid", "named", "keys"])


def keyed_rows(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(row_id, fid, named, keys): the key of each line of each row with text, 0 where a line has no letters."""
    rows = df.select(df[key].cast("bigint").alias("row_id"), F.xxhash64(df[source]).alias("fid"), df[source].isNotNull().alias("named"), df[text].alias("_text"))
    return rows.filter(F.col("_text").rlike(NOT_BLANK)).mapInArrow(_keyed, "row_id bigint, fid bigint, named boolean, keys array<bigint>")


def _x_ln(x: Column, expected: Column) -> Column:
    return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))


def log_likelihood(a: Column, n: Column, c: Column, m: Column) -> Column:
    """Signed G2 of a in n rows against c in m rows; negative where the rate outside is higher.

    Without rows outside (m = 0) nothing speaks against the line: TOP.
    """
    a, n, c, m = (x.cast("double") for x in (a, n, c, m))
    rate = (a + c) / (n + m)
    g = 2.0 * (_x_ln(a, n * rate) + _x_ln(n - a, n * (1 - rate)) + _x_ln(c, m * rate) + _x_ln(m - c, m * (1 - rate)))
    g = F.greatest(g, F.lit(0.0))
    return F.when(m <= 0, F.lit(TOP)).otherwise(F.when(a * m >= c * n, g).otherwise(-g))


def _ln_p(g: Column) -> Column:
    """ln of the one-sided p of a statistic g >= 0 with one degree of freedom.

    Asymptotic bound of the normal tail, within 0.7 for all g; exact enough for
    a step-up over steps of the statistic, and never below the true value.
    """
    z2 = g / 2.0
    return F.least(F.lit(-0.6931471805599453), -z2 - F.log(F.sqrt(z2) + F.sqrt(z2 + 4 / 3.141592653589793)) - F.lit(_LN_SQRT_PI) + F.lit(0.6931471805599453))


def tested_lines(keyed: DataFrame, share: float = 0.2, least: int = 5, fdr: float = 0.01, common: bool = True) -> DataFrame:
    """(fid, k, a, n, g, significant): the lines k of each source with at least `least` rows, and what the test says of them.

    keyed: as from keyed_rows. a of the source's n rows hold the line; g is the
    signed log-likelihood ratio against all rows outside, whether their source
    has few rows or none is named; significant is whether g holds at
    false-discovery rate `fdr` among all lines tested. Lines in `share` of their
    source's rows have g at TOP where the rows outside are too few to test
    against (ENOUGH), and, with `common`, where `share` of the rows outside hold
    the line too; without `common`, such a line is no excess.
    """
    totals = cut(keyed.groupBy("named", "fid").agg(F.count("*").alias("n")), "sources")
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"))
    # Both uses of the pairs need fid and k, so that they are filtered alike and share one shuffle.
    pairs = (
        keyed.select("fid", F.explode(F.array_distinct("keys")).alias("k"))
        .filter("fid is not null and k <> 0")
        .groupBy("fid", "k")
        .agg(F.count("*").alias("a"))
    )
    sizes = totals.filter(F.col("named") & (F.col("n") >= least)).select("fid", "n")
    family = pairs.filter(F.col("a") >= least).join(sizes, "fid")
    everywhere = pairs.join(family.select("k").distinct(), "k").groupBy("k").agg(F.sum("a").alias("a_all"))
    tested = family.join(everywhere, "k").crossJoin(F.broadcast(whole))  # one row
    a, n = F.col("a"), F.col("n")
    out, rows = F.col("a_all") - a, F.col("all_rows") - n
    shared = out >= share * rows
    weakest = F.greatest(F.ceil(share * n), F.lit(least))
    few = log_likelihood(weakest, n, F.lit(0), rows) < ENOUGH
    untested = (a >= share * n) & ((shared | few) if common else (few & ~shared))
    tested = tested.select("fid", "k", "a", "n", F.when(untested, F.lit(TOP)).otherwise(log_likelihood(a, n, out, rows)).alias("g"))
    tested = tested.withColumn("step", F.floor(F.least(F.col("g"), F.lit(TOP)) / STEP))
    # Step-up on a histogram of the statistic: at most TOP / STEP rows, whatever the data.
    steps = tested.groupBy("step").agg(F.count("*").alias("c"))
    down = Window.orderBy(F.col("step").desc())
    steps = steps.withColumn("rank", F.sum("c").over(down)).withColumn("m", F.sum("c").over(Window.partitionBy(F.lit(0))))
    bound = steps.filter((F.col("step") >= 0) & (_ln_p(F.col("step") * STEP) <= F.log(F.col("rank") * fdr / F.col("m")))).agg(F.min("step").alias("bound"))
    return tested.crossJoin(F.broadcast(bound)).select("fid", "k", "a", "n", "g", F.coalesce(F.col("step") >= F.col("bound"), F.lit(False)).alias("significant"))


def excess_lines(keyed: DataFrame, share: float = 0.2, least: int = 5, fdr: float = 0.01, common: bool = True) -> DataFrame:
    """(fid, keys): the significant lines of each source that stand in `share` of its rows."""
    kept = tested_lines(keyed, share, least, fdr, common).filter(F.col("significant") & (F.col("a") >= share * F.col("n")))
    return kept.groupBy("fid").agg(F.collect_list("k").alias("excess"))


def _marked(keyed: DataFrame, excess: DataFrame) -> DataFrame:
    """(row_id, lines): positions of the lines to remove, only for rows that have some.

    One row for each source on the right: broadcast while it is small, else a
    sort-merge join in which adaptive execution splits the hot sources.
    """
    hit = keyed.filter("named").join(excess, "fid")
    at = F.filter(F.transform("keys", lambda k, i: F.when(F.array_contains(F.col("excess"), k), i + 1)), F.isnotnull)
    return hit.select("row_id", at.alias("lines")).filter(F.size("lines") > 0)


def repeated_lines(df: DataFrame, key: str, source: str, text: str, share: float = 0.2, least: int = 5, fdr: float = 0.01, common: bool = True) -> DataFrame:
    """(row_id, line_no): every line to remove, by its 1-based position after splitting at newlines.

    Rows with null or blank text don't count; rows without a source lose nothing; repeated rows count like any other; `key` is
    taken to be unique. An empty table gives an empty result. Columns other than
    the three named are ignored, whatever their names.
    """
    keyed = cut(keyed_rows(df, key, source, text), "lines")
    return _marked(keyed, excess_lines(keyed, share, least, fdr, common)).select("row_id", F.explode("lines").alias("line_no")).withColumn("line_no", F.col("line_no").cast("long"))


def without_repeated_lines(df: DataFrame, key: str, source: str, text: str, out: str = "clean_text", **rule: float) -> DataFrame:
    """df with the column `out`: the text without its repeated lines, the rest in its order.

    Null stays null; a text all of whose lines go becomes empty.
    """
    keyed = cut(keyed_rows(df, key, source, text), "lines")
    marked = _marked(keyed, excess_lines(keyed, **rule)).select(F.col("row_id").alias("_row"), F.col("lines").alias("_lines"))
    joined = df.join(marked, df[key] == marked["_row"], "left")
    kept = F.filter(F.split(df[text], "\n", -1), lambda _, i: ~F.array_contains(F.col("_lines"), i + 1))
    return joined.withColumn(out, F.when(F.col("_lines").isNull(), df[text]).otherwise(F.array_join(kept, "\n"))).drop("_row", "_lines")
