"""Groups of rows whose texts share most of their content.

Similarity is the Jaccard coefficient of the sets of runs of `SHINGLE` letters
or digits. Candidates come from a MinHash LSH forest: TREES tries over prefixes
of the signature, held as sorted keys. Every two rows that share a prefix of
the depth at which the target recall is reached at the threshold are compared:
within a task up to BLOCK rows of a prefix, and beyond that block against block
in tasks of their own. A sketch of two bits for each hash thins the candidates
where they meet, and two bits more, joined to the pairs that are left, thin them
again before their texts are compared exactly; what both lose is part of the
recall. Equal texts are folded into one before, and groups are the connected
components of the verified links.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.repeated_lines import excess_lines, keyed_rows, line_keys, prepared
from siltstone.runtime import cut, done_with, small

SHINGLE = 5
#: Hash functions, tries, and hashes that one trie's full key holds.
HASHES, TREES, DEPTH = 120, 20, 6
#: Rows of one prefix that a task compares by itself; longer runs are spread over tasks in blocks of as many.
BLOCK = 1 << 15
#: Rows of a run from which on each is compared with all that follow at once.
LONG = 64
#: 64-bit words that hold one bit of every hash; a sketch has two such planes, and the finer one four.
PLANE = -(-HASHES // 64)
WORDS = 2 * PLANE
#: Share of the pairs at the threshold that each sketch may lose, and its normal quantile.
LOSS, QUANTILE = 0.01, 2.33
_RNG = np.random.RandomState(20240229)
_MULTIPLY = _RNG.randint(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.randint(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_PLACES = _RNG.randint(0, 2**63, SHINGLE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def depth_for(threshold: float, recall: float, trees: int = TREES) -> int:
    """The longest prefix with which `trees` tries and both sketches find a pair at the threshold with the target recall."""
    need = 1.0 - max(0.0, 1.0 - recall / (1.0 - 2 * LOSS)) ** (1.0 / trees)
    return max(1, min(DEPTH, int(math.log(need) / math.log(threshold))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shingles(text: str) -> np.ndarray:
    """A 64-bit hash for each run of SHINGLE characters, repeats included."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes) - SHINGLE + 1
    total = codes[:n] * _PLACES[0]
    for i in range(1, SHINGLE):
        total = total + codes[i : i + n] * _PLACES[i]
    return _mix(total)


def shingle_hashes(text: str) -> np.ndarray:
    """The upper halves of the hashes, for the signature."""
    return (_shingles(text) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima; long texts in blocks that stay in the cache."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


_SKETCH = [f"s{i}" for i in range(WORDS)]
_FINE = [f"s{i}" for i in range(2 * WORDS)]


def _signed(depth: int):
    """(rep, tops, words of the finer sketch) of each text; the first half of the words is the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = np.arange(TREES, dtype=np.uint64)
        for batch in batches:
            if batch.empty:
                continue
            sigs = np.stack([signature(shingle_hashes(t)) for t in batch["t"]])
            mixed = _mix(sigs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            bits = np.stack([(mixed >> np.uint64(i)) & np.uint64(1) for i in range(4)], axis=1).astype(np.uint8)
            words = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, PLANE * 64 - HASHES))), axis=2).reshape(len(sigs), -1).view(np.int64)
            by_tree = mixed.reshape(len(sigs), TREES, DEPTH)
            top = np.broadcast_to(tree, (len(sigs), TREES)).copy()
            for i in range(depth):
                top = _mix(top * np.uint64(0x9E3779B97F4A7C15) + by_tree[:, :, i])
            yield pd.DataFrame({"rep": batch["rep"].to_numpy(), "tops": list(top.view(np.int64))} | {c: words[:, i] for i, c in enumerate(_FINE)})

    return run


def most_unlike(threshold: float, bits: int = 2) -> int:
    """Hashes any of whose bits may differ between two sketches; at the threshold all but LOSS of the pairs stay within."""
    equal = threshold + (1.0 - threshold) / (1 << bits)
    return HASHES - math.floor(HASHES * equal - QUANTILE * math.sqrt(HASHES * equal * (1.0 - equal)))


def _unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For sketches with one row for each word: the number of hashes whose bits differ."""
    out = np.bitwise_count((x[0] ^ y[0]) | (x[PLANE] ^ y[PLANE]))
    for i in range(1, PLANE):
        out += np.bitwise_count((x[i] ^ y[i]) | (x[PLANE + i] ^ y[PLANE + i]))
    return out


def _frames(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Pairs of row numbers as frames (a, b) with a < b of about `rows` rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for pair in itertools.chain(pairs, [None]):
        if pair is not None:
            held.append(pair)
            n += len(pair[0])
        if held and (pair is None or n >= rows):
            x, y = (np.concatenate(side) for side in zip(*held, strict=True))
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
            held, n = [], 0


def _each_with(rep: np.ndarray, sketch: np.ndarray, others: np.ndarray, theirs: np.ndarray, most: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike rows of two blocks, each with each; `within` one block, each with those that follow."""
    for i in range(len(rep)):
        start = i + 1 if within else 0
        at = start + np.flatnonzero(_unlike(sketch[:, i : i + 1], theirs[:, start:]) <= most)
        if len(at):
            yield np.full(len(at), rep[i]), others[at]


def _within_runs(top: np.ndarray, rep: np.ndarray, sketch: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike rows of equal top, in whole runs."""
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    sizes = np.diff(np.append(starts, len(top)))
    for start, size in zip(starts[sizes > LONG], sizes[sizes > LONG], strict=True):
        part = slice(start, start + size)
        yield from _each_with(rep[part], sketch[:, part], rep[part], sketch[:, part], most, True)
    # Rows after each one in its run; in the short runs all rows take one step at a time.
    after = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(top))
    i = np.flatnonzero((after > 0) & (np.repeat(sizes, sizes) <= LONG))
    for step in range(1, LONG):
        i = i[after[i] >= step]
        if not len(i):
            break
        near = i[_unlike(sketch[:, i], sketch[:, i + step]) <= most]
        if len(near):
            yield rep[near], rep[near + step]


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return batch["rep"].to_numpy(), np.stack([batch[c].to_numpy().view(np.uint64) for c in _SKETCH])


def _alike(threshold: float, block: int):
    """From entries sorted by top: alike rows (a, b) of one top; a run of over `block` entries comes out as it is (a = rep), in numbered blocks."""
    most = most_unlike(threshold)

    def hot(top: int, rep: np.ndarray, sketch: np.ndarray, number: int) -> pd.DataFrame:
        return pd.DataFrame({"a": rep, "top": top, "block": number} | dict(zip(_SKETCH, sketch.view(np.int64), strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["a", "b", "top", "block", *_SKETCH]
        full = lambda frame: frame.reindex(columns=columns).astype("Int64")
        top, rep, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((WORDS, 0), np.uint64)
        number = 0  # blocks of the first run in hand that have gone out
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if batch.empty:
                    continue
                new_rep, new_sketch = _arrays(batch)
                top, rep, sketch = np.concatenate((top, batch["top"].to_numpy())), np.concatenate((rep, new_rep)), np.concatenate((sketch, new_sketch), axis=1)
            if not len(top):
                continue
            # The last run may go on in the next batch.
            last = len(top) if batch is None else int(np.searchsorted(top, top[-1]))
            if number and last:
                end = int(np.searchsorted(top, top[0], "right"))
                yield full(hot(top[0], rep[:end], sketch[:, :end], number))
                top, rep, sketch, last, number = top[end:], rep[end:], sketch[:, end:], last - end, 0
            if last:
                for frame in _frames(_within_runs(top[:last], rep[:last], sketch[:, :last], most)):
                    yield full(frame)
                top, rep, sketch = top[last:], rep[last:], sketch[:, last:]
            while len(top) > block:
                yield full(hot(top[0], rep[:block], sketch[:, :block], number))
                top, rep, sketch, number = top[block:], rep[block:], sketch[:, block:], number + 1

    return run


def _crossed(threshold: float):
    """Alike rows (a, b) of two blocks x and y of a top, or of one block, from rows sorted by top, x, y."""
    most = most_unlike(threshold)

    def pairs(parts: list[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = pd.concat(parts)
        first = cell["block"] == cell["x"]
        if cell["x"].iloc[0] == cell["y"].iloc[0]:
            rep, sketch = _arrays(cell)
            yield from _each_with(rep, sketch, rep, sketch, most, True)
        else:
            yield from _each_with(*_arrays(cell[first]), *_arrays(cell[~first]), most, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            for key, part in batch.groupby(["top", "x", "y"], sort=False):
                if key != last and held:
                    yield from _frames(pairs(held))
                    held = []
                held.append(part)
                last = key
        if held:
            yield from _frames(pairs(held))

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            kept = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                for key, text in ((a, x), (b, y)):
                    if key not in known:
                        known[key] = np.unique(_shingles(text))
                x, y = known[a], known[b]
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                if common >= threshold * (len(x) + len(y) - common):
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return run


def similar_pairs(texts: DataFrame, threshold: float = 0.8, recall: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b: the pairs of different texts with a Jaccard coefficient of at least `threshold`.

    texts: (rep bigint, t string) with distinct t, best a table that can be read
    twice. A text without a whole shingle has no partner. Pairs above the
    threshold are found with at least the probability `recall` (more for closer
    pairs), however many rows share a prefix; work grows with the square of
    their number, in tasks of at most `block` rows against as many.
    """
    texts = texts.filter(F.length("t") >= SHINGLE).select("rep", "t")
    words = lambda names: ", ".join(f"{c} bigint" for c in names)
    signed = cut(texts.mapInPandas(_signed(depth_for(threshold, recall)), f"rep bigint, tops array<bigint>, {words(_FINE)}"), "signatures")
    entries = signed.select(F.explode("tops").alias("top"), "rep", *_SKETCH)
    # By top alone, so that no two rows of one prefix are in different tasks unless block stands against block.
    ordered = entries.repartition("top").sortWithinPartitions("top")
    raw = cut(ordered.mapInPandas(_alike(threshold, block), f"a bigint, b bigint, top bigint, block bigint, {words(_SKETCH)}"), "alike")
    hot = raw.filter("b is null").drop("b").withColumnRenamed("a", "rep")
    counts = hot.groupBy("top").agg(F.max("block").alias("most"))
    cells = hot.join(counts, "top").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "most")))
    cells = cells.select("top", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", *_SKETCH)
    crossed = cells.repartition("top", "x", "y").sortWithinPartitions("top", "x", "y").mapInPandas(_crossed(threshold), "a bigint, b bigint")
    met = raw.filter("b is not null").select("a", "b").union(crossed).distinct()
    side = lambda end: signed.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}{c}") for c in _FINE])
    found = cut(met.join(side("a"), "a").join(side("b"), "b").filter(_differing("a", "b") <= most_unlike(threshold, 4)).select("a", "b"), "candidates")
    ids = found.select(F.col("a").alias("rep")).union(found.select("b")).distinct()
    near = texts.join(small(ids, 2 * found.count(), 16), "rep", "left_semi")
    left, right = near.select(F.col("rep").alias("a"), F.col("t").alias("ta")), near.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    return found.join(left, "a").join(right, "b").mapInPandas(_verify(threshold), "a bigint, b bigint")


def _differing(a: str, b: str) -> Column:
    """Hashes any of whose four bits differ, in the JVM."""
    planes = [F.lit(0)] * PLANE
    for i, c in enumerate(_FINE):
        planes[i % PLANE] = planes[i % PLANE].bitwiseOR(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    return sum((F.bit_count(x) for x in planes[1:]), F.bit_count(planes[0]))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for links (a, b).

    Alternating large-star and small-star steps; every step writes the links to
    the shared folder in place of the last, and the number of links never grows.
    """
    edges = cut(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        last, edges = edges, cut(star.select(F.col("b").alias("a"), F.col("a").alias("b")), "links")
        done_with(last)
        # Sum over the links' ends: it falls with every step until nothing changes.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


_ALNUM = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"\]\([^()\s]*\)|\\[A-Za-z]+")


def _lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [prepared(t) for t in batch["_text"]]
        keys, lines = line_keys(texts)
        ends = np.cumsum(lines)
        out = []
        for text, end, n, excess in zip(texts, ends, lines, batch["excess"], strict=True):
            if excess is not None and len(excess):
                gone = np.isin(keys[end - n : end], excess)
                if gone.any():
                    text = "\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g)
            if "\\" in text or "](" in text:
                text = _MARKUP.sub(" ", text)
            out.append("".join(_ALNUM.findall(text)))
        yield pd.DataFrame({"row_id": batch["row_id"], "t": out})


def lean_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(row_id, t): letters and digits of each text, in consistent form, without its source's repeated lines and without markup."""
    excess = cut(excess_lines(cut(keyed_rows(df, key, source, text), "lines")), "excess")
    rows = df.select(df[key].cast("bigint").alias("row_id"), F.xxhash64(df[source]).alias("fid"), df[text].alias("_text")).filter("_text is not null")
    # Where the lists of all sources are too large to broadcast, texts are shuffled by source.
    size = excess.agg(F.sum(F.lit(32) + 8 * F.size("excess"))).first()[0] or 0
    joined = rows.join(small(excess, size, 1), "fid", "left")
    return joined.select("row_id", "_text", "excess").mapInPandas(_lean, "row_id bigint, t string")


def near_duplicates(texts: DataFrame, threshold: float = 0.8, recall: float = 0.9) -> DataFrame:
    """(row_id, class_id, group_id, links): for each row its exact class, its group, and the links of its class.

    texts: (row_id bigint, t string) where t holds the letters and digits to
    compare. class_id is the least row of equal texts, group_id the least class
    of the component, links the number of classes alike to this one. Null and
    empty texts are left out; equal texts are a group even if too short for a
    shingle; an empty table gives an empty result.
    """
    rows = cut(texts.filter(F.length("t") > 0).select("row_id", "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")), "texts")
    classes = rows.groupBy("h1", "h2").agg(F.min("row_id").alias("class_id"))
    member = cut(rows.select("row_id", "h1", "h2").join(classes, ["h1", "h2"]).select("row_id", "class_id"), "members")
    doubled = member.filter("row_id <> class_id").select("row_id")
    single = rows.join(small(doubled, doubled.count(), 16), "row_id", "left_anti").select(F.col("row_id").alias("rep"), "t")
    links = cut(similar_pairs(single, threshold, recall), "similar")
    degree = links.select(F.col("a").alias("class_id")).union(links.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    roots = components(links).select(F.col("node").alias("class_id"), "root")
    out = member.join(roots, "class_id", "left").join(degree, "class_id", "left")
    return out.select("row_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b) with a < b for every two rows of one group."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    shared = groups.join(sizes, "group_id")
    a = shared.select("group_id", F.col("row_id").alias("row_id_a"))
    b = shared.select("group_id", F.col("row_id").alias("row_id_b"))
    return a.join(b, "group_id").filter("row_id_a < row_id_b").select("row_id_a", "row_id_b")
