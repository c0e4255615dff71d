"""Noise in text from scanned pages: cut words, misread characters, running heads, page numbers.

The blocks of a page form a sequence that a hidden Markov model labels from
layout and text features and the recognition's confidence: running head, page
number, table cell or speck, start of a paragraph ("break"), or its continuation
("body"). Its chances are estimated on all pages of the table, by Viterbi
training from given priors. Paragraphs are put together from the labels; words
cut at line ends are joined where the words of the table speak for it, and
misread characters are put right where the same context nearly always shows
another, similar character.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textform import canonical
from siltstone.runtime import cut

PAGE_HEIGHT = 840.0
#: Share of the page height that is margin, above and below.
MARGIN = 0.07
#: Pages of a document on which a running head returns at least.
HEAD_PAGES = 3
#: Blocks that are labelled as one sequence; a longer page is labelled in parts, none left out.
SEQUENCE = 2_000
#: Rounds of estimation, and the pages' worth of blocks that the priors count as.
ROUNDS, PRIOR_BLOCKS = 2, 200.0
#: Confidence of recognition from which a block counts as clear.
CLEAR = 0.9
#: Confidence of recognition from which a word is kept though it looks like a far more frequent one.
SURE = 0.99

# Groups of characters that recognition takes for one another.
ALIKE_GROUPS = (
    "元兀 资賌 计汁 率卒 增憎 营菅 预顶 收牧 系糸 额颔 亿忆 较铰 负贠 市巾 业亚 降隆 未末 土士 日曰 己已巳 人入八 千干于 大太犬 天夭夫 "
    "王玉主 木本术 刀力 田由甲申 白自百 目且 住往佳 令今 侯候 拆折析 拔拨 待侍 抱包 戌戍戊 治冶 未来 归旧 贝见 车东 第弟 洒酒 乌鸟 壮状 "
    "0Oo 1lIi!| 5S$ 8B 2Z a@ 6G 9g"
).split()
# What a wrongly read piece of a Latin word may stand for.
LATIN_READINGS = {
    "0": "o", "1": "li", "!": "il", "@": "a", "$": "s", "5": "s", "8": "B", "|": "li", "I": "l", "l": "i", "rn": "m", "cl": "d", "vv": "w", "m": ["rn"], "d": ["cl"],
}
_CLASS = {c: g[0] for g in ALIKE_GROUPS for c in g}
_HAN = re.compile("[㐀-鿿]")
_LETTER = re.compile("[A-Za-zÀ-ɏ]")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9!@$|]{3,}")
_FIGURE = re.compile(r"(?<=\d)[OoIlSBZ|]+(?=\d|[.,]\d|%)|(?<=\d[.,])[OoIlSBZ|]+(?=\d|%)|(?<=\d)[OoIl|](?![A-Za-z0-9])|(?<![A-Za-z0-9])[OoIlSBZ|](?=\d*[.,]\d)|(?<![A-Za-z0-9])[IlO](?=\d{2,}(?![A-Za-z]))")
_NOT_FIGURE = re.compile(r"\b\d+(?:st|nd|rd|th)\b|O2O|B2B")
_SIGNS = "-‐‑¬­"
_CUT = re.compile(rf"(?<![A-Za-zÀ-ɏ])([A-Za-zÀ-ɏ]+)([{_SIGNS}])[ \t ]*(?:\n|$)")
_FIRST = re.compile(r"\s*([A-Za-zÀ-ɏ]+)")
_BLANK_LINE_END = re.compile(r"[ \t ]*\n")
_COUNT = re.compile(
    r"[\s\-—–·•.|/()（）\[\]<>]*(?:第|page|p\.?|pg\.?)?\s*(?:\d{1,4}|[ivxlc]{1,8})\s*(?:页)?\s*(?:(?:/|of|共|，|,)\s*共?\s*\d{1,4}\s*页?)?[\s\-—–·•.|/()（）\[\]<>]*", re.I
)
_RUN_OF_SIGNS = re.compile(r"([\s\-—–·•.|/()（）\[\]<>])\1+")
_COUNT_LETTERS = 24
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_AS_DIGIT = str.maketrans("OolI|!SBZ@", "0011115820")
_FINAL = re.compile("[。！？!?.…：:；;][”’\"')）】»]*\\s*$")


def flat(text: str) -> str:
    """Consistent form in one line; a line break counts as a blank between ASCII only."""
    lines = [x.strip(" \t") for x in canonical(text).split("\n")]
    out = ""
    for line in lines:
        if out and line and out[-1] < "ɐ" and line[0] < "ɐ" and (out[-1].isalpha() and line[0].isalpha()):
            out += " "
        out += line
    return out


def skeleton(text: str) -> str:
    """Letters and digits with each look-alike folded into its group, for comparing heads."""
    t = canonical(text).replace("rn", "m").replace("cl", "d").replace("vv", "w")
    return "".join(_CLASS.get(c, c) for c in t if c.isalnum() or c in "!@|$").lower()


def counts_page(text: str) -> bool:
    """Only a page number, in arabic or roman figures, misread figures allowed."""
    t = _RUN_OF_SIGNS.sub(r"\1", canonical(text)).strip()
    # A count has a few words and two numbers at most, so more letters and digits never match below.
    if not t or sum(map(str.isalnum, t)) > _COUNT_LETTERS:
        return False
    bare = t.strip("-—–·•.|/()（）[]<> ")
    if _ROMAN.fullmatch(bare):
        return bool(bare)
    for form in (t, t.translate(_AS_DIGIT), re.sub("[^agep ofP]", lambda m: m.group().translate(_AS_DIGIT), t.replace("@", "a")), re.sub("(?i)p[a@][g9]e", "page", t).translate(_AS_DIGIT).replace("0f", "of")):
        if _COUNT.fullmatch(form) and _DIGIT.search(form):
            return True
    return False


# --- statistics over the whole table -------------------------------------------------


def _centres(t: str) -> Iterator[tuple[str, str, str]]:
    """(left, centre, right) for centres that may be misread, digits as one class."""
    t = "^" + _DIGIT.sub("#", t) + "$"
    for i in range(1, len(t) - 1):
        yield from _centres_at(t, i)


def _centres_at(t: str, i: int) -> Iterator[tuple[str, str, str]]:
    c = t[i]
    if c == "#" or _HAN.match(c) or _LETTER.match(c) and not _LETTER.match(t[i - 1]) and not _LETTER.match(t[i + 1]):
        yield t[i - 1], c, t[i + 1]


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by batch of contexts (t), Latin words (w) and hyphenated compounds (c)."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["text"]:
            if not text or not text.strip():
                continue
            one = flat(text)
            seen.update(("t", a + b, c) for a, c, b in _centres(one))
            body = _CUT.sub(" ", _BLANK_LINE_END.sub("\n", text))
            body = canonical(body)
            seen.update(("w", w, "") for w in _WORD.findall(body) if len(_LETTER.findall(w)) >= 2)
            seen.update(("c", x.lower(), y.lower()) for x, y in re.findall(r"\b([A-Za-z]+)[-‐]([A-Za-z]+)\b", body))
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "k", "v", "n"])


def statistics(blocks: DataFrame) -> DataFrame:
    """(kind, k, v, n): contexts, words and compounds of all blocks, counted by batch and then summed."""
    return blocks.select("text").mapInPandas(_tally, "kind string, k string, v string, n bigint").groupBy("kind", "k", "v").agg(F.sum("n").alias("n"))


def misread_contexts(stats: DataFrame, ratio: float = 12.0, least: int = 8) -> DataFrame:
    """(k, v, y): contexts k in which v stands where another character y nearly always stands.

    A pair (v, y) counts if it is a known look-alike, or if the table shows it
    in at least three contexts that make up half of all where v is out of place.
    """
    seen = stats.filter("kind = 't'").select("k", "v", "n")
    # One row for each context, whatever its number of characters; rare contexts convict nobody.
    top = seen.groupBy("k").agg(F.max(F.struct("n", F.col("v").alias("y"))).alias("b")).filter("b.n >= 3")
    pairs = seen.join(top, "k").filter("v <> b.y").select("k", "v", "n", F.col("b.y").alias("y"), F.col("b.n").alias("ny"))
    alike = F.create_map(*[F.lit(x) for c, g in _CLASS.items() for x in (c, g)])
    group_v, group_y = F.element_at(alike, F.col("v")), F.element_at(alike, F.col("y"))
    latin = F.col("v").rlike("[A-Za-z]")
    known = F.coalesce(group_v == group_y, F.lit(False)) | (F.col("v").isin(*"OoIlSBZ") & (F.col("y") == "#"))
    pairs = pairs.withColumn("known", known).filter((F.col("y") == "#") & latin | (~latin & F.col("y").rlike("[\\u3400-\\u9fff]") & (F.col("v") != "#")))
    odd = pairs.filter((F.col("ny") >= ratio * F.col("n")) & (F.col("ny") >= least) & (F.col("y") != "#"))
    learned = odd.groupBy("v", "y").agg(F.count("*").alias("contexts"), F.sum("n").alias("times"))
    everywhere = odd.groupBy("v").agg(F.sum("n").alias("odd_times"))
    occurrences = seen.groupBy("v").agg(F.sum("n").alias("all_times"))
    learned = learned.join(everywhere, "v").join(occurrences, "v").filter("contexts >= 3 and times >= 0.5 * odd_times and odd_times >= 0.5 * all_times").select("v", "y", F.lit(True).alias("learned"))
    judged = pairs.join(learned, ["v", "y"], "left")
    bad = judged.filter(F.col("known") & (F.col("ny") >= 4 * F.col("n")) & (F.col("ny") >= 4) | F.col("learned") & (F.col("ny") >= ratio * F.col("n"))).select("k", "v", "y")
    # A character that is out of place in most contexts is so in contexts too rare to tell, too.
    rare = seen.join(learned, "v").filter(F.col("n") < 3).select("k", "v", "y").join(bad, ["k", "v"], "left_anti")
    return bad.unionByName(rare)


# Each sign of a word in the form in which all its readings agree.
_ONE = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "I": "l", "i": "l", "@": "a", "$": "s", "5": "s", "8": "B"} | {"m": "rn", "d": "cl", "w": "vv"})
_RULES = [(k, y) for k, ys in LATIN_READINGS.items() for y in ys]


def _folded(word: str) -> str:
    """The same for a word and for all words it may be a wrong reading of: every rule maps both its sides to one form."""
    return word.translate(_ONE)


def reads_as(word: str, other: str) -> bool:
    """Whether `other` comes from `word` by reading some of its pieces, any number at any places, as LATIN_READINGS says."""
    ends = {(0, 0)}
    seen = set(ends)
    while ends:
        i, j = ends.pop()
        if i == len(word) and j == len(other):
            return True
        steps = [(i + 1, j + 1)] if i < len(word) and j < len(other) and word[i] == other[j] else []
        steps += [(i + len(k), j + len(y)) for k, y in _RULES if word.startswith(k, i) and other.startswith(y, j)]
        ends.update(x for x in steps if x not in seen)
        seen.update(steps)
    return False


def _fold_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(form=batch["k"].map(_folded))


def _read_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.loc[[reads_as(w, v) for w, v in zip(batch["w"], batch["v"], strict=True)], ["w", "v", "nv"]]


def misread_words(stats: DataFrame, ratio: float = 8.0) -> DataFrame:
    """(w, v): words w of the table that are a wrong reading of the far more frequent word v.

    Words meet by their folded form, whatever their length and the number of wrong pieces.
    """
    words = cut(stats.filter("kind = 'w'").select("k", "n").mapInPandas(_fold_words, "k string, n bigint, form string"), "words")
    known = words.filter(F.col("n") >= ratio + 2).select("form", F.col("k").alias("v"), F.col("n").alias("nv"))
    tried = words.select("form", F.col("k").alias("w"), "n").join(known, "form").filter((F.col("w") != F.col("v")) & (F.col("nv") >= ratio * F.col("n") + 2))
    read = tried.select("w", "v", "nv").mapInPandas(_read_words, "w string, v string, nv bigint")
    return read.groupBy("w").agg(F.max_by("v", F.struct("nv", "v")).alias("v"))


# --- defects of single blocks --------------------------------------------------------

_SIGN_IN_WORD = re.compile(r"(?<=[A-Za-zÀ-ɏ])[!@$|](?=[a-zÀ-ɏ])|(?<=[a-zÀ-ɏ])[!@$|0](?=[a-zÀ-ɏ]{2})|(?<=[A-Za-z]{2})[0!](?=[a-z])")
_ADDRESS = re.compile(r"(?<![\w.])[\w.]+@[\w-]+\.\w+|https?://\S+")


def has_misread_figure(text: str) -> bool:
    one = _NOT_FIGURE.sub(" ", _ADDRESS.sub(" ", flat(text)))
    return bool(_FIGURE.search(one) or _SIGN_IN_WORD.search(one))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: contexts (t), words (w) and cuts (s: left, right, sign) to look up; (f) figures found."""
    for batch in batches:
        rows = []
        for block, text in zip(batch["block"], batch["text"], strict=True):
            if not text or not text.strip():
                continue
            one = flat(text)
            rows += {(block, "t", a + b, c) for a, c, b in _centres(one) if c != "#"}
            rows += {(block, "w", w, "") for w in _WORD.findall(canonical(text)) if len(_LETTER.findall(w)) >= 2}
            if has_misread_figure(text):
                rows.append((block, "f", "", ""))
        yield pd.DataFrame(rows, columns=["block", "kind", "k", "v"])


def corrections(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(block, kind, k, v, y): what stands wrongly in a block, a character v in context k (t) or a word k (w), and y that belongs there."""
    parts = blocks.select("block", "text").mapInPandas(_parts, "block bigint, kind string, k string, v string")
    bad = misread_contexts(stats).select(F.lit("t").alias("kind"), "k", "v", "y")
    bad = cut(bad.unionByName(misread_words(stats).select(F.lit("w").alias("kind"), F.col("w").alias("k"), F.lit("").alias("v"), F.col("v").alias("y"))), "corrections")
    return parts.join(bad, ["kind", "k", "v"]).select("block", "kind", "k", "v", "y").distinct()


def misread(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(block): blocks with at least one character read as another."""
    parts = blocks.select("block", "text").mapInPandas(_parts, "block bigint, kind string, k string, v string")
    bad = misread_contexts(stats).select(F.lit("t").alias("kind"), "k", "v").unionByName(misread_words(stats).select(F.lit("w").alias("kind"), F.col("w").alias("k"), F.lit("").alias("v")))
    bad = cut(bad.unionByName(blocks.sparkSession.createDataFrame([("f", "", "")], "kind string, k string, v string")), "misreadings")
    return parts.join(bad, ["kind", "k", "v"], "left_semi").select("block").distinct()


# --- layout ---------------------------------------------------------------------------

STATES = ("head", "number", "cell", "break", "body")
#: The features of a block, one value of each.
GROUPS = {
    "place": ("margin", "inner"), "again": ("returns", "alone"), "count": ("count", "not_count"), "width": ("narrow", "wide"),
    "after": ("after_final", "after_open", "first"), "start": ("indented", "flush"), "sure": ("clear", "blurred", "unknown"),
}
# Chances of the features in each state before any page is seen, in the order of GROUPS; of text, first for the start of a paragraph.
_PLAIN = {"again": (0.002, 0.998), "count": (0.002, 0.998), "sure": (0.5, 0.4, 0.1)}
PRIORS = {
    "head": {"place": (0.999, 0.001), "again": (0.98, 0.02), "count": (0.005, 0.995), "width": (0.4, 0.6), "after": (0.34, 0.33, 0.33), "start": (0.2, 0.8), "sure": (0.5, 0.4, 0.1)},
    "number": {"place": (0.999, 0.001), "again": (0.5, 0.5), "count": (0.998, 0.002), "width": (0.8, 0.2), "after": (0.34, 0.33, 0.33), "start": (0.2, 0.8), "sure": (0.5, 0.4, 0.1)},
    "cell": {"place": (0.03, 0.97), "width": (0.97, 0.03), "after": (0.34, 0.33, 0.33), "start": (0.2, 0.8), **_PLAIN},
    "break": {"place": (0.02, 0.98), "width": (0.1, 0.9), "after": (0.7, 0.1, 0.2), "start": (0.4, 0.6), **_PLAIN},
    "body": {"place": (0.02, 0.98), "width": (0.1, 0.9), "after": (0.1, 0.8, 0.1), "start": (0.05, 0.95), **_PLAIN},
}
_NEXT = {(a, b): 0.2 for a in STATES for b in STATES} | {("head", "body"): 0.1, ("head", "break"): 0.4, ("body", "body"): 0.35, ("break", "body"): 0.35}


class LayoutModel(NamedTuple):
    """Log chances: of the first state, of a state after another, and of a block's code of features in a state."""

    first: list[float]
    moves: list[list[float]]
    emits: list[list[float]]


_SIZES = [len(v) for v in GROUPS.values()]
_CODES = math.prod(_SIZES)


def _values(code: int) -> list[int]:
    out = []
    for size in reversed(_SIZES):
        code, value = divmod(code, size)
        out.append(value)
    return out[::-1]


def layout_model(counts: dict[tuple[str, str, str], float] | None = None) -> LayoutModel:
    """The model of the priors, or of counts added to them.

    counts: (what, a, b) with what = "first" (state), "move" (state, state), or a group of GROUPS (state, value).
    """
    counts = counts or {}

    def log_chances(what: str, a: str, names: tuple[str, ...], prior: tuple[float, ...]) -> list[float]:
        scale = PRIOR_BLOCKS / sum(prior)
        own = [p * scale + counts.get((what, a, b), 0.0) for b, p in zip(names, prior, strict=True)]
        return [math.log(x / sum(own)) for x in own]

    first = log_chances("first", "", STATES, (0.2,) * len(STATES))
    moves = [log_chances("move", a, STATES, tuple(_NEXT[a, b] for b in STATES)) for a in STATES]
    by_group = [[log_chances(g, s, names, PRIORS[s][g]) for g, names in GROUPS.items()] for s in STATES]
    emits = [[sum(by_group[s][g][v] for g, v in enumerate(_values(code))) for s in range(len(STATES))] for code in range(_CODES)]
    return LayoutModel(first, moves, emits)


PRIOR_MODEL = layout_model()


def _code(block: dict, before: str | None) -> int:
    """The features of a block as one number."""
    sure = block.get("confidence")
    has = (
        not block["margin"],
        not block["returns"],
        not block["count"],
        not (block["x1"] - block["x0"] < 120 and len(block["text"]) < 24),
        2 if before is None else 0 if _FINAL.search(before) else 1,
        not (block["text"][:1] in "　  \t" or block["type"] == "title"),
        2 if sure is None or sure != sure else 0 if sure >= CLEAR else 1,
    )
    code = 0
    for size, value in zip(_SIZES, has, strict=True):
        code = code * size + int(value)
    return code


def page_codes(page: list[dict]) -> list[int]:
    out, before = [], None
    for block in page:
        out.append(_code(block, before))
        if not block["margin"]:
            before = block["text"]
    return out


def most_likely(codes: list[int], model: LayoutModel) -> list[int]:
    """Most likely states of a sequence (Viterbi)."""
    if not codes:
        return []
    every = range(len(STATES))
    score = [a + b for a, b in zip(model.first, model.emits[codes[0]], strict=True)]
    back = []
    for code in codes[1:]:
        step = [max(every, key=lambda p, s=s: score[p] + model.moves[p][s]) for s in every]
        score = [score[step[s]] + model.moves[step[s]][s] + model.emits[code][s] for s in every]
        back.append(step)
    states = [max(every, key=score.__getitem__)]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def label(page: list[dict], model: LayoutModel = PRIOR_MODEL) -> list[str]:
    """Most likely states of a page's blocks in reading order."""
    return [STATES[s] for s in most_likely(page_codes(page), model)]


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the pages of a batch, equal pages counted once."""
    seen: Counter = Counter()
    for page in _pages(batches):
        for block in page:
            block["count"] = block["margin"] and counts_page(block["text"])
        seen[tuple(page_codes(page))] += 1
        if len(seen) >= 20_000:
            yield pd.DataFrame({"codes": [list(c) for c in seen], "n": list(seen.values())})
            seen = Counter()
    yield pd.DataFrame({"codes": [list(c) for c in seen], "n": list(seen.values())})


def _states_counted(model: LayoutModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for codes, n in zip(batch["codes"], batch["n"], strict=True):
                states = most_likely(list(codes), model)
                seen["first", "", STATES[states[0]]] += n
                for a, b in zip(states, states[1:], strict=False):
                    seen["move", STATES[a], STATES[b]] += n
                for s, code in zip(states, codes, strict=True):
                    for (g, names), v in zip(GROUPS.items(), _values(code), strict=True):
                        seen[g, STATES[s], names[v]] += n
        yield pd.DataFrame([(*k, float(n)) for k, n in seen.items()], columns=["what", "a", "b", "n"])

    return run


def fitted_model(ordered: DataFrame, rounds: int = ROUNDS) -> LayoutModel:
    """The model estimated on all pages, by rounds of Viterbi training over their distinct sequences of features.

    The driver gets a row for each state and feature, whatever the table.
    """
    pages = cut(ordered.mapInPandas(_sequences, "codes array<int>, n bigint").filter(F.size("codes") > 0).groupBy("codes").agg(F.sum("n").alias("n")), "sequences")
    model = PRIOR_MODEL
    for _ in range(rounds):
        counted = pages.mapInPandas(_states_counted(model), "what string, a string, b string, n double").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
        model = layout_model({(r["what"], r["a"], r["b"]): r["n"] for r in counted.collect()})
    return model


def _layout_rows(df: DataFrame, key: str, height: float) -> DataFrame:
    cols = {"block": key, "doc": "doc_id", "page": "page", "x0": "x0", "y0": "y0", "x1": "x1", "y1": "y1", "text": "text", "type": "block_type", "confidence": "confidence"}
    rows = df.select(*[df[c].alias(a) for a, c in cols.items()])
    rows = rows.filter(F.col("text").rlike("\\S"))
    return rows.withColumn("margin", F.coalesce((F.col("y1") <= MARGIN * height) | (F.col("y0") >= (1 - MARGIN) * height), F.lit(False)))


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["block", "doc", "page"]].assign(bone=batch["text"].map(skeleton), number=batch["text"].map(counts_page))


def _most(length: int) -> int:
    """Characters in which a margin text may differ from a head of a length."""
    return max(1, length // 5) if length >= 3 else 0


def _head_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One piece more than a head may have errors: at least one piece stands unchanged in every text that is near."""
    for batch in batches:
        rows = []
        for doc, head in zip(batch["doc"], batch["head"], strict=True):
            parts = _most(len(head)) + 1
            ends = [len(head) * i // parts for i in range(parts + 1)]
            rows += [(doc, head, head[a:b], a) for a, b in zip(ends, ends[1:], strict=False)] if parts > 1 else []
        yield pd.DataFrame(rows, columns=["doc", "head", "piece", "at"])


def _text_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pieces of a margin text of the sizes that pieces of heads near it can have."""
    for batch in batches:
        rows = []
        for doc, bone in zip(batch["doc"], batch["bone"], strict=True):
            n = len(bone)
            near = [k for k in range(max(3, n - n // 4 - 2), n + n // 4 + 3) if abs(k - n) <= _most(k)]
            sizes = {x for k in near for x in (k // (_most(k) + 1), -(-k // (_most(k) + 1)))}
            rows += [(doc, bone, bone[i : i + size], i) for size in sizes for i in range(n - size + 1)]
        yield pd.DataFrame(rows, columns=["doc", "bone", "piece", "place"])


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Margin texts within a few characters of a head of their document."""
    for batch in batches:
        near = [_edits(a, b, _most(len(b))) for a, b in zip(batch["bone"], batch["head"], strict=True)]
        yield batch.loc[near, ["doc", "bone"]]


def _edits(a: str, b: str, most: int) -> bool:
    """Whether a and b differ by at most `most` insertions, deletions and substitutions."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def running_heads(rows: DataFrame) -> DataFrame:
    """(block): margin texts that return on HEAD_PAGES pages of their document, misreadings disregarded."""
    bones = cut(rows.filter("margin").select("block", "doc", "page", "text").mapInPandas(_skeletons, "block bigint, doc string, page int, bone string, number boolean").filter("bone <> '' and not number and doc is not null"), "margins")
    # Distinct pages first, so that a document with a third of all rows is summed before the shuffle.
    heads = bones.select("doc", "bone", "page").distinct().groupBy("doc", "bone").agg(F.count("*").alias("pages")).filter(F.col("pages") >= HEAD_PAGES)
    same = bones.join(heads.select("doc", "bone"), ["doc", "bone"], "left_semi").select("block")
    rest = bones.join(heads.select("doc", "bone"), ["doc", "bone"], "left_anti")
    # Texts and heads of a document meet by pieces, not each with each.
    pieces = heads.select("doc", F.col("bone").alias("head")).mapInPandas(_head_pieces, "doc string, head string, piece string, at int")
    texts = rest.select("doc", "bone").distinct().mapInPandas(_text_pieces, "doc string, bone string, piece string, place int")
    met = texts.join(pieces, ["doc", "piece"]).filter(F.abs(F.col("place") - F.col("at")) <= F.greatest(F.lit(1), F.floor(F.length("head") / 5)))
    near = met.select("doc", "bone", "head").distinct().mapInPandas(_close, "doc string, bone string").distinct()
    return same.unionByName(rest.join(near, ["doc", "bone"], "left_semi").select("block")).distinct()


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    """The pages of a partition that is sorted by doc, page, lone, y0; a block without document or page stands by itself."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_dict("records"):
            if held and (row["lone"] != 0 or (row["doc"], row["page"]) != (held[0]["doc"], held[0]["page"]) or len(held) >= SEQUENCE):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _label_pages(batches: Iterator[pd.DataFrame], model: LayoutModel) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for page in _pages(batches):
        for block in page:
            block["count"] = block["margin"] and counts_page(block["text"])
        states = label(page, model)
        text = [b for b, s in zip(page, states, strict=True) if s in ("break", "body")]
        follow = {}
        for b, n in zip(text, text[1:] + [None], strict=True):
            later = next((x for x in text if x["y0"] > b["y0"] + 2 and x["block"] != b["block"]), None) if n is None or n["y0"] <= b["y0"] + 2 else n
            follow[b["block"]] = later
        first = True
        for block, state in zip(page, states, strict=True):
            nxt = follow.get(block["block"])
            leads = first and state in ("break", "body")
            first = first and not leads
            out.append((block["block"], block["doc"], block["page"], state, block["text"], block["y0"], None if nxt is None else nxt["text"], leads))
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=_LABELLED)
            out = []
    yield pd.DataFrame(out, columns=_LABELLED)


_LABELLED = ["block", "doc", "page", "state", "text", "y0", "next", "leads"]


def labelled(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with their states, in reading order by page; the text that follows each body block on its page."""
    marked = rows.join(heads.withColumn("returns", F.lit(True)), "block", "left").withColumn("returns", F.coalesce("returns", F.lit(False)))
    by_page = _in_pages(cut(marked, "blocks"))
    model = fitted_model(by_page)
    return by_page.mapInPandas(lambda batches: _label_pages(batches, model), "block bigint, doc string, page int, state string, text string, y0 double, next string, leads boolean")


def _in_pages(rows: DataFrame) -> DataFrame:
    lone = F.when(F.col("doc").isNull() | F.col("page").isNull(), F.col("block")).otherwise(0)
    return rows.withColumn("lone", lone).repartition("doc", "page", "lone").sortWithinPartitions("doc", "page", "lone", "y0", "x0", "block")


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for block, text, follow in zip(batch["block"], batch["text"], batch["follow"], strict=True):
            for m in _CUT.finditer(text):
                after = text[m.end() :]
                inner = m.end() < len(text) or text[m.end() - 1 : m.end()] == "\n"
                right = _FIRST.match(canonical(after) if inner and after.strip() else canonical(follow or ""))
                left = re.search("[A-Za-zÀ-ɏ]+$", canonical(m.group(1)))
                if left:
                    rows.append((block, left.group().lower(), right.group(1).lower() if right else "", m.group(2)))
        yield pd.DataFrame(rows, columns=["block", "l", "r", "sign"])


def cut_words(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(block, l, r): the pieces, in lower case, of words that a hyphen-like sign cuts at a line's or the block's end.

    The pieces are one word if the table has it whole, and a compound if the
    table writes it with the hyphen more often. Where it has neither, they are a
    compound if the left piece begins others, and, at a soft hyphen, which may
    be a stray sign between two words, only one word if a piece is no word.
    """
    first = pages.filter("leads").select("doc", (F.col("page") - 1).alias("page"), F.col("text").alias("over"))
    text = pages.filter("state in ('break', 'body')").filter(F.col("text").rlike(f"[{_SIGNS}]\\s*(\\n|$)"))
    text = text.join(first, ["doc", "page"], "left").select("block", "text", F.coalesce("next", "over").alias("follow"))
    cuts = cut(text.mapInPandas(_cuts, "block bigint, l string, r string, sign string"), "cuts")
    words = stats.filter("kind = 'w'").groupBy(F.lower("k").alias("w")).agg(F.sum("n").alias("n"))
    compounds = stats.filter("kind = 'c'").select(F.col("k").alias("l"), F.col("v").alias("r"), F.col("n").alias("nc"))
    heads = compounds.groupBy("l").agg(F.sum("nc").alias("nl"))
    told = cuts.withColumn("joined", F.concat("l", "r"))
    for col, to in (("joined", "n_joined"), ("l", "n_left"), ("r", "n_right")):
        told = told.join(words.select(F.col("w").alias(col), F.col("n").alias(to)), col, "left")
    told = told.join(compounds, ["l", "r"], "left").join(heads, "l", "left").fillna(0, ["n_joined", "n_left", "n_right", "nc", "nl"])
    open_end = (F.col("r") == "") & (F.col("nl") == 0) & (F.col("n_left") < 3)
    both_words = (F.col("n_left") >= 2) & (F.col("n_right") >= 2)
    unseen = F.when(F.col("sign") == "\u00ad", ~both_words).otherwise(F.col("nl") == 0)
    whole = F.when(F.col("nc") > F.col("n_joined"), False).when(F.col("n_joined") > 0, True).otherwise(unseen)
    return told.filter(F.when(F.col("r") == "", open_end).otherwise(whole)).select("block", "l", "r").distinct()


def split_words(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(block): blocks in which a word is cut."""
    return cut_words(pages, stats).select("block").distinct()


def page_defects(df: DataFrame, key: str = "block_id", height: float = PAGE_HEIGHT) -> DataFrame:
    """(block_id, defect): split_word, misread, running_head and page_number, each once for a block.

    df has the columns of text_blocks; others are ignored. Blank and null texts
    never count; null positions count as inside the page; blocks read twice are
    judged like any other; an empty table gives an empty result.
    """
    rows = _layout_rows(df, key, height)
    stats = cut(statistics(rows), "statistics")
    pages = cut(labelled(rows, running_heads(rows)), "pages")
    found = [
        split_words(pages, stats).withColumn("defect", F.lit("split_word")),
        misread(rows, stats).withColumn("defect", F.lit("misread")),
        pages.filter("state = 'head'").select("block", F.lit("running_head").alias("defect")),
        pages.filter("state = 'number'").select("block", F.lit("page_number").alias("defect")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.col("block").alias("block_id"), "defect")


# --- paragraphs ------------------------------------------------------------------------


def corrected(text: str, fixes: dict[tuple[str, str, str], str], sure: bool = False) -> str:
    """text in one line with its misread characters, words and figures put right; `sure` text keeps words that are only rare."""
    one = flat(text)
    chars = list(one)
    for i, (a, c, b) in _places_of_centres(one):
        y = fixes.get(("t", a + b, c))
        if y is not None:
            chars[i] = c.translate(_AS_DIGIT) if y == "#" else y
    one = "".join(chars)
    if not sure:
        one = _WORD.sub(lambda m: fixes.get(("w", m.group(), ""), m.group()), one)
    kept = [m.span() for x in (_NOT_FIGURE, _ADDRESS) for m in x.finditer(one)]
    return _FIGURE.sub(lambda m: m.group() if any(a < m.end() and m.start() < b for a, b in kept) else m.group().translate(_AS_DIGIT), one)


def _places_of_centres(one: str) -> Iterator[tuple[int, tuple[str, str, str]]]:
    t = "^" + _DIGIT.sub("#", one) + "$"
    for i in range(1, len(t) - 1):
        for found in _centres_at(t, i):
            yield i - 1, found


def joined_lines(text: str, words: set[tuple[str, str]]) -> str:
    """text without the signs that cut one of `words` at the end of a line."""

    def join(m: re.Match) -> str:
        left, right = re.search("[A-Za-zÀ-ɏ]+$", canonical(m.group(1))), _FIRST.match(canonical(text[m.end() :]))
        return m.group(1) if left and right and (left.group().lower(), right.group(1).lower()) in words else m.group()

    return _CUT.sub(join, text)


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for page in _pages(batches):
        out: list[str] = []
        open_text = False
        pending: set[tuple[str, str]] = set()
        for block in page:
            if block["state"] in ("head", "number"):
                continue
            words = {tuple(x) for x in block["words"]} if block["words"] is not None else set()
            fixes = {(x[0], x[1], x[2]): x[3] for x in block["fixes"]} if block["fixes"] is not None else {}
            sure = block["confidence"] is not None and block["confidence"] >= SURE
            text = corrected(joined_lines(block["text"], words), fixes, sure).strip()
            if block["taken"] and text.lower().startswith(block["taken"]):
                text = text[len(block["taken"]) :].lstrip()
            if block["state"] == "cell":
                if text:
                    out.append(text)
                open_text = False
                continue
            if block["state"] == "body" and open_text and text:
                last = re.search(rf"([A-Za-zÀ-ɏ]+)[{_SIGNS}]$", out[-1])
                right = _FIRST.match(text)
                if last and right and (last.group(1).lower(), right.group(1).lower()) in pending:
                    out[-1] = out[-1][:-1] + text
                else:
                    out[-1] += (" " if out[-1][-1] < "ɐ" and text[0] < "ɐ" else "") + text
            elif text:
                out.append(text)
                open_text = True
            # A word whose rest stands on the next page is completed here and taken from there.
            if block["over"] and (m := re.search(rf"[{_SIGNS}]$", out[-1] if out else "")):
                out[-1] = out[-1][: m.start()] + block["over"]
            pending = words
        yield pd.DataFrame({"doc_id": page[0]["doc"], "page": page[0]["page"], "paragraph": range(1, len(out) + 1), "text": out})


def paragraphs(df: DataFrame, key: str = "block_id", height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, page, paragraph, text): the readable text of each page, paragraphs counted from 1.

    Heads and page numbers are left out, cut words joined, also over a page's
    end, and misread characters put right; table cells stand by themselves. A
    confidence of SURE or more keeps words that are merely rare.
    """
    rows = _layout_rows(df, key, height)
    stats = cut(statistics(rows), "statistics")
    pages = cut(labelled(rows, running_heads(rows)), "pages")
    words = cut(cut_words(pages, stats), "words")
    by_block = words.groupBy("block").agg(F.collect_list(F.array("l", "r")).alias("words"))
    fixes = corrections(rows, stats).groupBy("block").agg(F.collect_list(F.array("kind", "k", "v", "y")).alias("fixes"))
    ends = pages.filter("state in ('break', 'body') and next is null").join(words.filter("r <> ''"), "block")
    ends = ends.filter(F.col("text").rlike(f"[{_SIGNS}]\\s*$") & F.lower(F.regexp_extract("text", f"([A-Za-zÀ-ɏ]+)[{_SIGNS}]\\s*$", 1)).eqNullSafe(F.col("l")))
    leads = pages.filter("leads").select("doc", (F.col("page") - 1).alias("page"), F.col("block").alias("lead"), F.lower(F.regexp_extract("text", "^\\s*([A-Za-zÀ-ɏ]+)", 1)).alias("r"))
    over = cut(ends.join(leads, ["doc", "page", "r"]).groupBy("block").agg(F.min("lead").alias("lead"), F.min("r").alias("over")), "over")
    taken = over.groupBy(F.col("lead").alias("block")).agg(F.min("over").alias("taken"))
    full = pages.select("block", "doc", "page", "state", "text", "y0").join(rows.select("block", "x0", "confidence"), "block")
    for extra in (by_block, fixes, over.select("block", "over"), taken):
        full = full.join(extra, "block", "left")
    return _in_pages(full).mapInPandas(_assemble, "doc_id string, page int, paragraph int, text string")
