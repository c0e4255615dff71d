"""Markup residue in text: which languages it has, and clean text without it.

A lexer finds every place that may be a construct of HTML, Markdown, wiki text
or LaTeX. A classifier of the places' forms gives each a cost for either reading,
markup or content: log odds estimated on a bounded sample of the table's texts,
from given priors, by labelling the sample with the cut and counting, in turns.
Places
near one another in the same language, and still more the two ends of one
element and a tag and the tag around it, are tied by smoothness edges. A minimum cut (by maximum flow) parts
the places that are markup from those that are content. The markup is then
rewritten: headings, lists, tables, code and formulas stay recognisable in one
plain notation, and everything else is dropped.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.textform import canonical

LANGUAGES = ("html", "markdown", "wiki", "latex")
# Blanks, and characters that `canonical` drops.
_GAP = r"[\s ­͏؜ᅟ-ᅠ ឴-឵᠋-᠏ -‏ -  -⁯　ㅤ︀-️﻿ﾠ]"
#: A text without a match has no place to look at; Java and Python share the syntax. Takes in all that _LEX can match, and the
#: full-width twins that `canonical` turns into such signs.
ANY_SIGN = rf"[<&\[{{'=|`#*>$\\~!_＜＆［｛＇＝｜｀＃＊＞＄＼～＿]|[-－]{_GAP}*[-－]|(?m:^{_GAP}*(?:[-+－＋]|\S{{1,4}}[.)．]){_GAP})"

# HTML elements.
ELEMENTS = set(
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark meta nav noscript ol option p param picture pre q s samp script section select "
    "small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
# Elements without an end.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# LaTeX commands that stand without braces.
COMMANDS = set(
    "item alpha beta gamma delta epsilon theta lambda mu pi sigma tau phi omega Delta Gamma Theta Lambda Sigma Phi Omega times cdot div pm leq geq neq approx infty sum prod int "
    "partial nabla to rightarrow left right ldots dots quad qquad hline noindent newline newpage par centering small large bf it toprule midrule bottomrule maketitle tableofcontents le ge".split()
)


class Place(NamedTuple):
    lang: str
    kind: str
    start: int
    end: int
    form: str  # what the odds are counted by: the kind, and what its own text or place tells
    weight: float  # log odds of markup against content
    mate: int  # index of the place at the element's other end, or -1
    parent: int = -1  # index of the tag around this tag, or -1


# A table or fence may begin a line, or stand behind the sign of an item or a tag.
_BEGIN = r"(?:^[ \t]*|(?<=\\item)[ \t]+|(?<=>)[ \t]*|(?<=[-+*][ ])[ \t]*)"
_LEX = re.compile(
    r"""(?P<comment><!--.*?(?:-->|\Z))
    |(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>)
    |(?P<cuttag><(?:p|br|td|tr|th|li|ul|ol|div|span|table|h[1-6]|a|img|sup|sub|b|i)(?:\s[^<>]*)?\Z)
    |(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,7}|\#\d{1,6}|\#[xX][0-9a-fA-F]{1,6});)
    |(?P<fence>BEGIN(?:```|~~~)[^`\n<]*(?:$|(?=<)))
    |(?P<wikilink>\[\[[^\[\]\n]*(?:\]\]|\Z))
    |(?P<template>(?<!\\)\{\{[^{}\n]*(?:\}\}|\Z))
    |(?P<wikihead>^(?P<eq>={2,6})[ \t]*(?P<wikititle>[^=\n]+?)[ \t]*(?P=eq)[ \t]*$)
    |(?P<wikiopen>BEGIN\{\|[^\n]*$)|(?P<wikiclose>BEGIN\|\}[ \t]*(?:$|(?=<)))|(?P<wikirow>^[ \t]*\|-[^|\n]*$)
    |(?P<quotes>'{2,5})
    |(?P<image>!\[[^\[\]\n]*\]\([^()\n]*\))
    |(?P<mdlink>\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]"[^"\n]*")?\))
    |(?P<env>\\(?:begin|end)\{(?P<envname>[A-Za-z*]+)\}(?:\[[^\]\n]*\])?(?:[ \t]*%[^\n]*)?)
    |(?P<command>\\(?P<cmd>[A-Za-z]+)\*?(?P<brace>(?:\[[^\]\n]*\])?\{)?)
    |(?P<escape>\\[%$&\#_{}])
    |(?P<mathopen>\\[(\[]|\\[)\]])
    |(?P<math>\$\$[^$]+\$\$|(?<![\\A-Za-z0-9])\$[^$\n]+\$(?!\d)|(?<=[a-z0-9])\$\\[^$\n]+\$)
    |(?P<separator>^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-*:?[ \t]*)$)
    |(?P<row>^[ \t]*\|(?=(?:[^|\n]*\|){2,}[ \t]*$))
    |(?P<wikicell>^[ \t]*[|!](?=[ \t])|\|\||!!)
    |(?P<code>(?<!`)`[^`\n]+`(?!`))
    |(?P<heading>^\#{1,6}[ \t]+(?=\S))
    |(?P<bold>\*\*|__(?=\S)(?=[^_\n]+__)|(?<=\S)__(?![A-Za-z0-9_]))
    |(?P<strike>~~)
    |(?P<bullet>^[ \t]*[-+*][ \t]+(?=\S))
    |(?P<number>^[ \t]*(?P<n>\d{1,2})[.)][ \t]+(?=\S))
    |(?P<blockquote>^[ \t]*>[ \t]+(?=\S))
    |(?P<setext>^[ \t]*={3,}[ \t]*$)
    |(?P<rule>^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$)""".replace("BEGIN", _BEGIN),
    re.M | re.S | re.X,
)
_LANG = {
    **dict.fromkeys(("comment", "tag", "cuttag", "entity"), "html"),
    **dict.fromkeys(("wikilink", "template", "wikihead", "wikiopen", "wikiclose", "wikirow", "wikicell", "quotes"), "wiki"),
    **dict.fromkeys(("env", "command", "escape", "mathopen", "math"), "latex"),
}
# Log odds of markup for each form before any text is seen; `?` marks a form that speaks against it, `+` one that speaks for it.
WEIGHTS = {
    "comment": 4, "tag": 4, "tag?": -2, "cuttag": 1, "entity": 4, "entity?": -3, "wikilink": 3, "wikilink?": 0.2, "template": 3, "template?": 0.2, "wikihead": 3, "wikiopen": 3, "wikiclose": 2, "wikiclose?": 0.5,
    "wikirow": 0.5, "wikirow?": -0.5, "wikicell": 1, "quotes": -1, "env": 4, "command": 2, "command?": -2, "command+": 0.5, "escape": 1.5, "mathopen": 1, "math": -1, "math+": 2, "fence": 2, "image": 4, "mdlink": 3, "separator": 3,
    "row": 2.5, "code": 1.5, "heading": 1.5, "bold": -1, "strike": -0.5, "bullet": 0.8, "bullet?": -4, "number": -0.6, "number+": 1.2, "blockquote": 1, "setext": 1, "setext+": 2, "rule": 0.2,
}
# What the other end of an element adds.
PAIRED = {"tag": 1, "fence": 1, "bold": 2.5, "strike": 2.5, "quotes": 2.5}
_KINDS = [k for k in WEIGHTS if k[-1] not in "?+"]
#: (form, whether its other end was found): log odds.
Odds = dict[tuple[str, bool], float]
PRIOR: Odds = {(f, paired): w + paired * PAIRED.get(f.rstrip("?+"), 0) for f, w in WEIGHTS.items() for paired in (False, True)}
#: Texts, and their bytes together, that the odds are estimated on; the driver holds them.
SAMPLE, SAMPLE_BYTES = 2_000, 8 << 20
#: Rounds of estimation, places that a prior counts as, and the greatest odds either way.
ROUNDS, PRIOR_PLACES, MOST_ODDS = 2, 50.0, 6.0
_ONE_LINE = {"tag", "cuttag"}
_PAGE = re.compile(r"[ \t]*[-*+][ \t]+\d{1,4}[ \t]*[-*+]?[ \t]*$", re.M)
_FORMULA = re.compile(r"[\\^_{}]|[=+<>].*[A-Za-z]|[A-Za-z].*[=+<>]")


def places(text: str, odds: Odds = PRIOR) -> list[Place]:
    """Every place that may be markup, in order, with the odds that its own form and its element give."""
    out: list[Place] = []
    around: list[tuple[str, int]] = []  # open tags, the innermost last
    pending: dict[str, int] = {}
    fence = -1
    wiki_table = False
    last_number: tuple[int, int, int] | None = None

    def pair(a: int, b: int) -> None:
        out[a] = out[a]._replace(mate=b)
        out[b] = out[b]._replace(mate=a)

    for m in _LEX.finditer(text):
        kind = m.lastgroup if m.lastgroup in WEIGHTS else next(k for k in _KINDS if m.group(k) is not None)
        lang, sure, i = _LANG.get(kind, "markdown"), "", len(out)
        if fence >= 0 and kind != "fence":
            if lang != "html" or kind == "comment":
                continue  # inside a code block nothing else is markup
        if kind == "wikicell" and not wiki_table:
            continue
        if kind == "tag" and m.group("name").lower() not in ELEMENTS:
            sure = "?"
        elif kind == "entity" and html.unescape(m.group()) == m.group():
            sure = "?"
        elif kind in ("wikilink", "template") and not m.group().endswith(("]]", "}}")):
            sure = "?"
        elif kind in ("wikirow", "wikiclose") and not wiki_table:
            sure = "?"
        elif kind in ("row", "separator") and wiki_table:
            lang, kind = "wiki", "wikirow"
        elif kind == "command" and not m.group("brace") and m.group("cmd") not in COMMANDS:
            sure = "?" if re.search(r"[A-Za-z]:?$|[\w.]\\[\w.]*$", text[max(0, m.start() - 12) : m.start()]) else "+"
        elif kind == "setext" and not text[: m.start()].rstrip(" \t").endswith("\n\n") and text[: m.start()].strip():
            sure = "+"  # right under the line that it makes a heading
        elif kind == "math" and _FORMULA.search(m.group()):
            sure = "+"
        elif kind == "bullet":
            if _PAGE.match(text, m.start()):
                sure = "?"
        elif kind == "number":
            n, line = int(m.group("n")), text.count("\n", 0, m.start())
            if last_number and n == last_number[0] + 1 and line - last_number[1] <= 6:
                out[last_number[2]] = out[last_number[2]]._replace(form="number+")
                sure = "+"
            last_number = (n, line, i)
        out.append(Place(lang, kind, m.start(), m.end(), kind + sure, 0.0, -1))
        if kind == "wikiopen":
            wiki_table = True
        elif kind == "wikiclose":
            wiki_table = False
        elif kind == "fence":
            if fence >= 0:
                pair(fence, i)
                fence = -1
            else:
                fence = i
        elif kind == "tag":
            name = m.group("name").lower()
            if around:
                out[i] = out[i]._replace(parent=around[-1][1])
            if m.group().startswith("</"):
                at = next((k for k in range(len(around) - 1, -1, -1) if around[k][0] == name), -1)
                if at >= 0:
                    pair(around[at][1], i)
                    del around[at:]
            elif name not in VOID and not m.group().endswith("/>"):
                around.append((name, i))
        elif kind in ("bold", "strike", "quotes"):
            mark = m.group()
            if mark in pending and "\n\n" not in text[out[pending[mark]].end : m.start()] and m.start() > out[pending[mark]].end:
                pair(pending.pop(mark), i)
            else:
                pending[mark] = i
    return [p._replace(weight=odds[p.form, p.mate >= 0]) for p in out]


#: Smoothness: capacity between neighbours of one language, its reach in characters, and between the ends of an element.
TIE, REACH, MATE = 0.6, 200.0, 4.0
#: Smoothness between a tag and the tag around it.
NESTED = 1.0


def minimum_cut(found: list[Place]) -> list[bool]:
    """For each place whether it lies on the markup side of the minimum cut."""
    n = len(found)
    if all(p.weight > 0 for p in found):
        return [True] * n  # no capacity to the content side, so the flow is nil
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float = 0.0) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(c)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    last: dict[str, int] = {}
    for i, p in enumerate(found):
        if p.weight > 0:
            edge(source, i, p.weight)
        else:
            edge(i, sink, -p.weight)
        if p.lang in last:
            tie = TIE * math.exp(-(p.start - found[last[p.lang]].end) / REACH)
            if tie > 0.01:
                edge(last[p.lang], i, tie, tie)
        last[p.lang] = i
        if 0 <= p.mate < i:
            edge(p.mate, i, MATE, MATE)
        if 0 <= p.parent < i and p.parent != p.mate:
            edge(p.parent, i, NESTED, NESTED)
    while True:  # shortest augmenting paths; places are few
        via = {source: -1}
        queue = deque([source])
        while queue and sink not in via:
            a = queue.popleft()
            for e in at[a]:
                if cap[e] > 1e-9 and to[e] not in via:
                    via[to[e]] = e
                    queue.append(to[e])
        if sink not in via:
            return [i in via for i in range(n)]
        flow, b = math.inf, sink
        while b != source:
            e = via[b]
            flow, b = min(flow, cap[e]), to[e ^ 1]
        b = sink
        while b != source:
            e = via[b]
            cap[e] -= flow
            cap[e ^ 1] += flow
            b = to[e ^ 1]


def markup_places(text: str, odds: Odds = PRIOR) -> list[Place]:
    """The places of a text in consistent form that the minimum cut takes for markup."""
    found = places(text, odds)
    return [p for p, keep in zip(found, minimum_cut(found), strict=True) if keep] if found else []


def languages(text: str, odds: Odds = PRIOR) -> list[str]:
    return sorted({p.lang for p in markup_places(text, odds)})


def estimated(texts: list[str], rounds: int = ROUNDS) -> Odds:
    """Odds of the forms, from texts in consistent form: labels by the cut under the odds so far, then counts of the labels with the priors."""
    odds = PRIOR
    for _ in range(rounds):
        seen = {key: [0, 0] for key in PRIOR}
        for text in texts:
            found = places(text, odds)
            for p, markup in zip(found, minimum_cut(found), strict=True):
                seen[p.form, p.mate >= 0][markup] += 1
        share = {key: 1 / (1 + math.exp(-w)) for key, w in PRIOR.items()}
        ratio = {key: math.log((seen[key][True] + PRIOR_PLACES * q) / (seen[key][False] + PRIOR_PLACES * (1 - q))) for key, q in share.items()}
        odds = {key: max(-MOST_ODDS, min(MOST_ODDS, x)) for key, x in ratio.items()}
    return odds


def fitted_odds(df: DataFrame, key: str, text: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Odds:
    """Odds estimated on at most `sample` texts with signs of markup, the first by a hash of the key, of at most `sample_bytes` together.

    The hash leaves about eight times the sample before any text is looked at, so that no task gathers more, however large the table.
    """
    order = [F.xxhash64("_key"), "_key"]
    drawn = F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) < F.lit(int(min(1.0, 8 * sample / max(1, df.count())) * (1 << 40)))
    rows = df.select(df[key].alias("_key"), df[text].alias("_text")).filter(drawn & F.col("_text").rlike(ANY_SIGN)).orderBy(*order).limit(sample)
    total = F.sum(F.octet_length("_text")).over(Window.orderBy(*order))  # over `sample` rows
    kept = rows.withColumn("_total", total).filter(F.col("_total") <= sample_bytes).select("_text").collect()
    return estimated([canonical(r[0]) for r in kept])


_BREAK = set("p div br tr table ul ol section article h1 h2 h3 h4 h5 h6 blockquote pre hr dl dt dd header footer".split())
#: A line break unless the text has one there already.
SOFT = "\u000b"


def _plain(text: str, p: Place) -> str:
    """What stands in the clean text for one place."""
    piece = text[p.start : p.end]
    if p.kind == "tag":
        name = re.match(r"</?([A-Za-z0-9]+)", piece).group(1).lower()
        closing = piece.startswith("</")
        if name[0] == "h" and name[1:].isdigit():
            return SOFT if closing else SOFT + "#" * int(name[1:]) + " "
        if name == "li":
            return "" if closing else SOFT + "- "
        if name in ("td", "th"):
            return " |" if closing else " "
        if name == "tr":
            return "" if closing else SOFT + "|"
        if name in ("code", "tt", "kbd"):
            return "`"
        return SOFT if name in _BREAK else ""
    if p.kind == "entity":
        return canonical(html.unescape(piece))
    if p.kind == "wikilink":
        inner = piece.strip("[]")
        return "" if re.match("(?i)(?:category|file|image|分类|文件|图像)[:：]", inner) else inner.rpartition("|")[2]
    if p.kind == "template":
        return ""
    if p.kind == "wikihead":
        return "#" * (len(piece) - len(piece.lstrip("="))) + " " + piece.strip("= \t")
    if p.kind in ("wikirow", "wikicell"):
        return "" if "-" in piece else "|"
    if p.kind in ("row", "heading", "math", "code", "fence", "bullet", "number"):
        return re.sub(r"^([ \t]*)[+*]", r"\1-", piece) if p.kind == "bullet" else piece
    if p.kind in ("image", "mdlink"):
        return re.match(r"!?\[([^\]]*)\]", piece).group(1)
    if p.kind == "escape":
        return piece[1:]
    if p.kind == "mathopen":
        return "$"
    if p.kind == "command":
        name = re.match(r"\\([A-Za-z]+)", piece).group(1)
        if name.endswith("section") or name in ("chapter", "title"):
            return SOFT + "# "
        return SOFT + "- " if name == "item" else ""
    return ""



def clean(text: str | None, odds: Odds = PRIOR) -> str | None:
    """text without its markup: headings as `#`, items as `-`, rows between `|`, code and formulas in their signs."""
    if not text:
        return text
    text = canonical(text)
    found = markup_places(text, odds)
    if not found:
        return text
    out, at, open_braces = [], 0, []
    for p in found:
        if p.start < at:
            continue
        out.append(_close_braces(text[at : p.start], open_braces))
        if p.kind == "setext":
            out = [_headed("".join(out))]
        out.append(_plain(text, p))
        if p.kind == "command" and text[p.end - 1] == "{":
            open_braces.append(True)
        at = p.end
    out.append(_close_braces(text[at:], open_braces))
    joined = re.sub(f"(?:[ \t]*{SOFT})+[ \t]*", SOFT, "".join(out))
    joined = re.sub(f"(?<=\n){SOFT}|{SOFT}(?=\n)|^{SOFT}|{SOFT}$", "", joined).replace(SOFT, "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", joined)).strip("\n")


def _headed(text: str) -> str:
    """text with its last line marked as a heading."""
    body = text.rstrip("\n \t" + SOFT)
    at = max(body.rfind("\n"), body.rfind(SOFT)) + 1
    return body[:at] + "# " + body[at:] + "\n" if body[at:] else text


def _close_braces(piece: str, opened: list[bool]) -> str:
    """piece without the closing braces of commands that were taken out."""
    while opened and "}" in piece:
        head, _, piece_after = piece.partition("}")
        opened.pop()
        piece = head + piece_after
    return piece


def _by_text(function: Callable, kind: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(function, na_action="ignore")

    return run


def without_markup(text: Column, odds: Odds = PRIOR) -> Column:
    """The clean text; a text without any sign of markup stays in the JVM and as it is. Null gives null."""
    cleaned = _by_text(lambda t: clean(t, odds), T.StringType())
    return F.coalesce(cleaned(F.when(text.rlike(ANY_SIGN), text)), text)


def markup_languages(df: DataFrame, key: str, text: str, odds: Odds | None = None) -> DataFrame:
    """(row_id, markup): one row for each markup language of which a text has a construct.

    odds: those of `fitted_odds`, by default fitted on df. Null, blank and empty
    texts have none; repeated rows are told apart by key only; an empty table
    gives an empty result; other columns are ignored.
    """
    own = fitted_odds(df, key, text) if odds is None else odds
    found = _by_text(lambda t: languages(canonical(t), own) if t else None, T.ArrayType(T.StringType()))
    rows = df.select(df[key].alias("row_id"), df[text].alias("_text")).filter(F.col("_text").rlike(ANY_SIGN))
    return rows.select("row_id", F.explode(found("_text")).alias("markup"))
