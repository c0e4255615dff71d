"""Defective question and answer pairs, each with the kind of its defect.

Kinds, in the order in which they are tried: `empty`, `copy`, `refusal`,
`other_language`, `truncated`. A pair gets the first that holds.

- empty: nothing but blanks, signs, or a filler;
- copy: greedy string tiling covers the answer with pieces of the query;
- refusal: a small grammar, speaker or source with an inability or an absence;
- other_language: script shares, and function words for Latin scripts;
- truncated: a pushdown parser leaves brackets, quotations, fences, formulas or
  tags open, the text ends in a sign that calls for more, or the end is one at
  which the answers of the table go on (counted over all of them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textform import canonical
from siltstone.runtime import cut

# Answers without content.
FILLERS = {
    "", "na", "none", "null", "nil", "nan", "tbd", "todo", "empty", "noanswer", "无", "暂无", "空", "略", "没有", "无数据", "暂无数据", "待补充", "未知", "无内容", "同上",
}

# The refusal grammar. A refusal is an apology or a speaker with an
# inability, or a source of evidence with an absence.
_ZH_SPEAKER = "(?:我|本人|本助手|作为(?:一个|一名)?(?:人工智能|AI|语言模型|大模型|智能助手)[^。，]{0,6}，?)"
_ZH_UNABLE = "(?:无法|不能|没法|没办法|无权|难以|不便|不宜|帮不上|不清楚|不知道)"
_ZH_SOURCE = "(?:现有|所给|已有|当前|给定|提供的)?(?:资料|材料|片段|文档|文中|文本|原文|上下文|信息|内容|证据|检索结果)"
_ZH_ABSENT = "(?:不足以|不足|没有提及|未提及|没有提到|未提到|没有披露|未披露|未列示|并未列示|没有给出|未给出|未涉及|没有涉及|未包含|没有相关)"
_ZH_OPEN = "(?:抱歉|对不起|不好意思|很遗憾|恕难|恕我|请谅解)"
_ZH_ANSWER = "(?:回答|作答|答复|回复|判断|确认答案|得出|提供|评论|透露|协助)"
REFUSAL_ZH = re.compile(
    f"^{_ZH_OPEN}|{_ZH_SPEAKER}[^。]{{0,6}}{_ZH_UNABLE}|{_ZH_SOURCE}[^。]{{0,16}}{_ZH_ABSENT}"
    f"|(?:无法|不能|无从|难以|不足以)(?:{_ZH_ANSWER})|超出了?我的|不宜由我|无法作出回答"
)
_EN_UNABLE = "(?:cannot|can't|can not|could not|couldn't|am unable|am not able|won't|would rather not|must decline|do not know|don't know|am not in a position)"
_EN_SOURCE = "(?:passage|context|document|text|excerpt|material|source|information|evidence|report provided)s?"
REFUSAL_EN = re.compile(
    rf"\bI(?: am sorry,? but I| regret that I|'m sorry,? but I)?\b[^.]{{0,20}}\b{_EN_UNABLE}\b|^(?:sorry|i am sorry|i'm sorry|unfortunately)\b|\bas an? (?:ai|language|large language)\b"
    rf"|\b(?:not enough|insufficient|no) {_EN_SOURCE}|\b{_EN_SOURCE}\b[^.]{{0,24}}\b(?:does|do|did|is|are)(?: not|n't)\b|\b(?:beyond|outside) (?:my|the scope of my)\b",
    re.I,
)

# Function words that tell Latin-script languages apart.
WORDS = {
    "en": "the of and to in is was were for that with by which from at on it its as not this are".split(),
    "de": "der die das und im bei um von den mit ist war lag nicht ein eine des dem auf stieg für".split(),
    "fr": "le la les de des du et en est un une dans pour sur que par au aux avec était a d".split(),
    "es": "el la los las de del y en es un una por para con que se al fue su más".split(),
    "it": "il lo gli di del della e in è un una per con che si al nel sono".split(),
    "pt": "o os as de do da e em é um uma por para com que se ao foi no na".split(),
    "nl": "de het een en van in is op te dat die met voor niet aan bij door".split(),
}
_SCRIPTS = {
    "han": re.compile("[㐀-鿿]"),
    "kana": re.compile("[぀-ヿ]"),
    "hangul": re.compile("[가-힯]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "arabic": re.compile("[؀-ۿ]"),
    "latin": re.compile("[A-Za-zÀ-ɏ]"),
}
_ALNUM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the contexts that the end of an answer is looked up by, the longest first.
CONTEXTS = (10, 8, 6, 4, 3, 2)
#: An end counts as complete if at least this share of the same contexts end a sentence.
COMPLETE_SHARE = 0.15
#: Times that a context must stand in other answers to be trusted.
LEAST_SEEN = 6


def letters(text: str) -> str:
    return "".join(_ALNUM.findall(text)).lower()


def language(text: str) -> str:
    """A language or script code; "" where the text is too short to tell."""
    n = {s: len(p.findall(text)) for s, p in _SCRIPTS.items()}
    total = sum(n.values())
    if total < 4:
        return ""
    if n["kana"] >= 2 and n["kana"] >= 0.1 * (n["kana"] + n["han"]):
        return "ja"
    # An ideograph says about as much as two or three letters.
    if n["han"] * 3 >= n["latin"] + n["cyrillic"] and n["han"] >= 2:
        return "zh"
    top = max(n, key=n.get)
    if top != "latin":
        return {"han": "zh", "hangul": "ko", "cyrillic": "ru", "arabic": "ar"}.get(top, top)
    words = [w.lower() for w in _WORD.findall(text)]
    score = {lang: sum(w in known for w in words) for lang, known in _KNOWN.items()}
    best = max(score, key=score.get)
    return best if score[best] >= 2 and score[best] > score["en"] else "en" if score["en"] or len(words) < 12 else best


_KNOWN = {k: set(v) for k, v in WORDS.items()}


def tiled(answer: str, query: str, least: int = 3) -> list[tuple[int, int]]:
    """Greedy string tiling: spans of the answer, longest first, each matched by a span of the query.

    A span of either text is used once; repeats of the whole query are tiled in turn.
    """
    spans: list[tuple[int, int]] = []
    free = [(0, len(answer))]
    rounds = len(answer) // max(1, len(query)) + 1
    for _ in range(rounds):
        unused = [(0, len(query))]
        while unused and free:
            best = (0, 0, 0, None, None)
            for fa in free:
                for fq in unused:
                    m = _longest(answer[fa[0] : fa[1]], query[fq[0] : fq[1]])
                    if m[0] > best[0]:
                        best = (m[0], fa[0] + m[1], fq[0] + m[2], fa, fq)
            size, a, q, fa, fq = best
            if size < least:
                break
            spans.append((a, a + size))
            free.remove(fa)
            free += [x for x in ((fa[0], a), (a + size, fa[1])) if x[1] - x[0] >= least]
            unused.remove(fq)
            unused += [x for x in ((fq[0], q), (q + size, fq[1])) if x[1] - x[0] >= least]
    return spans


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """Length and starts of the longest common substring, by extension of matches."""
    if x in y:
        return len(x), 0, y.index(x)
    if y in x:
        return len(y), x.index(y), 0
    best = (0, 0, 0)
    i = 0
    while i + best[0] < len(x):
        n = best[0] + 1
        at = y.find(x[i : i + n])
        if at < 0:
            i += 1
            continue
        while i + n < len(x) and (to := y.find(x[i : i + n + 1])) >= 0:
            n, at = n + 1, to
        best = (n, i, at)
        i += 1
    return best


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    return letters(canonical(text)) in FILLERS


def is_copy(answer: str, query: str) -> bool:
    """Nothing of the answer but the query, apart from a few letters; the answer adds no figure."""
    a, q = letters(answer), letters(query)
    if len(q) < 4 or len(a) < 0.6 * len(q):
        return False
    rest, at = [], 0
    for start, end in sorted(tiled(a, q)):
        rest.append(a[at:start])
        at = end
    left = "".join([*rest, a[at:]])
    whole = q in a
    return not any(c.isdigit() for c in left) and len(left) <= (0.3 if whole else 0.12) * len(a)


_SENTENCE = re.compile(r"(?<=[。！？!?\n])|(?<=\.)\s+")


def is_refusal(answer: str) -> bool:
    # The whole text as well: a refusal may run over a mark that looks like a sentence end.
    pieces = [answer.strip(), *(x.strip() for x in _SENTENCE.split(answer))]
    return any(REFUSAL_ZH.search(x) or REFUSAL_EN.search(x) for x in pieces)


_CLOSE = dict(zip("([{（【《〈「『“‘«", ")]}）】》〉」』”’»", strict=True))
_OPENERS = {v: k for k, v in _CLOSE.items()}
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,2}[.)、]|（?[一二三四五六七八九十]{1,2}[）、])\s*$")


def left_open(text: str) -> bool:
    """Pushdown parse: whether a fence, formula, bracket, quotation, tag or list item stays open at the end."""
    stack: list[str] = []
    lines = text.split("\n")
    if len(lines) > 1 and _ITEM.match(lines[-1]) or text.count("```") % 2:
        return True
    i, straight = 0, 0
    while i < len(text):
        ch = text[i]
        if ch == "<" and (m := _TAG.match(text, i)):
            name = m.group(2).lower()
            if m.group(1):
                if f"<{name}" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}") :]
            elif not m.group(3) and name not in _VOID:
                stack.append(f"<{name}")
            i = m.end()
            continue
        if text.startswith("\\begin{", i):
            stack.append("\\begin")
        elif text.startswith("\\end{", i) and "\\begin" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("\\begin") :]
        elif ch in _CLOSE:
            if not (ch == "‘" and text[i - 1 : i].isalpha()):
                stack.append(ch)
        elif ch in _OPENERS:
            if _OPENERS[ch] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_OPENERS[ch]) :]
            elif ch in ")）" and {"(", "（"} & {*stack}:  # brackets of mixed width close one another
                while stack and stack.pop() not in "(（":
                    pass
        elif ch == '"':
            straight += 1
        i += 1
    return bool(stack) or bool(straight % 2)


_FINAL = re.compile("[。！？!?.][”’\"')）】»]*$")
_HANGING = re.compile("[,，、;；:：(（\\[【{<《“‘«\\-–—/&+=]$|[^.…。！？!?](?:…|\\.\\.\\.|……)$")


_CUT_FIGURE = re.compile(r"\d\.$")


def end_state(answer: str) -> str:
    """`open` if the end shows a break, `final` if a final mark closes it, else `bare`.

    A point after a digit closes no Chinese sentence: the figure goes on.
    """
    text = canonical(answer).rstrip()
    if left_open(text) or _HANGING.search(text) or _CUT_FIGURE.search(text) and language(text) == "zh":
        return "open"
    return "final" if _FINAL.search(text) else "bare"


def row_defect(query: str | None, answer: str | None) -> str | None:
    """The defect that shows in the pair alone; `bare` where only the table can tell whether it ends."""
    if is_empty(answer):
        return "empty"
    answer, query = canonical(answer), canonical(query or "")
    if is_copy(answer, query):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    asked, told = language(query), language(answer)
    if asked and told and asked != told:
        return "other_language"
    state = end_state(answer)
    return {"open": "truncated", "bare": "bare"}.get(state)


_NUMBER = re.compile(r"\d[\d,.]*\d|\d")


def masked(text: str) -> str:
    """Consistent form with every figure as one sign, without blanks around."""
    return _NUMBER.sub("#", canonical(text).strip())


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        defects = [row_defect(q, a) for q, a in zip(batch["query"], batch["answer"], strict=True)]
        usable = [d in (None, "bare", "truncated") for d in defects]
        yield pd.DataFrame({"item": batch["item"], "defect": defects, "m": [masked(a) if u else None for a, u in zip(batch["answer"], usable, strict=True)]})


_ENDS = re.compile(r"[。！？!?]|\.(?= |$)")


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by batch of every context of every answer, and of those at which a sentence ends."""
    for batch in batches:
        total: Counter = Counter()
        ends: Counter = Counter()
        for m in batch["m"]:
            last = {x.start() for x in _ENDS.finditer(m)} | {len(m)}
            for n in CONTEXTS:
                total.update(m[i - n : i] for i in range(n, len(m) + 1))
                ends.update(m[i - n : i] for i in last if i >= n)
        yield pd.DataFrame([(h, n, ends.get(h, 0)) for h, n in total.items()], columns=["h", "total", "ends"])


def _cut_short(judged: DataFrame) -> DataFrame:
    """(item): bare answers whose end is not one at which sentences of the table end."""
    said = judged.filter("m is not null").select("m").distinct()  # repeated answers count once
    bare = judged.filter("defect = 'bare'").select("item", "m")
    sizes = F.explode(F.array(*[F.lit(n) for n in CONTEXTS]))
    wanted = bare.select("item", F.length("m").alias("size"), F.substring("m", -max(CONTEXTS), max(CONTEXTS)).alias("tail"), sizes.alias("n")).filter("n <= size")
    wanted = wanted.select("item", "n", F.expr("right(tail, n)").alias("h"))
    seen = said.mapInPandas(_contexts, "h string, total bigint, ends bigint").groupBy("h").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    # The answer itself is one of the ends counted.
    known = wanted.join(seen, "h").filter(F.col("total") > LEAST_SEEN)
    longest = known.groupBy("item").agg(F.max_by(F.struct("total", "ends"), "n").alias("x"))
    share = (F.col("x.ends") - 1) / (F.col("x.total") - 1)
    told = bare.select("item").join(longest, "item", "left")
    # An end that the table never shows decides nothing by itself.
    return told.filter(F.col("x").isNotNull() & (share < COMPLETE_SHARE)).select("item")


def answer_defects(df: DataFrame, key: str, query: str, answer: str) -> DataFrame:
    """(item_id, defect): the defective pairs, one row each.

    A null or blank answer is empty; a null query only rules out copies and
    other languages; repeated pairs are judged alike; an empty table gives an
    empty result. Columns other than the three named are ignored.
    """
    pairs = df.select(df[key].alias("item"), df[query].cast("string").alias("query"), df[answer].cast("string").alias("answer"))
    judged = cut(pairs.mapInPandas(_judge, "item bigint, defect string, m string"), "answers")
    plain = judged.filter("defect is not null and defect <> 'bare'").select(F.col("item").alias("item_id"), "defect")
    return plain.unionByName(_cut_short(judged).select(F.col("item").alias("item_id"), F.lit("truncated").alias("defect")))
