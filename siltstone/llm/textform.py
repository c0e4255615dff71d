"""One consistent character form for text that looks alike.

A quick check finds the segments that may be out of form: characters that
normalization changes or may compose, as the character database says of each,
and odd blanks, invisible characters, and letters of other scripts. Only these
segments, widened to the whole word they touch, are normalised; the canonical
segments are spliced into the unchanged rest.

The form: ASCII where ASCII has the letter, digit or sign, except for the
Chinese marks in KEPT_MARKS; composed accents; unified ideographs; ordinary
blank, tab and newline only; nothing invisible; Latin words in Latin letters.
Characters that look different from their plain twin stay: raised, lowered and
circled ones, fractions, unit squares, and signs of several marks such as `…`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of Chinese typography that stay full-width.
KEPT_MARKS = "，：；！？（）"

# Ranges of blanks and of invisible characters.
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\r\u000b\u000c\u0085\u2028\u2029"
INVISIBLE = (
    "\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5"
    "\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb"
    "\U000e0000-\U000e01ef"
)
#: Marks that stand on the letter before them.
MARKS = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
#: Scripts with letters that pass for Latin: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
OTHER_LETTERS = "\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u13a0-\u13f5\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4f7"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"

# Look-alike letters by script and the Latin letters they resemble, from the Unicode table of confusables.
_PAIRS = (
    ("АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxijshdqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"),
    ("օսոռհցզգյաՏՕՍԼ", "ounnhgqqjwSOUL"),
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"),
    ("ⲞⲟⲢⲣⲤⲥⲦⲔⲎⲘⲚⲬⲀ", "OoPpCcTKHMNXA"),
    ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
)
ALIKE = str.maketrans("".join(x for x, _ in _PAIRS), "".join(y for _, y in _PAIRS))
# Letters that pass for Latin only inside a Latin word.
ALIKE_IN_WORD = str.maketrans("вкмнтгпи" + "ανικρτυχγ", "bkmhtrnu" + "avikptuxy")

# Radicals of the CJK supplement and the unified ideographs they show.
RADICALS = str.maketrans(
    "⺁⺅⺆⺇⺉⺊⺋⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺻⺼⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
    "厂亻冂几刂卜㔾兀尣尢巳幺彑彐忄㣺扌攵旡月歺母民氵氺灬爫爫丬牛犭王疋示礻竹糹纟罓罒羊耂肀聿肉艹艹艹虎衤覀西见角讠贝足车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟",
)

#: Kinds of compatibility characters that look different from their plain form.
DIFFERENT = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>"}


def plain_form(ch: str) -> str:
    """What one character becomes by itself; most stay."""
    if ch in KEPT_MARKS:
        return ch
    if ord(ch) in RADICALS:
        return ch.translate(RADICALS)
    parts = unicodedata.decomposition(ch)
    if not parts:
        return ch
    kind = parts.split(" ", 1)[0] if parts[0] == "<" else ""
    if kind in DIFFERENT:
        return ch
    to = unicodedata.normalize("NFKC" if kind else "NFC", ch)
    return ch if kind == "<compat>" and not to.isalnum() and len(to) > 1 else to


def _ranges(codes: Iterable[int]) -> str:
    """Codes in ascending order as the inside of a character class."""
    out: list[list[int]] = []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


def _quick_check() -> tuple[str, str]:
    """(changed, composing): characters whose quick check says no, and those that may compose with one before them."""
    no, maybe = [], set()
    for code in (*range(0xA0, 0xD800), *range(0xE000, 0x32000)):
        ch = chr(code)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and " " in parts:
            maybe.add(int(parts.split(" ")[1], 16))
        if (parts or code in RADICALS) and plain_form(ch) != ch:
            no.append(code)
    return _ranges(no), _ranges(sorted(maybe | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}))


COMPATIBLE, COMPOSING = _quick_check()
_UNSTABLE = re.compile(f"[{BLANKS}{INVISIBLE}{COMPATIBLE}{MARKS}{COMPOSING}{OTHER_LETTERS}]")
#: In the basic plane exactly the unstable characters; all beyond it, since matching slows with every range there.
UNSTABLE = _ranges(code for code in range(0x10000) if _UNSTABLE.match(chr(code))) + "\U00010000-\U0010ffff"
#: Blocks of common characters, from which those that are unstable are taken out.
_COMMON = ((0x09, 0x0A), (0x20, 0x7E), (0xA1, 0xFF), (0x2010, 0x2027), (0x2030, 0x203F), (0x2190, 0x22FF), (0x2460, 0x24FF), (0x2500, 0x25FF), (0x3001, 0x301F), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_STABLE = _ranges(code for a, b in _COMMON for code in range(a, b + 1) if not _UNSTABLE.match(chr(code))) + KEPT_MARKS
#: Quick check of a text, in the syntax that Java and Python share: a character that isn't known to be stable.
QUICK_CHECK = f"[^{_STABLE}]"
_SEGMENT = re.compile(f"(?:(?<![{LATIN}])[{LATIN}]+)?[{UNSTABLE}][{LATIN}{UNSTABLE}]*")
_ONLY_BLANK = re.compile(f"[{BLANKS}]+")
_WORD = re.compile(f"[{LATIN}{OTHER_LETTERS}{MARKS}]+")
_LEFT, _RIGHT = re.compile(f"({_WORD.pattern[:-1]}{{2,}}) $"), re.compile(f" ({_WORD.pattern[:-1]}{{2,}})")
_OTHER = re.compile(f"[{OTHER_LETTERS}]")
_LATIN = re.compile(f"[{LATIN}]")
_MARK = re.compile(f"[{MARKS}{COMPOSING}]")


class _Table(dict):
    """Translation by rule, filled as characters come up."""

    blank = re.compile(f"[{BLANKS}]")
    gone = re.compile(f"[{INVISIBLE}]")
    odd = re.compile(f"[{COMPATIBLE}]")

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in "\r\u0085\u2028\u2029\u000b\u000c":
            to = "\n" if ch != "\r" else "\r"
        elif self.blank.match(ch):
            to = " "
        elif self.gone.match(ch):
            to = ""
        elif self.odd.match(ch):
            to = plain_form(ch)
        else:
            to = ch
        self[code] = to
        return to


_TABLE = _Table()


def _real_word(word: str) -> bool:
    """A word of another script, that is, with a letter that has no Latin look-alike."""
    return bool(_OTHER.search(word.translate(ALIKE)))


def _latin_word(word: str, before: str, after: str) -> str:
    """word with look-alike letters in Latin, unless it belongs to another script."""
    if not _OTHER.search(word):
        return word
    swapped = word.translate(ALIKE)
    if _LATIN.search(word):
        if len(_LATIN.findall(word)) >= 3:
            swapped = swapped.translate(ALIKE_IN_WORD)
        return swapped
    if _OTHER.search(swapped):
        return word
    near = [m.group(1) for m in (_LEFT.search(before), _RIGHT.match(after)) if m]
    return word if any(_real_word(x) and not _LATIN.search(x) for x in near) else swapped


def _fix(match: re.Match) -> str:
    segment = match.group()
    if _ONLY_BLANK.fullmatch(segment) and "\r" not in segment:
        return segment.translate(_TABLE)
    text = segment.translate(_TABLE)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n" if match.string[match.end() : match.end() + 1] != "\n" else "")
    if _OTHER.search(text):
        whole, a, b = match.string, match.start(), match.end()
        before, after = whole[max(0, a - 24) : a].translate(_TABLE), whole[b : b + 24].translate(_TABLE)
        text = _WORD.sub(lambda m: _latin_word(m.group(), before + text[: m.start()], text[m.end() :] + after), text)
    if _MARK.search(text):
        left = match.string[match.start() - 1 : match.start()]
        if left and _MARK.match(text[0]):  # the mark joins the character before the segment
            text = unicodedata.normalize("NFC", text)
            return text if unicodedata.normalize("NFC", left + text[0]) == left + text[0] else "\u0000" + text
    return unicodedata.normalize("NFC", text)


_JOIN = re.compile("(.)\u0000([^\u0000]*)", re.S)


def canonical(text: str | None) -> str | None:
    """text in the consistent form; None stays None."""
    if not text:
        return text
    out = _SEGMENT.sub(_fix, text)
    if "\u0000" in out:
        out = _JOIN.sub(lambda m: unicodedata.normalize("NFC", m.group(1) + m.group(2)), out)
    return out


@F.pandas_udf(T.StringType())
def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical, na_action="ignore")


def consistent(text: Column) -> Column:
    """text in the consistent form.

    Texts that pass the quick check never leave the JVM: the Python side gets
    null for them. Null gives null, the empty text the empty text.
    """
    return F.coalesce(_canonical_batches(F.when(text.rlike(QUICK_CHECK), text)), text)


def normalise(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """df with the column `out`, the consistent form of the column `text`.

    Null and empty texts stay as they are; any other columns pass through. An
    existing column `out` is replaced.
    """
    return df.withColumn(out, consistent(df[text]))


def changed(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of rows whose text is not in the consistent form, once each.

    Rows with null or blank text (blank in any character form) never count.
    """
    kept = df.select(df[key].alias("row_key"), df[text].alias("_text"))
    kept = kept.filter(kept._text.rlike(QUICK_CHECK) & kept._text.rlike(f"[^\\s{BLANKS}{INVISIBLE}]"))
    kept = kept.withColumn("_form", _canonical_batches("_text"))
    return kept.filter("_form <> _text").select("row_key").distinct()
