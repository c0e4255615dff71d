"""Text expressions: tokens, cleaning, extraction, classification. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and what is deleted before it applies.
DELETED = r"[^\p{L}\p{N}_\s\p{Z}]"
TOKEN = r"[a-zA-Z]+|[一-龥]|[0-9]+"
# Boilerplate that marks a chunk as noise.
NOISE_WORDS = ("本报告采用基本无氯气漂染纸浆", "年报封面", "封面由AI工具", "中式卷轴徐徐展开", "书写壮丽诗篇", "环保纸印刷", "目录", "释义")
# Kinds of institution in file names and lines.
INSTITUTIONS = ("证券", "研究所", "投顾", "基金", "资管")
# Lines that are no titles, and words that make a title likely.
NO_TITLE = ("请务必阅读正文之后的免责条款部分", "风险提示", "目录", "证券研究报告", "行业评级", "投资评级")
TITLE_WORDS = ("深度", "专题", "点评", "研究", "报告", "行业", "公司", "策略", "跟踪")
# The company patterns, in order.
COMPANY = (
    r"([一-龥A-Za-z]{2,20}(?:银行|证券|集团|股份|科技|信息|药业|电子|能源|通信|汽车|工业|软件|智能|航空|半导体))",
    r"([一-龥]{2,12})（\d{6}(?:\.SH|\.SZ)?）",
    r"([一-龥]{2,12})\(\d{6}(?:\.SH|\.SZ)?\)",
)


def tokens(text: Column) -> Column:
    """Lower-case words, single ideographs and numbers; punctuation is deleted, so it joins its sides."""
    flat = F.lower(F.trim(F.translate(text, "\n", " ")))
    return F.regexp_extract_all(F.regexp_replace(flat, DELETED, ""), F.lit(f"({TOKEN})"), F.lit(1))


def clean(text: Column) -> Column:
    """No-break blanks to blanks, runs of blanks to one, at most one empty line, trimmed."""
    out = F.regexp_replace(F.translate(text, "\u00a0", " "), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """Runs of white space to one blank, control characters removed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " "), r"[\x00-\x08\x0e-\x1b]", ""))


def before_split(text: Column) -> Column:
    """Cleaning ahead of chunking: rulers of `=` and lone `n / m` lines go, empty lines shrink."""
    out = F.translate(text, "\u00a0", " ")
    out = F.regexp_replace(out, r"(?m)^\s*=+\s*$", "")
    out = F.regexp_replace(out, r"(?m)^\s*\d+\s*/\s*\d+\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cell(text: Column) -> Column:
    """A table cell for one Markdown row; null gives the empty text."""
    out = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("<br>")), "[ \t]+", " "))
    return F.replace(out, F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table, the first row as its head; ragged rows are padded, blank ones dropped."""
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(kept, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), line)
    return F.when(F.size(kept) > 0, F.array_join(F.concat(F.array(line(kept[0]), ruler), body), "\n")).otherwise("")


def valid_share(text: Column) -> Column:
    """Share of letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).cast("double") / F.length(text)


def is_noise(text: Column) -> Column:
    """Too short, boilerplate, or mostly signs. Null is noise."""
    t = clean(F.coalesce(text, F.lit("")))
    return (F.length(t) < 30) | t.rlike("|".join(NOISE_WORDS)) | (valid_share(t) < 0.45)


def is_page_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^(?:\d{1,3}|-\s*\d{1,3}\s*-|第\s*\d+\s*页)$")


def report_date(text: Column) -> Column:
    """The first date, yyyy-mm-dd; the calendar is not checked. Null without a date."""
    parted = r"(20\d{2})[-/\.年](\d{1,2})[-/\.月](\d{1,2})日?"
    packed = r"(20\d{2})(\d{2})(\d{2})"
    form = lambda p: F.when(text.rlike(p), F.concat_ws("-", F.regexp_extract(text, p, 1), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 3), 2, "0")))
    return F.coalesce(form(parted), form(packed))


def broker(stem: Column) -> Column:
    """The institution that a file name begins with, or any securities house in it."""
    first = F.trim(F.split(stem, "[_\\-—]+")[0])
    named = first.rlike("|".join(INSTITUTIONS)) & F.length(first).between(2, 20)
    return F.when(named, first).otherwise(F.nullif(F.regexp_extract(stem, r"([一-龥A-Za-z]{2,20}证券)", 1), F.lit("")))


def company(title: Column, text: Column) -> Column:
    """The first company pattern in the title, else in the first 3000 characters of the text."""
    found = [F.nullif(F.regexp_extract(src, p, 1), F.lit("")) for src in (title, F.substring(text, 1, 3000)) for p in COMPANY]
    return F.coalesce(*found)


def title(text: Column) -> Column:
    """A likely title among the first 80 lines: with a title word, else the first candidate."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), clean), lambda x: x != ""), 1, 80)
    bad = "|".join(NO_TITLE)
    fits = lambda x: (
        F.length(x).between(6, 40)
        & ~is_page_number(x)
        & report_date(x).isNull()
        & ~x.rlike(bad)
        & ~x.rlike(r"^[一-龥A-Za-z]{2,20}(?:证券|研究所|基金|资管)$")
    )
    candidates = F.filter(lines, fits)
    liked = F.filter(candidates, lambda x: x.rlike("|".join(TITLE_WORDS)))
    return F.coalesce(F.get(liked, F.lit(0)), F.get(candidates, F.lit(0)))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case, trimmed, white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def redacted(text: Column, n: int = 1000) -> Column:
    """Secrets masked, at most n characters."""
    return F.substring(F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1***"), 1, n)


def unfenced(text: Column) -> Column:
    """The inside of a code fence, for parsing as JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^`+|`+$", ""), "^json", ""))


def chunk_key(source: Column, page: Column, text: Column) -> Column:
    """A key made from source, page and content, for chunks without an id."""
    return F.concat(source, F.lit("::page_"), page.cast("string"), F.lit("::chunk_"), F.substring(F.md5(text), 1, 12))


# Marks dropped before intents are told apart, questions about the assistant, and questions without a subject.
INTENT_MARKS = r"[？?！!，,。.；;：:\s\p{Z}]+"
CHAT = ("你是谁", "你是什么模型", "介绍一下你自己", "请介绍.*你自己", "你好", "您好", "hello", r"(?:^|[^\p{L}\p{N}_])hi(?:$|[^\p{L}\p{N}_])", "你能做什么")
UNCLEAR = ("这个怎么样", "这个呢", "那这个呢", "那它呢", "这个公司怎么样")


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def intent(query: Column) -> Column:
    """chat, unclear or rag_qa: patterns are looked for in the query and in its bare form, where a wildcard bridges nothing."""
    raw = F.lower(stripped(F.coalesce(query, F.lit(""))))
    bare = F.regexp_replace(raw, INTENT_MARKS, "")
    tight = lambda patterns: "|".join(p.replace(".*", "") for p in patterns)
    chat = bare.rlike(tight(CHAT)) | raw.rlike("|".join(CHAT))
    return F.when(chat, "chat").when(bare.rlike(tight(UNCLEAR)) | (F.length(bare) <= 2), "unclear").otherwise("rag_qa")


# Words that lean on what was said before, and words of tasks with several parts.
LEANING = "它 他 她 他们 她们 它们 这家 那家 该公司 其 这个 那个 前者 后者 那 那么 然后 再 接着 另外 还有 以及 如何 多少 吗".split()
COMPLEX = "对比 比较 分别 各自 汇总 总结 筛选 排除 不包括 除了 排名 前五 前十 top bottom 比 较 更 多 少".split()
# What names a company, and what names a figure.
SUBJECTS = "公司|集团|银行|证券|保险|科技|信息|股份|控股|有限"
FIGURES = "营收|收入|利润|净利润|归母净利润|毛利率|净利率|同比|环比|估值|PE|PB|ROE|现金流|资产负债率"


def stands_alone(query: Column) -> Column:
    """Names both a company and a figure."""
    return query.rlike(SUBJECTS) & query.rlike(FIGURES)


def needs_rewriting(query: Column) -> Column:
    """Leans on earlier questions, has several parts, or is long without standing alone. Null and blank never do."""
    q = stripped(F.coalesce(query, F.lit("")))
    return (q != "") & (q.rlike("|".join(LEANING)) | q.rlike("|".join(COMPLEX)) | ((F.length(q) > 15) & ~stands_alone(q)))


def block_type(text: Column, y0: Column, height: float) -> Column:
    """header or footer by the block's upper edge, else title by its form, else text."""
    capitals = (text == F.upper(text)) & text.rlike(r"\p{Lu}")
    numbered = text.rlike(r"^(?:[一二三四五六七八九十\p{Nd}]+[、.]|第[一二三四五六七八九十\p{Nd}]+[章节])")
    title = (F.length(text) < 50) & (capitals | numbered)
    return F.when(y0 < height * 0.08, "header").when(y0 > height * 0.92, "footer").when(title, "title").otherwise("text")


def joined_spans(spans: Column) -> Column:
    """An array of texts as one line: no blank between two ideographs, else one."""
    han = r"^[\u4e00-\u9fff]"
    glue = lambda t, x: F.when(t == "", x).when(F.right(t, F.lit(1)).rlike(han) & x.rlike(han), F.concat(t, x)).otherwise(F.concat(t, F.lit(" "), x))
    return stripped(F.aggregate(F.filter(spans, lambda x: x != ""), F.lit(""), glue))


def is_bold(flags: Column, font: Column) -> Column:
    return F.contains(F.lower(F.coalesce(font, F.lit(""))), F.lit("bold")) | (flags.bitwiseAND(16) != 0)


def is_italic(flags: Column, font: Column) -> Column:
    return F.lower(F.coalesce(font, F.lit(""))).rlike("italic|oblique") | (flags.bitwiseAND(2) != 0)


def plain_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table, cells trimmed only: neither padded nor escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: stripped(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(rows[0])), " | "), F.lit(" |"))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), ruler), rest), "\n")).otherwise("")


def with_sources(answer: Column, sources: Column) -> Column:
    """The answer with its list of sources, unless it names them itself."""
    return F.when(F.contains(answer, F.lit("来源")), answer).otherwise(F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\n来源：\n"), sources))


def first_key(own: Column, other: Column, made: Column) -> Column:
    """The first of three keys that is neither null nor empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")), made)


def selection(text: str, most: int) -> list[int]:
    """Places chosen by digits alone (`123`) or by a list (`1,3,5`), within 1 to `most`, each once, in the order given."""
    parts = text.replace("，", ",").split(",") if "," in text or "，" in text else list(text)
    chosen = (int(p) for p in map(str.strip, parts) if p.isdigit())
    return list(dict.fromkeys(n for n in chosen if 1 <= n <= most))
