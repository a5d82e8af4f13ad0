"""Text expressions: hashing, tokens, shingles, previews. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same in Java and in other Unicode regex engines.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
HAN_OR_KANA = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"

# ASCII punctuation removed before answers are compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Words and word pairs that carry no search meaning.
QUERY_STOPWORDS = (
    "用户", "助手", "我们", "他们", "这个", "那个", "什么", "如何", "是否",
    "有没", "没有", "有过", "做过", "进行", "完成", "包括", "通过", "实现",
    "行为", "内容", "相关", "情况", "问题", "方式", "时候", "时间", "目前",
    "当前", "最近", "之前", "以前", "后来", "然后", "因为", "所以", "但是",
    "用户在", "用户对", "的行为吗", "进行了",
)


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+\\z", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, f"{SPACE}+\\z", "")


def squash(col: Column, by: str = " ") -> Column:
    """Replace every run of white space."""
    return F.regexp_replace(col, f"{SPACE}+", by)


def present(col: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def lines(col: Column) -> Column:
    """Lines of a text; a final line break adds no empty line."""
    parts = F.split(col, LINE_BREAK, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def content_hash(text: Column, kind: Column) -> Column:
    """Identity of a memory text within its type."""
    return F.substring(F.sha2(F.concat(squash(strip(F.lower(text))), kind), 256), 1, 16)


def stable_id(prefix: str, length: int, *parts: Column, sep: str = ":", digest: str = "sha1") -> Column:
    """`prefix` plus the first `length` hex digits of a digest over the joined parts."""
    joined = F.concat_ws(sep, *parts)
    value = F.sha1(joined) if digest == "sha1" else F.sha2(joined, 256)
    return F.concat(F.lit(prefix), F.substring(value, 1, length))


def characters(col: Column) -> Column:
    """Code points of a text as an array."""
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(F.split(col, ""))


def pairs(chars: Column) -> Column:
    """Adjacent pairs of an array of characters."""
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))


def char_bigrams(col: Column) -> Column:
    """Set of two-character shingles of the lower-cased text without white space."""
    return F.array_distinct(pairs(characters(squash(F.lower(col), ""))))


def bm25_tokens(col: Column) -> Column:
    """Words of two or more characters, then per Han run its characters, pairs and (if short) itself."""
    raw = F.lower(F.coalesce(col, F.lit("")))
    words = F.filter(
        F.regexp_extract_all(raw, F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), 0), lambda w: F.length(w) >= 2
    )
    none = F.array().cast("array<string>")

    def pieces(run: Column) -> Column:
        chars = characters(run)
        whole = F.when(F.length(run) <= 8, F.array(run)).otherwise(none)
        return F.concat(chars, pairs(chars), whole)

    runs = F.regexp_extract_all(raw, F.lit(f"{HAN}+"), 0)
    return F.concat(words, F.flatten(F.transform(runs, pieces)))


def query_terms(col: Column, limit: int = 20) -> Column:
    """Distinct search terms of a question, at most `limit`."""
    ascii_terms = F.regexp_extract_all(col, F.lit(r"[a-zA-Z0-9_.\-]{2,}"), 0)
    runs = F.regexp_extract_all(col, F.lit(HAN_OR_KANA + "{2,}"), 0)
    grams = F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(pairs(characters(r))))
    )
    stop = F.array(*[F.lit(w) for w in QUERY_STOPWORDS])
    kept = F.filter(grams, lambda g: ~F.array_contains(stop, g))
    return F.slice(F.array_distinct(F.concat(ascii_terms, kept)), 1, limit)


def catalog_keywords(col: Column) -> Column:
    """Whole string, words, script segments, Han characters and Han pairs of a query."""
    low = strip(F.lower(col))
    words = F.split(low, f"{SPACE}+")
    segments = F.transform(F.regexp_extract_all(low, F.lit(f"{HAN}+|[^\\x{{4E00}}-\\x{{9FFF}}]+"), 0), strip)
    han = characters(F.regexp_replace(low, "[^\\x{4E00}-\\x{9FFF}]", ""))
    every = F.array_distinct(F.concat(F.array(low), words, segments, han, pairs(han)))
    return F.filter(every, lambda k: k != "")


def qa_normalize(col: Column) -> Column:
    """Lower case, no ASCII punctuation, single blanks."""
    return strip(squash(F.translate(F.lower(col), PUNCTUATION, "")))


def qa_tokens(col: Column) -> Column:
    text = qa_normalize(col)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def preview(col: Column, limit: int) -> Column:
    """One-line preview with an ellipsis when cut."""
    compact = strip(squash(col))
    cut = F.concat(rstrip(F.substring(compact, 1, max(0, limit - 1))), F.lit("…"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def line_preview(col: Column, max_lines: int = 50) -> Column:
    """First lines of a text and the number of lines left out."""
    every = lines(col)
    head = F.array_join(F.slice(every, 1, max_lines), "\n")
    rest = (F.size(every) - max_lines).cast("string")
    return F.when(
        F.size(every) > max_lines, F.concat(head, F.lit("\n...[已截断，剩余 "), rest, F.lit(" 行]"))
    ).otherwise(head)


def head_tail(col: Column, budget: int = 10_000) -> Column:
    """Keep head and tail of a long text around a marker that names the cut length.

    The marker counts towards the budget and its own length depends on the number in it. The
    number settles after at most three steps, because only its digit count matters.
    """
    size = F.length(col)

    def marker(omitted: Column) -> Column:
        return F.concat(F.lit("…"), omitted.cast("string"), F.lit(" chars truncated…"))

    omitted = size - budget
    for _ in range(3):
        omitted = size - F.greatest(F.lit(0), F.lit(budget) - F.length(marker(omitted)))
    keep = size - omitted
    head = F.floor(keep / 2).cast("int")
    tail = keep - head
    body = F.concat(
        F.substring(col, F.lit(1), head), marker(omitted), F.substring(col, size - tail + 1, tail)
    )
    note = F.concat(F.lit("Total output lines: "), F.size(lines(col)).cast("string"), F.lit("\n\n"))
    return F.when(size <= budget, col).otherwise(F.concat(note, body))


def token_estimate(col: Column, chars_per_token: int) -> Column:
    """Token count guessed from the length, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(col) / chars_per_token)).cast("bigint")


def user_clauses(col: Column) -> Column:
    """Distinct clauses of four or more characters from the lines a user spoke, in order."""
    spoken = F.transform(
        lines(col), lambda line: strip(F.regexp_extract(strip(line), r"(?i)\bUSER:\s*(.+)$", 1))
    )
    parts = F.flatten(F.transform(spoken, lambda t: F.split(t, r"[。！？；;.!?，,]\s*")))
    clean = F.transform(parts, strip)
    return F.array_distinct(F.filter(clean, lambda c: F.length(c) >= 4))
