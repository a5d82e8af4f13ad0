"""From hits to context: parent expansion, context packing, injection quotas, citations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.windows import top_rows

# Heading of a packed context block. Its length counts towards the budget.
CONTEXT_HEADER = (
    "## Document Knowledge（文档知识）",
    "",
    "以下内容来自本地文档检索结果。回答涉及这些内容时，请优先依据这些片段，并在相关句子后标注引用编号，例如 [K1]。如果片段不足以支持答案，请说明信息不足，不要编造。",
)
ENTRY_CHARS = 900

# Headings of the three memory sections.
FORCED_HEADER = "## 【强制约束】记忆规则（必须执行）"
RULES_HEADER = "## 【流程规范】用户偏好与规则"
EVENTS_HEADER = (
    "## 【相关历史】你与当前用户的过往对话（来自记忆检索，时间戳可信，可直接引用，不得自行否定；"
    "数字/金额/地名等具体值以记录为准，不得用常识替换；可根据上下文合理推断，如去某城市探望姐姐可推断姐姐住在该城市）"
)
UNSURE = "有印象，不确定"
LOW_CONFIDENCE_WORDS = ("未在对话中明确记录", "无法凭记忆确认", "没有记录", "真的没有", "未找到", "不确定")


def expand_to_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replace child hits (query_id, id, parent_id, chunk_type, score) by their parent chunks.

    A hit whose parent is unknown stands for itself (`fallback`). Scores are pooled with max; the
    matched children are listed in order of score. `chunks` has (id, parent_id, chunk_type, text).
    """
    links = chunks.filter(F.col("parent_id").isNotNull()).select(
        F.col("id").alias("id"), F.col("parent_id").alias("linked_parent")
    )
    known = hits.join(links, "id", "left").withColumn(
        "wanted",
        F.when(tx.present(F.col("parent_id")).isNotNull(), F.col("parent_id")).when(
            F.col("chunk_type") == "child", F.col("linked_parent")
        ),
    )
    parents = chunks.select(F.col("id").alias("parent_key"), F.col("text").alias("parent_text"))
    joined = known.join(parents, known["wanted"] == parents["parent_key"], "left")
    keyed = joined.select(
        "query_id",
        F.coalesce("parent_key", "id").alias("key"),
        F.struct(-F.col("score"), F.col("id")).alias("child"),
        F.col("score"),
        F.col("parent_key").isNull().alias("fallback"),
        F.col("parent_text"),
    )
    return keyed.groupBy("query_id", "key").agg(
        F.max("score").alias("score"),
        F.transform(F.array_sort(F.collect_set("child")), lambda c: c["id"]).alias("matched_child_ids"),
        F.max("fallback").alias("fallback"),
        F.first("parent_text", ignorenulls=True).alias("parent_text"),
    )


def trimmed(text: Column, limit: int = ENTRY_CHARS) -> Column:
    """Text with right-stripped lines, cut with an ellipsis."""
    compact = tx.strip(F.array_join(F.transform(tx.lines(tx.strip(text)), tx.rstrip), "\n"))
    cut = F.concat(tx.rstrip(F.substring(compact, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def pack_context(hits: DataFrame, max_chars: int = 2400) -> DataFrame:
    """Numbered context entries per query up to the character budget.

    `hits` has query_id, id, rank, text, source_path, heading_path, line_start, line_end. Entries
    stop at the first one that would exceed the budget; the heading counts.
    """
    place = tx.strip(
        F.concat(
            F.coalesce("source_path", F.lit("")),
            F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit("#"), "heading_path")).otherwise(""),
            F.when(
                (F.coalesce("line_start", F.lit(0)) > 0) & (F.coalesce("line_end", F.lit(0)) > 0),
                F.concat(F.lit(" 行 "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")),
            ).otherwise(""),
        )
    )
    numbered = hits.withColumn("citation_id", F.concat(F.lit("K"), F.col("rank").cast("string")))
    entry = F.concat(F.lit("\n["), F.col("citation_id"), F.lit("] "), place, F.lit("\n"), trimmed(F.col("text")))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    base = sum(len(p) for p in CONTEXT_HEADER)
    packed = numbered.withColumn("entry", entry).withColumn("used_chars", F.lit(base) + F.sum(F.length("entry")).over(order))
    return packed.filter(F.col("used_chars") <= max(400, max_chars))


def context_block(packed: DataFrame) -> DataFrame:
    """The full context text per query, with the ids it holds."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "entry", "id")))
    grouped = packed.groupBy("query_id").agg(rows.alias("rows"))
    return grouped.select(
        "query_id",
        tx.strip(F.concat_ws("\n", F.lit("\n".join(CONTEXT_HEADER)), F.transform("rows", lambda r: r["entry"]))).alias("block"),
        F.transform("rows", lambda r: r["id"]).alias("injected_ids"),
    )


@dataclass(frozen=True)
class InjectionConfig:
    thresholds: dict = field(
        default_factory=lambda: {"procedure": 0.66, "preference": 0.5, "event": 0.5, "profile": 0.5}
    )
    max_forced: int = 3
    max_rules: int = 4
    max_events: int = 4
    unsure_delta: float = 0.15
    max_chars: int = 6000


def _happened(now: Column) -> tuple[Column, Column]:
    raw = tx.strip(F.coalesce(F.col("happened_at"), F.lit("")))
    at = F.try_to_timestamp(raw)
    plain_day = (F.date_format(at, "HH:mm:ss") == "00:00:00") & ~F.contains(raw, F.lit("T"))
    shown = (
        F.when(raw == "", F.lit(None))
        .when(at.isNull(), raw)
        .when(plain_day, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    )
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at)
    days, hours, minutes = F.floor(seconds / 86400), F.floor(seconds / 3600), F.floor(seconds / 60)
    age = (
        F.when(at.isNull(), F.lit(None))
        .when(days >= 1, F.concat(F.lit("距今约 "), days.cast("string"), F.lit(" 天")))
        .when(hours >= 1, F.concat(F.lit("距今约 "), hours.cast("string"), F.lit(" 小时")))
        .otherwise(F.concat(F.lit("距今约 "), F.greatest(F.lit(0), minutes).cast("string"), F.lit(" 分钟")))
    )
    return shown, age


def _sources() -> Column:
    base = tx.strip(F.element_at(F.split(F.coalesce("source_ref", F.lit("")), "#h:"), 1))
    listed = F.filter(F.from_json(base, "array<string>"), lambda i: i != "")
    ids = F.when(base == "", F.lit(None)).when(F.startswith(base, F.lit("[")), listed).otherwise(F.array(base))
    return F.when(
        F.coalesce(F.size(ids), F.lit(0)) > 0, F.concat(F.lit("(src: "), F.array_join(F.slice(ids, 1, 2), ", "), F.lit(")"))
    )


def select_injection(hits: DataFrame, now: Column, cfg: InjectionConfig = InjectionConfig()) -> DataFrame:
    """Pick memory hits per query by type thresholds and quotas and lay them out as lines.

    `hits`: query_id, id, memory_type, summary, score, happened_at, source_ref, extra_json.
    """
    tool = tx.present(F.get_json_object("extra_json", "$.tool_requirement"))
    limits = F.create_map(*[F.lit(x) for pair in cfg.thresholds.items() for x in pair])
    limit = F.coalesce(F.try_element_at(limits, F.col("memory_type")), F.lit(2.0))
    section = (
        F.when((F.col("memory_type") == "procedure") & tool.isNotNull(), 0)
        .when(F.col("score") < limit, F.lit(None))
        .when(F.col("memory_type").isin("procedure", "preference"), 1)
        .when(F.col("memory_type").isin("event", "profile"), 2)
    )
    placed = hits.withColumn("section", section).filter(F.col("section").isNotNull())
    order = [F.col("score").desc(), F.col("id")]
    quota = F.element_at(F.array(*[F.lit(n) for n in (cfg.max_forced, cfg.max_rules, cfg.max_events)]), F.col("section") + 1)
    most = max(cfg.max_forced, cfg.max_rules, cfg.max_events)
    picked = top_rows(placed, ["query_id", "section"], order, most, "place").filter(F.col("place") <= quota)

    summary = tx.strip(F.coalesce("summary", F.lit("")))
    unsure = F.when((F.col("section") > 0) & (F.col("score") < limit + cfg.unsure_delta), UNSURE).otherwise("")
    shown, age = _happened(now)
    source = _sources()
    weak = (F.col("memory_type") == "preference") & F.rlike("summary", F.lit("|".join(LOW_CONFIDENCE_WORDS)))
    notes = F.array_compact(
        F.array(
            F.nullif(F.col("confidence"), F.lit("")),
            F.when(shown.isNotNull(), F.concat(F.lit("发生于: "), shown)),
            F.when(shown.isNotNull(), age),
            F.when(source.isNotNull(), F.lit("证据: 可回源原文")).otherwise("证据: 记忆摘要"),
            source,
            F.when(weak, F.lit("低置信线索: 不能单独证明历史细节")),
        )
    )
    meta = F.concat(F.lit("（"), F.array_join(notes, "；"), F.lit("）"))
    steps = F.from_json(F.get_json_object("extra_json", "$.steps"), "array<string>")
    step_text = F.when(
        (F.col("memory_type") == "procedure") & (F.coalesce(F.size(steps), F.lit(0)) > 0),
        F.concat(F.lit("（步骤："), F.array_join(steps, "；"), F.lit("）")),
    ).otherwise("")
    head = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] "))
    when = tx.present(F.col("happened_at"))
    line = (
        F.when(F.col("section") == 0, F.concat(head, summary, F.lit("（必须调用工具："), tool, F.lit("）")))
        .when(F.col("section") == 1, F.concat(head, summary, meta, step_text))
        .otherwise(
            F.concat(head, F.when(when.isNotNull(), F.concat(F.lit("["), "happened_at", F.lit("] "))).otherwise(""), summary, meta)
        )
    )
    return picked.withColumn("confidence", unsure).withColumn("line", F.when(summary != "", line))


def inject_block(selected: DataFrame, cfg: InjectionConfig = InjectionConfig()) -> DataFrame:
    """Join the sections per query within the character budget; the forced section is always in.

    A section that does not fit is skipped and the next one is still tried.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "line", F.col("id").alias("id"))))
    parts = selected.filter(F.col("line").isNotNull()).groupBy("query_id", "section").agg(rows.alias("rows"))
    header = F.element_at(F.array(F.lit(FORCED_HEADER), F.lit(RULES_HEADER), F.lit(EVENTS_HEADER)), F.col("section") + 1)
    parts = parts.select(
        "query_id", "section",
        F.concat_ws("\n", header, F.transform("rows", lambda r: r["line"])).alias("part"),
        F.transform("rows", lambda r: r["id"]).alias("ids"),
    )
    by_query = parts.groupBy("query_id").agg(
        *[F.max(F.when(F.col("section") == i, F.struct("part", "ids"))).alias(f"s{i}") for i in range(3)]
    )
    size = [F.coalesce(F.length(F.col(f"s{i}.part")), F.lit(0)) for i in range(3)]
    after0 = size[0]
    take1 = F.col("s1").isNotNull() & (after0 + size[1] + F.when(after0 > 0, 2).otherwise(0) <= cfg.max_chars)
    after1 = after0 + F.when(take1, size[1] + F.when(after0 > 0, 2).otherwise(0)).otherwise(0)
    take2 = F.col("s2").isNotNull() & (after1 + size[2] + F.when(after1 > 0, 2).otherwise(0) <= cfg.max_chars)
    chosen = F.array_compact(
        F.array(F.col("s0"), F.when(take1, F.col("s1")), F.when(take2, F.col("s2")))
    )
    return by_query.withColumn("chosen", chosen).select(
        "query_id",
        F.array_join(F.transform("chosen", lambda c: c["part"]), "\n\n").alias("block"),
        F.array_distinct(F.flatten(F.transform("chosen", lambda c: c["ids"]))).alias("injected_ids"),
    )


def citation_marks(answer: Column) -> Column:
    """Distinct `K<n>` marks of an answer in order of first use."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[K(\d+)\]"), 1)
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("K"), n)))


def validate_citations(df: DataFrame, answer: str = "answer", allowed: str = "citation_ids") -> DataFrame:
    """Add used, valid, missing and unused citation ids and the ok flag."""
    given = F.filter(F.coalesce(F.col(allowed), F.array().cast("array<string>")), lambda c: c != "")
    out = df.withColumn("used_ids", citation_marks(F.col(answer)))
    out = out.withColumn("valid_ids", F.array_intersect("used_ids", given))
    out = out.withColumn("missing_ids", F.array_except("used_ids", given))
    out = out.withColumn("unused_ids", F.array_except(given, "used_ids"))
    return out.withColumn("ok", F.size("missing_ids") == 0)


# Shapes of the citation protocol.
TAG = r"<[a-zA-Z][a-zA-Z0-9_-]*:[^<>\s]+>"
CITED = r"(?i)(?:\r\n|\n)?§cited:\[([A-Za-z0-9_,\-\s]*)\]§((?:\s*" + TAG + r"\s*)*)\z"
TRAILING_TAGS = r"(?:\s*" + TAG + r"\s*)+\z"
INLINE_REF = r"(?i)[ \t]*(?:\[§[A-Za-z0-9:_-]{1,128}\])+"
CALLS = "array<struct<calls:array<struct<name:string,result:string>>>>"
RESULT = "struct<cited_item_ids:array<string>,items:array<struct<id:string>>>"


def extract_cited(df: DataFrame, answer: str = "answer", tool_chain: str = "tool_chain") -> DataFrame:
    """Cited ids from the closing protocol line, else from recall results; plus the clean answer."""
    raw = F.coalesce(F.col(answer), F.lit(""))
    has_line = F.rlike(raw, F.lit(CITED))
    listed = F.filter(F.transform(F.split(F.regexp_extract(raw, CITED, 1), ","), tx.strip), lambda i: i != "")
    tags = tx.strip(F.regexp_extract(raw, CITED, 2))
    without = tx.rstrip(F.regexp_replace(raw, CITED, ""))
    body = F.when(has_line, F.when(tags != "", tx.strip(F.concat(without, F.lit(" "), tags))).otherwise(without)).otherwise(raw)
    clean = tx.rstrip(F.regexp_replace(tx.rstrip(F.regexp_replace(body, INLINE_REF, "")), TRAILING_TAGS, ""))
    calls = F.flatten(
        F.transform(F.from_json(F.col(tool_chain), CALLS), lambda g: F.coalesce(g["calls"], F.from_json(F.lit("[]"), "array<struct<name:string,result:string>>")))
    )
    recalls = F.filter(calls, lambda c: c["name"] == "recall_memory")
    none = F.array().cast("array<string>")

    def ids(call: Column) -> Column:
        parsed = F.from_json(call["result"], RESULT)
        return F.coalesce(parsed["cited_item_ids"], F.transform(parsed["items"], lambda i: i["id"]), none)

    fallback = F.array_distinct(
        F.filter(F.transform(F.flatten(F.transform(recalls, ids)), tx.strip), lambda i: i.isNotNull() & (i != ""))
    )
    return df.withColumn(
        "cited_ids", F.when(has_line & (F.size(listed) > 0), listed).otherwise(F.coalesce(fallback, none))
    ).withColumn("clean_answer", clean)
