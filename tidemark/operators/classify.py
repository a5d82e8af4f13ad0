"""Keyword rules over messages, attachments, tool rules and entries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx

# Labels of a structured post, tried in this order.
SECTION_LABELS = (
    "待招岗位", "招聘岗位", "岗位职责", "岗位要求", "薪酬福利", "合作方式", "投递方式", "申请方式", "联系方式", "联系",
    "岗位来源", "官网", "中文频道", "Global Channel", "韩语频道", "X", "客服", "职位", "岗位",
)
TITLE_LABELS = ("待招岗位", "招聘岗位", "职位", "岗位")
DUTY_LABEL, NEED_LABEL = "岗位职责", "岗位要求"


@dataclass(frozen=True)
class PostRules:
    """Keyword lists of the classifier. Words in `whole_words` match only as whole ASCII words."""

    exclude: Sequence[str]
    irrelevant: Sequence[str]
    intent: Sequence[str]
    target: Sequence[str]
    strong: Sequence[str] = ()
    whole_words: Sequence[str] = ()
    unless_followed: tuple[tuple[str, str], ...] = (("市场", "风险"),)


# The default lists.
JOB_RULES = PostRules(
    intent=("招聘", "招人", "岗位", "职位", "JD", "待招岗位", "岗位职责", "岗位要求", "薪酬福利", "实习", "全职", "兼职"),
    target=(
        "Agent", "AI Agent", "Agent 开发", "Agent 工程师", "RAG", "LLM", "量化", "量化研究员", "量化研究", "量化开发",
        "Quant", "Quant Research", "Quant Developer", "策略研究", "交易策略", "因子", "回测", "做市", "做市商",
        "Market Maker", "Market Making", "MM", "数据分析", "数据分析师", "Data Analyst", "Business Analyst", "BI",
    ),
    exclude=(
        "关注频道", "Bounty", "Referral", "推荐奖励", "中介佣金", "介绍费", "资源对接", "人脉", "机会市场", "空投", "白嫖",
        "返佣", "求购", "买家", "卖家",
    ),
    irrelevant=(
        "客服主管", "钱包运营", "内容运营", "活动运营", "产品经理", "安全工程师", "客服", "运营", "社群", "社区", "BD", "商务",
        "销售", "市场", "品牌", "HR", "猎头", "产品", "运维", "SRE", "DevOps",
    ),
    whole_words=(
        "Agent", "AI Agent", "RAG", "LLM", "Quant", "Quant Research", "Quant Developer", "Market Maker", "Market Making",
        "MM", "Data Analyst", "Business Analyst", "BI", "JD", "Bounty", "Referral", "BD", "HR", "SRE", "DevOps",
    ),
    strong=("量化研究员", "AI Agent", "RAG", "LLM", "Data Analyst", "Market Maker"),
)


def _quoted(word: str) -> str:
    return r"\Q" + word + r"\E"


def _meets(text: Column, low: Column, word: str, rules: PostRules) -> Column:
    """Whether `text` holds the word; `low` is the lowered text. A plain search comes first: a pattern reads only texts that can meet it."""
    for base, follow in rules.unless_followed:
        if word == base:
            return F.contains(text, F.lit(base)) & F.rlike(text, F.lit(f"{_quoted(base)}(?!{_quoted(follow)})"))
    if word in rules.whole_words:
        whole = F.rlike(text, F.lit(rf"(?i)(?<![A-Za-z0-9_]){_quoted(word)}(?![A-Za-z0-9_])"))
        return F.contains(low, F.lit(word.lower())) & whole if word.isascii() else whole
    return F.contains(low, F.lit(word.lower()))


def matched(text: Column, low: Column, words: Sequence[str], rules: PostRules) -> Column:
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(_meets(text, low, w, rules), F.lit(w)) for w in words]))


#: Line breaks other than "\n", see `tx.LINE_BREAK`.
RARE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def post_lines(text: Column) -> Column:
    """The stripped lines of a text that are not empty."""
    ends = lambda l: F.concat(F.substring(l, 1, 1), F.substring(l, -1, 1))
    rare = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in RARE_BREAKS])
    split = F.when(rare, F.split(text, tx.LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    parts = F.filter(split, lambda l: l != "")
    return F.filter(F.transform(parts, lambda l: F.when(F.rlike(ends(l), F.lit(tx.SPACE)), tx.strip(l)).otherwise(l)), lambda l: l != "")


def post_sections(text: Column) -> Column:
    """Struct of title, duties and needs of a labelled post."""
    any_label = "(?:" + "|".join(_quoted(name) for name in SECTION_LABELS) + r")\s*[:：]"

    def labelled(line: Column) -> Column:
        label, value = F.lit(""), F.lit("")
        for name in reversed(SECTION_LABELS):
            pattern = f"{_quoted(name)}\\s*[:：]\\s*(.*)$"
            hit = F.rlike(line, F.lit(pattern))
            label = F.when(hit, name).otherwise(label)
            value = F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(value)
        clean = tx.strip(tx.squash(F.replace(F.regexp_replace(value, r"#(?=\S)", ""), F.lit("#"), F.lit(" "))))
        named = F.struct(line.alias("line"), label.alias("label"), clean.alias("value"))
        plain = F.struct(line.alias("line"), F.lit("").alias("label"), F.lit("").alias("value"))
        # most lines have no label: none is tried on them one by one
        has = (F.contains(line, F.lit(":")) | F.contains(line, F.lit("："))) & F.rlike(line, F.lit(any_label))
        return F.when(has, named).otherwise(plain)

    rows = F.transform(post_lines(text), labelled)
    start = F.struct(F.lit("").alias("title"), F.lit("").alias("duties"), F.lit("").alias("needs"), F.lit("").alias("at"))

    def grow(old: Column, more: Column, when: Column) -> Column:
        return F.when(when & (more != ""), F.concat(old, F.lit("\n"), more)).otherwise(old)

    def step(acc: Column, row: Column) -> Column:
        at = F.when(row["label"] != "", row["label"]).otherwise(acc["at"])
        said = F.when(row["label"] != "", row["value"]).otherwise(row["line"])
        return F.struct(
            F.when(row["label"].isin(*TITLE_LABELS), row["value"]).otherwise(acc["title"]).alias("title"),
            grow(acc["duties"], said, at == DUTY_LABEL).alias("duties"),
            grow(acc["needs"], said, at == NEED_LABEL).alias("needs"),
            at.alias("at"),
        )

    # what grew are stripped lines, each after a line break
    shown = lambda done: F.struct(done["title"].alias("title"), *[F.substr(done[n], F.lit(2)).alias(n) for n in ("duties", "needs")])
    return tx.let(F.aggregate(rows, start, step), shown)


def classify_messages(df: DataFrame, rules: PostRules = JOB_RULES, text: str = "text") -> DataFrame:
    """Add the decision (`matched`, `skipped`), the reason and the matched keywords."""
    none = F.array().cast("array<string>")

    def lowered(row: Column) -> Column:
        parts = {"body": row["body"], **{n: row["s"][n] for n in ("title", "duties", "needs")}}
        return F.struct(*[x.alias(n) for n, x in parts.items()], *[F.lower(x).alias(f"low_{n}") for n, x in parts.items()])

    def found(row: Column) -> Column:
        title = row["title"]
        hits = lambda part, words: matched(row[part], row[f"low_{part}"], words, rules)
        return F.struct(
            title.alias("title"),
            hits("body", rules.exclude).alias("exclude"),
            hits("body", rules.intent).alias("intent"),
            F.when(title != "", hits("title", rules.irrelevant)).otherwise(hits("body", rules.irrelevant)).alias("irrelevant"),
            hits("title", rules.target).alias("titled"),
            F.array_distinct(F.concat(hits("duties", rules.target), hits("needs", rules.target))).alias("inside"),
        )

    def judged(m: Column) -> Column:
        has_title = m["title"] != ""
        strong = F.arrays_overlap(m["inside"], F.array(*[F.lit(w) for w in rules.strong])) if rules.strong else F.lit(False)
        reason = (
            F.when(F.size(m["exclude"]) > 0, "skipped_by_exclude_keywords")
            .when(has_title & (F.size(m["irrelevant"]) > 0), "skipped_irrelevant_role")
            .when(F.size(m["intent"]) == 0, "skipped_no_job_intent_keywords")
            .when(has_title & (F.size(m["titled"]) > 0), "")
            .when(~has_title & ((F.size(m["inside"]) >= 2) | strong), "")
            .otherwise("skipped_no_title_target_keywords")
        )
        return F.struct(m.alias("m"), reason.alias("reason"))

    # each step is bound once: a filter on the decision must not repeat the keyword search inside it
    row = lambda body: F.struct(body.alias("body"), post_sections(body).alias("s"))
    out = df.withColumn("__v", tx.let(tx.let(tx.let(tx.let(F.coalesce(F.col(text), F.lit("")), row), lowered), found), judged))
    m, reason = F.col("__v.m"), F.col("__v.reason")
    early = reason.isin("skipped_by_exclude_keywords", "skipped_irrelevant_role", "skipped_no_job_intent_keywords")
    target = (
        F.when(early, F.array_distinct(F.concat(m["titled"], m["inside"])))
        .when((reason == "") & (m["title"] != ""), m["titled"])
        .otherwise(F.coalesce(m["inside"], none))
    )
    return out.select(
        *df.columns,
        F.when(reason == "", "matched").otherwise("skipped").alias("decision"),
        reason.alias("reason"),
        m["title"].alias("title"),
        target.alias("matched_target"),
        *[m[a].alias(f"matched_{b}") for a, b in (("exclude", "exclude"), ("intent", "intent"), ("irrelevant", "irrelevant"), ("titled", "title"))],
    )


# What counts as audio.
AUDIO_SUFFIXES = (".mp3", ".wav", ".ogg", ".opus", ".flac", ".aac", ".m4a")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm")
AUDIO_TYPES = (
    "audio/mpeg", "audio/mp3", "audio/wav", "audio/x-wav", "audio/ogg", "audio/opus", "audio/flac", "audio/aac", "audio/mp4",
)


def is_audio(filename: Column, mime: Column, suffixes=AUDIO_SUFFIXES, blocked=VIDEO_SUFFIXES, types=AUDIO_TYPES) -> Column:
    suffix = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/.](\.[^./]+)$", 1))
    kind = F.coalesce(mime, F.lit(""))
    return (
        F.when(suffix.isin(*blocked) | F.startswith(kind, F.lit("video/")), False)
        .when(suffix.isin(*suffixes), True)
        .otherwise(kind.isin(*types))
    )


def filter_attachments(
    df: DataFrame, include: Sequence[str], exclude: Sequence[str], *, text: str = "text", filename: str = "filename", mime: str = "mime", suffixes=AUDIO_SUFFIXES
) -> DataFrame:
    """Audio attachments whose text, name or type meets an include word and no exclude word."""
    source = F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in (text, filename, mime)]))

    def hits(words: Sequence[str]) -> Column:
        if not words:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(F.contains(source, F.lit(w.lower())), F.lit(w)) for w in words]))

    out = df.filter(is_audio(F.col(filename), F.col(mime), suffixes)).withColumn("matched_keywords", hits(include))
    return out.filter((F.size("matched_keywords") > 0) & (F.size(hits(exclude)) == 0))


# How a mention is written.
MENTION = r"\[CQ:at,qq=(\d+)[^\]]*\]"


def filter_group(df: DataFrame, allow: DataFrame | None, bot: str, require_mention: bool = True) -> DataFrame:
    """Messages of allowed senders that mention the bot, without the mention codes.

    `df`: sender, raw. No allow list lets everyone pass.
    """
    kept = df if allow is None else df.join(allow.select("sender").distinct(), "sender", "left_semi")
    if require_mention:
        kept = kept.filter(F.array_contains(F.regexp_extract_all("raw", F.lit(MENTION), 1), bot))
    return kept.withColumn("clean", tx.strip(F.regexp_replace("raw", MENTION, "")))


# Phrases that forbid or require the tool named right behind them.
FORBID_CUES = (
    "不能直接使用", "不能直接用", "不要直接使用", "不要直接用", "别直接使用", "别直接用", "不能先使用", "不能先用",
    "不要先使用", "不要先用", "别先使用", "别先用", "不能使用", "不能用", "不要使用", "不要用", "别使用", "别用",
    "禁止使用", "禁止用",
)
REQUIRE_CUES = (
    "必须先使用", "必须先用", "必须使用", "必须用", "先使用", "先用", "优先使用", "优先用", "应先使用", "应先用",
    "应该使用", "应该用", "直接使用", "直接用",
)
_NAME = "[A-Za-z][A-Za-z0-9_]*"


def tool_mentions(text: Column) -> Column:
    """Lower-case names of two or more characters, and neighbouring names joined by `_`."""
    raw = F.coalesce(text, F.lit(""))
    names = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(_NAME), 0), F.lower), lambda n: F.length(n) >= 2)
    pair = f"({_NAME})(?=\\s+({_NAME}))"
    joined = F.zip_with(
        F.regexp_extract_all(raw, F.lit(pair), 1), F.regexp_extract_all(raw, F.lit(pair), 2),
        lambda a, b: F.lower(F.concat_ws("_", a, b)),
    )
    return F.array_distinct(F.concat(names, joined))


def _cued(text: Column) -> Column:
    """(cue, tool) pairs: a cue directly before one name or two neighbouring names."""
    cues = "|".join(r"\s*".join(c) for c in (*FORBID_CUES, *REQUIRE_CUES))
    pattern = f"({cues})\\s*({_NAME}(?:\\s+{_NAME})?)"
    found_cues = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda c: F.regexp_replace(c, r"\s+", ""))
    tools = F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda t: F.lower(F.regexp_replace(t, r"\s+", "_")))
    return F.arrays_zip(found_cues.alias("cue"), tools.alias("tool"))


def rule_schema(df: DataFrame, summary: str = "summary", tool: str = "tool_requirement", steps: str = "steps") -> DataFrame:
    """Add required, forbidden and mentioned tools of a rule; required wins over forbidden."""
    none = F.array().cast("array<string>")
    texts = F.concat(F.array(F.coalesce(F.col(summary), F.lit(""))), F.coalesce(F.col(steps), none))
    clauses = F.flatten(F.transform(texts, lambda t: F.split(t, "[，。！？；;\n]")))
    pairs = F.flatten(F.transform(clauses, _cued))
    forbid = F.array(*[F.lit(c) for c in FORBID_CUES])

    def tools(banned: bool) -> Column:
        side = F.filter(pairs, lambda p: F.array_contains(forbid, p["cue"]) if banned else ~F.array_contains(forbid, p["cue"]))
        return F.array_distinct(F.transform(side, lambda p: p["tool"]))

    named = F.lower(tx.present(F.col(tool)))
    own = F.when(named.isNotNull(), F.array(named)).otherwise(none)
    required = F.array_sort(F.array_distinct(F.concat(tools(False), own)))
    out = df.withColumn("required_tools", required)
    out = out.withColumn("forbidden_tools", F.array_sort(F.array_except(tools(True), F.col("required_tools"))))
    mentioned = F.array_distinct(F.concat(F.flatten(F.transform(texts, tool_mentions)), own))
    return out.withColumn("mentioned_tools", F.array_sort(mentioned))


def rule_conflicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Per new rule and tool: how many old rules contradict it, and the first of them.

    One side requires the tool, the other forbids it. Old rules are folded per tool first, so no
    pair of rules is ever formed.
    """
    sides = []
    for mine, theirs in (("required_tools", "forbidden_tools"), ("forbidden_tools", "required_tools")):
        a = new.select(F.col("id").alias("rule_id"), F.explode(mine).alias("tool"), F.lit(mine).alias("side"))
        b = old.select("id", F.explode(theirs).alias("tool")).groupBy("tool").agg(
            F.count(F.lit(1)).alias("n_conflicts"), F.min("id").alias("first_conflict")
        )
        sides.append(a.join(b, "tool"))
    return sides[0].unionByName(sides[1]).select("rule_id", "tool", "side", "n_conflicts", "first_conflict")


def match_procedures(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """(action_id, id) of tool-triggered procedures an action sets off.

    `rules`: id, keywords, tools, skills (arrays); `actions`: action_id, tokens. Keywords of three
    or more characters must occur in the action text; without keywords a tool or skill name must
    match, unless the rule names more than four tools.
    """
    from tidemark.operators.lexical import substring_join

    none = F.array().cast("array<string>")
    long = F.filter(F.coalesce("keywords", none), lambda k: F.length(k) >= 3)
    worded = rules.withColumn("kw", long)
    needles = worded.select("id", F.explode("kw").alias("k")).withColumn("k", F.lower("k"))
    texts = actions.select("action_id", F.lower(F.array_join("tokens", " ")).alias("body"))
    by_word = substring_join(texts, "action_id", "body", needles.select("k").distinct(), "k").join(needles, "k").select("action_id", "id")
    plain = worded.filter((F.size("kw") == 0) & (F.size(F.coalesce("tools", none)) <= 4))
    names = plain.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.coalesce("tools", none), F.coalesce("skills", none)), F.lower))).alias("n"))
    tokens = actions.select("action_id", F.explode(F.array_distinct(F.transform("tokens", F.lower))).alias("n"))
    by_name = tokens.filter("n <> ''").join(names, "n").select("action_id", "id")
    return by_word.unionByName(by_name).distinct()


# Tags a pending note may carry.
PENDING_TAGS = (
    "identity", "preference", "key_info", "health_long_term", "requested_memory", "correction", "agent_context",
)


def history_entries(entries: Column) -> Column:
    """Distinct non-blank entries (summary, emotional_weight within 0..10), the first of each text."""
    clean = F.transform(
        F.coalesce(entries, F.from_json(F.lit("[]"), "array<struct<summary:string,emotional_weight:int>>")),
        lambda e: F.struct(
            tx.strip(F.coalesce(e["summary"], F.lit(""))).alias("summary"),
            F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(e["emotional_weight"].cast("int"), F.lit(0)))).alias("emotional_weight"),
        ),
    )
    kept = F.filter(clean, lambda e: e["summary"] != "")
    names = lambda all_: F.transform(all_, lambda e: e["summary"])
    firsts = lambda both: F.filter(both["kept"], lambda e, i: F.array_position(both["names"], e["summary"]) == i + 1)
    return tx.let(kept, lambda all_: tx.let(F.struct(all_.alias("kept"), names(all_).alias("names")), firsts))


def history_rows(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same for entries as rows (keys, order, summary, emotional_weight): the first of each text per key."""
    weight = F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(F.col("emotional_weight").cast("int"), F.lit(0))))
    clean = entries.select(*keys, F.col(order), tx.strip(F.coalesce("summary", F.lit(""))).alias("summary"), weight.alias("emotional_weight")).filter("summary <> ''")
    return clean.groupBy(*keys, "summary").agg(F.min(order).alias(order), F.min_by("emotional_weight", order).alias("emotional_weight"))


def pending_lines(items: Column) -> Column:
    """Distinct `- [tag] content` lines of items (tag, content) with an allowed tag."""
    clean = F.transform(items, lambda e: F.struct(F.lower(tx.strip(F.coalesce(e["tag"], F.lit("")))).alias("tag"), tx.strip(F.coalesce(e["content"], F.lit(""))).alias("content")))
    kept = F.filter(clean, lambda e: e["tag"].isin(*PENDING_TAGS) & (e["content"] != ""))
    return F.array_distinct(F.transform(kept, lambda e: F.concat(F.lit("- ["), e["tag"], F.lit("] "), e["content"])))
