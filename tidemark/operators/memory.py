"""The memory table: candidates for merging, merges, retirement, undo, and retrieval filters.

A memory item has id, memory_type, summary, content_hash, embedding, reinforcement,
emotional_weight, extra_json, source_ref, happened_at, status, created_at, updated_at. Every write
is a function from tables to the new table; `sources.versions` publishes the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.vector import similar
from tidemark.operators.windows import top_rows

LOCAL_ZONE = "Asia/Shanghai"
STORED_SIMILARITY = 0.45
BATCH_SIMILARITY = 0.90
INVALIDATE_SIMILARITY = 0.82
EVENT_SIMILARITY = 0.92
CANDIDATES = 5
NORM_EPSILON = 1e-9


# -- expressions ------------------------------------------------------------------------------


def coerce_type(kind: Column, tool: Column, steps: Column) -> Column:
    """A procedure without tool and without steps is a preference."""
    has_step = F.exists(F.coalesce(steps, F.array().cast("array<string>")), lambda s: tx.present(s).isNotNull())
    return F.when((kind == "procedure") & tx.present(tool).isNull() & ~has_step, "preference").otherwise(kind)


def source_ids(ref: Column) -> Column:
    """Message ids named by a source reference: a JSON list or one bare id, before the first `#`."""
    base = tx.strip(F.element_at(F.split(F.coalesce(ref, F.lit("")), "#", 2), 1))
    listed = F.filter(F.transform(F.from_json(base, "array<string>"), tx.strip), lambda i: i != "")
    quoted = F.rlike(base, F.lit(r'^".*"$'))
    one = tx.strip(F.when(quoted, F.substring(base, F.lit(2), F.length(base) - 2)).otherwise(base))
    none = F.array().cast("array<string>")
    return (
        F.when(base == "", none)
        .when(F.startswith(base, F.lit("[")), F.coalesce(listed, F.array(base)))
        .when(one == "", none)
        .otherwise(F.array(one))
    )


def explode_source_refs(df: DataFrame, ref: str = "source_ref") -> DataFrame:
    """One row per named message id, in order; rows without ids are kept with a null id."""
    return df.select("*", F.posexplode_outer(source_ids(F.col(ref))).alias("pos", "message_id"))


def parse_event_time(col: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC time of ISO text; a time without a zone is local to `zone`. Bad text gives null."""

    def parsed(text: Column) -> Column:
        day = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
        shape = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"))
        zoned = F.rlike(text, F.lit(r"[T ]\d{2}.*(Z|[+-]\d{2}:?\d{2})$"))
        spelled = F.regexp_replace(F.regexp_replace(text, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
        naive = F.to_utc_timestamp(F.try_to_timestamp(text), zone)
        return F.when(day | (shape & ~zoned), naive).when(shape, F.try_to_timestamp(spelled))

    # hours and minutes may stand alone; the cast wants seconds
    text = F.regexp_replace(tx.strip(F.coalesce(col, F.lit(""))), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|Z|[+-])", "$1:00")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    return tx.let(text, parsed)


def summary_time(summary: Column) -> Column:
    """ISO local time from a `[YYYY-MM-DD HH:MM[:SS]]` prefix, else null."""
    pattern = r"^\[(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?\]"

    def built(text: Column) -> Column:
        def piece(i: int) -> Column:
            return F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("00"))

        parts = F.concat(F.regexp_extract(text, pattern, 1), F.lit("T"), piece(2), F.lit(":"), piece(3), F.lit(":"), piece(4))
        return F.when(F.rlike(text, F.lit(pattern)), parts)

    return tx.let(tx.strip(F.coalesce(summary, F.lit(""))), built)


def time_bounds(text: str, now_local: "datetime") -> tuple["datetime", "datetime"] | None:  # noqa: F821
    """Half-open local bounds of `today`, `yesterday`, `recent_3d/7d/30d`, a day or `day~day`."""
    from datetime import datetime, timedelta

    def day(value: str):
        try:
            return datetime.strptime(value.strip(), "%Y-%m-%d").replace(tzinfo=now_local.tzinfo)
        except ValueError:
            return None

    text = (text or "").strip()
    today = now_local.replace(hour=0, minute=0, second=0, microsecond=0)
    one = timedelta(days=1)
    if text == "today":
        return today, today + one
    if text == "yesterday":
        return today - one, today
    if text in ("recent_3d", "recent_7d", "recent_30d"):
        return now_local - timedelta(days=int(text[7:-1])), now_local
    first, _, last = text.partition("~")
    start, end = day(first), day(last or first)
    return None if start is None or end is None else (start, end + one)


def filter_memory(
    df: DataFrame,
    *,
    q: str = "",
    types: Sequence[str] = (),
    status: str = "",
    source_ref: str = "",
    scope_channel: str | None = None,
    scope_chat_id: str | None = None,
    has_embedding: bool | None = None,
    start: Column | None = None,
    end: Column | None = None,
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Rows that meet all given conditions. Text conditions ignore case and are literal."""
    tests: list[Column] = []

    def has(column: str, value: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(value.lower()))

    if q:
        tests.append(has("id", q) | has("summary", q) | has("source_ref", q))
    if types:
        tests.append(F.col("memory_type").isin(*types))
    if status:
        tests.append(F.col("status") == status)
    if source_ref:
        tests.append(has("source_ref", source_ref))
    for key, value in (("scope_channel", scope_channel), ("scope_chat_id", scope_chat_id)):
        if value is not None:
            got = F.coalesce(F.trim(F.get_json_object("extra_json", f"$.{key}")), F.lit(""))
            tests.append(got == value.strip())
    if has_embedding is not None:
        tests.append(F.col("embedding").isNotNull() if has_embedding else F.col("embedding").isNull())
    if start is not None or end is not None:
        at = parse_event_time(F.col("happened_at"), zone)
        tests.append(at.isNotNull())
        if start is not None:
            tests.append(at >= start)
        if end is not None:
            tests.append(at < end)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


# -- candidates -------------------------------------------------------------------------------


def dedup_candidates(
    new: DataFrame,
    stored: DataFrame,
    k: int = CANDIDATES,
    same: str | None = "memory_type",
    stored_at: float = STORED_SIMILARITY,
    batch_at: float = BATCH_SIMILARITY,
) -> DataFrame:
    """Up to `k` likely duplicates per new item: stored ones first, then earlier ones of the batch.

    `new` needs id, ord (place in the batch), embedding; `stored` needs id, embedding.
    """
    asked = new.withColumnRenamed("id", "query_id")
    known = similar(asked, stored, k=k, threshold=stored_at, same=same, epsilon=NORM_EPSILON)
    order = new.select("id", "ord")
    batch = similar(asked, new, threshold=batch_at, same=same, skip_same_id=True, epsilon=NORM_EPSILON)
    batch = (
        batch.join(order.withColumnRenamed("id", "query_id").withColumnRenamed("ord", "q_ord"), "query_id")
        .join(order, "id")
        .filter(F.col("ord") < F.col("q_ord"))
        .join(known.select("query_id", "id"), ["query_id", "id"], "left_anti")
    )
    both = known.select("query_id", "id", "score", F.lit(0).alias("lane"), F.col("rank").cast("bigint").alias("at")).unionByName(
        batch.select("query_id", "id", "score", F.lit(1).alias("lane"), F.col("ord").cast("bigint").alias("at"))
    )
    ranked = top_rows(both, ["query_id"], [F.col("lane"), F.col("at"), F.col("id")], k)
    return ranked.select("query_id", "id", "score", (F.col("lane") == 1).alias("in_batch"), "rank")


def invalidate_candidates(topics: DataFrame, rules: DataFrame, protected: DataFrame | None = None, k: int = CANDIDATES, threshold: float = INVALIDATE_SIMILARITY) -> DataFrame:
    """Rules close enough to a topic to be reconsidered, without the protected ids."""
    open_rules = rules if protected is None else rules.join(protected.select("id"), "id", "left_anti")
    return similar(topics, open_rules, k=k, threshold=threshold, epsilon=NORM_EPSILON)


def semantic_dedup(new: DataFrame, stored: DataFrame, now: Column, days: int = 7, threshold: float = EVENT_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Split new events into (fresh, repeats): a repeat has a close active event of the last days.

    A repeat names the closest event in `reinforced_id`. `stored` has id, embedding, status,
    memory_type, created_at.
    """
    recent = stored.filter(
        (F.col("memory_type") == "event")
        & (F.col("status") == "active")
        & (F.col("created_at") >= now - F.expr(f"INTERVAL {max(1, days)} DAYS"))
    )
    asked = new.withColumnRenamed("id", "query_id")
    best = similar(asked, recent.select("id", "embedding"), k=1, threshold=threshold, epsilon=NORM_EPSILON)
    match = best.select(F.col("query_id").alias("id"), F.col("id").alias("reinforced_id"), "score")
    return new.join(match.select("id"), "id", "left_anti"), new.join(match, "id")


# -- writes -----------------------------------------------------------------------------------

ITEM_COLUMNS = (
    "id", "memory_type", "summary", "content_hash", "embedding", "reinforcement", "emotional_weight",
    "extra_json", "source_ref", "happened_at", "status", "created_at", "updated_at",
)


def weight(col: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(col.cast("int"), F.lit(0))))


def upsert_memory(target: DataFrame, changes: DataFrame, now: Column, fill_happened: bool = False) -> DataFrame:
    """Reinforce items whose (hash, type) is already known, else insert.

    `changes`: ord, memory_type, summary, emotional_weight and optional payload columns. The first
    change of a new text brings the payload; every further one reinforces it. A retired item that
    is seen again becomes active.
    """
    payload = ["summary", "embedding", "extra_json", "source_ref", "happened_at"]
    have = [c for c in payload if c in changes.columns]
    keyed = changes.withColumn("content_hash", tx.content_hash(F.col("summary"), F.col("memory_type")))
    folded = keyed.groupBy("content_hash", "memory_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(weight(F.col("emotional_weight"))).alias("w"),
        F.min_by(F.struct(*have), "ord").alias("first"),
        *([F.min_by(F.when(F.coalesce("happened_at", F.lit("")) != "", F.col("happened_at")), F.when(F.coalesce("happened_at", F.lit("")) != "", F.col("ord"))).alias("when_known")] if "happened_at" in have else []),
    )
    t, c = target.alias("t"), folded.alias("c")
    joined = t.join(c, ["content_hash", "memory_type"], "full_outer")
    known, seen = F.col("t.id").isNotNull(), F.col("n").isNotNull()
    types = {f.name: f.dataType for f in target.schema}
    fresh_id = F.substring(F.md5(F.concat(F.col("content_hash"), F.col("memory_type"))), 1, 12)

    def brought(name: str) -> Column:
        return F.col(f"first.{name}") if name in have else F.lit(None)

    happened = F.col("t.happened_at")
    if fill_happened and "happened_at" in have:
        happened = F.when(seen, F.coalesce(F.nullif("t.happened_at", F.lit("")), F.col("when_known"))).otherwise(happened)
    values = {
        "id": F.coalesce("t.id", fresh_id),
        "reinforcement": F.coalesce("t.reinforcement", F.lit(0)) + F.coalesce("n", F.lit(0)),
        "emotional_weight": F.greatest(F.coalesce("t.emotional_weight", F.lit(0)), F.coalesce("w", F.lit(0))),
        "status": F.when(seen, "active").otherwise(F.col("t.status")),
        "created_at": F.coalesce("t.created_at", now),
        "updated_at": F.when(seen, now).otherwise(F.col("t.updated_at")),
        "happened_at": F.when(known, happened).otherwise(brought("happened_at")),
    }
    for name in payload[:-1]:
        values[name] = F.when(known, F.col(f"t.{name}")).otherwise(brought(name))
    out = []
    for name in target.columns:
        if name in ("content_hash", "memory_type"):
            out.append(F.col(name))
        else:
            out.append(values.get(name, F.col(f"t.{name}")).cast(types[name]).alias(name))
    kept = F.when(seen & (F.col("t.status") != "superseded"), F.col("t.status")).otherwise(values["status"])
    out = [kept.alias("status") if target.columns[i] == "status" else col for i, col in enumerate(out)]
    return joined.select(*out)


def ingest_once(target: DataFrame, log: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Write events at most once per source reference: (new items, new log).

    `log` has source_ref and item_id; a blank reference or text is ignored.
    """
    clean = changes.withColumn("source_ref", tx.strip(F.col("source_ref"))).withColumn("summary", tx.strip(F.col("summary")))
    clean = clean.filter((F.col("source_ref") != "") & (F.col("summary") != ""))
    cols = [c for c in clean.columns if c != "source_ref"]
    first = clean.groupBy("source_ref").agg(F.min_by(F.struct(*cols), "ord").alias("c")).select("source_ref", "c.*")
    fresh = first.join(log.select("source_ref"), "source_ref", "left_anti").withColumn("memory_type", F.lit("event"))
    items = upsert_memory(target, fresh, now, fill_happened=True)
    hashed = fresh.withColumn("content_hash", tx.content_hash(F.col("summary"), F.col("memory_type")))
    made = hashed.join(items.select("content_hash", "memory_type", F.col("id").alias("item_id")), ["content_hash", "memory_type"])
    return items, log.select("source_ref", "item_id").unionByName(made.select("source_ref", "item_id"))


def supersede(target: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Retire the listed items."""
    flagged = target.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return flagged.select(
        *[
            F.when(F.col("__hit"), F.lit("superseded")).otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.when(F.col("__hit"), now).otherwise(F.col("updated_at")).alias("updated_at")
            if c == "updated_at"
            else F.col(c)
            for c in target.columns
        ]
    )


def replacement_rows(items: DataFrame, pairs: DataFrame, now: Column, relation: str = "supersede") -> DataFrame:
    """Log rows with snapshots of both sides for (old_item_id, new_item_id) pairs."""
    shot = ["memory_type", "summary", "source_ref", "happened_at", "extra_json"]
    old = items.select(F.col("id").alias("old_item_id"), *[F.col(c).alias(f"old_{c}") for c in shot])
    new = items.select(F.col("id").alias("new_item_id"), *[F.col(c).alias(f"new_{c}") for c in shot])
    return (
        pairs.join(old, "old_item_id")
        .join(new, "new_item_id")
        .withColumn("relation_type", F.lit(relation))
        .withColumn("source_ref", F.col("new_source_ref"))
        .withColumn("created_at", now)
    )


def reinforce(target: DataFrame, ids: DataFrame, now: Column, emotional_weight: int = 0) -> DataFrame:
    """Add one reinforcement per listed id (an id listed twice counts twice)."""
    hits = ids.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    joined = target.join(hits, "id", "left")
    changed = {
        "reinforcement": F.col("reinforcement") + F.coalesce("__n", F.lit(0)),
        "updated_at": F.when(F.col("__n").isNotNull(), now).otherwise(F.col("updated_at")),
        "emotional_weight": F.when(
            F.col("__n").isNotNull(), F.greatest("emotional_weight", F.lit(max(0, min(10, emotional_weight))))
        ).otherwise(F.col("emotional_weight")),
    }
    return joined.select(*[changed[c].cast(target.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in target.columns])


def merged_summary(old: Column, new: Column) -> Column:
    """Join two rule texts; one that contains the other stands alone."""
    a, b = tx.strip(F.coalesce(old, F.lit(""))), tx.strip(F.coalesce(new, F.lit("")))
    return (
        F.when(a == "", b)
        .when((b == "") | F.contains(a, b), a)
        .when(F.contains(b, a), b)
        .otherwise(F.concat(F.regexp_replace(a, r"[。；;，, ]+\z", ""), F.lit("；"), b))
    )


def save_supersede(target: DataFrame, changes: DataFrame, now: Column, merge_at: float = 0.70, retire_at: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """Save rules, preferences and profile facts, merging or retiring what they replace.

    Returns (new items, actions), an action being (change_id, action, item_id). A procedure with a
    tool is merged into the closest active procedure with the same tool. Otherwise a procedure or
    preference retires close items of its type, and a status or purchase fact those of its
    category. At most five items are looked at per change. Within a batch, changes are taken in
    `ord`: a later change retires close earlier ones before they are stored.
    """
    tool = lambda c: tx.present(F.get_json_object(c, "$.tool_requirement"))
    category = lambda c: F.get_json_object(c, "$.category")
    active = target.filter(F.col("status") == "active")
    asked = changes.withColumnRenamed("id", "query_id")
    close = similar(asked, active, k=CANDIDATES, threshold=min(merge_at, retire_at), same="memory_type", epsilon=NORM_EPSILON)
    info_c = changes.select(
        F.col("id").alias("query_id"), "memory_type", tool(F.col("extra_json")).alias("c_tool"), category(F.col("extra_json")).alias("c_cat")
    )
    info_t = active.select(
        "id", tool(F.col("extra_json")).alias("t_tool"), category(F.col("extra_json")).alias("t_cat"), "emotional_weight"
    )
    pairs = close.join(info_c, "query_id").join(info_t, "id")
    mergeable = pairs.filter(
        (F.col("memory_type") == "procedure") & (F.col("c_tool") == F.col("t_tool")) & (F.col("score") >= merge_at)
    )
    merges = mergeable.groupBy("query_id").agg(F.min_by("id", "rank").alias("item_id"))
    bar = F.when((F.col("memory_type") == "profile") & (F.col("emotional_weight") >= 7), F.greatest(F.lit(0.92), F.lit(0.0))).otherwise(retire_at)
    applies = F.col("memory_type").isin("procedure", "preference") | (
        (F.col("memory_type") == "profile") & F.col("c_cat").isin("status", "purchase") & (F.col("c_cat") == F.col("t_cat"))
    )
    retired = (
        pairs.filter(applies & (F.col("score") >= bar))
        .join(merges.select("query_id"), "query_id", "left_anti")
        .select("query_id", F.col("id").alias("item_id"))
    )
    new = changes.join(merges.select(F.col("query_id").alias("id")), "id", "left_anti")
    order = new.select("id", "ord", category(F.col("extra_json")).alias("cat"), "memory_type")
    inside = similar(new.withColumnRenamed("id", "query_id"), new, threshold=retire_at, same="memory_type", skip_same_id=True, epsilon=NORM_EPSILON)
    later = order.select(F.col("id").alias("query_id"), F.col("ord").alias("q_ord"), F.col("cat").alias("q_cat"), "memory_type")
    inside = inside.join(later, "query_id").join(order.drop("memory_type"), "id").filter(
        (F.col("ord") < F.col("q_ord"))
        & (
            F.col("memory_type").isin("procedure", "preference")
            | ((F.col("memory_type") == "profile") & F.col("q_cat").isin("status", "purchase") & (F.col("q_cat") == F.col("cat")))
        )
    )
    dropped = inside.select("id").distinct()
    # the last merge of the batch (by ord) writes its text over the target
    patch = (
        merges.join(changes.select(F.col("id").alias("query_id"), "ord", F.col("summary").alias("m_summary"), F.col("embedding").alias("m_embedding")), "query_id")
        .groupBy("item_id")
        .agg(F.max_by(F.struct("m_summary", "m_embedding"), "ord").alias("m"))
        .select(F.col("item_id").alias("id"), "m.*")
    )
    base = supersede(target, retired.select(F.col("item_id").alias("id")), now)
    joined = base.join(patch, "id", "left")
    text = F.when(F.col("m_summary").isNotNull(), merged_summary(F.col("summary"), F.col("m_summary"))).otherwise(F.col("summary"))
    changed = {
        "summary": text,
        "content_hash": F.when(F.col("m_summary").isNotNull(), tx.content_hash(text, F.col("memory_type"))).otherwise(F.col("content_hash")),
        "embedding": F.coalesce("m_embedding", "embedding"),
        "updated_at": F.when(F.col("m_summary").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    patched = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in base.columns])
    kept = upsert_memory(patched, new.join(dropped, "id", "left_anti"), now)
    buried = new.join(dropped, "id")
    buried_items = upsert_memory(patched.limit(0), buried, now).withColumn("status", F.lit("superseded"))
    buried_items = buried_items.join(kept.select("content_hash", "memory_type"), ["content_hash", "memory_type"], "left_anti")
    items = kept.unionByName(buried_items.select(*kept.columns))
    actions = (
        merges.select("query_id", F.lit("merge").alias("action"), "item_id")
        .unionByName(retired.select("query_id", F.lit("retire").alias("action"), "item_id"))
        .unionByName(inside.select("query_id", F.lit("retire").alias("action"), F.col("id").alias("item_id")))
    )
    return items, actions


def restore_plan(items: DataFrame, replacements: DataFrame, affected: DataFrame) -> DataFrame:
    """Retired items to bring back: replaced by an affected item and by no other active item."""
    gone = affected.select(F.col("id").alias("new_item_id")).distinct()
    touched = replacements.join(gone, "new_item_id", "left_semi").select("old_item_id").distinct()
    active = items.filter(F.col("status") == "active").select(F.col("id").alias("new_item_id"))
    still = (
        replacements.select("old_item_id", "new_item_id")
        .join(gone, "new_item_id", "left_anti")
        .join(active, "new_item_id", "left_semi")
        .select("old_item_id")
    )
    free = touched.join(still, "old_item_id", "left_anti").select(F.col("old_item_id").alias("id"))
    return items.filter(F.col("status") == "superseded").join(free, "id", "left_semi").select("id")


def undo_sources(items: DataFrame, replacements: DataFrame, message_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Retire items derived from the given messages and bring back what they replaced.

    Returns (new items, report), the report listing (kind, id) with kind affected, restored or
    rollback_source. `message_ids` has message_id.
    """
    wanted = message_ids.select(tx.strip(F.col("message_id")).alias("message_id")).filter("message_id <> ''").distinct()
    refs = items.select("id", tx.strip(F.coalesce("source_ref", F.lit(""))).alias("ref"))
    whole = refs.join(wanted, refs["ref"] == wanted["message_id"], "left_semi").select("id", F.col("ref").alias("source"))
    base = F.element_at(F.split("ref", "#", 2), 1)
    listed = refs.filter(F.startswith(tx.strip(base), F.lit("["))).select("id", F.explode(source_ids(F.col("ref"))).alias("source"))
    listed = listed.join(whole.select("id"), "id", "left_anti")
    met = listed.join(wanted, listed["source"] == wanted["message_id"], "left_semi").select("id").distinct()
    sources = whole.select("source").unionByName(listed.join(met, "id", "left_semi").select("source")).distinct()
    affected = whole.select("id").unionByName(met).distinct()
    retired = supersede(items, affected, now)
    restored = restore_plan(retired, replacements, affected)
    flagged = retired.join(restored.withColumn("__back", F.lit(True)), "id", "left")
    back = {"status": F.when(F.col("__back"), "active").otherwise(F.col("status")), "updated_at": F.when(F.col("__back"), now).otherwise(F.col("updated_at"))}
    new_items = flagged.select(*[back[c].alias(c) if c in back else F.col(c) for c in items.columns])
    report = (
        affected.select(F.lit("affected").alias("kind"), "id")
        .unionByName(restored.select(F.lit("restored").alias("kind"), "id"))
        .unionByName(sources.select(F.lit("rollback_source").alias("kind"), F.col("source").alias("id")))
    )
    return new_items, report
