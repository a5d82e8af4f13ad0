"""Traces, turns, runs and feeds: summaries, windows, quotas and repeat detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.scoring import hotness
from tidemark.operators.relations import looks_failed
from tidemark.operators.windows import TIME_BUCKET_SECONDS, carry_last, position, time_bucket, top_rows


def trace_list(events: DataFrame) -> DataFrame:
    """Per trace and session: first and last time, number of events, committed flag, traces in total."""
    total = events.agg(F.count_distinct("trace_id").alias("c")).scalar()
    per = events.groupBy("trace_id", "session_key").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("event_count"),
        (F.max((F.col("event_type") == "turn.committed").cast("int")) == 1).alias("committed"),
    )
    return per.withColumn("total", total)


def trace_detail(events: DataFrame, payload_schema: str) -> DataFrame:
    """Events of each trace with their place in it, the decoded payload and the bounds of the trace.

    The events stay rows: a trace may be too long for one array.
    """
    placed = position(events, ["trace_id"], time_bucket("ts"), [F.col("ts"), F.col("id")], "pos")
    bounds = events.groupBy("trace_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("event_count")
    )
    return placed.withColumn("payload", F.from_json("payload_json", payload_schema)).join(bounds, "trace_id")


def bucket_counts(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows per first non-null of the columns."""
    bucket = F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("unknown"))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("section"), "bucket", "total")


def run_overview(runs: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """(section, bucket, total): row counts of tables, result buckets, flow buckets."""
    out = None
    for name, frame in counted.items():
        row = frame.agg(F.count(F.lit(1)).alias("total")).select(F.lit("counts").alias("section"), F.lit(name).alias("bucket"), "total")
        out = row if out is None else out.unionByName(row)
    flow = runs.withColumn("flow", F.when(F.col("drift_entered"), "drift").otherwise("proactive"))
    parts = [bucket_counts(runs, "result_counts", "terminal_action", "gate_exit"), bucket_counts(flow, "flow_counts", "flow")]
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run; ties go to the larger id."""
    rest = F.struct(*[F.col(c) for c in runs.columns])
    return runs.agg(F.max_by(rest, F.struct("started_at", "run_id")).alias("r")).select("r.*")


def cache_summary(turns: DataFrame, per_session_last: int | None = None) -> DataFrame:
    """Turns, tracked turns, tokens, hit rate and last tracked time: overall or per session tail.

    `turns`: session_key, ts, id, prompt_tokens, hit_tokens (null when untracked).
    """
    rows, keys = turns, []
    if per_session_last is not None:
        keys = ["session_key"]
        rows = top_rows(turns, keys, [F.col("ts").desc(), F.col("id").desc()], per_session_last)
    tracked = F.col("prompt_tokens").isNotNull()
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.count_if(tracked).alias("tracked_turn_count"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("hit_tokens"), F.lit(0)).alias("hit_tokens"),
        F.max(F.when(tracked, F.col("ts"))).alias("last_tracked_at"),
    )
    rate = F.when(F.col("prompt_tokens") > 0, F.col("hit_tokens") / F.col("prompt_tokens"))
    return out.withColumn("miss_tokens", F.greatest(F.col("prompt_tokens") - F.col("hit_tokens"), F.lit(0))).withColumn("hit_rate", rate)


def daily_activity(sources: dict[str, DataFrame], day: str, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows per source for the last days up to `day`, one column per source; empty days are left out."""
    union = None
    last = F.to_date(F.lit(day))
    for name, frame in sources.items():
        stamped = frame.select(F.to_date(F.col(ts)).alias("day")).filter(
            (F.col("day") <= last) & (F.col("day") > F.date_sub(last, days))
        )
        part = stamped.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
        union = part if union is None else union.unionByName(part)
    wide = union.groupBy("day").pivot("source", list(sources)).agg(F.sum("n")).fillna(0, list(sources))
    total = sum((F.col(s) for s in list(sources)[1:]), F.col(list(sources)[0]))
    return wide.withColumn("count", total)


def daily_digest(messages: DataFrame, now: Column, hours: int = 24, line_chars: int = 800, max_chars: int = 35_000) -> DataFrame:
    """Lines of a digest: groups in order, messages by time, cut at a total length.

    `messages`: chat_id, topic_id, message_id, ts, sender, text. The first line that would exceed
    the budget ends the digest; group counts cover all messages of the window.
    """
    recent = messages.filter((F.col("ts") >= now - F.expr(f"INTERVAL {max(1, hours)} HOURS")) & (tx.strip(F.col("text")) != ""))
    clean = F.regexp_replace("text", r"\r\n|\r", "\n")
    cut = F.when(F.length(clean) > line_chars, F.concat(tx.rstrip(F.substring(clean, 1, line_chars - 3)), F.lit("..."))).otherwise(clean)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    line = F.concat(
        F.lit("["), stamp, F.lit("] "), F.col("sender"), F.lit(" message_id="), F.col("message_id").cast("string"), F.lit(": "), cut
    )
    lined = recent.withColumn("line", line)
    counts = recent.groupBy("chat_id", "topic_id").agg(F.count(F.lit(1)).alias("group_count"))
    order = [F.col("chat_id"), F.coalesce("topic_id", F.lit(0)), F.col("ts"), F.col("message_id")]
    # stamp and labels alone take 43 characters, so no more lines than this can fit
    first = lined.orderBy(*order).limit(max_chars // 43 + 1)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = first.withColumn("used_chars", F.sum(F.length("line")).over(running)).filter(F.col("used_chars") <= max_chars)
    return kept.join(counts, (kept["chat_id"] == counts["chat_id"]) & kept["topic_id"].eqNullSafe(counts["topic_id"])).drop(counts["chat_id"], counts["topic_id"])


def clean_summary(col: Column) -> Column:
    return F.regexp_replace(tx.strip(tx.squash(col)), r"^[ \-。；;]+|[ \-。；;]+\z", "")


def rollup_candidates(items: DataFrame, long_term: str, now: Column) -> DataFrame:
    """Group unprocessed profile and preference items of the same text into candidates.

    Content is the longest summary; score, reinforcement and weight come from the hottest item.
    The ids behind a candidate come from `rollup_evidence`, as rows: one text may have very many.
    """
    marked = F.coalesce(F.get_json_object("extra_json", "$._rollup"), F.lit(""))
    source = items.filter(
        (F.col("status") == "active") & F.col("memory_type").isin("profile", "preference") & (marked == "") & (tx.strip(F.col("summary")) != "")
    )
    compact = tx.squash(F.lower(F.col("summary")), "")
    heat = hotness(F.col("reinforcement"), F.col("updated_at"), now, F.col("emotional_weight"))
    known = "".join(long_term.lower().split())
    rows = source.select(
        "memory_type", "id", "reinforcement", "emotional_weight", "updated_at",
        F.sha2(compact, 256).alias("text_key"), clean_summary(F.col("summary")).alias("text"), heat.alias("heat"),
        ((F.length(compact) >= 12) & F.contains(F.lit(known), F.substring(compact, 1, 24))).alias("overlap"),
    )
    grouped = rows.groupBy("memory_type", "text_key").agg(
        F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"),
        F.max(F.struct(F.col("heat"), F.col("id"), F.col("reinforcement"), F.col("emotional_weight"), F.col("updated_at"))).alias("best"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.max("overlap").alias("existing_overlap"),
    )
    identity = F.col("memory_type") == "profile"
    content = F.when(identity & ~F.startswith("text", F.lit("用户")), F.concat(F.lit("用户的稳定身份信息是"), "text")).otherwise(F.col("text"))
    return grouped.select(
        F.substring(F.sha1(F.concat_ws("\n", "memory_type", "text_key")), 1, 16).alias("candidate_id"),
        F.when(identity, "identity").otherwise("preference").alias("tag"),
        content.alias("content"),
        F.round(F.greatest("best.heat", F.lit(0.0)) * 100, 2).alias("score"),
        F.col("best.reinforcement").alias("reinforcement"),
        F.col("best.emotional_weight").alias("emotional_weight"),
        "evidence_count", "existing_overlap", "memory_type", "text_key",
    )


def rollup_evidence(items: DataFrame) -> DataFrame:
    """(candidate_id, id) rows behind the candidates."""
    compact = tx.squash(F.lower(F.col("summary")), "")
    key = F.sha2(compact, 256)
    return items.select(F.substring(F.sha1(F.concat_ws("\n", F.col("memory_type"), key)), 1, 16).alias("candidate_id"), "id")


def prompt_cost(calls: DataFrame, messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of model calls: `calls` has keys and `tools` array<struct<name,schema>>, `messages` keys, pos, role, content.

    Adds system, message and schema characters, tool count, estimated tokens and the five largest
    schemas. The size of the JSON list of messages is summed up message by message.
    """
    text = F.struct("role", "content")
    said = messages.select(*keys, "pos", "role", F.coalesce(F.length("content"), F.lit(0)).alias("chars"), F.length(F.to_json(text)).alias("json"))
    sums = said.groupBy(*keys).agg(
        (F.sum("json") + F.count(F.lit(1)) + 1).alias("__json"), F.sum("chars").alias("__chars"), F.min_by(F.struct("role", "chars"), "pos").alias("__first"),
    )
    joined = calls.join(sums, list(keys), "left").withColumn("messages_json_chars", F.coalesce("__json", F.lit(2))).withColumn("tools_schema_chars", F.length(F.to_json("tools")))
    ranked = F.slice(
        F.reverse(F.array_sort(F.transform("tools", lambda s: F.struct(F.length(F.to_json(s)).alias("chars"), s["name"].alias("name"))))), 1, 5
    )
    return joined.select(
        *[c for c in joined.columns if not c.startswith("__")],
        F.when(F.col("__first.role") == "system", F.col("__first.chars")).otherwise(0).alias("system_chars"),
        F.coalesce("__chars", F.lit(0)).alias("messages_chars"),
        F.size("tools").alias("tool_count"),
        F.greatest(F.lit(1), F.floor((F.col("messages_json_chars") + F.col("tools_schema_chars")) / 3)).alias("estimated_input_tokens"),
        ranked.alias("largest_schemas"),
    )


def cost_delta(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size differences (after minus before) per call, matched by `keys`."""
    names = ["system_chars", "messages_json_chars", "tools_schema_chars", "tool_count", "estimated_input_tokens"]
    b, a = before.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names]), after.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names])
    return b.join(a, list(keys)).select(*keys, *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names])


def recall_turns(log: DataFrame) -> DataFrame:
    """Fold log records into turns: first non-empty fields, counts of prepared and recalled items.

    `log`: turn_id, ord, kind, engine, channel, session_key, user_text, ts, count. Records of other
    engines are ignored.
    """
    engine = F.coalesce("engine", F.lit(""))
    mine = F.when(engine != "", engine == "default").otherwise(
        (F.coalesce("channel", F.lit("")) != "cross_mem") & ~F.startswith(F.coalesce("session_key", F.lit("")), F.lit("cross_mem:"))
    )
    rows = log.filter(mine & (F.coalesce("turn_id", F.lit("")) != ""))
    recall, prepare = F.col("kind") == "recall_memory", F.col("kind") == "context_prepare"

    def first(name: str) -> Column:
        there = F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
        return F.min_by(F.when(there, F.col(name)), F.when(there, F.col("ord"))).alias(name)

    return rows.groupBy("turn_id").agg(
        *[first(c) for c in ("session_key", "channel", "user_text", "ts")],
        F.coalesce(F.max_by(F.when(prepare, F.col("count")), F.when(prepare, F.col("ord"))), F.lit(0)).alias("context_prepare_count"),
        F.coalesce(F.sum(F.when(recall, F.coalesce("count", F.lit(0)))), F.lit(0)).alias("recall_memory_count"),
        F.count_if(recall).alias("recall_call_count"),
    )


def count_in_window(df: DataFrame, hours: int, now: Column, key: str = "session_key", ts: str = "ts") -> DataFrame:
    """Rows per key in the last hours before `now`."""
    return df.filter((F.col(ts) >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= now)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def topic_groups(messages: DataFrame, min_count: int = 1, keyword: str = "", sample: int = 8) -> DataFrame:
    """Per topic: message count, latest time, first text and up to `sample` earliest texts.

    `messages`: topic_id, ts, message_id, text. Topics that do not mention `keyword` are left out.
    """
    kept = messages.filter(F.col("topic_id").isNotNull())
    said = kept.filter(F.coalesce("text", F.lit("")) != "")
    first = top_rows(said, ["topic_id"], [F.col("ts"), F.col("message_id")], sample, "n")
    texts = first.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]).alias("recent_texts"))
    stats = kept.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("latest"))
    out = stats.filter(F.col("count") >= min_count).join(texts, "topic_id", "left")
    out = out.withColumn("example", F.try_element_at("recent_texts", F.lit(1)))
    if keyword:
        text = F.concat_ws(" ", "example", "recent_texts")
        out = out.filter(F.contains(F.lower(text), F.lit(keyword.lower())))
    return out


def topic_order() -> list[Column]:
    return [F.col("count").desc(), F.col("latest").desc(), F.col("topic_id")]


# Tools whose repeats are normal.
REPEATABLE_TOOLS = ("task_output", "task_stop")


def repeat_runs(calls: DataFrame, limit: int = 3, bucket_seconds: int = TIME_BUCKET_SECONDS) -> DataFrame:
    """Length of the run of identical calls up to each call, and whether the guard stops it.

    `calls`: session_key, ts, id, tool, args. Calls of repeatable tools are skipped.
    """
    keep = calls.filter(~F.coalesce(F.col("tool").isin(*REPEATABLE_TOOLS), F.lit(False)))
    signed = keep.withColumn("signature", F.concat_ws(":", "tool", "args"))
    order = [F.col("ts"), F.col("id")]
    bucket = time_bucket("ts", bucket_seconds)
    prev = carry_last(signed, ["session_key"], bucket, order, F.col("signature"), "__prev")
    prev = prev.withColumn("__start", (~F.col("signature").eqNullSafe(F.col("__prev"))).cast("int"))
    numbered = position(prev, ["session_key"], bucket, order, "__n")
    started = carry_last(numbered, ["session_key"], bucket, order, F.when(F.col("__start") == 1, F.col("__n")), "__from", inclusive=True)
    run = (F.col("__n") - F.col("__from") + 1).cast("bigint")
    return started.withColumn("repeat_count", run).withColumn("denied", run >= max(2, limit)).drop("__prev", "__start", "__n", "__from")


def p90_exclusive(values: Column) -> Column:
    """Ninth decile by the exclusive method; beyond the ends it extrapolates."""
    ordered = F.array_sort(values)
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(9 * (n + 1) / 10).cast("int"), n - 1))
    delta = 9 * (n + 1) - j * 10
    low, high = F.try_element_at(ordered, j), F.try_element_at(ordered, j + 1)
    return (low * (10 - delta) + high * delta) / 10.0


def latency_p90(df: DataFrame, window: int = 20, default: float = 25.0, bucket_seconds: int = TIME_BUCKET_SECONDS) -> DataFrame:
    """P90 of the last `window` samples up to each sample; `default` below three samples.

    `df`: key, ts, id, seconds. Buckets of one key are scanned apart; each one also gets the last
    samples before it, found from the tails of the buckets before.
    """
    back = window - 1
    rows = df.withColumn("__b", time_bucket("ts", bucket_seconds))
    tail = top_rows(rows, ["key", "__b"], [F.col("ts").desc(), F.col("id").desc()], back, "__r")
    tails = tail.groupBy("key", "__b").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "seconds"))).alias("__tail"))
    over = Window.partitionBy("key").orderBy("__b").rowsBetween(-back, -1)
    # every bucket has at least one sample, so `back` buckets hold at least `back` samples
    before = tails.select("key", "__b", F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("__tail").over(over)))), 1, back).alias("__before"))
    local = Window.partitionBy("key", "__b").orderBy("ts", "id").rowsBetween(-back, 0)
    scanned = rows.withColumn("__mine", F.collect_list("seconds").over(local)).withColumn(
        "__n", F.row_number().over(Window.partitionBy("key", "__b").orderBy("ts", "id"))
    )
    joined = scanned.join(before, ["key", "__b"])
    missing = F.greatest(F.lit(window) - F.col("__n"), F.lit(0))
    samples = F.concat(F.col("__mine"), F.transform(F.slice("__before", F.lit(1), missing), lambda s: s["seconds"]))
    sized = joined.withColumn("__s", samples)
    lead = F.when(F.size("__s") < 3, F.lit(default)).otherwise(p90_exclusive(F.col("__s")))
    return sized.withColumn("samples", F.size("__s")).withColumn("p90", lead).drop("__b", "__mine", "__n", "__before", "__s")


def quota_days(df: DataFrame, reset_hour: int, zone: str, daily_max: int, min_interval_s: int, bucket_seconds: int = TIME_BUCKET_SECONDS) -> DataFrame:
    """Quota state before each action: local day key, used count, last action and the gate reason.

    `df`: key, ts, id. A day starts at `reset_hour` local time.
    """
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone) - F.expr(f"INTERVAL {reset_hour} HOURS")
    day = F.date_format(local, "yyyy-MM-dd")
    order = [F.col("ts"), F.col("id")]
    bucket = time_bucket("ts", bucket_seconds)
    keyed = df.withColumn("window_key", F.concat(day, F.lit(f"@{reset_hour:02d}@{zone}")))
    used = position(keyed, ["key", "window_key"], bucket, order, "used").withColumn("used", F.col("used") - 1)
    last = carry_last(used, ["key"], bucket, order, F.col("ts"), "last_action_at")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_action_at").cast("timestamp"))
    reason = (
        F.when(F.col("used") >= daily_max, "quota_exhausted")
        .when(F.col("last_action_at").isNotNull() & (gap < min_interval_s * 1_000_000), "min_interval")
        .otherwise("ok")
    )
    return last.withColumn("remaining", F.greatest(F.lit(daily_max) - F.col("used"), F.lit(0))).withColumn("reason", reason)


def recent_events(df: DataFrame, start: Column, end: Column, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The latest `n` events of a half-open range, per key if given."""
    ranged = df.filter((F.col("ts") >= start) & (F.col("ts") < end))
    limit = max(1, n)
    if not keys:
        return ranged.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)
    return top_rows(ranged, list(keys), [F.col("ts").desc(), F.col("id").desc()], limit, "__n").drop("__n")


def run_status(final: Column, skip: Column, gate: Column, action: Column, finished: Column) -> Column:
    """failed, needs_approval, completed or pending, from texts and fields of a run."""
    texts = F.concat_ws(" ", F.coalesce(final, F.lit("")), F.coalesce(skip, F.lit("")), F.coalesce(gate, F.lit("")))
    asks = F.rlike(F.lower(F.coalesce(skip, F.lit(""))), F.lit("approval|confirm|人工"))
    ended = (F.coalesce(action, F.lit("")) != "") | finished.isNotNull()
    return F.when(looks_failed(texts), "failed").when(asks, "needs_approval").when(ended, "completed").otherwise("pending")


def normal_url(col: Column) -> Column:
    """URL with lower-case scheme and host, no fragment and no slash at the end of the path."""
    text = tx.strip(F.coalesce(col, F.lit("")))
    pattern = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, search = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3, 4))
    short = F.regexp_replace(path, "/+$", "")
    kept = F.when(short == "", path).otherwise(short)
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""),
        kept,
        F.when(search != "", F.concat(F.lit("?"), search)).otherwise(""),
    )


def _json_list(items: Column) -> Column:
    """JSON list of strings with a blank behind each comma."""
    quoted = F.transform(items, lambda i: F.concat(F.lit('"'), F.replace(F.replace(i, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def delivery_ref(item: Column, url: Column, source: Column, title: Column) -> Column:
    """Reference of one cited item: its URL, else source and title, else its id."""
    link, name = normal_url(url), F.lower(tx.strip(F.coalesce(title, F.lit(""))))
    return (
        F.when(link != "", F.concat(F.lit("url:"), link))
        .when(name != "", F.concat(F.lit("title:"), F.lower(tx.strip(F.coalesce(source, F.lit("")))), F.lit("|"), name))
        .otherwise(F.concat(F.lit("id:"), item))
    )


def delivery_key(refs: Column, ids: Column, message: Column) -> Column:
    """Key of a delivery: its references if any is more than an id, else its ids, else its text."""
    sorted_refs = F.array_sort(F.array_distinct(refs))
    named = F.exists(sorted_refs, lambda r: ~F.startswith(r, F.lit("id:")))
    source = (
        F.when((F.size(sorted_refs) > 0) & named, _json_list(sorted_refs))
        .when(F.size(ids) > 0, _json_list(F.array_sort(ids)))
        .otherwise(F.substring(F.coalesce(message, F.lit("")), 1, 500))
    )
    return F.substring(F.sha1(source), 1, 16)
