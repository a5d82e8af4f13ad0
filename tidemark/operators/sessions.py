"""Conversation logs: context, history and consolidation windows, turns, sequence numbers.

Messages have session_key, seq, role, content; an `id` is `session_key:seq`. One session may be
very long, so running values use the bucketed windows of `operators.windows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.windows import carry_last, position, seq_bucket

KEY = ["session_key"]

# How an injected context message starts.
CONTEXT_FRAMES = ("<system-reminder", "[SYSTEM_CONTEXT_FRAME]")


def message_id() -> Column:
    return F.concat_ws(":", F.col("session_key").cast("string"), F.col("seq").cast("string"))


def is_context_frame(content: Column) -> Column:
    text = tx.strip(F.coalesce(content, F.lit("")))
    return F.startswith(text, F.lit(CONTEXT_FRAMES[0])) | F.startswith(text, F.lit(CONTEXT_FRAMES[1]))


def real_user() -> Column:
    return (F.col("role") == "user") & (tx.strip(F.coalesce("content", F.lit(""))) != "") & ~is_context_frame(F.col("content"))


def _proactive(messages: DataFrame) -> Column:
    return F.coalesce(F.col("proactive"), F.lit(False)) if "proactive" in messages.columns else F.lit(False)


def with_context(messages: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Hit messages and up to `n` sequence numbers around them, once each, with a hit flag.

    `hits` has session_key, seq. Every hit lists its neighbours, which makes the range an equi-join.
    """
    near = hits.select(
        "session_key", F.explode(F.sequence(F.greatest(F.col("seq") - n, F.lit(0)), F.col("seq") + n)).alias("near"), "seq"
    )
    wanted = near.groupBy("session_key", "near").agg(F.max((F.col("near") == F.col("seq")).cast("int")).alias("hit"))
    wanted = wanted.select("session_key", F.col("near").alias("seq"), (F.col("hit") == 1).alias("in_source_ref"))
    return messages.join(wanted, ["session_key", "seq"])


def fetch_in_order(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows named by an id list (id, pos); `pos` gives the order. A repeated id counts once."""
    first = ids.groupBy(F.col("id").alias(id_col)).agg(F.min("pos").alias("pos"))
    return df.join(first, id_col)


def history(messages: DataFrame, n: int, start: DataFrame | None = None) -> DataFrame:
    """The last `n` messages per session, or those from a cursor on.

    With `start` (session_key, start_index: 0-based position) the cursor moves back to the closest
    user or proactive message; if there is none, on to the first one after it.
    """
    order = [F.col("seq")]
    if start is None:
        if n <= 0:
            return messages.limit(0)
        back = position(messages, KEY, seq_bucket("seq"), [F.col("seq").desc()], "__back", descending=True)
        return back.filter(F.col("__back") <= n).drop("__back")
    if n <= 0:
        return messages.limit(0)
    placed = position(messages, KEY, seq_bucket("seq"), order, "__pos").withColumn("__pos", F.col("__pos") - 1)
    edge = (F.col("role") == "user") | ((F.col("role") == "assistant") & _proactive(messages))
    cursors = start.select("session_key", F.greatest(F.col("start_index"), F.lit(0)).alias("__start"))
    joined = placed.join(cursors, "session_key")
    bounds = joined.groupBy("session_key").agg(
        F.max(F.when(edge & (F.col("__pos") <= F.col("__start")), F.col("__pos"))).alias("__before"),
        F.min(F.when(edge, F.col("__pos"))).alias("__first"),
        F.count(F.lit(1)).alias("__n"),
        F.first("__start").alias("__at"),
    )
    begin = bounds.filter(F.col("__at") < F.col("__n")).select("session_key", F.coalesce("__before", "__first").alias("__begin"))
    return placed.join(begin, "session_key").filter(F.col("__pos") >= F.col("__begin")).drop("__pos", "__begin")


def last_turn(messages: DataFrame) -> DataFrame:
    """Per session the latest reply with its user message and the context frames before it.

    Output: session_key, seq, part (`context`, `user`, `assistant`). A reply counts when the closest
    message before it that is no context frame is a real user message.
    """
    frame = (F.col("role") == "user") & is_context_frame(F.col("content"))
    bucket = seq_bucket("seq")
    marked = messages.select(
        "session_key", "seq", "role", frame.alias("frame"), ((F.col("role") == "user") & ~frame).alias("user"),
        ((F.col("role") == "assistant") & ~_proactive(messages)).alias("reply"),
    )
    solid = F.when(~F.col("frame"), F.struct("seq", "user"))
    prev = carry_last(marked, KEY, bucket, [F.col("seq")], solid, "prev")
    replies = prev.filter(F.col("reply") & F.col("prev.user"))
    chosen = replies.groupBy("session_key").agg(F.max(F.struct(F.col("seq"), F.col("prev.seq").alias("user_seq"))).alias("t"))
    turn = chosen.select("session_key", F.col("t.seq").alias("reply_seq"), F.col("t.user_seq").alias("user_seq"))
    before = prev.join(turn, "session_key").filter(F.col("seq") < F.col("user_seq"))
    border = before.groupBy("session_key").agg(F.max(F.when(~F.col("frame"), F.col("seq"))).alias("border"))
    parts = marked.join(turn, "session_key").join(border, "session_key", "left")
    part = (
        F.when(F.col("seq") == F.col("reply_seq"), "assistant")
        .when(F.col("seq") == F.col("user_seq"), "user")
        .when(F.col("frame") & (F.col("seq") < F.col("user_seq")) & (F.col("seq") > F.coalesce("border", F.lit(-1))), "context")
    )
    return parts.select("session_key", "seq", part.alias("part")).filter(F.col("part").isNotNull())


def last_dialogue_pair(messages: DataFrame) -> DataFrame:
    """Per session the last non-blank reply and the last non-blank user text before it (or at all)."""
    said = messages.filter(tx.strip(F.coalesce("content", F.lit(""))) != "")
    text = tx.strip(F.col("content"))
    reply = said.filter(F.col("role") == "assistant").groupBy("session_key").agg(
        F.max("seq").alias("reply_seq"), F.max_by(text, "seq").alias("last_assistant")
    )
    user = said.filter(F.col("role") == "user").groupBy("session_key").agg(
        F.max("seq").alias("user_seq"), F.max_by(text, "seq").alias("last_user")
    )
    both = user.join(reply, "session_key", "full_outer")
    answered = F.when(F.col("user_seq").isNull() | (F.col("reply_seq") > F.col("user_seq")), F.col("last_assistant"))
    return both.select("session_key", F.coalesce("last_user", F.lit("")).alias("last_user"), F.coalesce(answered, F.lit("")).alias("last_assistant"))


def keep_count(window: int) -> int:
    """Messages kept out of consolidation: half of the window rounded up to a multiple of six."""
    return max(6, ((max(1, window) + 5) // 6) * 6) // 2


def consolidation_window(
    messages: DataFrame, cursors: DataFrame, keep: int, min_new: int, *, force: bool = False, archive_all: bool = False
) -> DataFrame:
    """Messages after the cursor and before the last `keep`, for sessions with enough of them.

    `cursors`: session_key, last_consolidated (a count). Output: messages with pos, up_to.
    """
    placed = position(messages, KEY, seq_bucket("seq"), [F.col("seq")], "pos").withColumn("pos", F.col("pos") - 1)
    totals = messages.groupBy("session_key").agg(F.count(F.lit(1)).alias("total"))
    plan = totals.join(cursors, "session_key", "left").withColumn("start", F.coalesce("last_consolidated", F.lit(0)))
    if archive_all:
        plan = plan.withColumn("start", F.lit(0)).withColumn("up_to", F.col("total"))
    else:
        plan = plan.withColumn("up_to", F.col("total") - (0 if force else keep))
        enough = F.col("up_to") - F.col("start") >= (1 if force else max(1, min_new))
        plan = plan.filter((F.col("total") > F.col("start")) & (F.col("up_to") > 0) & enough)
    plan = plan.select("session_key", "start", "up_to")
    return placed.join(plan, "session_key").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("up_to"))).drop("start")


def window_refs(window: DataFrame) -> DataFrame:
    """The JSON id list of every consolidation window, without context frames."""
    kept = window.filter(~((F.col("role") == "user") & is_context_frame(F.col("content"))))
    parts = kept.groupBy("session_key", "up_to").agg(
        F.array_sort(F.collect_list(F.struct("seq", message_id().alias("id")))).alias("rows"), F.count(F.lit(1)).alias("n")
    )
    return parts.select("session_key", "up_to", "n", F.to_json(F.transform("rows", lambda r: r["id"])).alias("source_ref"))


def turn_sessions(messages: DataFrame) -> DataFrame:
    """Number the sessions of a dialogue: each ends with a reply; a trailing rest joins the last."""
    from tidemark.operators.windows import prefix_sum

    reply = (F.col("role") == "assistant").cast("int")
    closed = prefix_sum(messages, KEY, seq_bucket("seq"), [F.col("seq")], reply, "session_no", inclusive=False)
    last = messages.groupBy("session_key").agg(F.greatest(F.sum(reply) - 1, F.lit(0)).alias("__last"))
    joined = closed.join(last, "session_key")
    return joined.withColumn("session_no", F.least("session_no", "__last").cast("bigint")).drop("__last")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Number new messages per session after the current maximum; `new` has session_key, ord."""
    top = messages.groupBy("session_key").agg((F.max("seq") + 1).alias("__next"))
    placed = position(new, KEY, seq_bucket("ord"), [F.col("ord")], "__n")
    numbered = placed.join(top, "session_key", "left")
    out = numbered.withColumn("seq", (F.coalesce("__next", F.lit(0)) + F.col("__n") - 1).cast("bigint")).drop("__next", "__n")
    return out.withColumn("id", message_id())


def backlog(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Real user messages in total, consolidated and pending, and the last consolidated text."""
    placed = position(messages, KEY, seq_bucket("seq"), [F.col("seq")], "pos")
    joined = placed.join(cursors, "session_key", "left")
    done = F.col("pos") <= F.coalesce("last_consolidated", F.lit(0))
    user = real_user()
    return joined.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(user).alias("total_user"),
        F.count_if(user & done).alias("consolidated_user"),
        F.count_if(user & ~done).alias("pending_user"),
        F.max_by(F.when(user & done, tx.strip(F.col("content"))), F.when(user & done, F.col("seq"))).alias("last_user_text"),
    )


def undo_turn(messages: DataFrame, sessions: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove the last turn of every session and move its cursor back: (messages, sessions).

    `sessions`: session_key, last_consolidated. `sources` (session_key, seq) are messages whose
    memories were rolled back; the cursor goes back to the first of them when the turn was
    already consolidated.
    """
    turn = last_turn(messages)
    remaining = messages.join(turn, ["session_key", "seq"], "left_anti")
    placed = position(messages.select("session_key", "seq"), KEY, seq_bucket("seq"), [F.col("seq")], "pos").withColumn("pos", F.col("pos") - 1)
    cut = placed.join(turn.select("session_key", "seq"), ["session_key", "seq"])
    summary = cut.groupBy("session_key").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_cut"))
    totals = messages.groupBy("session_key").agg(F.count(F.lit(1)).alias("total"))
    plan = sessions.join(totals, "session_key", "left").join(summary, "session_key", "left")
    source_pos = F.lit(None).cast("bigint")
    if sources is not None:
        first = placed.join(sources, ["session_key", "seq"], "left_semi").groupBy("session_key").agg(F.min("pos").alias("source_pos"))
        plan = plan.join(first, "session_key", "left")
        source_pos = F.col("source_pos")
    old = F.greatest(F.col("last_consolidated"), F.lit(0))
    back = F.least(F.col("first_pos"), F.coalesce(source_pos, F.col("first_pos")), old)
    rollback = F.when(F.col("first_pos") >= old, F.least(old, F.col("total") - F.col("n_cut"))).otherwise(back)
    plan = plan.withColumn("rollback", rollback)
    before = cut.join(plan.select("session_key", "rollback"), "session_key").filter(F.col("pos") < F.col("rollback"))
    counts = before.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_before"))
    plan = plan.join(counts, "session_key", "left")
    moved = F.least(F.greatest(F.col("rollback") - F.coalesce("n_before", F.lit(0)), F.lit(0)), F.col("total") - F.col("n_cut"))
    cursor = F.coalesce(moved, F.col("last_consolidated")).cast("bigint")
    return remaining, plan.select("session_key", cursor.alias("last_consolidated"), F.coalesce("n_cut", F.lit(0)).alias("removed"))


def presence(events: DataFrame) -> DataFrame:
    """Last user and last proactive time per session, the latest user time overall, and the channel.

    `events`: session_key, kind (`user`, `proactive`), ts.
    """
    per = events.groupBy("session_key").agg(
        F.max(F.when(F.col("kind") == "user", F.col("ts"))).alias("last_user_at"),
        F.max(F.when(F.col("kind") == "proactive", F.col("ts"))).alias("last_proactive_at"),
    ).filter(F.col("last_user_at").isNotNull() | F.col("last_proactive_at").isNotNull())
    latest = events.agg(F.max(F.when(F.col("kind") == "user", F.col("ts"))).alias("t")).scalar()
    parts = F.split("session_key", ":", 2)
    return per.withColumn("most_recent_user_at", latest).withColumn("channel", F.element_at(parts, 1)).withColumn(
        "chat_id", F.element_at(parts, -1)
    )


def upsert_sessions(target: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Insert or update sessions; created_at and missing presence times keep their old values.

    `changes` has one row per key; several changes of one key are folded by `ord`, last one first.
    """
    names = ["last_consolidated", "metadata", "last_user_at", "last_proactive_at"]
    folded = changes.groupBy("session_key").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"n_{c}") for c in names],
        F.max("updated_at").alias("n_updated"), F.min("created_at").alias("n_created"),
    )
    joined = target.join(folded, "session_key", "full_outer")
    defaults = {"last_consolidated": F.lit(0), "metadata": F.lit("{}")}
    values = {c: F.coalesce(F.col(f"n_{c}"), F.col(c), defaults.get(c, F.lit(None))) for c in names}
    values["created_at"] = F.coalesce("created_at", "n_created", now)
    values["updated_at"] = F.coalesce("n_updated", "updated_at")
    return joined.select(
        *[values[c].cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns]
    )
