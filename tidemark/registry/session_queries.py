"""Conversation logs as sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evals, maintain, relations, sessions
from tidemark.registry.core import Tables, query
from tidemark.registry.memory_queries import big, now
from tidemark.registry import sqltext as q


def messages(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_key"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def framed(t: Tables) -> DataFrame:
    """Messages where the system turn is an injected context frame of the user."""
    system = F.col("role") == "system"
    return messages(t).select(
        "session_key", "seq", F.when(system, "user").otherwise(F.col("role")).alias("role"),
        F.when(system, F.concat(F.lit("<system-reminder>"), "content")).otherwise(F.col("content")).alias("content"),
    )


def cursors(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_key"), (F.col("conv_id") % 5).alias("last_consolidated")).distinct()


_POS = "p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS total, conv_id % 5 AS cur FROM conversations)"


@query(
    "parent_counts",
    """SELECT 'c' || c_custkey AS parent, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
    UNION ALL SELECT 's' || conv_id, count(*) FILTER (role = 'user') FROM conversations GROUP BY conv_id""",
)
def parent_counts(t: Tables) -> DataFrame:
    shops = relations.with_counts(t.customer, t.orders, "c_custkey", "o_custkey")
    talks = relations.with_counts(t.conversations.select("conv_id").distinct(), t.conversations.filter("role = 'user'"), "conv_id", "conv_id")
    return shops.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("parent"), "n").unionByName(
        talks.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("parent"), "n")
    )


@query(
    "context_range_join",
    """WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND contains(text, 'on'))
    SELECT c.conv_id, c.turn, max((h.turn = c.turn)::INT) = 1 AS in_source_ref FROM conversations c JOIN h ON h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 2 AND h.turn + 2 GROUP BY 1, 2""",
)
def context_range_join(t: Tables) -> DataFrame:
    log = messages(t)
    hits = log.filter((F.col("role") == "assistant") & F.contains("content", F.lit("on"))).select("session_key", "seq")
    return sessions.with_context(log, hits, 2).select(F.col("session_key").alias("conv_id"), F.col("seq").alias("turn"), "in_source_ref")


@query(
    "id_list_fetch",
    "SELECT conv_id || ':' || turn AS id, min(event_id) AS pos, any_value(role) AS role FROM events JOIN conversations ON conv_id = user_id AND turn = floor(value)::BIGINT % 8 GROUP BY 1",
)
def id_list_fetch(t: Tables) -> DataFrame:
    wanted = t.events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), (F.floor("value") % 8).cast("string")).alias("id"), F.col("event_id").alias("pos")
    )
    log = messages(t).withColumn("id", sessions.message_id())
    return sessions.fetch_in_order(log, wanted).orderBy("pos").select("id", "pos", "role")


@query(
    "history_window",
    f"""WITH {_POS}, b AS (SELECT conv_id, max(total) AS total, max(cur) AS cur, max(pos) FILTER (role = 'user' AND pos <= cur) AS before, min(pos) FILTER (role = 'user') AS first FROM p GROUP BY 1)
    SELECT 'last' AS mode, conv_id, turn FROM p WHERE pos >= total - 3
    UNION ALL SELECT 'cursor', p.conv_id, turn FROM p JOIN b USING (conv_id) WHERE b.cur < b.total AND pos >= coalesce(before, first)""",
)
def history_window(t: Tables) -> DataFrame:
    start = cursors(t).withColumnRenamed("last_consolidated", "start_index")
    tail = sessions.history(messages(t), 3).withColumn("mode", F.lit("last"))
    since = sessions.history(messages(t), 500, start).withColumn("mode", F.lit("cursor"))
    cols = ["mode", F.col("session_key").alias("conv_id"), F.col("seq").alias("turn")]
    return tail.select(*cols).unionByName(since.select(*cols))


_TURN = """f AS (SELECT conv_id, turn, role = 'system' AS frame, role = 'user' AS usr, role = 'assistant' AS reply FROM conversations),
  a AS (SELECT r.conv_id, r.turn, (SELECT max(turn) FROM f x WHERE x.conv_id = r.conv_id AND x.turn < r.turn AND NOT x.frame) AS prev FROM f r WHERE reply),
  b AS (SELECT a.conv_id, max(a.turn) AS reply_at FROM a JOIN f ON f.conv_id = a.conv_id AND f.turn = a.prev AND f.usr GROUP BY 1),
  c AS (SELECT b.conv_id, reply_at, prev AS user_at FROM b JOIN a ON a.conv_id = b.conv_id AND a.turn = b.reply_at),
  d AS (SELECT c.*, coalesce((SELECT max(turn) FROM f x WHERE x.conv_id = c.conv_id AND x.turn < user_at AND NOT x.frame), -1) AS border FROM c),
  tp AS (SELECT conv_id, reply_at AS turn, 'assistant' AS part FROM d UNION ALL SELECT conv_id, user_at, 'user' FROM d
    UNION ALL SELECT d.conv_id, f.turn, 'context' FROM d JOIN f ON f.conv_id = d.conv_id AND f.frame AND f.turn < user_at AND f.turn > border)"""


@query("last_turn", f"WITH {_TURN} SELECT * FROM tp")
def last_turn(t: Tables) -> DataFrame:
    return sessions.last_turn(framed(t)).select(F.col("session_key").alias("conv_id"), F.col("seq").alias("turn"), "part")


@query(
    "last_dialogue_pair",
    """WITH u AS (SELECT conv_id, max(turn) AS ut, arg_max(trim(text), turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY 1),
    a AS (SELECT conv_id, max(turn) AS at_, arg_max(trim(text), turn) AS last_assistant FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, md5(coalesce(last_user, '')) AS last_user, md5(CASE WHEN ut IS NULL OR at_ > ut THEN coalesce(last_assistant, '') ELSE '' END) AS last_assistant FROM u FULL JOIN a USING (conv_id)""",
)
def last_dialogue_pair(t: Tables) -> DataFrame:
    out = sessions.last_dialogue_pair(messages(t))
    return out.select(F.col("session_key").alias("conv_id"), F.md5("last_user").alias("last_user"), F.md5("last_assistant").alias("last_assistant"))


@query(
    "consolidation_window",
    f"""WITH {_POS}, w AS (SELECT conv_id, turn, pos, total - 2 AS up_to, role FROM p WHERE total > cur AND total - 2 > 0 AND total - 2 - cur >= 2 AND pos >= cur AND pos < total - 2)
    SELECT conv_id, up_to, count(*) FILTER (role <> 'system') AS n, '["' || string_agg(conv_id || ':' || turn, '","' ORDER BY turn) FILTER (role <> 'system') || '"]' AS source_ref FROM w GROUP BY ALL HAVING count(*) FILTER (role <> 'system') > 0""",
)
def consolidation_window(t: Tables) -> DataFrame:
    window = sessions.consolidation_window(framed(t), cursors(t), keep=2, min_new=2)
    return sessions.window_refs(window).select(F.col("session_key").alias("conv_id"), *big("up_to"), "n", "source_ref")


@query(
    "turn_sessions",
    """WITH s AS (SELECT conv_id, turn, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
      sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id) AS k FROM conversations)
    SELECT conv_id, turn, least(n, greatest(k - 1, 0))::BIGINT AS session_no FROM s""",
)
def turn_sessions(t: Tables) -> DataFrame:
    return sessions.turn_sessions(messages(t)).select(F.col("session_key").alias("conv_id"), F.col("seq").alias("turn"), "session_no")


@query(
    "assign_seq",
    """WITH m AS (SELECT conv_id, max(turn) + 1 AS nx FROM conversations GROUP BY 1),
    n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
    SELECT event_id, coalesce(nx, 0) + k AS seq, user_id || ':' || (coalesce(nx, 0) + k) AS id FROM n LEFT JOIN m ON conv_id = user_id""",
)
def assign_seq(t: Tables) -> DataFrame:
    new = t.events.select(F.col("user_id").alias("session_key"), F.col("event_id").alias("ord"))
    return sessions.append_messages(messages(t), new).select(F.col("ord").alias("event_id"), "seq", "id")


@query(
    "backlog_status",
    f"""WITH {_POS} SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS total_user, count(*) FILTER (role = 'user' AND pos < cur) AS consolidated_user,
      count(*) FILTER (role = 'user' AND pos >= cur) AS pending_user, md5(coalesce(arg_max(trim(text), turn) FILTER (role = 'user' AND pos < cur), '')) AS last_text FROM p GROUP BY conv_id""",
)
def backlog_status(t: Tables) -> DataFrame:
    out = sessions.backlog(framed(t), cursors(t))
    return out.select(
        F.col("session_key").alias("conv_id"), "messages", "total_user", "consolidated_user", "pending_user", F.md5(F.coalesce("last_user_text", F.lit(""))).alias("last_text")
    )


@query(
    "undo_turn",
    f"""WITH {_TURN}, {_POS}, k AS (SELECT p.conv_id, min(pos) AS fp, count(*) AS n_cut FROM p JOIN tp USING (conv_id, turn) GROUP BY 1),
    s AS (SELECT conv_id, max(total) AS total, max(cur) AS cur FROM p GROUP BY 1),
    r AS (SELECT s.*, fp, n_cut, CASE WHEN fp >= cur THEN least(cur, total - n_cut) ELSE least(fp, cur) END AS rb FROM s LEFT JOIN k USING (conv_id)),
    z AS (SELECT r.conv_id, count(*) FILTER (p.pos < rb) AS nb FROM r JOIN p USING (conv_id) JOIN tp ON tp.conv_id = p.conv_id AND tp.turn = p.turn GROUP BY 1)
    SELECT r.conv_id, coalesce(least(greatest(rb - coalesce(nb, 0), 0), total - n_cut), cur) AS last_consolidated, coalesce(n_cut, 0) AS removed, total - coalesce(n_cut, 0) AS left_over FROM r LEFT JOIN z USING (conv_id)""",
)
def undo_turn(t: Tables) -> DataFrame:
    remaining, state = sessions.undo_turn(framed(t), cursors(t))
    left = relations.with_counts(state, remaining, "session_key", "session_key", "left_over")
    return left.select(F.col("session_key").alias("conv_id"), "last_consolidated", "removed", "left_over")


@query(
    "upsert_sessions",
    f"""WITH o AS (SELECT conv_id AS k, conv_id % 5 AS lc, {q.NOW} - INTERVAL 9 DAY AS created FROM conversations GROUP BY 1),
    c AS (SELECT user_id AS k, max(ts) AS up, min(ts) AS cr, max(ts) FILTER (event_type <> 'error') AS lu, max(ts) FILTER (event_type = 'signup') AS lp FROM events GROUP BY 1)
    SELECT coalesce(o.k, c.k)::VARCHAR AS session_key, strftime(coalesce(created, cr), '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(lc, 0) AS last_consolidated,
      coalesce(strftime(lu, '%Y-%m-%d %H:%M:%S'), '') AS last_user_at, coalesce(strftime(lp, '%Y-%m-%d %H:%M:%S'), '') AS last_proactive_at FROM o FULL JOIN c ON o.k = c.k""",
)
def upsert_sessions(t: Tables) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    target = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("session_key"), (now() - F.expr("INTERVAL 9 DAYS")).alias("created_at"), (now() - F.expr("INTERVAL 9 DAYS")).alias("updated_at"),
        (F.col("conv_id") % 5).alias("last_consolidated"), F.lit("{}").alias("metadata"), none.alias("last_user_at"), none.alias("last_proactive_at"),
    )
    changes = t.events.select(
        F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("ord"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("bigint").alias("last_consolidated"), F.lit(None).cast("string").alias("metadata"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("last_user_at"), F.when(F.col("event_type") == "signup", F.col("ts")).alias("last_proactive_at"),
    )
    out = sessions.upsert_sessions(target, changes, now())
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return out.select("session_key", stamp("created_at"), "last_consolidated", stamp("last_user_at"), stamp("last_proactive_at"))


@query(
    "presence",
    """SELECT 'cli:' || user_id AS session_key, coalesce(strftime(max(ts) FILTER (event_type IN ('click', 'view', 'purchase')), '%Y-%m-%d %H:%M:%S'), '') AS last_user_at,
      coalesce(strftime(max(ts) FILTER (event_type = 'signup'), '%Y-%m-%d %H:%M:%S'), '') AS last_proactive_at,
      (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events WHERE event_type IN ('click', 'view', 'purchase')) AS most_recent_user_at, 'cli' AS channel, user_id::VARCHAR AS chat_id
    FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0""",
)
def presence(t: Tables) -> DataFrame:
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return sessions.presence(presence_events(t)).select(
        "session_key", stamp("last_user_at"), stamp("last_proactive_at"), stamp("most_recent_user_at"), "channel", "chat_id"
    )


def presence_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "user").when(F.col("event_type") == "signup", "proactive")
    return t.events.select(F.concat(F.lit("cli:"), F.col("user_id").cast("string")).alias("session_key"), kind.alias("kind"), "ts")


@query(
    "cascade_delete",
    """WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT 'cascade' AS mode, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM g)) AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM g)) AS children
    UNION ALL SELECT 'refuse', (SELECT count(*) FROM orders), (SELECT count(*) FROM lineitem)""",
)
def cascade_delete(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    out = None
    for mode, cascade in (("cascade", True), ("refuse", False)):
        parents, children = maintain.cascade_delete(t.orders, t.lineitem, keys, "o_orderkey", "l_orderkey", cascade)
        n = children.agg(F.count(F.lit(1)).alias("c")).scalar()
        row = parents.agg(F.count(F.lit(1)).alias("parents")).select(F.lit(mode).alias("mode"), "parents", n.alias("children"))
        out = row if out is None else out.unionByName(row)
    return out


_QA = f"""
  pr AS (SELECT a.conv_id * 1000 + a.turn AS case_id, 'type' || (a.conv_id % 5) AS qt, a.text AS pred, coalesce(u.text, '') AS gold, CASE WHEN u.text IS NULL THEN 'no question' ELSE '' END AS err,
      CASE WHEN a.turn % 3 = 0 THEN length(a.text) > length(coalesce(u.text, '')) END AS jc FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
  nm AS (SELECT *, {q.qa_norm("pred")} AS np, {q.qa_norm("gold")} AS ng FROM pr),
  tk AS (SELECT case_id, tok, count(*) FILTER (s = 1) AS p, count(*) FILTER (s = 0) AS g FROM (
    SELECT case_id, unnest(string_split(np, ' ')) AS tok, 1 AS s FROM nm WHERE np <> '' UNION ALL SELECT case_id, unnest(string_split(ng, ' ')), 0 FROM nm WHERE ng <> '') GROUP BY 1, 2),
  sm AS (SELECT case_id, sum(least(p, g)) AS same, sum(p) AS n_p, sum(g) AS n_g FROM tk GROUP BY 1),
  fs AS (SELECT nm.*, CASE WHEN err <> '' THEN 0 WHEN np = '' OR ng = '' THEN (np = ng)::INT WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * (same / n_p) * (same / n_g) / (same / n_p + same / n_g) END::DOUBLE AS f1,
      CASE WHEN err <> '' THEN 0 ELSE (np = ng)::INT END AS em FROM nm LEFT JOIN sm USING (case_id))"""


def qa_rows(t: Tables) -> DataFrame:
    a = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("predicted_answer"))
    u = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold_answer"))
    both = a.join(u, ["conv_id", "turn"], "left")
    longer = F.length("predicted_answer") > F.length(F.coalesce("gold_answer", F.lit("")))
    return both.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.concat(F.lit("type"), (F.col("conv_id") % 5).cast("string")).alias("question_type"),
        "predicted_answer", "gold_answer", F.when(F.col("gold_answer").isNull(), "no question").otherwise("").alias("error"),
        F.when(F.col("turn") % 3 == 0, longer).alias("judge_correct"),
    )


@query(
    "qa_scores",
    f"""WITH {_QA} SELECT coalesce(qt, '__all__') AS question_type, round(avg(f1), 4) AS f1, round(avg(em), 4) AS em, round(coalesce(avg(jc::INT) FILTER (err = ''), -1), 4) AS judge_acc,
      count(*) AS n, count(*) FILTER (err <> '') AS errors FROM fs GROUP BY ROLLUP (qt)""",
)
def qa_scores(t: Tables) -> DataFrame:
    out = evals.qa_scores(qa_rows(t))
    return out.select("question_type", "f1", "em", F.coalesce("judge_acc", F.lit(-1.0)).alias("judge_acc"), "n", "errors")


@query("qa_pair_scores", f"WITH {_QA} SELECT case_id, round(CASE WHEN np = '' OR ng = '' THEN (np = ng)::INT ELSE f1 END, 6) AS f1, (np = ng)::INT::DOUBLE AS em FROM fs")
def qa_pair_scores(t: Tables) -> DataFrame:
    out = evals.qa_pair_scores(qa_rows(t), "case_id", "predicted_answer", "gold_answer")
    return out.select("case_id", F.round("f1", 6).alias("f1"), "em")
