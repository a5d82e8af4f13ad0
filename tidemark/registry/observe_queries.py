"""Events as traces, turns, tool calls, runs, deliveries and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import observe, policy, relations
from tidemark.operators.windows import top_rows
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query
from tidemark.registry.memory_queries import big, key, now

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(name: str, out: str | None = None) -> Column:
    return F.coalesce(F.date_format(name, STAMP), F.lit("")).alias(out or name)


def sql_stamp(x: str, out: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m-%d %H:%M:%S'), '') AS {out}"


# -- scores -----------------------------------------------------------------------------------

_REWARD = """CASE event_type WHEN 'signup' THEN -1.0::DOUBLE WHEN 'error' THEN -1.5 ELSE 1.0 END
  + CASE WHEN event_id % 5 = 0 THEN 2.0 WHEN event_id % 7 = 0 THEN -2.0 ELSE 0.0 END + CASE WHEN event_id % 4 = 0 THEN (least(1.0, value / 100.0) - 0.5) * 2 ELSE 0 END
  + CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END + CASE WHEN value * 1000 > 30000 THEN -0.25 ELSE 0 END"""


def reward() -> Column:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "denied").when(kind == "error", "error").otherwise("Success")
    error = F.when(kind == "error", "timeout").otherwise("")
    vote = F.when(F.col("event_id") % 5 == 0, "thumbs_up").when(F.col("event_id") % 7 == 0, "Down")
    judge = F.when(F.col("event_id") % 4 == 0, F.col("value") / 100.0)
    return scoring.tool_reward(status, error, vote, judge, kind == "purchase", F.col("value") * 1000)


@query("tool_reward", f"SELECT event_id, round({_REWARD}, 4) AS reward FROM events")
def tool_reward(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(reward(), 4).alias("reward"))


_TOOLS = f"""tl AS (SELECT {q.key_of()} AS tool, round({_REWARD}, 6) AS r, event_type NOT IN ('signup', 'error') AS ok, ts FROM events),
  ts_ AS (SELECT tool, count(*) AS n, sum(r) AS total, count(*) FILTER (ok) / count(*)::DOUBLE AS rate, max(ts) AS last FROM tl GROUP BY 1)"""


def tool_stats(t: Tables) -> DataFrame:
    rows = t.events.select(key().alias("tool"), reward().alias("reward"), ~F.col("event_type").isin("signup", "error"), "ts").toDF("tool", "reward", "success", "ts")
    return policy.tool_policy(rows)


@query("tool_policy_stats", f"WITH {_TOOLS} SELECT tool, n AS count, round(total, 6) AS total_reward, round(round(total, 6) / n, 5) AS avg_reward, round(rate, 6) AS success_rate, {sql_stamp('last', 'last_used_at')} FROM ts_")
def tool_policy_stats(t: Tables) -> DataFrame:
    out = tool_stats(t)
    return out.select("tool", "count", "total_reward", F.round("avg_reward", 5).alias("avg_reward"), "success_rate", stamp("last_used_at"))


@query(
    "bandit_rank",
    f"""WITH {_TOOLS}, c AS (SELECT DISTINCT p_size::BIGINT * 4 AS tool FROM part), g AS (SELECT sum(n) AS total FROM ts_),
    s AS (SELECT c.tool, round(coalesce(round(ts_.total, 6) / n, 0.25) + CASE WHEN n > 0 THEN sqrt(ln(greatest(2, g.total + 1)) / n) ELSE 1.0 END, 9) AS score FROM c LEFT JOIN ts_ USING (tool), g)
    SELECT tool, score, row_number() OVER (ORDER BY score DESC, tool) AS rank FROM s""",
)
def bandit_rank(t: Tables) -> DataFrame:
    candidates = t.part.select((F.col("p_size").cast("bigint") * 4).alias("tool")).distinct()
    return policy.bandit_rank(tool_stats(t), candidates).select("tool", "score", *big("rank"))


_USERS = f"""us AS (SELECT user_id, max(ts) FILTER (event_type IN ('click', 'view', 'purchase')) AS lu, max(ts) FILTER (event_type = 'signup') AS lp,
    count(*) FILTER (event_type = 'purchase' AND ts >= {q.NOW} - INTERVAL 7 DAY) AS items, count(*) FILTER (ts >= {q.NOW} - INTERVAL 3 DAY) AS msgs,
    count(*) FILTER (event_type = 'signup' AND ts >= {q.NOW} - INTERVAL 24 HOUR) AS sent FROM events GROUP BY 1),
  mx AS (SELECT max(lu) AS la FROM us)"""


def users(t: Tables) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    since = lambda n, unit: ts >= now() - F.expr(f"INTERVAL {n} {unit}")
    return t.events.groupBy("user_id").agg(
        F.max(F.when(kind.isin("click", "view", "purchase"), ts)).alias("lu"),
        F.max(F.when(kind == "signup", ts)).alias("lp"),
        F.count_if((kind == "purchase") & since(7, "DAYS")).alias("items"),
        F.count_if(since(3, "DAYS")).alias("msgs"),
        F.count_if((kind == "signup") & since(24, "HOURS")).alias("sent"),
    )


@query(
    "engagement_energy",
    f"""WITH {_USERS}, m AS (SELECT *, greatest((epoch_us({q.NOW}) - epoch_us(lu)) / 60000000.0::DOUBLE, 0) AS mi FROM us),
    e AS (SELECT *, coalesce(0.5 * exp(-mi / 30.0::DOUBLE) + 0.35 * exp(-mi / 240.0::DOUBLE) + 0.15 * exp(-mi / 2880.0::DOUBLE), 0) AS energy FROM m),
    s AS (SELECT *, least(1, greatest(0, 0.4 * (1 - least(1, greatest(0, energy))) + 0.4 * CASE WHEN items <= 0 THEN 0 ELSE 1 - exp(-items / 3.0::DOUBLE) END
      + 0.2 * CASE WHEN msgs <= 0 THEN 0 ELSE least(1, ln(1.0::DOUBLE + msgs) / ln(11.0::DOUBLE)) END)) AS score FROM e)
    SELECT user_id, round(energy, 6) AS energy, round(score, 6) AS score, CASE WHEN score > 0.7 THEN 420 WHEN score > 0.4 THEN 1080 WHEN score > 0.2 THEN 2400 ELSE 4800 END::BIGINT AS wait_seconds FROM s""",
)
def engagement_energy(t: Tables) -> DataFrame:
    e = users(t).withColumn("energy", scoring.energy(F.col("lu"), now()))
    s = e.withColumn("score", scoring.drive(F.col("energy"), F.col("items"), F.col("msgs")))
    return s.select("user_id", F.round("energy", 6).alias("energy"), F.round("score", 6).alias("score"), scoring.next_check_seconds(F.col("score")).alias("wait_seconds"))


_INTERRUPT = f"""{_USERS}, fa AS (SELECT user_id, items, sent,
      CASE WHEN lp IS NULL THEN 0.6 WHEN lu > lp THEN exp(-((epoch_us(lu) - epoch_us(lp)) / 60000000.0::DOUBLE) / 120.0) ELSE 0.15 + 0.35 * exp(-((epoch_us({q.NOW}) - epoch_us(lp)) / 60000000.0::DOUBLE) / 360.0) END AS fr,
      0.5 * exp(-((epoch_us({q.NOW}) - epoch_us(la)) / 60000000.0::DOUBLE) / 180.0) + 0.5 * CASE WHEN msgs <= 0 THEN 0 ELSE least(1, ln(1.0::DOUBLE + msgs) / ln(11.0::DOUBLE)) END AS fv,
      1.0::DOUBLE / (1 + sent / 6.0::DOUBLE) AS ff, greatest((epoch_us({q.NOW}) - epoch_us(lu)) / 3600000000.0::DOUBLE, 0) AS age FROM us, mx),
  iv AS (SELECT *, greatest(0.08, least(1.0, (0.35 * fr + 0.25 * fv + 0.15 * ff) / 0.75::DOUBLE)) AS score FROM fa)"""


def interrupts(t: Tables) -> DataFrame:
    cfg = scoring.InterruptConfig()
    base = users(t)
    latest = base.agg(F.max("lu")).scalar()
    base = base.withColumn("la", latest)
    factors = base.withColumn("fr", scoring.reply_factor(F.col("lu"), F.col("lp"), now(), cfg))
    factors = factors.withColumn("fv", scoring.activity_factor(F.col("la"), F.col("msgs"), now(), cfg)).withColumn("ff", scoring.fatigue_factor(F.col("sent"), cfg))
    age = F.greatest(scoring.seconds_between(now(), F.col("lu")) / 3600.0, F.lit(0.0))
    return factors.withColumn("score", scoring.interruptibility(F.col("fr"), F.col("fv"), F.col("ff"), cfg)).withColumn("age", age)


@query("interruptibility", f"WITH {_INTERRUPT} SELECT user_id, round(fr, 6) AS f_reply, round(fv, 6) AS f_activity, round(ff, 6) AS f_fatigue, round(score, 6) AS score FROM iv")
def interruptibility(t: Tables) -> DataFrame:
    names = {"fr": "f_reply", "fv": "f_activity", "ff": "f_fatigue", "score": "score"}
    return interrupts(t).select("user_id", *[F.round(a, 6).alias(b) for a, b in names.items()])


@query(
    "send_score",
    f"""WITH {_INTERRUPT}, d AS (SELECT user_id, greatest(0, 1 - age / 12.0::DOUBLE) AS u, greatest(0, 1 - sent / 8.0::DOUBLE) AS b, 0.6 + 0.4 * score AS y,
      (least(5, greatest(1, 1 + items)) - 1) / 4.0::DOUBLE AS g, (least(5, greatest(1, 2 + user_id % 5)) - 1) / 4.0::DOUBLE AS r, (least(5, greatest(1, user_id % 7)) - 1) / 4.0::DOUBLE AS i FROM iv),
    v AS (SELECT *, CASE WHEN b < 0.1 THEN 'balance' WHEN g < 0.25 OR r < 0.25 OR i < 0.25 THEN 'llm_dim' ELSE '' END AS veto, (0.15 * u + 0.1 * b + 0.1 * y + 0.25 * g + 0.2 * r + 0.2 * i) / 1.0::DOUBLE AS s FROM d)
    SELECT user_id, veto AS vetoed_by, round(CASE WHEN veto = '' THEN s ELSE 0 END, 6) AS score, veto = '' AND s >= 0.6 AS send FROM v""",
)
def send_score(t: Tables) -> DataFrame:
    s = scoring.send_score(F.col("age"), F.col("sent"), F.col("score"), 1 + F.col("items"), 2 + F.col("user_id") % 5, F.col("user_id") % 7)
    rows = interrupts(t).select("user_id", s.alias("s"))
    return rows.select("user_id", F.coalesce("s.vetoed_by", F.lit("")).alias("vetoed_by"), F.round("s.score", 6).alias("score"), "s.send")


# -- traces -----------------------------------------------------------------------------------


def traces(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "turn.committed").otherwise(F.col("event_type"))
    return t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.col("user_id").alias("session_key"), "ts",
        kind.alias("event_type"), F.col("event_id").alias("id"), F.col("props").alias("payload_json"),
    )


_TR = "tr AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, * FROM events)"


@query(
    "trace_list",
    f"""WITH {_TR} SELECT trace_id, user_id AS session_key, {sql_stamp('min(ts)', 'started_at')}, {sql_stamp('max(ts)', 'updated_at')}, count(*) AS event_count,
      max((event_type = 'purchase')::INT) = 1 AS committed, (SELECT count(DISTINCT trace_id) FROM tr) AS total FROM tr GROUP BY 1, 2""",
)
def trace_list(t: Tables) -> DataFrame:
    return observe.trace_list(traces(t)).select("trace_id", "session_key", stamp("started_at"), stamp("updated_at"), "event_count", "committed", "total")


@query(
    "trace_detail",
    f"""WITH {_TR} SELECT trace_id, event_id AS id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS pos, {q.key_of()} AS k,
      strftime(min(ts) OVER (PARTITION BY trace_id), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) OVER (PARTITION BY trace_id) AS event_count FROM tr""",
)
def trace_detail(t: Tables) -> DataFrame:
    out = observe.trace_detail(traces(t), "k bigint")
    return out.select("trace_id", "id", *big("pos"), F.col("payload.k").alias("k"), stamp("started_at"), "event_count")


@query(
    "run_overview",
    """SELECT 'counts' AS section, 'orders' AS bucket, count(*) AS total FROM orders UNION ALL SELECT 'counts', 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'result_counts', coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderpriority, 'unknown'), count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'flow_counts', CASE WHEN o_orderpriority = '1-URGENT' THEN 'drift' ELSE 'proactive' END, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'latest', o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d'), o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) = (SELECT (max(o_orderdate), max(o_orderkey)) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))""",
)
def run_overview(t: Tables) -> DataFrame:
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("terminal_action"),
        F.col("o_orderpriority").alias("gate_exit"), (F.col("o_orderpriority") == "1-URGENT").alias("drift_entered"), F.col("o_orderstatus").alias("state"),
    )
    last = observe.latest_run(runs).select(
        F.lit("latest").alias("section"), F.concat_ws(" ", "state", F.date_format("started_at", "yyyy-MM-dd")).alias("bucket"), F.col("run_id").alias("total")
    )
    return observe.run_overview(runs, {"orders": t.orders, "lineitem": t.lineitem}).unionByName(last)


_TURNS = "tn AS (SELECT l_suppkey AS s, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag <> 'N' THEN (l_quantity * 100)::BIGINT END AS p, CASE WHEN l_returnflag <> 'N' THEN (l_quantity * l_linenumber * 10)::BIGINT END AS h FROM lineitem)"


def turns(t: Tables) -> DataFrame:
    tracked = F.col("l_returnflag") != "N"
    return t.lineitem.select(
        F.col("l_suppkey").alias("session_key"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(tracked, (F.col("l_quantity") * 100).cast("bigint")).alias("prompt_tokens"), F.when(tracked, (F.col("l_quantity") * F.col("l_linenumber") * 10).cast("bigint")).alias("hit_tokens"),
    )


_SUM = f"count(*) AS turn_count, count(p) AS tracked_turn_count, coalesce(sum(p), 0)::BIGINT AS prompt_tokens, coalesce(sum(h), 0)::BIGINT AS hit_tokens, greatest(coalesce(sum(p), 0) - coalesce(sum(h), 0), 0)::BIGINT AS miss_tokens, round(coalesce(sum(h) / nullif(sum(p), 0), -1), 6) AS hit_rate, {sql_stamp('max(ts) FILTER (p IS NOT NULL)', 'last_tracked_at')}"


@query(
    "cache_summary",
    f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts DESC, id DESC) AS n FROM tn)
    SELECT -1 AS session_key, {_SUM} FROM tn UNION ALL SELECT s, {_SUM} FROM r WHERE n <= 5 GROUP BY s""",
)
def cache_summary(t: Tables) -> DataFrame:
    whole = observe.cache_summary(turns(t)).withColumn("session_key", F.lit(-1).cast("bigint"))
    tails = observe.cache_summary(turns(t), per_session_last=5)
    cols = ["session_key", "turn_count", "tracked_turn_count", "prompt_tokens", "hit_tokens", "miss_tokens", F.round(F.coalesce("hit_rate", F.lit(-1.0)), 6).alias("hit_rate"), stamp("last_tracked_at")]
    return whole.select(*cols).unionByName(tails.select(*cols))


@query(
    "daily_activity",
    """WITH d AS (SELECT ts::DATE AS day, event_type FROM events WHERE ts::DATE <= DATE '2024-01-29' AND ts::DATE > DATE '2024-01-22')
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS ticks, count(*) FILTER (event_type = 'view') AS messages, count(*) FILTER (event_type IN ('signup', 'error')) AS memory_items,
      count(*) FILTER (event_type <> 'purchase') AS count FROM d WHERE event_type <> 'purchase' GROUP BY 1""",
)
def daily_activity(t: Tables) -> DataFrame:
    pick = lambda *kinds: t.events.filter(F.col("event_type").isin(*kinds)).select("ts")
    out = observe.daily_activity({"ticks": pick("click"), "messages": pick("view"), "memory_items": pick("signup", "error")}, "2024-01-29")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "ticks", "messages", "memory_items", "count")


@query(
    "daily_digest",
    f"""WITH m AS (SELECT user_id % 10 AS chat, user_id AS topic, event_id, ts, event_type || ' ' || props AS text FROM events WHERE ts >= {q.NOW} - INTERVAL 48 HOUR),
    l AS (SELECT *, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00] u' || topic || ' message_id=' || event_id || ': ' || text AS line FROM m),
    r AS (SELECT *, sum(length(line)) OVER (ORDER BY chat, topic, ts, event_id) AS used, count(*) OVER (PARTITION BY chat, topic) AS group_count FROM l)
    SELECT event_id, line, used::BIGINT AS used_chars, group_count FROM r WHERE used <= 35000""",
)
def daily_digest(t: Tables) -> DataFrame:
    rows = t.events.select(
        (F.col("user_id") % 10).alias("chat_id"), F.col("user_id").alias("topic_id"), F.col("event_id").alias("message_id"), "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"), F.concat_ws(" ", "event_type", "props").alias("text"),
    )
    out = observe.daily_digest(rows, now(), hours=48)
    return out.select(F.col("message_id").alias("event_id"), "line", *big("used_chars"), "group_count")


@query(
    "prompt_cost",
    """WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
    j AS (SELECT conv_id, '[' || string_agg('{"role":"' || role || '","content":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn) || ']' AS mj, sum(length(text)) AS mc,
      max(CASE WHEN role = 'system' AND turn = 0 THEN length(text) ELSE 0 END) AS sc FROM m GROUP BY conv_id),
    t AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN '[{"name":"shell","schema":"run a command"},{"name":"read","schema":"f"}]' ELSE '[]' END AS tj FROM j)
    SELECT conv_id, sc::BIGINT AS system_chars, mc::BIGINT AS messages_chars, length(mj) AS messages_json_chars, length(tj) AS tools_schema_chars, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS tool_count,
      greatest(1, (length(mj) + length(tj)) // 3) AS estimated_input_tokens, CASE WHEN conv_id % 2 = 0 THEN 'shell' ELSE '' END AS largest FROM t""",
)
def prompt_cost(t: Tables) -> DataFrame:
    out = observe.prompt_cost(model_calls(t), call_messages(t), ["conv_id"])
    names = ["system_chars", "messages_chars", "messages_json_chars", "tools_schema_chars", "tool_count", "estimated_input_tokens"]
    return out.select("conv_id", *big(*names), F.coalesce(F.try_element_at("largest_schemas", F.lit(1))["name"], F.lit("")).alias("largest"))


def call_messages(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def model_calls(t: Tables) -> DataFrame:
    """One call per conversation."""
    rows = t.conversations.select("conv_id").distinct()
    tools = F.array(
        F.struct(F.lit("shell").alias("name"), F.lit("run a command").alias("schema")), F.struct(F.lit("read").alias("name"), F.lit("f").alias("schema"))
    )
    none = F.from_json(F.lit("[]"), "array<struct<name:string,schema:string>>")
    return rows.withColumn("tools", F.when(F.col("conv_id") % 2 == 0, tools).otherwise(none))


@query(
    "cost_delta",
    """SELECT conv_id, (count(*) FILTER (role = 'system') > 0 AND min(turn) = 0)::INT AS had_system, 0::BIGINT AS tool_count, -max(CASE WHEN role = 'system' AND turn = 0 THEN length(text) ELSE 0 END)::BIGINT AS system_chars
    FROM conversations GROUP BY conv_id""",
)
def cost_delta(t: Tables) -> DataFrame:
    calls, said = model_calls(t), call_messages(t)
    lean = said.filter("role <> 'system'")
    delta = observe.cost_delta(observe.prompt_cost(calls, said, ["conv_id"]), observe.prompt_cost(calls, lean, ["conv_id"]), ["conv_id"])
    return delta.select("conv_id", (F.col("messages_json_chars") < 0).cast("int").alias("had_system"), *big("tool_count", "system_chars"))


@query(
    "recall_turns",
    f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS turn_id, event_id, user_id, event_type, {q.key_of()} AS k, ts FROM events WHERE event_type <> 'error')
    SELECT turn_id, max(user_id) AS session_key, coalesce(arg_min('text ' || event_id, event_id) FILTER (event_type <> 'click'), '') AS user_text, {sql_stamp('arg_min(ts, event_id)', 'ts')},
      coalesce(arg_max(k, event_id) FILTER (event_type = 'click'), 0) AS context_prepare_count, coalesce(sum(k) FILTER (event_type = 'view'), 0)::BIGINT AS recall_memory_count, count(*) FILTER (event_type = 'view') AS recall_call_count
    FROM e GROUP BY turn_id""",
)
def recall_turns(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    log = t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("turn_id"), F.col("event_id").alias("ord"),
        F.when(kind == "click", "context_prepare").when(kind == "view", "recall_memory").otherwise("other").alias("kind"),
        F.when(kind == "error", "remote").when(kind == "view", "default").otherwise("").alias("engine"), F.lit("cli").alias("channel"), F.col("user_id").cast("string").alias("session_key"),
        F.when(kind != "click", F.concat(F.lit("text "), F.col("event_id").cast("string"))).otherwise("").alias("user_text"), "ts", key().alias("count"),
    )
    out = observe.recall_turns(log)
    return out.select(
        "turn_id", F.col("session_key").cast("bigint").alias("session_key"), F.coalesce("user_text", F.lit("")).alias("user_text"), stamp("ts"),
        *big("context_prepare_count", "recall_memory_count", "recall_call_count"),
    )


@query("window_counts", f"SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND ts >= {q.NOW} - INTERVAL 240 HOUR GROUP BY 1")
def window_counts(t: Tables) -> DataFrame:
    return observe.count_in_window(t.events.filter("event_type = 'signup'"), 240, now(), key="user_id")


@query(
    "topic_groups",
    f"""WITH m AS (SELECT {q.key_of()} AS topic_id, ts, event_id, CASE WHEN event_type = 'click' THEN '' ELSE event_type || ' ' || user_id END AS text FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ts, event_id) AS n FROM m WHERE text <> ''),
    x AS (SELECT topic_id, string_agg(text, '|' ORDER BY n) AS texts, arg_min(text, n) AS example FROM s WHERE n <= 8 GROUP BY 1)
    SELECT m.topic_id, count(*) AS count, {sql_stamp('max(ts)', 'latest')}, any_value(example) AS example, any_value(texts) AS recent FROM m LEFT JOIN x USING (topic_id)
    GROUP BY 1 HAVING count(*) >= 3 AND contains(any_value(texts), 'purchase')""",
)
def topic_groups(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "").otherwise(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")))
    rows = t.events.select(key().alias("topic_id"), "ts", F.col("event_id").alias("message_id"), text.alias("text"))
    out = observe.topic_groups(rows, min_count=3, keyword="Purchase").orderBy(*observe.topic_order())
    return out.select("topic_id", "count", stamp("latest"), "example", F.array_join("recent_texts", "|").alias("recent"))


# -- windows ----------------------------------------------------------------------------------


def calls(t: Tables) -> DataFrame:
    tool = F.when(F.col("event_type") == "error", "task_stop").otherwise(F.col("event_type"))
    return t.events.select(F.col("user_id").alias("session_key"), "ts", F.col("event_id").alias("id"), tool.alias("tool"), (key() < 80).cast("string").alias("args"))


_RUNS = f"""c AS (SELECT user_id AS s, ts, event_id, event_type || ':' || ({q.key_of()} < 80) AS sig FROM events WHERE event_type <> 'error'),
  g AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY s, sig ORDER BY ts, event_id) AS isl, lag(sig) OVER w IS DISTINCT FROM sig AS st, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY s ORDER BY ts, event_id)),
  h AS (SELECT *, max(CASE WHEN st THEN n END) OVER (PARTITION BY s ORDER BY n) AS f FROM g)"""


@query("repeat_runs", f"WITH {_RUNS} SELECT event_id, n - f + 1 AS repeat_count, n - f + 1 >= 3 AS denied FROM h")
def repeat_runs(t: Tables) -> DataFrame:
    return observe.repeat_runs(calls(t)).select(F.col("id").alias("event_id"), "repeat_count", "denied")


_P90 = """w AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM events),
  o AS (SELECT *, len(v) AS n, list_sort(v) AS z, greatest(1, least((9 * (len(v) + 1)) // 10, len(v) - 1)) AS j FROM w),
  pq AS (SELECT user_id, event_id, n, CASE WHEN n < 3 THEN 25.0 ELSE (z[j] * (10 - (9 * (n + 1) - j * 10)) + z[j + 1] * (9 * (n + 1) - j * 10)) / 10.0 END AS p90 FROM o)"""


@query("latency_p90", f"WITH {_P90} SELECT event_id, n::BIGINT AS samples, round(p90, 6) AS p90 FROM pq")
def latency_p90(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("value").alias("seconds"))
    return observe.latency_p90(rows).select(F.col("id").alias("event_id"), *big("samples"), F.round("p90", 6).alias("p90"))


@query(
    "quota_day",
    """WITH a AS (SELECT event_id, user_id, ts, strftime(ts + INTERVAL 8 HOUR - INTERVAL 5 HOUR, '%Y-%m-%d') || '@05@Asia/Shanghai' AS window_key FROM events WHERE event_type IN ('signup', 'purchase')),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_key ORDER BY ts, event_id) - 1 AS used, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM a)
    SELECT event_id, window_key, used, greatest(3 - used, 0) AS remaining, CASE WHEN used >= 3 THEN 'quota_exhausted' WHEN last IS NOT NULL AND epoch_us(ts) - epoch_us(last) < 7200000000 THEN 'min_interval' ELSE 'ok' END AS reason FROM b""",
)
def quota_day(t: Tables) -> DataFrame:
    rows = t.events.filter(F.col("event_type").isin("signup", "purchase")).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    out = observe.quota_days(rows, 5, "Asia/Shanghai", 3, 7200)
    return out.select(F.col("id").alias("event_id"), "window_key", *big("used", "remaining"), "reason")


@query(
    "recent_then_asc",
    """WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
    SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE n <= 4""",
)
def recent_then_asc(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), "user_id", "ts")
    start, end = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    out = observe.recent_events(rows, start, end, 4, ["user_id"]).orderBy("user_id", "ts", "id")
    return out.select(F.col("id").alias("event_id"), "user_id", stamp("ts"))


@query(
    "run_status",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'needs_approval' WHEN event_type = 'purchase' OR event_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM events""",
)
def run_status(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = observe.run_status(
        F.when(kind == "error", "Traceback: it broke").otherwise("fine"), F.when(kind == "signup", "waits for 人工").otherwise(""), F.lit(None).cast("string"),
        F.when(kind == "purchase", "reply"), F.when(F.col("event_id") % 2 == 0, F.col("ts")),
    )
    return t.events.select("event_id", status.alias("status"))


@query(
    "url_normalize",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS x FROM pages),
    n AS (SELECT page_id, lower(x.s) || '://' || lower(x.h) || CASE WHEN regexp_replace(x.p, '/+$', '') = '' THEN x.p ELSE regexp_replace(x.p, '/+$', '') END || CASE WHEN x.q <> '' THEN '?' || x.q ELSE '' END AS url FROM u)
    SELECT page_id, url, substr(sha1('["id:z", "url:' || url || '"]'), 1, 16) AS delivery_key FROM n""",
)
def url_normalize(t: Tables) -> DataFrame:
    ref = observe.delivery_ref(F.col("page_id").cast("string"), F.col("url"), F.lit(""), F.lit(""))
    other = observe.delivery_ref(F.lit("z"), F.lit(""), F.lit("s"), F.lit(" "))
    made = observe.delivery_key(F.array(ref, other), F.array(F.lit("z")), F.lit(""))
    return t.pages.select("page_id", observe.normal_url(F.col("url")).alias("url"), made.alias("delivery_key"))


# -- joins ------------------------------------------------------------------------------------


@query(
    "run_steps",
    """WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
      CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status FROM lineitem)
    SELECT o_orderkey, count(*) AS steps, count(*) FILTER (status = 'failed') AS failed FROM orders JOIN lineitem ON l_orderkey = o_orderkey, LATERAL (SELECT CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status) GROUP BY 1""",
)
def run_steps(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"))
    steps = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_index"), F.when(F.col("l_returnflag") == "R", "Step FAILED").otherwise("done").alias("result_text")
    )
    out = relations.run_steps(runs, steps)
    return out.groupBy(F.col("run_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(
    "ttl_anti",
    f"""WITH seen AS (SELECT DISTINCT 's' || (user_id % 10) AS g, {q.key_of()} AS k FROM events WHERE event_type = 'view' AND ts >= {q.NOW} - INTERVAL 96 HOUR),
    rej AS (SELECT DISTINCT 's' || (user_id % 10) AS g, {q.key_of()} AS k FROM events WHERE event_type = 'error' AND ts >= {q.NOW} - INTERVAL 24 HOUR)
    SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM seen WHERE g = 's' || (e.user_id % 10) AND k = CAST(json_extract_string(e.props, '$.k') AS BIGINT))
      AND NOT EXISTS (SELECT 1 FROM rej WHERE g = 's' || (e.user_id % 10) AND k = CAST(json_extract_string(e.props, '$.k') AS BIGINT))""",
)
def ttl_anti(t: Tables) -> DataFrame:
    source = F.concat(F.lit("mcp:s"), (F.col("user_id") % 10).cast("string"), F.lit(":"), F.col("event_type"))
    rows = t.events.select("event_id", source.alias("source_key"), key().alias("item_id"), F.col("ts").alias("seen_at"), "event_type")
    left = relations.unseen(rows.drop("seen_at", "event_type"), rows.filter("event_type = 'view'"), 96, now())
    return relations.unseen(left, rows.filter("event_type = 'error'"), 24, now(), floor_hours=0).select("event_id")


@query(
    "evidence_check",
    f"""WITH e AS (SELECT user_id AS run, {q.key_of()} AS k, event_type FROM events), f AS (SELECT DISTINCT run, k FROM e WHERE event_type <> 'error' AND k <> 7),
    c AS (SELECT DISTINCT run, k FROM e WHERE event_type IN ('click', 'purchase')), d AS (SELECT DISTINCT run, k FROM e WHERE event_type = 'error'),
    u AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run = c.run AND f.k = c.k))
    SELECT 'unknown' AS kind, run, k FROM u UNION ALL SELECT 'interesting', run, k FROM c WHERE run NOT IN (SELECT run FROM u WHERE run IN (SELECT run FROM f)) AND NOT EXISTS (SELECT 1 FROM d WHERE d.run = c.run AND d.k = c.k)""",
)
def evidence_check(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("run_id"), key().alias("item_id"), "event_type")
    good, unknown = relations.check_evidence(
        rows.filter(F.col("event_type").isin("click", "purchase")), rows.filter((F.col("event_type") != "error") & (F.col("item_id") != 7)), rows.filter("event_type = 'error'").distinct()
    )
    cols = [F.col("run_id").alias("run"), F.col("item_id").alias("k")]
    return good.select(F.lit("interesting").alias("kind"), *cols).unionByName(unknown.select(F.lit("unknown").alias("kind"), *cols))
