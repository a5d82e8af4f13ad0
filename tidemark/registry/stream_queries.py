"""Streaming jobs over the event and conversation files, run over all available input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import chunking
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query
from tidemark.registry.curation_queries import RULES
from tidemark.registry.memory_queries import POLICY, key
from tidemark.registry.observe_queries import _P90, _RUNS, stamp
from tidemark.streaming import jobs


#: Batches that a table is dealt into, least and most, the rows of one batch between these, its files at most, and the least and most rows of one.
LEAST_PARTS, MOST_PARTS, PART_ROWS, MOST_FILES, FILE_ROWS, MOST_FILE_ROWS = 5, 16, 200_000, 16, 500, 50_000


def layout(n: int) -> tuple[int, int, int]:
    """(batches, files of a batch, most rows of a file) for a table of `n` rows.

    A batch costs a commit of every state partition, whatever it holds, so beyond MOST_PARTS batches grow in files and not in number.
    """
    parts = max(LEAST_PARTS, min(MOST_PARTS, -(-n // PART_ROWS)))
    rows = -(-n // parts)
    files = max(1, min(MOST_FILES, rows // FILE_ROWS), -(-rows // MOST_FILE_ROWS))
    return parts, files, 2 * -(-rows // files)  # ranges come from a sample: some are longer than others, and an extra file is an extra batch


def stream(t: Tables, name: str, order: str = "ts", by: str | None = None) -> DataFrame:
    """The table as files that follow (`order`, `by`), rows without `order` first, read some files per batch.

    A batch has several files, so that several tasks read it. One sort deals all rows; equal values of `order` are parted by `by`, so no value makes a file of its own
    size. Modification times, which a file stream goes by, follow the order of the files.
    """
    rows, out = getattr(t, name), jobs.scratch(t.spark, name)
    keys = [F.asc_nulls_first(order), F.asc_nulls_first(by or rows.columns[0])]
    parts, files, most = layout(rows.count())
    rows.repartitionByRange(parts * files, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", most).parquet(out)
    jobs.set_arrival(t.spark, out)
    return jobs.read_stream(t.spark, out, rows.schema, files_per_trigger=files)


def finish(t: Tables, rows: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    return jobs.run_to_table(rows, jobs.scratch(t.spark, name), mode, keys)


@query(
    "stream_traces",
    """SELECT CASE event_type WHEN 'click' THEN 'turns' WHEN 'view' THEN 'rag_queries' WHEN 'purchase' THEN 'memory_writes' ELSE 'trace_events' END AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, 300::BIGINT AS max_args
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
)
def stream_traces(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "turns", "view", "rag_queries", "purchase", "memory_writes", "signup", "trace_events", "error", "noise")])
    call = F.struct(F.lit("shell").alias("name"), F.repeat("props", F.lit(60)).alias("args"), F.col("event_type").alias("result"))
    rows = stream(t, "events").select("event_id", "ts", names[F.col("event_type")].alias("kind"), F.array(call).alias("tool_calls"))
    out = jobs.scratch(t.spark, "traces")
    jobs.start_traces(rows, out).awaitTermination()
    union = None
    for kind in ("turns", "rag_queries", "memory_writes", "trace_events"):
        part = t.spark.read.option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}").withColumn("kind", F.lit(kind))
        union = part if union is None else union.unionByName(part)
    longest = F.max(F.length(F.element_at("tool_calls", 1)["args"])).cast("bigint")
    return union.groupBy("kind", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), longest.alias("max_args"))


@query(
    "stream_seen_dedup",
    f"""WITH RECURSIVE e AS (SELECT 'mcp:s' || (user_id % 10) AS s, {q.key_of()} AS d, event_id, ts, row_number() OVER (PARTITION BY user_id % 10, {q.key_of()} ORDER BY ts, event_id) AS n FROM events),
    a AS (SELECT s, d, event_id, n, ts AS last, true AS allowed FROM e WHERE n = 1
      UNION ALL SELECT e.s, e.d, e.event_id, e.n, CASE WHEN e.ts - a.last > INTERVAL 72 HOUR THEN e.ts ELSE a.last END, e.ts - a.last > INTERVAL 72 HOUR FROM a JOIN e ON e.s = a.s AND e.d = a.d AND e.n = a.n + 1)
    SELECT s AS source_key, d AS item_id, event_id FROM a WHERE allowed""",
)
def stream_seen_dedup(t: Tables) -> DataFrame:
    source = F.concat(F.lit("mcp:s"), (F.col("user_id") % 10).cast("string"), F.lit(":"), F.col("event_type"))
    rows = stream(t, "events").select(source.alias("source_key"), key().alias("item_id"), F.col("event_id").alias("id"), "ts")
    return finish(t, jobs.stream_unseen(rows, 72), "seen").select("source_key", "item_id", F.col("id").alias("event_id"))


@query(
    "stream_delivery_dedup",
    f"""WITH RECURSIVE e AS (SELECT user_id AS s, event_type AS d, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    a AS (SELECT s, d, event_id, n, ts AS last, true AS allowed FROM e WHERE n = 1
      UNION ALL SELECT e.s, e.d, e.event_id, e.n, CASE WHEN e.ts - a.last > INTERVAL 48 HOUR THEN e.ts ELSE a.last END, e.ts - a.last > INTERVAL 48 HOUR FROM a JOIN e ON e.s = a.s AND e.d = a.d AND e.n = a.n + 1)
    SELECT event_id, allowed FROM a""",
)
def stream_delivery_dedup(t: Tables) -> DataFrame:
    rows = stream(t, "events").select(
        F.col("user_id").cast("string").alias("session_key"), F.col("event_type").alias("delivery_key"), F.col("event_id").alias("id"), "ts"
    )
    return finish(t, jobs.stream_deliver_once(rows, 48), "deliver").select(F.col("id").alias("event_id"), "allowed")


@query(
    "stream_window_counts",
    """WITH w AS (SELECT user_id, ts, unnest(range(0, 4)) AS i, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events WHERE event_type = 'signup')
    SELECT user_id AS session_key, strftime(b - i * INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w GROUP BY 1, 2""",
)
def stream_window_counts(t: Tables) -> DataFrame:
    rows = stream(t, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("session_key"), "ts")
    out = finish(t, jobs.stream_window_counts(rows, 24, "6 hours"), "windows", "update", ("session_key", "start"))
    return out.select("session_key", stamp("start"), "n")


@query(
    "stream_trailing_counts",
    """SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 24 HOUR AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY a.event_id""",
)
def stream_trailing_counts(t: Tables) -> DataFrame:
    rows = stream(t, "events").select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("id"), "ts")
    return finish(t, jobs.stream_trailing_counts(rows, 24), "trailing").select(F.col("id").alias("event_id"), "n")


@query("stream_policy_stats", f"WITH {POLICY} SELECT item_id, c3 AS used_count, round(ar, 5) AS avg_reward, round(boost, 5) AS retrieval_boost FROM pb")
def stream_policy_stats(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "retrieved", "view", "injected", "purchase", "used", "signup", "superseded", "error", "corrected")])
    rows = stream(t, "events").select(F.col("user_id").alias("item_id"), names[F.col("event_type")].alias("event_type"), "ts")
    rows = rows.withColumn("reward", scoring.memory_reward(F.col("event_type")))
    out = finish(t, jobs.stream_policy(rows), "policy", "update", ("item_id",))
    return out.select("item_id", "used_count", F.round("avg_reward", 5).alias("avg_reward"), F.round("retrieval_boost", 5).alias("retrieval_boost"))


@query("stream_repeat_guard", f"WITH {_RUNS} SELECT event_id, n - f + 1 AS repeat_count, n - f + 1 >= 3 AS denied FROM h")
def stream_repeat_guard(t: Tables) -> DataFrame:
    tool = F.when(F.col("event_type") == "error", "task_stop").otherwise(F.col("event_type"))
    rows = stream(t, "events").select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("id"), "ts", tool.alias("tool"), (key() < 80).cast("string").alias("args"))
    return finish(t, jobs.stream_repeat_guard(rows), "guard").select(F.col("id").alias("event_id"), "repeat_count", "denied")


@query("stream_cursor_filter")
def stream_cursor_filter(t: Tables) -> DataFrame:
    rows = posts_stream(t)
    return finish(t, jobs.stream_matches(rows, RULES).select("doc_id", "title", "decision"), "matches")


def posts_stream(t: Tables) -> DataFrame:
    plain = F.concat(F.lit("岗位职责：\n"), "text")
    named = F.concat(F.lit("职位: #"), "source", F.lit("  "), "lang", F.lit("\n岗位要求: "), "text")
    return stream(t, "documents", "doc_id").select("doc_id", F.when(F.col("n_chars") % 3 == 0, plain).otherwise(named).alias("text"))


@query(
    "stream_presence",
    f"""SELECT 'cli:' || user_id AS session_key, coalesce(strftime(max(ts) FILTER (event_type IN ('click', 'view', 'purchase')), '%Y-%m-%d %H:%M:%S'), '') AS last_user_at,
      coalesce(strftime(max(ts) FILTER (event_type = 'signup'), '%Y-%m-%d %H:%M:%S'), '') AS last_proactive_at FROM events GROUP BY user_id""",
)
def stream_presence(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "user").when(F.col("event_type") == "signup", "proactive")
    rows = stream(t, "events").select(F.concat(F.lit("cli:"), F.col("user_id").cast("string")).alias("session_key"), kind.alias("kind"), "ts")
    out = finish(t, jobs.stream_presence(rows), "presence", "update", ("session_key",))
    return out.select("session_key", stamp("last_user_at"), stamp("last_proactive_at"))


@query(
    "stream_feed_union",
    "SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'alert' WHEN event_type = 'view' THEN 'context' ELSE 'content' END AS kind, 's' || (user_id % 10) AS source, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_feed_union(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "signup"), "alert").otherwise("content")
    server = F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"))
    payload = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), kind.alias("kind"), server.alias("source_name"), F.col("props").alias("content")))
    rows = stream(t, "events").select("event_type", payload.alias("payload"), server.alias("server"))
    alerts = rows.filter("event_type IN ('error', 'signup')").drop("event_type")
    context = rows.filter("event_type = 'view'").drop("event_type")
    content = rows.filter("event_type IN ('click', 'purchase')").drop("event_type")
    out = finish(t, jobs.union_feeds(alerts, context, content), "feeds")
    return out.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))


@query("stream_index", f"SELECT 'kdoc_' || substr(sha1(source || '/' || doc_id || '.md'), 1, 20) AS document_id, sha256(text) AS content_hash FROM documents")
def stream_index(t: Tables) -> DataFrame:
    files = stream(t, "documents", "doc_id").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_path"), F.col("text").alias("content"), F.col("doc_id").alias("mtime"))
    out = jobs.scratch(t.spark, "index")
    jobs.start_index(files, out, lambda rows: chunking.chunk_markdown(rows)).awaitTermination()
    docs, chunks = jobs.read_index(t.spark, out)
    return docs.select(F.col("id").alias("document_id"), "content_hash").join(chunks.select("document_id").distinct(), "document_id", "left_semi")


@query(
    "stream_quota",
    """SELECT user_id AS key, strftime(time_bucket(INTERVAL 1 DAY, ts + INTERVAL 3 HOUR) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS day_start, count(*) AS used, greatest(3 - count(*), 0) AS remaining FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2""",
)
def stream_quota(t: Tables) -> DataFrame:
    rows = stream(t, "events").filter("event_type IN ('signup', 'purchase')").select(F.col("user_id").alias("key"), "ts")
    out = finish(t, jobs.stream_quota(rows, 5, 8, 3), "quota", "update", ("key", "day_start"))
    return out.select("key", stamp("day_start"), "used", "remaining")


@query("stream_latency", f"WITH {_P90} SELECT event_id, round(p90, 6) AS p90 FROM pq")
def stream_latency(t: Tables) -> DataFrame:
    rows = stream(t, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts", F.col("value").alias("seconds"))
    return finish(t, jobs.stream_latency(rows), "latency").select(F.col("id").alias("event_id"), F.round("p90", 6).alias("p90"))
