"""Structured Streaming jobs. Every job has a batch twin among the operators.

State is kept per key and cleared by event time. Sources limit the files per trigger, so one batch
never holds an unbounded group; nothing is dropped when input is fast, it waits.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import classify, policy, relations
from tidemark.operators.observe import REPEATABLE_TOOLS
from tidemark.session import checkpoint_root
from tidemark.sources import documents, feeds
from tidemark.sources.deltas import DeltaTable
from tidemark.streaming import stateful

WATERMARK = "1 hour"
FILES_PER_TRIGGER = 64


def read_stream(spark: SparkSession, root: str, schema, glob: str = "*.parquet", files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream of the parquet files below `root`."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).option("pathGlobFilter", glob)
    return reader.parquet(root)


def set_arrival(spark: SparkSession, root: str) -> None:
    """Give the files below `root` modification times that follow their names: a stream reads them in that order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(((f.getPath().getName(), f) for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda x: x[0])
    newest = max((f.getModificationTime() for _, f in files), default=0)
    for n, (_, file) in enumerate(files):
        fs.setTimes(file.getPath(), newest - 1000 * (len(files) - n), -1)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"


def run_to_table(stream: DataFrame, out: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all available input and read what it wrote.

    Every batch overwrites its own folder, so a batch that is run again leaves one copy. In update
    mode the last row per key counts.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode != "update":
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def timed(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# -- sinks with their own logic ---------------------------------------------------------------


def start_traces(df: DataFrame, out: str, available_now: bool = True):
    """Append traces to one log per kind, in folders by day."""

    def sink(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for kind, rows in feeds.route_traces(held).items():
            rows.drop("kind").write.mode("overwrite").partitionBy("day").parquet(f"{out}/{kind}/batch={number}")
        held.unpersist()

    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def index_tables(spark: SparkSession, out: str) -> tuple[DeltaTable, DeltaTable]:
    """The tables of documents (by id) and of chunks (by document_id) that `start_index` keeps."""
    return DeltaTable(spark, f"{out}/docs", ["id"]), DeltaTable(spark, f"{out}/chunks", ["document_id"])


def read_index(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    docs, chunks = index_tables(spark, out)
    return docs.read(), chunks.read()


def start_index(files: DataFrame, out: str, cut, available_now: bool = True):
    """Keep `docs` and `chunks` tables below `out` up to date with (source_path, content, mtime) rows.

    In a batch the row with the largest mtime counts. Unchanged documents are skipped, changed ones replace their chunks.
    A batch adds one delta to each table (`read_index` merges them) and rewrites neither.
    """
    from tidemark.operators import maintain

    if "mtime" not in files.columns:
        raise ValueError("an index needs the version (mtime) of every row")

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        doc_table, chunk_table = index_tables(spark, out)
        newest = batch.groupBy("source_path").agg(F.max_by("content", "mtime").alias("content"))
        found = documents.document_rows(newest)
        docs = doc_table.read() if doc_table.exists() else None
        fresh = (found if docs is None else relations.changed_docs(found, docs)).persist()
        at = F.current_timestamp()
        slim = fresh.select("id", "source_path", "title", "file_type", "content_hash")
        known = docs if docs is not None else slim.limit(0).withColumn("created_at", at)
        # the chunks go first: the document rows are what marks a document as done
        chunk_table.change(cut(fresh), fresh.select(F.col("id").alias("document_id")), batch=str(number))
        doc_table.change(maintain.stamped_docs(known, slim, at), batch=str(number))
        fresh.unpersist()

    writer = files.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- built-in state ---------------------------------------------------------------------------


def stream_window_counts(df: DataFrame, hours: int, slide: str = "1 hour", key: str = "session_key", ts: str = "ts") -> DataFrame:
    """Sends per key in trailing windows, and whether the cooldown blocks the next one."""
    counted = timed(df, ts).groupBy(F.window(ts, f"{hours} hours", slide), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") > 0).alias("blocked"))


def stream_policy(events: DataFrame) -> DataFrame:
    """Running feedback statistics per item; see `operators.policy.memory_policy`."""
    return policy.memory_policy(events)


def stream_matches(messages: DataFrame, rules: classify.PostRules) -> DataFrame:
    """Matched posts. The checkpoint remembers which messages were read."""
    return classify.classify_messages(messages, rules).filter(F.col("decision") == "matched")


def stream_presence(events: DataFrame) -> DataFrame:
    """Running last user and last proactive time per session."""
    return events.groupBy("session_key").agg(
        F.max(F.when(F.col("kind") == "user", F.col("ts"))).alias("last_user_at"),
        F.max(F.when(F.col("kind") == "proactive", F.col("ts"))).alias("last_proactive_at"),
    )


def union_feeds(alerts: DataFrame, context: DataFrame, content: DataFrame) -> DataFrame:
    """Alerts, context and content in one stream of metadata; `compound_id` finds the bodies.

    How much content one batch takes is set where its stream is read (`maxFilesPerTrigger`).
    """
    none = F.lit(None).cast("string")
    shape = ["compound_id", "kind", "title", "source", "url", "published_at"]

    def events(df: DataFrame, channel: str) -> DataFrame:
        rows = feeds.normalize_feed(df, channel)
        return rows.select(
            F.concat_ws(":", "ack_server", "event_id").alias("compound_id"), "kind", F.coalesce("title", F.lit("")).alias("title"), F.col("source_name").alias("source"),
            F.coalesce("url", F.lit("")).alias("url"), "published_at",
        )

    plain = context.select(
        F.concat_ws(":", "server", F.sha1("payload")).alias("compound_id"), F.lit("context").alias("kind"), F.lit("").alias("title"), F.col("server").alias("source"), F.lit("").alias("url"),
        none.cast("timestamp").alias("published_at"),
    )
    return events(alerts, "alert").unionByName(plain).unionByName(events(content, "content")).select(*shape)


def feed_bodies(content: DataFrame) -> DataFrame:
    """Bodies of content events, apart from their metadata."""
    rows = feeds.normalize_feed(content, "content")
    return rows.select(F.concat_ws(":", "ack_server", "event_id").alias("compound_id"), F.coalesce(F.nullif("display_text", F.lit("")), F.col("content")).alias("body"))


def stream_quota(actions: DataFrame, reset_hour: int, zone_offset_hours: int, daily_max: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """Actions per local day that starts at `reset_hour`, and what is left of the quota."""
    shift = (reset_hour - zone_offset_hours) % 24
    counted = timed(actions, ts).groupBy(F.window(ts, "1 day", startTime=f"{shift} hours"), key).agg(F.count(F.lit(1)).alias("used"), F.max(ts).alias("last_action_at"))
    return counted.select(key, F.col("window.start").alias("day_start"), "used", "last_action_at", F.greatest(F.lit(daily_max) - F.col("used"), F.lit(0)).alias("remaining"))


# -- custom state -----------------------------------------------------------------------------


def _silent(df: DataFrame, keys: tuple[str, str], hours: int, ts: str, delay: str) -> DataFrame:
    """Rows with `allowed`: false within `hours` of the last allowed row of their key; refused rows do not extend that."""
    rows = timed(df.select(*keys, "id", F.col(ts).alias("ts")), "ts", delay)
    kinds = ", ".join(f"{k} string" for k in keys)
    return stateful.run_processor(rows, keys, stateful.Many(stateful.Silence(keys, hours), keys), f"{kinds}, id bigint, ts timestamp, allowed boolean")


def stream_deliver_once(df: DataFrame, hours: int, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Mark each delivery allowed or not: a key is silent for `hours` after its last allowed send.

    A suppressed repeat does not extend the silence. `df`: session_key, delivery_key, id (bigint), ts.
    A state is dropped once the watermark has passed the end of its silence.
    """
    return _silent(df, ("session_key", "delivery_key"), hours, ts, delay)


def stream_unseen(df: DataFrame, ttl_hours: int, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Items whose (source, item) was not passed on within the time to live: source_key, item_id, id, ts.

    The answer follows event times alone, however the input is cut into batches. `df`: source_key,
    item_id, id (bigint), ts.
    """
    keyed = df.withColumn("source_key", relations.source_key(F.col("source_key")))
    return _silent(keyed, ("source_key", "item_id"), ttl_hours, ts, delay).filter("allowed").drop("allowed")


def stream_repeat_guard(calls: DataFrame, limit: int = 3) -> DataFrame:
    """Length of the run of identical calls per session, and whether the guard stops the call.

    `calls`: session_key (string), id (bigint), ts, tool, args. A session keeps one signature and one
    number for good, as its batch twin does.
    """
    repeatable = F.coalesce(F.col("tool").isin(*REPEATABLE_TOOLS), F.lit(False))
    signed = calls.filter(~repeatable).select("session_key", "id", "ts", F.concat_ws(":", "tool", "args").alias("signature"))
    return stateful.run_processor(timed(signed), ("session_key",), stateful.Many(stateful.Repeats(max(2, limit)), ("session_key",)), "session_key string, id bigint, repeat_count bigint, denied boolean")


def stream_latency(df: DataFrame, window: int = 20, default: float = 25.0) -> DataFrame:
    """P90 of the last `window` samples per key after each sample; `default` below three samples.

    `df`: key (string), id (bigint), ts, seconds.
    """
    rows = timed(df.select("key", "id", "ts", "seconds"))
    return stateful.run_processor(rows, ("key",), stateful.Many(stateful.Latency(window, default), ("key",)), "key string, id bigint, p90 double")


def stream_trailing_counts(df: DataFrame, hours: int, key: str = "session_key", ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Exact number of rows of the key in the `hours` up to each row: session_key, id, n; see `stream_window_counts` for fixed steps.

    `df`: the key (string), id (bigint), ts. Of rows of one time the later id counts the earlier one.
    """
    rows = timed(df.select(F.col(key).alias("session_key"), "id", F.col(ts).alias("ts")), "ts", delay)
    return stateful.run_processor(rows, ("session_key",), stateful.Trailing(hours, 15 * hours, by="session_key"), "session_key string, id bigint, n bigint")
