"""Joins between parent and child tables, logs and reference lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def searchable(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of active documents, without parent chunks."""
    active = docs.filter(F.col("status") == "active").select(
        F.col("id").alias("document_id"), *[c for c in docs.columns if c not in ("id", "status")]
    )
    kids = chunks.filter(F.coalesce("chunk_type", F.lit("child")) != "parent")
    return kids.join(active, "document_id")


def with_counts(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, out: str = "n") -> DataFrame:
    """Every parent with the number of its children, zero included."""
    counts = child.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias(out))
    return parent.join(counts, parent_key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def changed_docs(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose path is unknown or whose stored hash differs."""
    return new.join(stored.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")


def nest_hits(events: DataFrame, items: DataFrame, key: str, item_order: str, fields: Sequence[Column], injected: Column, page: int | None = None) -> DataFrame:
    """One row per event with its items as an ordered array and the number of injected ones.

    With `page` an array holds at most that many items, and an event with more continues on further
    rows (`part` 1, 2, ...); `injected_count` is always that of the whole event.
    """
    from tidemark.operators.windows import position, seq_bucket

    placed = position(items, [key], seq_bucket(item_order), [F.col(item_order), *fields], "__n")
    parts = placed.withColumn("part", (F.floor((F.col("__n") - 1) / page) if page else F.lit(0)).cast("bigint"))
    hits = parts.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__n"), F.struct(*fields).alias("hit")))).alias("rows"),
    )
    nested = hits.select(key, "part", F.transform("rows", lambda r: r["hit"]).alias("hits"))
    joined = events.join(nested, key, "left").join(items.groupBy(key).agg(F.count_if(injected).alias("injected_count")), key, "left")
    return joined.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("injected_count", F.coalesce("injected_count", F.lit(0)))


def source_key(col: Column) -> Column:
    """Feed key of an item: `mcp:<server>:...` is cut to `mcp:<server>`."""
    raw = tx.strip(F.coalesce(col, F.lit("")))
    return F.when(F.startswith(raw, F.lit("mcp:")), F.array_join(F.slice(F.split(raw, ":", 3), 1, 2), ":")).otherwise(raw)


def unseen(items: DataFrame, seen: DataFrame, ttl_hours: int, now: Column, at: str = "seen_at", floor_hours: int = 1) -> DataFrame:
    """Items whose (source, item) was not marked within the last `ttl_hours` before `now`.

    With `floor_hours=0` a time to live of zero or less marks nothing (rejection cooldown).
    """
    if ttl_hours <= 0 and floor_hours == 0:
        return items
    hours = max(ttl_hours, floor_hours)
    fresh = (
        seen.filter(F.col(at) >= now - F.expr(f"INTERVAL {hours} HOURS"))
        .select(source_key(F.col("source_key")).alias("__key"), "item_id")
        .distinct()
    )
    keyed = items.withColumn("__key", source_key(F.col("source_key")))
    return keyed.join(fresh, ["__key", "item_id"], "left_anti").drop("__key")


def check_evidence(cited: DataFrame, fetched: DataFrame, discarded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(interesting, unknown) cited ids per run.

    `cited` and `fetched` have run_id, item_id. A run that fetched something and cites an unknown
    id is refused as a whole: it yields only unknown rows. Discarded ids are not interesting.
    """
    known = fetched.select("run_id", "item_id").distinct()
    unknown = cited.select("run_id", "item_id").distinct().join(known, ["run_id", "item_id"], "left_anti")
    refused = unknown.join(known.select("run_id").distinct(), "run_id", "left_semi").select("run_id").distinct()
    good = cited.select("run_id", "item_id").distinct().join(refused, "run_id", "left_anti")
    if discarded is not None:
        good = good.join(discarded.select("run_id", "item_id"), ["run_id", "item_id"], "left_anti")
    return good, unknown


# Words that mark a failed text.
FAILURE_WORDS = ("error", "failed", "traceback", "exception")


def looks_failed(col: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(col, F.lit(""))), F.lit("|".join(FAILURE_WORDS)))


def run_steps(runs: DataFrame, steps: DataFrame, limit: int | None = None) -> DataFrame:
    """Steps joined to their runs, each marked failed or completed by its result text."""
    joined = runs.join(steps, "run_id")
    status = F.when(looks_failed(F.col("result_text")), "failed").otherwise("completed")
    out = joined.withColumn("status", status).withColumn("step_id", F.concat_ws(":", F.col("run_id").cast("string"), F.col("step_index").cast("string")))
    if limit is None:
        return out
    from tidemark.operators.windows import top_rows

    return top_rows(out, ["run_id"], [F.col("step_index")], limit, "__n").drop("__n")
