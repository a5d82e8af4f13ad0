"""The day at a glance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import observe
from tidemark.operators.relations import run_steps


def day_bounds(day: str) -> tuple[Column, Column]:
    start = F.to_date(F.lit(day)).cast("timestamp_ntz")
    return start, start + F.expr("INTERVAL 1 DAY")


def with_status(runs: DataFrame) -> DataFrame:
    fields = ("final_message", "skip_reason", "gate_exit", "terminal_action", "finished_at")
    return runs.withColumn("status", observe.run_status(*[F.col(f) for f in fields]))


def latest_missions(runs: DataFrame, day: str, n: int) -> DataFrame:
    """The latest `n` runs of a day with their status, for display."""
    start, end = day_bounds(day)
    today = runs.withColumn("ts", F.col("started_at")).withColumn("id", F.col("run_id"))
    return with_status(observe.recent_events(today, start, end, n)).drop("ts", "id")


def daily_snapshot(runs: DataFrame, steps: DataFrame, messages: DataFrame, items: DataFrame, day: str) -> DataFrame:
    """(section, key, value) of one day: mission states, tool calls, totals, archive and status.

    `runs`: run_id, started_at, final_message, skip_reason, gate_exit, terminal_action,
    finished_at. `steps`: run_id, step_index, result_text. `messages` and `items` have ts. All runs of
    the day count; `latest_missions` lists some of them.
    """
    start, end = day_bounds(day)
    today = runs.withColumnRenamed("started_at", "ts")
    missions = with_status(today.filter((F.col("ts") >= start) & (F.col("ts") < end)))
    states = missions.groupBy("status").agg(F.count(F.lit(1)).alias("value"))
    calls = run_steps(missions.select("run_id"), steps).groupBy("status").agg(F.count(F.lit(1)).alias("value"))

    def on_day(df: DataFrame, name: str) -> DataFrame:
        n = df.filter((F.col("ts") >= start) & (F.col("ts") < end)).agg(F.count(F.lit(1)).alias("value"))
        return n.select(F.lit("totals").alias("section"), F.lit(name).alias("key"), "value")

    archive = observe.daily_activity({"runs": today, "messages": messages, "memory_items": items}, day)
    failed = missions.agg(F.count_if(F.col("status") == "failed").alias("f"), F.count_if(F.col("status") == "needs_approval").alias("a"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("f") > 0, "degraded").when(F.col("a") > 0, "idle").when(F.col("n") > 0, "running").otherwise("idle")
    parts = [
        states.select(F.lit("missions").alias("section"), F.col("status").alias("key"), "value"),
        calls.select(F.lit("tool_calls").alias("section"), F.col("status").alias("key"), "value"),
        on_day(today, "runs"), on_day(messages, "messages"), on_day(items, "memory_items"),
        archive.select(F.lit("archive").alias("section"), F.date_format("day", "yyyy-MM-dd").alias("key"), F.col("count").alias("value")),
        failed.select(F.lit("status").alias("section"), state.alias("key"), F.col("n").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
