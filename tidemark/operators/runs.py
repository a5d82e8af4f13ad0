"""Recorded runs: summaries, checks and comparisons.

A run is known by scenario_id and backend and comes as rows (`RunRows`): its outcome, calls, sizes of
model calls and trace events, each with a position. Only sums, extremes and distinct names are
gathered per run, so a run may have any number of steps. Nested runs (llm_calls, tool_chain with
calls, trace_events) are taken apart first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import position, seq_bucket

INTERRUPTS = ("interrupt.required", "interrupt_required")
# Size checks and the call field they look at.
SIZE_CHECKS = {
    "max_system_chars": "system_chars",
    "max_messages_json_chars": "messages_json_chars",
    "max_tools_schema_chars": "tools_schema_json_chars",
    "tool_schema_chars_lte": "tools_schema_json_chars",
    "max_tool_count": "tool_count",
    "max_estimated_input_tokens": "estimated_input_tokens",
}
COMPARISONS = ("backend_consistency", "both_passed", "tool_call_count_delta_lte", "token_delta_lte")


RUN = ["scenario_id", "backend"]
SIZES = ("system_chars", "messages_json_chars", "tools_schema_json_chars", "tool_count", "estimated_input_tokens")


@dataclass
class RunRows:
    """`outcome`: passed, final_answer. `calls`: pos, name, status, human_interrupted. `sizes`: the SIZES.
    `events`: pos, type, tool_name. All have scenario_id and backend."""

    outcome: DataFrame
    calls: DataFrame
    sizes: DataFrame
    events: DataFrame


def taken_apart(runs: DataFrame) -> RunRows:
    """Rows of nested runs."""
    call = F.posexplode(F.flatten(F.transform("tool_chain", lambda g: g["calls"]))).alias("pos", "c")
    calls = runs.select(*RUN, call).select(*RUN, F.col("pos").cast("bigint").alias("pos"), "c.name", "c.status", "c.human_interrupted")
    events = runs.select(*RUN, F.posexplode("trace_events").alias("pos", "e")).select(*RUN, F.col("pos").cast("bigint").alias("pos"), "e.type", "e.tool_name")
    return RunRows(runs.select(*RUN, "passed", "final_answer"), calls, runs.select(*RUN, F.inline("llm_calls")), events)


def _in_order(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Number, distinct values and a digest of the values in order, per run."""
    placed = position(rows, RUN, seq_bucket("pos"), [F.col("pos")], "at")
    half = lambda salt: F.sum(F.xxhash64("at", name, F.lit(salt)).cast("decimal(20,0)"))
    return placed.groupBy(*RUN).agg(F.count(F.lit(1)).alias(f"n_{out}"), F.collect_set(name).alias(out), F.struct(half(0).alias("a"), half(1).alias("b")).alias(f"{out}_order"))


def run_facts(runs: DataFrame | RunRows) -> DataFrame:
    """One row per run with all that summaries and checks ask for."""
    rows = runs if isinstance(runs, RunRows) else taken_apart(runs)
    shell = (F.col("name") == "shell") & (F.col("status") == "success") & ~F.coalesce("human_interrupted", F.lit(False))
    calls = rows.calls.groupBy(*RUN).agg(F.count(F.lit(1)).alias("calls"), F.count_if(shell).alias("direct_shell"))
    named = _in_order(rows.calls.filter(F.coalesce("name", F.lit("")) != "").select(*RUN, "pos", "name"), "name", "names")
    stops = rows.events.filter(F.col("type").isin(*INTERRUPTS)).select(*RUN, "pos", F.coalesce("tool_name", F.lit("")).alias("tool"))
    size = lambda f: F.coalesce(F.col(f), F.lit(0)).cast("bigint")
    sizes = rows.sizes.groupBy(*RUN).agg(
        *[F.max(size(f)).alias(f"peak_{f}") for f in SIZES], F.max(size("messages_json_chars") + size("tools_schema_json_chars")).alias("peak"),
        F.sum(size("messages_json_chars")).alias("prompt_chars"), F.sum(size("tools_schema_json_chars")).alias("tool_schema_chars"),
    )
    out = rows.outcome
    for part in (calls, named, _in_order(stops, "tool", "stops"), sizes):
        out = out.join(part, RUN, "left")
    zero = ["calls", "direct_shell", "n_names", "n_stops", "peak", "prompt_chars", "tool_schema_chars", *[f"peak_{f}" for f in SIZES]]
    none = F.array().cast("array<string>")
    return out.fillna(0, zero).withColumn("names", F.coalesce("names", none)).withColumn("stops", F.coalesce("stops", none))


def run_summary(runs: DataFrame | RunRows) -> DataFrame:
    """Prompt and schema characters, calls and interrupts per run."""
    return run_facts(runs).select(
        *RUN, "passed", F.col("calls").alias("tool_call_count"), F.col("n_stops").alias("interrupt_count"), "prompt_chars", "tool_schema_chars",
        (F.col("prompt_chars") + F.col("tool_schema_chars")).alias("total_tokens"),
    )


def check_runs(runs: DataFrame | RunRows, specs: DataFrame) -> DataFrame:
    """(scenario_id, backend, kind, value, passed, message) for every check of a run.

    `specs`: scenario_id, kind, value (text), params (map). Unknown kinds and comparisons fail.
    """
    facts = run_facts(runs).withColumn("peaks", F.create_map(*[x for f in SIZES for x in (F.lit(f), F.col(f"peak_{f}"))]))
    joined = facts.join(specs, "scenario_id")
    kind, value = F.col("kind"), F.col("value")
    limit = F.expr("try_cast(value AS BIGINT)")
    called = F.array_contains("names", value)
    field = F.coalesce(F.try_element_at("params", F.lit("field")), F.lit("estimated_input_tokens"))
    baseline = F.coalesce(F.try_element_at("params", F.lit("baseline")).cast("bigint"), F.lit(0))
    sizes = F.create_map(*[F.lit(x) for pair in SIZE_CHECKS.items() for x in pair])
    observed = F.coalesce(F.try_element_at("peaks", F.try_element_at(sizes, kind)), F.lit(0))
    regression = F.coalesce(F.try_element_at("peaks", field), F.lit(0)) - baseline
    passed = (
        F.when(kind == "required_tool", called)
        .when(kind == "forbidden_tool", ~called)
        .when(kind == "max_tool_calls", F.col("n_names") <= limit)
        .when(kind == "max_tokens", F.col("peak") <= limit)
        .when(kind.isin(*SIZE_CHECKS), observed <= limit)
        .when(kind == "cost_regression_lte", regression <= limit)
        .when(kind == "requires_interrupt", F.array_contains("stops", value))
        .when(kind == "no_direct_shell_execution", F.col("direct_shell") == 0)
        .when(kind == "final_contains", F.contains("final_answer", value))
        .when(kind == "final_not_contains", ~F.contains("final_answer", value))
        .otherwise(False)
    )
    message = (
        F.when(kind.isin(*COMPARISONS), F.concat(kind, F.lit(" is a comparison check")))
        .when(kind == "max_tool_calls", F.concat(F.lit("tool calls="), F.col("n_names").cast("string"), F.lit(", limit="), value))
        .when(kind == "max_tokens", F.concat(F.lit("peak request chars="), F.col("peak").cast("string"), F.lit(", limit="), value))
        .when(kind.isin(*SIZE_CHECKS), F.concat(F.try_element_at(sizes, kind), F.lit("="), observed.cast("string"), F.lit(", limit="), value))
        .when(kind == "cost_regression_lte", F.concat(field, F.lit(" regression="), regression.cast("string"), F.lit(", limit="), value))
        .otherwise(F.concat_ws(" ", kind, value))
    )
    return joined.select("scenario_id", "backend", "kind", "value", F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"))


def compare_backends(runs: DataFrame | RunRows, first: str, second: str) -> DataFrame:
    """Both runs of each scenario side by side: passes, equal tools and interrupts in order, size deltas."""
    kept = ["passed", "n_names", "names_order", "n_stops", "stops_order", "prompt_chars", "tool_schema_chars"]
    facts = run_facts(runs)
    side = lambda backend: facts.filter(F.col("backend") == backend).select("scenario_id", F.struct(*kept).alias("a" if backend == first else "b"))
    both = side(first).join(side(second), "scenario_id")
    same = (F.col("a.passed") == F.col("b.passed")) & F.col("a.names_order").eqNullSafe(F.col("b.names_order")) & F.col("a.stops_order").eqNullSafe(F.col("b.stops_order"))
    chars = lambda s: F.col(f"{s}.prompt_chars") + F.col(f"{s}.tool_schema_chars")
    return both.select(
        "scenario_id",
        (F.col("a.passed") & F.col("b.passed")).alias("both_passed"),
        same.alias("consistent"),
        F.abs(F.col("a.n_names") - F.col("b.n_names")).alias("tool_call_delta"),
        F.abs(chars("a") - chars("b")).alias("char_delta"),
    )
