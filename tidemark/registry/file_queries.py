"""Runs made of orders, and files written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evals, runs, windows
from tidemark.registry.core import Tables, query
from tidemark.registry.curation_queries import ALL_PAIRS, all_samples
from tidemark.registry.memory_queries import big
from tidemark.sources import feeds, records
from tidemark.streaming.jobs import scratch


def recorded(t: Tables) -> runs.RunRows:
    """One run per order, its steps from the line items; two orders share a scenario."""
    run = [F.floor(F.col("o_orderkey") / 2).alias("scenario_id"), F.when(F.col("o_orderkey") % 2 == 0, "native").otherwise("graph").alias("backend")]
    name = F.when(F.col("l_returnflag") == "R", "shell").otherwise(F.concat(F.lit("tool"), (F.col("l_suppkey") % 3).cast("string")))
    items = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    outcome = t.orders.join(items.select("o_orderkey").distinct(), "o_orderkey", "left_semi").select(*run, (F.col("o_orderstatus") != "F").alias("passed"), F.col("o_orderpriority").alias("final_answer"))
    steps = windows.position(items, ["o_orderkey"], windows.seq_bucket("l_linenumber"), [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], "pos")
    stop = F.col("l_tax") > 0.05
    calls = steps.select(*run, "pos", name.alias("name"), F.when(F.col("l_linestatus") == "O", "success").otherwise("error").alias("status"), stop.alias("human_interrupted"))
    sizes = items.select(
        *run, F.lit(7).alias("system_chars"), (F.col("l_quantity") * 10).cast("int").alias("messages_json_chars"), (F.col("l_partkey") % 100).cast("int").alias("tools_schema_json_chars"),
        F.col("l_linenumber").alias("tool_count"), F.col("l_quantity").cast("int").alias("estimated_input_tokens"),
    )
    events = steps.select(*run, "pos", F.when(stop, "interrupt.required").otherwise("step").alias("type"), name.alias("tool_name"))
    return runs.RunRows(outcome, calls, sizes, events)


_STEPS = """st AS (SELECT o_orderkey, o_orderkey // 2 AS scenario_id, CASE WHEN o_orderkey % 2 = 0 THEN 'native' ELSE 'graph' END AS backend, o_orderstatus <> 'F' AS passed, o_orderpriority AS answer, l_linenumber AS n, l_partkey, l_suppkey, l_quantity,
    CASE WHEN l_returnflag = 'R' THEN 'shell' ELSE 'tool' || (l_suppkey % 3) END AS name, l_linestatus = 'O' AS ok, l_tax > 0.05 AS stop, (l_quantity * 10)::INT AS m, (l_partkey % 100)::INT AS c, l_quantity::INT AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  rn AS (SELECT o_orderkey, scenario_id, backend, any_value(passed) AS passed, any_value(answer) AS answer, count(*) AS calls, count(*) FILTER (stop) AS stops, sum(m)::BIGINT AS m, sum(c)::BIGINT AS c, max(m + c) AS peak, max(e) AS e, max(n) AS tn,
    list(name ORDER BY n, l_partkey, l_suppkey, l_quantity) AS names, list(name ORDER BY n, l_partkey, l_suppkey, l_quantity) FILTER (stop) AS sn, count(*) FILTER (name = 'shell' AND ok AND NOT stop) AS direct FROM st GROUP BY 1, 2, 3)"""


@query("run_summary", f"WITH {_STEPS} SELECT scenario_id, backend, passed, calls AS tool_call_count, stops AS interrupt_count, m AS prompt_chars, c AS tool_schema_chars, m + c AS total_tokens FROM rn")
def run_summary(t: Tables) -> DataFrame:
    out = runs.run_summary(recorded(t))
    return out.select("scenario_id", "backend", "passed", *big("tool_call_count", "interrupt_count"), "prompt_chars", "tool_schema_chars", "total_tokens")


CHECKS = (
    ("required_tool", "shell"), ("forbidden_tool", "tool1"), ("max_tool_calls", "4"), ("max_tokens", "400"), ("max_system_chars", "6"), ("max_messages_json_chars", "300"), ("max_tools_schema_chars", "70"),
    ("tool_schema_chars_lte", "50"), ("max_tool_count", "5"), ("max_estimated_input_tokens", "30"), ("cost_regression_lte", "12"), ("requires_interrupt", "shell"), ("no_direct_shell_execution", ""),
    ("final_contains", "URGENT"), ("final_not_contains", "LOW"), ("both_passed", ""),
)


@query(
    "run_assertions",
    f"""WITH {_STEPS}, mx AS (SELECT o_orderkey, max(m) AS mm, max(c) AS mc FROM st GROUP BY 1), k AS (SELECT scenario_id, backend, unnest([
      {{'k': 'required_tool', 'p': list_contains(names, 'shell')}}, {{'k': 'forbidden_tool', 'p': NOT list_contains(names, 'tool1')}}, {{'k': 'max_tool_calls', 'p': calls <= 4}}, {{'k': 'max_tokens', 'p': peak <= 400}},
      {{'k': 'max_system_chars', 'p': false}}, {{'k': 'max_messages_json_chars', 'p': mm <= 300}}, {{'k': 'max_tools_schema_chars', 'p': mc <= 70}}, {{'k': 'tool_schema_chars_lte', 'p': mc <= 50}}, {{'k': 'max_tool_count', 'p': tn <= 5}},
      {{'k': 'max_estimated_input_tokens', 'p': e <= 30}}, {{'k': 'cost_regression_lte', 'p': mm - 300 <= 12}}, {{'k': 'requires_interrupt', 'p': coalesce(list_contains(sn, 'shell'), false)}}, {{'k': 'no_direct_shell_execution', 'p': direct = 0}},
      {{'k': 'final_contains', 'p': contains(answer, 'URGENT')}}, {{'k': 'final_not_contains', 'p': NOT contains(answer, 'LOW')}}, {{'k': 'both_passed', 'p': false}}]) AS u FROM rn JOIN mx USING (o_orderkey))
    SELECT scenario_id, backend, u.k AS kind, u.p AS passed FROM k""",
)
def run_assertions(t: Tables) -> DataFrame:
    rows = recorded(t)
    params = F.create_map(F.lit("field"), F.lit("messages_json_chars"), F.lit("baseline"), F.lit("300"))
    checks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in CHECKS])
    specs = t.orders.select(F.floor(F.col("o_orderkey") / 2).alias("scenario_id")).distinct().select("scenario_id", F.inline(checks), params.alias("params"))
    return runs.check_runs(rows, specs).select("scenario_id", "backend", "kind", "passed")


@query(
    "backend_compare",
    f"""WITH {_STEPS}, a AS (SELECT * FROM rn WHERE backend = 'native'), b AS (SELECT * FROM rn WHERE backend = 'graph')
    SELECT a.scenario_id, a.passed AND b.passed AS both_passed, a.passed = b.passed AND a.names = b.names AND coalesce(a.sn, []) = coalesce(b.sn, []) AS consistent, abs(a.calls - b.calls) AS tool_call_delta, abs(a.m + a.c - b.m - b.c) AS char_delta FROM a JOIN b USING (scenario_id)""",
)
def backend_compare(t: Tables) -> DataFrame:
    out = runs.compare_backends(recorded(t), "native", "graph")
    return out.select("scenario_id", "both_passed", "consistent", *big("tool_call_delta"), "char_delta")


@query(
    "rag_case_metrics",
    """WITH c AS (SELECT conv_id, list(turn::VARCHAR ORDER BY turn)[1:3] AS got, list('d' || (turn % 3) ORDER BY turn)[1:3] AS docs FROM conversations GROUP BY 1)
    SELECT conv_id, round(CASE WHEN conv_id % 4 = 0 THEN 1.0 ELSE least(1.0::DOUBLE, (len(list_intersect(got, ['1', '5'])) + list_contains(docs, 'd2')::INT) / 3.0::DOUBLE) END, 6) AS recall_at_k, conv_id % 3 = 0 AS citation_hit FROM c""",
)
def rag_case_metrics(t: Tables) -> DataFrame:
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("v")))), lambda r: r["v"])
    rows = t.conversations.select("conv_id", "turn").groupBy("conv_id").agg(pack(F.col("turn").cast("string")).alias("chunk_ids"), pack(F.concat(F.lit("d"), (F.col("turn") % 3).cast("string"))).alias("document_ids"))
    gold = F.col("conv_id") % 4 != 0
    none = F.array().cast("array<string>")
    said = F.when(F.col("conv_id") % 3 == 0, "so [K1] and [K2]").when(F.col("conv_id") % 3 == 1, "so [K9]").otherwise("so")
    full = rows.select(
        "*", F.when(gold, F.array(F.lit("1"), F.lit("5"), F.lit(""))).otherwise(none).alias("gold_chunk_ids"), F.when(gold, F.array(F.lit("d2"))).otherwise(none).alias("gold_document_ids"),
        said.alias("answer"), F.array(F.lit("K1"), F.lit("K2"), F.lit("K3")).alias("citation_ids"),
    )
    return evals.rag_metrics(full, 3).select("conv_id", F.round("recall_at_k", 6).alias("recall_at_k"), "citation_hit")


@query("json_records_scan", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_records_scan(t: Tables) -> DataFrame:
    out = scratch(t.spark, "records")
    held = t.conversations.groupBy("conv_id", F.floor(F.col("turn") / 1000)).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("records"))
    held.select("records").write.option("maxRecordsPerFile", 1).json(out)
    rows = records.read_records(t.spark, out, "conv_id bigint, turn bigint, role string, text string")
    return rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "eval_cases_scan",
    "SELECT 'set' || (item_id // 10) AS dataset, item_id::VARCHAR AS case_id, md5(text) AS query, 'c' || item_id AS chunks, 0::BIGINT AS n_docs FROM benchmark",
)
def eval_cases_scan(t: Tables) -> DataFrame:
    out = scratch(t.spark, "cases")
    none = F.lit(None).cast("string")
    item = F.col("item_id").cast("string")
    case = F.struct(
        item.alias("case_id"), F.col("text").alias("query"), F.array(F.concat(F.lit("c"), item), F.lit(" ")).alias("relevant_chunk_ids"), F.array(F.lit(""), none).alias("relevant_document_ids")
    )
    sets = t.benchmark.groupBy(F.concat(F.lit("set"), F.floor(F.col("item_id") / 10).cast("string")).alias("name")).agg(F.collect_list(case).alias("cases"))
    sets.write.option("maxRecordsPerFile", 1).json(out)
    cases = records.read_eval_cases(t.spark, out)
    return cases.select("dataset", "case_id", F.md5("query").alias("query"), F.array_join("relevant_chunk_ids", "|").alias("chunks"), F.size("relevant_document_ids").cast("bigint").alias("n_docs"))


@query("preference_sink", f"{ALL_PAIRS} SELECT sample_id, prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, source, 1::BIGINT AS n_train FROM al")
def preference_sink(t: Tables) -> DataFrame:
    """Samples of all kinds written and read back from both files."""
    out = scratch(t.spark, "samples")
    records.write_preferences(all_samples(t), out)
    full, train = t.spark.read.json(f"{out}/full"), t.spark.read.json(f"{out}/train")
    found = train.groupBy("prompt", "chosen", "rejected").agg(F.count(F.lit(1)).alias("n"))
    same = full.groupBy("prompt", "chosen", "rejected").agg(F.count(F.lit(1)).alias("m"))
    shown = full.join(found.join(same, ["prompt", "chosen", "rejected"]), ["prompt", "chosen", "rejected"], "left")
    return shown.select("sample_id", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "source", F.coalesce(F.floor(F.col("n") / F.col("m")), F.lit(0)).alias("n_train"))


@query(
    "trace_sink",
    "SELECT CASE event_type WHEN 'click' THEN 'turns' WHEN 'view' THEN 'rag_queries' WHEN 'purchase' THEN 'memory_writes' ELSE 'trace_events' END AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
)
def trace_sink(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "turns", "view", "rag_queries", "purchase", "memory_writes", "signup", "trace_events", "error", "noise")])
    out = None
    for rows in feeds.route_traces(t.events.withColumn("kind", names[F.col("event_type")])).values():
        part = rows.groupBy("kind", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
