"""Composed retrieval, evaluation, pairs and the daily view over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import memory as memory_ops
from tidemark.operators import policy, vector
from tidemark.plans import daily, memory, retrieval
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query
from tidemark.registry.curation_queries import ALL_PAIRS, all_samples
from tidemark.registry.memory_queries import POLICY, big, items, key, now
from tidemark.registry.retrieval_queries import BM25, PASSAGES, RRF, VECTOR, _embedding, passages, questions


def chunks(t: Tables) -> DataFrame:
    """Every document as one searchable chunk; English ones belong to a parent per ten documents."""
    doc = F.col("doc_id")
    parent = F.concat(F.lit("p"), F.floor(doc / 10).cast("string"))
    none = F.lit(None).cast("string")
    base = [F.lit("").alias("heading_path"), F.lit("").alias("source_path"), F.lit("").alias("title"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end")]
    kids = t.documents.select(
        doc.cast("string").alias("id"), doc.cast("string").alias("document_id"), "text", F.when(F.col("lang") == "en", parent).alias("parent_id"), F.lit("child").alias("chunk_type"), *base
    )
    tops = t.documents.filter("lang = 'en'").groupBy(parent.alias("id")).agg(F.min("text").alias("text"))
    tops = tops.select("id", F.lit("").alias("document_id"), "text", none.alias("parent_id"), F.lit("parent").alias("chunk_type"), *base)
    return kids.unionByName(tops)


def vectors(t: Tables) -> DataFrame:
    return vector.embed(t.documents.select(F.col("doc_id").cast("string").alias("id"), "text"), "text").select("id", "embedding")


@query("knowledge_retrieve")
def knowledge_retrieve(t: Tables) -> DataFrame:
    out = retrieval.knowledge_retrieve(questions(t), chunks(t), vectors(t))
    return out.select("query_id", "id", "citation_id", F.round("score", 6).alias("score"), F.array_join("matched_child_ids", "|").alias("children"), "fallback", "used_chars", "injected")


_STRING_RANKS = RRF.replace("ORDER BY score DESC, id)", "ORDER BY score DESC, id::VARCHAR)").replace("best_score DESC, id)", "best_score DESC, id::VARCHAR)")


@query(
    "knowledge_hits",
    f"""WITH {_STRING_RANKS} SELECT query_id, id::VARCHAR AS id, round(rrf_score, 6) AS score, rank, lanes FROM fr WHERE rank <= 6""",
)
def knowledge_hits(t: Tables) -> DataFrame:
    hits = retrieval.knowledge_hits(questions(t), chunks(t), vectors(t))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), *big("rank"), F.array_join("lanes", "+").alias("lanes"))


@query(
    "retrieval_log",
    f"""WITH {BM25.replace("ORDER BY score DESC, id)", "ORDER BY score DESC, id::VARCHAR)")}, r AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM kw WHERE rank <= 6 GROUP BY 1)
    SELECT 'kretr_' || substr(sha1(':' || text || ':' || ids), 1, 24) AS event_id, md5(text) AS query, replace(ids, ',', '|') AS retrieved FROM r JOIN benchmark ON item_id = query_id""",
)
def retrieval_log(t: Tables) -> DataFrame:
    cfg = retrieval.RetrieveConfig(mode="bm25", expand_parents=False)
    out = retrieval.knowledge_retrieve(questions(t), chunks(t), vectors(t), cfg)
    log = retrieval.retrieval_log(out, questions(t), now())
    return log.select("event_id", F.md5("query").alias("query"), F.array_join("retrieved_chunk_ids", "|").alias("retrieved"))


@query("evaluate_retrieval")
def evaluate_retrieval(t: Tables) -> DataFrame:
    gold = passages(t).groupBy("query_id").agg(F.collect_set(F.col("id").cast("string")).alias("relevant_document_ids"))
    cases = questions(t).join(gold, "query_id", "left").select(
        F.col("query_id").alias("case_id"), "query", F.array().cast("array<string>").alias("relevant_chunk_ids"), "relevant_document_ids"
    )
    out = retrieval.evaluate_retrieval(cases, chunks(t), vectors(t))
    return out.select("retriever", *[F.round(c, 6).alias(c) for c in out.columns if c != "retriever"])


def memory_items(t: Tables) -> DataFrame:
    vec = vector.embed(t.documents.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "text"), "text").select("id", F.col("embedding").alias("v"))
    full = items(t).join(vec, "id")
    return full.withColumn("embedding", F.col("v")).drop("v")


_MEMORY = f"""{q.items_cte()}, {_embedding("qe", "item_id", "benchmark")}, {_embedding("de", "doc_id", "documents")}, {POLICY},
  cs AS (SELECT qe.id AS query_id, de.id AS doc_id, sum(qe.v * de.v) AS dot FROM qe JOIN de USING (b) GROUP BY ALL),
  sm AS (SELECT query_id, mi.id, round(dot / ((qe_m.norm + 1e-9) * (de_m.norm + 1e-9)), 9) AS cosine, round({q.hot("mi.reinforcement", "mi.updated_at", q.NOW, "mi.emotional_weight")}, 15) AS hot, mi.doc_id
    FROM cs JOIN mi USING (doc_id) JOIN qe_m ON qe_m.id = query_id JOIN de_m ON de_m.id = cs.doc_id WHERE mi.status = 'active'),
  bl AS (SELECT query_id, sm.id, round(round(0.8 * cosine + 0.2 * hot, 4) + coalesce(boost, 0), 4) AS score FROM sm LEFT JOIN pb ON 'm' || pb.item_id = sm.id WHERE cosine >= 0.45),
  vt AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bl),
  qt AS (SELECT DISTINCT item_id, term, lower(term) AS low FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM (SELECT item_id, term, min(pos) AS pos FROM (
      SELECT item_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_.\\-]{{2,}}')) AS term, generate_subscripts(regexp_extract_all(text, '[a-zA-Z0-9_.\\-]{{2,}}'), 1) AS pos FROM benchmark) GROUP BY 1, 2)) WHERE rn <= 20),
  kn AS (SELECT item_id, count(*) AS nt FROM qt GROUP BY 1),
  kh AS (SELECT item_id AS query_id, mi.id, mi.reinforcement, count(*) / max(nt)::DOUBLE AS ks FROM qt JOIN mi ON contains(lower(mi.summary), low) AND mi.status = 'active' JOIN kn USING (item_id) GROUP BY 1, 2, 3),
  kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ks DESC, reinforcement DESC, id) AS rank FROM kh),
  mf AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, coalesce(v.score, k.ks) AS score, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(0.5::DOUBLE / (60 + k.rank), 0), 12) AS rrf
    FROM (SELECT * FROM vt WHERE rank <= 8) v FULL JOIN (SELECT * FROM kr WHERE rank <= 30) k ON k.query_id = v.query_id AND k.id = v.id),
  mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, id) AS rank FROM mf)"""


@query("memory_retrieve", f"WITH {_MEMORY} SELECT query_id, id, round(score, 4) AS score, round(rrf, 6) AS rrf_score, rank FROM mr WHERE rank <= 8")
def memory_retrieve(t: Tables) -> DataFrame:
    from tidemark.registry.memory_queries import policy_events

    stats = policy.memory_policy(policy_events(t)).withColumn("item_id", F.concat(F.lit("m"), F.col("item_id").cast("string")))
    hits = memory.memory_retrieve(questions(t), memory_items(t), now(), stats=stats)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), F.round("rrf_score", 6).alias("rrf_score"), *big("rank"))


@query("memory_inject")
def memory_inject(t: Tables) -> DataFrame:
    rows = memory_items(t)
    hits = memory.retrieve_for("answer", questions(t), rows, now())
    block = memory.inject(hits, rows, now())
    return block.select("query_id", F.length("block").alias("chars"), F.array_join("injected_ids", "|").alias("injected"))


@query("build_preferences", f"{ALL_PAIRS} SELECT sample_id, prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, source, task_type FROM al")
def build_preferences(t: Tables) -> DataFrame:
    return all_samples(t).select("sample_id", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "source", "task_type")


@query(
    "daily_snapshot",
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'needs_approval' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'pending' END AS st FROM orders),
    m AS (SELECT * FROM o WHERE d = DATE '1998-06-03'), e AS (SELECT ts::DATE - 9356 + 0 AS d, event_type FROM events)
    SELECT 'missions' AS section, st AS key, count(*) AS value FROM m GROUP BY 2
    UNION ALL SELECT 'tool_calls', CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END, count(*) FROM m JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2
    UNION ALL SELECT 'totals', 'runs', count(*) FROM m UNION ALL SELECT 'totals', 'messages', count(*) FROM lineitem WHERE l_shipdate::DATE = DATE '1998-06-03' UNION ALL SELECT 'totals', 'memory_items', count(*) FROM events WHERE ts::DATE = DATE '1998-06-03'
    UNION ALL SELECT 'archive', strftime(d, '%Y-%m-%d'), sum(n)::BIGINT FROM (SELECT d, count(*) AS n FROM o WHERE d <= DATE '1998-06-03' AND d > DATE '1998-05-27' GROUP BY 1 UNION ALL SELECT l_shipdate::DATE, count(*) FROM lineitem WHERE l_shipdate::DATE <= DATE '1998-06-03' AND l_shipdate::DATE > DATE '1998-05-27' GROUP BY 1) GROUP BY 2
    UNION ALL SELECT 'status', CASE WHEN count(*) FILTER (st = 'failed') > 0 THEN 'degraded' WHEN count(*) FILTER (st = 'needs_approval') > 0 THEN 'idle' WHEN count(*) > 0 THEN 'running' ELSE 'idle' END, count(*) FROM m""",
)
def daily_snapshot(t: Tables) -> DataFrame:
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "it failed").alias("final_message"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "needs approval").alias("skip_reason"), F.lit("").alias("gate_exit"), F.when(F.col("o_orderstatus") == "O", "reply").alias("terminal_action"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    steps = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_index"), F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("result_text")
    )
    out = daily.daily_snapshot(runs, steps, t.lineitem.select(F.col("l_shipdate").alias("ts")), t.events.select("ts"), "1998-06-03")
    return out.select("section", "key", *big("value"))
