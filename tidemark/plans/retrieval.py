"""Composed retrieval: documents for questions, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import context, evals, fusion, lexical, vector
from tidemark.operators.windows import top_rows

# A trigger in the question adds its expansion once.
EXPANSIONS = (
    ("工具", "tool tool calling function calling"),
    ("tool", "tool calling function calling"),
    ("记忆", "memory long-term memory retrieval"),
    ("memory", "memory long-term memory retrieval"),
    ("检索", "retrieval vector search bm25 hybrid search"),
    ("retrieval", "retrieval vector search bm25 hybrid search"),
    ("引用", "citation source validation"),
    ("citation", "citation source validation"),
    ("任务", "task scheduler background task proactive notification"),
    ("scheduler", "task scheduler background task proactive notification"),
    ("插件", "plugin plugin system lifecycle hook"),
    ("plugin", "plugin plugin system lifecycle hook"),
)


def query_variants(queries: DataFrame, expansions: Sequence[tuple[str, str]] = EXPANSIONS, limit: int = 3) -> DataFrame:
    """(query_id, variant_no, variant): the question, its normal form, and with expansions.

    Variants that agree in their normal form count once, so the plain normal form never stays.
    """
    rows = queries.select("query_id", tx.strip(F.col("query")).alias("original")).filter("original <> ''")
    rows = rows.withColumn("normal", tx.squash(F.lower("original")))
    added = F.array_distinct(
        F.array_compact(
            F.array(*[F.when(F.contains("normal", F.lit(trigger)), F.lit(" ".join(text.lower().split()))) for trigger, text in expansions])
        )
    )
    rows = rows.withColumn("added", added)
    grown = F.when(F.size("added") > 0, F.concat_ws(" ", "normal", F.array_join("added", " ")))
    variants = F.slice(F.array_compact(F.array("original", grown)), 1, max(1, limit))
    return rows.select("query_id", F.posexplode(variants).alias("variant_no", "variant"))


@dataclass(frozen=True)
class RetrieveConfig:
    k: int = 6
    mode: str = "hybrid_rrf"
    threshold: float = 0.20
    max_chars: int = 2400
    expand_parents: bool = True
    rerank_top_n: int = 10


Embedder = Callable[[DataFrame, str], DataFrame]


def default_embedder(df: DataFrame, col: str) -> DataFrame:
    return vector.embed(df, col)


def ranked_lanes(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, cfg: RetrieveConfig, embedder: Embedder) -> DataFrame:
    """Hits of every lane and question variant: query_id, lane, variant, id, rank, score."""
    if cfg.mode == "hybrid_rrf":
        asked = query_variants(queries)
    else:
        asked = queries.select("query_id", F.lit(0).alias("variant_no"), tx.strip(F.col("query")).alias("variant")).filter("variant <> ''")
    # one key per question and variant, so the lanes rank each variant on its own
    asked = asked.withColumn("key", F.concat_ws(" ", F.col("variant_no").cast("string"), F.col("query_id").cast("string")))
    back = asked.select("key", "query_id", F.col("variant_no").alias("variant"))
    lanes = []
    if cfg.mode in ("vector", "hybrid_rrf"):
        q = embedder(asked.select("key", "variant"), "variant").select("key", "embedding")
        hits = vector.similar(q, vectors, k=cfg.k, threshold=cfg.threshold, query_id="key")
        lanes.append(hits.select("key", "id", "rank", "score", F.lit("vector").alias("lane")))
    if cfg.mode in ("bm25", "hybrid_rrf"):
        body = chunks.select("id", lexical.chunk_search_text().alias("body"))
        hits = lexical.bm25_search(body, asked, max(2 * cfg.k, 12), text_col="body", query_id="key", query_col="variant")
        lanes.append(hits.select("key", "id", "rank", "score", F.lit("bm25").alias("lane")))
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out.join(back, "key").drop("key")


def knowledge_hits(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, cfg: RetrieveConfig = RetrieveConfig(), embedder: Embedder = default_embedder, scores: DataFrame | None = None
) -> DataFrame:
    """Chunks per question: query_id, id, score, rank, lanes, before parent expansion.

    `chunks`: id, document_id, text, heading_path, source_path, title, parent_id, chunk_type,
    line_start, line_end; parents are not searched. `vectors`: id, embedding. `scores` (query_id,
    id, given_score) rerank the first hits.
    """
    kids = chunks.filter(F.coalesce("chunk_type", F.lit("child")) != "parent")
    lanes = ranked_lanes(queries, kids, vectors, cfg, embedder)
    if cfg.mode == "hybrid_rrf":
        hits = fusion.rrf(lanes, cfg.k).withColumnRenamed("rrf_score", "score")
    else:
        hits = lanes.filter(F.col("rank") <= cfg.k).select("query_id", "id", "score", "rank", F.array("lane").alias("lanes"))
    return hits if scores is None else fusion.rerank(hits, scores, cfg.rerank_top_n, cfg.k)


def knowledge_retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, cfg: RetrieveConfig = RetrieveConfig(), embedder: Embedder = default_embedder, scores: DataFrame | None = None
) -> DataFrame:
    """Context per question: query_id, id, citation_id, score, matched_child_ids, entry, used_chars, injected.

    Every retrieved chunk is listed; `injected` marks those inside the character budget.
    """
    hits = knowledge_hits(queries, chunks, vectors, cfg, embedder, scores)
    info = chunks.select("id", "parent_id", "chunk_type")
    if cfg.expand_parents:
        wide = hits.select("query_id", "id", "score").join(info, "id")
        grown = context.expand_to_parents(wide, chunks.select("id", "parent_id", "chunk_type", "text")).withColumnRenamed("key", "id").drop("parent_text")
    else:
        grown = hits.select("query_id", "id", "score", F.array("id").alias("matched_child_ids"), F.lit(True).alias("fallback"))
    ranked = top_rows(grown, ["query_id"], [F.col("score").desc(), F.col("id")], cfg.k)
    full = ranked.join(chunks.select("id", "document_id", "text", "source_path", "heading_path", "line_start", "line_end"), "id")
    packed = context.pack_context(full, cfg.max_chars).select("query_id", "id", "citation_id", "entry", "used_chars")
    return full.select("query_id", "id", "document_id", "rank", "score", "matched_child_ids", "fallback").join(packed, ["query_id", "id"], "left").withColumn(
        "injected", F.col("entry").isNotNull()
    )


def retrieval_log(results: DataFrame, queries: DataFrame, at) -> DataFrame:
    """One log row per question with the retrieved and injected ids."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "injected")))
    packed = results.groupBy("query_id").agg(rows.alias("rows")).join(queries.select("query_id", "query"), "query_id")
    got = F.transform("rows", lambda r: r["id"].cast("string"))
    used = F.transform(F.filter("rows", lambda r: r["injected"]), lambda r: r["id"].cast("string"))
    digest = F.concat_ws(":", F.lit(""), "query", F.array_join(got, ","))
    return packed.select(
        tx.stable_id("kretr_", 24, digest).alias("event_id"), "query", got.alias("retrieved_chunk_ids"), used.alias("injected_chunk_ids"), at.alias("created_at")
    )


def evaluate_retrieval(
    cases: DataFrame, chunks: DataFrame, vectors: DataFrame, ks: Sequence[int] = (1, 3, 5), k: int = 5, embedder: Embedder = default_embedder
) -> DataFrame:
    """Mean metrics of the keyword, vector and fused retriever over evaluation cases.

    `cases`: case_id, query, relevant_chunk_ids, relevant_document_ids.
    """
    asked = cases.select(F.col("case_id").alias("query_id"), "query")
    owner = chunks.select("id", "document_id")
    preds = None
    for mode in ("bm25", "vector", "hybrid_rrf"):
        hits = knowledge_hits(asked, chunks, vectors, RetrieveConfig(k=k, mode=mode), embedder).join(owner, "id")
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("c"), F.col("document_id").cast("string").alias("d"))))
        packed = hits.groupBy("query_id").agg(rows.alias("r")).select(
            F.lit(mode).alias("retriever"), F.col("query_id").alias("case_id"), F.transform("r", lambda x: x["c"]).alias("chunk_ids"), F.transform("r", lambda x: x["d"]).alias("document_ids")
        )
        preds = packed if preds is None else preds.unionByName(packed)
    return evals.evaluate(cases, preds, ks)
