"""Combine ranked lists: rank fusion, best-hit pooling, reranking, lane unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import settle
from tidemark.operators.windows import top_rows

RRF_K = 60
KEYWORD_WEIGHT = 0.5
SCORE_DIGITS = 12


def rrf(lanes: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse (query_id, lane, variant, id, rank, score): the sum of 1/(60+rank) per id.

    Ties fall to the best original score, then the id.
    """
    first = lanes.groupBy("query_id", "lane", "variant", "id").agg(
        F.min("rank").alias("rank"), F.max("score").alias("score")
    )
    fused = first.groupBy("query_id", "id").agg(
        settle(F.sum(1.0 / (rrf_k + F.col("rank"))), SCORE_DIGITS).alias("rrf_score"),
        F.max("score").alias("best_score"),
        F.array_sort(F.collect_set("lane")).alias("lanes"),
        F.min(F.when(F.col("lane") == "vector", F.col("rank"))).alias("vector_rank"),
        F.min(F.when(F.col("lane") == "bm25", F.col("rank"))).alias("bm25_rank"),
    )
    order = [F.col("rrf_score").desc(), F.col("best_score").desc(), F.col("id")]
    return top_rows(fused, ["query_id"], order, k)


def rrf_weighted(vector_hits: DataFrame, keyword_hits: DataFrame, n: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse ranked vector (query_id, id, rank, score) and keyword (.., keyword_score) hits.

    The keyword lane counts half. The score kept is the vector score when there is one.
    """
    v = vector_hits.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = keyword_hits.select("query_id", "id", F.col("rank").alias("keyword_rank"), "keyword_score")
    both = v.join(w, ["query_id", "id"], "full_outer")
    fused = both.select(
        "query_id",
        "id",
        "vector_rank",
        "keyword_rank",
        F.coalesce("vector_score", "keyword_score").alias("score"),
        settle(
            F.coalesce(1.0 / (rrf_k + F.col("vector_rank")), F.lit(0.0))
            + F.coalesce(KEYWORD_WEIGHT / (rrf_k + F.col("keyword_rank")), F.lit(0.0)),
            SCORE_DIGITS,
        ).alias("rrf_score"),
    )
    return top_rows(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("score").desc(), F.col("id")], n)


def maxpool(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per id (within `keys`): the hit with the best score; ties go to the smaller variant."""
    group = [*(keys or []), "id"]
    rest = [c for c in hits.columns if c not in group]
    order = F.struct(F.col("score"), -F.col("variant"))
    return hits.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("hit")).select(*group, "hit.*")


def rerank(hits: DataFrame, scores: DataFrame | None, top_n: int, k: int) -> DataFrame:
    """Reorder the first `top_n` hits per query by (given score, old score); the rest follow.

    Given scores are clamped to 0..1 and count as 0 when absent. A query without any usable score
    keeps its order. Without `scores` the hits carry their `given_score`.
    """
    given = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("given_score").cast("double")))
    renamed = hits.withColumnRenamed("rank", "old_rank")
    if scores is None:
        joined = renamed.withColumn("given", F.when(F.col("given_score").isNotNull(), given)).drop("given_score")
    else:
        usable = scores.select("query_id", "id", given.alias("given")).filter(F.col("given").isNotNull())
        joined = renamed.join(usable, ["query_id", "id"], "left")
    head = F.col("old_rank") <= max(1, top_n)
    any_score = F.max(F.when(head & F.col("given").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("query_id")) == 1
    moved = head & any_score
    new = F.when(moved, F.coalesce("given", F.lit(0.0)))
    ordered = joined.withColumn("rerank_score", new).withColumn("moved", moved)
    order = [
        F.col("moved").desc(),
        F.when(F.col("moved"), F.col("rerank_score")).desc(),
        F.when(F.col("moved"), F.col("score")).desc(),
        F.col("old_rank"),
    ]
    return top_rows(ordered, ["query_id"], order, max(1, k)).drop("given", "moved")


def union_keep_first(raw: DataFrame, extra: DataFrame) -> DataFrame:
    """All raw hits, plus extra hits whose (query_id, id) is not among them."""
    new = extra.join(raw.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    return raw.withColumn("origin", F.lit("raw")).unionByName(new.withColumn("origin", F.lit("extra")))


def scoped_else_global(scoped: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Scoped hits of a query if it has any, else its global hits."""
    missing = everywhere.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    return scoped.withColumn("mode", F.lit("scoped")).unionByName(missing.withColumn("mode", F.lit("global")))
