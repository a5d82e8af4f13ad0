"""Feedback statistics and the rankings they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import clamp
from tidemark.operators.windows import position

MAX_BOOST = 0.20


def memory_policy(events: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Counts, mean reward, reliability, usefulness and boost per item.

    `events`: item_id, event_type, reward, ts. `used` and `corrected` with a reward of the matching
    sign also count as feedback, so the mean divides by more than the number of events.
    """
    kind = F.col("event_type")
    counts = {k: F.count_if(kind == k) for k in ("retrieved", "injected", "used", "corrected", "superseded", "deleted")}
    counts["positive"] = F.count_if((F.col("reward") > 0) & kind.isin("user_positive", "used"))
    counts["negative"] = F.count_if((F.col("reward") < 0) & kind.isin("user_negative", "corrected"))
    stats = events.groupBy(*keys).agg(
        *[c.alias(f"{n}_count") for n, c in counts.items()],
        (F.sum(F.round(F.col("reward") * 1e9).cast("bigint")) / 1e9).alias("total_reward"),  # whole billionths: no order of adding changes the sum
        F.max("ts").alias("last_event_at"),
    )
    return policy_scores(stats)


def policy_scores(stats: DataFrame) -> DataFrame:
    """Derive the mean reward and the scores from the counters; also used on streaming counters."""

    def n(name: str) -> Column:
        return F.col(f"{name}_count")

    events = sum((n(k) for k in ("injected", "used", "corrected", "superseded", "deleted", "positive", "negative")), n("retrieved"))
    average = F.col("total_reward") / F.greatest(events, F.lit(1))
    good = n("used") + n("positive")
    bad = n("corrected") + n("superseded") + n("deleted")
    shown = F.greatest(n("retrieved") + n("injected"), F.lit(1))

    def upto(col: Column, top: int) -> Column:
        return F.least(col, F.lit(top))

    reliability = (
        0.50
        + 0.015 * upto(n("retrieved"), 20)
        + 0.035 * upto(n("injected"), 20)
        + 0.090 * upto(good, 10)
        - 0.180 * upto(n("corrected"), 10)
        - 0.140 * upto(n("superseded"), 10)
        - 0.180 * upto(n("deleted"), 10)
        - 0.120 * upto(n("negative"), 10)
    )
    usefulness = (0.50 * n("injected") + 1.50 * n("used") + 2.00 * n("positive")) / (shown + good + bad)
    boost = 0.24 * (reliability - 0.5) + 0.18 * (usefulness - 0.35) + 0.08 * average
    return stats.select(
        *stats.columns,
        average.alias("avg_reward"),
        clamp(reliability, 0.0, 1.0).alias("reliability"),
        clamp(usefulness, 0.0, 1.0).alias("usefulness"),
        clamp(boost, -MAX_BOOST, MAX_BOOST).alias("retrieval_boost"),
    )


def tool_policy(events: DataFrame, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Count, total and mean reward, success rate and last use per tool.

    `events`: tool, reward, success (may be null), ts.
    """
    stats = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum("reward"), 6).alias("total_reward"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.max("ts").alias("last_used_at"),
    )
    judged = F.greatest(F.col("success_count") + F.col("failure_count"), F.lit(1))
    return stats.withColumn("avg_reward", F.col("total_reward") / F.col("count")).withColumn(
        "success_rate", F.round(F.col("success_count") / judged, 6)
    )


def policy_rerank(hits: DataFrame, stats: DataFrame, max_boost: float = MAX_BOOST) -> DataFrame:
    """Add the clamped boost of each item to its score; rank per query before and after.

    `hits`: query_id, id, score, rank. Items without history are neutral.
    """
    known = stats.select(F.col("item_id").alias("id"), "retrieval_boost", "reliability", "usefulness")
    joined = hits.join(known, "id", "left").fillna({"retrieval_boost": 0.0, "reliability": 0.5, "usefulness": 0.0})
    top = max(0.0, min(0.5, max_boost))
    boosted = joined.withColumn(
        "policy_score", F.round(F.col("score") + clamp(F.col("retrieval_boost"), -top, top), 4)
    )
    return boosted.withColumnRenamed("rank", "rank_before").withColumn(
        "rank_after", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("policy_score").desc(), F.col("rank_before")))
    )


def bandit_rank(
    stats: DataFrame, candidates: DataFrame, weight: float = 1.0, cold_start: float = 0.25, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Upper-confidence score per candidate tool; unseen tools get the cold-start score.

    `stats` comes from `tool_policy`; `candidates` has a `tool` column (and `keys`, ranked apart).
    """
    weight = max(0.0, weight)
    total = stats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).scalar()
    known = stats.select("tool", "count", "avg_reward")
    joined = candidates.join(known, "tool", "left")
    bonus = F.when(
        F.coalesce("count", F.lit(0)) > 0, weight * F.sqrt(F.log(F.greatest(F.lit(2), total + 1)) / F.col("count"))
    ).otherwise(weight)
    scored = joined.withColumn("exploration_bonus", bonus).withColumn(
        "score", F.round(F.coalesce("avg_reward", F.lit(cold_start)) + F.col("exploration_bonus"), 9)
    )
    bucket = F.floor(F.col("score") * 1000).cast("bigint")
    return position(scored, keys, bucket, [F.col("score").desc(), F.col("tool")], "rank", descending=True)
