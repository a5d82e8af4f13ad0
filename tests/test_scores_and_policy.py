"""Rewards, decay, feedback statistics and gates."""

import math

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import observe, policy

def now():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tool_rewards(spark):
    no = F.lit(None)

    def reward(status, error="", vote="", judge=no, done=False, ms=0):
        return one(spark, scoring.tool_reward(F.lit(status), F.lit(error), F.lit(vote), judge.cast("double"), F.lit(done), F.lit(ms)))

    assert reward("success") == 1.0
    assert reward("error") == -1.0
    assert reward("denied", "tool_loop_guard") == -0.5
    assert reward("error", "timeout") == -1.5
    assert reward("Success", vote="up", done=True) == 4.0
    assert reward("success", vote="thumbs_down") == -1.0
    assert reward("success", judge=F.lit(1.0)) == 2.0
    assert reward("success", ms=30_001) == 0.75


def test_memory_rewards(spark):
    got = [one(spark, scoring.memory_reward(F.lit(k))) for k in ("retrieved", "injected", "used", "corrected", "superseded", "deleted", "other")]
    assert got == [0.05, 0.10, 0.50, -1.0, -0.75, -1.0, 0.0]
    assert one(spark, scoring.memory_reward(F.lit("used"), F.lit("dislike"))) == -2.0
    assert one(spark, scoring.memory_reward(F.lit("used"), F.lit("up"), F.lit(1.25))) == 1.25


def test_missing_times_and_values(spark):
    missing = F.lit(None).cast("timestamp")
    assert one(spark, scoring.energy(missing, now())) == 0.0
    assert one(spark, scoring.hotness(F.lit(5), missing, now(), F.lit(3))) == 0.0
    assert one(spark, scoring.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    cfg = scoring.InterruptConfig()
    assert one(spark, scoring.reply_factor(missing, missing, now(), cfg)) == 0.6
    assert abs(one(spark, scoring.activity_factor(missing, F.lit(0), now(), cfg)) - 0.1) < 1e-12


def test_hotness_decays_slower_with_weight(spark):
    then = now() - F.expr("INTERVAL 14 DAYS")
    plain = one(spark, scoring.hotness(F.lit(1), then, now(), F.lit(0)))
    heavy = one(spark, scoring.hotness(F.lit(1), then, now(), F.lit(10)))
    assert abs(plain - 0.5 * (2 / 3)) < 1e-9
    assert abs(heavy - (2 / 3) * math.exp(-math.log(2) / 21 * 14)) < 1e-9


def test_send_score_vetoes(spark):
    def send(sent, gap, relevance, impact):
        s = scoring.send_score(F.lit(1.0), F.lit(sent), F.lit(1.0), F.lit(gap), F.lit(relevance), F.lit(impact))
        return one(spark, s)

    assert (send(8, 5, 5, 5).vetoed_by, send(8, 5, 5, 5).score) == ("balance", 0.0)
    assert send(0, 1, 5, 5).vetoed_by == "llm_dim"
    assert send(0, 5, 5, 5).send and not send(0, 2, 2, 2).send


def test_feedback_lifts_an_item(spark):
    events = spark.createDataFrame([("b", k) for _ in range(4) for k in ("injected", "used")], "item_id string, event_type string")
    events = events.withColumn("reward", scoring.memory_reward(F.col("event_type"))).withColumn("ts", now())
    stats = policy.memory_policy(events)
    row = stats.first()
    assert (row.injected_count, row.used_count, row.positive_count) == (4, 4, 4)
    assert abs(row.avg_reward - (4 * 0.1 + 4 * 0.5) / 12) < 1e-9 and row.retrieval_boost == 0.2
    hits = spark.createDataFrame([(1, "a", 0.95, 1), (1, "b", 0.90, 2)], "query_id int, id string, score double, rank int")
    got = {r.id: (r.rank_before, r.rank_after, r.policy_score) for r in policy.policy_rerank(hits, stats).collect()}
    assert got == {"a": (1, 2, 0.95), "b": (2, 1, 1.1)}


def test_bandit_prefers_unseen_over_poor(spark):
    rows = spark.createDataFrame([("bad", -1.0, False)] * 9 + [("good", 1.0, True)] * 9, "tool string, reward double, success boolean").withColumn("ts", now())
    names = spark.createDataFrame([("bad",), ("good",), ("new",)], "tool string")
    got = [r.tool for r in policy.bandit_rank(policy.tool_policy(rows), names).orderBy("rank").collect()]
    assert got == ["good", "new", "bad"]


def test_run_status_words(spark):
    def status(final="", skip="", gate="", action=None, finished=None):
        cols = [F.lit(final), F.lit(skip), F.lit(gate), F.lit(action).cast("string"), F.lit(finished).cast("string")]
        return one(spark, observe.run_status(*cols))

    assert status(final="Traceback ...") == "failed"
    assert status(skip="needs confirm") == "needs_approval"
    assert status(skip="人工处理") == "needs_approval"
    assert status(action="reply") == "completed"
    assert status() == "pending"


def test_urls(spark):
    def url(text):
        return one(spark, observe.normal_url(F.lit(text)))

    assert url("HTTPS://Ex.Com/A/b/?q=1#top") == "https://ex.com/A/b?q=1"
    assert url("http://ex.com/") == "http://ex.com/"
    assert url("  ") == ""
