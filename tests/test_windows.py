"""Bucketed windows equal plain ones, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import observe
from tidemark.operators.windows import carry_last, position, prefix_sum, seq_bucket, top_rows


def rows(n=4000, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        out.append((key, i, rng.randint(0, 9), rng.choice([None, None, "x", "y"])))
    return out


def test_running_values_match_plain_windows(spark):
    df = spark.createDataFrame(rows(), "k string, seq bigint, v int, w string")
    bucket, order = seq_bucket("seq", 97), [F.col("seq")]
    got = prefix_sum(df, ["k"], bucket, order, F.col("v"), "run")
    got = prefix_sum(got, ["k"], bucket, order, F.col("v"), "before", inclusive=False)
    got = position(got, ["k"], bucket, order, "n")
    got = position(got, ["k"], bucket, [F.col("seq").desc()], "back", descending=True)
    got = carry_last(got, ["k"], bucket, order, F.col("w"), "prev")
    got = carry_last(got, ["k"], bucket, order, F.col("w"), "upto", inclusive=True)
    w = Window.partitionBy("k").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*",
        F.sum("v").over(now).alias("run"),
        F.coalesce(F.sum("v").over(past), F.lit(0)).alias("before"),
        F.row_number().over(w).alias("n"),
        F.row_number().over(Window.partitionBy("k").orderBy(F.col("seq").desc())).alias("back"),
        F.last("w", ignorenulls=True).over(past).alias("prev"),
        F.last("w", ignorenulls=True).over(now).alias("upto"),
    )
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    top = top_rows(df, ["k"], [F.col("id").desc()], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {(r.k, r.id) for r in top.collect()} == {(0, 4998), (0, 4995), (1, 4999), (1, 4996), (2, 4997), (2, 4994)}


def test_p90_is_exclusive_and_extrapolates(spark):
    stamped = [("k", f"2024-01-01 00:{i:02d}:00", i, float(i + 1)) for i in range(20)]
    stamped += [("s", f"2024-01-01 0{i}:00:00", i, float(i + 1)) for i in range(3)]
    df = spark.createDataFrame(stamped, "key string, t string, id int, seconds double").withColumn("ts", F.to_timestamp("t"))
    for seconds in (60, 3600, 864000):
        got = {(r.key, r.id): r.p90 for r in observe.latency_p90(df, bucket_seconds=seconds).collect()}
        assert abs(got[("k", 19)] - 18.9) < 1e-9
        assert abs(got[("s", 2)] - 3.6) < 1e-9
        assert got[("s", 0)] == got[("s", 1)] == 25.0


def test_repeat_runs_cross_buckets(spark):
    calls = [("s", f"2024-01-01 00:00:{i:02d}", i, tool, "{}") for i, tool in enumerate("aaabba") ]
    calls.append(("s", "2024-01-01 00:00:02", 99, "task_stop", "{}"))
    df = spark.createDataFrame(calls, "session_key string, t string, id int, tool string, args string").withColumn("ts", F.to_timestamp("t"))
    for seconds in (1, 4, 3600):
        got = sorted((r.id, r.repeat_count, r.denied) for r in observe.repeat_runs(df, 3, seconds).collect())
        assert got == [(0, 1, False), (1, 2, False), (2, 3, True), (3, 1, False), (4, 2, False), (5, 1, False)]
