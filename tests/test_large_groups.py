"""Queries on tables with one very long conversation, one very long order and one very full day."""

import pytest
from pyspark.sql import functions as F

import verify_sql

ROOT = "/root/testdata/sf0.001"
LONG = 2500
NAMES = (
    "run_summary", "run_assertions", "backend_compare", "rag_case_metrics", "json_records_scan", "legacy_nest", "consolidation_window", "daily_snapshot", "haystack_scan", "persona_scan", "history_entries",
    "prompt_cost", "cost_delta", "turn_sessions",
)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("large"))
    read = lambda name: spark.read.parquet(f"{ROOT}/{name}.parquet")
    talk, items, orders = read("conversations"), read("lineitem"), read("orders")
    n = spark.range(LONG)
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    more = n.select(F.lit(900001).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("said "), (F.col("id") % 1700).cast("string")).alias("text"))
    talk.unionByName(more).coalesce(1).write.parquet(f"{root}/t/conversations")
    one = items.filter("l_linenumber = 1").limit(1)
    steps = one.crossJoin(n).withColumn("l_linenumber", (F.col("id") + 10).cast(items.schema["l_linenumber"].dataType)).withColumn("l_suppkey", (F.col("l_suppkey") + F.col("id")).cast(items.schema["l_suppkey"].dataType)).drop("id")
    items.unionByName(steps).coalesce(1).write.parquet(f"{root}/t/lineitem")
    day = orders.withColumn("o_orderdate", F.lit("1998-06-03").cast(orders.schema["o_orderdate"].dataType))
    day.coalesce(1).write.parquet(f"{root}/t/orders")
    import glob
    import os
    import shutil

    for path in glob.glob(f"{ROOT}/*.parquet"):
        name = os.path.basename(path)
        made = glob.glob(f"{root}/t/{name.removesuffix('.parquet')}/part-*.parquet")
        shutil.copy(made[0] if made else path, f"{root}/{name}")
    shutil.rmtree(f"{root}/t")
    return root


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, large, name):
    line = verify_sql.compare(spark, verify_sql.connect(large), large, name)
    assert line.startswith("ok"), line
