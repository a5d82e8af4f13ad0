"""Deep pages against a plain sort."""

import random

import pytest

from tidemark.operators import maintain


@pytest.mark.parametrize("pile", [100_000, 30])
def test_deep_pages_equal_sorted_ones(spark, monkeypatch, pile):
    monkeypatch.setattr(maintain, "PILE_ROWS", pile)
    monkeypatch.setattr(maintain, "PAGE_RANGES", 16)
    rng = random.Random(pile)
    rows = [(i, rng.choice([None, 5.0, 5.0, round(rng.uniform(-9, 9), 1), float(rng.randint(0, 3))])) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(5)
    for ascending in (True, False):
        order = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0.0) if ascending else (r[1] is None, -(r[1] or 0.0)), r[0]))
        for number, size in ((1, 7), (9, 20), (14, 20), (40, 10), (41, 10), (3, 133), (1, 1000)):
            got = [(r.id, r.v, r.total) for r in maintain.deep_page(df, "v", ascending, number, size, "id").collect()]
            assert got == [(i, v, 400) for i, v in order[(number - 1) * size : number * size]]
    assert maintain.deep_page(df.limit(0), "v", True, 2, 5, "id").count() == 0


def test_a_page_reads_its_range_only(spark):
    df = spark.range(20_000).selectExpr("id", "double(id) AS v")
    part, total = maintain._page_rows(df, "v", True, 10_000, 10, "id")
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert total == 20_000 and [r.id for r in part.collect()] == list(range(10_000, 10_010)) and "Filter" in plan
