"""The inverted file gives what brute force gives; its fast mode is measured; its shuffle follows the rows."""

import numpy as np
import pytest

from tests.test_vector import SCHEMA, brute, vectors
from tidemark.operators import inverted


def clustered(n, n_centres, dim=16, seed=3, wide=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_centres, dim))
    return [(i, "k", [float(x) for x in centres[i % n_centres] + wide * rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("same, skip, threshold, epsilon", [(None, True, 0.1, 0.0), ("kind", False, float("-inf"), 0.0), ("kind", True, 0.6, 1e-9)])
def test_exact_mode_matches_brute_force(spark, tmp_path, same, skip, threshold, epsilon):
    rows = vectors(240) + [(1000 + i, "hot", [0.5] * 8) for i in range(60)]  # a fifth are equal
    items = spark.createDataFrame(rows, SCHEMA)
    lists = inverted.build_lists(items, str(tmp_path / "l"), same=same, n_lists=9)
    assert len(lists.centres) > 3 and lists.rows.count() == len(rows) - 1
    got = inverted.search_lists(lists, items.withColumnRenamed("id", "query_id"), k=3, threshold=threshold, same=same, skip_same_id=skip, epsilon=epsilon, block_rows=29)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == brute(rows, 3, threshold, same, skip)


def test_all_pairs_above_a_threshold(spark, tmp_path):
    rows = clustered(200, 10) + [(900, "k", [0.0] * 16), (901, "k", [1.0]), (902, "k", None)]
    items = spark.createDataFrame(rows, SCHEMA)
    lists = inverted.build_lists(items, str(tmp_path / "l"), n_lists=10)
    got = inverted.search_lists(lists, items.withColumnRenamed("id", "query_id"), threshold=0.9, block_rows=16)
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, i) for q, i, _ in brute(rows, 10**6, 0.9, None, False)}


def test_small_and_empty_tables_have_one_list(spark, tmp_path):
    rows = vectors(6)
    items = spark.createDataFrame(rows, SCHEMA)
    lists = inverted.build_lists(items, str(tmp_path / "l"))
    got = inverted.search_lists(lists, items.withColumnRenamed("id", "query_id"), k=2)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == brute(rows, 2, float("-inf"), None, False)
    none = inverted.build_lists(items.limit(0), str(tmp_path / "n"))
    assert inverted.search_lists(none, items.withColumnRenamed("id", "query_id"), k=2).count() == 0


def test_fast_mode_finds_nearly_all(spark, tmp_path):
    items = spark.createDataFrame(clustered(1500, 40, wide=0.4), SCHEMA)
    asked = items.withColumnRenamed("id", "query_id").filter("query_id % 10 = 0")
    lists = inverted.build_lists(items, str(tmp_path / "l"), n_lists=30)
    truth = inverted.search_lists(lists, asked, k=5)
    found = [inverted.recall(inverted.search_lists(lists, asked, k=5, probes=p), truth) for p in (1, 4, 31)]
    assert found[0] <= found[1] <= found[2] == 1.0 and found[1] >= 0.9


def test_probes_follow_the_rows_not_their_square(spark, tmp_path):
    """Four times the rows, with lists of the same size: about four times the probes, where blocks against blocks give sixteen."""
    counts = []
    for n in (1000, 4000):
        items = spark.createDataFrame(clustered(n, n // 50), SCHEMA)
        lists = inverted.build_lists(items, str(tmp_path / f"l{n}"), n_lists=n // 50)
        asked = items.selectExpr("id AS qid", "0 AS grp", "embedding AS vec", "0.95D AS floor")
        counts.append(inverted._probes(lists, asked, lists.heads.toPandas(), 0.0, None, 0).count())
    assert counts[1] < 6 * counts[0] and counts[0] < 1000 * 10


def test_rows_without_structure_are_copied_like_a_grid(spark, tmp_path):
    """Random directions rule no list out: a question goes to each shelf, not to each of the lists on it."""
    rng = np.random.default_rng(4)
    rows = [(i, "k", [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    items = spark.createDataFrame(rows, SCHEMA)
    lists = inverted.build_lists(items, str(tmp_path / "l"), n_lists=30)
    heads = inverted._shelves(lists, 200)
    asked = items.selectExpr("id AS qid", "0 AS grp", "embedding AS vec", "0.1D AS floor")
    assert inverted._probes(lists, asked, heads, 0.0, None).count() <= 600 * heads["shelf"].nunique() <= 600 * 5
    got = inverted.search_lists(lists, items.withColumnRenamed("id", "query_id"), threshold=0.6, block_rows=200)
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, i) for q, i, _ in brute(rows, 10**6, 0.6, None, False)}


def test_questions_leave_in_small_frames(spark, tmp_path, monkeypatch):
    """A batch of questions that probes everything is not copied as a whole."""
    sizes = []
    items = spark.createDataFrame(clustered(300, 6), SCHEMA)
    lists = inverted.build_lists(items, str(tmp_path / "l"), n_lists=6)
    monkeypatch.setattr(inverted, "OUT_ROWS", 50)

    class Questions:
        schema = spark.createDataFrame([], "qid bigint, grp int, vec array<float>, floor double").schema

        def mapInPandas(self, fn, _):
            batch = items.selectExpr("id AS qid", "0 AS grp", "embedding AS vec", "-1D AS floor").toPandas()
            sizes.extend(len(f) for f in fn(iter([batch])))

    inverted._probes(lists, Questions(), lists.heads.toPandas(), 0.0, None)
    assert sum(sizes) == 300 * 6 and max(sizes) <= 50
