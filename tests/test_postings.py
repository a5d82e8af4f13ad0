"""Stored postings: the pruned search equals the full one, leaves ranges out, and reads no arrays for its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical, postings

WORDS = ["the", "of", "in", *(f"w{i}" for i in range(80)), "don't", "记忆", "é"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, [300 / (1 + j) for j in range(len(WORDS))], k=rng.choice([0, 1, 10, 60, 300])))) for i in range(n)]
    rows += [(n + i, "rare w70 w71 w72 w73 passage") for i in range(12)] + [(n + 50, None), (n + 51, ""), (n + 52, "?!")]
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 4, 20])))) for i in range(15)]
    return rows, asked + [(90, "w70 w71 w72 w73 passage"), (91, None), (92, ""), (93, "zzz nowhere"), (94, "the the the")]


def frames(spark, seed, n):
    rows, asked = corpus(seed, n)
    return spark.createDataFrame(rows, "id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, query string")


@pytest.mark.parametrize("k, range_docs, first", [(5, 16, 1), (3, 4, 2), (500, 16, 1), (5, 10_000, 1)])
def test_equal_to_the_full_score(spark, tmp_path, k, range_docs, first):
    docs, asked = frames(spark, k, 300)
    index = postings.build_index(docs, str(tmp_path / "ix"), range_docs=range_docs)
    got = postings.search_index(index, asked, k, first_ranges=first)
    want = lexical.bm25_search(docs, asked, k)
    key = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_counts_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "b a b c b a"), (2, ""), (3, None), (4, "xx xx"), (5, "aa bb aa")], "id bigint, text string")
    got = {r.id: (r.len, {t.term: t.tf for t in r.terms}) for r in postings.term_counts(docs, "id", "text").collect()}
    assert got == {1: (0, {}), 2: (0, {}), 3: (0, {}), 4: (2, {"xx": 2}), 5: (3, {"aa": 2, "bb": 1})}


def test_ranges_without_an_answer_are_left_out(spark, tmp_path):
    docs, asked = frames(spark, 7, 600)
    index = postings.build_index(docs, str(tmp_path / "ix"), range_docs=16)
    one = asked.filter("query_id = 90")
    found = postings.chosen_ranges(index, one, 5, query_id="query_id", query_col="query", k1=1.5, b=0.75, first_ranges=2)
    scores = {r["range"]: r.m for r in found.scores(found.bounds).join(index.docs.select("id", "range"), "id").groupBy("range").agg(F.max("score").alias("m")).collect()}
    bounds = {r["range"]: r.bound for r in found.bounds.collect()}
    assert all(scores[r] <= bounds[r] for r in scores)
    assert found.kept.count() < found.bounds.count()


def test_bounds_do_not_read_the_arrays(spark, tmp_path):
    docs, asked = frames(spark, 8, 100)
    index = postings.build_index(docs, str(tmp_path / "ix"))
    found = postings.chosen_ranges(index, asked, 5, query_id="query_id", query_col="query", k1=1.5, b=0.75, first_ranges=1)
    plan = found.bounds._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan parquet" in line and "most_tf" in line]
    assert reads and all("ids:" not in line and "tfs:" not in line for line in reads)


def test_a_new_version_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "ix")
    docs, asked = frames(spark, 9, 50)
    postings.build_index(docs, path)
    index = postings.build_index(docs.filter("id >= 50"), path)
    assert {r.id for r in postings.search_index(index, asked.filter("query_id = 90"), 50).collect()} == set(range(50, 62))
    empty = postings.build_index(docs.limit(0), str(tmp_path / "none"))
    assert postings.search_index(empty, asked, 5).count() == 0


def test_postings_are_shuffled_in_blocks_only(spark, tmp_path):
    """Grouping by range and term, and scoring, find the rows dealt by range: no exchange carries single postings."""
    docs, asked = frames(spark, 9, 200)
    index = postings.build_index(docs, str(tmp_path / "ix"), range_docs=16)
    found = postings.chosen_ranges(index, asked, 5, query_id="query_id", query_col="query", k1=1.5, b=0.75, first_ranges=1)
    plan = found.scores(found.bounds)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(range" in line for line in exchanges)
    assert not any("term#" in line.split("hashpartitioning")[1] or "query_id" in line for line in exchanges if "range" in line)
