"""Terms that are sent to the texts give the rows of the equi-join, ties and missing values included."""

import random

import pytest

from tidemark.operators import lexical


@pytest.mark.parametrize("limit, piece", [(3, 4), (50, 256)])
def test_sent_terms_and_joined_terms_agree(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(lexical, "PIECE_TEXTS", piece)
    rng = random.Random(4)
    words = ["ab", "abc", "abcd", "Bcd", "x.y", "zz-top", "a_b", "needle"]
    items = [(f"m{i}", None if i % 17 == 0 else " ".join(rng.choices([*words, "ÄB", "noise"], k=rng.randint(0, 6))), rng.choice([None, 0, 1, 2])) for i in range(120)]
    items = spark.createDataFrame(items, "id string, summary string, reinforcement int").repartition(3)
    asked = spark.createDataFrame([("q1", "ABC abc needle"), ("q2", "zz-top x.y ab"), (None, "abcd"), ("q4", "nothing here"), ("q5", "!")], "query_id string, query string")
    sent = sorted(map(tuple, lexical.term_join(items, asked, limit).collect()), key=repr)
    monkeypatch.setattr(lexical, "TERMS_SENT", 0)
    assert sent and sent == sorted(map(tuple, lexical.term_join(items, asked, limit).collect()), key=repr)


def test_no_terms(spark):
    items = spark.createDataFrame([("m", "text", 1)], "id string, summary string, reinforcement int")
    asked = spark.createDataFrame([("q", "!")], "query_id string, query string")
    assert lexical.term_join(items, asked, 5).collect() == []


def test_texts_are_not_taken_apart_for_a_shuffle(spark):
    items = spark.range(50).selectExpr("concat('m', id) AS id", "repeat('some long text ', 50) AS summary", "1 AS reinforcement")
    asked = spark.createDataFrame([("q", "long")], "query_id string, query string")
    plan = lexical.term_join(items, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
