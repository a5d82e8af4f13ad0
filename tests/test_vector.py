"""Block layouts of the vector and set searches give what brute force gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import dedup, memory, vector

SCHEMA = "id bigint, kind string, embedding array<float>"


def vectors(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kind = "hot" if i % 3 else f"k{i % 5}"
        out.append((i, kind, [float(x) for x in rng.normal(size=dim)]))
    out.append((n, "hot", [0.0] * dim))
    out.append((n + 1, "hot", [1.0, 2.0]))
    out.append((n + 2, "hot", None))
    return out


def brute(rows, k, threshold, same, skip):
    want = set()
    for qi, qk, qv in rows:
        if qv is None:
            continue
        scored = []
        for ii, ik, iv in rows:
            if iv is None or len(iv) != len(qv) or (same and qk != ik) or (skip and qi == ii):
                continue
            a, b = np.float32(qv).astype(float), np.float32(iv).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            score = round(float(a @ b / norm), 9) if norm else 0.0
            if score >= threshold:
                scored.append((-score, ii))
        want |= {(qi, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])}
    return want


def test_both_layouts_match_brute_force(spark):
    rows = vectors()
    items = spark.createDataFrame(rows, SCHEMA)
    asked = items.withColumnRenamed("id", "query_id")
    for same in (None, "kind"):
        want = brute(rows, 3, 0.1, same, True)
        for sent in (10_000, 0):
            got = vector.similar(asked, items, k=3, threshold=0.1, same=same, skip_same_id=True, broadcast_rows=sent, block_rows=37)
            assert {(r.query_id, r.id, r.rank) for r in got.collect()} == want


def test_blocks_of_the_best_are_long(spark, monkeypatch):
    """With `k` a query meets few blocks of items, whatever their number: copies and answers shuffled follow the rows."""
    rows = vectors(600)
    items = spark.createDataFrame(rows, SCHEMA)
    asked = items.withColumnRenamed("id", "query_id")
    for name, size in (("GRID_ROWS", 16), ("MOST_BLOCK_ROWS", 32), ("TOP_QUERY_ROWS", 64), ("TOP_ITEM_ROWS", 256), ("PIECE_ROWS", 50)):
        monkeypatch.setattr(vector, name, size)
    blocks = lambda *most: items.agg(vector._blocks(None, *most).alias("n")).first().n
    assert (blocks(32), blocks(vector.TOP_QUERY_ROWS), blocks(vector.TOP_ITEM_ROWS, 4)) == (19, 16, 4)
    got = vector.similar(asked, items, k=3, threshold=0.1, skip_same_id=True, broadcast_rows=0)
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == brute(rows, 3, 0.1, None, True)


def test_equal_scores_do_not_pass_the_cut():
    """Of many copies of a vector a block keeps `k`, those with the smallest ids."""
    import pandas as pd

    for ids in (np.arange(3000)[::-1], np.array([f"x{i:04d}" for i in range(3000)], object)[::-1]):
        same = pd.DataFrame({"iid": ids, "grp": 0, "vec": [np.ones(4, np.float32)] * len(ids)})
        got = vector._best(same.rename(columns={"iid": "qid"})[:5], same, 7, float("-inf"), False, 0.0)
        assert len(got) == 35 and all(g["iid"].tolist() == sorted(ids)[:7] for _, g in got.groupby("qid"))


def test_all_pairs_above_a_threshold(spark):
    rows = vectors(80)
    items = spark.createDataFrame(rows, SCHEMA)
    want = {(q, i) for q, i, _ in brute(rows, 10**6, 0.5, None, False)}
    got = vector.similar(items.withColumnRenamed("id", "query_id"), items, threshold=0.5, broadcast_rows=0, block_rows=16)
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_cosine_order(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.8, 0.6, 0.0]), (3, [0.0, 1.0, 0.0])], "id int, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id int, embedding array<float>")
    got = vector.similar(asked, items, k=3).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3] and abs(got[1].score - 0.8) < 1e-6


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = ["the quick brown fox jumps over it", "lorem ipsum dolor sit amet now", "数据分析 与 量化 研究员 招聘", "x", ""]
    texts = [(i, "".join(c if rng.random() > 0.1 else rng.choice("abcxyz ") for c in rng.choice(base)) ) for i in range(120)]
    grams = {}
    for i, t in texts:
        s = "".join(t.lower().split())
        grams[i] = {s[j : j + 2] for j in range(len(s) - 1)}
    want = {}
    for i, _ in texts:
        best = [(-round(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), 9), j) for j in range(i) if grams[i] and grams[j]]
        if best and -min(best)[0] >= 0.45:
            want[i] = (min(best)[1], -min(best)[0])
    df = spark.createDataFrame(texts, "id int, text string")
    for block in (16, 1024):
        got = {r.id: (r.similar_id, r.score) for r in dedup.near_dups(df, block_rows=block).collect()}
        assert got == want


def test_recent_events_are_merged_within_seven_days(spark):
    new = spark.createDataFrame([("n", [0.99, 0.01])], "id string, embedding array<float>")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    for days, repeats in ((1, 1), (8, 0)):
        stored = spark.createDataFrame([("o", [1.0, 0.0], "event", "active")], "id string, embedding array<float>, memory_type string, status string")
        stored = stored.withColumn("created_at", now - F.expr(f"INTERVAL {days} DAYS"))
        fresh, same = memory.semantic_dedup(new, stored, now)
        assert (fresh.count(), same.count()) == (1 - repeats, repeats)


def test_embedding_hook_and_default(spark):
    df = spark.createDataFrame([(1, "tool calling"), (2, "")], "id int, text string")
    own = vector.embed(df, "text", fn=lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("id").collect()
    assert [list(r.embedding) for r in own] == [[12.0, 1.0], [0.0, 1.0]]
    plain = vector.embed(df, "text", dim=16).orderBy("id").collect()
    assert abs(sum(x * x for x in plain[0].embedding) - 1) < 1e-5 and not any(plain[1].embedding)


def test_tokens_are_digested_once_for_many_texts(spark, monkeypatch):
    """The vectors of the default embedding are those of one digest per token, in whatever pieces texts are hashed."""
    import hashlib

    import pyarrow as pa

    rng = random.Random(3)
    lists = [[rng.choice(["aa", "bb", "数据", "don't", "w1"]) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(50)]
    want = []
    for tokens in lists:
        values = np.zeros(16)
        for t in tokens:
            h = int(hashlib.md5(t.encode()).hexdigest()[:5], 16)
            values[(h >> 4) % 16] += -1.0 if h & 1 else 1.0
        size = np.sqrt((values * values).sum())
        want.append((values / size if size else values).astype(np.float32).tolist())
    rows, calls, real = pa.array([["zz"], *lists], pa.list_(pa.string()))[1:], [], hashlib.md5
    monkeypatch.setattr(vector.hashlib, "md5", lambda b: calls.append(b) or real(b))
    assert vector._hashed(rows, 16).to_pylist() == want and len(calls) == 5
    monkeypatch.undo()
    monkeypatch.setattr(vector, "PIECE_TOKENS", 7)
    df = spark.createDataFrame([(i, " ".join(["aa", "bb", "w1"] * (i % 9))) for i in range(40)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in vector.embed(df, "text", dim=16).collect()}
    assert all(got[i] == vector._hashed(pa.array([["aa", "bb", "w1"] * (i % 9)], pa.list_(pa.string())), 16).to_pylist()[0] for i in range(40))
