"""Blocks of near duplicates: a pair of blocks serves both of its sides, piece by piece."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import dedup


def plain(rows, threshold):
    out = {}
    for i, (a, x) in rows.items():
        found = [(-round(len(x & y) / len(x | y), 9), b) for b, y in rows.values() if b < a]
        if found and -min(found)[0] >= threshold:
            out[a] = (min(found)[1], -min(found)[0])
    return out


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_best_of_both_sides(monkeypatch, piece):
    monkeypatch.setattr(dedup, "PIECE_ROWS", piece)
    rng = random.Random(3)
    rows = {i: (i, set(rng.sample(range(12), rng.randint(3, 8)))) for i in rng.sample(range(90), 40)}
    frame = pd.DataFrame({"id": list(rows), "g": [np.array(sorted(g), np.int64) for _, g in rows.values()]})
    a, b = frame.iloc[:17].reset_index(drop=True), frame.iloc[17:].reset_index(drop=True)
    found = pd.concat([dedup._best(a, a, 0.45), dedup._best(b, b, 0.45), dedup._best(a, b, 0.45)])
    best = {}
    for r in found.itertuples():
        best[r.id] = min(best.get(r.id, (1.0, 0)), (-r.score, r.similar_id))
    assert {i: (other, -score) for i, (score, other) in best.items()} == plain(rows, 0.45)


@pytest.mark.parametrize(("dense", "columns", "kept"), [(0, 2, 1), (0, 4096, 4), (3, 2, 0), (10**9, 4096, 4)])
def test_pairs_as_columns_and_one_by_one(monkeypatch, dense, columns, kept):
    for name, value in (("DENSE_PAIRS", dense), ("DENSE_COLUMNS", columns), ("KEPT_CHUNKS", kept), ("PIECE_ROWS", 7)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(8)
    rows = {i: (i, set(rng.sample(range(12), rng.randint(1, 8)))) for i in rng.sample(range(90), 50)}
    frame = pd.DataFrame({"id": list(rows), "g": [np.array(sorted(g), np.int64) for _, g in rows.values()]})
    assert {r.id: (r.similar_id, r.score) for r in dedup._best(frame, frame, 0.45).itertuples()} == plain(rows, 0.45)


def test_sets_of_any_text(spark):
    texts = {1: "ab ab Cabc", 2: "\U0001f600x \U0001f600X", 3: None, 4: "a", 5: "abc", 6: "\U0001f600x", 7: "ABC cab"}
    df = spark.createDataFrame([*texts.items(), (None, "abc")], "id bigint, text string")
    chars = {i: "".join((t or "").lower().split()) for i, t in texts.items()}
    sets = {i: (i, {t[k : k + 2] for k in range(len(t) - 1)}) for i, t in chars.items() if len(t) > 1}
    assert {r.id: (r.similar_id, r.score) for r in dedup.near_dups(df).collect()} == plain(sets, 0.45)
