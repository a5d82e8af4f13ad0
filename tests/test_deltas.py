"""Merge-on-read tables against a plain dictionary; snapshots, batches, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.deltas import DeltaTable

SCHEMA = "id bigint, part int, text string"


def state(table):
    out = {}
    for r in table.read().collect():
        out.setdefault(r.id, []).append((r.part, r.text))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("compacting, fanout", [(False, 4), (True, 2), (True, 4)])
def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch, compacting, fanout):
    rng, want = random.Random(fanout), {}
    table = DeltaTable(spark, str(tmp_path / "t"), ["id"])
    for n in range(9):
        rows = [(i, p, f"v{n}-{i}-{p}") for i in rng.sample([None, *range(12)], rng.choice([0, 2, 5])) for p in range(rng.randint(1, 3))]
        gone = rng.sample(range(12), rng.choice([0, 1, 3]))
        gone = [i for i in gone if i not in {r[0] for r in rows}]
        table.change(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in gone], "id bigint"), compacting=False)
        if compacting:
            table.compact(fanout=fanout)
        for i in gone:
            want.pop(i, None)
        for i in {r[0] for r in rows}:
            want[i] = sorted((p, t) for j, p, t in rows if j == i)
        assert state(table) == want
    held = table.snapshot()["deltas"]
    assert len(held) == 9 if not compacting else len(held) < 9
    table.compact(whole=True)
    assert state(table) == want and len(table.snapshot()["deltas"]) == 1 and table.snapshot()["deltas"][0].keys == 0
    assert table.vacuum() >= 9 and state(table) == want


def test_a_reader_keeps_its_snapshot_and_a_batch_counts_once(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"), ["id"])
    assert not table.exists()
    table.change(spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], SCHEMA), batch="s-0")
    seen, before = table.read(), table.snapshot()["name"]
    table.change(spark.createDataFrame([(1, 0, "c")], SCHEMA), spark.createDataFrame([(2,)], "id bigint"), batch="s-1")
    table.change(spark.createDataFrame([(1, 0, "again")], SCHEMA), batch="s-1")
    assert state(table) == {1: [(0, "c")]}
    assert {(r.id, r.text) for r in seen.collect()} == {(1, "a"), (2, "b")} == {(r.id, r.text) for r in table.read(before).collect()}


def test_a_change_writes_its_rows_only_and_reads_no_keys_of_the_base(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"), ["id"])
    table.change(spark.range(5000).select("id", F.lit(0).alias("part"), F.lit("x").alias("text")))
    table.change(spark.createDataFrame([(7, 0, "new")], SCHEMA))
    base, delta = table.snapshot()["deltas"]
    assert (base.rows, delta.rows, delta.keys) == (5000, 1, 1)
    files = table.read().inputFiles()
    assert any(f"{base.name}/rows" in f for f in files) and not any(f"{base.name}/keys" in f for f in files)
    assert table.read().count() == 5000
