"""State by groups of keys: every key has its own answer, and state calls do not grow with the number of keys."""

import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_stateful import HOUR, Store, cut, drive, in_order, rows

from tidemark.streaming import jobs, stateful


def keyed(seed, n, keys):
    frame = rows(seed, n)
    rng = random.Random(seed)
    return frame.assign(key=pd.Series([rng.choice(keys) for _ in range(n)], dtype=object), session_key=lambda f: f["key"])


def alone(make, frame, result):
    """Results of each key's rows run by themselves."""
    want = {}
    for key in frame["key"].unique():
        mine = frame[frame["key"].isna()] if key is None else frame[frame["key"] == key]
        got, _ = drive(make(), [[mine]], key=(key,))
        want |= dict(zip(got["id"], got[result], strict=True))
    return want


@pytest.mark.parametrize("frame_rows", [1000, 41])
@pytest.mark.parametrize("one, result", [(lambda: stateful.Repeats(3), "repeat_count"), (lambda: stateful.Latency(5, 25.0), "p90"), (lambda: stateful.Silence(("key",), 3), "allowed")])
def test_keys_of_a_group_stay_apart(frame_rows, one, result):
    frame = keyed(7, 400, ["a", "b", "c", None])
    got, _ = drive(stateful.Many(one(), ("key",)), [cut(frame, frame_rows)], key=(0,))
    assert dict(zip(got["id"], got[result], strict=True)) == alone(one, frame, result)
    named = "session_key" if "session_key" in got else "key"
    assert Counter(map(repr, got[named])) == Counter(map(repr, frame["key"]))


def test_trailing_counts_of_a_group():
    frame = keyed(8, 300, ["a", "b", None])
    got, _ = drive(stateful.Trailing(3, 45, by="session_key"), [cut(frame, 60)], key=(0,))
    assert dict(zip(got["id"], got["n"], strict=True)) == alone(lambda: stateful.Trailing(3), frame, "n")


def test_groups_carry_states_and_clear_them():
    at = lambda h: pd.Timestamp(h * HOUR, unit="us")
    one = lambda *data: [pd.DataFrame({"id": [d[0] for d in data], "key": [d[1] for d in data], "ts": pd.Series([at(d[2]) for d in data])})]
    make = lambda: stateful.Many(stateful.Silence(("key",), 2), ("key",))
    got, store = drive(make(), [one((1, "a", 0), (2, "b", 0)), one((3, "a", 1), (4, "b", 5))], key=(0,), watermark=lambda n: [0, 3 * 3_600_000][n])
    assert dict(zip(got["id"], got["allowed"], strict=True)) == {1: True, 2: True, 3: False, 4: True}
    assert store.timers == {7 * 3_600_000 + 1}
    _, store = drive(make(), [one((1, "a", 0), (2, "b", 1))], key=(0,), watermark=lambda n: 4 * 3_600_000)
    assert "kept" not in store.values and not store.timers


def test_state_calls_do_not_follow_the_keys():
    calls = Counter()

    class Counting(Store):
        def getValueState(self, name, kind):
            state = super().getValueState(name, kind)
            return SimpleNamespace(**{n: (lambda *a, n=n, f=f: (calls.update([n]), f(*a))[1]) for n, f in vars(state).items()})

    made = {}
    for keys in (2, 200):
        calls.clear()
        processor = stateful.Many(stateful.Latency(20, 25.0), ("key",))
        processor.init(Counting())
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: -1)
        list(processor.handleInputRows((0,), iter([keyed(9, 400, [str(i) for i in range(keys)])]), now))
        made[keys] = sum(calls.values())
    assert made[2] == made[200] <= 4


def test_streams_take_few_calls_and_keep_large_and_missing_keys(spark, tmp_path):
    """More keys than groups: the state of a stream is held by group; whole numbers beyond 2^53 stay exact beside nulls."""
    big = 1 << 60
    data = spark.range(3000).select(
        F.col("id"), F.lit("s").alias("source_key"), F.when(F.col("id") % 1500 > 0, F.lit(big) + F.col("id") % 1500).alias("item_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
    )
    data.repartitionByRange(2, "id").write.parquet(f"{tmp_path}/in")
    jobs.set_arrival(spark, f"{tmp_path}/in")
    got = jobs.run_to_table(jobs.stream_unseen(jobs.read_stream(spark, f"{tmp_path}/in", data.schema, files_per_trigger=1), 72), f"{tmp_path}/out")
    assert {r.item_id for r in got.collect()} == {None} | {big + i for i in range(1, 1500)} and got.count() == 1500
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint").option("stateVarName", "kept").load()
    assert 0 < held.count() <= stateful.GROUPS
