"""State processors: many frames, missing times, ties, cleared state; against plain versions."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs, stateful

HOUR = 3_600_000_000


class Store:
    """The state variables and timers of one key, in memory."""

    def __init__(self):
        self.values, self.lists, self.maps, self.timers = {}, {}, {}, set()

    def getValueState(self, name, _):
        v = self.values
        return SimpleNamespace(exists=lambda: name in v, get=lambda: v.get(name), update=lambda x: v.__setitem__(name, x), clear=lambda: v.pop(name, None))

    def getListState(self, name, _):
        v = self.lists
        return SimpleNamespace(exists=lambda: name in v, get=lambda: iter(v[name]), put=lambda x: v.__setitem__(name, x))

    def getMapState(self, name, *_):
        m = self.maps.setdefault(name, {})
        return SimpleNamespace(updateValue=m.__setitem__, getValue=m.get, removeKey=lambda k: m.pop(k, None), clear=m.clear, iterator=lambda: iter(list(m.items())))

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def drive(processor, batches, key=("k",), watermark=lambda n: -1):
    """Run batches (lists of frames) through a processor of one key; after each, timers below the watermark go off."""
    store, out = Store(), []
    processor.init(store)
    for n, frames in enumerate(batches):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda n=n: watermark(n))
        out += list(processor.handleInputRows(key, iter(frames), now))
        assert not store.maps["runs"], "runs are only kept while they are merged"
        for ms in sorted(t for t in store.timers if t <= watermark(n)):
            store.timers.discard(ms)
            list(processor.handleExpiredTimer(key, now, SimpleNamespace(getExpiryTimeInMs=lambda ms=ms: ms)))
    return (pd.concat(out, ignore_index=True) if out else pd.DataFrame()), store


def rows(seed, n, none=0.1):
    rng = random.Random(seed)
    times = [None if rng.random() < none else rng.randint(0, 40) * HOUR // 4 for _ in range(n)]
    return pd.DataFrame({"id": rng.sample(range(n), n), "ts": pd.Series([pd.NaT if t is None else pd.Timestamp(t, unit="us") for t in times], dtype="datetime64[ns]"), "signature": rng.choices("ab", k=n), "seconds": [rng.randint(1, 90) for _ in range(n)]})


def in_order(frame):
    at = [stateful.NO_TIME if pd.isna(t) else t.value // 1000 for t in frame["ts"]]
    return sorted(zip(at, frame["id"], frame["signature"], frame["seconds"], strict=True))


def cut(frame, size):
    return [frame.iloc[i : i + size] for i in range(0, len(frame), size)]


@pytest.mark.parametrize("frame_rows, chunk", [(1000, 2000), (37, 2000), (50, 7), (10, 1)])
def test_one_order_whatever_the_frames(monkeypatch, frame_rows, chunk):
    monkeypatch.setattr(stateful, "CHUNK_ROWS", chunk)
    frame = rows(1, 300)
    want = in_order(frame)
    got, _ = drive(stateful.Repeats(3), [cut(frame, frame_rows)])
    n, last, counts = 0, None, []
    for _, _, s, _ in want:
        n, last = (n + 1 if s == last else 1), s
        counts.append(n)
    assert got["id"].tolist() == [r[1] for r in want] and got["repeat_count"].tolist() == counts
    got, store = drive(stateful.Latency(20, 25.0), [cut(frame, frame_rows)])
    samples = [float(r[3]) for r in want]
    plain = [25.0 if i < 2 else stateful.p90(np.array(samples[max(0, i - 19) : i + 1])) for i in range(len(samples))]
    assert got["p90"].tolist() == plain and len(store.lists["samples"]) == 20


@pytest.mark.parametrize("frame_rows", [1000, 23])
def test_silence(frame_rows):
    frame = rows(2, 200)
    got, _ = drive(stateful.Silence(("a",), 3), [cut(frame, frame_rows)])
    last, want = None, []
    for at, i, *_ in in_order(frame):
        ok = last is None or at - last > 3 * HOUR
        last = at if ok else last
        want.append((i, ok))
    assert list(zip(got["id"], got["allowed"], strict=True)) == want


def test_silence_ends_with_the_watermark():
    at = lambda h: pd.Series([pd.Timestamp(h * HOUR, unit="us")])
    one = lambda i, h: [pd.DataFrame({"id": [i], "ts": at(h)})]
    got, store = drive(stateful.Silence(("a",), 2), [one(1, 0), one(2, 1), one(3, 5)], watermark=lambda n: [0, 0, 4 * 3_600_000][n])
    assert got["allowed"].tolist() == [True, False, True]
    assert store.values["last"] == (5 * HOUR,) and store.timers == {7 * 3_600_000 + 1}  # the first timer is gone
    _, store = drive(stateful.Silence(("a",), 2), [one(1, 0), one(2, 5)], watermark=lambda n: [0, 9 * 3_600_000][n])
    assert "last" not in store.values and not store.timers


@pytest.mark.parametrize("frame_rows, minutes", [(1000, 60), (19, 60), (40, 7)])
def test_trailing_counts(frame_rows, minutes):
    frame = rows(3, 250)
    ordered = in_order(frame)
    batches = [pd.concat([frame[frame["id"] == r[1]] for r in ordered[a : a + 50]]) for a in range(0, 250, 50)]
    want = {i: sum(t == at if at == stateful.NO_TIME else at - 3 * HOUR < t <= at for t, *_ in ordered[: n + 1]) for n, (at, i, *_) in enumerate(ordered)}
    marks = [max([r[0] for r in in_order(b)] + [0]) // 1000 for b in batches]
    got, store = drive(stateful.Trailing(3, minutes), [cut(b, frame_rows) for b in batches], watermark=lambda n: marks[n])
    assert dict(zip(got["id"], got["n"], strict=True)) == want
    assert sum(len(v[0]) for k, v in store.maps["ring"].items() if k[0] != stateful.NO_TIME) < 250


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """Calls in four files; a third of the rows belong to one session, times are missing or equal."""
    rng, data = random.Random(5), []
    for i in range(400):
        at = None if i < 20 else 1_704_067_200 + (i // 3) * 900
        data.append((i, "hot" if rng.random() < 0.4 else rng.choice("xyz"), at, rng.choice(["ls", "ls", None, "task_stop"]), "{}", float(rng.randint(1, 90))))
    frame = spark.createDataFrame(data, "id bigint, session_key string, at bigint, tool string, args string, seconds double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    root = str(tmp_path_factory.mktemp("stateful"))
    order = [F.asc_nulls_first("ts"), F.asc_nulls_first("id")]
    frame.repartitionByRange(4, *order).sortWithinPartitions(*order).write.parquet(f"{root}/in")
    jobs.set_arrival(spark, f"{root}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")  # so that a key comes in many frames
    yield root, frame, [r for r in frame.orderBy(*order).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def source(spark, calls):
    return jobs.read_stream(spark, f"{calls[0]}/in", calls[1].schema, files_per_trigger=1)


def test_streams_read_files_in_order_and_keep_rows_without_a_time(spark, calls, tmp_path):
    got = jobs.run_to_table(jobs.stream_repeat_guard(source(spark, calls)), f"{tmp_path}/g")
    state, want = {}, {}
    for r in calls[2]:
        if r.tool in ("task_stop", "task_output"):
            continue
        signature = ":".join(x for x in (r.tool, r.args) if x is not None)
        last, n = state.get(r.session_key, (None, 0))
        n = n + 1 if signature == last else 1
        state[r.session_key] = signature, n
        want[r.id] = (n, n >= 3)
    assert {r.id: (r.repeat_count, r.denied) for r in got.collect()} == want


def test_trailing_stream_and_cleared_state(spark, calls, tmp_path):
    got = {r.id: r.n for r in jobs.run_to_table(jobs.stream_trailing_counts(source(spark, calls), 2, delay="0 seconds"), f"{tmp_path}/t").collect()}
    want, before = {}, {}
    for r in calls[2]:
        same = before.setdefault(r.session_key, [])
        same.append(r.ts)
        want[r.id] = sum(t is None for t in same) if r.ts is None else sum(t is not None and (r.ts - t).total_seconds() < 7200 for t in same)
    assert got == want
    ring = spark.read.format("statestore").option("path", f"{tmp_path}/t/checkpoint").option("stateVarName", "ring").load()
    held = ring.selectExpr("user_map_key.bucket AS b", "size(user_map_value.times) AS n").filter(f"b <> {stateful.NO_TIME}").agg(F.sum("n")).first()[0]
    assert 0 < held < 150
