"""State processors: rows of a key in event order, state in RocksDB, cleared by event-time timers.

A batch hands a processor the rows of a key in frames of bounded size. `InOrder` never puts them
together: a single frame is sorted and used as it is; of several, each is sorted for itself, kept in
chunks in map state (on disk, not in memory) and all are merged chunk by chunk. So memory holds one chunk
for each frame, whatever share of the rows one key has. What a processor keeps between batches is a value,
a list of at most `window` samples or a ring of time buckets, never rows without a bound.

A stream deals its keys into `GROUPS` groups by hash, and a processor is called with the rows of a group: state calls
and frames are paid for each group and batch, not for each key. `Many` takes the steps of a processor for all keys of a
group, `Trailing` keeps the key beside each time.

Rows without a time count as one moment before all others; among equal times the smaller id is first.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import ROCKSDB

#: Rows of a chunk of a kept frame.
CHUNK_ROWS = 2000
#: Microseconds that stand for "no time".
NO_TIME = -(1 << 62)
#: Groups that the keys of a stream are dealt into; fixed, since the state is kept by group.
GROUPS = 512


def with_rocksdb(spark: SparkSession) -> None:
    """The state store these processors need; queries that start later in this session use it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(times: pd.Series) -> np.ndarray:
    """Event times as microseconds, NO_TIME for none."""
    stamps = times.to_numpy("datetime64[us]")
    return np.where(np.isnat(stamps), NO_TIME, stamps.astype(np.int64))


def packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_all().to_pandas()


def column(frame: pd.DataFrame, name: str) -> list:
    """Values of a key column, None for none."""
    values = frame[name].astype(object)
    return values.where(values.notna(), None).tolist()


class InOrder(StatefulProcessor):
    """Base of processors that take the rows of a key by (ts, id); rows have at least these two columns.

    `step` goes from one row to the next: it takes the state of the key (None at first) and the row's value of the
    column `reads`, and gives the next state and the row's result.
    """

    reads = "us"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run int, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.begin(key)
        for frame in self.ordered(iter(rows)):
            yield self.take(key, frame)
        self.end(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expire(key, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass

    def ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = next(frames, None), next(frames, None)
        if first is None:
            return
        if second is None:
            yield self.sort(first)
            return
        parts = []
        for run, frame in enumerate(chain((first, second), frames)):
            frame = self.sort(frame)
            parts.append(-(-len(frame) // CHUNK_ROWS))
            for part in range(parts[-1]):
                self.runs.updateValue((run, part), (packed(frame.iloc[part * CHUNK_ROWS : (part + 1) * CHUNK_ROWS]),))
        columns = [*first.columns, "us"]
        at, name = columns.index("us"), columns.index("id")
        merged = heapq.merge(*[self.run(i, n) for i, n in enumerate(parts)], key=lambda row: (row[at], row[name] is not None, row[name]))
        while some := list(islice(merged, CHUNK_ROWS)):
            yield pd.DataFrame(some, columns=columns)
        self.runs.clear()

    def sort(self, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(us=micros(frame["ts"]))
        return frame.sort_values(["us", "id"], kind="stable", na_position="first")

    def run(self, run: int, parts: int) -> Iterator[tuple]:
        for part in range(parts):
            frame = unpacked(self.runs.getValue((run, part))[0])
            yield from frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)

    def begin(self, key) -> None:
        """Read what is kept of the key."""

    def take(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        """Output rows for the next rows in order; `us` is the time in microseconds."""
        results = []
        for value in frame[self.reads].tolist():
            self.now, result = self.step(self.now, value)
            results.append(result)
        return self.rows([[k] * len(frame) for k in key], frame, results)

    def step(self, state, value) -> tuple:
        raise NotImplementedError

    def rows(self, keys: list[list], frame: pd.DataFrame, results: list) -> pd.DataFrame:
        """Output rows from the values of the keys, the rows and their results."""
        raise NotImplementedError

    def ends_ms(self, state) -> int | None:
        """When the watermark makes this state worthless, if ever."""
        return None

    def end(self, key, timers) -> None:
        """Keep what the next batch needs."""

    def expire(self, key, at_ms: int) -> None:
        """A timer of the key has gone off."""


class Silence(InOrder):
    """`allowed`: no allowed row of the key came in the `hours` before; refused rows start no silence.

    State: the time of the last allowed row, until the watermark has passed the end of its silence.
    """

    def __init__(self, keys: tuple[str, ...], hours: int) -> None:
        self.keys, self.span = keys, max(hours, 1) * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us bigint")

    def ends_ms(self, last: int) -> int | None:
        return None if last == NO_TIME else (last + self.span) // 1000 + 1

    def begin(self, key) -> None:
        self.before = self.now = self.last.get()[0] if self.last.exists() else None

    def step(self, last: int | None, at: int) -> tuple:
        ok = last is None or at - last > self.span
        return (at if ok else last), ok

    def rows(self, keys: list[list], frame: pd.DataFrame, results: list) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(self.keys, keys, strict=True)), "id": frame["id"].to_numpy(), "ts": frame["ts"].to_numpy(), "allowed": results})

    def end(self, key, timers) -> None:
        if self.now == self.before:
            return
        if self.before is not None and self.before != NO_TIME:
            self.handle.deleteTimer(self.ends_ms(self.before))
        if self.now != NO_TIME and self.ends_ms(self.now) <= timers.getCurrentWatermarkInMs():
            self.last.clear()  # no row that still counts can fall into this silence
            return
        self.last.update((self.now,))
        if self.now != NO_TIME:
            self.handle.registerTimer(self.ends_ms(self.now))

    def expire(self, key, at_ms: int) -> None:
        if self.last.exists() and self.ends_ms(self.last.get()[0]) <= at_ms:
            self.last.clear()


class Repeats(InOrder):
    """Length of the run of equal signatures; a key keeps one signature and one number."""

    reads = "signature"

    def __init__(self, stop: int) -> None:
        self.stop = stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "signature string, n bigint")

    def begin(self, key) -> None:
        self.now = self.last.get() if self.last.exists() else None

    def step(self, last: tuple | None, signature) -> tuple:
        n = last[1] + 1 if last is not None and last[0] == signature else 1
        return (signature, n), n

    def rows(self, keys: list[list], frame: pd.DataFrame, results: list) -> pd.DataFrame:
        counts = np.asarray(results, np.int64)
        return pd.DataFrame({"session_key": keys[0], "id": frame["id"].to_numpy(), "repeat_count": counts, "denied": counts >= self.stop})

    def end(self, key, timers) -> None:
        self.last.update(self.now)


def p90(samples: np.ndarray) -> float:
    n = len(samples)
    ordered = np.sort(samples)
    j = min(max(9 * (n + 1) // 10, 1), n - 1)
    delta = 9 * (n + 1) - j * 10
    return float((ordered[j - 1] * (10 - delta) + ordered[j] * delta) / 10.0)


class Latency(InOrder):
    """P90 of the last `window` samples after each one; the samples are the list state."""

    reads = "seconds"

    def __init__(self, window: int, default: float) -> None:
        self.window, self.default = window, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.samples = handle.getListState("samples", "seconds double")

    def begin(self, key) -> None:
        self.now = [row[0] for row in self.samples.get()] if self.samples.exists() else []

    def step(self, kept: list[float] | None, seconds) -> tuple:
        kept = [*(kept or ())[-(self.window - 1) :], float(seconds)]
        return kept, self.default if len(kept) < 3 else p90(np.asarray(kept))

    def rows(self, keys: list[list], frame: pd.DataFrame, results: list) -> pd.DataFrame:
        return pd.DataFrame({"key": keys[0], "id": frame["id"].to_numpy(), "p90": results})

    def end(self, key, timers) -> None:
        self.samples.put([(x,) for x in self.now])


class Many(InOrder):
    """The steps of `one` for every key of a group; rows hold the columns `keys`.

    State: the states of the group's keys as one value. The watermark ends them as `one` says; a group without new rows is
    cleared by a timer on its last end.
    """

    def __init__(self, one: InOrder, keys: tuple[str, ...]) -> None:
        self.one, self.keys = one, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "states binary, due bigint")

    def begin(self, key) -> None:
        body, self.due = self.kept.get() if self.kept.exists() else (None, None)
        self.states: dict[tuple, object] = {} if body is None else pickle.loads(body)

    def take(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        keys, states, step, results = [column(frame, k) for k in self.keys], self.states, self.one.step, []
        for own, value in zip(zip(*keys, strict=True), frame[self.one.reads].tolist(), strict=True):
            states[own], result = step(states.get(own), value)
            results.append(result)
        return self.one.rows(keys, frame, results)

    def end(self, key, timers) -> None:
        self.keep(timers.getCurrentWatermarkInMs())

    def keep(self, watermark_ms: int) -> None:
        ends = {own: at for own, state in self.states.items() if (at := self.one.ends_ms(state)) is not None}
        for own in [own for own, at in ends.items() if at <= watermark_ms]:
            del self.states[own], ends[own]
        due = max(ends.values(), default=None)
        if due != self.due:
            if self.due is not None and self.due > watermark_ms:
                self.handle.deleteTimer(self.due)
            if due is not None:
                self.handle.registerTimer(due)
        if self.states:
            self.kept.update((pickle.dumps(self.states, pickle.HIGHEST_PROTOCOL), due))
        else:
            self.kept.clear()

    def expire(self, key, at_ms: int) -> None:
        self.begin(key)
        self.due = None
        self.keep(at_ms)


class Trailing(InOrder):
    """n: rows of the key in the `hours` up to each row, itself included, exactly, whatever the time.

    With `by`, a column of the rows, a group holds many keys. State: a ring of time buckets, each with the times in it and
    their keys. A bucket goes once its last time can no longer fall into the window of a row that still counts; a timer
    on the oldest bucket sees to that.
    """

    def __init__(self, hours: int, bucket_minutes: int = 60, by: str | None = None) -> None:
        self.span, self.width, self.by = hours * 3_600_000_000, bucket_minutes * 60_000_000, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getMapState("ring", "bucket bigint", "times array<bigint>, owners array<string>")
        self.timer = handle.getValueState("timer", "ms bigint")

    def begin(self, key) -> None:
        self.times: dict[int, tuple[list, list]] = {row[0][0]: (list(row[1][0]), list(row[1][1])) for row in self.ring.iterator()}
        self.changed: set[int] = set()
        self.held: dict[str | None, list[int]] = {}
        for times, owners in self.times.values():
            for at, own in zip(times, owners, strict=True):
                self.held.setdefault(own, []).append(at)
        for held in self.held.values():
            held.sort()

    def take(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        counts, keys = [], column(frame, self.by) if self.by else [key[0]] * len(frame)
        for own, at in zip(keys, frame["us"].tolist(), strict=True):
            bucket = at if at == NO_TIME else at // self.width
            times, owners = self.times.setdefault(bucket, ([], []))
            times.append(at)
            owners.append(own)
            self.changed.add(bucket)
            held = self.held.setdefault(own, [])
            here = bisect_right(held, at)
            held.insert(here, at)
            counts.append(here + 1 - (bisect_right(held, at - self.span) if at != NO_TIME else 0))
        return pd.DataFrame({"session_key": keys, "id": frame["id"].to_numpy(), "n": np.asarray(counts, np.int64)})

    def end(self, key, timers) -> None:
        for bucket in self.changed:
            self.ring.updateValue((bucket,), self.times[bucket])
        self.drop(timers.getCurrentWatermarkInMs())

    def drop(self, watermark_ms: int) -> None:
        known = [b for b in self.times if b != NO_TIME]
        gone = [b for b in known if ((b + 1) * self.width + self.span) // 1000 < watermark_ms]
        for bucket in gone:
            self.ring.removeKey((bucket,))
        rest = sorted(set(known) - set(gone))
        due = ((rest[0] + 1) * self.width + self.span) // 1000 + 1 if rest else None
        old = self.timer.get()[0] if self.timer.exists() else None
        if due != old:
            if old is not None and old > watermark_ms:
                self.handle.deleteTimer(old)
            if due is None:
                self.timer.clear()
            else:
                self.timer.update((due,))
                self.handle.registerTimer(due)

    def expire(self, key, at_ms: int) -> None:
        self.begin(key)
        self.timer.clear()
        self.drop(at_ms)


def run_processor(rows: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, schema: str) -> DataFrame:
    """`processor` over the rows of each group of keys; event times drive its timers.

    Keys are texts on the way: a frame would make fractions of whole numbers among which some are missing.
    """
    with_rocksdb(rows.sparkSession)
    kinds = {k: rows.schema[k].dataType for k in keys}
    grouped = rows.withColumns({k: F.col(k).cast("string") for k in keys}).withColumn("grp", F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int"))
    out = grouped.groupBy("grp").transformWithStateInPandas(processor, schema, "append", "EventTime")
    return out.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})
