"""Repeated strings of 200 bytes, found by merging Burrows-Wheeler transforms of shards.

Every 200-byte window is filed under the smallest hash of the 64-byte grams in it, which depends on
its bytes alone: equal windows are filed alike, and neighbouring windows mostly share a file, so runs
of windows ("segments") are what moves. Segments that occur twice are repeated whole. Where a file
has several different segments, their texts are compared: shards of segments have their suffixes
sorted and are merged pair by pair. A merge never sorts the suffixes of a shard again: it starts with
the interleaving by eight bytes and refines it, each round by the block of the suffix further on,
where a block has suffixes of both shards, until those in one block share 200 bytes. The round that
cut two neighbours apart bounds their common prefix; such blocks are the repeated intervals.

Files with very many different segments (edges of a passage in countless documents) are counted by
the hash of each window instead, which any number of tasks can share.

Texts under 200 bytes have nothing to remove; null counts as empty. Matches never cross documents;
overlapping ones count, so a text that repeats itself is covered as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import bloom
from tidemark.llm.batches import pieces, signed, span_hashes, text_bytes
from tidemark.llm.store import keep

LENGTH, GRAM = 200, 64
#: Windows in one segment at most; segments of a file beyond which windows are counted by hash.
MOST_WINDOWS, MOST_SEGMENTS = 4096, 512
#: Bytes of segments that one task merges, and in one shard.
BIN_BYTES, SHARD_BYTES = 1_000_000, 520_000
STEP = 8


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every `width` values in a row, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[:-rest], out[rest:]) if rest else out


@dataclass
class Segments:
    text: np.ndarray
    start: np.ndarray  # in the text
    windows: np.ndarray
    key: np.ndarray
    content: np.ndarray
    again: np.ndarray  # the gram of the key occurs twice in the text


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Segments:
    n, wide = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool))
    at = np.arange(n - gram + 1)
    h = span_hashes(data, at, at + gram)
    least = slide(h, wide, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= ends)
    first = np.ones(len(window), bool)
    first[1:] = (window[1:] != window[:-1] + 1) | (least[window[1:]] != least[window[:-1]])
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(window)))
    parts = -(-size // MOST_WINDOWS)
    of = np.repeat(np.arange(len(heads)), parts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = window[heads[of]] + inner * MOST_WINDOWS if len(heads) else heads
    windows = np.minimum(MOST_WINDOWS, size[of] - inner * MOST_WINDOWS)
    key = least[start]
    # positions of grams that are smallest in some window
    around = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
    chosen = np.flatnonzero(slide(around, wide, np.maximum)[: len(h)] == h)
    text_of = lambda x: np.searchsorted(offsets, x, side="right") - 1
    order = np.argsort(h[chosen], kind="stable")
    chosen = chosen[order]
    twin = (h[chosen[1:]] == h[chosen[:-1]]) & (text_of(chosen[1:]) == text_of(chosen[:-1])) if len(chosen) > 1 else np.zeros(0, bool)
    again = np.isin(key, np.unique(h[chosen[1:][twin]]))
    text = text_of(start)
    return Segments(text, start - offsets[text], windows, key, span_hashes(data, start, start + windows + length - 1), again)


# ---------------------------------------------------------------- shards in one task


class Shard:
    """Sorted suffixes of some segments, and which windows occur twice among them."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, order: np.ndarray | None = None, hit: np.ndarray | None = None) -> None:
        """text: segments in a row; ends: the end of its segment for every position."""
        self.text, self.ends, self.order, self.hit = text, ends, order, hit

    def grams(self) -> np.ndarray:
        """The next STEP bytes at every position as a number; 0 where the segment ends before."""
        padded = np.concatenate([self.text, np.zeros(STEP, np.uint8)])
        gram = np.zeros(len(self.text), np.uint64)
        for k in range(STEP):
            gram = gram << np.uint64(8) | padded[k : k + len(self.text)].astype(np.uint64)
        return np.where(np.arange(len(self.text)) + STEP <= self.ends, gram, np.uint64(0))

    @property
    def transform(self) -> np.ndarray:
        """The Burrows-Wheeler transform: the byte before every suffix, in sorted order (0 before the first)."""
        return np.where(self.order > 0, self.text[self.order - 1], 0)


def _hops(length: int) -> list[int]:
    """Distances that take blocks of STEP bytes to blocks of `length` bytes."""
    out, depth = [], STEP
    while depth < length:
        out.append(min(depth, length - depth))
        depth += out[-1]
    return out


def _starts(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of every run of equal values, place of its first for every value); `places` are their places in the order."""
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(head)
    return first, np.repeat(places[first], np.diff(np.append(first, len(values))))


def _refine(order: np.ndarray, block: np.ndarray, active: np.ndarray, ends: np.ndarray, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort `active` places of `order` inside their blocks by the block `hop` bytes on: (firsts of the new blocks, old blocks).

    A block is known by the place of its first suffix; a suffix beyond the end of its segment comes first.
    """
    at = order[active]
    further = at + hop
    inside = further < ends[at]
    ahead = np.zeros(len(at), np.int64)
    ahead[inside] = block[further[inside]] + 1
    old = block[at]
    key = old * (len(block) + 2) + ahead
    sort = np.argsort(key, kind="stable")
    order[active] = at[sort]
    first, place = _starts(key[sort], active)
    block[order[active]] = place
    return first, old


def sort_shard(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Shard:
    """Sort all suffixes of a shard by `length` bytes; blocks of one suffix are settled and left alone."""
    shard = Shard(text, ends)
    gram = shard.grams()
    order = np.argsort(gram, kind="stable")
    block = np.empty(len(text), np.int64)
    first, place = _starts(gram[order], np.arange(len(text)))
    block[order] = place
    active = np.arange(len(text))
    for hop in _hops(length):
        active = active[np.repeat(np.diff(np.append(first, len(active))) > 1, np.diff(np.append(first, len(active))))]
        if not len(active):
            first = active
            break
        first, _ = _refine(order, block, active, ends, hop)
    shard.order = order
    shard.hit = np.zeros(len(text), bool)
    _mark(shard.hit, order[active], first, ends, length)
    return shard


def _mark(hit: np.ndarray, at: np.ndarray, first: np.ndarray, ends: np.ndarray, length: int) -> None:
    """Mark the whole windows among `at` whose block (from each of `first` on) has two of them."""
    if not len(at):
        return
    whole = at + length <= ends[at]
    many = np.repeat(np.add.reduceat(whole.astype(np.int64), first) > 1, np.diff(np.append(first, len(at))))
    hit[at[whole & many]] = True


def merge(a: Shard, b: Shard, length: int = LENGTH) -> tuple[Shard, np.ndarray]:
    """(merged shard, common prefix of each suffix with the one before where the merge told them apart, else -1).

    Only blocks with suffixes of both shards are refined: inside one shard the order and the repeated
    windows are known. Common prefixes are rounded down to the depth of a round; `length` means equal.
    """
    cut, n = len(a.text), len(a.text) + len(b.text)
    ends = np.concatenate([a.ends, b.ends + cut])
    gram = np.concatenate([a.grams(), b.grams()])
    left, right = a.order, b.order + cut
    spot = np.empty(n, np.int64)  # first interleaving, by STEP bytes
    spot[: len(left)] = np.arange(len(left)) + np.searchsorted(gram[right], gram[left], side="left")
    spot[len(left) :] = np.arange(len(right)) + np.searchsorted(gram[left], gram[right], side="right")
    order = np.empty(n, np.int64)
    order[spot] = np.concatenate([left, right])
    block = np.empty(n, np.int64)
    first, place = _starts(gram[order], np.arange(n))
    block[order] = place
    common = np.full(n, -1)
    common[first] = 0
    active, depth = np.arange(n), STEP
    for hop in [*_hops(length), 0]:
        size = np.diff(np.append(first, len(active)))
        of_b = np.add.reduceat((order[active] >= cut).astype(np.int64), first) if len(active) else size
        mixed = np.repeat((of_b > 0) & (of_b < size), size)
        active = active[mixed]
        if not len(active):
            first = active
            break
        if hop:
            first, old = _refine(order, block, active, ends, hop)
            fresh = np.setdiff1d(first, _starts(old, active)[0], assume_unique=True)
            common[active[fresh]] = depth
            depth += hop
        else:
            first = _starts(block[order[active]], active)[0]
    hit = np.concatenate([a.hit, b.hit])
    _mark(hit, order[active], first, ends, length)
    inner = np.ones(len(active), bool)
    inner[first] = False
    common[active[inner]] = length
    return Shard(np.concatenate([a.text, b.text]), ends, order, hit), common


def repeated_windows(texts: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For every segment, which of its windows occur elsewhere among all segments or in itself."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.repeat(bounds[1:], sizes)
    edges = [0]
    while edges[-1] < len(texts):
        reach = int(np.searchsorted(bounds, bounds[edges[-1]] + shard_bytes, side="right")) - 1
        edges.append(min(len(texts), max(edges[-1] + 1, reach)))
    shards = [sort_shard(data[bounds[i] : bounds[j]], ends[bounds[i] : bounds[j]] - bounds[i], length) for i, j in zip(edges[:-1], edges[1:])]
    while len(shards) > 1:
        shards = [merge(*shards[i : i + 2], length)[0] if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    return [shards[0].hit[bounds[i] : max(bounds[i], bounds[i + 1] - length + 1)] for i in range(len(texts))]


# ---------------------------------------------------------------- jobs

_ROW = "key bigint, content bigint, n bigint, doc_id {kind}, start bigint, windows int, again boolean"


def _scan(docs: DataFrame, kind: str, merge_equal: bool) -> DataFrame:
    """Segments of all texts; with `merge_equal`, equal ones of a batch are one row with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = segments(*text_bytes(piece.column("text")))
                take, n = np.arange(len(s.key)), np.ones(len(s.key), np.int64)
                if merge_equal and len(take):
                    pair = s.key ^ (s.content << np.uint64(1))
                    _, take, n = np.unique(pair, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.key[take])), pa.array(signed(s.content[take])), pa.array(n.astype(np.int64)), piece.column("doc_id").take(pa.array(s.text[take])), pa.array(s.start[take]), pa.array(s.windows[take].astype(np.int32)), pa.array(s.again[take])], names=["key", "content", "n", "doc_id", "start", "windows", "again"])

    return docs.mapInArrow(run, _ROW.format(kind=kind))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _merge_bins(cut: DataFrame, kind: str) -> DataFrame:
    """Repeated windows of segments whose files have few segments: doc_id, start, windows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        group = group.sort_values("key", kind="stable")  # segments of one file stand in few shards
        for doc, start, hit in zip(group["doc_id"], group["start"], repeated_windows(group["body"].tolist())):
            rows += [(doc, start + a, n) for a, n in zip(*(x.tolist() for x in _runs(hit)))]
        return pd.DataFrame(rows, columns=["doc_id", "start", "windows"]).astype({"start": "int64", "windows": "int32"})

    size = cut.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    bins = max(1, -(-size // BIN_BYTES))
    return cut.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).select("bin", "key", "doc_id", "start", "body").groupBy("bin").applyInPandas(run, f"doc_id {kind}, start bigint, windows int")


def repeated_intervals(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, start, windows: runs of windows (by first byte) that occur elsewhere."""
    found = _scan(docs, kind, True).repartition("key").groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "start", "windows")).alias("at"), F.max("again").alias("again"))
    found = found.withColumn("different", F.count(F.lit(1)).over(Window.partitionBy("key")))
    found = keep(found.filter("n > 1 OR different > 1 OR again").select("key", "content", "n", "at.doc_id", "at.start", "at.windows", "again", "different"), "segments")
    # segments that occur as they are in several places
    twice = found.filter("n > 1").select("key", "content", F.xxhash64("key", "content").alias("pair"))
    everywhere = bloom.ask(_scan(docs, kind, False).withColumn("pair", F.xxhash64("key", "content")), "pair", twice, "pair").filter("maybe")
    whole = everywhere.select("key", "content", "doc_id", "start", "windows").join(twice.select("key", "content"), ["key", "content"], "left_semi").select("doc_id", "start", "windows")
    # the others: fetch their texts, each document once
    unclear = found.filter("different > 1 OR again")
    wanted = unclear.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "windows", (F.col("different") > MOST_SEGMENTS).alias("hot"))).alias("cuts"))
    texts = bloom.ask(docs, "doc_id", wanted, "doc_id").filter("maybe").select("doc_id", "text").join(wanted, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                at, rows = [], []
                for i, (text, cuts) in enumerate(zip(piece.column("text").to_pylist(), piece.column("cuts").to_pylist(), strict=True)):
                    raw = (text or "").encode()
                    for c in cuts:
                        at.append(i)
                        rows.append((c["key"], c["start"], raw[c["start"] : c["start"] + c["windows"] + LENGTH - 1], c["hot"]))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "key", "start", "body", "hot"])

    bodies = keep(texts.mapInArrow(cut, f"doc_id {kind}, key bigint, start bigint, body binary, hot boolean"), "bodies")
    few = _merge_bins(bodies.filter("NOT hot"), kind)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "body", 500_000):
                raw = piece.column("body").to_pylist()
                sizes = np.array([len(b) for b in raw], np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                count = np.maximum(sizes - LENGTH + 1, 0)
                owner = np.repeat(np.arange(len(raw)), count)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = (np.cumsum(sizes) - sizes)[owner] + inner
                index = pa.array(owner)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(index), piece.column("key").take(index), pa.array(signed(span_hashes(data, first, first + LENGTH))), pa.array(np.asarray(piece.column("start"))[owner] + inner)], names=["doc_id", "key", "window", "start"])

    many = bodies.filter("hot").select("doc_id", "key", "start", "body").mapInArrow(windows, f"doc_id {kind}, key bigint, window bigint, start bigint")
    common = many.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "window")
    many = many.join(common, ["key", "window"], "left_semi").select("doc_id", "start", F.lit(1).alias("windows"))
    return whole.unionByName(few).unionByName(many)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Take every byte out that a repeated 200-byte string covers.

    Output: the id, n_bytes, n_removed, n_spans, kept_sha256 and, with `with_text`, kept (bytes).
    Every row is a document of its own, also when ids repeat or are null: rows get a number, written once.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = keep(df.select(F.monotonically_increasing_id().alias("doc_id"), F.col(id_col).alias("own"), F.col(text_col).alias("text")), "rows")
    found = repeated_intervals(docs, "bigint")
    marks = keep(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("marks")), "marks")
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for text, spans in zip(piece.column("text").to_pylist(), piece.column("marks").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    edge = np.zeros(len(raw) + 1, np.int64)
                    for s in spans or ():
                        edge[s["start"]] += 1
                        edge[s["start"] + s["windows"] + LENGTH - 1] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                    rows.append((len(raw), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_text])
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = zip(*rows, strict=True) if rows else [[]] * (4 + with_text)
                yield pa.RecordBatch.from_arrays([piece.column("own"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    asked = bloom.ask(docs, "doc_id", marks, "doc_id")
    clean = asked.filter("NOT maybe").select("own", "text", F.lit(None).cast("array<struct<start: bigint, windows: int>>").alias("marks"))
    marked = asked.filter("maybe").join(marks, "doc_id", "left").select("own", "text", "marks")
    return clean.unionByName(marked).mapInArrow(run, schema)
