"""Benchmark passages in documents: SimHash windows, multi-index Hamming search, exact verification.

A window has as many words as the item it is compared with. Windows that share no shingle with any
item have similarity 0, so only windows that cover a shared shingle are fingerprinted (an exact
filter). The 64-bit SimHash of a window's weighted shingles is looked up in four tables, one for each
16-bit block; a table lists the items within INNER bits of every block value. By the pigeonhole
principle every item within RADIUS bits is found. What remains after the full distance is verified:
the sum of smaller shingle counts over the sum of larger ones must reach the threshold.

An item shorter than a shingle is one shingle of all its words. Empty and null items and texts match
nothing. A document shorter than an item is one window. Items go to the executors in chunks of fixed
size, one scan of the documents for each chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.batches import Words, mix, pieces, shingles

SHINGLE, THRESHOLD = 5, 0.8
#: Hamming radius; 0.8 similar bags differ in about 10 of 64 bits, with a deviation below 3.
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
INNER = RADIUS // BLOCKS
#: Items and bytes of items that one scan of the documents carries.
CHUNK_ITEMS, CHUNK_BYTES = 1000, 4_000_000

_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def simhash(weights: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of +1/-1 per bit: rows x 64 -> rows."""
    return np.packbits(weights > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def bit_signs(h: np.ndarray) -> np.ndarray:
    """shingles x 64 of +1 / -1."""
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_ONES[(x >> np.uint64(16 * k)).astype(np.uint64) & np.uint64(0xFFFF)].astype(np.int64) for k in range(4))


@dataclass
class Items:
    """Benchmark items of one shingle size, with their Hamming tables."""

    size: int
    ids: np.ndarray
    words: np.ndarray
    bags: list[Counter]
    known: np.ndarray  # distinct shingles, sorted
    owner_at: np.ndarray  # items of every known shingle, as bounds into owners
    owners: np.ndarray
    prints: np.ndarray
    table_at: np.ndarray  # blocks x (values + 1)
    table: list[np.ndarray]


def index_items(ids: list, texts: list[str | None], size: int = SHINGLE) -> list[Items]:
    """Indexes, one for each shingle size that the items need."""
    column = pa.array([t or "" for t in texts], pa.string())
    counts = Words(column).counts
    out = []
    for s in range(1, size + 1):
        at = np.flatnonzero((counts == s) if s < size else (counts >= size))
        if not len(at):
            continue
        h, bounds = shingles(Words(column.take(pa.array(at))), s)
        owner = np.repeat(np.arange(len(at)), np.diff(bounds))
        pair = np.unique(np.stack([h, owner.astype(np.uint64)]), axis=1)
        known, first = np.unique(pair[0], return_index=True)
        signs = bit_signs(h)
        prints = simhash(np.add.reduceat(signs, bounds[:-1], axis=0))
        masks = np.flatnonzero(_ONES <= INNER)
        table_at, table = np.zeros((BLOCKS, (1 << BLOCK_BITS) + 1), np.int64), []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & 0xFFFF
            near = (value[:, None] ^ masks[None]).ravel()
            order = np.argsort(near, kind="stable")
            table.append(np.repeat(np.arange(len(at)), len(masks))[order].astype(np.int32))
            table_at[b] = np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1))
        bags = [Counter(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        out.append(Items(s, np.array(ids, object)[at], counts[at], bags, known, np.append(first, pair.shape[1]), pair[1].astype(np.int64), prints, table_at, table))
    return out


def similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of all values lo[i] .. hi[i] - 1."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def search_text(h: np.ndarray, n_words: int, items: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item number, similarity, first word, words) of the best window per item; h: all shingles of a text in order."""
    at = np.searchsorted(items.known, h)
    at[at == len(items.known)] = 0
    hits = np.flatnonzero(items.known[at] == h)
    if not len(hits):
        return []
    row, place = _expand(items.owner_at[at[hits]], items.owner_at[at[hits] + 1])
    size = np.minimum(items.words[items.owners[place]], n_words)
    pos = hits[row]
    pairs = np.unique(np.stack([size, pos]), axis=1)
    size, pos = pairs
    row, start = _expand(np.maximum(pos - size + items.size, 0), np.minimum(pos, n_words - size) + 1)
    size, start = np.unique(np.stack([size[row], start]), axis=1)
    span = size - items.size + 1
    best: dict[int, tuple[float, int, int]] = {}
    lo, hi = int(start.min()), int((start + span).max())
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bit_signs(h[lo:hi]), axis=0, dtype=np.int32)])
    for part in range(0, len(start), 20_000):
        s, w, n = start[part : part + 20_000], size[part : part + 20_000], span[part : part + 20_000]
        prints = simhash(sums[s - lo + n] - sums[s - lo])
        found = []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & 0xFFFF
            window, slot = _expand(items.table_at[b][value], items.table_at[b][value + 1])
            item = items.table[b][slot].astype(np.int64)
            fits = np.minimum(items.words[item], n_words) == w[window]  # item-sized windows
            found.append(np.stack([window[fits], item[fits]]))
        window, item = np.unique(np.concatenate(found, axis=1), axis=1)
        close = distance(prints[window], items.prints[item]) <= RADIUS
        for i, j in zip(window[close].tolist(), item[close].tolist()):
            value = similarity(Counter(h[s[i] : s[i] + n[i]].tolist()), items.bags[j])
            # the threshold holds on whole numbers of shingles, whatever the last bit of a quotient
            if value >= threshold - 1e-12 and (j not in best or (-value, s[i]) < (-best[j][0], best[j][1])):
                best[j] = (value, int(s[i]), int(w[i]))
    return [(j, *b) for j, b in sorted(best.items())]


def _chunks(items: DataFrame) -> Iterator[DataFrame]:
    """Items in chunks of bounded number and size, cut by a running sum over id-ordered blocks of the table."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // (CHUNK_ITEMS // 2)), -(-size // (CHUNK_BYTES // 2)))
    for part in range(parts if n else 0):
        yield items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Best window of every document and item that are similar enough.

    Output: the ids of document and item, similarity, first_word, n_words (of the window).
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, similarity double, first_word bigint, n_words bigint"
    spark, source = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    out = spark.createDataFrame([], schema)
    for chunk in _chunks(named):
        rows = chunk.orderBy("item_id").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(index_items([r.item_id for r in rows], [r.text for r in rows], size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = []
            for items_ in sent.value:
                marks = np.zeros(1 << 22, bool)
                marks[(items_.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                filters.append(marks)
            for batch in batches:
                for piece in pieces(batch):
                    words, found = Words(piece.column("text")), []
                    for items_, marks in zip(sent.value, filters, strict=True):
                        h, bounds = shingles(words, items_.size)
                        maybe = np.flatnonzero(marks[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                        for i in np.unique(np.searchsorted(bounds, maybe, side="right") - 1).tolist():
                            if words.counts[i] >= items_.size:
                                found += [(i, items_.ids[j], *rest) for j, *rest in search_text(h[bounds[i] : bounds[i + 1]], int(words.counts[i]), items_, threshold)]
                    columns = list(zip(*found, strict=True)) if found else [[]] * 5
                    ids = piece.column("id").take(pa.array(columns[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], item_type), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=[id_col, item_col, "similarity", "first_word", "n_words"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out
