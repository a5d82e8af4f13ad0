"""Text columns as byte arrays: words, hashes and bounded pieces of Arrow batches, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text one numpy pass holds at a time; a longer single text is still taken whole.
PIECE_BYTES = 1_000_000
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose texts have at most `limit` bytes together (or a single row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts in a row, offsets of every text and the end); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), PIECE_BYTES + 2)
        for name, factor in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span data[start:end], from one prefix sum over the bytes."""
    powers, inverses = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch of texts: maximal runs of bytes that are not white space, A-Z lowered."""

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        data, self.offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        solid = ~IS_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]  # texts may touch
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of text i: bounds[i]:bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The number of the text of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def strings(self, index: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[index].tolist(), self.ends[index].tolist())]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): runs of `size` words per text, in order; a shorter text with words is one shingle."""
    h, counts = words.hashes(), words.counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per_text) + np.repeat(words.bounds[:-1], per_text)
    taken = np.repeat(np.minimum(counts, size), per_text)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = taken > k
        if not more.any():
            break
        word = h[np.minimum(at + k, len(h) - 1)]
        out = np.where(more, mix(out * np.uint64(0xA0761D6478BD642F) + word), out)
    return out, bounds


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs Spark has."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def carrying(df: DataFrame, columns: tuple[str, ...]) -> tuple[list[Column], str]:
    """Columns that pass an operator unchanged: under names c0, c1, ... on the way in, and their schema on the way out."""
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    return named, "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
