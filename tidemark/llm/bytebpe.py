"""Byte-level byte-pair encoding as a monoid: halves are encoded apart and joined at their boundary.

What makes this exact: a token sequence is the encoding of its bytes if, and only if, every two
neighbours are the encoding of their own bytes. (Up to the first merge across a boundary, two
neighbouring tokens are merged inside in the same order whether their surroundings are there or not,
because each step takes the lowest rank, the leftmost on ties. So that first merge would also happen
to the two alone.) Two encodings are therefore joined by looking at the boundary only: if the tokens
that meet there fit, nothing changes; else a window around the boundary is encoded anew and grows to
the side on which its outer token does not fit its neighbour. Tokens outside the window are then final.

Decoding is the same tree: the bytes of both halves are put together.

A null or empty text has no tokens. Matches of the splitting pattern never touch each other's tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import pieces

#: Bytes of a leaf of the tree; tokens that are decoded at once.
LEAF, DECODED = 8, 1024
#: Length and number of the strings and token pairs that a task remembers; only speed depends on them.
CACHE_BYTES, CACHE_SIZE = 32, 300_000
#: Characters from which on a text's matches are taken bit by bit, and how many at a time.
LONG_TEXT, MATCHES = 1_000_000, 100_000


class Memo(dict):
    """Results of `make`, forgotten all together when there are too many."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, bytes | str) or len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one table of ranks (bytes -> rank, which is also the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: raw for raw, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.leaves = Memo(self._merged)
        self.fits = Memo(self._fits)
        self.words = Memo(self._word)

    def _merged(self, raw: bytes) -> tuple[int, ...]:
        """Tokens of a short string or window: the lowest rank first, the leftmost on ties."""
        ends, before = [*range(1, len(raw) + 1)], [*range(-1, len(raw) - 1)]  # of the symbol that starts at a byte
        rank_of = self.ranks.get
        queue = [(r, i, i + 2) for i in range(len(raw) - 1) if (r := rank_of(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, at, end = heapq.heappop(queue)
            nxt = ends[at]
            if nxt <= at or nxt >= len(raw) or ends[nxt] != end:
                continue  # one of the two was merged meanwhile
            ends[at], ends[nxt] = end, -1
            if end < len(raw):
                before[end] = at
                if (r := rank_of(raw[at : ends[end]])) is not None:
                    heapq.heappush(queue, (r, at, ends[end]))
            if (left := before[at]) >= 0 and (r := rank_of(raw[left:end])) is not None:
                heapq.heappush(queue, (r, left, end))
        out, at = [], 0
        while at < len(raw):
            out.append(self.ranks[raw[at : ends[at]]])
            at = ends[at]
        return tuple(out)

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self.leaves[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]] == pair

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two strings together, from their encodings."""
        if not left or not right or self.fits[left[-1], right[0]]:
            return left + right
        a = b = 1  # tokens of the window on each side
        while True:
            window = self.leaves[b"".join([self.bytes_of[i] for i in left[-a:] + right[:b]])]
            grow_left = a < len(left) and window[0] != left[-a] and not self.fits[left[-a - 1], window[0]]
            grow_right = b < len(right) and window[-1] != right[b - 1] and not self.fits[window[-1], right[b]]
            if not grow_left and not grow_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = min(len(left), a * (1 + grow_left)), min(len(right), b * (1 + grow_right))

    def tree(self, raw: bytes) -> tuple[int, ...]:
        if len(raw) <= LEAF:
            return self.leaves[raw]
        half = 1 << (len(raw) - 1).bit_length() - 1  # runs of one letter are cut where their tokens end
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def encode_match(self, raw: bytes) -> tuple[int, ...]:
        """One match of the pattern; one that is a token as a whole is that token, however merges would build it."""
        whole = self.ranks.get(raw)
        return self.tree(raw) if whole is None else (whole,)

    def _word(self, word: str) -> bytes:
        return array("I", self.encode_match(word.encode())).tobytes()

    def encoded(self, text: str) -> Iterator[bytes]:
        """The ids of the text as little-endian 32-bit numbers, in parts of bounded size for long texts."""
        if len(text) < LONG_TEXT:
            yield b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, MATCHES)):
            yield b"".join(map(self.words.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.encoded(text) for i in array("I", part)]

    def decode(self, ids) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> bytes:
    """The rank file (base64 of the bytes, a blank, the rank) as it is."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(body: bytes) -> dict[bytes, int]:
    return {base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, body.splitlines()) if rank}


def encode_texts(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every text: one output row for each input row, whatever its id.

    Output: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes) and, with `with_ids`, ids (array) and decoded (binary).
    `ranks` is a file on the driver; it reaches the executors once each.
    """
    body = df.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(parse_ranks(body.value), pattern)
        for batch in batches:
            for piece in pieces(batch):
                rows: dict[str, list] = {"n": [], "ids_sha": [], "decoded_sha": [], "ids": [], "decoded": []}
                for text in piece.column("text").to_pylist():
                    n, ids_sha, decoded_sha, ids, decoded = 0, hashlib.sha256(), hashlib.sha256(), array("I"), []
                    for part in bpe.encoded(text or ""):
                        some = array("I", part)
                        back = bpe.decode(some)
                        n += len(some)
                        ids_sha.update(part)
                        decoded_sha.update(back)
                        if with_ids:
                            ids.extend(some)
                            decoded.append(back)
                    for name, value in zip(rows, (n, ids_sha.hexdigest(), decoded_sha.hexdigest(), ids, b"".join(decoded)), strict=True):
                        rows[name].append(value)
                columns = [piece.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["ids_sha"], pa.string()), pa.array(rows["decoded_sha"], pa.string())]
                if with_ids:
                    columns += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return source.mapInArrow(run, schema)
