"""Byte-pair encoding and decoding with a public vocabulary file.

Every word is a doubly linked list of symbols. A priority queue holds (merge rank, position) of all
neighbouring pairs; the lowest is taken, entries whose symbols have changed since are stale and
skipped, and the two new neighbour pairs are pushed. A word of n symbols takes O(n log n), so one
word of a megabyte is no problem. Decoding joins vocabulary strings.

Empty and null texts have no tokens; a text that holds a special token's string gives its id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import pieces

# What the vocabulary file says about splitting, and the printable form of bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHOWN_AS_THEMSELVES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Longest word and number of words that are remembered per task; only speed depends on them.
CACHE_CHARS, CACHE_WORDS = 40, 200_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it; bytes without a printable form take those from 256 on."""
    plain = {b for span in SHOWN_AS_THEMSELVES for b in span}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordBpe:
    """Encoder and decoder of one vocabulary whose words end in a suffix."""

    def __init__(self, text: str, cache_words: int = CACHE_WORDS) -> None:
        spec = json.loads(text)
        self.cache_words = cache_words
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.letters = byte_alphabet()
        self.inner = {b: self.ids[c] for b, c in self.letters.items()}
        self.final = {b: self.ids[c + self.suffix] for b, c in self.letters.items()}
        self.word = regex.compile(SPLIT)
        self.control = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Token ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        # the suffix belongs to the last character; a character of several bytes carries it on its last byte
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        queue: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            nxt = after[at]
            if nxt >= 0 and (found := self.merges.get((ids[at], ids[nxt]))):
                heapq.heappush(queue, (found[0], at, ids[at], ids[nxt]))

        for at in range(len(ids) - 1):
            offer(at)
        while queue:
            _, at, left, right = heapq.heappop(queue)
            nxt = after[at]
            if ids[at] != left or nxt < 0 or ids[nxt] != right:
                continue  # stale: one of the two was merged meanwhile
            ids[at], ids[nxt] = self.merges[left, right][1], -1
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [i for i in ids if i >= 0]

    def _entry(self, word: str) -> tuple[int, str, str]:
        ids = self.merge(word)
        entry = len(ids), " ".join(map(str, ids)), " ".join(self.strings[i] for i in ids)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= self.cache_words:
                self.cache.clear()
            self.cache[word] = entry
        return entry

    def entries(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids, strings) of every word and special token."""
        for part in self.control.split(text) if self.control else [text]:
            if part in self.special:
                yield 1, str(self.special[part]), part
            elif part:
                # letters are lowered one by one, so a final sigma has no form of its own
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                known = self.cache.get
                for word in self.word.findall(part):
                    yield known(word) or self._entry(word)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of `ids`, a blank between two: this file names no decoder of its own."""
        return " ".join(self.strings[i] for i in ids)


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encode and decode every text; a task remembers the ids of at most `cache_words` words.

    Output: the id, n_tokens, ids_sha256, decoded_sha256 and, with `with_ids`, ids (array) and decoded.
    `vocabulary` is a file on the driver; it reaches the executors once each.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value, cache_words)
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for piece in pieces(batch):
                rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for text in piece.column("text").to_pylist():
                    entries = list(bpe.entries(text or ""))
                    ids, decoded = " ".join([e[1] for e in entries]), " ".join([e[2] for e in entries])
                    rows["n_tokens"].append(sum([e[0] for e in entries]))
                    rows["ids_sha256"].append(sha(ids))
                    rows["decoded_sha256"].append(sha(decoded))
                    if with_ids:
                        rows["ids"].append([int(i) for i in ids.split()])
                        rows["decoded"].append(decoded)
                columns = [piece.column("doc_id"), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
                if with_ids:
                    columns += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return source.mapInArrow(run, schema)

