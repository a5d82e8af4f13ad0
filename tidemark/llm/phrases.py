"""Phrases of two to four words that occur together more often than apart.

Counting goes by length, shortest first. A phrase can only be frequent if the two phrases that lack its
last and its first word are, so each scan counts just those occurrences whose two parts passed the
scan before. What passed travels as a bit filter of bounded size: false hits cost a few more rows to
count, nothing is lost, and all counts are exact (words and phrases are compared as strings; hashes only
ask the filter). Counts are summed in each piece of a batch, in each task, and then by phrase.

The count streams of neighbouring lengths are then merge-joined in step: in prefix order (a phrase follows
the phrase without its last word) for left counts and extensions to the right, in suffix order (without
its first word) for right counts and extensions to the left. No hash table is built. A phrase carries
the counts of all its beginnings and ends on to the next length. Whatever longer phrase holds nearly all
occurrences of a phrase, one that is longer by one word does as well, so those two orders suffice.

Null text counts as empty, null language as `und`; ids play no part, repeated rows count as often as
they occur. A text of any length is cut between pieces, which phrases do not cross.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import mix, pieces, signed, span_hashes
from tidemark.llm.store import keep
from tidemark.llm.tokens import Tokens, byte_set

BLANKS, SIGNS = byte_set(0x20, 0x09), byte_set(*b".,;:!?", *range(0x0A, 0x0E))
_SIGN = re.compile("[.,;:!?\n-\r]")
LONGEST = 4
#: Bytes of text counted at once; most bits of a filter and bits for each phrase in it; rows of an output batch.
PIECE, FILTER_BITS, BITS_PER_PHRASE, ROWS = 5_000_000, 1 << 27, 16, 50_000


def long_texts_cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE bytes; longer texts are cut after a sign that ends a piece."""
    for part in pieces(batch, limit=PIECE):
        if part.num_rows > 1 or part.column("text").nbytes <= 2 * PIECE:
            yield part
            continue
        text, lang, start = part.column("text")[0].as_py(), part.column("lang"), 0
        while start < len(text):
            sign = _SIGN.search(text, start + PIECE)
            end = sign.end() if sign else len(text)
            yield pa.RecordBatch.from_arrays([pa.array([text[start:end]]), lang], names=["text", "lang"])
            start = end


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, different values)."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def string_hashes(strings: pa.Array) -> np.ndarray:
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return span_hashes(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def chain(first: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their language and words."""
    for word in words:
        first = mix(first * np.uint64(0xA0761D6478BD642F) + word)
    return first


class Counter:
    """Words of a slice of texts, and the phrases among them that a filter lets through."""

    def __init__(self, part: pa.RecordBatch) -> None:
        tokens = Tokens(part.column("text"), BLANKS | SIGNS)
        words = tokens.strings.dictionary_encode()
        langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
        self.words, self.langs = words.dictionary, langs.dictionary
        self.word, text = words.indices.to_numpy().astype(np.int64), tokens.text_of()
        self.lang = langs.indices.to_numpy().astype(np.int64)[text]
        piece = np.searchsorted(np.flatnonzero(SIGNS[tokens.data]), tokens.starts)
        self.joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])  # with the next word

    def passing(self, size: int, bits: np.ndarray) -> np.ndarray:
        """First words of the phrases of `size` words whose two parts of size - 1 words are in the filter."""
        n = max(0, len(self.word) - size + 1)
        at = np.flatnonzero(np.logical_and.reduce([self.joined[k : k + n] for k in range(size - 1)])) if n else np.zeros(0, np.int64)
        word, lang = string_hashes(self.words)[self.word], string_hashes(self.langs)
        for skip in (0, 1):
            at = at[held(bits, chain(lang[self.lang[at]], [word[at + skip + k] for k in range(size - 1)]))]
        return at

    def counts(self, size: int, at: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(languages, phrases, counts) of the different phrases of `size` words that begin at `at`."""
        number, different = numbered(self.lang[at] * max(1, len(self.words)) + self.word[at])
        lang, phrase = different // max(1, len(self.words)), [different % max(1, len(self.words))]
        for k in range(1, size):
            number, different = numbered(number * len(self.words) + self.word[at + k])
            before = different // len(self.words)
            lang, phrase = lang[before], [w[before] for w in phrase] + [different % len(self.words)]
        strings = [self.words.take(pa.array(w)) for w in phrase]
        joined = pc.binary_join_element_wise(*strings, pa.scalar(" ", pa.large_string())) if size > 1 else strings[0]
        return self.langs.take(pa.array(lang)), joined, np.bincount(number, minlength=len(different))


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set; the filter has a power of two of bits."""
    out = np.ones(len(hashes), bool)
    for spot in (hashes, hashes >> np.uint64(32)):
        spot = spot & np.uint64(len(bits) * 64 - 1)
        out &= (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0
    return out


def bit_filter(phrases: DataFrame, size: int) -> np.ndarray:
    """The filter of all (lang, phrase) rows: at most FILTER_BITS bits, whatever their number."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(batch.column("phrase"), BLANKS)
            words = string_hashes(tokens.strings).reshape(-1, size)
            found = chain(string_hashes(batch.column("lang")), list(words.T))
            yield pa.RecordBatch.from_arrays([pa.array(signed(found))], names=["h"])

    count = phrases.count()
    bits = min(FILTER_BITS, max(64, 1 << (count * BITS_PER_PHRASE - 1).bit_length()))
    spots = F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(bits)))
    set_bits = phrases.select("lang", "phrase").mapInArrow(hashed, "h bigint").select(F.explode(spots).alias("spot"))
    rows = set_bits.groupBy((F.col("spot") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("word")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64).view(np.uint64)
    return out


def count_phrases(docs: DataFrame, size: int, bits: np.ndarray | None) -> DataFrame:
    """lang, phrase, a: counts of all words, or of the phrases that the filter lets through; phrase null: number of words."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in long_texts_cut(batch):
                found = Counter(part)
                at = np.arange(len(found.word)) if size == 1 else found.passing(size, sent.value)
                lang, phrase, count = found.counts(size, at)
                if size == 1:
                    totals = np.bincount(found.lang, minlength=len(found.langs))
                    lang, phrase, count = pa.concat_arrays([lang, found.langs]), pa.concat_arrays([phrase, pa.nulls(len(totals), pa.large_string())]), np.concatenate([count, totals])
                out = pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "phrase", "a"])
                for start in range(0, len(count), ROWS):
                    yield out.slice(start, ROWS)

    counted = docs.mapInArrow(run, "lang string, phrase string, a bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _stream(counts: DataFrame, size: int) -> DataFrame:
    """A count stream with the two keys it is merged by: head (without the last word) and tail (without the first)."""
    return counts.select("lang", "phrase", "a", F.substring_index("phrase", " ", size - 1).alias("head"), F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("tail"))


def _parts(stream: DataFrame, shorter: DataFrame) -> DataFrame:
    """Left and right counts of all cuts, from those of the phrases without the last and the first word."""
    shorter = shorter.select("lang", "phrase", "a", "lefts", "rights")
    left = shorter.select("lang", F.col("phrase").alias("head"), F.concat("lefts", F.array("a")).alias("lefts")).hint("merge")
    right = shorter.select("lang", F.col("phrase").alias("tail"), F.concat(F.array("a"), "rights").alias("rights")).hint("merge")
    return stream.join(left, ["lang", "head"]).join(right, ["lang", "tail"])


def _extension(longer: DataFrame) -> DataFrame:
    """The largest count of a phrase longer by one word, for the phrases that have one."""
    both = longer.select("lang", F.col("head").alias("phrase"), "a").unionByName(longer.select("lang", F.col("tail").alias("phrase"), "a"))
    return both.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def weakest_cut() -> Column:
    """(score, k, l, r) of the cut with the lowest score, the first of equal ones; decimals, as products may pass 64 bits."""
    cuts = F.expr("transform(lefts, (l, i) -> struct(CAST(a AS DECIMAL(20,0)) * 2000000 div (CAST(l AS DECIMAL(20,0)) + CAST(rights[i] AS DECIMAL(20,0))) AS score, i AS k, l AS l, rights[i] AS r))")
    return F.array_min(cuts)


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The `top` phrases of every language that occur at least `least` times.

    Output: lang, rank, phrase, a (its count), l and r (counts of the two parts at its weakest cut), n (words
    of the language), score (2,000,000 a / (l + r), whole part). Phrases with `share` percent or more of their
    occurrences inside one longer phrase are left out.
    """
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = keep(count_phrases(source, 1, None).filter((F.col("a") >= least) | F.col("phrase").isNull()), "words")
    totals = words.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
    none = F.array().cast("array<bigint>")
    parts = [words.filter("phrase IS NOT NULL").select("lang", "phrase", "a", none.alias("lefts"), none.alias("rights"))]
    for size in range(2, LONGEST + 1):
        counts = keep(count_phrases(source, size, bit_filter(parts[-1], size - 1)).filter(F.col("a") >= least), f"phrases{size}")
        parts.append(keep(_parts(_stream(counts, size), parts[-1]), f"parts{size}"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    kept = []
    for shorter, longer in zip(parts[1:], [*parts[2:], None], strict=True):
        if longer is not None:
            met = shorter.join(_extension(longer).hint("merge"), ["lang", "phrase"], "left")
            shorter = met.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
        kept.append(shorter.select("lang", "phrase", "a", "lefts", "rights"))
    found = kept[0].unionByName(kept[1]).unionByName(kept[2]).select("lang", "phrase", "a", weakest_cut().alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
