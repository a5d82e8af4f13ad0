"""Scoring texts by a hierarchical Pitman-Yor model.

Every document is a restaurant. Its parent, at each word, is the restaurant of the word before (or of the
start of a text); these all share one parent, the restaurant of all words. That one's parent spells
words by restaurants of contexts: two symbols before, whose parent is the context of one symbol, whose
parent is the context of none, over a uniform base. A table sends one customer to its parent.

A document's word opens a table at its first use, and at later ones as drawn from the probability of all
words. The seating of words and spelling is drawn in sweeps: each draws the tables of every dish, given the
other tables of the sweep before. Then contexts are drawn several times, each time given the words and the
tables of the draw before, and followed by a sweep of the words that goes on from the last one. Probabilities
of words and tables of contexts are averaged over the last draws. A word met once after another has one table
there in every draw, so only pairs met more often are drawn.

A document is scored in order: its own restaurant fills up as its words are read, so the probability
of a text is the product of proper predictive probabilities, unknown words included.

Words are reseated in parallel, so a sweep sees the total number of tables of the sweep before. All
draws come from hashes of word and sweep: a task that runs again draws the same. Words are known by a
64-bit hash when texts are scored. The frequent words, contexts and pairs of both (a bounded number of each)
go to every executor; all others are dealt by hash, and what is asked of them travels as arrays of keys to where
they lie. Texts are scored in passes over parts of them, so that the arrays of one pass only are on disk. Every
input row gives one row. Null and empty texts have the end token only; without training
texts everything is spelled by the uniform base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Words, mix, pieces, signed, span_hashes, text_bytes
from tidemark.llm.store import forget, keep

#: Gibbs sweeps, and how many of the last are averaged.
SWEEPS, AVERAGED = 5, 3
#: Draws of the context restaurants' seats, each followed by a sweep of the words; the last are averaged as well.
CONTEXT_SWEEPS = 5
#: Words that travel to every executor with their probabilities (24 bytes each); the rest is joined.
FREQUENT = 1 << 18
STRENGTH, DOC_STRENGTH = 1.0, 100.0
#: Tokens no text has: they cannot hold white space.
END, STATS = "\n", "\r"
WORD_END, TEXT_END, START = 256, 257, 258
SYMBOLS, CONTEXTS = 258, 259
COUNT_BYTES = 2_000_000
#: Tokens of a deal, least deals, entries of one array, parts that the pairs of one context are dealt into (a power of two).
DEAL_TOKENS, LEAST_DEALS, ARRAY_ROWS, CONTEXT_BITS = 500_000, 64, 1 << 16, 4
#: Bytes of the texts that are scored in one pass, and passes at most.
PASS_BYTES, MOST_PASSES = 20_000_000, 8


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and salt only."""
    for s in salt:
        key = mix(key + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (key >> np.uint64(11)).astype(np.float64) / (1 << 53)


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one.

    A customer opens a table with probability fresh / (fresh + seated - discount * tables), where
    fresh = (strength + discount * all tables) * parent probability. Past 40 seated customers they sit
    down in groups of a twentieth, with the expected number of new tables rounded at random.
    """
    order = np.argsort(-customers, kind="stable")
    m, a, k = customers[order].astype(np.float64), fresh[order], key[order]
    t = np.minimum(m, 1.0)
    seated = 1
    while True:
        live = int(np.searchsorted(-m, -seated, side="left"))
        if not live:
            break
        group = np.minimum(max(1, seated // 20), m[:live] - seated)
        p = a[:live] / (a[:live] + seated - discount * t[:live])
        t[:live] += np.floor(group * p + uniform(k[:live], sweep, seated))
        seated += max(1, seated // 20)
    out = np.empty(len(m))
    out[order] = t
    return out


def discount_of(once: float, twice: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


@dataclass
class Speller:
    """Probabilities of symbols after two symbols, from one seating; it travels as what was seated, without the full table."""

    contexts: np.ndarray  # both symbols as one number, in order
    shares: np.ndarray  # of a context: what it leaves to the context of its last symbol, and its customers
    cells: tuple[np.ndarray, np.ndarray, np.ndarray]  # (context, symbol, customers less their discount)
    last: np.ndarray  # probabilities after one symbol

    @cached_property
    def table(self) -> np.ndarray:
        at, symbol, own = self.cells
        fresh, customers = self.shares
        table = fresh[:, None] * self.last[self.contexts % CONTEXTS] if len(self.contexts) else np.zeros((0, SYMBOLS))
        np.add.at(table, (at, symbol), own)
        return np.concatenate([table / (STRENGTH + customers)[:, None], self.last])

    @cached_property
    def row(self) -> np.ndarray:
        """Context -> row of `table`, by both symbols; unseen ones share the row of their last symbol."""
        row = np.tile(len(self.contexts) + np.arange(CONTEXTS), (CONTEXTS, 1))
        row[self.contexts // CONTEXTS, self.contexts % CONTEXTS] = np.arange(len(self.contexts))
        return row

    def __reduce__(self):
        return Speller, (self.contexts, self.shares, self.cells, self.last)

    def words(self, column: pa.Array) -> np.ndarray:
        """Probability of every string as the spelling of a word."""
        data, offsets = text_bytes(column)
        count = len(offsets) - 1
        owner = np.repeat(np.arange(count), np.diff(offsets))
        symbols = np.full(len(data) + count, WORD_END, np.int64)
        symbols[np.arange(len(data)) + owner] = data
        starts = offsets[:-1] + np.arange(count)
        one, two = _shift(symbols, starts, 1), _shift(symbols, starts, 2)
        return 10 ** np.add.reduceat(np.log10(self.table[self.row[two, one], symbols]), starts) if count else np.zeros(0)

    def end(self) -> float:
        return float(self.table[self.row[START, START], TEXT_END])


def _shift(symbols: np.ndarray, starts: np.ndarray, by: int) -> np.ndarray:
    """The symbol `by` places before each one in the same word, START before its first."""
    out = np.full(len(symbols), START, np.int64)
    out[by:] = symbols[: max(0, len(symbols) - by)]
    ends = np.append(starts[1:], len(symbols))
    for k in range(by):
        out[(starts + k)[starts + k < ends]] = START
    return out


def spell(triples: np.ndarray, counts: np.ndarray, sweep: int, rounds: int = 3) -> Speller:
    """Seat the customers of all spelling contexts; triples: (before two, before one, symbol) as one number."""
    two, one, symbol = triples // (CONTEXTS * SYMBOLS), triples // SYMBOLS % CONTEXTS, triples % SYMBOLS
    pairs, pair_of = np.unique(one * SYMBOLS + symbol, return_inverse=True)
    contexts, context_of = np.unique(two * CONTEXTS + one, return_inverse=True)
    base = np.full(SYMBOLS, 1.0 / SYMBOLS)
    d2 = discount_of((counts == 1).sum(), (counts == 2).sum())
    d1 = d0 = 0.5
    p0, p1 = base, np.tile(base, (CONTEXTS, 1))
    t2, t1, t0 = np.minimum(counts, 1.0), np.ones(len(pairs)), np.ones(SYMBOLS)
    for r in range(rounds):
        key = lambda x: mix(x.astype(np.uint64) + np.uint64(r))
        total2 = np.bincount(context_of, t2, len(contexts))
        t2 = seat(counts, (STRENGTH + d2 * total2[context_of]) * p1[one, symbol], d2, key(triples), sweep)
        m1 = np.bincount(pair_of, t2, len(pairs))
        c1, s1 = pairs // SYMBOLS, pairs % SYMBOLS
        total1 = np.bincount(c1, t1, CONTEXTS)
        t1 = seat(m1, (STRENGTH + d1 * total1[c1]) * p0[s1], d1, key(pairs), sweep)
        m0 = np.bincount(s1, t1, SYMBOLS)
        t0 = seat(m0, (STRENGTH + d0 * t0.sum()) * base, d0, key(np.arange(SYMBOLS)), sweep)
        p0 = (np.maximum(m0 - d0 * t0, 0) + (STRENGTH + d0 * t0.sum()) * base) / (STRENGTH + m0.sum())
        grid_m, grid_t = np.zeros((CONTEXTS, SYMBOLS)), np.zeros((CONTEXTS, SYMBOLS))
        grid_m[c1, s1], grid_t[c1, s1] = m1, t1
        p1 = (grid_m - d1 * grid_t + (STRENGTH + d1 * grid_t.sum(1, keepdims=True)) * p0) / (STRENGTH + grid_m.sum(1, keepdims=True))
    total2, customers = np.bincount(context_of, t2, len(contexts)), np.bincount(context_of, counts, len(contexts))
    return Speller(contexts, np.array([STRENGTH + d2 * total2, customers]), (context_of, symbol, counts - d2 * t2), p1)


@dataclass
class Sweep:
    """What one sweep was drawn with, so that any task can draw it again."""

    number: int
    speller: Speller
    tables_before: float
    tables: float = 0.0


@dataclass
class Seats:
    discount: float
    customers: float

    def base(self, speller: Speller, words: pa.Array) -> np.ndarray:
        out = speller.words(words)
        ends = np.array(words.to_pylist(), object) == END
        return np.where(ends, speller.end(), out)

    def draw(self, sweep: Sweep, key: np.ndarray, customers: np.ndarray, base: np.ndarray) -> np.ndarray:
        return seat(customers, (STRENGTH + self.discount * sweep.tables_before) * base, self.discount, key, sweep.number)

    def known(self, sweep: Sweep, customers: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
        fresh = STRENGTH + self.discount * sweep.tables
        return (np.maximum(customers - self.discount * tables, 0) + fresh * base) / (STRENGTH + self.customers)


@dataclass
class Tokens:
    """The words of a batch of texts and the end of each text, with their documents' seating."""

    words: Words
    key: np.ndarray
    text: np.ndarray
    place: np.ndarray
    word: np.ndarray  # number in `words`, -1 for an end
    context: np.ndarray  # key of what stands before
    pair: np.ndarray
    seen: np.ndarray  # earlier uses in the same text
    near: np.ndarray
    fresh: np.ndarray

    @staticmethod
    def of(column: pa.Array, discount: float) -> Tokens:
        words = Words(column)
        rows = len(words.counts)
        key = np.full(len(words.starts) + rows, word_keys(pa.array([END]))[0])
        word = np.full(len(key), -1)
        at = np.arange(len(words.starts)) + words.text_of()
        key[at], word[at] = words.hashes(), np.arange(len(at))
        text = np.repeat(np.arange(rows), words.counts + 1)
        starts = words.bounds[:-1] + np.arange(rows)
        place = np.arange(len(key)) - starts[text]
        before = np.concatenate([np.zeros(1, np.uint64), key])[: len(key)]
        before[starts] = np.uint64(0)
        context = mix(before + np.uint64(0xA24BAED4963EE407))
        order = np.argsort(group := mix(key + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = group[order[1:]] != group[order[:-1]]
        heads = np.flatnonzero(new)
        seen = np.zeros(len(key))
        seen[order] = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
        opened = np.concatenate([[0], np.cumsum(seen == 0)])
        kinds = opened[:-1] - opened[starts[text]]  # dishes in the document's restaurant so far
        near = np.where(seen > 0, (seen - discount) / (place + DOC_STRENGTH), 0.0)
        fresh = (DOC_STRENGTH + discount * kinds) / (place + DOC_STRENGTH)
        return Tokens(words, key, text, place, word, context, pair_keys(context, key), seen, near, fresh)


def pair_keys(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9FB21C651E98DF25) + key)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ordered `keys`, whether it is there) of all wanted ones."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def deals_of(key: np.ndarray, deals: int) -> np.ndarray:
    """Where words and contexts lie, and are asked for."""
    return (mix(key ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(deals)).astype(np.int64)


def pair_deals(context: np.ndarray, key: np.ndarray, deals: int) -> np.ndarray:
    """Where pairs lie: mostly those of a context together, those of a common one in several deals."""
    part = key >> np.uint64(64 - CONTEXT_BITS)
    return (mix(context + part * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(deals)).astype(np.int64)


def dealt(deal: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by deal and `then`, (deal, start, end) of each one in that order)."""
    order = np.lexsort((*then[::-1], deal)) if then else np.argsort(deal, kind="stable")
    found, starts = np.unique(deal[order], return_index=True)
    return order, list(zip(found.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist()))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal neighbours."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(values)))


def read(cell, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer() if cell.is_valid else b"", kind)


def joined(column, kind: type = np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[read(x, kind) for x in column]])


def tasks_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: What is kept of the counted pairs, array by array: lone pairs, others, and the sums of contexts and of words.
PAIRS = ("lone", "before", "key", "c", "contexts", "tables", "customers", "words", "held")


def count_pairs(df: DataFrame, model: DataFrame, discount: float, deals: int, text_col: str = "text") -> DataFrame:
    """The tables that documents open for a word after what stands before it, by deal: PAIRS as arrays, and the numbers of pairs met once and twice; kept."""
    _, keys, _, probs = frequent(model, FREQUENT)
    sent = df.sparkSession.sparkContext.broadcast((keys, probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, probs_ = sent.value
        for batch in batches:
            for piece in pieces(batch):
                t = Tokens.of(piece.column("text"), discount)
                at, hot = find(keys_, t.key)
                p = np.where(hot, probs_[at], probs_.min()) if len(keys_) else np.zeros(len(t.key))
                opens = (t.seen == 0) | (uniform(t.pair + t.place.astype(np.uint64), 7) * (t.near + t.fresh * p) < t.fresh * p)
                _, first, c = np.unique(t.pair[opens], return_index=True, return_counts=True)
                first = np.flatnonzero(opens)[first]
                before, key = t.context[first], t.key[first]
                order, parts = dealt(pair_deals(before, key, deals), before, key)
                before, key, c = before[order], key[order], c[order].astype(np.uint32)
                rows = []
                for deal, a, b in parts:
                    starts, lengths = runs(before[a:b])
                    rows.append((deal, before[a:b][starts].tobytes(), lengths.astype(np.uint32).tobytes(), key[a:b].tobytes(), c[a:b].tobytes()))
                if rows:
                    deal, *cells = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), *[pa.array(x, pa.binary()) for x in cells]], names=["deal", "before", "lengths", "key", "c"])

    def add(found: pa.Table) -> pa.Table:
        before = np.concatenate([np.repeat(read(x), read(n, np.uint32)) for x, n in zip(found["before"], found["lengths"])])
        key, c = joined(found["key"]), joined(found["c"], np.uint32).astype(np.int64)
        order = np.lexsort((key, before))
        before, key, c = before[order], key[order], c[order]
        new = np.ones(len(key), bool)
        new[1:] = (before[1:] != before[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        before, key, c = before[starts], key[starts], np.add.reduceat(c, starts)
        at, tables = runs(before)
        words, held = np.unique(key, return_counts=True)
        more = c > 1
        arrays = (np.sort(pair_keys(before[~more], key[~more])), before[more], key[more], c[more], before[at], tables, np.add.reduceat(c, at), words, held)
        rows = max(1, *[-(-len(x) // ARRAY_ROWS) for x in arrays])
        cells = [[x[i * ARRAY_ROWS : (i + 1) * ARRAY_ROWS].tobytes() for i in range(rows)] for x in arrays]
        ones = np.zeros((2, rows), np.int64)
        ones[:, 0] = (~more).sum(), (c == 2).sum()
        return pa.table([pa.repeat(found["deal"][0], rows), *[pa.array(x, pa.binary()) for x in cells], *[pa.array(x) for x in ones]], names=["deal", *PAIRS, "once", "twice"])

    sums = df.select(F.col(text_col).alias("text")).mapInArrow(run, "deal bigint, before binary, lengths binary, key binary, c binary")
    schema = "deal bigint, " + ", ".join(f"{x} binary" for x in PAIRS) + ", once bigint, twice bigint"
    counted = keep(sums.repartition(tasks_of(df), "deal").groupBy("deal").applyInArrow(add, schema), "pairs", True)
    sent.destroy()
    return counted


def unpacked(kept: DataFrame, *columns: str) -> DataFrame:
    """Arrays of equal lengths as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(read(batch.column(x)[i], np.int64)) for x in columns], names=list(columns))

    return kept.select(*columns).mapInArrow(run, ", ".join(f"{x} bigint" for x in columns))


def shifted(name: str, new: Column) -> list[Column]:
    """The drawn values of the last AVERAGED draws, `name`0 the newest."""
    return [new.cast("bigint").alias(f"{name}0"), *[F.col(f"{name}{i}").alias(f"{name}{i + 1}") for i in range(AVERAGED - 1)]]


def seat_contexts(pairs: DataFrame, model: DataFrame, contexts: DataFrame, discount: float, sweep: int) -> DataFrame:
    """pairs with t0, the tables of a word in the restaurant of a context, and those of the draws before; contexts: before, tables."""
    older = [f"t{i}" for i in range(AVERAGED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, key = [batch.column(x).to_numpy().view(np.uint64) for x in ("before", "key")]
            c, tables, p = [batch.column(x).to_numpy().astype(np.float64) for x in ("c", "tables", "p")]
            t = seat(c, (STRENGTH + discount * tables) * p, discount, pair_keys(before, key), sweep).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("before", "key", "c")], pa.array(t), *[batch.column(x) for x in older[:-1]]], names=["before", "key", "c", *older])

    met = pairs.join(model.select("key", "p"), "key").join(contexts.select("before", "tables"), "before")
    return met.select("before", "key", "c", *older, "tables", "p").mapInArrow(run, ", ".join(f"{x} bigint" for x in ("before", "key", "c", *older)))


def train_contexts(df: DataFrame, text_col: str = "text") -> tuple[tuple[DataFrame, DataFrame, DataFrame], list[tuple[Sweep, Seats]], dict, tuple[DataFrame, DataFrame]]:
    """((words, contexts, pairs), draws, totals, (lone pairs as arrays, the other pairs)); each table has key, c and p: of a word its
    probability, of a context the share left to all words, of a pair the customers less the discount of their tables."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(signed(word_keys(batch.column("word")))), batch.column("c"), batch.column("m")], names=["word", "key", "c", "m"])

    zeros = lambda name: [F.lit(0).cast("bigint").alias(f"{name}{i}") for i in range(AVERAGED)]
    words = keep(count_words(df, text_col).mapInArrow(keyed, "word string, key bigint, c bigint, m bigint"), "words", True)
    model, _, _, total, state = train(words)
    deals = total["deals"] = max(LEAST_DEALS, total["n"] // DEAL_TOKENS)
    counted = count_pairs(df, model, total["doc_discount"], deals, text_col)
    discount = discount_of(*counted.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first())
    # every pair has one table; what more the drawn ones have is added
    first = keep(unpacked(counted, "contexts", "tables", "customers").groupBy(F.col("contexts").alias("before")).agg(F.sum("tables").alias("tables"), F.sum("customers").alias("c")), "contexts", True)
    held = keep(unpacked(counted, "words", "held").groupBy(F.col("words").alias("key")).agg(F.sum("held").alias("t")), "held", True)
    lone = keep(counted.select("deal", "lone").filter(F.length("lone") > 0), "lone")
    seated = keep(unpacked(counted, "before", "key", "c").select("before", "key", "c", *zeros("t")), "seated")
    forget(counted)
    more = lambda by, t: seated.groupBy(by).agg(F.sum(t - 1).alias("more"))
    added = lambda name: (F.col(name) + F.coalesce("more", F.lit(0))).alias(name)
    after = lambda t: first.join(more("before", t), "before", "left").select("before", "c", added("tables"))
    words, counts = keep(words.select("*", *zeros("m")), "words"), words
    forget(counts)
    draws = []
    for sweep in range(CONTEXT_SWEEPS):
        contexts = after(F.col("t0")) if sweep else first
        seated, old = keep(seat_contexts(seated, model, contexts, discount, sweep), "seated", True), (seated, model, words)
        tables = held.join(more("key", F.col("t0")), "key", "left").select("key", added("t"))
        drawn = F.when(F.col("word") == STATS, F.col("m")).otherwise(F.coalesce("t", "m"))
        words = keep(words.join(tables, "key", "left").select("word", "key", "c", "m", *shifted("m", drawn)), "words", True)
        for done in old:
            forget(done)
        sweeps, seats, _, state = sweep_words(words, "m0", state, 1)
        draws = [*draws, (sweeps[-1], seats)][-AVERAGED:]
        used = [(0, *draws[-1])] if sweep < CONTEXT_SWEEPS - 1 else [(i, *x) for i, x in enumerate(draws[::-1])]
        model = model_of(words, [(f"m{i}", s, seats) for i, s, seats in used])
    last = range(min(AVERAGED, CONTEXT_SWEEPS))
    mean = reduce(lambda a, b: a + b, [F.col(f"t{i}") for i in last]) / len(last)
    left = keep(after(mean).select(F.col("before").alias("key"), "c", ((STRENGTH + discount * F.col("tables")) / (STRENGTH + F.col("c"))).alias("p")), "contexts", True)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, key = [batch.column(x).to_numpy().view(np.uint64) for x in ("before", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(pair_deals(before, key, deals)), pa.array(signed(pair_keys(before, key))), batch.column("c"), batch.column("p")], names=["deal", "key", "c", "p"])

    met = seated.select("before", "key", "c", F.greatest(F.col("c") - discount * mean, F.lit(0.0)).alias("p"))
    shares = keep(met.mapInArrow(name, "deal bigint, key bigint, c bigint, p double"), "shares")
    for done in (words, first, held, seated):
        forget(done)
    total["lone_share"] = 1.0 - discount
    pairs = shares.select("key", "c", "p").unionByName(unpacked(lone, "lone").select(F.col("lone").alias("key"), F.lit(1).cast("bigint").alias("c"), F.lit(1.0 - discount).alias("p")))
    return (model, left, pairs), draws, total, (lone, shares)


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c (occurrences), m (documents) of all texts; the row STATS has the words met once and twice in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=COUNT_BYTES):
                words = Words(piece.column("text"))
                h, text = words.hashes(), words.text_of()
                order = np.argsort(mix(h + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), kind="stable")
                hs, ts = h[order], text[order]
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
                per_doc = np.diff(np.append(np.flatnonzero(new), len(hs)))
                firsts = order[new]
                keys, at, back = np.unique(h[firsts], return_index=True, return_inverse=True)
                c, m = np.bincount(back, per_doc, len(keys)), np.bincount(back, minlength=len(keys))
                names = words.strings(firsts[at]) + [END, STATS]
                c = np.append(c, [piece.num_rows, (per_doc == 1).sum()]).astype(np.int64)
                m = np.append(m, [piece.num_rows, (per_doc == 2).sum()]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(c), pa.array(m)], names=["word", "c", "m"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, c bigint, m bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def word_keys(words: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(words)
    return span_hashes(data, offsets[:-1], offsets[1:])


def train(counts: DataFrame) -> tuple[DataFrame, list[Sweep], Seats, dict, tuple[int, Speller, float]]:
    """(key, c, p of every word; the averaged sweeps; seats; totals; state) from the kept rows of `count_words`."""
    sweeps, seats, total, state = sweep_words(counts, "m", None, SWEEPS)
    return model_of(counts, [("m", s, seats) for s in sweeps]), sweeps, seats, total, state


def sweep_words(counts: DataFrame, tables_col: str, state: tuple[int, Speller, float] | None, rounds: int) -> tuple[list[Sweep], Seats, dict, tuple[int, Speller, float]]:
    """(the averaged sweeps; seats; totals; state) of `rounds` sweeps over words with `tables_col` customers.

    state: the number, spelling and tables that the next sweep starts from; without one sweeps begin anew.
    """
    spark = counts.sparkSession
    counts = counts.select("word", "c", F.col(tables_col).alias("m"))
    words = counts.filter(F.col("word") != STATS)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count_if(F.col("m") == 1).alias("once"), F.count_if(F.col("m") == 2).alias("twice")).first().asDict()
    stats = counts.filter(F.col("word") == STATS).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    total["doc_discount"] = discount_of(*map(float, stats)) if stats[0] else 0.5
    seats = Seats(discount_of(float(total["once"]), float(total["twice"])), float(total["m"]))
    begun, speller, tables = state or (0, spell(np.zeros(0, np.int64), np.zeros(0), 0), float(total["v"]))
    sweeps = []
    for number in range(begun, begun + rounds):
        sweep = Sweep(number, speller, tables)
        sent = spark.sparkContext.broadcast((sweep, seats))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            drawn, held = sent.value
            for batch in batches:
                words_, m = batch.column("word"), batch.column("m").to_numpy().astype(np.float64)
                base = held.base(drawn.speller, words_)
                t = held.draw(drawn, word_keys(words_), m, base)
                codes, owner = _triples(words_)
                found, back = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(np.bincount(back, t[owner], len(found)), t.sum()))], names=["code", "n"])

        # at most one row per possible triple of symbols, far fewer in any writing system
        found = words.select("word", "m").mapInArrow(run, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
        sent.destroy()
        code, n = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
        sweep.tables = tables = float(n[code < 0].sum())
        sweeps.append(sweep)
        speller = spell(code[code >= 0], n[code >= 0], number + 1)
    return sweeps[-AVERAGED:], seats, total, (begun + rounds, speller, tables)


def model_of(words: DataFrame, draws: list[tuple[str, Sweep, Seats]]) -> DataFrame:
    """key, c and p of every word, averaged over draws (the column of its customers, sweep, seats); kept."""
    sent = words.sparkSession.sparkContext.broadcast(draws)
    columns = sorted({x for x, _, _ in draws})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = batch.column("word")
            key, p = word_keys(words_), np.zeros(batch.num_rows)
            for column, s, held in sent.value:
                m, base = batch.column(column).to_numpy().astype(np.float64), held.base(s.speller, words_)
                p += held.known(s, m, held.draw(s, key, m, base), base)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), batch.column("c"), pa.array(p / len(sent.value))], names=["key", "c", "p"])

    model = keep(words.filter(F.col("word") != STATS).select("word", "c", *columns).mapInArrow(predict, "key bigint, c bigint, p double"), "model")
    sent.destroy()
    return model


def _triples(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all symbol triples of all words, word number of each)."""
    data, offsets = text_bytes(words)
    count = len(offsets) - 1
    owner = np.repeat(np.arange(count), np.diff(offsets))
    symbols = np.full(len(data) + count, WORD_END, np.int64)
    symbols[np.arange(len(data)) + owner] = data
    starts = offsets[:-1] + np.arange(count)
    one, two = _shift(symbols, starts, 1), _shift(symbols, starts, 2)
    of = np.repeat(np.arange(count), np.diff(offsets) + 1)
    codes = (two * CONTEXTS + one) * SYMBOLS + symbols
    ends = np.array(words.to_pylist(), object)[of] == END  # spelled by its own single symbol
    first = np.zeros(len(codes), bool)
    first[starts] = True
    codes = np.where(ends, (START * CONTEXTS + START) * SYMBOLS + TEXT_END, codes)
    use = ~ends | first
    return codes[use], of[use]


def frequent(model: DataFrame, most: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(smallest count, keys in order, counts, probabilities) of the words above the count that at most `most` words reach."""
    levels = model.groupBy(F.floor(F.log2(F.col("c")) * 8).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    least, held = (1 << 62), 0
    for row in levels:
        held += row.n
        if held > most:
            break
        least = row.least
    top = model.filter(F.col("c") >= least).toPandas() if held else model.limit(0).toPandas()
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return least, key[order], top["c"].to_numpy(np.int64)[order], top["p"].to_numpy(np.float64)[order]


#: Rows between the steps of scoring: entries of tables, of lone pairs, what a pair may add to a text, the three lookups, tokens that wait for them, sums of texts.
ENTRIES, LONE, RATIO, WORD, CONTEXT, PAIR, HOME, SUMS = range(8)
#: A token whose word or context is not frequent; places among the lookups of its piece, -1 where nothing is asked.
TOKEN = np.dtype([(x, "f8") for x in ("near", "fresh", "p", "left", "share")] + [(x, "i4") for x in ("text", "word", "context", "pair")])


def entries(table: DataFrame, deals: int) -> DataFrame:
    """A table (key, c, p, and deal if it was dealt) as arrays by deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chained(batches):
            if batch is not None:
                held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
                size += batch.num_rows
            if size and (batch is None or size >= DEAL_TOKENS):
                deal, key, c, p = (np.concatenate(x) for x in zip(*held))
                if deal[0] < 0:
                    deal = deals_of(key.view(np.uint64), deals)
                order, parts = dealt(deal)
                parts = [(d, i, min(b, i + ARRAY_ROWS)) for d, a, b in parts for i in range(a, b, ARRAY_ROWS)]
                cells = [[x[a:b].tobytes() for _, a, b in parts] for x in (key[order], c[order], p[order])]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in parts], pa.int64()), *[pa.array(x, pa.binary()) for x in cells]], names=["deal", "a", "b", "c"])
                held, size = [], 0

    if "deal" not in table.columns:
        table = table.withColumn("deal", F.lit(-1).cast("bigint"))
    rows = table.select("deal", "key", "c", "p").mapInArrow(run, "deal bigint, a binary, b binary, c binary")
    return rows.withColumn("kind", F.lit(ENTRIES))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _cells(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def looked_up(batches: Iterator[pa.RecordBatch], lone_share: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What is asked in the order of deals, the entries of a deal first: answers, sums by text, and all other rows as they are."""
    deal, tables, keys, c, p = None, [], None, None, None
    for batch in batches:
        out = []
        for kind, at, piece, place, *cells in zip(*[batch.column(x) for x in ("kind", "deal", "piece", "at", "a", "b", "c")]):
            kind = kind.as_py()
            if kind >= HOME:
                continue
            if at.as_py() != deal:
                deal, tables, keys = at.as_py(), [], None
            if kind <= LONE:
                key = read(cells[0])
                tables.append((key, read(cells[1], np.int64), read(cells[2], np.float64)) if kind == ENTRIES else (key, np.ones(len(key), np.int64), np.full(len(key), lone_share)))
                continue
            if keys is None:
                keys, c, p = (np.concatenate(x) for x in zip(*tables)) if tables else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
                order = np.argsort(keys)
                keys, c, p, tables = keys[order], c[order], p[order], []
            found, known = find(keys, read(cells[0]))
            if kind != RATIO:
                answer = (np.where(known, c[found], 0), np.where(known, p[found], np.nan)) if len(keys) else (np.zeros(len(known), np.int64), np.full(len(known), np.nan))
                out.append({"kind": kind, "piece": piece.as_py(), "at": place.as_py(), "a": answer[0].tobytes(), "b": answer[1].tobytes()})
            elif known.any():
                ratio, text = read(cells[1], np.float64)[known], read(cells[2], np.uint32)[known]
                starts, _ = runs(text)
                sums = np.add.reduceat(np.log1p(ratio * p[found[known]]) / np.log(10), starts)
                out.append({"kind": kind, "piece": piece.as_py(), "a": text[starts].tobytes(), "b": sums.tobytes()})
        if out:
            yield _cells(out, schema)
        rest = np.flatnonzero(batch.column("kind").to_numpy() >= HOME)
        if len(rest):
            yield batch.take(pa.array(rest)).select(schema.names)


def finished(found: pa.Table, below: float, schema: pa.Schema) -> pa.Table:
    """The texts of a piece from all that came back for it."""
    kinds = found["kind"].to_numpy()
    texts = found.take(pa.array(np.flatnonzero(kinds == SUMS)))
    at = texts["at"].to_numpy()
    texts = texts.take(pa.array(np.argsort(at)))
    n = texts.num_rows
    known, base, score = (texts[x].to_numpy().copy() for x in ("n_known", "base", "score"))
    home = np.flatnonzero(kinds == HOME)
    for i in np.flatnonzero(kinds == RATIO):
        score[read(found["a"][int(i)], np.uint32)] += read(found["b"][int(i)], np.float64)
    if len(home):
        t, unseen = np.frombuffer(found["a"][int(home[0])].as_buffer(), TOKEN), read(found["b"][int(home[0])], np.float64)
        answers = {}
        for kind, name in ((WORD, "word"), (CONTEXT, "context"), (PAIR, "pair")):
            size = int(t[name].max()) + 1
            c, p = answers[name] = np.zeros(size, np.int64), np.full(size, np.nan)
            for i in map(int, np.flatnonzero(kinds == kind)):
                start, more = found["at"][i].as_py(), read(found["a"][i], np.int64)
                c[start : start + len(more)], p[start : start + len(more)] = more, read(found["b"][i], np.float64)
        own = np.nan_to_num(answers["pair"][1], nan=0.0)[t["pair"]]
        p_word, left, share = t["p"].copy(), t["left"].copy(), t["share"].copy()
        cold, far = np.flatnonzero(t["word"] >= 0), np.flatnonzero(t["context"] >= 0)
        c, p = (x[t["word"][cold]] for x in answers["word"])
        p_word[cold] = np.where(c > 0, p, unseen[t["word"][cold]])
        known += np.bincount(t["text"][cold], c > 0, n).astype(np.int64)
        base += np.bincount(t["text"][cold], np.log10((c + 0.5) / below), n)
        c, p = (x[t["context"][far]] for x in answers["context"])
        left[far], share[far] = np.where(c > 0, p, 1.0), 1 / (STRENGTH + c)
        score += np.bincount(t["text"], np.log10(t["near"] + t["fresh"] * (own * share + left * p_word)), n)
    return pa.table([texts["doc_id"], texts["held_out"], texts["n_tokens"], pa.array(known), pa.array(base), pa.array(score)], schema=schema)


def score_texts(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where `training` holds and score all rows.

    Output: the id, held_out, n_tokens, n_known, train_tokens, base_score (unigram counts plus a half),
    score (log10 probability by the model) and perplexity (10 to the minus mean score per token).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    tables, draws, total, (lone, shares) = train_contexts(df.filter(training), text_col)
    tops = [frequent(x) for x in tables]
    n, v, discount, deals, lone_share = float(total["n"]), float(total["v"]), total["doc_discount"], total["deals"], total["lone_share"]
    below = n + 0.5 * (v + 1)
    sent = spark.sparkContext.broadcast(([x[1:] for x in tops], draws))
    kind = df.schema[id_col].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
    shape = f"kind int, piece bigint, at bigint, a binary, b binary, c binary, {result}"
    cells, scored = (to_arrow_schema(spark.createDataFrame([], x).schema) for x in (shape, result))
    asked_cells = cells.insert(0, pa.field("deal", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((keys, counts, probs), (context_keys, context_counts, lefts), (pairs, _, shares_)), drawn = sent.value
        mean = lambda of: sum((STRENGTH + held.discount * s.tables) / (STRENGTH + held.customers) * of(s) for s, held in drawn) / len(drawn)
        at_end = mean(lambda s: s.speller.end())
        for batch in batches:
            for piece in pieces(batch):
                t, rows, name = Tokens.of(piece.column("text"), discount), piece.num_rows, piece.column("row")[0].as_py()
                zero = np.zeros(len(t.key))
                at, hot = find(keys, t.key)
                c, p = (np.where(hot, x[at], 0.0) if len(keys) else zero for x in (counts, probs))
                at, near_by = find(context_keys, t.context)
                share, left = (np.where(near_by, x[at], 0.0) if len(context_keys) else zero for x in (1 / (STRENGTH + context_counts), lefts))
                at, met = find(pairs, t.pair)
                own = np.where(met, shares_[at], 0.0) if len(pairs) else zero
                sure = hot & near_by
                # what a pair that is not at hand adds comes later
                value = np.log10((t.near + t.fresh * (own * share + left * p))[sure])
                sums = [np.bincount(t.text[of], x, rows).astype(np.float64) for of, x in ((hot, np.log10((c[hot] + 0.5) / below)), (sure, value))]
                known = np.bincount(t.text[hot], minlength=rows).astype(np.int64)
                out = []
                rest = np.flatnonzero(sure & ~met)
                order, parts = dealt(pair_deals(t.context[rest], t.key[rest], deals))
                rest = rest[order]
                ratio = t.fresh[rest] * share[rest] / (t.near[rest] + t.fresh[rest] * left[rest] * p[rest])
                for deal, a, b in parts:
                    out.append({"deal": deal, "kind": RATIO, "piece": name, "a": t.pair[rest[a:b]].tobytes(), "b": ratio[a:b].tobytes(), "c": t.text[rest[a:b]].astype(np.uint32).tobytes()})
                few = np.flatnonzero(~sure)
                if len(few):
                    token = np.zeros(len(few), TOKEN)
                    token["near"], token["fresh"], token["text"] = t.near[few], t.fresh[few], t.text[few]
                    token["p"], token["left"], token["share"] = np.where(hot, p, np.nan)[few], np.where(near_by, left, np.nan)[few], np.where(near_by, share, np.nan)[few]
                    unseen = np.zeros(0)
                    for code, column, key, asked in ((WORD, "word", t.key, ~hot), (CONTEXT, "context", t.context, ~near_by), (PAIR, "pair", t.pair, ~sure)):
                        token[column] = -1
                        of = np.flatnonzero(asked[few])
                        found, first, back = np.unique(key[few[of]], return_index=True, return_inverse=True)
                        first = few[of[first]]
                        order, parts = dealt(pair_deals(t.context[first], t.key[first], deals) if code == PAIR else deals_of(found, deals))
                        place = np.empty(len(order), np.int64)
                        place[order] = np.arange(len(order))
                        token[column][of] = place[back]
                        out += [{"deal": deal, "kind": code, "piece": name, "at": a, "a": found[order[a:b]].tobytes()} for deal, a, b in parts]
                        if code == WORD and len(first):
                            first = first[order]
                            unseen, cold = np.full(len(first), at_end), np.flatnonzero(t.word[first] >= 0)
                            if len(cold):
                                unseen[cold] = mean(lambda s: s.speller.words(pa.array(t.words.strings(t.word[first[cold]]), pa.string())))
                    out.append({"deal": name % deals, "kind": HOME, "piece": name, "a": token.tobytes(), "b": unseen.tobytes()})
                if out:
                    yield _cells(out, asked_cells)
                own_rows = {"deal": pa.array(np.full(rows, name % deals)), "kind": pa.array(np.full(rows, SUMS, np.int32)), "piece": pa.array(np.full(rows, name)), "at": pa.array(np.arange(rows)), "doc_id": piece.column("id"), "held_out": piece.column("held_out"), "n_tokens": pa.array(t.words.counts + 1, pa.int64()), "n_known": pa.array(known), "base": pa.array(sums[0]), "score": pa.array(sums[1])}
                yield pa.RecordBatch.from_arrays([own_rows.get(f.name, pa.nulls(rows, f.type)) for f in asked_cells], schema=asked_cells)

    rare = [x.filter(F.col("c") < top[0]) for x, top in zip((*tables[:2], shares), tops)]
    stored = reduce(DataFrame.unionByName, [entries(x, deals) for x in rare])
    if tops[2][0] > 1:
        stored = stored.unionByName(lone.select("deal", F.col("lone").alias("a"), F.lit(LONE).alias("kind")), allowMissingColumns=True)
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    passes = min(MOST_PASSES, 1 + size // PASS_BYTES)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~training).alias("held_out"))
    tasks = tasks_of(df)
    out = []
    for number in range(passes):
        texts = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == number) if passes > 1 else source
        asked = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"deal bigint, {shape}")
        met = asked.unionByName(stored, allowMissingColumns=True).repartition(tasks, "deal").sortWithinPartitions("deal", "kind")
        back = met.mapInArrow(lambda batches: looked_up(batches, lone_share, cells), shape)
        done = back.groupBy("piece").applyInArrow(lambda found: finished(found, below, scored), result)
        out.append(keep(done, "scores", True))
    sent.destroy()
    rows = reduce(DataFrame.unionByName, out)
    for done in (*tables[:2], lone, shares):
        forget(done)
    return rows.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
