"""A substring index that is kept up to date: trigrams of texts in merge-on-read tables.

Each change adds the trigrams of the changed texts as one delta and marks those of earlier versions as dead
(see `sources.deltas`); deltas are compacted in tiers. A term is looked up by its rarest trigrams: texts that
hold all of them are candidates, which the text itself then confirms. Keys are not null. Trigrams are of lowered text and
characters, so any script works; terms below three characters have none and scan the texts.

Both tables of an index name the batch they hold, so a batch that is run again is applied once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.windows import top_rows
from tidemark.session import checked_side, spread
from tidemark.sources.deltas import DeltaTable

SIZE = 3
#: Trigrams of a term that are intersected, the rarest first.
RAREST = 3
#: Different trigrams of all terms of a search that are sent to the postings.
SENT = 100_000
#: Trigrams that are asked of the files themselves, short terms that are searched in a text one by one, characters whose trigrams are made at once.
ASKED, SCANNED, PIECE_CHARS = 1_000, 64, 4_000_000


def trigrams_of(text: Column) -> Column:
    """Different trigrams of a text, lowered."""
    chars = tx.characters(F.lower(F.coalesce(text, F.lit(""))))
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(tx.pairs(chars), F.lit(1), n), F.slice(chars, F.lit(3), n), lambda pair, last: F.concat(pair, last)))


def _grams(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, gram) of the different trigrams of lowered texts `low`; those of some texts together in the order of trigrams, so that files can be skipped in pages."""
    for batch in batches:
        texts = batch.column("low").to_pylist()
        ends = np.cumsum([len(t or "") for t in texts])
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_CHARS, side="right")))
            part = [t or "" for t in texts[start:stop]]
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
            if len(points) >= SIZE:
                inside = owner[2:] == owner[:-2]
                code, of = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside], owner[2:][inside]
                order = np.lexsort((of, code))
                code, of = code[order], of[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
                code, of = code[new], of[new]
                known, name = np.unique(code, return_inverse=True)
                names = [chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in known.tolist()]
                at = pa.array(start + of)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], pa.array(names, pa.string()).take(pa.array(name))], names=[*keys, "gram"])
            start = stop


class TrigramIndex:
    """Texts by key with their trigrams, below `path`."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], text: str = "content") -> None:
        self.spark, self.keys, self.text = spark, list(keys), text
        self.texts = DeltaTable(spark, f"{path}/texts", keys)
        self.grams = DeltaTable(spark, f"{path}/grams", keys)

    def change(self, rows: DataFrame, deleted: DataFrame | None = None, batch: str | None = None) -> None:
        """Insert or replace the rows of their keys; drop the keys in `deleted`."""
        gone = rows.select(*self.keys)  # also of texts that have no trigram now
        gone = gone if deleted is None else gone.unionByName(deleted.select(*self.keys))
        self.texts.change(rows, deleted, batch)
        keys = self.keys
        texts = spread(rows.select(*keys, self.text)).select(*keys, F.lower(F.col(self.text)).alias("low"))
        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        self.grams.change(texts.mapInArrow(lambda batches: _grams(batches, keys), f"{kinds}, gram string"), gone, batch)

    def search(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """(term, the columns of the texts) of all texts that contain the term, whatever its case."""
        low = F.lower(F.col(term))
        asked = terms.select(F.col(term), low.alias("__low")).filter(F.length("__low") > 0).distinct()
        texts = self.texts.read()
        long_terms = asked.filter(F.length("__low") >= SIZE)
        grams = long_terms.select(term, F.explode(trigrams_of(F.col("__low"))).alias("gram"))
        grams, small = checked_side(grams, SENT)
        wanted = grams.select("gram").distinct()
        few = [r.gram for r in wanted.limit(ASKED + 1).collect()] if small else None
        if few is not None and len(few) <= ASKED:
            met = lambda posts: posts.filter(F.col("gram").isin(few))
        else:
            met = lambda posts: posts.join(F.broadcast(wanted) if small else wanted, "gram", "left_semi")
        posts = self.grams.read(among=met)  # postings of other trigrams are not held against later changes
        counts = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # a trigram that no text has makes its term impossible: it counts as the rarest, and nothing meets it
        ranked = grams.join(counts, "gram", "left").fillna(0, ["n"])
        rarest = top_rows(ranked, [term], [F.col("n"), F.col("gram")], RAREST, "rank")
        needed = rarest.groupBy(term).agg(F.count(F.lit(1)).alias("needed"))
        found_in = posts.join(rarest.select(term, "gram"), "gram").groupBy(term, *self.keys).agg(F.count(F.lit(1)).alias("n"))
        likely = found_in.join(needed, term).filter("n = needed").select(term, *self.keys)
        found = likely.join(texts, self.keys).filter(F.contains(F.lower(F.col(self.text)), F.lower(F.col(term))))
        short, bounded = checked_side(asked.filter(F.length("__low") < SIZE), SENT)
        if bounded and short.isEmpty():
            return found
        asked_short = [tuple(r) for r in short.limit(SCANNED + 1).collect()] if bounded else []
        if bounded and len(asked_short) <= SCANNED:
            pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(low).alias("low")) for t, low in asked_short])
            low = F.lower(F.col(self.text))
            hits = tx.let(low, lambda body: F.filter(pairs, lambda x: F.contains(body, x["low"])))
            return found.unionByName(texts.withColumn(term, F.explode(hits["term"])).select(found.columns))
        held = texts.withColumn("__part", F.explode(_parts(F.col(self.text))))
        scanned = held.join(short.withColumnRenamed("__low", "__part"), "__part").select(found.columns)
        return found.unionByName(scanned)


def _parts(text: Column) -> Column:
    """Different single characters and pairs of a text, lowered: what a short term can be."""
    chars = tx.characters(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_distinct(F.concat(chars, tx.pairs(chars)))
