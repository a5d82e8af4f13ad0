"""Texts that resemble earlier ones, compared exactly in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.session import checkpoint_root, spread

SIMILAR_AT = 0.45
#: Least and most rows of a block, rows of each side that are compared at once.
BLOCK_ROWS, MOST_BLOCK_ROWS, PIECE_ROWS = 1024, 16384, 1024
#: Pairs of rows that share a character pair from which it is cheaper as a column of a matrix, and such columns at once.
DENSE_PAIRS, DENSE_COLUMNS = 500, 4096
#: Such chunks of columns that a piece keeps (16 MB each).
KEPT_CHUNKS = 4
#: Relative error that a quotient of short floats may have.
SLACK = 1e-6


class Side:
    """The texts of a block in the order of their ids: numbers of the character pairs that both blocks hold."""

    def __init__(self, sizes: np.ndarray, grams: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.order, self.rank, self.sizes = order, rank[order], sizes[order].astype(np.float32)
        self.row, self.gram = np.repeat(place, sizes), grams
        self.best, self.pick = np.full(len(order), -1.0), np.full(len(order), -1)

    def number(self, common: np.ndarray, column: np.ndarray) -> None:
        """Names pairs by their column and leaves out those that are not in `common`."""
        at = np.minimum(np.searchsorted(common, self.gram), max(0, len(common) - 1))
        use = common[at] == self.gram if len(common) else np.zeros(len(at), bool)
        row, col = self.row[use], column[at[use]]
        order = np.argsort(row, kind="stable")
        self.row, self.col, self.gram = row[order], col[order], None

    def piece(self, start: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """(its rows, the row of each entry, the column)."""
        stop = min(start + PIECE_ROWS, len(self.rank))
        a, b = np.searchsorted(self.row, [start, stop])
        return slice(start, stop), self.row[a:b] - start, self.col[a:b]

    def better(self, rows: slice, score: np.ndarray, both: np.ndarray, other: Side, cols: slice) -> None:
        """Put the best column of each row of `score` (of equal ones the smallest id) where it beats what is known."""
        top = score.max(axis=1)
        found = np.flatnonzero(top >= np.maximum(self.least, self.best[rows] * (1 - SLACK)))
        if not len(found):
            return
        r, c = np.nonzero(score[found] >= (top[found] * np.float32(1 - SLACK))[:, None])
        r = found[r]
        k = both[r, c].astype(np.float64)
        exact = np.round(k / (self.sizes[rows][r].astype(np.float64) + other.sizes[cols][c] - k), 9)
        order = np.lexsort((c, -exact, r))  # columns follow the ids
        r, c, exact = r[order], c[order], exact[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        at, exact, pick = rows.start + r[first], exact[first], other.rank[cols][c[first]]
        more = (exact > self.best[at]) | ((exact == self.best[at]) & (pick < self.pick[at]))
        self.best[at[more]], self.pick[at[more]] = exact[more], pick[more]


def _dense(size: int, row: np.ndarray, col: np.ndarray, first: int, last: int) -> np.ndarray:
    out = np.zeros((size, last - first), np.float32)
    use = (col >= first) & (col < last)
    out[row[use], col[use] - first] = 1.0
    return out


def _shared(a: tuple, b: tuple, wide: int, kept: list[np.ndarray]) -> np.ndarray:
    """Number of common character pairs of every row of both pieces; columns from `wide` on are met one by one."""
    (rows, ra, ca), (cols, rb, cb) = a, b
    n, m = rows.stop - rows.start, cols.stop - cols.start
    both = np.zeros((n, m), np.float32)
    for i, first in enumerate(range(0, wide, DENSE_COLUMNS)):
        last = min(wide, first + DENSE_COLUMNS)
        if i == len(kept) < KEPT_CHUNKS:
            kept.append(_dense(m, rb, cb, first, last))
        both += _dense(n, ra, ca, first, last) @ (kept[i] if i < len(kept) else _dense(m, rb, cb, first, last)).T
    thin, few = ca >= wide, np.flatnonzero(cb >= wide)
    if thin.any() and len(few):
        few = few[np.argsort(cb[few], kind="stable")]
        keys = cb[few]
        start, stop = np.searchsorted(keys, ca[thin], "left"), np.searchsorted(keys, ca[thin], "right")
        n_met = stop - start
        at = np.arange(n_met.sum()) - np.repeat(np.cumsum(n_met) - n_met, n_met) + np.repeat(start, n_met)
        flat = np.repeat(ra[thin].astype(np.int64), n_met) * m + rb[few[at]]
        both += np.bincount(flat, minlength=n * m).reshape(n, m)
    return both


def _best(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For every row of both blocks the most similar row with a smaller id in the other one; a block of its own is given as `b` too."""
    twice = a is not b
    frames = (a, b) if twice else (a,)
    names, rank = np.unique(np.concatenate([x["id"].to_numpy() for x in frames]), return_inverse=True)
    grams = [np.concatenate([np.zeros(0, np.int64), *x["g"]]).astype(np.int64) for x in frames]
    counted = [np.unique(x, return_counts=True) for x in grams]
    common, at, bt = np.intersect1d(counted[0][0], counted[-1][0], assume_unique=True, return_indices=True)
    pairs = counted[0][1][at] * counted[-1][1][bt] * min(1.0, PIECE_ROWS / len(a)) * min(1.0, PIECE_ROWS / len(b))
    order = np.argsort(-pairs, kind="stable")
    column = np.empty(len(common), np.int32)
    column[order] = np.arange(len(order), dtype=np.int32)
    wide = int((pairs >= DENSE_PAIRS).sum())
    sides = [Side(x["g"].map(len).to_numpy(), g, r) for x, g, r in zip(frames, grams, np.split(rank, [len(a)] if twice else []))]
    del grams
    for side in sides:
        side.number(common, column)
        side.least = np.float32(threshold * (1 - SLACK))
    x, y = sides[0], sides[-1]
    for start in range(0, len(b), PIECE_ROWS):
        right, kept = y.piece(start), []
        cols = right[0]
        for first in range(0 if twice else start, len(a), PIECE_ROWS):
            left = x.piece(first)
            rows = left[0]
            both = _shared(left, right, wide, kept)
            score = x.sizes[rows, None] + y.sizes[None, cols]
            score -= both
            np.divide(both, score, out=score)
            one, other = x.rank[rows], y.rank[cols]
            if other[-1] < one[0]:
                x.better(rows, score, both, y, cols)
            elif twice and one[-1] < other[0]:
                y.better(cols, score.T, both.T, x, rows)
            else:
                x.better(rows, np.where(other[None] < one[:, None], score, np.float32(-1)), both, y, cols)
                if twice:
                    y.better(cols, np.where(one[None] < other[:, None], score.T, np.float32(-1)), both.T, x, rows)
    found = []
    for side in sides:
        ok = np.flatnonzero(side.best >= threshold)
        found.append(pd.DataFrame({"id": names[side.rank[ok]], "similar_id": names[side.pick[ok]], "score": side.best[ok]}))
    return pd.concat(found, ignore_index=True)


def _pair_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and g, the different pairs of neighbouring characters of a text as numbers built from both code points."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(start, PIECE_ROWS)
            sets = []
            for text in part.column("text").to_pylist():
                points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                sets.append(np.unique(points[:-1] * 2097152 + points[1:]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            g = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([part.column("id"), g], names=["id", "g"])


def near_dups(df: DataFrame, threshold: float = SIMILAR_AT, id_col: str = "id", text_col: str = "text", block_rows: int | None = None) -> DataFrame:
    """For every text the most similar earlier one (smaller id) by Jaccard of character pairs.

    Output: id, similar_id, score, for scores at or above the threshold. Texts are laid out in
    blocks; each pair of blocks is one task that keeps only the best match per text of either side, so neither a
    task nor its output grows with the number of similar texts. Block pairs that cannot reach the
    threshold by set size are never formed: blocks follow the set size. A text is copied once for each near block:
    all pairs are compared, so work and shuffle stay quadratic, with a quarter of a level's texts, 16,384 at most, in a block.
    The sets of the texts are made once and written to the folder of checkpoints.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    texts = spread(df).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tx.squash(F.lower(F.col(text_col)), "").alias("text"))
    sets, spark = f"{checkpoint_root(df.sparkSession)}/pairs-{uuid4().hex}", df.sparkSession
    texts.mapInArrow(_pair_sets, f"id {id_type}, g array<bigint>").filter(F.size("g") > 0).write.parquet(sets)
    coded = spark.read.parquet(sets)
    sized = coded.withColumn("level", F.floor(F.log(F.size("g").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    n = F.count(F.lit(1))
    rows = F.lit(block_rows) if block_rows else F.least(F.lit(MOST_BLOCK_ROWS), F.greatest(F.lit(BLOCK_ROWS), F.floor(n / 4)))
    counts = sized.groupBy("level").agg(F.ceil(n / rows).cast("int").alias("n_blocks"))
    placed = sized.join(counts, "level").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    # a/b >= threshold bounds the distance of two size levels; a pair of blocks is formed once, by its lower one
    reach = int(np.ceil(np.log(1.0 / threshold) / np.log(1.25))) + 1
    levels = counts.select(F.col("level").alias("o_level"), F.col("n_blocks").alias("o_blocks"))
    near = counts.select("level", F.explode(F.sequence(F.col("level") - reach, F.col("level") + reach)).alias("o_level")).join(levels, "o_level")
    copied = placed.join(near, "level").withColumn("o_block", F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)))
    own, other = F.struct("level", "block"), F.struct(F.col("o_level").alias("level"), F.col("o_block").alias("block"))
    left = copied.filter(own <= other).select("id", "g", F.col("level").alias("la"), F.col("block").alias("ba"), F.col("o_level").alias("lb"), F.col("o_block").alias("bb"))
    right = copied.filter(other < own).select("id", "g", F.col("o_level").alias("la"), F.col("o_block").alias("ba"), F.col("level").alias("lb"), F.col("block").alias("bb"))

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if key[:2] == key[2:]:
            b = a
        if a.empty or b.empty:
            return pd.DataFrame({"id": a["id"][:0], "similar_id": b["id"][:0], "score": np.zeros(0)})
        return _best(a, b, threshold)

    keys = ["la", "ba", "lb", "bb"]
    right = right.toDF("id", "g", *keys)
    # pairs of blocks are much work for few bytes: a given number keeps them from being put together by size
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"id {id_type}, similar_id {id_type}, score double")
    order = F.struct(F.col("score"), -F.col("similar_id")) if id_type in ("bigint", "int") else F.struct("score", "similar_id")
    return found.groupBy("id").agg(F.max_by(F.struct("similar_id", "score"), order).alias("m")).select("id", "m.similar_id", "m.score")
