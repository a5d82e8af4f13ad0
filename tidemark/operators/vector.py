"""Exact vector search.

Both sides meet in blocks. A small query side (its size is checked first) is sent to every item
partition, which is read once and never shuffled. A larger one is laid out as a grid: items and
queries are cut into blocks of bounded size, every pair of blocks is one task, and each task keeps
only the best rows per query. Nothing but those rows is shuffled again, and no block grows with a
hot group: a group with more rows simply gets more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import top_rows
from tidemark.session import small_rows, spread

#: Least (of lists, of a grid) and most rows of a block, rows of each side that are scored at once.
BLOCK_ROWS, GRID_ROWS, MOST_BLOCK_ROWS, PIECE_ROWS = 1024, 2048, 8192, 1024
#: Most queries and most items of a pair of blocks when only the best `k` are asked, whose answers are few.
TOP_QUERY_ROWS, TOP_ITEM_ROWS = 16_384, 65_536
#: Tokens that are hashed into vectors at once, about.
PIECE_TOKENS = 1_000_000
BROADCAST_ROWS = 4096
SCORE_DIGITS = 9


def block_size(rows: int) -> int:
    """Rows of a block: a sixteenth of the table, so that there are many tasks, within the bounds."""
    return min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, rows // 16))


def _blocks(block_rows: int | None, most: int = MOST_BLOCK_ROWS, parts: int = 16) -> Column:
    """Number of blocks that an aggregate's rows are cut into: `parts` of them within the bounds, without a given size."""
    n = F.count(F.lit(1))
    size = F.lit(block_rows) if block_rows else F.least(F.lit(most), F.greatest(F.lit(GRID_ROWS), F.ceil(n / parts)))
    return F.ceil(n / size).cast("int")


def _matrix(vectors: Sequence, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i] = v
    return out


def _directions(vectors: Sequence, width: int, epsilon: float) -> np.ndarray:
    """Vectors over their lengths; zeros where there is none."""
    out = _matrix(vectors, width)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out /= (np.sqrt((out * out).sum(axis=1)) + epsilon)[:, None]
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return out


def _first(row: np.ndarray, score: np.ndarray, place: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first `k` of each of `n` rows by score, then place; the k-th best score of each row, -inf for rows with fewer)."""
    order = np.lexsort((place, -score, row))
    row, score = row[order], score[order]
    starts = np.searchsorted(row, np.arange(n))
    first = np.arange(len(row)) - starts[row] < k
    at = starts + k - 1
    ok = at < np.searchsorted(row, np.arange(n), side="right")
    cut = np.full(n, -np.inf)
    cut[ok] = score[at[ok]]
    return order[first], cut


def _best(
    queries: pd.DataFrame, items: pd.DataFrame, k: int | None, threshold, skip_same: bool, epsilon: float, rescore=None
) -> pd.DataFrame:
    """Rows at or above the threshold (one number, or one for each query), at most `k` per query (of ties those with the smallest ids).

    `rescore(cosine matrix, item rows)` gives the score that ranks and is returned. Scores are made for a piece of
    queries and of items at a time; the k-th best so far leaves few rows of the later pieces.
    """
    least = np.broadcast_to(np.asarray(threshold, float), len(queries))
    # missing vectors are dropped here: a filter in the plan would run an embedding function twice
    known = queries["vec"].notna().to_numpy()
    queries, least, items = queries[known], least[known], items[items["vec"].notna()]
    if k is not None:
        items = items.sort_values("iid", kind="stable", na_position="first")  # the place of an item tells ties apart
    frames = []
    q_ids, i_ids = queries["qid"].to_numpy(), items["iid"].to_numpy()
    groups = pd.factorize(np.concatenate([queries["grp"].to_numpy(), items["grp"].to_numpy()]))[0]
    q_groups, i_groups = groups[: len(queries)], groups[len(queries) :]
    one_group = len(groups) > 0 and groups[0] >= 0 and (groups == groups[0]).all()
    q_len, i_len = queries["vec"].map(len).to_numpy(), items["vec"].map(len).to_numpy()
    for width in np.intersect1d(q_len, i_len):
        if width == 0:
            continue
        i_rows = np.flatnonzero(i_len == width)
        x = _directions(items["vec"].to_numpy()[i_rows], width, epsilon)
        for start in range(0, int((q_len == width).sum()), PIECE_ROWS):
            q_rows = np.flatnonzero(q_len == width)[start : start + PIECE_ROWS]
            q = _directions(queries["vec"].to_numpy()[q_rows], width, epsilon)
            cut = np.full(len(q_rows), -np.inf)
            kept = [np.zeros(0, int)] * 2 + [np.zeros(0)]
            for at in range(0, len(i_rows), PIECE_ROWS):
                here = i_rows[at : at + PIECE_ROWS]
                score = q @ x[at : at + PIECE_ROWS].T
                if rescore is None:
                    ok = score >= (np.maximum(least[q_rows], cut) - 1e-8)[:, None]
                else:
                    cosine = np.round(score, SCORE_DIGITS)
                    score = rescore(cosine, items.iloc[here])
                    ok = (cosine >= least[q_rows][:, None]) & (score >= cut[:, None])
                if not one_group:
                    ok &= (q_groups[q_rows][:, None] == i_groups[here][None, :]) & (q_groups[q_rows] >= 0)[:, None]
                if skip_same:
                    ok &= q_ids[q_rows][:, None] != i_ids[here][None, :]
                if k is not None and len(here) > k and not np.isfinite(cut).all():
                    masked = np.where(ok, score, -np.inf)
                    ok &= score >= np.partition(masked, len(here) - k, axis=1)[:, len(here) - k][:, None] - 1e-8
                a, b = np.nonzero(ok)
                found = score[a, b] if rescore is not None else np.round(score[a, b], SCORE_DIGITS)
                reach = found >= np.maximum(least[q_rows[a]], cut[a]) if rescore is None else np.ones(len(a), bool)
                kept = [np.concatenate(p) for p in zip(kept, (a[reach], here[b[reach]], found[reach]), strict=True)]
                if k is not None:
                    still, cut = _first(kept[0], kept[2], kept[1], len(q_rows), k)
                    kept = [p[still] for p in kept]
            frames.append(pd.DataFrame({"qid": q_ids[q_rows[kept[0]]], "iid": i_ids[kept[1]], "score": kept[2]}))
    if not frames:
        return pd.DataFrame({"qid": q_ids[:0], "iid": i_ids[:0], "score": np.zeros(0)})
    return pd.concat(frames, ignore_index=True)


def _grid(side: DataFrame, other: DataFrame, own: str, theirs: str, own_blocks: Column, other_blocks: Column, grouped: bool) -> DataFrame:
    """Give each row its block and one copy per block of the other side in its group; the columns count the blocks of a side."""
    key = "qid" if own == "qb" else "iid"
    if not grouped:
        n_own = side.agg(F.greatest(own_blocks, F.lit(1)).alias("n")).scalar()
        n_other = other.agg(F.greatest(other_blocks, F.lit(1)).alias("n")).scalar()
        placed = side.withColumn(own, F.pmod(F.xxhash64(key), n_own).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), n_other - 1)))
    own_sizes = side.groupBy("grp").agg(own_blocks.alias("n_own"))
    other_sizes = other.groupBy("grp").agg(other_blocks.alias("n_other"))
    sizes = own_sizes.join(other_sizes, "grp")
    placed = side.join(sizes, "grp").withColumn(own, F.pmod(F.xxhash64(key), F.col("n_own")).cast("int"))
    return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("n_other") - 1))).drop("n_own", "n_other")


def similar(
    queries: DataFrame,
    items: DataFrame,
    *,
    k: int | None = None,
    threshold: float = float("-inf"),
    query_id: str = "query_id",
    item_id: str = "id",
    vector: str = "embedding",
    same: str | None = None,
    skip_same_id: bool = False,
    epsilon: float = 0.0,
    extra: Sequence[str] = (),
    rescore=None,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """(query_id, id, score[, rank]): the `k` best items per query with cosine >= `threshold`.

    `same` names a column both sides must agree on. Vectors of different length never match; a
    zero vector scores 0. Without `k` every pair above the threshold is returned. With `rescore`,
    a function of the cosine matrix and the item rows (with their `extra` columns), the cut to `k`
    follows the new score, so a blended ranking still keeps only `k` rows per query and task.
    """
    group = F.col(same) if same else F.lit(0)
    q = queries.select(F.col(query_id).alias("qid"), group.alias("grp"), F.col(vector).alias("vec"))
    x = items.select(F.col(item_id).alias("iid"), group.alias("grp"), F.col(vector).alias("vec"), *extra)
    schema = f"qid {q.schema['qid'].dataType.simpleString()}, iid {x.schema['iid'].dataType.simpleString()}, score double"
    local = small_rows(q, broadcast_rows) if broadcast_rows else None
    if local is not None:
        sent = items.sparkSession.sparkContext.broadcast(local)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _best(sent.value, batch, k, threshold, skip_same_id, epsilon, rescore)

        found = spread(x).mapInPandas(scan, schema)
    else:
        # of the best k little is kept, so blocks can be long, of items above all: a query meets few of them and leaves k rows at each
        asked, held = (_blocks(block_rows),) * 2 if k is None else (_blocks(block_rows, TOP_QUERY_ROWS), _blocks(block_rows, TOP_ITEM_ROWS, 4))
        left = _grid(q, x, "qb", "ib", asked, held, same is not None).groupBy("grp", "qb", "ib")
        right = _grid(x, q, "ib", "qb", held, asked, same is not None).groupBy("grp", "qb", "ib")

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _best(a, b, k, threshold, skip_same_id, epsilon, rescore)

        found = left.cogroup(right).applyInPandas(pair, schema)
    found = found.select(F.col("qid").alias(query_id), F.col("iid").alias(item_id if item_id != query_id else "id"), "score")
    out_id = item_id if item_id != query_id else "id"
    if k is None:
        return found
    return top_rows(found, [query_id], [F.col("score").desc(), F.col(out_id)], k)


def _hashed(rows: pa.ListArray, dim: int) -> pa.ListArray:
    """The vector of every list of tokens; a token is digested once for all lists."""
    words = rows.flatten().dictionary_encode()
    codes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:5], 16) for w in words.dictionary.to_pylist()], np.int64)
    numbers = codes[words.indices.to_numpy()]
    owner = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
    values = np.bincount(owner * dim + (numbers >> 4) % dim, np.where(numbers & 1, -1.0, 1.0), len(rows) * dim).astype(float).reshape(len(rows), dim)
    length = np.sqrt((values * values).sum(axis=1, keepdims=True))
    values = np.divide(values, length, out=values, where=length > 0).astype(np.float32)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, dim, dtype=np.int32), values.ravel())


def embed(df: DataFrame, col: str, fn=None, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Add a vector per text, computed per Arrow batch.

    `fn` maps a list of texts to a list of vectors (for example a model client). The default hashes
    the search tokens into `dim` signed buckets and scales the result to length one.
    """
    from tidemark.functions import text as tx

    if fn is not None:

        @F.pandas_udf("array<float>")
        def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in fn(texts.tolist())])

        return df.withColumn(out, model(F.col(col)))

    @F.arrow_udf("array<float>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // PIECE_TOKENS)) + 1
            yield pa.concat_arrays([_hashed(rows[a:z], dim) for a, z in zip([0, *cuts], [*cuts, len(rows)])])

    return spread(df).withColumn(out, hashed(tx.bm25_tokens(F.col(col))))


def score_pairs(pairs: DataFrame, fn, columns: Sequence[str], out: str = "given_score") -> DataFrame:
    """Add scores from a user function over the named columns, one Arrow batch at a time."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.asarray(fn(*[batch[c] for c in batch.columns]), dtype=float))

    return pairs.withColumn(out, scored(F.struct(*[F.col(c) for c in columns])))


def blended(semantic: Column, hot: Column, alpha: float) -> Column:
    return (1.0 - alpha) * semantic + alpha * hot
