"""Nearest neighbours by an inverted file: vectors in lists around trained centres, probed list by list.

Build. Spark ML's k-means (cosine) fits about one centre for every LIST_ROWS vectors, at most MOST_LISTS, on a
sample whose size is a parameter; every vector is then filed under its nearest centre with its angle to it.
A list knows its rows and its largest angle (radius). Vectors of another width, zero vectors and tables too
small for a fit lie in a list without a centre.

Search. By the triangle inequality of angles no vector of a list is nearer to a question than
(angle to the centre - radius). The exact mode scores the nearest lists first; the k-th best score there
(or the threshold) is a floor, and of the other lists only those that can reach the floor are probed, and
in them only the rows whose own angle can. The fast mode probes a fixed number of lists and says nothing about
the rest; `recall` measures what it finds.

Layout. Near lists stand on one shelf. A question is copied once for each shelf with a list that it probes, and rows
once for each block of questions that looks at their shelf; which lists of a shelf a question probes is found again
where they meet. Shelves and blocks have bounded sizes, also when one list holds a third of all rows. So
with well parted vectors the shuffle follows the number of rows. Without any structure (random directions) the
exact mode must probe nearly all lists, as any exact search must, and then copies no more than a grid of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.vector import _best, block_size
from tidemark.operators.windows import top_rows
from tidemark.sources import versions

#: Rows that a list has on average, most lists, rows for each list in the sample of a fit.
LIST_ROWS, MOST_LISTS, SAMPLE_PER_LIST = 256, 1024, 64
#: Questions whose probes are chosen at once, copies of them in a frame, share of probed lists from which a shelf is scored whole.
SLICE_ROWS, OUT_ROWS, DENSE_SHARE = 1024, 4096, 0.25
ROUNDS, SEED = 5, 7
#: Angles are rounded up by this much (radians), so that no last bit leaves a list out.
SLACK = 1e-5
NO_CENTRE = -1


def fit_centres(items: DataFrame, vector: str, n_lists: int, width: int, sample_rows: int) -> np.ndarray:
    """Centres of length one, n x width, from a sample of about `sample_rows` vectors of that width."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    usable = items.filter(F.size(vector) == width).select(F.col(vector).cast("array<double>").alias("v"), length.alias("length")).filter("length > 0 AND length < double('infinity')")
    known = usable.count()
    if n_lists < 2 or known < 2 * n_lists:
        return np.zeros((0, width))
    part = usable.sample(min(1.0, sample_rows / known), seed=SEED) if known > sample_rows else usable
    model = KMeans(k=n_lists, maxIter=ROUNDS, seed=SEED, distanceMeasure="cosine").fit(part.select(array_to_vector("v").alias("features")))
    found = np.array(model.clusterCenters())
    norms = np.linalg.norm(found, axis=1)
    return found[norms > 0] / norms[norms > 0][:, None]


def angles(vectors: Sequence, centres: np.ndarray) -> np.ndarray:
    """Angles to all centres, rows x centres; NaN in rows of another width or without a direction."""
    width = centres.shape[1]
    out = np.full((len(vectors), len(centres)), np.nan)
    rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
    if rows and len(centres):
        x = np.stack([np.asarray(vectors[i], float) for i in rows])
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (x @ centres.T) / norm[:, None]
            out[rows] = np.where(np.isfinite(cosine), np.arccos(np.clip(cosine, -1.0, 1.0)), np.nan)
    return out


@dataclass
class Lists:
    """A stored inverted file: `rows` has list, angle and the item's columns; `heads` one row for each list."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return versions.read_current(self.spark, f"{self.path}/rows")

    @property
    def heads(self) -> DataFrame:
        return self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))


def build_lists(items: DataFrame, path: str, *, item_id: str = "id", vector: str = "embedding", same: str | None = None, extra: Sequence[str] = (), n_lists: int | None = None, sample_rows: int | None = None) -> Lists:
    """File every row of `items` that has a vector under its nearest centre and write the lists below `path`."""
    group = F.col(same) if same else F.lit(0)
    known = items.filter(F.col(vector).isNotNull())
    n = known.count()
    n_lists = max(1, min(MOST_LISTS, n // LIST_ROWS)) if n_lists is None else n_lists
    width = known.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    centres = fit_centres(known, vector, n_lists, width[0].w, sample_rows or SAMPLE_PER_LIST * n_lists) if width else np.zeros((0, 1))
    sent = items.sparkSession.sparkContext.broadcast(centres)  # MOST_LISTS x width numbers at most
    source = known.select(F.col(item_id).alias("iid"), group.alias("grp"), F.col(vector).alias("vec"), *extra)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = angles(batch["vec"].to_numpy(), sent.value)
            placed = ~np.isnan(found).all(axis=1) if found.shape[1] else np.zeros(len(batch), bool)
            nearest = np.full(len(batch), NO_CENTRE)
            angle = np.full(len(batch), np.nan)
            if placed.any():
                nearest[placed] = np.argmin(found[placed], axis=1)
                angle[placed] = found[placed, nearest[placed]]
            yield batch.assign(list=nearest.astype(np.int32), angle=np.where(placed, angle, 0.0))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    filed = source.mapInPandas(file, f"{fields}, list int, angle double")
    versions.publish(filed.repartitionByRange(F.col("list"), F.col("angle"), F.col("iid")).sortWithinPartitions("list", "angle"), f"{path}/rows")
    return Lists(items.sparkSession, path, centres)


def _walk(centres: np.ndarray) -> np.ndarray:
    """Centre numbers in an order in which neighbours are near: each time the nearest one not yet visited."""
    left, order = np.ones(len(centres), bool), []
    at = 0
    while left.any():
        left[at] = False
        order.append(at)
        at = int(np.argmax(np.where(left, centres @ centres[at], -np.inf)))
    return np.array(order, int)


def _shelves(lists: Lists, block_rows: int) -> pd.DataFrame:
    """A row for each list, with its shelf: near lists stand together, about `block_rows` rows on a shelf."""
    heads = lists.heads.toPandas()  # MOST_LISTS + 1 rows at most
    place = np.empty(len(lists.centres), int)
    place[_walk(lists.centres)] = np.arange(len(lists.centres))
    heads["place"] = [place[n] if n >= 0 else -1 for n in heads["list"]]
    heads = heads.sort_values("place", kind="stable").reset_index(drop=True)
    heads["shelf"] = (heads["n"].cumsum() - heads["n"]) // block_rows
    return heads


def _reach(to_centre: np.ndarray, radius: np.ndarray, floor: np.ndarray, epsilon: float) -> np.ndarray:
    """Questions x lists: whether a list can hold a row at or above the question's floor; unknown angles can."""
    best = np.cos(np.maximum(to_centre - radius - SLACK, 0.0))  # no row of the list is nearer
    if epsilon:
        best = np.maximum(best, 0.0)  # short vectors are drawn towards 0
    return np.isnan(best) | (best >= floor[:, None] - 1e-9)


def _list_angles(vectors: Sequence, centres: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Angles to the centres of the lists `number`; NaN for the list without a centre."""
    out = np.full((len(vectors), len(number)), np.nan)
    placed = number >= 0
    if placed.any():
        out[:, placed] = angles(vectors, centres[number[placed]])
    return out


def _probes(lists: Lists, questions: DataFrame, heads: pd.DataFrame, epsilon: float, nearest: int | None, first: int = 0) -> DataFrame:
    """The questions (with their `floor`), once for each shelf to look at, and `only`: the lists to probe there.

    With `nearest`, the lists from place `first` to that one in the order of the least possible angle (those without
    a centre always). Else `only` is missing, and of the shelves with a list that can reach the floor all such lists
    are meant. Without a column `shelf` in `heads` each list is a shelf.
    """
    heads = heads.assign(shelf=heads["shelf"] if "shelf" in heads else heads["list"]).sort_values("shelf", kind="stable")
    sent = lists.spark.sparkContext.broadcast((lists.centres, heads["list"].to_numpy(np.int64), heads["radius"].to_numpy(float), heads["shelf"].to_numpy(np.int64)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, number, radius, shelf = sent.value
        if not len(number):
            return
        names, starts = np.unique(shelf, return_index=True)
        free = int((number < 0).sum())
        for batch in batches:
            for start in range(0, len(batch), SLICE_ROWS):  # a slice goes out before the next one is copied
                some = batch.iloc[start : start + SLICE_ROWS]
                here = _list_angles(some["vec"].to_numpy(), centres, number)
                if nearest is None:
                    take = _reach(here, radius, some["floor"].to_numpy(float), epsilon)
                else:
                    least = np.where(number < 0, -1.0, np.where(np.isnan(here), 0.0, np.maximum(here - radius - SLACK, 0.0)))
                    rank = np.argsort(np.argsort(least, axis=1, kind="stable"), axis=1, kind="stable")
                    take = (rank < free) | ((rank >= free + first) & (rank < free + nearest))
                row, at = np.nonzero(np.logical_or.reduceat(take, starts, axis=1))
                for cut in range(0, len(row), OUT_ROWS):
                    r, c = row[cut : cut + OUT_ROWS], names[at[cut : cut + OUT_ROWS]]
                    only = [None if nearest is None else number[take[i] & (shelf == j)].tolist() for i, j in zip(r, c, strict=True)]
                    yield some.iloc[r].reset_index(drop=True).assign(shelf=c.astype(np.int32), only=pd.Series(only, dtype=object))

    return questions.mapInPandas(choose, f"{fields}, shelf int, only array<int>")


def _meet(lists: Lists, probes: DataFrame, heads: pd.DataFrame, k: int | None, skip_same: bool, epsilon: float, rescore, block_rows: int) -> DataFrame:
    """Rows of the probed lists at or above the floor, block by block: (qid, iid, score), best k of a block."""
    shelf_of = F.broadcast(lists.spark.createDataFrame([(int(a), int(b)) for a, b in zip(heads["list"], heads["shelf"], strict=True)], "list int, shelf int"))
    rows = lists.rows.join(shelf_of, "list")
    asked = probes.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_blocks"))
    held = rows.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("i_blocks"))
    sizes = F.broadcast(asked.join(held, "shelf"))  # MOST_LISTS + 1 rows at most
    spread = lambda df, key, own, other: df.join(sizes, "shelf").withColumn("own", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("q_blocks", "i_blocks")
    left = spread(probes, "qid", "q_blocks", "i_blocks").withColumnsRenamed({"own": "qb", "other": "ib"})
    right = spread(rows, "iid", "i_blocks", "q_blocks").withColumnsRenamed({"own": "ib", "other": "qb"})
    schema = f"qid {probes.schema['qid'].dataType.simpleString()}, iid {rows.schema['iid'].dataType.simpleString()}, score double"
    sent = lists.spark.sparkContext.broadcast((lists.centres, dict(zip(heads["list"].tolist(), heads["radius"].tolist(), strict=True))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k, a["floor"].to_numpy(float), skip_same, epsilon, rescore)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return best(a, b)
        centres, radius = sent.value
        number = np.unique(b["list"].to_numpy(np.int64))
        here = _list_angles(a["vec"].to_numpy(), centres, number)
        if a["only"].notna().all():
            wanted = [set(x) for x in a["only"]]
            take = np.array([[n in w for n in number.tolist()] for w in wanted])
            parted = True
        else:
            take = _reach(here, np.array([radius[n] for n in number.tolist()]), a["floor"].to_numpy(float), epsilon)
            parted = take.mean() < DENSE_SHARE  # else the whole shelf at once, which is only more work
        if not parted:
            return best(a, b)
        floor = a["floor"].to_numpy(float)
        reach = np.where(floor <= (0.0 if epsilon else -1.0), np.pi, np.arccos(np.clip(floor - 1e-9, -1.0, 1.0)) + SLACK)
        frames = []
        for at, rows in b.groupby("list"):
            j = int(np.searchsorted(number, at))
            some = np.flatnonzero(take[:, j])
            if len(some):
                angle = here[some, j]
                low, high = np.where(np.isnan(angle), -1.0, angle - reach[some]).min(), np.where(np.isnan(angle), 9.0, angle + reach[some]).max()
                frames.append(best(a.iloc[some], rows[(rows["angle"] >= low) & (rows["angle"] <= high)]))
        return pd.concat(frames, ignore_index=True) if frames else best(a[:0], b[:0])

    return left.groupBy("shelf", "qb", "ib").cogroup(right.groupBy("shelf", "qb", "ib")).applyInPandas(pair, schema)


def search_lists(lists: Lists, queries: DataFrame, *, k: int | None = None, threshold: float = float("-inf"), query_id: str = "query_id", item_id: str = "id", vector: str = "embedding", same: str | None = None, skip_same_id: bool = False, epsilon: float = 0.0, rescore=None, probes: int | None = None, first_lists: int = 2, block_rows: int | None = None) -> DataFrame:
    """What `vector.similar` returns: exact without `probes`, else from so many lists for each question.

    `rescore` changes the order within the floor by cosine only if it never ranks a lower cosine above a
    higher one; with other functions give no `k` here and cut afterwards.
    """
    if rescore is not None and k is not None:
        raise ValueError("the floor follows the cosine: rescore without k and cut afterwards")
    group = F.col(same) if same else F.lit(0)
    questions = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("qid"), group.alias("grp"), F.col(vector).alias("vec"))
    questions = questions.withColumn("floor", F.lit(threshold))
    block_rows = block_rows or block_size(lists.rows.count())
    heads = _shelves(lists, block_rows)
    meet = lambda p: _meet(lists, p, heads, k, skip_same_id, epsilon, rescore, block_rows)
    order = [F.col("score").desc(), F.col("iid")]
    if probes is not None:
        found = meet(_probes(lists, questions, heads, epsilon, probes))
    elif k is None:
        found = meet(_probes(lists, questions, heads, epsilon, None))
    else:
        first = meet(_probes(lists, questions, heads, epsilon, first_lists))
        floor = top_rows(first, ["qid"], order, k).filter(F.col("rank") == k).select("qid", F.greatest("score", F.lit(threshold)).alias("least"))
        asked = questions.join(floor, "qid", "left").withColumn("floor", F.coalesce("least", "floor")).drop("least")
        found = meet(_probes(lists, asked, heads, epsilon, None))  # the first rows reach the floor, so they are found again
    out_id = item_id if item_id != query_id else "id"
    found = found.select(F.col("qid").alias(query_id), F.col("iid").alias(out_id), "score")
    return found if k is None else top_rows(found, [query_id], [F.col("score").desc(), F.col(out_id)], k)


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", item_id: str = "id") -> float:
    """Share of the pairs of `truth` that are in `found` as well."""
    total = truth.count()
    return truth.join(found, [query_id, item_id], "left_semi").count() / total if total else 1.0
