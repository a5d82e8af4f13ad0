"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of MinHash tuples are computed per document, A with `a` tuples and B with `b`.
A table key joins one tuple of A with one of B, so a * b tables need only (a + b) * rows MinHash
values. Documents that share a key are candidates. At similarity 0.8 with the defaults a pair is
missed with a probability below 0.0004.

Exact copies (equal sets) are merged before anything is compared. Every document meets one centre first, the
most shared of its buckets' centres; confirmed links give components, and only between different ones
do documents meet the other centres of their buckets. Where a bucket still holds several components, their
documents are joined by their rarest shingles: linked ones share one early in the order. Components with such
documents are compared in full, block by block, so no link between documents of one bucket is lost.

Texts without words have no set: they are linked with nothing and stay. One word (or fewer words than
a shingle) is one shingle. Every row is a document of its own, also when ids repeat or are null: the
component's id is the smallest id in it (null if all are null), and one row of each component is kept,
the one with that id (of several the first read).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import bloom
from tidemark.llm.batches import Words, carrying, mix, pieces, shingles, signed
from tidemark.llm.graph import components, extend
from tidemark.llm.store import keep

#: Tuples in either collection, and MinHash values in a tuple.
A_TUPLES, B_TUPLES, ROWS = 12, 12, 3
PERCENT = 80
#: Documents of one component that one task compares with those of others.
BLOCK = 128


class PlacedWords(Words):
    """Words hashed by a sum over (place, byte) pairs, each mixed for itself: unlike for a polynomial, no family of
    strings is known that collides."""

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        letters = self.data[place + np.repeat(self.starts, sizes)]
        parts = mix((place.astype(np.uint64) << np.uint64(8) | letters) + np.uint64(0x9E3779B97F4A7C15))
        return mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64))


def _distinct(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every text in order, bounds)."""
    h, bounds = shingles(PlacedWords(column), size)
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])


def _tuples(h: np.ndarray, bounds: np.ndarray, count: int, rows: int, seed: int) -> np.ndarray:
    """texts x count keys, each from `rows` MinHash values; only for texts that have shingles."""
    numbers = mix(np.arange(1, count * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    for k in range(count):
        key = np.full(len(out), k + 1 + 1000 * seed, np.uint64)
        for r in range(rows):
            n = numbers[k * rows + r]
            least = np.minimum.reduceat((h ^ (n >> np.uint64(1))) * n, bounds[:-1])
            key = mix(key * np.uint64(0xA0761D6478BD642F) + least)
        out[:, k] = key
    return out


def signatures(df: DataFrame, text_col: str, size: int, a: int = A_TUPLES, b: int = B_TUPLES, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """n_shingles, s1, s2 (hash of the whole set), ka, kb (tuple keys; null without shingles), text and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                h, bounds = _distinct(piece.column("text"), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                keys: list[list] = [[None] * len(n), [None] * len(n)]
                if len(full):
                    edges = np.append(bounds[full], bounds[-1])
                    sums[0, full] = np.add.reduceat(h, bounds[full])
                    sums[1, full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
                    for side, count in ((0, a), (1, b)):
                        found = signed(_tuples(h, edges, count, rows, side + 1)).tolist()
                        for i, row in zip(full.tolist(), found, strict=True):
                            keys[side][i] = row
                columns = [pa.array(n, pa.int64()), pa.array(signed(sums[0])), pa.array(signed(sums[1])), *[pa.array(k, pa.list_(pa.int64())) for k in keys], piece.column("text")]
                yield pa.RecordBatch.from_arrays(columns + [piece.column(f"c{i}") for i in range(len(carry))], names=["n_shingles", "s1", "s2", "ka", "kb", "text", *carry])

    named, more = carrying(df, carry)
    return df.select(F.col(text_col).alias("text"), *named).mapInArrow(run, f"n_shingles bigint, s1 bigint, s2 bigint, ka array<bigint>, kb array<bigint>, text string{more}")


def word_set(text: str | None, size: int) -> set[bytes]:
    """The set of one text as the contract writes it: words between white space, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked(x: set, y: set, percent: int) -> bool:
    common = len(x & y)
    return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets and of what they share: na, nb, common."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    whole = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, second = None, set()
        for batch in (q for whole_batch in batches for p in pieces(whole_batch, "ta") for q in pieces(p, "tb")):  # texts of both sides are bounded
            rows = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb"))):
                if b != last:
                    last, second = b, word_set(tb, size)
                first = word_set(ta, size)
                rows.append((len(first), len(second), len(first & second)))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(c, pa.int64()) for c in columns]], names=["a", "b", "na", "nb", "common"])

    return whole.mapInArrow(run, f"a {kind}, b {kind}, na bigint, nb bigint, common bigint")


def _similar(percent: int) -> Column:
    """The condition on full sets, in whole numbers."""
    return (F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def _against(pairs: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components (c, d), c having the more members; members: id, component, count.

    All opponents of a large component meet it together, in blocks on both sides, so its texts are
    read once per block of opponents and not once per opponent. One link per document and block is
    enough to join two components.
    """
    kind = members.schema["id"].dataType.simpleString()
    rivals = pairs.join(members.select(F.col("component").alias("d"), "id"), "d").select("c", "id").distinct()
    blocks = rivals.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nd"))
    hosts = members.select(F.col("component").alias("c"), "id", F.ceil(F.col("count") / BLOCK).cast("int").alias("nc")).join(blocks, "c")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    keys = ["c", "bc", "bd"]
    left = hosts.select("c", own("nc").alias("bc"), spread("nd").alias("bd"), "id").join(texts, "id").select(*keys, "id", "text")
    sizes = hosts.groupBy("c").agg(F.first("nc").alias("nc"), F.first("nd").alias("nd"))
    right = rivals.join(sizes, "c").select("c", spread("nc").alias("bc"), own("nd").alias("bd"), "id").join(texts, "id").select(*keys, "id", "text")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        sets = [word_set(t, size) for t in x["text"]]
        found = []
        for b, text in zip(y["id"], y["text"]):
            rival = word_set(text, size)
            hit = next((a for a, one in zip(x["id"], sets) if percent * len(one) <= 100 * len(rival) and percent * len(rival) <= 100 * len(one) and linked(one, rival, percent)), None)
            if hit is not None:
                found.append((hit, b))
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": x["id"].dtype, "b": y["id"].dtype})

    left, right = (side.toDF(*keys, "id", "text") for side in (left, right))  # names of their own: both come from the same tables
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"a {kind}, b {kind}")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, id, n_shingles, n (members) of all table keys that several documents have.

    Rows are dealt by the tuple of collection A alone; the tuples of B are spread out only within it.
    """
    rows = classes.select("id", "n_shingles", F.explode("ka").alias("x"), "kb").repartition("x").select("id", "n_shingles", "x", F.explode("kb").alias("y"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("x", "y"))).filter("n > 1").select(F.xxhash64("x", "y").alias("bucket"), "id", "n_shingles", "n")


def _named(placed: DataFrame, label: DataFrame) -> DataFrame:
    return placed.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _spread(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """id, component, n, h: every distinct shingle of every document in `rows` (id, component)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                h, bounds = _distinct(piece.column("text"), size)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays([*[piece.column(x).take(pa.array(row)) for x in ("id", "component")], pa.array(n[row], pa.int64()), pa.array(signed(h))], names=["id", "component", "n", "h"])

    return rows.join(texts, "id").select("id", "component", "text").mapInArrow(run, f"id {kind}, component {kind}, n bigint, h bigint")


def _open_pairs(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (c < d) whose documents (id, component) may be linked, by the first shingle they share.

    Shingles are ordered by the number of components that have them. When x and y of n <= m shingles are linked, they
    share at least percent / (100 + percent) * (n + m), so behind their first common shingle, itself included,
    either has as many: that shingle stands early in both. Shingles of one component only come first and need no
    rows, so documents that differ from all others in enough of them meet nobody.
    """
    every = keep(_spread(rows, texts, size), "shingles")
    common = every.groupBy("h", "component").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = every.join(common, "h")
    order = Window.partitionBy("id").orderBy(F.desc("held"), "h")
    # what stands behind a shingle: counted from the end of the order, all of it held by several components
    placed = met.withColumn("reach", F.row_number().over(order).cast("bigint")).filter(F.col("reach") * 100 >= F.col("n") * percent)
    by = lambda found, side: found.groupBy("h", "component").agg(F.min("n").alias(f"small{side}"), F.max("n").alias(f"big{side}"), F.max("reach").alias(f"reach{side}"))
    placed = keep(placed.select("h", "component", "n", "reach"), "prefixes")
    less = by(placed.filter(F.col("reach") * (100 + percent) >= F.col("n") * 2 * percent), 1).withColumnRenamed("component", "c")
    more = by(placed, 2).withColumnRenamed("component", "d")
    sizes = (F.col("small1") <= F.col("big2")) & (F.col("big1") * 100 >= F.col("small2") * percent)
    enough = F.least("reach1", "reach2") * (100 + percent) >= (F.col("small1") + F.col("small2")) * percent
    pairs = less.join(more, "h").filter((F.col("c") != F.col("d")) & sizes & enough)
    return pairs.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", a: int = A_TUPLES, b: int = B_TUPLES, rows: int = ROWS, key_col: str | None = None) -> DataFrame:
    """Component of every row: the id, n_shingles, component_id (smallest id reachable) and kept.

    `key_col` names a column of longs that are different for all rows; the output then has it as well.
    """
    key = F.monotonically_increasing_id() if key_col is None else F.col(key_col)
    named = df.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sigs = keep(signatures(named, "text", size, a, b, rows, ("key", "doc_id")), "signatures")
    # null ids come last; all joins go by key
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = sigs.filter("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("key").alias("id"), first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    classes = keep(classes, "classes")
    shared = keep(_buckets(classes), "buckets")
    # the centre of a bucket is the document that shares most with others
    degree = keep(shared.groupBy("id").agg(F.sum("n").alias("degree")), "degrees")
    # texts are only needed of documents that share a bucket: those the filter cannot rule out are stored once
    texts = keep(bloom.ask(sigs.select(F.col("key").alias("id"), "text"), "id", degree, "id").filter("maybe").select("id", "text"), "texts")
    centred = shared.join(degree, "id").withColumn("top", F.max(F.struct("degree", "id", "n_shingles")).over(Window.partitionBy("bucket")))
    shared = keep(centred.select("bucket", "id", "n_shingles", "n", F.col("top.id").alias("centre"), F.col("top.n_shingles").alias("m"), F.col("top.degree").alias("weight")), "centred")
    near = F.least("n_shingles", "m") * 100 >= F.greatest("n_shingles", "m") * percent  # sets that differ more in size cannot be similar
    near_centres = shared.filter((F.col("id") != F.col("centre")) & near)
    # one centre for each document, then the others only where components differ
    own = keep(near_centres.groupBy("id").agg(F.max(F.struct("weight", "centre")).alias("w")).select("id", F.col("w.centre").alias("via")), "own")
    star = keep(_compared(own.toDF("a", "b"), texts, size), "star")
    label = components(star.filter(_similar(percent)).select("a", "b"))
    others = near_centres.select("id", "centre").distinct().join(own.toDF("id", "centre"), ["id", "centre"], "left_anti").toDF("a", "b")
    apart = others.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = keep(_compared(apart, texts, size), "more")
    label = extend(label, more.filter(_similar(percent)).select("a", "b"))
    star = star.unionByName(more)

    # only buckets that hold several components are open; of these, whatever may be linked is compared in full, once
    named = keep(_named(shared.filter("n > 2").select("bucket", "id"), label), "named")
    several = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    mixed = keep(named.join(several, "bucket", "left_semi").select("id", "component").distinct(), "mixed")
    pairs = _open_pairs(mixed, texts, size, percent)
    counts = label.groupBy("component").agg(F.count(F.lit(1)).alias("count"))
    sized = pairs.join(counts.toDF("c", "nc"), "c", "left").join(counts.toDF("d", "nd"), "d", "left").fillna(1, ["nc", "nd"])
    swap = F.col("nd") > F.col("nc")
    pairs = keep(sized.select(F.when(swap, F.col("d")).otherwise(F.col("c")).alias("c"), F.when(swap, F.col("c")).otherwise(F.col("d")).alias("d"), F.greatest("nc", "nd").alias("nc")), "rivals")
    single = pairs.filter("nc = 1").select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    new = _compared(single, texts, size).filter(_similar(percent)).select("a", "b")
    large = keep(pairs.filter("nc > 1").select("c", "d"), "large")
    wanted = large.select("c").unionByName(large.select(F.col("d").alias("c"))).distinct().withColumnRenamed("c", "component")
    members = wanted.join(label, "component", "left").select(F.coalesce("id", "component").alias("id"), "component").join(counts, "component", "left").fillna(1, ["count"])
    new = keep(new.unionByName(_against(large, members, texts, size, percent)), "rest")
    if not new.isEmpty():
        label = extend(label, new)
    return _result(sigs, classes, label, id_col, key_col)


def _result(sigs: DataFrame, classes: DataFrame, label: DataFrame, id_col: str, key_col: str | None) -> DataFrame:
    """One output row for each row; classes of one row that are linked with nothing need no join."""
    of_class = classes.select("n_shingles", "s1", "s2", "id", "first", "copies").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keeper = of_class.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("members")).filter("members > 1")
    changed = of_class.join(keeper, "component").select("n_shingles", "s1", "s2", "keeper")
    out = sigs.select("key", "doc_id", "n_shingles", "s1", "s2").join(changed, ["n_shingles", "s1", "s2"], "left")
    alone = F.col("keeper").isNull()
    named = [F.col("doc_id").alias(id_col), "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("component_id"), (alone | (F.col("keeper.key") == F.col("key"))).alias("kept")]
    return out.select(*named, *([F.col("key").alias(key_col)] if key_col else []))
