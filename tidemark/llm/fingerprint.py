"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in column expressions only.

A paragraph is a non-empty line, its digest a 64-bit hash; a document is the set of its digests. Each
digest goes to one cell in each of three parts of a sketch; a cell holds the number of its digests,
their exclusive or, and that of their check sums. Two sketches subtract cell by cell, which leaves
only the digests that differ; cells with one digest left give it up, it is taken out of its other
cells, and so on (peeling). If that stops early, both sets are sketched again with twice as many
groups of cells, digests spread over the groups by hash, until everything is recovered.

Texts without paragraphs (also null ones) are empty sets; two empty sets are equal (likeness 1).
Fingerprints know sets: order and repetition of paragraphs do not change them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells in each of the three parts of a group, and rounds of peeling (each takes out all that it can).
WIDTH, ROUNDS = 8, 14
CELLS = 3 * WIDTH
#: Groups double until a group has about four digests; LEVELS more attempts follow, then sets are compared directly.
PER_GROUP, LEVELS = 4, 4


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line != "")
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def check_sum(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _entries(keys: Column, level: Column) -> Column:
    """Digests with check sum, group, and cell in each part; every level places them anew."""

    def place(key: Column) -> Column:
        spot = F.xxhash64(key, level)
        part = lambda j: (F.shiftrightunsigned(spot, 10 * j) % WIDTH + j * WIDTH).cast("int")
        group = F.pmod(F.shiftrightunsigned(spot, 32), F.call_function("shiftleft", F.lit(1).cast("bigint"), level)).cast("int")
        return F.struct(key.alias("k"), check_sum(key).alias("h"), *[F.abs(part(j)).alias(f"s{j}") for j in range(3)], group.alias("g"))

    return F.transform(keys, place)


def _in_cell(entry: Column, i: Column) -> Column:
    return (entry["s0"] == i) | (entry["s1"] == i) | (entry["s2"] == i)


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("bigint").alias("k"), h.cast("bigint").alias("h"))


def _numbers() -> Column:
    return F.sequence(F.lit(0), F.lit(CELLS - 1))


def sketch(entries: Column) -> Column:
    """Cells of one group."""
    empty = _cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda c, e: _cell(c["n"] + 1, c["k"].bitwiseXOR(e["k"]), c["h"].bitwiseXOR(e["h"]))
    return F.transform(_numbers(), lambda i: F.aggregate(F.filter(entries, lambda e: _in_cell(e, i)), empty, add))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, level: Column) -> Column:
    """struct(ok, only_a, only_b): digests recovered from a difference of two sketches."""
    start = F.struct(cells.alias("cells"), F.expr("cast(array() as array<bigint>)").alias("only_a"), F.expr("cast(array() as array<bigint>)").alias("only_b"), F.lit(True).alias("going"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check_sum(c["k"])))

        def take(found: Column) -> Column:
            side = lambda sign: F.transform(F.filter(found, lambda p: p["n"] == sign), lambda p: p["k"])
            placed = F.transform(found, lambda p: F.struct(p.alias("p"), F.element_at(_entries(F.array(p["k"]), level), 1).alias("e")))
            out = lambda c, x: _cell(c["n"] - x["p"]["n"], c["k"].bitwiseXOR(x["p"]["k"]), c["h"].bitwiseXOR(x["p"]["h"]))
            left = bind(placed, lambda all_: F.transform(state["cells"], lambda c, i: F.aggregate(F.filter(all_, lambda x: _in_cell(x["e"], i)), c, out)))
            return F.struct(left.alias("cells"), F.concat(state["only_a"], side(1)).alias("only_a"), F.concat(state["only_b"], side(-1)).alias("only_b"), (F.size(found) > 0).alias("going"))

        return F.when(state["going"], bind(F.array_distinct(pure), take)).otherwise(state)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    clean = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return bind(done, lambda s: F.struct(clean(s).alias("ok"), s["only_a"].alias("only_a"), s["only_b"].alias("only_b")))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct(ok, only_a, only_b, level): digests that only one side has, from sketches; larger ones on failure."""
    none = F.expr("cast(array() as array<bigint>)")
    result = lambda ok, x, y, level: F.struct(ok.alias("ok"), x.alias("only_a"), y.alias("only_b"), level.alias("level"))
    gathered = lambda r, side: F.flatten(F.transform(r, lambda x: x[side]))

    def attempt(level: Column) -> Column:
        last = F.call_function("shiftleft", F.lit(1), level) - 1
        mine = lambda side, g: sketch(F.filter(side, lambda e: e["g"] == g))
        grouped = lambda pair: F.transform(F.sequence(F.lit(0), last), lambda g: subtract(mine(pair["a"], g), mine(pair["b"], g)))
        larger = bind(F.struct(_entries(a, level).alias("a"), _entries(b, level).alias("b")), grouped)
        cells = F.when(level == 0, F.array(subtract(sketch_a, sketch_b))).otherwise(larger)
        return bind(F.transform(cells, lambda c: peel(c, level)), lambda r: result(F.forall(r, lambda x: x["ok"]), gathered(r, "only_a"), gathered(r, "only_b"), level))

    # how far levels may go follows from the sizes of both sets, which their sketches tell
    top = F.ceil(F.log2(F.greatest(F.lit(1.0), (F.size(a) + F.size(b)) / PER_GROUP))).cast("int") + LEVELS
    found = F.aggregate(F.sequence(F.lit(0), top), result(F.lit(False), none, none, F.lit(-1)), lambda acc, level: F.when(acc["ok"], acc).otherwise(attempt(level)))
    direct = result(F.lit(True), F.array_except(a, b), F.array_except(b, a), F.lit(-1))
    return bind(found, lambda f: F.when(f["ok"], f).otherwise(direct))


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Shared over all digests, from the set sizes and the recovered differences."""
    both, apart = F.size(a) + F.size(b), F.size(diff["only_a"]) + F.size(diff["only_b"])
    return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart))


def serialised(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(c["n"].cast("string"), F.lit("."), F.lower(F.hex(c["k"])), F.lit("."), F.lower(F.hex(c["h"])))), " ")


def base_sketch(keys: Column) -> Column:
    return bind(_entries(keys, F.lit(0)), sketch)


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, keys, cells and next (text, keys, cells of the next lower id; after the last the first).

    Every row is a document of its own; null ids come after all others, rows of one id follow the hash of
    their text. Rows are dealt by ranges of ids; the first row of each range also goes to the range above, so no
    range needs more than its own rows. Bounds come from quantiles of the ids alone.
    """
    spark = df.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(id_col).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    kind = df.schema[id_col].dataType.simpleString()
    if cuts:
        below = lambda array: F.size(F.filter(array, lambda c: c <= F.col("id")))
        array = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
        inside = lambda at: (at - 1) * step + below(F.element_at(F.array(*[array(f) for f in fine]), at))
        bucket = bind(below(array(coarse)), lambda at: F.when(at == 0, 0).otherwise(inside(at)).cast("int"))
    else:
        bucket = F.lit(0)
    heads = {r.bucket: r.head for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("id").alias("head")).collect()}
    used = sorted(heads)
    target = {b: used[i + 1] if i + 1 < len(used) else used[0] for i, b in enumerate(used)}
    size = len(cuts) + 1
    head = F.element_at(F.array(*[F.lit(heads.get(b)).cast(kind) for b in range(size)]), F.col("bucket") + 1)
    goes = F.element_at(F.array(*[F.lit(target.get(b, 0)) for b in range(size)]), F.col("bucket") + 1)
    place = lambda b, ghost: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"))
    placed = rows.withColumn("bucket", bucket).withColumn("place", F.explode(F.when(F.col("id").eqNullSafe(head), F.array(place(F.col("bucket"), 0), place(goes, 1))).otherwise(F.array(place(F.col("bucket"), 0)))))
    dealt = placed.select("id", "text", "place.bucket", "place.ghost").repartition("bucket")
    known = dealt.withColumn("keys", digests(F.col("text"))).withColumn("cells", base_sketch(F.col("keys")))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("id"), F.xxhash64("text"))
    return known.withColumn("next", F.lead(F.struct("text", "keys", "cells")).over(order)).filter("ghost = 0").drop("bucket", "ghost")


def compare_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text (second half from the next document) and compare.

    Output: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    only_text, only_edited (digests the two versions do not share), level (of the sketch that told).
    """
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_cells", base_sketch(F.col("edited_keys")))
    keys, cells, other, other_cells = F.col("keys"), F.col("cells"), F.col("edited_keys"), F.col("edited_cells")
    # both comparisons are one expression over two partners: half the expression for each task to load
    partners = F.array(F.struct(other.alias("keys"), other_cells.alias("cells")), F.struct(F.col("next.keys").alias("keys"), F.col("next.cells").alias("cells")))
    rows = rows.withColumn("found", F.transform(partners, lambda p: difference(keys, p["keys"], cells, p["cells"])))
    rows = rows.withColumn("to_edited", F.element_at("found", 1)).withColumn("to_next", F.element_at("found", 2))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        serialised(cells).alias("fingerprint"),
        serialised(other_cells).alias("edited_fingerprint"),
        likeness(keys, other, F.col("to_edited")).alias("near_edited"),
        likeness(keys, F.col("next.keys"), F.col("to_next")).alias("near_next"),
        F.col("to_edited.only_a").alias("only_text"),
        F.col("to_edited.only_b").alias("only_edited"),
        F.col("to_edited.level").alias("level"),
    )
