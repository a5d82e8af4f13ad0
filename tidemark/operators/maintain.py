"""Batch merges and paging: every job maps tables to the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def stamped_docs(target: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The changed documents with their times and status; created_at of a known document stays."""
    old = target.select("id", F.col("created_at").alias("__created"))
    fresh = changes.join(old, "id", "left").withColumn("created_at", F.coalesce("__created", now))
    return fresh.withColumn("updated_at", now).withColumn("status", F.lit("active")).drop("__created")


def upsert_docs(target: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Insert or replace documents by id; created_at of a known document stays."""
    fresh = stamped_docs(target, changes, now)
    kept = target.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def replace_children(target: DataFrame, changes: DataFrame, key: str = "document_id") -> DataFrame:
    """Drop all children of the changed parents and add the new ones."""
    kept = target.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.select(*target.columns))


def retain(df: DataFrame, days: int, now: Column, ts: str = "ts", keep: Column | None = None) -> DataFrame:
    """Rows younger than `days`, plus those `keep` names (errors)."""
    young = F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(young if keep is None else (young | F.coalesce(keep, F.lit(False))))


def cascade_delete(parents: DataFrame, children: DataFrame, keys: DataFrame, parent_key: str, child_key: str, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """Delete the listed parents and their children.

    Without `cascade` nothing is deleted as long as any listed parent has children.
    """
    wanted = keys.select(F.col(parent_key)).distinct()
    gone = wanted
    if not cascade:
        blocking = children.join(wanted.withColumnRenamed(parent_key, child_key), child_key, "left_semi").limit(1)
        blocked = blocking.agg(F.count(F.lit(1)).alias("n")).scalar()
        gone = wanted.filter(blocked == 0)
        return parents.join(gone, parent_key, "left_anti"), children
    left = children.join(gone.withColumnRenamed(parent_key, child_key), child_key, "left_anti")
    return parents.join(gone, parent_key, "left_anti"), left


def append_once(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Append entries once per (source_ref, kind); the first by `ord` wins, blanks are ignored."""
    clean = changes.withColumn("source_ref", tx.strip(F.col("source_ref"))).withColumn("kind", tx.strip(F.col("kind")))
    clean = clean.filter((F.col("source_ref") != "") & (F.col("kind") != "") & (tx.strip(F.col("payload")) != ""))
    rest = [c for c in log.columns if c not in ("source_ref", "kind")]
    first = clean.groupBy("source_ref", "kind").agg(F.min_by(F.struct(*rest), "ord").alias("c")).select("source_ref", "kind", "c.*")
    new = first.join(log.select("source_ref", "kind"), ["source_ref", "kind"], "left_anti")
    return log.unionByName(new.select(*log.columns))


def dedup_samples(*frames: DataFrame) -> DataFrame:
    """Union of sample tables, one row per sample_id: the first of the earliest table.

    Every table has an `ord` column that fixes the order inside it.
    """
    union = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("__at", F.struct(F.lit(i).alias("i"), F.col("ord").alias("o")))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in ("sample_id", "__at")]
    return union.groupBy("sample_id").agg(F.min_by(F.struct(*rest), "__at").alias("s")).select("sample_id", "s.*")


def changed_since(now_df: DataFrame, base_df: DataFrame) -> DataFrame:
    """Rows that are new or carry another updated_at than the baseline.

    Rows that agree on (id without status prefix, type, text) count once; the oldest is kept.
    """
    base = base_df.select("id", F.col("updated_at").alias("__was"))
    joined = now_df.join(base, "id", "left")
    moved = joined.filter(~F.col("updated_at").eqNullSafe(F.col("__was"))).drop("__was")
    item = F.when(F.contains("id", F.lit(":")), F.element_at(F.split("id", ":", 2), 2)).otherwise(F.col("id"))
    keyed = moved.withColumn("item_id", item)
    rest = [c for c in keyed.columns if c not in ("item_id", "memory_type", "summary")]
    first = keyed.groupBy("item_id", "memory_type", "summary").agg(F.min_by(F.struct(*rest), F.struct("updated_at", "id")).alias("r"))
    return first.select("item_id", "memory_type", "summary", "r.*")


def page(df: DataFrame, allowed: Sequence[str], sort_by: str, ascending: bool, number: int, size: int, id_col: str) -> DataFrame:
    """One page of a table, sorted by an allowed column (else the first allowed) and the id, with the total."""
    column = sort_by if sort_by in allowed else allowed[0]
    rows = max(1, int(size))
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    key = F.col(column).asc() if ascending else F.col(column).desc()
    cut = df.orderBy(key, F.col(id_col)).offset((max(1, int(number)) - 1) * rows).limit(rows)
    return cut.withColumn("total", total)


#: Ranges into which the sort column of a deep page is cut, and the rows from which a range of one value is cut by id.
PAGE_RANGES, PILE_ROWS = 256, 100_000


def deep_page(df: DataFrame, column: str, ascending: bool, number: int, size: int, id_col: str) -> DataFrame:
    """The page that `page` gives, without sorting the table.

    A quantile sketch of the sort column cuts it into ranges, one count says how many rows each holds, and only
    the ranges that the page touches are read and sorted. A range that is one value held by very many rows is cut
    again, by id. `column` is a number, date or time; nulls are first in rising order, last in falling.
    """
    rows, first = max(1, int(size)), (max(1, int(number)) - 1) * max(1, int(size))
    cut, total = _page_rows(df, column, ascending, first, rows, id_col)
    return cut.withColumn("total", F.lit(total).cast("bigint"))


def _page_rows(df: DataFrame, column: str, ascending: bool, first: int, rows: int, id_col: str) -> tuple[DataFrame, int]:
    sketch = df.agg(F.percentile_approx(column, [i / PAGE_RANGES for i in range(1, PAGE_RANGES)], 20 * PAGE_RANGES)).first()[0]
    cuts = sorted(set(sketch or ()))
    at = F.col(column)
    inside = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
    place = F.when(at.isNull(), -1).otherwise(inside)
    counts = df.groupBy(place.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
    held, before, chosen = sorted(counts, key=lambda r: r["range"], reverse=not ascending), 0, []
    skipped = 0
    for r in held:
        if before + r.n <= first:
            skipped = before + r.n
        elif before < first + rows:
            chosen.append(r)
        before += r.n
    part = df.filter(place.isin([r["range"] for r in chosen])) if chosen else df.limit(0)
    if len(chosen) == 1 and chosen[0].n > PILE_ROWS and chosen[0].low == chosen[0].high and column != id_col:
        return _page_rows(part, id_col, True, first - skipped, rows, id_col)[0], before
    key = at.asc() if ascending else at.desc()
    return part.orderBy(key, F.col(id_col)).offset(first - skipped).limit(rows), before


def mark_rollup(items: DataFrame, decisions: DataFrame, acted_at: Column) -> DataFrame:
    """Note a decision in the extra_json of its source items, so they are not proposed again.

    `decisions`: candidate_id, action, source_ids. The last candidate by id wins for an item.
    """
    named = decisions.select("candidate_id", "action", F.explode("source_ids").alias("id"))
    last = named.groupBy("id").agg(F.max_by(F.struct("candidate_id", "action"), "candidate_id").alias("d")).select("id", "d.*")
    note = F.to_json(
        F.struct(
            "candidate_id", "action", F.date_format(acted_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("acted_at"),
            F.concat(F.lit("memory_rollup:"), "candidate_id").alias("pending_source_ref"),
        )
    )
    joined = items.join(last, "id", "left")
    known = F.coalesce(F.from_json("extra_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = F.map_filter(known, lambda k, v: k != "_rollup")
    merged = F.to_json(F.map_concat(others, F.create_map(F.lit("_rollup"), note)))
    return joined.withColumn("extra_json", F.when(F.col("candidate_id").isNotNull(), merged).otherwise(F.col("extra_json"))).select(*items.columns)
