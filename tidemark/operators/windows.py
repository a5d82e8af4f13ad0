"""Running values over very large groups.

`Window.partitionBy(key)` puts a whole key into one task. When one key may hold a third of the
table, that task never ends. The helpers below cut every key into buckets that follow the sort
order: each bucket is scanned on its own, the per-bucket summaries (one row each) are scanned per
key, and the carried value is joined back. The result equals the plain window.

`bucket` must be a non-decreasing (or, with `descending`, non-increasing) function of the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_BUCKET = 4096
TIME_BUCKET_SECONDS = 3600


def seq_bucket(column: str, width: int = SEQ_BUCKET) -> Column:
    return F.floor(F.col(column) / width).cast("bigint")


def time_bucket(column: str, seconds: int = TIME_BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys))


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = summary.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in summary.columns if c not in keys],
    )
    joined = rows.join(right, _same(rows, right, keys), "left")
    return joined.drop(*[f"__r_{k}" for k in keys])


def _bucket_window(keys: Sequence[str], descending: bool):
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    amount: Column,
    out: str,
    *,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of `amount` per key in `order`."""
    parts = [*keys, "__bucket"]
    rows = df.withColumn("__bucket", bucket).withColumn("__amount", amount)
    totals = rows.groupBy(*parts).agg(F.sum("__amount").alias("__total"))
    offsets = totals.select(
        *parts, F.coalesce(F.sum("__total").over(_bucket_window(keys, descending)), F.lit(0)).alias("__offset")
    )
    local = (
        Window.partitionBy(*parts)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    rows = rows.withColumn("__local", F.coalesce(F.sum("__amount").over(local), F.lit(0)))
    joined = _attach(rows, offsets, parts)
    return joined.withColumn(out, F.col("__local") + F.col("__offset")).drop(
        "__bucket", "__amount", "__local", "__offset"
    )


def position(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """1-based row number per key in `order`."""
    return prefix_sum(df, keys, bucket, order, F.lit(1).cast("bigint"), out, descending=descending)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    *,
    inclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Last non-null `value` at or (without `inclusive`) before each row, in `order`.

    `value` may be a struct; a null struct counts as missing.
    """
    parts = [*keys, "__bucket"]
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    to_end = Window.partitionBy(*parts).orderBy(*order)
    local = to_end.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    backwards = Window.partitionBy(*parts).orderBy(*order)
    marked = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(local)).withColumn(
        "__nr", F.row_number().over(backwards)
    )
    tails = (
        marked.filter(F.col("__value").isNotNull())
        .groupBy(*parts)
        .agg(F.max_by("__value", "__nr").alias("__tail"))
    )
    spans = rows.select(*parts).distinct()
    spans = _attach(spans, tails, parts)
    carried = spans.select(
        *parts, F.last("__tail", ignorenulls=True).over(_bucket_window(keys, descending)).alias("__carry")
    )
    joined = _attach(marked, carried, parts)
    return joined.withColumn(out, F.coalesce(F.col("__local"), F.col("__carry"))).drop(
        "__bucket", "__value", "__local", "__nr", "__carry"
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First `k` rows per key with their rank.

    Spark puts a partial group limit before the shuffle, so each map task ships at most `k` rows
    of a key and a hot key stays small. That rewrite holds for limits below
    `spark.sql.optimizer.windowGroupLimitThreshold`.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)
