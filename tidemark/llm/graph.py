"""Connected components of links between ids, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import keep


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from every id in `links` (columns a, b): columns id, component.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    the number of rounds follows the logarithm of the longest chain. Labels are written each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = keep(both, "links")
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("above"))
        moved = step.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("above", "component")).alias("component"))
        moved = keep(moved, "labels")
        label = moved.select("id", "component")
        if moved.filter("was <> component").isEmpty():
            return label


def extend(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label` (id, component) after more links: only the components they join are looked at again."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    every = keep(label.unionByName(ends.join(label, "id", "left_anti").select("id", F.col("id").alias("component"))), "named")
    named = links.join(every.toDF("a", "ca"), "a").join(every.toDF("b", "cb"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(named).toDF("component", "root")
    return keep(every.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
