"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tidemark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster the same settings go into spark-defaults; only the master, the memory and
    the number of shuffle partitions (the start value for AQE coalescing) differ.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only for local runs without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work on a table that arrives in few splits.

    A large table already has more splits than cores, and then nothing moves.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(node in plan for node in ("Repartition", "Aggregate", "Join", "Window", "Sort", "InPandas", "Limit", "Union")):
        return df  # not a plain scan: its splits are set by a shuffle
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def small_rows(df: DataFrame, limit: int):
    """All rows as pandas when there are at most `limit`, else None. Reads limit + 1 rows at most."""
    rows = df.limit(limit + 1).toPandas()
    return rows if len(rows) <= limit else None


def checked_side(df: DataFrame, limit: int = 100_000) -> tuple[DataFrame, bool]:
    """(`df`, False), or its rows as a local table and True when there are at most `limit` of them.

    Spark cannot know that an exploded or aggregated side is small, and would shuffle the large side
    by the join key before it finds out. Counting first costs one small job.
    """
    rows = small_rows(df, limit)
    if rows is None:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def small_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """`df` marked for broadcast when it has at most `limit` rows, else `df` itself."""
    side, small = checked_side(df, limit)
    return F.broadcast(side) if small else side
