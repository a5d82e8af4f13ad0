"""From raw documents to token counts, stage by stage; every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloom, bpe, decontaminate, langid, neardup, pii
from tidemark.llm.queries import vocabulary
from tidemark.llm.store import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own (`row`), written once: ids may repeat or be null, so rows go, not ids."""
    return keep(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` without those in `gone` (row); only rows a Bloom filter cannot clear are shuffled."""
    asked = bloom.ask(rows, "row", gone, "row")
    sure = asked.filter("NOT maybe").select(*COLUMNS)
    return sure.unionByName(asked.filter("maybe").join(gone, "row", "left_anti").select(*COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; the others get their main language, or null if no row of the input has one to learn from."""
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.lit(None).cast("string")).select(*COLUMNS)
    found = langid.identify(docs, model, carry=("text", "source", "n_chars"))
    return found.filter(F.col("lang_pred") != "und").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, 0.8) the row with the smallest doc_id stays."""
    rows = keyed(docs)
    found = keep(neardup.near_duplicates(rows, size=5, key_col="row").filter("NOT kept").select("row"), "copies")
    return without(rows, found)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    rows = keyed(docs)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = keep(decontaminate.find_leaks(rows, items, id_col="row").select("row").distinct(), "leaks")
    return without(rows, found)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = pii.find_pii(docs, with_text=True, carry=("lang", "source"))
    return found.withColumnRenamed("masked", "text").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_texts(docs, vocabulary(), with_ids=False, cache_words=80_000)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pii", without_pii), ("bpe", encoded)]

#: Language identification, near-duplicate search and tagging have no SQL form; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
