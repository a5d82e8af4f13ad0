"""A stored keyword index with block maxima, and exact top-k search that leaves blocks out.

Documents are dealt into ranges of about RANGE_DOCS. The postings of a term in a range are one block: the
document ids, term counts and lengths in arrays, and beside them the largest count and the smallest
length. A block is bounded by its range, so no term, however common, makes a long row. Documents are
shuffled by range, once, and the blocks of a range are made and written where it lies: in folders by term bucket,
sorted by term within a file, so a search reads the folders and pages of its terms only.

A search (block-max pruning) runs in three steps, all of them joins and aggregates:

1. Bounds. From the two numbers beside each block (the arrays are not read) follows the most that a
   document of the range can score for a question.
2. Floor. The most promising ranges of each question are scored in full; the k-th best score there is
   a floor that the answer cannot lie below.
3. Scores. Only ranges whose bound reaches the floor are read and scored.

The result equals the full score over all documents. Documents without an id are left out. Ids are
keys: rows that share one are counted apart but add up to one score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.scoring import settle
from tidemark.operators.windows import top_rows
from tidemark.session import checked_side, spread
from tidemark.sources import versions

#: Documents of a range, folders of terms, ranges of a question that give its floor (times k documents at least).
RANGE_DOCS, BUCKETS, FIRST_RANGES = 256, 16, 2
SCORE_DIGITS = 9
QUERY_TERMS_SENT = 1_000_000
#: A bound is summed in another order than a score: this much larger it holds in any order.
MARGIN = 1e-9


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document row: id, len (tokens), terms (array of term and tf), counted inside the row.

    Equal tokens are neighbours once the tokens are sorted; a run's length is the term's count.
    """
    tokens = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.array_sort(tx.bm25_tokens(F.col("text"))).alias("toks"))
    numbered = tokens.select("id", "toks", F.size("toks").alias("len"))
    new = lambda i: (i == 1) | (F.element_at("toks", i) != F.element_at("toks", F.greatest(i - 1, F.lit(1))))
    starts = F.when(F.col("len") > 0, F.filter(F.sequence(F.lit(1), F.col("len")), new)).otherwise(F.array().cast("array<int>"))
    found = numbered.select("id", "toks", "len", starts.alias("starts"))
    run = lambda at, n: F.struct(F.element_at("toks", at).alias("term"), (F.coalesce(F.get("starts", n + 1), F.col("len") + 1) - at).cast("int").alias("tf"))
    return found.select("id", F.col("len").cast("bigint").alias("len"), F.transform("starts", run).alias("terms"))


@dataclass
class Index:
    """Where an index lies; `blocks` and `docs` are read on use."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        """bucket, term, range, n, ids, tfs, lens, most_tf, least_len."""
        kind = self.docs.schema["id"].dataType.simpleString()
        schema = f"term string, range int, n int, ids array<{kind}>, tfs array<int>, lens array<bigint>, most_tf int, least_len bigint, bucket int"
        return self.spark.read.schema(schema).parquet(versions.current_path(self.spark, f"{self.path}/blocks"))

    @property
    def docs(self) -> DataFrame:
        """range, id, len, terms: the forward index."""
        return versions.read_current(self.spark, f"{self.path}/docs")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", range_docs: int = RANGE_DOCS) -> Index:
    """Write the index of `docs` below `path` as a new version; readers of the old one are not disturbed."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull())
    n_ranges = rows.select(F.greatest(F.ceil(F.count(F.lit(1)) / range_docs), F.lit(1)).cast("int")).first()[0]
    counted = term_counts(rows, id_col, text_col).select(F.pmod(F.xxhash64("id"), F.lit(n_ranges)).cast("int").alias("range"), "id", "len", "terms")
    versions.publish(counted, f"{path}/docs")  # texts are read and cut into tokens once
    # dealt by range, which grouping by range and term then finds in place: postings are not shuffled
    dealt = versions.read_current(spark, f"{path}/docs").repartition("range")
    postings = dealt.select("range", "id", "len", F.explode("terms").alias("t")).select("range", "id", "len", "t.term", "t.tf")
    block = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
    blocks = postings.groupBy("range", "term").agg(block.alias("b"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len"))
    shaped = blocks.select(bucket_of(F.col("term")).alias("bucket"), "term", "range", F.size("b").alias("n"), F.col("b.id").alias("ids"), F.col("b.tf").alias("tfs"), F.col("b.len").alias("lens"), "most_tf", "least_len")
    versions.publish(shaped.sortWithinPartitions("bucket", "term", "range"), f"{path}/blocks", partition_by=("bucket",))
    return Index(spark, path)


def _part(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """A term's share of the score before its weight: grows with tf, falls with the length."""
    return (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / mean))


def search_index(index: Index, queries: DataFrame, k: int = 12, *, query_id: str = "query_id", query_col: str = "query", k1: float = 1.5, b: float = 0.75, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """Okapi BM25 of all documents of the index for a batch of questions: (query_id, id, score, rank)."""
    ranges = chosen_ranges(index, queries, k, query_id=query_id, query_col=query_col, k1=k1, b=b, first_ranges=first_ranges)
    return top_rows(ranges.scores(ranges.kept), [query_id], [F.col("score").desc(), F.col("id")], k)


@dataclass
class Ranges:
    """The (question, range) pairs of a search: `bounds` has all, `kept` those that can hold an answer."""

    bounds: DataFrame
    kept: DataFrame
    scores: object


def chosen_ranges(index: Index, queries: DataFrame, k: int, *, query_id: str, query_col: str, k1: float, b: float, first_ranges: int) -> Ranges:
    asked = queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(tx.bm25_tokens(F.col(query_col)))).alias("term"))
    asked, small = checked_side(asked, QUERY_TERMS_SENT)
    sent = F.broadcast if small else (lambda df: df)
    whole = index.docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("mean"))
    n_docs, mean = whole.select("n").scalar(), whole.select("mean").scalar()
    wanted = asked.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
    near = index.blocks.join(sent(wanted), ["bucket", "term"], "left_semi")
    # one row of numbers for each block of an asked term; the arrays are not read here
    heads = near.select("term", "range", "n", "most_tf", "least_len")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    weights = asked.join(df.select("term", F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "term")
    top = F.col("idf") * _part(F.col("most_tf"), F.col("least_len"), mean, k1, b)
    bounds = heads.join(sent(weights), "term").groupBy("qid", "range").agg((F.sum(top) * (1.0 + MARGIN) + MARGIN).alias("bound"))

    def scores(pairs: DataFrame) -> DataFrame:
        """Full scores of all documents in the given (question, range) pairs that hold a term of the question."""
        here = pairs.groupBy("range").agg(F.collect_set("qid").alias("qids"))
        # blocks are dealt by range, so the scores of a document are summed in place and its postings are not shuffled for each question
        posts = near.repartition("range").join(here, "range").join(sent(weights), "term").filter(F.array_contains("qids", F.col("qid")))
        parts = posts.select("range", "qid", "idf", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
        part = F.col("idf") * _part(F.col("p.tfs"), F.col("p.lens"), mean, k1, b)
        found = parts.groupBy("range", F.col("qid").alias(query_id), F.col("p.ids").alias("id")).agg(settle(F.sum(part), SCORE_DIGITS).alias("score")).drop("range")
        return found.filter(F.col("score") > 0)

    first = top_rows(bounds, ["qid"], [F.col("bound").desc(), F.col("range")], first_ranges, "n")
    best = top_rows(scores(first), [query_id], [F.col("score").desc(), F.col("id")], k)
    floor = best.filter(F.col("rank") == k).select(F.col(query_id).alias("qid"), F.col("score").alias("floor"))
    kept = bounds.join(floor, "qid", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("qid", "range")
    return Ranges(bounds, kept, scores)
