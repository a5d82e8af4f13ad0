"""From logs to preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import maintain, prefs
from tidemark.sources import records


def preference_samples(logs: DataFrame, gap: float = 0.2, source: str = "auto", ready_first: bool = False) -> DataFrame:
    """Samples of all pair builders that apply, one row per sample id.

    With `ready_first`, rows that already are samples short-circuit the builders. Ties between equal scores
    follow the column `ord`; without one, as the file order is not known to Spark, a hash of the row.
    """
    source = source.strip().lower()
    rows = logs if "ord" in logs.columns else logs.withColumn("ord", F.xxhash64(*[F.col(c) for c in logs.columns]))
    ready = prefs.existing_samples(rows, gap)
    if ready_first and not ready.isEmpty():
        return maintain.dedup_samples(ready.withColumn("ord", F.xxhash64("sample_id"))).drop("ord")
    parts = [ready]
    have = set(rows.columns)
    if source in ("auto", "eval_harness"):
        parts.append(prefs.pairs_from_scores(prefs.normalize_records(rows), gap))
    if source in ("auto", "llm_judge") and have & {"response_a", "candidate_a"} and have & {"response_b", "candidate_b"}:
        parts.append(prefs.pairs_from_ab(rows, gap))
    if source in ("auto", "user_feedback") and {"feedback_id", "feedback", "prompt", "response"} <= have:
        given = rows.filter((F.coalesce(F.col("feedback_id").cast("string"), F.lit("")) != "") & (F.coalesce(F.col("feedback").cast("string"), F.lit("")) != ""))
        parts.append(prefs.pairs_from_feedback(given, gap))
    return maintain.dedup_samples(*[p.withColumn("ord", F.xxhash64("sample_id")) for p in parts]).drop("ord")


def build_preferences(spark, path: str, out: str | None = None, gap: float = 0.2, source: str = "auto", ready_first: bool = False) -> DataFrame:
    """Read the logs below `path`, build the samples and, with `out`, write both sample files."""
    samples = preference_samples(records.read_records(spark, path), gap, source, ready_first)
    if out is not None:
        records.write_preferences(samples, out)
    return samples
