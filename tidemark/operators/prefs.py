"""Scored logs to preference pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.functions.scoring import clamp

# Candidate fields in order of preference.
PROMPT_FIELDS = ("prompt", "question", "input", "user_prompt", "user_message")
RESPONSE_FIELDS = (
    "response", "answer", "final_answer", "predicted_answer", "candidate", "completion", "text", "final_answer_summary",
)
SCORE_FIELDS = ("judge_score", "score", "accuracy", "judge_acc", "final_score", "preference_score")
TASK_FIELDS = ("task_type", "question_type", "scenario_name", "scenario_id")
GROUP_FIELDS = ("prompt_id", "case_id", "scenario_name", "scenario_id")
TASK_WORDS = (
    ("rag|retrieval|knowledge", "rag_qa"),
    ("memory|persona|longmem", "memory_qa"),
    ("tool|shell|spawn", "tool_use"),
    ("interview", "interview_qa"),
    ("proactive", "proactive_reply"),
)
META_FIELDS = (
    "tools_used", "tool_chain", "retrieved_docs", "retrieved_chunk_ids", "citations", "conversation_id", "turn_id",
    "scenario_name", "scenario_id", "trace_id", "backend",
)
FEEDBACK_ALIASES = {
    "up": "thumbs_up", "+1": "thumbs_up", "like": "thumbs_up",
    "down": "thumbs_down", "-1": "thumbs_down", "dislike": "thumbs_down",
    "a": "choose_a", "b": "choose_b",
}
POSITIVE = ("thumbs_up", "choose_a", "choose_b", "selected")
NEGATIVE = ("thumbs_down", "rejected")

SAMPLE_COLUMNS = (
    "sample_id", "prompt", "chosen", "rejected", "source", "task_type", "judge_score_chosen", "judge_score_rejected",
    "score_gap", "metadata",
)


def _texts(df: DataFrame, names: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [tx.present(F.col(n)) for n in names if isinstance(kinds.get(n), T.StringType)]


def _first(columns: list[Column], otherwise: str | None = None) -> Column:
    every = [*columns, *([F.lit(otherwise)] if otherwise is not None else [])]
    return F.coalesce(*every) if every else F.lit(None).cast("string")


def prompt_of(df: DataFrame) -> Column:
    """First non-blank prompt field, else the joined contents of `input_messages`."""
    found = _texts(df, PROMPT_FIELDS)
    kinds = {f.name: f.dataType for f in df.schema}
    if isinstance(kinds.get("input_messages"), T.ArrayType):
        said = F.filter(F.transform("input_messages", lambda m: tx.present(m["content"])), lambda c: c.isNotNull())
        found.append(tx.present(F.array_join(said, "\n")))
    return _first(found)


def task_type_of(df: DataFrame) -> Column:
    raw = F.lower(_first(_texts(df, TASK_FIELDS), ""))
    out = None
    for words, name in TASK_WORDS:
        test = F.rlike(raw, F.lit(words))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general_chat")


def score_of(df: DataFrame) -> Column:
    """First usable score field within 0..1, else a correct or passed flag, else one half."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts: list[Column] = []
    for name in SCORE_FIELDS:
        if isinstance(kinds.get(name), T.BooleanType):
            parts.append(F.col(name).cast("double"))
        elif isinstance(kinds.get(name), T.NumericType):
            parts.append(clamp(F.col(name).cast("double"), 0.0, 1.0))

    def flag(name: str) -> Column:
        return F.col(name) if isinstance(kinds.get(name), T.BooleanType) else F.lit(None).cast("boolean")

    judged = F.when(flag("judge_correct") | flag("is_correct"), 1.0).when(~flag("judge_correct") | ~flag("is_correct"), 0.0)
    return F.coalesce(*parts, judged, flag("passed").cast("double"), F.lit(0.5))


def metadata_of(df: DataFrame) -> Column:
    """Known context fields of a record as JSON, on top of its own metadata."""
    kinds = {f.name: f.dataType for f in df.schema}
    fields = [F.col(n) for n in META_FIELDS if n in kinds]
    if "metadata" in kinds and not isinstance(kinds["metadata"], T.NullType):
        fields.append(F.col("metadata"))
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def normalize_records(df: DataFrame) -> DataFrame:
    """Records as (group_key, prompt, response, score, task_type, metadata), blank ones dropped.

    Works on whatever candidate fields the table has. An `ord` column is kept.
    """
    keep = [F.col("ord")] if "ord" in df.columns else []
    prompt = prompt_of(df)
    kinds = {f.name for f in df.schema}
    groups = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in GROUP_FIELDS if n in kinds]
    rows = df.select(
        *keep,
        F.coalesce(*groups, prompt).alias("group_key"),
        prompt.alias("prompt"),
        _first(_texts(df, RESPONSE_FIELDS)).alias("response"),
        score_of(df).alias("score"),
        task_type_of(df).alias("task_type"),
        metadata_of(df).alias("metadata"),
    )
    return rows.filter(F.col("prompt").isNotNull() & F.col("response").isNotNull())


def sample_id(*parts: Column) -> Column:
    return tx.stable_id("pref_", 24, *[F.coalesce(p, F.lit("")) for p in parts], sep="|", digest="sha256")


def valid_samples(df: DataFrame, gap: float) -> DataFrame:
    """Pairs with text on both sides, different texts and a large enough score gap."""
    clean = df.withColumn("score_gap", F.greatest(F.lit(0.0), F.col("judge_score_chosen") - F.col("judge_score_rejected")))
    texts = F.lit(True)
    for name in ("prompt", "chosen", "rejected"):
        texts = texts & tx.present(F.col(name)).isNotNull()
    return clean.filter(texts & (tx.strip(F.col("chosen")) != tx.strip(F.col("rejected"))) & (F.col("score_gap") >= gap)).select(*SAMPLE_COLUMNS)


def pairs_from_scores(records: DataFrame, gap: float = 0.2) -> DataFrame:
    """Best against worst response per group; `records` comes from `normalize_records` with `ord`.

    Both ends are running aggregates, so a group of any size is folded before the shuffle.
    """
    row = F.struct("prompt", "response", "score", "task_type", "metadata")
    ends = records.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(row, F.struct(F.col("score"), -F.col("ord"))).alias("c"),
        F.min_by(row, F.struct(F.col("score"), -F.col("ord"))).alias("r"),
    )
    out = ends.filter(F.col("n") >= 2).select(
        sample_id(F.lit("eval"), F.col("group_key"), F.col("c.response"), F.col("r.response")).alias("sample_id"),
        F.col("c.prompt").alias("prompt"), F.col("c.response").alias("chosen"), F.col("r.response").alias("rejected"),
        F.lit("eval_harness").alias("source"), F.col("c.task_type").alias("task_type"),
        F.col("c.score").alias("judge_score_chosen"), F.col("r.score").alias("judge_score_rejected"),
        F.to_json(F.struct(F.col("group_key"), F.col("c.metadata").alias("chosen"), F.col("r.metadata").alias("rejected"))).alias("metadata"),
    )
    return valid_samples(out, gap)


def _given_score(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return clamp(F.expr(f"try_cast(`{name}` AS DOUBLE)"), 0.0, 1.0)


def pairs_from_ab(df: DataFrame, gap: float = 0.2) -> DataFrame:
    """A/B records to pairs by their scores, or by the winner when a score is missing."""
    a, b = _first(_texts(df, ("response_a", "candidate_a"))), _first(_texts(df, ("response_b", "candidate_b")))
    winner = F.lower(_first(_texts(df, ("winner", "chosen")), ""))
    won_a = winner.isin("a", "response_a", "candidate_a", "chosen_a")
    won_b = winner.isin("b", "response_b", "candidate_b", "chosen_b")
    raw_a, raw_b = _given_score(df, "score_a"), _given_score(df, "score_b")
    both = raw_a.isNotNull() & raw_b.isNotNull()
    score_a = F.when(both, raw_a).when(won_a, 1.0).when(won_b, 0.0).otherwise(0.5)
    score_b = F.when(both, raw_b).when(won_b, 1.0).when(won_a, 0.0).otherwise(0.5)
    rows = df.select(
        prompt_of(df).alias("prompt"), a.alias("a"), b.alias("b"), score_a.alias("sa"), score_b.alias("sb"),
        task_type_of(df).alias("task_type"), metadata_of(df).alias("metadata"),
    )
    first = F.col("sa") >= F.col("sb")
    out = rows.filter("prompt IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select(
        "prompt",
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"),
        F.lit("llm_judge").alias("source"), "task_type",
        F.greatest("sa", "sb").alias("judge_score_chosen"), F.least("sa", "sb").alias("judge_score_rejected"), "metadata",
    )
    return valid_samples(out.withColumn("sample_id", sample_id(F.lit("judge"), F.col("prompt"), F.col("chosen"), F.col("rejected"))), gap)


def feedback_score(feedback: Column, score: Column | None = None) -> Column:
    raw = F.lower(tx.strip(F.coalesce(feedback, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in FEEDBACK_ALIASES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(table, raw), raw)
    value = F.when(kind.isin(*POSITIVE), 1.0).when(kind.isin(*NEGATIVE), 0.0).otherwise(0.5)
    return value if score is None else F.coalesce(score.cast("double"), value)


def pairs_from_feedback(df: DataFrame, gap: float = 0.2) -> DataFrame:
    """Best liked against worst disliked response per conversation, turn or prompt.

    `df`: ord, feedback_id, prompt, response, feedback and optionally conversation_id, turn_id, score.
    """
    have = set(df.columns)
    keys = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("conversation_id", "turn_id") if c in have]
    value = feedback_score(F.col("feedback"), F.col("score") if "score" in have else None)
    rows = df.select(
        F.coalesce(*keys, F.col("prompt")).alias("group_key"), tx.present(F.col("prompt")).alias("prompt"),
        tx.present(F.col("response")).alias("response"), value.alias("value"), "ord", F.col("feedback_id").cast("string").alias("feedback_id"),
    ).filter("prompt IS NOT NULL AND response IS NOT NULL")
    row = F.struct("prompt", "response", "value", "feedback_id")
    liked, disliked = F.col("value") > 0.5, F.col("value") < 0.5
    ends = rows.groupBy("group_key").agg(
        F.max_by(row, F.when(liked, F.struct(F.col("value"), -F.col("ord")))).alias("c"),
        F.min_by(row, F.when(disliked, F.struct(F.col("value"), F.col("ord")))).alias("r"),
    )
    out = ends.filter("c IS NOT NULL AND r IS NOT NULL").select(
        sample_id(F.lit("feedback"), F.col("group_key"), F.col("c.response"), F.col("r.response")).alias("sample_id"),
        F.col("c.prompt").alias("prompt"), F.col("c.response").alias("chosen"), F.col("r.response").alias("rejected"),
        F.lit("user_feedback").alias("source"), F.lit("general_chat").alias("task_type"),
        F.col("c.value").alias("judge_score_chosen"), F.col("r.value").alias("judge_score_rejected"),
        F.to_json(F.struct("group_key", F.col("c.feedback_id").alias("chosen_feedback_id"), F.col("r.feedback_id").alias("rejected_feedback_id"))).alias("metadata"),
    )
    return valid_samples(out, gap)


def existing_samples(df: DataFrame, gap: float = 0.2) -> DataFrame:
    """Rows that already are samples; their gap is recomputed from the scores."""
    needed = [c for c in SAMPLE_COLUMNS if c != "metadata"]
    if not set(needed) <= set(df.columns):
        return df.limit(0).select(*[F.lit(None).cast("double" if "score" in c else "string").alias(c) for c in SAMPLE_COLUMNS])
    rows = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in needed))
    meta = F.col("metadata") if "metadata" in df.columns and isinstance(df.schema["metadata"].dataType, T.StringType) else metadata_of(df)
    texts = {c: tx.strip(F.col(c)) for c in ("prompt", "chosen", "rejected", "sample_id")}
    typed = [
        texts.get(c, F.col(c).cast("double") if "score" in c else F.col(c)).alias(c) for c in needed
    ]
    return valid_samples(rows.select(*typed, meta.alias("metadata")), gap)
