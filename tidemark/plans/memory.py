"""Composed memory retrieval: lanes, hotness, feedback boosts, fusion, and what to inject."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.scoring import clamp, hotness
from tidemark.operators import context, fusion, lexical, memory, observe, vector
from tidemark.operators.policy import MAX_BOOST

ALPHA = 0.20
KEYWORD_FLOOR = 30
ANSWER_K, ANSWER_THRESHOLD = 15, 0.35


@dataclass(frozen=True)
class MemoryConfig:
    k: int = 8
    threshold: float = 0.45
    alpha: float = ALPHA
    half_life_days: float = 14.0
    types: Sequence[str] = ()
    keywords: bool = True
    injection: context.InjectionConfig = field(default_factory=context.InjectionConfig)


def query_texts(queries: DataFrame, aux: DataFrame | None) -> DataFrame:
    """(query_id, variant, text): the question and its auxiliary texts, blank and equal ones once.

    `aux` (query_id, pos, text) holds texts written for a question, such as model hypotheses.
    """
    own = queries.select("query_id", F.lit(0).alias("variant"), tx.strip(F.col("query")).alias("text"))
    every = own if aux is None else own.unionByName(aux.select("query_id", (F.col("pos") + 1).cast("int").alias("variant"), tx.strip(F.col("text")).alias("text")))
    return every.filter("text <> ''").groupBy("query_id", "text").agg(F.min("variant").alias("variant"))


def vector_lane(texts: DataFrame, items: DataFrame, now: Column, cfg: MemoryConfig, stats: DataFrame | None, embedder) -> DataFrame:
    """Best vector hit per question and item over all texts: query_id, id, score.

    Items must reach the cosine threshold; their score blends cosine and hotness, plus the boost
    feedback earned them. The best `k` of every text are pooled.
    """
    keyed = texts.withColumn("key", F.concat_ws(" ", F.col("variant").cast("string"), F.col("query_id").cast("string")))
    asked = embedder(keyed, "text").select("key", "embedding")
    heat = hotness(F.col("reinforcement"), F.col("updated_at"), now, F.col("emotional_weight"), cfg.half_life_days)
    known = items.select("id", "embedding", F.round(heat, 15).alias("hot"))
    if stats is None:
        known = known.withColumn("boost", F.lit(0.0))
    else:
        boost = stats.select(F.col("item_id").alias("id"), clamp(F.col("retrieval_boost"), -MAX_BOOST, MAX_BOOST).alias("boost"))
        known = known.join(boost, "id", "left").fillna({"boost": 0.0})
    alpha = cfg.alpha

    def blend(cosine: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        mixed = np.round((1.0 - alpha) * cosine + alpha * rows["hot"].to_numpy()[None, :], 4)
        return np.round(mixed + rows["boost"].to_numpy()[None, :], 4)

    # the blend is part of the block scan, so no task ships more than k rows per text
    top = vector.similar(
        asked, known, k=cfg.k, threshold=cfg.threshold, query_id="key", epsilon=memory.NORM_EPSILON, extra=("hot", "boost"), rescore=blend
    ).select("key", "id", "score")
    back = keyed.select("key", "query_id", "variant")
    return fusion.maxpool(top.join(back, "key").select("query_id", "id", "variant", "score"), ["query_id"])


def memory_retrieve(
    queries: DataFrame, items: DataFrame, now: Column, cfg: MemoryConfig = MemoryConfig(), *, aux: DataFrame | None = None, stats: DataFrame | None = None,
    embedder=vector.embed, scope: tuple[str, str] | None = None, start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """Memory hits per question: query_id, id, score, rrf_score, rank, from the vector and keyword lanes."""
    channel, chat = scope if scope else (None, None)
    open_items = memory.filter_memory(items, types=cfg.types, status="active", scope_channel=channel, scope_chat_id=chat, start=start, end=end)
    found = vector_lane(query_texts(queries, aux), open_items.filter(F.col("embedding").isNotNull()), now, cfg, stats, embedder)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    limit = max(KEYWORD_FLOOR, 2 * cfg.k)
    words = lexical.term_join(open_items if cfg.keywords else open_items.limit(0), queries, limit)
    return fusion.rrf_weighted(ranked, words, cfg.k)


def retrieve_for(intent: str, queries: DataFrame, items: DataFrame, now: Column, cfg: MemoryConfig = MemoryConfig(), **options) -> DataFrame:
    """Memory hits for an intent.

    `context` and `procedure` (rules and preferences) use the given limits; `answer` looks wider
    and lower; `interest` looks at preferences and profile; `timeline` lists the events of
    `start`..`end` in time order.
    """
    if intent == "timeline":
        if options.get("start") is None or options.get("end") is None:
            return items.limit(0)
        events = memory.filter_memory(items, types=("event",), status="active", start=options["start"], end=options["end"])
        timed = events.withColumn("ts", memory.parse_event_time(F.col("happened_at")))
        return observe.recent_events(timed, options["start"], options["end"], cfg.k).orderBy("ts", "id")
    if intent == "answer":
        wide = MemoryConfig(**{**cfg.__dict__, "k": max(cfg.k, ANSWER_K), "threshold": ANSWER_THRESHOLD})
        return memory_retrieve(queries, items, now, wide, **options).filter(F.col("rank") <= cfg.k)
    types = {"interest": ("preference", "profile"), "procedure": ("procedure", "preference")}.get(intent, tuple(cfg.types))
    return memory_retrieve(queries, items, now, MemoryConfig(**{**cfg.__dict__, "types": types}), **options)


def inject(hits: DataFrame, items: DataFrame, now: Column, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The injected memory block per question, with the ids it holds."""
    full = hits.select("query_id", "id", "score").join(items.select("id", "memory_type", "summary", "happened_at", "source_ref", "extra_json"), "id")
    return context.inject_block(context.select_injection(full, now, cfg.injection), cfg.injection)
