"""Alert and content feeds in one event schema, and trace logs by kind."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx

PAYLOAD = (
    "event_id string, kind string, source_type string, source_name string, title string, url string, content string, "
    "published_at string, severity string, ack_server string, display_text string"
)
ID_PREFIX = {"alert": "gev_", "content": "gcv_"}


@F.pandas_udf(T.StringType())
def canonical_json(payload: pd.Series, server: pd.Series) -> pd.Series:
    """The object as sorted JSON (at every depth, ASCII, blanks behind separators), with the server as default for `ack_server`."""

    def spelled(text: str | None, sender: str | None) -> str | None:
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        if not isinstance(found, dict):
            return None
        if found.get("ack_server") is None and sender is not None:
            found["ack_server"] = sender
        return json.dumps(found, sort_keys=True)

    return pd.Series([spelled(t, s) for t, s in zip(payload, server)], dtype=object)


def normalize_feed(df: DataFrame, channel: str, payload: str = "payload", server: str = "server") -> DataFrame:
    """Payloads of the given channel (`alert` or `content`) as events.

    The kind must equal the channel. A missing id becomes a digest of the payload, a missing
    acknowledging server the one that sent it.
    """
    rows = df.withColumn("p", F.from_json(payload, PAYLOAD)).filter(F.col("p.kind") == channel)
    text = lambda n: tx.strip(F.coalesce(F.col(f"p.{n}"), F.lit("")))
    given = tx.present(F.col("p.event_id"))
    # only rows without an id reach Python
    made = F.concat(F.lit(ID_PREFIX[channel]), F.substring(F.sha1(canonical_json(F.when(given.isNull(), F.col(payload)), F.col(server))), 1, 12))
    published = F.try_to_timestamp(F.col("p.published_at"))
    event_id = F.coalesce(given, made)
    return rows.select(
        *[c for c in df.columns if c not in (payload, server)],
        event_id.alias("event_id"),
        F.lit(channel).alias("kind"),
        *[text(n).alias(n) for n in ("source_type", "source_name", "content")],
        F.col("p.title").alias("title"), F.col("p.url").alias("url"), published.alias("published_at"),
        (F.nullif(text("severity"), F.lit("")) if channel == "alert" else F.lit(None).cast("string")).alias("severity"),
        F.coalesce(F.nullif(text("ack_server"), F.lit("")), F.col(server)).alias("ack_server"),
        (given if channel == "alert" else event_id).alias("ack_id"),
        (text("display_text") if channel == "content" else F.lit("")).alias("display_text"),
    )


TRACE_KINDS = ("turns", "rag_queries", "memory_writes", "trace_events")


def trim_calls(calls: Column, args_chars: int = 300, result_chars: int = 500) -> Column:
    """Tool calls (name, args, result) with arguments and results cut for the log."""
    return F.transform(
        calls,
        lambda c: F.struct(
            c["name"].alias("name"), F.substring(c["args"], 1, args_chars).alias("args"), F.substring(c["result"], 1, result_chars).alias("result")
        ),
    )


def route_traces(df: DataFrame) -> dict[str, DataFrame]:
    """Split traces by kind; tool calls are trimmed. Rows of unknown kinds are ignored."""
    rows = df.withColumn("tool_calls", trim_calls(F.col("tool_calls"))) if "tool_calls" in df.columns else df
    rows = rows.withColumn("day", F.to_date("ts"))
    return {kind: rows.filter(F.col("kind") == kind) for kind in TRACE_KINDS}
