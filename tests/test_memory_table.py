"""Writes to the memory table."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import maintain, memory
from tidemark.sources import versions

def now():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))
SCHEMA = (
    "id string, memory_type string, summary string, embedding array<float>, reinforcement int, emotional_weight int, extra_json string, source_ref string, happened_at string, status string"
)


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("content_hash", tx.content_hash(F.col("summary"), F.col("memory_type")))
    return df.withColumn("created_at", now()).withColumn("updated_at", now() - F.expr("INTERVAL 5 DAYS"))


def item(id, kind="preference", summary=None, vec=None, extra="{}", ref="", status="active", weight=0):
    return (id, kind, summary or f"text {id}", vec, 1, weight, extra, ref, "", status)


def test_upsert_reinforces_revives_and_is_idempotent_in_shape(spark):
    target = table(spark, [item("a", summary="Likes  TEA"), item("b", summary="old", status="superseded")])
    changes = spark.createDataFrame(
        [(1, "preference", " likes tea ", 4), (2, "preference", "Likes tea", 99), (3, "preference", "OLD", 0), (4, "preference", "new", 2), (5, "preference", "new", 3)],
        "ord int, memory_type string, summary string, emotional_weight int",
    )
    got = {r.summary: r for r in memory.upsert_memory(target, changes, now()).collect()}
    assert (got["Likes  TEA"].reinforcement, got["Likes  TEA"].emotional_weight) == (3, 10)
    assert (got["old"].status, got["old"].reinforcement) == ("active", 2)
    assert (got["new"].reinforcement, got["new"].emotional_weight, got["new"].status) == (2, 3, "active")
    assert len(got) == 3


def test_a_hot_text_is_folded_before_the_join(spark):
    target = table(spark, [item("a", summary="same")])
    changes = spark.range(50_000).select(F.col("id").alias("ord"), F.lit("preference").alias("memory_type"), F.lit("same").alias("summary"), F.lit(1).alias("emotional_weight"))
    assert memory.upsert_memory(target, changes, now()).first().reinforcement == 50_001


def test_events_are_written_once_per_source(spark):
    changes = spark.createDataFrame(
        [(1, "s1", "went home", 1, ""), (2, "s1", "went home again", 1, ""), (3, "s2", "Went  home", 5, "2024-01-01"), (4, "", "x", 0, ""), (5, "s3", "  ", 0, ""), (6, "done", "late", 0, "")],
        "ord int, source_ref string, summary string, emotional_weight int, happened_at string",
    )
    log = spark.createDataFrame([("done", "z")], "source_ref string, item_id string")
    items, new_log = memory.ingest_once(table(spark, [item("q")]).limit(0), log, changes, now())
    row = items.first()
    assert items.count() == 1 and (row.reinforcement, row.emotional_weight) == (2, 5)
    assert sorted(r.source_ref for r in new_log.collect()) == ["done", "s1", "s2"]
    again, _ = memory.ingest_once(items, new_log, changes, now())
    assert again.first().reinforcement == 2


def test_procedures_merge_and_preferences_retire(spark):
    target = table(
        spark,
        [
            item("p", "procedure", "先看日志。", [1.0, 0.0], '{"tool_requirement":"shell"}'),
            item("r", "preference", "likes tea", [0.0, 1.0]),
            item("h", "profile", "is ill", [0.7, 0.7], '{"category":"status"}', weight=8),
        ],
    )
    changes = spark.createDataFrame(
        [
            (1, "n1", "procedure", "再重启", [0.9, 0.3], '{"tool_requirement":"shell"}', 0),
            (2, "n2", "preference", "likes strong tea", [0.1, 1.0], "{}", 0),
            (3, "n3", "profile", "is well", [0.95, 0.36], '{"category":"status"}', 0),
            (4, "n4", "preference", "likes green tea", [0.12, 1.0], "{}", 0),
        ],
        "ord int, id string, memory_type string, summary string, embedding array<float>, extra_json string, emotional_weight int",
    )
    items, actions = memory.save_supersede(target, changes, now())
    got = {r.summary: r.status for r in items.collect()}
    assert got["先看日志；再重启"] == "active"
    assert got["likes tea"] == "superseded" and got["likes strong tea"] == "superseded" and got["likes green tea"] == "active"
    # a weighty fact needs 0.92, these two reach 0.912
    assert got["is ill"] == "active" and got["is well"] == "active"
    assert ("n1", "merge", "p") in {tuple(r) for r in actions.collect()}


def test_undo_retires_and_restores(spark):
    items = table(spark, [item("old", status="superseded"), item("new", ref='["cli:1:1","cli:1:2"]#h:x'), item("bare", ref="cli:1:1"), item("kept", status="superseded"), item("other")])
    links = spark.createDataFrame([("old", "new"), ("kept", "new"), ("kept", "other")], "old_item_id string, new_item_id string")
    ids = spark.createDataFrame([("cli:1:1",), (" ",)], "message_id string")
    after, report = memory.undo_sources(items, links, ids, now())
    got = {r.id: r.status for r in after.collect()}
    assert got == {"old": "active", "new": "superseded", "bare": "superseded", "kept": "superseded", "other": "active"}
    rows = {tuple(r) for r in report.collect()}
    assert rows == {("affected", "new"), ("affected", "bare"), ("restored", "old"), ("rollback_source", "cli:1:1"), ("rollback_source", "cli:1:2")}


def test_times_and_presets(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02T03:04:05",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04+02:00",), ("soon",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(F.date_format(memory.parse_event_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()]
    assert got == ["2024-01-01 16:00:00", "2024-01-01 19:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:00", None, None, None]
    s = spark.createDataFrame([("[2024-01-02 03:04] x",), ("[2024-01-02] x",), ("x [2024-01-02]",)], "t string")
    assert [r.x for r in s.select(memory.summary_time(F.col("t")).alias("x")).collect()] == ["2024-01-02T03:04:00", "2024-01-02T00:00:00", None]
    now = datetime(2024, 1, 10, 15, tzinfo=timezone.utc)
    assert [d.day for d in memory.time_bounds("yesterday", now)] == [9, 10]
    assert [d.day for d in memory.time_bounds("2024-01-02~2024-01-04", now)] == [2, 5]
    assert memory.time_bounds("never", now) is None


def test_source_references(spark):
    df = spark.createDataFrame([('["a"," b "]#h:1',), ("m:1",), ("#h",), (None,), ('"q"',), ("[bad",)], "source_ref string")
    got = [r.x for r in df.select(memory.source_ids(F.col("source_ref")).alias("x")).collect()]
    assert got == [["a", "b"], ["m:1"], [], [], ["q"], ["[bad"]]


def test_published_versions_replace_each_other(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.publish(spark.range(3), path)
    versions.publish(versions.read_current(spark, path).filter("id > 0"), path)
    assert sorted(r.id for r in versions.read_current(spark, path).collect()) == [1, 2]


def test_cascade_and_pages(spark):
    p, c = spark.range(4).toDF("k"), spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k long, n int")
    keys = spark.createDataFrame([(1,), (3,)], "k long")
    left, kids = maintain.cascade_delete(p, c, keys, "k", "k", False)
    assert left.count() == 4
    left, kids = maintain.cascade_delete(p, c, keys, "k", "k", True)
    assert sorted(r.k for r in left.collect()) == [0, 2] and kids.count() == 1
    rows = maintain.page(p, ["k"], "bad name", False, 2, 3, "k").collect()
    assert [(r.k, r.total) for r in rows] == [(0, 4)]
