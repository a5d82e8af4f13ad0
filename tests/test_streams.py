"""Streams over several batches agree with the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import observe
from tidemark.operators import chunking
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """Calls of three sessions in time order, written as four files that arrive one by one."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        at = 1_704_067_200 + i * 600 + rng.randint(0, 500)
        rows.append((i, rng.choice("xyz"), at, rng.choice(["ls", "ls", "cat", "task_stop"]), "{}", float(rng.randint(1, 90))))
    root = tmp_path_factory.mktemp("calls")
    schema = "id bigint, session_key string, at bigint, tool string, args string, seconds double"
    frames = []
    for n in range(4):
        part = spark.createDataFrame(rows[n * 60 : (n + 1) * 60], schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        frames.append(part)
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return str(root), whole


def stream(spark, calls):
    root, whole = calls
    return jobs.read_stream(spark, f"{root}/in", whole.schema, files_per_trigger=1)


def test_guard_keeps_its_state_between_batches(spark, calls, tmp_path):
    got = jobs.run_to_table(jobs.stream_repeat_guard(stream(spark, calls)), f"{tmp_path}/g")
    want = observe.repeat_runs(calls[1])
    assert {(r.id, r.repeat_count, r.denied) for r in got.collect()} == {(r.id, r.repeat_count, r.denied) for r in want.collect()}


def test_latency_keeps_its_samples_between_batches(spark, calls, tmp_path):
    got = jobs.run_to_table(jobs.stream_latency(stream(spark, calls).withColumnRenamed("session_key", "key")), f"{tmp_path}/l")
    want = observe.latency_p90(calls[1].withColumnRenamed("session_key", "key"))
    assert {(r.id, round(r.p90, 6)) for r in got.collect()} == {(r.id, round(r.p90, 6)) for r in want.collect()}


def test_deliveries_stay_silent_after_an_allowed_one(spark, calls, tmp_path):
    rows = stream(spark, calls).withColumn("delivery_key", F.col("tool"))
    got = {r.id: r.allowed for r in jobs.run_to_table(jobs.stream_deliver_once(rows, 3), f"{tmp_path}/d").collect()}
    last, want = {}, {}
    for r in calls[1].orderBy("ts", "id").collect():
        key = (r.session_key, r.tool)
        ok = key not in last or (r.ts - last[key]).total_seconds() > 3 * 3600
        if ok:
            last[key] = r.ts
        want[r.id] = ok
    assert got == want


def test_running_counts_end_at_the_batch_value(spark, calls, tmp_path):
    rows = stream(spark, calls).select("session_key", F.lit("user").alias("kind"), "ts")
    got = jobs.run_to_table(jobs.stream_presence(rows), f"{tmp_path}/p", "update", ("session_key",))
    want = calls[1].groupBy("session_key").agg(F.max("ts").alias("m"))
    assert {(r.session_key, r.last_user_at) for r in got.collect()} == {(r.session_key, r.m) for r in want.collect()}


def test_index_replaces_changed_documents_only(spark, tmp_path):
    schema = "source_path string, content string, mtime double"
    first = spark.createDataFrame([("a.md", "# A\none", 1.0), ("b.txt", "two", 1.0), ("c.pdf", "no", 1.0)], schema)
    later = spark.createDataFrame([("a.md", "# A\nchanged", 2.0), ("b.txt", "two", 2.0)], schema)
    out = f"{tmp_path}/ix"
    first.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: jobs.start_index(jobs.read_stream(spark, f"{tmp_path}/in", first.schema, files_per_trigger=1), out, lambda d: chunking.chunk_markdown(d)).awaitTermination()
    run()
    before = {r.source_path: r.updated_at for r in jobs.read_index(spark, out)[0].collect()}
    later.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    docs = {r.source_path: r for r in jobs.read_index(spark, out)[0].collect()}
    texts = {r.text for r in jobs.read_index(spark, out)[1].collect()}
    assert set(docs) == {"a.md", "b.txt"} and texts == {"# A\nchanged", "two"}
    assert docs["b.txt"].updated_at == before["b.txt"] and docs["a.md"].updated_at > before["a.md"]


def test_a_batch_of_a_larger_table_has_several_files(spark, tmp_path, monkeypatch):
    """Else one task reads a whole batch; the files still follow the order of the rows."""
    from tidemark.registry import stream_queries
    from tidemark.registry.core import Tables

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    spark.range(400).selectExpr("id AS doc_id").write.parquet(f"{tmp_path}/t.parquet")
    seen = []
    rows = stream_queries.stream(Tables(spark, str(tmp_path)), "t", "doc_id").withColumn("file", F.input_file_name())
    rows.writeStream.foreachBatch(lambda b, _: seen.append([tuple(r) for r in b.select("doc_id", "file").collect()])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 3 and all(len({f for _, f in batch}) > 1 for batch in seen[:-1])
    assert sorted(i for batch in seen for i, _ in batch) == list(range(400))
    assert all(max(a)[0] < min(b)[0] for a, b in zip(seen, seen[1:]))


def test_batches_do_not_grow_in_number_with_the_table():
    """A batch pays for all state partitions: large tables get larger batches of files of bounded size, small ones as before."""
    from tidemark.registry.stream_queries import layout

    assert layout(100_000) == (5, 16, 2 * 1250) and layout(1_000_000)[:2] == (5, 16)
    for n in (6_000_000, 36_000_000, 360_000_000):
        parts, files, most = layout(n)
        assert parts == 16 and parts * files * most >= n and most <= 100_000
