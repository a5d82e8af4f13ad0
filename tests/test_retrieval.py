"""Keyword search, fusion, context, citations and metrics on small fixtures."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import context, evals, fusion, lexical
from tidemark.plans import retrieval


def test_bm25_finds_the_right_chunk_and_han_text(spark):
    docs = spark.createDataFrame(
        [("c1", "Agent Runtime supports tool calling hooks."), ("c2", "Dashboard observability shows session events."), ("c3", "长期记忆检索系统")], "id string, text string"
    )
    asked = spark.createDataFrame([(1, "tool calling"), (2, "记忆"), (3, "  ")], "query_id int, query string")
    got = {(r.query_id, r.id) for r in lexical.bm25_search(docs, asked, 5).collect()}
    assert got == {(1, "c1"), (2, "c3")}


def test_tokens_of_short_han_runs_repeat(spark):
    row = spark.createDataFrame([("Don't stop a 记 工具",)], "t string").select(tx.bm25_tokens(F.col("t")).alias("k")).first()
    assert row.k == ["don't", "stop", "记", "记", "工", "具", "工具", "工具"]


def test_query_terms_drop_stopwords(spark):
    row = spark.createDataFrame([("用户 量化研究员 v1.2 x ab ab",)], "t string").select(tx.query_terms(F.col("t")).alias("k")).first()
    assert row.k == ["v1.2", "ab", "量化", "化研", "研究", "究员"]


def test_catalog_keywords_split_scripts(spark):
    row = spark.createDataFrame([("RSS订阅 feed",)], "t string").select(F.array_sort(tx.catalog_keywords(F.col("t"))).alias("k")).first()
    assert set(row.k) == {"rss订阅 feed", "rss订阅", "feed", "rss", "订阅", "订", "阅"}


def test_catalog_exact_name_wins(spark):
    cat = spark.createDataFrame(
        [("web_search", "look things up", "find", "mcp", "low"), ("read_file", "read a file", "", "builtin", "low"), ("shell", "run", "", "builtin", "high")],
        "name string, description string, hint string, source_type string, risk string",
    )
    asked = spark.createDataFrame([(1, " shell "), (2, "search file"), (3, "zzz")], "query_id int, query string")
    got = {(r.query_id, r.name, r.score, r["rank"]) for r in lexical.catalog_search(cat, asked, 5).collect()}
    # read_file: part `file` 10, whole query overlaps a part 5, description 2
    assert got == {(1, "shell", None, 1), (2, "web_search", 12 + 6, 1), (2, "read_file", 10 + 5 + 2, 2)}


def test_substring_join_matches_contains(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xbc"), (3, "量化研究员"), (4, "a\nb")], "id int, body string")
    needles = spark.createDataFrame([("abc",), ("bc",), ("c",), ("研究员",), ("a\nb",), ("abca",), ("zzz",)], "n string")
    want = {(i, n) for i, b in [(1, "abcabc"), (2, "xbc"), (3, "量化研究员"), (4, "a\nb")] for n in ("abc", "bc", "c", "研究员", "a\nb", "abca", "zzz") if n in b}
    for sizes in ((1, 2, 3), (4,)):
        got = lexical.substring_join(texts, "id", "body", needles, "n", sizes)
        assert sorted((r.id, r.n) for r in got.collect()) == sorted(want)


def test_rrf_order_and_ranks(spark):
    lanes = spark.createDataFrame(
        [(1, "vector", 0, "c1", 1, 0.99), (1, "vector", 0, "c2", 2, 0.80), (1, "bm25", 0, "c2", 1, 4.0), (1, "bm25", 0, "c3", 2, 3.0)],
        "query_id int, lane string, variant int, id string, rank int, score double",
    )
    for frame in (lanes, lanes.orderBy(F.col("lane").desc())):
        got = fusion.rrf(frame, 5).orderBy("rank").collect()
        assert [r.id for r in got] == ["c2", "c1", "c3"]
        assert (got[0].vector_rank, got[0].bm25_rank, got[0].lanes) == (2, 1, ["bm25", "vector"])


def test_rerank_without_scores_keeps_order(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3), (2, "a", 0.5, 1), (2, "b", 0.4, 2)], "query_id int, id string, score double, rank int")
    scores = spark.createDataFrame([(1, "b", 7.0), (1, "zz", 1.0)], "query_id int, id string, given_score double")
    got = sorted((r.query_id, r["rank"], r.id) for r in fusion.rerank(hits, scores, 2, 5).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b")]


def test_rerank_by_scores_the_hits_carry(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1, None), (1, "b", 0.8, 2, 7.0), (1, "c", 0.7, 3, 1.0), (2, "a", 0.5, 1, None), (2, "b", 0.4, 2, None)], "query_id int, id string, score double, rank int, given_score double")
    got = fusion.rerank(hits, None, 2, 5)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b")]
    assert got.columns == fusion.rerank(hits.drop("given_score"), hits.select("query_id", "id", "given_score"), 2, 5).columns


def test_parents_pool_children(spark):
    hits = spark.createDataFrame(
        [(1, "child_a", "parent_1", "child", 0.4), (1, "child_b", None, "child", 0.9), (1, "lone", None, "child", 0.2)], "query_id int, id string, parent_id string, chunk_type string, score double"
    )
    chunks = spark.createDataFrame(
        [("parent_1", None, "parent", "P"), ("child_a", "parent_1", "child", "a"), ("child_b", "parent_1", "child", "b")], "id string, parent_id string, chunk_type string, text string"
    )
    got = {r.key: r for r in context.expand_to_parents(hits, chunks).collect()}
    assert got["parent_1"].score == 0.9 and sorted(got["parent_1"].matched_child_ids) == ["child_a", "child_b"] and not got["parent_1"].fallback
    assert got["lone"].fallback and got["lone"].matched_child_ids == ["lone"]


def test_context_stops_at_the_first_overflow(spark):
    size = [500, 300, 50]
    hits = spark.createDataFrame([(1, i, i + 1, "x" * n, "p", "", 0, 0) for i, n in enumerate(size)], "query_id int, id int, rank int, text string, source_path string, heading_path string, line_start int, line_end int")
    assert [r.id for r in context.pack_context(hits, 700).collect()] == [0]
    block = context.context_block(context.pack_context(hits, 5000)).first()
    assert block.injected_ids == [0, 1, 2] and block.block.startswith("## Document Knowledge")


def test_citations(spark):
    df = spark.createDataFrame([("[K1] [K3]", ["K1", "K2"]), (None, ["K1"])], "answer string, citation_ids array<string>")
    a, b = context.validate_citations(df).collect()
    assert (a.valid_ids, a.missing_ids, a.unused_ids, a.ok) == (["K1"], ["K3"], ["K2"], False)
    assert b.ok and b.unused_ids == ["K1"]


def test_memory_budget_skips_and_goes_on(spark):
    rows = [(1, "f", "procedure", "do", 0.9, '{"tool_requirement":"shell"}'), (1, "r", "preference", "r" * 300, 0.9, "{}"), (1, "e", "event", "short", 0.9, "{}"), (1, "low", "event", "no", 0.1, "{}")]
    hits = spark.createDataFrame(rows, "query_id int, id string, memory_type string, summary string, score double, extra_json string").withColumn("happened_at", F.lit("")).withColumn("source_ref", F.lit(""))
    cfg = context.InjectionConfig(max_chars=280)
    block = context.inject_block(context.select_injection(hits, F.current_timestamp(), cfg), cfg).first()
    assert block.injected_ids == ["f", "e"]


def test_id_metrics(spark):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcd")], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "d"), (2, "z")], "query_id int, id string")
    got = {r.query_id: r for r in evals.ir_metrics(hits, rel, (1, 2, 3)).collect()}
    assert (got[1].recall_3, round(got[1].precision_3, 6), got[1].hit_1, got[1].hit_2, got[1].mrr_3) == (0.5, 0.333333, 0.0, 1.0, 0.5)
    assert got[2].recall_3 == got[2].ndcg_3 == 0.0
    assert 0 < got[1].ndcg_3 < 1


def test_case_metrics(spark):
    cases = spark.createDataFrame([("a", ["x"], []), ("b", [], ["d9"])], "case_id string, relevant_chunk_ids array<string>, relevant_document_ids array<string>")
    preds = spark.createDataFrame([("r", "a", ["q", "x", "p"], ["d1", "d2", "d3"])], "retriever string, case_id string, chunk_ids array<string>, document_ids array<string>")
    got = evals.evaluate(cases, preds, (3,)).first()
    assert (got.hit_3, got.mrr) == (0.5, 0.25)
    single = evals.evaluate_cases(cases, preds.drop("retriever"), (3,)).filter("case_id = 'b'").first()
    assert single.error == "missing prediction"


def test_option_labels(spark):
    options = ["Alpha choice", "Bravo choice", "Gamma thing"]
    said = ["(b)", "I choose b", "Bravo choice", "zzz qqq", "(z) choice", ""]
    df = spark.createDataFrame([(s, options) for s in said], "answer string, options array<string>")
    got = [r.l for r in df.select(evals.option_label(F.col("answer"), F.col("options")).alias("l")).collect()]
    assert got[:4] == ["(b)", "(b)", "(b)", None] and got[5] is None


def test_query_variants(spark):
    df = spark.createDataFrame([(1, " My Tool memory "), (2, "nothing"), (3, "  ")], "query_id int, query string")
    got = sorted((r.query_id, r.variant_no, r.variant) for r in retrieval.query_variants(df).collect())
    assert got == [
        (1, 0, "My Tool memory"),
        (1, 1, "my tool memory tool calling function calling memory long-term memory retrieval"),
        (2, 0, "nothing"),
    ]


@pytest.mark.parametrize("pairs, cells", [(1_000_000, 1_000_000), (7, 1_000_000), (50, 3)])
def test_bm25_scores_documents_where_they_lie(monkeypatch, pairs, cells):
    """What a task lets out holds the best rows with all ties, and far fewer rows than it scored."""
    monkeypatch.setattr(lexical, "PIECE_PAIRS", pairs)
    monkeypatch.setattr(lexical, "PIECE_CELLS", cells)
    rng = np.random.default_rng(2)
    docs = [["common", *rng.choice(list("abcdefgh"), rng.integers(0, 9)).tolist()] if i % 9 else [] for i in range(400)] + [["common", "a", "b"]] * 9
    asked = {1: ["a", "b", "common"], 2: ["common", "none"], 3: ["h"], None: ["c", "d"]}
    pairs_of = [(q, t) for q, ts in asked.items() for t in ts]
    plan = lexical._Asked.of(pa.chunked_array([pa.array([q for q, _ in pairs_of], pa.int64())]), pa.chunked_array([pa.array([t for _, t in pairs_of])]))
    df = {t: sum(t in d for d in docs) for _, t in pairs_of}
    mean = sum(map(len, docs)) / len(docs)
    cut = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 90, len(docs)))), pa.array(docs[i : i + 90], pa.list_(pa.string()))], ["id", "toks"]) for i in range(0, len(docs), 90)]
    out = list(plan.scorer((len(docs), mean, np.array([df[t] for t in plan.vocabulary.to_pylist()], float)), 5, 1.5, 0.75, "q")(iter(cut)))
    got = {(r["q"], r["id"]): r["score"] for b in out for r in b.to_pylist()}
    n = 0
    for q, terms in asked.items():
        idf = {t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
        want = {i: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms) for i, d in enumerate(docs)}
        want = {i: round(s, 9) for i, s in want.items() if s > 0}
        n += len(want)
        fifth = sorted(want.values())[-5]
        assert all(abs(got[q, i] - s) < 1e-8 for i, s in want.items() if s >= fifth)
    assert len(got) == sum(b.num_rows for b in out) < n


def test_bm25_shuffles_only_the_best(spark):
    docs = spark.range(500).selectExpr("id", "concat('common word', id % 7) AS text")
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(7)], "query_id int, query string")
    hits = lexical.bm25_search(docs, asked, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and ", id#" not in plan.split("hashpartitioning(")[1].split(")")[0]
    assert {(r.query_id, r.id) for r in hits.collect()} == {(q, q + 7 * i) for q in range(7) for i in range(3)}
