"""Loading, chunking, classification, pairs, runs and session edges."""

import json

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking, classify, prefs, runs, sessions
from tidemark.plans import preferences
from tidemark.sources import documents, feeds, records

TEXT = "# Top\nintro line\n\n## Sub A\n" + "word " * 300 + "\n\nsecond paragraph\n### Deep\n数据分析 内容\n## Sub B\n"


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("\nx\n  # The Title \n# Later", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("# not a title", encoding="utf-8")
    (tmp_path / "c.pdf").write_text("no", encoding="utf-8")
    got = {r.title: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"The Title", "b"} and got["b"].file_type == "text" and got["b"].mtime > 0


def test_headings_and_paragraphs(spark):
    df = spark.createDataFrame([("d", TEXT), ("e", "  "), ("f", None)], "id string, content string")
    rows = chunking.chunk_markdown(df, 400, 40).orderBy("chunk_index").collect()
    assert [r.heading_path for r in rows][0] == "Top" and rows[-1].heading_path == "Top > Sub B"
    assert "Top > Sub A > Deep" in {r.heading_path for r in rows}
    assert all(len(r.text) <= 400 for r in rows) and [r.chunk_index for r in rows] == list(range(len(rows)))
    deep = next(r for r in rows if r.heading_path.endswith("Deep"))
    assert deep.text == "### Deep\n数据分析 内容" and deep.line_end - deep.line_start == 1
    long = [r.text for r in rows if r.heading_path == "Top > Sub A"]
    assert len(long) > 3 and long[-1].endswith("second paragraph")


def test_children_belong_to_parents(spark):
    df = spark.createDataFrame([("d", TEXT)], "id string, content string")
    rows = chunking.chunk_parent_child(df, (600, 60), (200, 20)).collect()
    parents = {r.id: r for r in rows if r.chunk_type == "parent"}
    kids = [r for r in rows if r.chunk_type == "child"]
    assert kids and all(k.parent_id in parents and k.text in parents[k.parent_id].text for k in kids)
    assert all(p.id.endswith("_parent") for p in parents.values()) and len({r.id for r in rows}) == len(rows)


def test_chunks_leave_in_small_frames(spark, monkeypatch):
    """A batch of many documents is not turned into one frame of all their chunks; the chunks are the same."""
    df = spark.createDataFrame([(str(i), TEXT * (i % 3)) for i in range(60)] + [("n", None)], "id string, content string").coalesce(1)
    whole = chunking.chunk_parent_child(df, (600, 60), (200, 20))
    key = lambda rows: sorted(map(str, rows))
    want = key(whole.collect())
    monkeypatch.setattr(chunking, "PIECE_CHARS", 2000)
    assert key(chunking.chunk_parent_child(df, (600, 60), (200, 20)).collect()) == want and len(want) > 300
    frames = []
    monkeypatch.setattr(chunking, "spread", lambda rows: Rows(rows.toArrow().to_batches()))

    class Rows:
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            frames.extend(run(iter(self.batches)))

    chunking.chunk_parent_child(df, (600, 60), (200, 20))
    assert sum(f.num_rows for f in frames) == len(want) and max(sum(map(len, f.column("text").to_pylist())) for f in frames) < 3000


def test_memory_blocks_and_samples(spark):
    text = "## A\nshort\n## B\n" + "- one " + "x" * 300 + "\n- two " + "y" * 300
    df = spark.createDataFrame([("m", text)], "id string, content string")
    blocks = chunking.chunk_memory_text(df, 400)
    assert [r.block[:6] for r in blocks.orderBy("pos").collect()] == ["## A\ns", "## B", "- one ", "- two "]
    assert chunking.sample_chunks(blocks, 2, 1).count() == 2 and chunking.sample_chunks(blocks, 9, 1).count() == 4


def test_html(spark):
    page = "<title>T&eacute;</title><script>x<b></script>tail<p>a<!-- no -->b &amp; c<style>p{}</style> d</p>\n e"
    got = spark.createDataFrame([(page,)], "h string").select(documents.html_text(F.col("h")).alias("x")).first().x
    assert got == "Téab & c e"


def test_previews(spark):
    text = "a" * 30 + "\n" + "b" * 30
    row = spark.createDataFrame([(text, "x\ny\n")], "t string, u string").select(
        tx.preview(F.col("t"), 10).alias("p"), tx.line_preview(F.col("t"), 1).alias("l"), tx.head_tail(F.col("t"), 40).alias("h"), tx.lines(F.col("u")).alias("n")
    ).first()
    assert row.p == "a" * 9 + "…" and row.l == "a" * 30 + "\n...[已截断，剩余 1 行]" and row.n == ["x", "y"]
    body = row.h.split("\n\n", 1)[1]
    assert row.h.startswith("Total output lines: 2") and len(body) == 40 and "chars truncated" in body


def test_posts(spark):
    posts = [
        (1, "待招岗位：#客服 #运营\n岗位职责：量化 研究"), (2, "待招岗位：#量化研究员\n薪酬福利: 高"), (3, "招聘 兼职\n岗位要求：\n会 回测\n懂 因子"), (4, "招聘 空投"), (5, "hello"), (6, "职位: SREx 量化\n招人"), (7, "招聘\n岗位要求: RAG"),
    ]
    out = classify.classify_messages(spark.createDataFrame(posts, "id int, text string"))
    got = {r.id: (r.decision, r.reason, r.title) for r in out.collect()}
    assert got[1] == ("skipped", "skipped_irrelevant_role", "客服 运营")
    assert got[2] == ("matched", "", "量化研究员")
    assert got[3][0] == "matched" and got[7][0] == "matched"
    assert got[4][1] == "skipped_by_exclude_keywords" and got[5][1] == "skipped_no_job_intent_keywords"
    assert got[6] == ("matched", "", "SREx 量化")


def test_rule_conflicts(spark):
    rules = spark.createDataFrame(
        [(1, "必须先用 web search，不要用 shell", None, []), (2, "先用shell", None, ["禁止使用 Web  Search"]), (3, "直接用 shell", " SHELL ", [])], "id int, summary string, tool_requirement string, steps array<string>"
    )
    out = classify.rule_schema(rules)
    got = {r.id: (r.required_tools, r.forbidden_tools) for r in out.collect()}
    assert got == {1: (["web_search"], ["shell"]), 2: (["shell"], ["web_search"]), 3: (["shell"], [])}
    pairs = {(r.rule_id, r.tool, r.n_conflicts, r.first_conflict) for r in classify.rule_conflicts(out, out).collect()}
    assert pairs == {(1, "web_search", 1, 2), (1, "shell", 2, 2), (2, "shell", 1, 1), (2, "web_search", 1, 1), (3, "shell", 1, 1)}


def test_entries_and_notes(spark):
    df = spark.createDataFrame([([(" a ", 12), ("a", 1), ("", 3), ("b", -4), (None, None)],)], "e array<struct<summary:string,emotional_weight:int>>")
    got = df.select(classify.history_entries(F.col("e")).alias("x")).first().x
    assert [(r.summary, r.emotional_weight) for r in got] == [("a", 10), ("b", 0)]
    notes = spark.createDataFrame([([(" Identity ", " x "), ("identity", "x"), ("gossip", "y"), ("preference", " ")],)], "n array<struct<tag:string,content:string>>")
    assert notes.select(classify.pending_lines(F.col("n")).alias("x")).first().x == ["- [identity] x"]


def test_record_files_and_pairs(spark, tmp_path):
    wrapped = {"results": [{"case_id": "c", "question": " q ", "answer": "good", "score": 0.9}, {"case_id": "c", "question": "q", "answer": "bad", "score": 0.1}], "note": "x"}
    (tmp_path / "a.json").write_text(json.dumps(wrapped), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text(json.dumps({"prompt": "p", "response_a": "weak", "response_b": "strong", "score_a": 0.1, "score_b": 0.8}) + "\n\n", encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps([{"feedback_id": "f1", "prompt": "z", "response": "yes", "feedback": "+1"}, {"feedback_id": "f2", "prompt": "z", "response": "no", "feedback": "down"}]), encoding="utf-8")
    out = f"{tmp_path}/out"
    samples = preferences.build_preferences(spark, str(tmp_path), out)
    got = {(r.source, r.chosen, r.rejected) for r in samples.collect()}
    assert got == {("eval_harness", "good", "bad"), ("llm_judge", "strong", "weak"), ("user_feedback", "yes", "no")}
    assert set(spark.read.json(f"{out}/train").columns) == {"prompt", "chosen", "rejected"}
    again = preferences.preference_samples(records.read_records(spark, f"{out}/full"), ready_first=True)
    assert again.count() == 3


def test_small_gaps_and_equal_texts_are_no_pairs(spark):
    rows = spark.createDataFrame(
        [(1, "g", "p", "a", 0.5), (2, "g", "p", "b", 0.4), (3, "h", "p", "a", 0.9), (4, "h", "p", "a ", 0.1), (5, "k", "p", "a", 0.9), (6, "k", "p", "b", 0.3), (7, "l", "p", "a", 0.9)],
        "ord int, case_id string, prompt string, response string, score double",
    )
    got = prefs.pairs_from_scores(prefs.normalize_records(rows)).collect()
    assert [(r.chosen, round(r.score_gap, 6)) for r in got] == [("a", 0.6)]


def test_evaluation_sets_and_personas(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"name": "n", "cases": [{"case_id": "1", "query": "q", "relevant_chunk_ids": ["a", "", " "]}]}), encoding="utf-8")
    case = records.read_eval_cases(spark, str(tmp_path)).first()
    assert (case.case_id, case.relevant_chunk_ids, case.relevant_document_ids) == ("1", ["a"], [])
    (tmp_path / "q.csv").write_text("question_id,question_type,user_question_or_message,correct_answer,all_options,shared_context_id,end_index_in_shared_context,persona_id,topic\nq1,t,why,(b),\"['x', 'y, z']\",ctx,3,p,tp\n", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text(json.dumps({"ctx": [{"role": "system", "content": "profile"}, {"role": "user", "content": "User: hi"}, {"role": "assistant", "content": "Assistant: yo"}, {"role": "user", "content": "late"}]}) + "\n", encoding="utf-8")
    row = records.read_persona_cases(spark, f"{tmp_path}/q.csv", f"{tmp_path}/c.jsonl").first()
    assert (row.gold_label, row.gold_option, row.options, row.profile) == ("(b)", "y, z", ["x", "y, z"], "profile")
    assert [(t.role, t.content) for t in row.turns] == [("user", "hi"), ("assistant", "yo")]


def test_turns_become_sessions(spark):
    roles = ["user", "assistant", "user", "user", "assistant"]
    df = spark.createDataFrame([("s", i, r, "x") for i, r in enumerate([*roles, "user"])] + [("t", 0, "user", "x")], "session_key string, seq bigint, role string, content string")
    got = [r.session_no for r in sessions.turn_sessions(df).orderBy("session_key", "seq").collect()]
    assert got == [0, 0, 1, 1, 1, 1, 0]


def test_last_turn_skips_proactive_replies(spark):
    rows = [(0, "user", "<system-reminder>ctx", False), (1, "user", "hi", False), (2, "assistant", "yo", False), (3, "assistant", "news", True)]
    df = spark.createDataFrame([("s", *r) for r in rows], "session_key string, seq bigint, role string, content string, proactive boolean")
    got = sorted((r.seq, r.part) for r in sessions.last_turn(df).collect())
    assert got == [(0, "context"), (1, "user"), (2, "assistant")]
    remaining, state = sessions.undo_turn(df, spark.createDataFrame([("s", 3)], "session_key string, last_consolidated bigint"))
    assert [r.seq for r in remaining.collect()] == [3] and state.first().last_consolidated == 0


def test_feed_ids_do_not_depend_on_key_order(spark):
    rows = spark.createDataFrame([('{"kind":"alert","content":" x ","n":1}', "srv"), ('{"n":1,"content":" x ","kind":"alert"}', "srv"), ('{"kind":"content"}', "srv")], "payload string, server string")
    got = feeds.normalize_feed(rows, "alert").collect()
    assert len(got) == 2 and got[0].event_id == got[1].event_id and got[0].event_id.startswith("gev_")
    assert got[0].ack_server == "srv" and got[0].content == "x" and got[0].ack_id is None


def test_run_checks(spark):
    schema = (
        "scenario_id int, backend string, passed boolean, final_answer string, llm_calls array<struct<system_chars:int,messages_json_chars:int,tools_schema_json_chars:int,tool_count:int,estimated_input_tokens:int>>, "
        "tool_chain array<struct<calls:array<struct<name:string,status:string,human_interrupted:boolean>>>>, trace_events array<struct<type:string,tool_name:string>>"
    )
    row = (1, "a", True, "all done", [(1, 100, 50, 2, 9), (1, 80, 90, 2, 9)], [([("shell", "success", False), ("", "x", None)],)], [("interrupt.required", "shell")])
    bare = (1, "b", True, "", [], [], [])
    df = spark.createDataFrame([row, bare], schema)
    kinds = [("required_tool", "shell"), ("max_tokens", "169"), ("no_direct_shell_execution", ""), ("requires_interrupt", "shell"), ("final_contains", "done"), ("what", "")]
    specs = spark.createDataFrame([(1, k, v, {}) for k, v in kinds], "scenario_id int, kind string, value string, params map<string,string>")
    got = {(r.backend, r.kind): r.passed for r in runs.check_runs(df, specs).collect()}
    assert [got[("a", k)] for k, _ in kinds] == [True, False, False, True, True, False]
    assert [got[("b", k)] for k, _ in kinds] == [False, True, True, False, False, False]
    assert runs.compare_backends(df, "a", "b").first().tool_call_delta == 1


def test_haystack_files(spark, tmp_path):
    case = {
        "question_id": "q", "question_type": "t", "question": "?", "answer": "!", "haystack_session_ids": ["a", "b"], "haystack_dates": ["2024-01-01", "2024/01/02"], "answer_session_ids": ["b"],
        "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "x", "has_answer": True}, {"role": "assistant", "content": "y"}]],
    }
    (tmp_path / "h.json").write_text(json.dumps([case]), encoding="utf-8")
    got = [(r.session_id, r.turn_no, r.content, r.is_answer_session, r.has_answer) for r in records.read_haystack(spark, str(tmp_path)).orderBy("session_no", "turn_no").collect()]
    assert got == [("a", 0, "hi", False, False), ("b", 0, "x", True, True), ("b", 1, "y", True, False)]


def test_journal_files(spark, tmp_path):
    rows = [("[2024-01-01 10:00] a",), ("[2024-01-01 11:00] b",), ("[2024-01-02] c",), ("no day",)]
    records.write_journal(spark.createDataFrame(rows, "entry string"), f"{tmp_path}/j", files_per_day=2)
    got = {(str(r.day), r.value) for r in spark.read.option("basePath", f"{tmp_path}/j").text(f"{tmp_path}/j").collect() if r.value}
    assert got == {("2024-01-01", "[2024-01-01 10:00] a"), ("2024-01-01", "[2024-01-01 11:00] b"), ("2024-01-02", "[2024-01-02] c")}


def test_feed_ids_of_nested_and_foreign_text(spark):
    import hashlib

    payload = {"kind": "alert", "content": 'é "x"', "z": {"b": [1, {"d": None, "c": 1.5}], "a": True}}
    rows = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False), 'srv"1')], "payload string, server string")
    want = hashlib.sha1(json.dumps(payload | {"ack_server": 'srv"1'}, sort_keys=True).encode()).hexdigest()[:12]
    assert feeds.normalize_feed(rows, "alert").first().event_id == f"gev_{want}"


def test_named_references_need_their_semicolon(spark):
    page = "<h1>a &amp; b &amp</h1><p>&ampX; &copy; &#65;&#x42 &amp;quot; &nope; &notin;</p>"
    got = spark.createDataFrame([(page,)], "h string").select(documents.html_text(F.col("h")).alias("x")).first().x
    assert got == "a & b &amp&ampX; © AB &quot; &nope; ∉"


def test_lines_and_words_of_odd_posts(spark):
    import re

    texts = ["", " \n", "a\r\nb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029j", "\u3000x y \n\n\t z \r", "one", "岗位要求：　RAG\nagent \x1f\n职位: \n", "AGENT\n量化 agents 市场风险 市场", "rag_ RAG. İbi BI KBI"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lines = {r.id: r.x for r in df.select("id", classify.post_lines(F.col("text")).alias("x")).collect()}
    assert lines == {i: [x.strip() for x in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", t) if x.strip()] for i, t in enumerate(texts)}
    sections = {r.id: r.x for r in df.select("id", classify.post_sections(F.col("text")).alias("x")).collect()}
    assert (sections[5].duties, sections[5].needs, sections[5].title) == ("", "RAG\nagent", "")
    words = ("Agent", "RAG", "BI", "市场", "量化")
    rules = classify.PostRules(exclude=(), irrelevant=words, intent=(), target=(), whole_words=words[:3])
    got = {r.id: r.matched_irrelevant for r in classify.classify_messages(df, rules).collect()}

    def whole(w, t):
        return re.search(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])", t, re.I | re.A)

    assert got[6] == ["Agent", "市场", "量化"] and got[7] == [w for w in words[:3] if whole(w, texts[7])]
