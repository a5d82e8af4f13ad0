"""Documents, pages and logs through loading, chunking, classification, pairs and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking, classify, dedup, evals, maintain, prefs, relations
from tidemark.plans import preferences
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query
from tidemark.registry.memory_queries import big, items, key, labelled, now
from tidemark.sources import documents, feeds, records


def joined(col, sep: str = "|") -> Column:
    return F.array_join(col, sep)


# -- sources ----------------------------------------------------------------------------------


@query(
    "doc_scan",
    """WITH d AS (SELECT *, source || '/d' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.Markdown' ELSE '.pdf' END AS path FROM documents)
    SELECT doc_id, 'kdoc_' || substr(sha1(path), 1, 20) AS id, CASE lang WHEN 'en' THEN 'About ' || source ELSE 'd' || doc_id END AS title, CASE lang WHEN 'fr' THEN 'text' ELSE 'markdown' END AS file_type,
      sha256(CASE lang WHEN 'en' THEN chr(10) || '#  About ' || source || ' ' || chr(10) || text ELSE text END) AS content_hash FROM d WHERE lang <> 'es'""",
)
def doc_scan(t: Tables) -> DataFrame:
    lang = F.col("lang")
    suffix = F.when(lang == "en", ".md").when(lang == "fr", ".txt").when(lang == "de", ".Markdown").otherwise(".pdf")
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), suffix)
    body = F.when(lang == "en", F.concat(F.lit("\n#  About "), "source", F.lit(" \n"), "text")).otherwise(F.col("text"))
    rows = t.documents.select("doc_id", path.alias("source_path"), body.alias("content"))
    return documents.document_rows(rows).select("doc_id", "id", "title", "file_type", "content_hash")


_PAYLOAD = f"""p AS (SELECT event_id AS n, user_id % 10 AS srv, event_type, '{{' || CASE WHEN event_id % 3 = 0 THEN '"event_id":"e' || event_id || '",' ELSE '' END || '"content":"' || event_type || '","k":' || {q.key_of()} || ',"kind":"' ||
    CASE WHEN event_type IN ('error', 'signup') THEN 'alert' ELSE 'content' END || '","source_name":" s' || (user_id % 10) || ' "}}' AS payload, {q.key_of()} AS k FROM events)"""


@query(
    "feed_normalize",
    f"""WITH {_PAYLOAD}, r AS (SELECT n, CASE WHEN event_type IN ('error', 'signup') THEN 'alert' ELSE 'content' END AS kind, srv, event_type, k, 's' || srv AS source_name FROM p)
    SELECT n, kind, CASE WHEN n % 3 = 0 THEN 'e' || n ELSE CASE kind WHEN 'alert' THEN 'gev_' ELSE 'gcv_' END || substr(sha1('{{"ack_server": "srv' || srv || '", "content": "' || event_type || '", "k": ' || k || ', "kind": "' || kind || '", "note": {{"a": [1], "b": "\\u00e9\\""}}, "source_name": " s' || srv || ' "}}'), 1, 12) END AS event_id,
      source_name, event_type AS content, 'srv' || srv AS ack_server, CASE WHEN kind = 'alert' AND n % 3 <> 0 THEN '' WHEN n % 3 = 0 THEN 'e' || n ELSE 'made' END AS ack FROM r""",
)
def feed_normalize(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "signup"), "alert").otherwise("content")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    name = F.concat(F.lit(" s"), (F.col("user_id") % 10).cast("string"), F.lit(" "))
    payload = F.to_json(
        F.struct(given.alias("event_id"), F.col("event_type").alias("content"), key().alias("k"), kind.alias("kind"), name.alias("source_name"), F.struct(F.lit('é"').alias("b"), F.array(F.lit(1)).alias("a")).alias("note"))
    )
    rows = t.events.select(F.col("event_id").alias("n"), payload.alias("payload"), F.concat(F.lit("srv"), (F.col("user_id") % 10).cast("string")).alias("server"))
    both = feeds.normalize_feed(rows, "alert").unionByName(feeds.normalize_feed(rows, "content"))
    ack = F.when(F.col("ack_id").isNull(), "").when(F.col("n") % 3 == 0, F.col("ack_id")).otherwise("made")
    return both.select("n", "kind", "event_id", "source_name", "content", "ack_server", ack.alias("ack"))


@query(
    "journal_sink",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, md5(string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' ' || event_id, chr(10) ORDER BY event_id)) AS digest FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def journal_sink(t: Tables) -> DataFrame:
    stamp = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise("soon")
    rows = t.events.select("event_id", F.concat(F.lit("["), stamp, F.lit("] "), "event_type", F.lit(" "), F.col("event_id").cast("string")).alias("entry"))
    days = records.journal_rows(rows)
    lines = F.array_sort(F.collect_list(F.struct("event_id", "entry")))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.md5(joined(F.transform(lines, lambda r: r["entry"]), "\n")).alias("digest"))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\b[^>]*>.*?</script\s*>[^<]*', '', 'gsi'),
  '<style\b[^>]*>.*?</style\s*>[^<]*', '', 'gsi'), '<noscript\b[^>]*>.*?</noscript\s*>[^<]*', '', 'gsi'), '<[^>]*>', '', 'gs')"""


@query(
    "html_text",
    f"""WITH h AS (SELECT page_id, replace(replace(replace(replace({_HTML}, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS s FROM pages)
    SELECT page_id, {q.strip(q.squash("s"))} AS text FROM h""",
)
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", documents.html_text(F.col("html")).alias("text"))


@query(
    "legacy_nest",
    """SELECT o_orderkey, 0::BIGINT AS part, count(l_orderkey) AS n_hits, count(*) FILTER (l_returnflag = 'R') AS injected_count,
      coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS hits FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def legacy_nest(t: Tables) -> DataFrame:
    fields = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_linenumber")]
    steps = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = relations.nest_hits(t.orders.select("o_orderkey"), steps, "o_orderkey", "l_linenumber", fields, F.col("l_returnflag") == "R")
    text = F.transform("hits", lambda h: F.concat_ws(":", h["l_linenumber"].cast("string"), h["l_partkey"].cast("string"), h["l_suppkey"].cast("string")))
    return out.select("o_orderkey", *big("part"), F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("n_hits"), "injected_count", F.coalesce(joined(text), F.lit("")).alias("hits"))


@query(
    "haystack_scan",
    """SELECT 'q' || conv_id AS question_id, turn // 2 AS session_no, turn % 2 AS turn_no, role, md5(text) AS digest, turn // 2 = 1 AS is_answer_session, strftime(DATE '2024-01-01' + (turn // 2)::INT, '%Y-%m-%d') AS day FROM conversations""",
)
def haystack_scan(t: Tables) -> DataFrame:
    turn = F.struct("turn", "role", F.col("text").alias("content"), (F.col("turn") == 2).alias("has_answer"))
    rows = t.conversations.withColumn("s", F.floor(F.col("turn") / 2)).groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    slim = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["has_answer"].alias("has_answer")))
    nested = rows.withColumn("turns", slim).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", "turns"))).alias("ss"))
    form = lambda s: F.when(s == 0, "2024-01-01").when(s == 1, "2024/01/02").otherwise(F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), s.cast("int")), "yyyy-MM-dd"), F.lit(" 10:00:00")))
    cases = nested.select(
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), F.lit("multi").alias("question_type"), F.lit("?").alias("question"), F.lit("!").alias("answer"),
        F.transform("ss", lambda x: F.concat(F.lit("s"), x["s"].cast("string"))).alias("haystack_session_ids"), F.transform("ss", lambda x: form(x["s"])).alias("haystack_dates"),
        F.transform("ss", lambda x: x["turns"]).alias("haystack_sessions"), F.array(F.lit("s1")).alias("answer_session_ids"),
    )
    out = records.haystack_turns(cases)
    return out.select(
        "question_id", F.substring("session_id", 2, 9).cast("bigint").alias("session_no"), *big("turn_no"), "role", F.md5("content").alias("digest"), "is_answer_session",
        F.date_format("session_at", "yyyy-MM-dd").alias("day"),
    )


@query(
    "persona_scan",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT 'q' || conv_id AS question_id, '(b)' AS gold_label, 'it''s b' AS gold_option, count(*) FILTER (role <> 'system') AS n_turns, md5(coalesce(string_agg({q.strip("text")}, chr(10) || chr(10) ORDER BY n) FILTER (role = 'system'), '')) AS profile FROM c GROUP BY conv_id""",
)
def persona_scan(t: Tables) -> DataFrame:
    """Each conversation with a question at its end: the context is one nested record, as in its file."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    prefix = lambda m: F.when(m["role"] == "user", F.concat(F.lit(" User: "), m["text"])).otherwise(m["text"])
    contexts = t.conversations.groupBy(F.col("conv_id").cast("string").alias("shared_context_id")).agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), prefix(m).alias("content"))).alias("messages"))
    asked = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("end_index_in_shared_context")).select(
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), F.lit("t").alias("question_type"), F.lit("why").alias("user_question_or_message"),
        F.lit(" (B) ").alias("correct_answer"), F.lit("""['one', "it's b", 'c']""").alias("all_options"), F.col("conv_id").cast("string").alias("shared_context_id"), "end_index_in_shared_context",
    )
    out = records.persona_cases(asked, contexts)
    return out.select("question_id", "gold_label", "gold_option", F.size("turns").cast("bigint").alias("n_turns"), F.md5("profile").alias("profile"))


# -- indexing ---------------------------------------------------------------------------------


@query(
    "active_chunks",
    "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0 AND d.lang <> 'es'",
)
def active_chunks(t: Tables) -> DataFrame:
    docs = t.labels.select(F.col("doc_id").alias("id"), "quality", F.when(F.col("toxic") == 0, "active").otherwise("deleted").alias("status"))
    kind = F.when(F.col("lang") == "es", "parent").when(F.col("lang") == "de", F.lit(None)).otherwise("child")
    chunks = t.documents.select(F.col("doc_id").alias("document_id"), kind.alias("chunk_type"))
    return relations.searchable(chunks, docs).select(F.col("document_id").alias("doc_id"), "quality")


def doc_table(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), F.sha2("text", 256).alias("content_hash"), "doc_id"
    )


@query(
    "incremental_skip",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0",
)
def incremental_skip(t: Tables) -> DataFrame:
    new = doc_table(t)
    old = new.join(t.labels, "doc_id").select("source_path", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("stale").alias("content_hash"))
    return relations.changed_docs(new, old).select("doc_id")


@query(
    "upsert_documents",
    f"""SELECT 'd' || d.doc_id AS id, sha256(text) AS content_hash, CASE WHEN l.doc_id IS NULL THEN '2024-01-31' ELSE '2024-01-01' END AS created, CASE WHEN lang = 'en' THEN '2024-01-31' ELSE '2024-01-01' END AS updated
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR lang = 'en'""",
)
def upsert_documents(t: Tables) -> DataFrame:
    first = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    base = doc_table(t)
    target = base.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        "id", "source_path", "content_hash", first.alias("created_at"), first.alias("updated_at"), F.lit("active").alias("status")
    )
    changes = base.join(t.documents.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("id", "source_path", "content_hash")
    out = maintain.upsert_docs(target, changes, now())
    day = lambda c, a: F.date_format(c, "yyyy-MM-dd").alias(a)
    return out.select("id", "content_hash", day("created_at", "created"), day("updated_at", "updated"))


@query(
    "replace_children",
    "SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR lang = 'en'",
)
def replace_children(t: Tables) -> DataFrame:
    old = t.labels.select(F.col("doc_id").alias("document_id"), F.lit("old").alias("version"))
    new = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("document_id"), F.lit("new").alias("version"))
    return maintain.replace_children(old, new).select(F.col("document_id").alias("doc_id"), "version")


def cut(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


# a text without headings and blank lines is one section: either whole, or cut by windows of 1200 with step 1080
_WINDOWS = f"""s AS (SELECT doc_id, {q.strip("array_to_string(" + q.line_list("text") + ", chr(10))")} AS x FROM documents),
  w AS (SELECT doc_id, i, CASE WHEN length(x) <= 1200 THEN x ELSE {q.strip("substr(x, i * 1080 + 1, 1200)")} END AS piece FROM
    (SELECT doc_id, x, unnest(range(0, CASE WHEN length(x) <= 1200 THEN 1 ELSE (length(x) - 120 + 1079) // 1080 END)) AS i FROM s WHERE x <> ''))"""


@query(
    "chunk_markdown",
    f"""WITH {_WINDOWS} SELECT doc_id::VARCHAR AS document_id, i AS chunk_index, 'kchunk_' || substr(sha1(doc_id || ':' || i || ':' || piece), 1, 20) AS id, length(piece) AS n_chars, greatest(1, length(piece) // 4) AS token_count,
      sha256(piece) AS content_hash FROM w""",
)
def chunk_markdown(t: Tables) -> DataFrame:
    out = chunking.chunk_markdown(cut(t))
    return out.select("document_id", *big("chunk_index"), "id", F.length("text").cast("bigint").alias("n_chars"), *big("token_count"), "content_hash")


@query("chunk_parent_child")
def chunk_parent_child(t: Tables) -> DataFrame:
    out = chunking.chunk_parent_child(cut(t))
    return out.select("document_id", "id", "parent_id", "chunk_type", "chunk_index", "heading_path", "line_start", "line_end", "token_count", "content_hash")


@query(
    "chunk_memory_text",
    f"""WITH s AS (SELECT doc_id, {q.strip("text")} AS x FROM documents) SELECT doc_id, 0::BIGINT AS pos, md5(CASE WHEN length(x) <= 100000000 AND length(x) <= 400 THEN x ELSE array_to_string(list_filter(list_transform({q.line_list("x")}, lambda l: {q.strip("l")}), lambda l: l <> ''), chr(10)) END) AS digest FROM s WHERE x <> ''""",
)
def chunk_memory_text(t: Tables) -> DataFrame:
    out = chunking.chunk_memory_text(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return out.select(F.col("id").alias("doc_id"), *big("pos"), F.md5("block").alias("digest"))


@query("sample_chunks")
def sample_chunks(t: Tables) -> DataFrame:
    blocks = chunking.chunk_markdown(cut(t), 400, 0).select(F.col("document_id").alias("id"), F.col("chunk_index").alias("pos"), F.col("text").alias("block"))
    return chunking.sample_chunks(blocks, 3, seed=7)


# -- near duplicates and history --------------------------------------------------------------


@query(
    "near_duplicates",
    f"""WITH n AS (SELECT doc_id, {q.squash("lower(text)", "")} AS s FROM documents), c AS (SELECT doc_id, string_split(s, '') AS c FROM n WHERE length(s) > 1),
    g AS (SELECT DISTINCT doc_id, a || b AS gram FROM (SELECT doc_id, unnest(c[1:len(c)-1]) AS a, unnest(c[2:len(c)]) AS b FROM c)),
    z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    i AS (SELECT x.doc_id AS id, y.doc_id AS other, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND y.doc_id < x.doc_id GROUP BY 1, 2),
    j AS (SELECT id, other, round(k / (a.n + b.n - k)::DOUBLE, 9) AS score FROM i JOIN z a ON a.doc_id = id JOIN z b ON b.doc_id = other),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM j WHERE score >= 0.45)
    SELECT id AS doc_id, other AS similar_id, round(score, 6) AS score FROM r WHERE n = 1""",
)
def near_duplicates(t: Tables) -> DataFrame:
    out = dedup.near_dups(t.documents, id_col="doc_id")
    return out.select(F.col("id").alias("doc_id"), "similar_id", F.round("score", 6).alias("score"))


@query(
    "history_entries",
    f"""WITH e AS (SELECT conv_id, turn, {q.strip("text")} AS s, least(10, turn * 2) AS w FROM conversations WHERE role <> 'system'),
    f AS (SELECT conv_id, s, min(turn) AS turn, arg_min(w, turn) AS w FROM e WHERE s <> '' GROUP BY 1, 2)
    SELECT c.conv_id, count(s) AS n, coalesce(sum(w), 0)::BIGINT AS weight, md5(coalesce(string_agg(s, '|' ORDER BY turn), '')) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) GROUP BY 1""",
)
def history_entries(t: Tables) -> DataFrame:
    text = F.when(F.col("role") == "system", "  ").otherwise(F.concat(F.lit(" "), "text"))
    twice = F.explode(F.sequence(F.lit(0), F.lit(1)))
    rows = t.conversations.select("conv_id", "turn", text.alias("summary"), (F.col("turn") * 2).cast("int").alias("emotional_weight"), twice.alias("again"))
    kept = classify.history_rows(rows.withColumn("ord", F.struct("turn", "again")), ["conv_id"], "ord")
    mine = kept.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("emotional_weight").alias("weight"), F.array_sort(F.collect_list(F.struct("ord", "summary"))).alias("h"),
    )
    every = t.conversations.select("conv_id").distinct().join(mine, "conv_id", "left")
    none = F.array().cast("array<string>")
    return every.select(
        "conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"),
        F.md5(joined(F.coalesce(F.transform("h", lambda x: x["summary"]), none))).alias("digest"),
    )


@query(
    "snapshot_diff",
    f"""WITH {q.items_cte()}, m AS (SELECT mi.*, l.quality FROM mi LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality = 0)
    SELECT id AS item_id, memory_type, md5(summary) AS digest FROM m""",
)
def snapshot_diff(t: Tables) -> DataFrame:
    mine = items(t)
    moved = mine.select(*[F.concat(F.lit("new:"), F.col(c)).alias(c) if c == "id" else F.col(c) for c in mine.columns])
    both = mine.unionByName(moved)
    base = mine.join(labelled(t), "id").select("id", F.when(F.col("quality") == 1, F.col("updated_at")).alias("updated_at"))
    base = base.unionByName(base.select(F.concat(F.lit("new:"), "id").alias("id"), "updated_at"))
    out = maintain.changed_since(both, base)
    return out.select("item_id", "memory_type", F.md5("summary").alias("digest"))


# -- classification ---------------------------------------------------------------------------

RULES = classify.PostRules(
    exclude=("src19", "blees"), irrelevant=("es", "src4"), intent=("tion", "über"), target=("src1", "src2", "src3", "src5", "edon", "ver"), strong=("ver",),
    whole_words=("src1", "src2", "src3", "src4", "src5", "src19", "es", "edon", "ver"),
)


def _word(x: str, w: str) -> str:
    return rf"regexp_matches({x}, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(_word(x, w) if w in RULES.whole_words else f"contains(lower({x}), '{w}')" for w in words) + ")"


_POST = "CASE WHEN n_chars % 3 = 0 THEN '岗位职责：' || chr(10) || text ELSE '职位: #' || source || '  ' || lang || chr(10) || '岗位要求: ' || text END"
_TITLE = "CASE WHEN n_chars % 3 = 0 THEN '' ELSE source || ' ' || lang END"


@query(
    "message_classify",
    f"""WITH p AS (SELECT doc_id, {_POST} AS body, {_TITLE} AS title, array_to_string({q.line_list("text")}, chr(10)) AS duties FROM documents),
    f AS (SELECT doc_id, title, {_any("body", RULES.exclude)} AS ex, {_any("CASE WHEN title <> '' THEN title ELSE body END", RULES.irrelevant)} AS irr, {_any("body", RULES.intent)} AS intent,
      {_any("title", RULES.target)} AS tt, {" + ".join(_any("duties", [w]) + "::INT" for w in RULES.target)} AS nb, {_any("duties", RULES.strong)} AS strong FROM p),
    r AS (SELECT doc_id, title, CASE WHEN ex THEN 'skipped_by_exclude_keywords' WHEN title <> '' AND irr THEN 'skipped_irrelevant_role' WHEN NOT intent THEN 'skipped_no_job_intent_keywords'
      WHEN title <> '' AND tt THEN '' WHEN title = '' AND (nb >= 2 OR strong) THEN '' ELSE 'skipped_no_title_target_keywords' END AS reason FROM f)
    SELECT doc_id, title, reason, CASE WHEN reason = '' THEN 'matched' ELSE 'skipped' END AS decision FROM r""",
)
def message_classify(t: Tables) -> DataFrame:
    out = classify.classify_messages(posts(t), RULES)
    return out.select("doc_id", "title", "reason", "decision")


def posts(t: Tables) -> DataFrame:
    plain = F.concat(F.lit("岗位职责：\n"), "text")
    named = F.concat(F.lit("职位: #"), "source", F.lit("  "), "lang", F.lit("\n岗位要求: "), "text")
    return t.documents.select("doc_id", F.when(F.col("n_chars") % 3 == 0, plain).otherwise(named).alias("text"))


@query(
    "attachment_filter",
    """WITH a AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 'f.MP3' WHEN 1 THEN 'f.mp4' WHEN 2 THEN 'f.bin' ELSE '' END AS fn, CASE WHEN page_id % 3 = 0 THEN 'audio/mpeg' WHEN page_id % 3 = 1 THEN 'video/mp4' ELSE 'audio/ogg' END AS mime FROM pages),
    k AS (SELECT *, lower(html || chr(10) || fn || chr(10) || mime) AS s FROM a WHERE NOT (page_id % 4 = 1 OR page_id % 3 = 1) AND (page_id % 4 = 0 OR mime IN ('audio/mpeg', 'audio/ogg')))
    SELECT page_id, concat_ws('|', CASE WHEN contains(s, 'tion') THEN 'tion' END, CASE WHEN contains(s, 'mpeg') THEN 'MPEG' END) AS keywords FROM k WHERE (contains(s, 'tion') OR contains(s, 'mpeg')) AND NOT contains(s, 'über')""",
)
def attachment_filter(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    m = F.col("page_id") % 3
    rows = t.pages.select(
        "page_id", F.col("html").alias("text"), F.when(n == 0, "f.MP3").when(n == 1, "f.mp4").when(n == 2, "f.bin").otherwise("").alias("filename"),
        F.when(m == 0, "audio/mpeg").when(m == 1, "video/mp4").otherwise("audio/ogg").alias("mime"),
    )
    out = classify.filter_attachments(rows, ["tion", "MPEG"], ["ÜBER"])
    return out.select("page_id", joined("matched_keywords").alias("keywords"))


@query(
    "mention_filter",
    f"""SELECT conv_id, turn, {q.strip("text")} AS clean FROM conversations WHERE turn % 2 = 0 AND conv_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50)""",
)
def mention_filter(t: Tables) -> DataFrame:
    at = F.when(F.col("turn") % 2 == 0, "[CQ:at,qq=42,name=x]").otherwise("[CQ:at,qq=7]")
    rows = t.conversations.select("conv_id", "turn", F.col("conv_id").alias("sender"), F.concat(at, F.lit(" "), "text").alias("raw"))
    allow = t.events.filter("event_type = 'signup' AND value > 50").select(F.col("user_id").alias("sender"))
    return classify.filter_group(rows, allow, "42").select("conv_id", "turn", "clean")


def rules(t: Tables) -> DataFrame:
    """Rules whose tools come from the row: some name a tool, some forbid one, some mention two."""
    tool = F.concat(F.lit("tool"), (F.col("p_partkey") % 50).cast("string"))
    other = F.concat(F.lit("aid"), (F.col("p_size") % 7).cast("string"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("回答前必须先用 "), tool, F.lit("，不要用 "), other)).otherwise(F.concat(F.lit("禁止使用"), tool, F.lit(" Pro。直接用"), other))
    named = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" Extra"), (F.col("p_size") % 5).cast("string")))
    steps = F.when(F.col("p_size") % 4 == 0, F.array(F.concat(F.lit("先用 "), other))).otherwise(F.array().cast("array<string>"))
    return t.part.select(F.col("p_partkey").alias("id"), text.alias("summary"), named.alias("tool_requirement"), steps.alias("steps"))


_RULES = """ru AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS ev, 'tool' || (p_partkey % 50) AS tl, 'aid' || (p_size % 7) AS ot, CASE WHEN p_size % 3 = 0 THEN 'extra' || (p_size % 5) END AS ex, p_size % 4 = 0 AS st FROM part),
  rs AS (SELECT id, list_sort(list_distinct(list_filter([CASE WHEN ev THEN tl END, CASE WHEN NOT ev OR st THEN ot END, ex], lambda x: x IS NOT NULL))) AS req,
      CASE WHEN ev THEN ot ELSE tl || '_pro' END AS fb, list_sort(list_distinct(list_filter([tl, ot, ex, CASE WHEN NOT ev THEN 'pro' END, CASE WHEN NOT ev THEN tl || '_pro' END], lambda x: x IS NOT NULL))) AS men FROM ru),
  rz AS (SELECT id, req, CASE WHEN list_contains(req, fb) THEN CAST([] AS VARCHAR[]) ELSE [fb] END AS forb, men FROM rs)"""


@query("rule_schema", f"WITH {_RULES} SELECT id, array_to_string(req, '|') AS required, array_to_string(forb, '|') AS forbidden, array_to_string(men, '|') AS mentioned FROM rz")
def rule_schema(t: Tables) -> DataFrame:
    out = classify.rule_schema(rules(t))
    return out.select("id", joined("required_tools").alias("required"), joined("forbidden_tools").alias("forbidden"), joined("mentioned_tools").alias("mentioned"))


@query(
    "rule_conflicts",
    f"""WITH {_RULES}, r AS (SELECT id, unnest(req) AS tool FROM rz), f AS (SELECT id, unnest(forb) AS tool FROM rz)
    SELECT r.id AS rule_id, r.tool, 'required_tools' AS side, count(*) AS n_conflicts, min(f.id) AS first_conflict FROM r JOIN f USING (tool) GROUP BY 1, 2
    UNION ALL SELECT f.id, f.tool, 'forbidden_tools', count(*), min(r.id) FROM f JOIN r USING (tool) GROUP BY 1, 2""",
)
def rule_conflicts(t: Tables) -> DataFrame:
    out = classify.rule_schema(rules(t))
    return classify.rule_conflicts(out, out)


@query(
    "procedure_match",
    """WITH r AS (SELECT p_partkey AS id, p_partkey % 3 AS m, split_part(p_name, ' ', 1) AS w1, lower(p_type) AS ty, p_size FROM part),
    a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2 FROM part)
    SELECT t1 || ' ' || t2 AS action_id, id FROM a, r WHERE CASE WHEN m = 0 THEN contains(lower(t1 || ' ' || t2), lower(w1)) WHEN p_size % 10 = 9 THEN false ELSE w1 IN (t1, t2) OR ty IN (t1, t2) END""",
)
def procedure_match(t: Tables) -> DataFrame:
    word = F.element_at(F.split("p_name", " "), 1)
    none = F.array().cast("array<string>")
    many = F.array(*[F.lit(f"x{i}") for i in range(4)], word)
    made = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.upper(word), F.lit("ab"))).otherwise(F.array(F.lit("no"))).alias("keywords"),
        F.when(F.col("p_size") % 10 == 9, many).otherwise(F.array(word)).alias("tools"), F.array(F.col("p_type")).alias("skills"), none.alias("unused"),
    )
    actions = t.part.select(F.slice(F.split("p_name", " "), 1, 2).alias("tokens")).distinct()
    actions = actions.select(joined("tokens", " ").alias("action_id"), "tokens")
    return classify.match_procedures(made, actions)


# -- pairs and scores -------------------------------------------------------------------------


def scored_docs(t: Tables) -> DataFrame:
    value = F.col("quality") * 0.6 + F.col("toxic") * 0.3
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("prompt_id"), F.concat(F.lit(" write "), "lang", F.lit(" ")).alias("question"), F.col("text").alias("answer"), value.alias("judge_score"),
        F.concat(F.lit("rag "), "lang").alias("task_type"),
    )


_SCORED = f"sd AS (SELECT doc_id, source AS g, 'write ' || lang AS prompt, {q.strip('text')} AS resp, round(quality * 0.6 + toxic * 0.3, 9) AS score FROM documents JOIN labels USING (doc_id))"


@query("record_coalesce", f"WITH {_SCORED} SELECT doc_id AS ord, g AS group_key, prompt, md5(resp) AS digest, round(score, 6) AS score, 'rag_qa' AS task_type FROM sd WHERE resp <> ''")
def record_coalesce(t: Tables) -> DataFrame:
    out = prefs.normalize_records(scored_docs(t))
    return out.select("ord", "group_key", "prompt", F.md5("response").alias("digest"), F.round("score", 6).alias("score"), "task_type")


_EVAL_PAIRS = f"""{_SCORED}, e AS (SELECT g, count(*) AS n, arg_max(doc_id, score * 1000000 - doc_id * 0.000001) AS c, arg_min(doc_id, score * 1000000 - doc_id * 0.000001) AS r FROM sd WHERE resp <> '' GROUP BY 1),
  pp AS (SELECT 'pref_' || substr(sha256('eval|' || e.g || '|' || a.resp || '|' || b.resp), 1, 24) AS sample_id, a.prompt, a.resp AS chosen, b.resp AS rejected, a.score AS sc, b.score AS sr FROM e JOIN sd a ON a.doc_id = c JOIN sd b ON b.doc_id = r WHERE n >= 2)"""


def eval_pairs(t: Tables) -> DataFrame:
    return prefs.pairs_from_scores(prefs.normalize_records(scored_docs(t)))


def shown(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.round("score_gap", 6).alias("score_gap"), "task_type")


@query("preference_pairs_scored", f"WITH {_EVAL_PAIRS} SELECT sample_id, prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, round(sc - sr, 6) AS score_gap, 'rag_qa' AS task_type FROM pp WHERE sc - sr >= 0.2 AND chosen <> rejected")
def preference_pairs_scored(t: Tables) -> DataFrame:
    return shown(eval_pairs(t))


def ab_rows(t: Tables) -> DataFrame:
    a = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("response_a"))
    b = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_b"))
    scored = F.col("turn") % 4 == 0
    return a.join(b, ["conv_id", "turn"]).select(
        F.concat(F.lit("ask "), F.col("conv_id").cast("string")).alias("prompt"), "response_a", "response_b", F.when(scored, (F.col("conv_id") % 10).cast("double") / 10).alias("score_a"),
        F.when(scored, F.lit("0.35")).alias("score_b"), F.when(F.col("conv_id") % 3 == 0, "B").when(F.col("conv_id") % 3 == 1, "chosen_a").otherwise("tie").alias("winner"), F.lit("tool x").alias("task_type"),
    )


_AB = f"""ab AS (SELECT 'ask ' || a.conv_id AS prompt, {q.strip("a.text")} AS ra, {q.strip("b.text")} AS rb,
    CASE WHEN a.turn % 4 = 0 THEN (a.conv_id % 10) / 10.0::DOUBLE WHEN a.conv_id % 3 = 0 THEN 0 WHEN a.conv_id % 3 = 1 THEN 1 ELSE 0.5 END AS sa, CASE WHEN a.turn % 4 = 0 THEN 0.35 WHEN a.conv_id % 3 = 0 THEN 1 WHEN a.conv_id % 3 = 1 THEN 0 ELSE 0.5 END::DOUBLE AS sb
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
  ap AS (SELECT prompt, CASE WHEN sa >= sb THEN ra ELSE rb END AS chosen, CASE WHEN sa >= sb THEN rb ELSE ra END AS rejected, abs(sa - sb) AS gap FROM ab WHERE ra <> '' AND rb <> '' AND ra <> rb),
  aq AS (SELECT 'pref_' || substr(sha256('judge|' || prompt || '|' || chosen || '|' || rejected), 1, 24) AS sample_id, * FROM ap WHERE gap >= 0.2)"""


@query("preference_pairs_ab", f"WITH {_AB} SELECT sample_id, prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, round(gap, 6) AS score_gap, 'tool_use' AS task_type FROM aq")
def preference_pairs_ab(t: Tables) -> DataFrame:
    return shown(prefs.pairs_from_ab(ab_rows(t)))


def feedback_rows(t: Tables) -> DataFrame:
    vote = F.when(F.col("event_type").isin("purchase", "signup"), " Like").when(F.col("event_type") == "error", "-1").otherwise("neutral")
    return t.events.select(
        F.col("event_id").alias("ord"), F.col("event_id").alias("feedback_id"), F.lit("say").alias("prompt"), F.concat_ws(" ", F.lit("r"), key().cast("string")).alias("response"), vote.alias("feedback"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("conversation_id"), F.when(F.col("event_type") == "signup", F.lit(0.9)).alias("score"),
    )


_FB = f"""fb AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS g, event_id, 'r ' || {q.key_of()} AS resp, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.9 WHEN 'error' THEN 0.0 ELSE 0.5 END AS v FROM events),
  fe AS (SELECT g, arg_max(resp, v * 1000000000 - event_id) FILTER (v > 0.5) AS c, max(v) FILTER (v > 0.5) AS cv, arg_min(resp, event_id) FILTER (v < 0.5) AS r FROM fb GROUP BY 1),
  fp AS (SELECT 'pref_' || substr(sha256('feedback|' || g || '|' || c || '|' || r), 1, 24) AS sample_id, c AS chosen, r AS rejected, cv FROM fe WHERE c IS NOT NULL AND r IS NOT NULL AND c <> r)"""


@query("preference_pairs_feedback", f"WITH {_FB} SELECT sample_id, 'say' AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, round(cv, 6) AS score_gap, 'general_chat' AS task_type FROM fp")
def preference_pairs_feedback(t: Tables) -> DataFrame:
    return shown(prefs.pairs_from_feedback(feedback_rows(t)))


@query(
    "dedup_samples",
    f"""WITH {_EVAL_PAIRS}, {_AB}, {_FB}, u AS (SELECT sample_id, prompt FROM pp WHERE sc - sr >= 0.2 AND chosen <> rejected UNION SELECT sample_id, prompt FROM aq UNION SELECT sample_id, 'say' FROM fp) SELECT sample_id, prompt FROM u""",
)
def dedup_samples(t: Tables) -> DataFrame:
    parts = [eval_pairs(t), prefs.pairs_from_ab(ab_rows(t)), prefs.pairs_from_feedback(feedback_rows(t)), prefs.pairs_from_ab(ab_rows(t))]
    return maintain.dedup_samples(*[p.withColumn("ord", F.xxhash64("sample_id")) for p in parts]).select("sample_id", "prompt")


ALL_PAIRS = f"""WITH {_EVAL_PAIRS}, {_AB}, {_FB}, al AS (
    SELECT sample_id, prompt, chosen, rejected, 'eval_harness' AS source, 'rag_qa' AS task_type FROM pp WHERE sc - sr >= 0.2 AND chosen <> rejected
    UNION SELECT sample_id, prompt, chosen, rejected, 'llm_judge', 'tool_use' FROM aq UNION SELECT sample_id, 'say', chosen, rejected, 'user_feedback', 'general_chat' FROM fp)"""


def all_samples(t: Tables) -> DataFrame:
    """Samples from the logs of all three kinds."""
    logs = {"eval_harness": scored_docs(t), "llm_judge": ab_rows(t).withColumn("score_a", F.col("score_a").cast("string")), "user_feedback": feedback_rows(t)}
    parts = [preferences.preference_samples(rows, source=kind) for kind, rows in logs.items()]
    return maintain.dedup_samples(*[p.withColumn("ord", F.xxhash64("sample_id")) for p in parts])


_SETF = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: w <> ''))"


def _set_f1(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {inter} = 0 THEN 0 ELSE 2 * ({inter} / len({a})::DOUBLE) * ({inter} / len({b})::DOUBLE) / ({inter} / len({a})::DOUBLE + {inter} / len({b})::DOUBLE) END"


@query(
    "model_comparison",
    f"""WITH s AS (SELECT {_SETF.format(x="a.text")} AS x, {_SETF.format(x="b.text")} AS y, {_SETF.format(x="d.text")} AS z FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 JOIN documents d ON d.doc_id = a.doc_id + 2),
    f AS (SELECT {_set_f1("x", "z")} AS b, {_set_f1("y", "z")} AS n FROM s)
    SELECT count(*) AS num_prompts, round(avg((n > b)::INT), 4) AS win_rate, round(avg((n = b)::INT), 4) AS tie_rate, round(avg(b), 4) AS avg_score_base, round(avg(n), 4) AS avg_score_new, round(avg(n - b), 4) AS score_delta FROM f""",
)
def model_comparison(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    one = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new_answer"))
    two = d.select((F.col("doc_id") - 2).alias("doc_id"), F.col("text").alias("reference"))
    rows = d.withColumnRenamed("text", "base_answer").join(one, "doc_id").join(two, "doc_id")
    out = evals.compare_models(rows)
    return out


def option_rows(t: Tables) -> DataFrame:
    m = F.col("event_id") % 6
    said = (
        F.when(m == 0, "I pick (B) now").when(m == 1, "answer is c").when(m == 2, F.concat(F.lit("kind "), "event_type")).when(m == 3, "quite the kind error here it is").when(m == 4, "nothing fits this")
    )
    options = F.array(F.lit("kind click"), F.lit("kind view"), F.lit("kind error"), F.lit("kind signup"))
    return t.events.select("event_id", "event_type", "value", said.alias("answer"), options.alias("options"), m.alias("m"))


_OPT = """op AS (SELECT event_id, event_type, value, event_id % 6 AS m FROM events),
  ol AS (SELECT *, CASE m WHEN 0 THEN '(b)' WHEN 1 THEN '(c)' WHEN 2 THEN CASE event_type WHEN 'click' THEN '(a)' WHEN 'view' THEN '(b)' WHEN 'error' THEN '(c)' WHEN 'signup' THEN '(d)' ELSE '' END ELSE '' END AS label FROM op)"""


@query("option_label", f"WITH {_OPT} SELECT event_id, label FROM ol")
def option_label(t: Tables) -> DataFrame:
    rows = option_rows(t)
    return rows.select("event_id", F.coalesce(evals.option_label(F.col("answer"), F.col("options")), F.lit("")).alias("label"))


@query(
    "option_scores",
    f"""WITH {_OPT} SELECT coalesce(event_type, '__all__') AS question_type, round(avg((label = '(b)')::INT), 4) AS accuracy, round(avg((label <> '')::INT), 4) AS parsed_rate, count(*) AS n, count(*) FILTER (value > 100) AS errors FROM ol GROUP BY ROLLUP (event_type)""",
)
def option_scores(t: Tables) -> DataFrame:
    rows = option_rows(t).withColumn("predicted_label", evals.option_label(F.col("answer"), F.col("options")))
    scored = rows.select(
        F.col("event_type").alias("question_type"), "predicted_label", (F.col("predicted_label") == "(b)").alias("is_correct"), F.when(F.col("value") > 100, "slow").alias("error")
    )
    out = evals.option_scores(scored)
    return out.select("question_type", "accuracy", "parsed_rate", "n", "errors")


# -- maintenance ------------------------------------------------------------------------------


@query("retention", f"SELECT event_id FROM events WHERE ts >= {q.NOW} - INTERVAL 10 DAY OR event_type = 'error'")
def retention(t: Tables) -> DataFrame:
    return maintain.retain(t.events, 10, now(), keep=F.col("event_type") == "error").select("event_id")


@query(
    "append_once",
    f"""WITH c AS (SELECT 'u' || user_id AS source_ref, event_type AS kind, event_id, {q.key_of()} AS k FROM events), o AS (SELECT source_ref, kind, min(k) AS k FROM c WHERE kind = 'error' GROUP BY 1, 2)
    SELECT source_ref, kind, 'p' || arg_min(k, event_id) AS payload FROM c WHERE kind <> 'error' GROUP BY 1, 2 UNION ALL SELECT source_ref, kind, 'old' || k FROM o""",
)
def append_once(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.concat(F.lit(" u"), F.col("user_id").cast("string")).alias("source_ref"), F.col("event_type").alias("kind"), F.concat(F.lit("p"), key().cast("string")).alias("payload"), F.col("event_id").alias("ord"), key().alias("k")
    )
    old = rows.filter("kind = 'error'").groupBy(F.trim("source_ref").alias("source_ref"), "kind").agg(F.concat(F.lit("old"), F.min("k").cast("string")).alias("payload"))
    return maintain.append_once(old, rows.drop("k"))


@query(
    "page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def page(t: Tables) -> DataFrame:
    out = maintain.page(t.orders, ["o_totalprice", "o_orderdate"], "o_totalprice", False, 3, 25, "o_orderkey")
    return out.select("o_orderkey", "o_totalprice", "total")


@query(
    "deep_page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 1225""",
)
def deep_page(t: Tables) -> DataFrame:
    out = maintain.deep_page(t.orders, "o_totalprice", False, 50, 25, "o_orderkey")
    return out.select("o_orderkey", "o_totalprice", "total")


@query(
    "query_variants",
    """WITH n AS (SELECT item_id, trim(text) AS o, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS n FROM benchmark),
    e AS (SELECT *, contains(n, 'tion') AS a, contains(n, 'the') AS b FROM n), v AS (SELECT item_id, 0 AS pos, md5(o) AS variant FROM e
      UNION ALL SELECT item_id, 1, md5(n || CASE WHEN a THEN ' action motion' ELSE '' END || CASE WHEN b THEN ' article word' ELSE '' END) FROM e WHERE a OR b)
    SELECT item_id, pos::BIGINT AS pos, variant FROM v""",
)
def query_variants(t: Tables) -> DataFrame:
    from tidemark.plans.retrieval import query_variants as variants

    rows = variants(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), (("tion", "action  Motion"), ("the", "article word"), ("TION", "never")))
    return rows.select(F.col("query_id").alias("item_id"), *big("variant_no"), F.md5("variant").alias("variant")).withColumnRenamed("variant_no", "pos")
