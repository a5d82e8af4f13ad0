"""The memory table: filters, candidates, merges and retrieval.

Items are made of documents (type by language) or of embeddings (type by label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring, text as tx
from tidemark.operators import maintain, memory, observe, policy, vector
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query



def now() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def key() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def kind_of(lang: str = "lang") -> Column:
    c = F.col(lang)
    return F.when(c == "en", "event").when(c == "fr", "profile").when(c == "de", "preference").otherwise("procedure")


def items(t: Tables) -> DataFrame:
    at = now() - F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    doc = F.col("doc_id").cast("string")
    extra = F.concat(F.lit('{"scope_channel":"'), "source", F.lit('","category":"'), "lang", F.lit('"}'))
    return t.documents.select(
        F.concat(F.lit("m"), doc).alias("id"),
        kind_of().alias("memory_type"),
        F.col("text").alias("summary"),
        tx.content_hash(F.col("text"), kind_of()).alias("content_hash"),
        F.lit(None).cast("array<float>").alias("embedding"),
        (1 + F.col("n_chars") % 5).cast("int").alias("reinforcement"),
        (F.col("n_chars") % 11).cast("int").alias("emotional_weight"),
        extra.alias("extra_json"),
        F.concat(F.lit('["c'), doc, F.lit(':1"]#h:x')).alias("source_ref"),
        F.lit("").alias("happened_at"),
        F.when(F.col("n_chars") % 7 == 0, "superseded").otherwise("active").alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def labelled(t: Tables) -> DataFrame:
    return t.labels.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "quality", "toxic")


def stored(t: Tables) -> DataFrame:
    """Labelled items, one per (hash, type)."""
    known = items(t).join(labelled(t).select("id"), "id", "left_semi")
    rest = [c for c in known.columns if c not in ("content_hash", "memory_type")]
    one = known.groupBy("content_hash", "memory_type").agg(F.min_by(F.struct(*rest), "id").alias("r"))
    return one.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in known.columns])


STORED = """
  st AS (SELECT * EXCLUDE (n) FROM (SELECT mi.*, row_number() OVER (PARTITION BY content_hash, memory_type ORDER BY id) AS n FROM mi WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE n = 1)"""


def typed_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# -- expressions ------------------------------------------------------------------------------


@query(
    "hotness",
    f"""SELECT event_id, round({q.hot(q.key_of(), "ts", q.NOW, "event_id % 11")}, 6) AS hotness FROM events""",
)
def hotness(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(scoring.hotness(key(), F.col("ts"), now(), F.col("event_id") % 11), 6).alias("hotness"))


@query(
    "memory_reward",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN value WHEN event_type = 'error' AND event_id % 2 = 0 THEN -2.0::DOUBLE
      WHEN event_type = 'click' AND event_id % 3 = 0 THEN 2.0::DOUBLE
      ELSE CASE event_type WHEN 'click' THEN 0.05::DOUBLE WHEN 'view' THEN 0.10::DOUBLE WHEN 'purchase' THEN 0.50::DOUBLE WHEN 'error' THEN -1.0::DOUBLE END END AS reward FROM events""",
)
def memory_reward(t: Tables) -> DataFrame:
    names = {"click": "retrieved", "view": "injected", "purchase": "used", "signup": "superseded", "error": "corrected"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    vote = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "Thumbs_Down").when(
        (F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), " like "
    )
    explicit = F.when(F.col("event_type") == "signup", F.col("value"))
    return t.events.select("event_id", scoring.memory_reward(table[F.col("event_type")], vote, explicit).alias("reward"))


@query(
    "memory_filter",
    f"""WITH {q.items_cte()} SELECT id, memory_type, reinforcement FROM mi WHERE status = 'active' AND memory_type IN ('event', 'profile')
      AND contains(lower(summary), 'tion') AND trim(json_extract_string(extra_json, '$.scope_channel')) = 'src3'""",
)
def memory_filter(t: Tables) -> DataFrame:
    hits = memory.filter_memory(items(t), q="TION", types=("event", "profile"), status="active", scope_channel=" src3 ", has_embedding=False)
    return hits.select("id", "memory_type", "reinforcement")


@query(
    "event_time_parse",
    """WITH p AS (SELECT event_id, CASE event_id % 4
        WHEN 0 THEN date_trunc('second', ts) - INTERVAL 8 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) - INTERVAL 8 HOUR
        ELSE date_trunc('minute', ts) - INTERVAL 8 HOUR END AS tm FROM events)
    SELECT event_id, strftime(tm, '%Y-%m-%d %H:%M:%S') AS happened FROM p WHERE tm >= TIMESTAMP '2024-01-05 00:00:00' AND tm < TIMESTAMP '2024-01-20 00:00:00'""",
)
def event_time_parse(t: Tables) -> DataFrame:
    form = lambda pattern: F.date_format("ts", pattern)
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, form("yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 2, form("yyyy-MM-dd"))
        .otherwise(memory.summary_time(F.concat(F.lit("["), form("yyyy-MM-dd HH:mm"), F.lit("] note"))))
    )
    rows = t.events.select("event_id", memory.parse_event_time(text).alias("at"))
    start, end = F.to_timestamp(F.lit("2024-01-05 00:00:00")), F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return rows.filter((F.col("at") >= start) & (F.col("at") < end)).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("happened"))


@query(
    "memory_type_coerce",
    f"""SELECT doc_id, CASE WHEN {q.KIND} = 'procedure' AND NOT (n_chars % 3 = 0) AND NOT (n_chars % 5 = 0) THEN 'preference' ELSE {q.KIND} END AS memory_type FROM documents""",
)
def memory_type_coerce(t: Tables) -> DataFrame:
    tool = F.when(F.col("n_chars") % 3 == 0, "shell").otherwise("  ")
    steps = F.when(F.col("n_chars") % 5 == 0, F.array(F.lit(" "), F.lit("run it"))).otherwise(F.array(F.lit(" ")))
    return t.documents.select("doc_id", memory.coerce_type(kind_of(), tool, steps).alias("memory_type"))


@query(
    "source_ref_explode",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [conv_id || ':' || turn, conv_id || ':' || (turn + 1)] WHEN turn % 3 = 1 THEN [conv_id || ':' || turn] ELSE CAST([] AS VARCHAR[]) END AS ids FROM conversations)
    SELECT conv_id, turn, i - 1 AS pos, ids[i] AS message_id FROM (SELECT conv_id, turn, ids, unnest(range(1, len(ids) + 1)) AS i FROM m)
    UNION ALL SELECT conv_id, turn, -1, '' FROM m WHERE len(ids) = 0""",
)
def source_ref_explode(t: Tables) -> DataFrame:
    me = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nxt = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    two = F.concat(F.lit('["'), me, F.lit('", "'), nxt, F.lit('"]#h:abc'))
    ref = F.when(F.col("turn") % 3 == 0, two).when(F.col("turn") % 3 == 1, me).otherwise("#h:only")
    rows = memory.explode_source_refs(t.conversations.select("conv_id", "turn", ref.alias("source_ref")))
    return rows.select("conv_id", "turn", F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), F.coalesce("message_id", F.lit("")).alias("message_id"))


# -- candidates -------------------------------------------------------------------------------

_PAIRS = """
  x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
  nn AS (SELECT id, sqrt(list_dot_product(e, e)) + 1e-9::DOUBLE AS n FROM x),
  cs AS (SELECT a.id AS query_id, b.id AS id, a.label AS la, b.label AS lb, round(list_dot_product(a.e, b.e) / (na.n * nb.n), 9) AS score
    FROM x a JOIN nn na ON na.id = a.id, x b JOIN nn nb ON nb.id = b.id)"""


@query(
    "dedup_candidates",
    f"""WITH {_PAIRS}, k AS (SELECT query_id, id, score, 0 AS lane, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pl FROM cs WHERE la < 5 AND lb >= 5 AND score >= 0.36),
    b AS (SELECT query_id, id, score, 1 AS lane, id AS pl FROM cs WHERE la < 5 AND lb < 5 AND id < query_id AND score >= 0.40),
    u AS (SELECT * FROM k WHERE pl <= 5 UNION ALL SELECT * FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane, pl, id) AS rank FROM u)
    SELECT query_id, id, round(score, 6) AS score, lane = 1 AS in_batch, rank FROM r WHERE rank <= 5""",
)
def dedup_candidates(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    new = x.filter("label < 5").withColumn("ord", F.col("id"))
    out = memory.dedup_candidates(new, x.filter("label >= 5"), same=None, stored_at=0.36, batch_at=0.40)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "in_batch", *big("rank"))


@query(
    "invalidation_candidates",
    f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs
      WHERE la < 3 AND lb >= 3 AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND score >= 0.30)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def invalidation_candidates(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    safe = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    topics = x.filter("label < 3").withColumnRenamed("id", "query_id")
    out = memory.invalidate_candidates(topics, x.filter("label >= 3"), safe, threshold=0.30)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), *big("rank"))


@query(
    "semantic_recent_dedup",
    f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM cs
      WHERE la < 5 AND lb >= 5 AND id % 14 <= 7 AND id % 9 <> 0 AND score >= 0.36)
    SELECT e.vec_id AS id, coalesce(r.id, -1) AS reinforced_id, r.id IS NULL AS fresh FROM embeddings e LEFT JOIN r ON r.query_id = e.vec_id AND n = 1 WHERE e.label < 5""",
)
def semantic_recent_dedup(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    old = x.filter("label >= 5").select(
        "id", "embedding", F.lit("event").alias("memory_type"), F.when(F.col("id") % 9 == 0, "superseded").otherwise("active").alias("status"),
        (now() - F.make_dt_interval((F.col("id") % 14).cast("int"))).alias("created_at"),
    )
    fresh, repeats = memory.semantic_dedup(x.filter("label < 5").drop("label"), old, now(), threshold=0.36)
    return fresh.select("id", F.lit(-1).cast("bigint").alias("reinforced_id"), F.lit(True).alias("fresh")).unionByName(
        repeats.select("id", "reinforced_id", F.lit(False).alias("fresh"))
    )


# -- writes -----------------------------------------------------------------------------------

_FINAL = "id, memory_type, content_hash, reinforcement, emotional_weight, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def final(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "memory_type", "content_hash", F.col("reinforcement").cast("int").alias("reinforcement"), F.col("emotional_weight").cast("int").alias("emotional_weight"),
        "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


@query(
    "upsert_memory",
    f"""WITH {q.items_cte()}, {STORED}, c AS (SELECT content_hash, memory_type, count(*) AS n, max(emotional_weight) AS w FROM mi GROUP BY ALL),
    u AS (SELECT coalesce(st.id, substr(md5(content_hash || memory_type), 1, 12)) AS id, memory_type, content_hash, (coalesce(reinforcement, 0) + coalesce(n, 0))::INT AS reinforcement,
        greatest(coalesce(emotional_weight, 0), coalesce(w, 0))::INT AS emotional_weight, 'active' AS status, {q.NOW} AS updated_at FROM st FULL JOIN c USING (content_hash, memory_type))
    SELECT {_FINAL} FROM u""",
)
def upsert_memory(t: Tables) -> DataFrame:
    changes = items(t).withColumn("ord", F.col("id"))
    return final(memory.upsert_memory(stored(t), changes, now()))


@query(
    "ingest_events_once",
    f"""WITH c AS (SELECT event_id, user_id || ':' || {q.key_of()} AS source_ref, event_type || ' of item ' || {q.key_of()} AS summary, event_id % 11 AS w FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY event_id) AS n FROM c),
    g AS (SELECT * FROM f WHERE n = 1 AND source_ref NOT IN (SELECT user_id || ':' || {q.key_of()} FROM events WHERE event_type = 'error')),
    h AS (SELECT substr(sha256(summary || 'event'), 1, 16) AS content_hash, count(*) AS n, max(w) AS w FROM g GROUP BY 1)
    SELECT content_hash, n::INT AS reinforcement, w::INT AS emotional_weight FROM h""",
)
def ingest_events_once(t: Tables) -> DataFrame:
    ref = F.concat_ws(":", F.col("user_id").cast("string"), key().cast("string"))
    text = F.concat(F.col("event_type"), F.lit(" of item "), key().cast("string"))
    changes = t.events.select(
        ref.alias("source_ref"), text.alias("summary"), (F.col("event_id") % 11).alias("emotional_weight"), F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("happened_at"),
    )
    log = t.events.filter("event_type = 'error'").select(ref.alias("source_ref"), F.lit("old").alias("item_id")).distinct()
    new_items, _ = memory.ingest_once(items(t).limit(0), log, changes, now())
    return new_items.select("content_hash", F.col("reinforcement").cast("int").alias("reinforcement"), F.col("emotional_weight").cast("int").alias("emotional_weight"))


@query("save_with_supersede")
def save_with_supersede(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    kind = F.when(F.col("label") % 2 == 0, "procedure").otherwise("preference")
    rows = x.select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), kind.alias("memory_type"), F.concat(F.lit("rule "), F.col("id").cast("string")).alias("summary"),
        "embedding", F.col("id").alias("ord"), F.concat(F.lit('{"tool_requirement":"t'), (F.col("label") % 4).cast("string"), F.lit('"}')).alias("extra_json"), "label",
    )
    target = rows.filter("label >= 5").select(
        "id", "memory_type", "summary", tx.content_hash(F.col("summary"), F.col("memory_type")).alias("content_hash"), "embedding", F.lit(1).alias("reinforcement"),
        F.lit(0).alias("emotional_weight"), "extra_json", F.lit("").alias("source_ref"), F.lit("").alias("happened_at"), F.lit("active").alias("status"),
        now().alias("created_at"), now().alias("updated_at"),
    )
    changes = rows.filter("label < 5").select("id", "memory_type", "summary", "embedding", "ord", "extra_json", F.lit(0).alias("emotional_weight"))
    new_items, _ = memory.save_supersede(target, changes, now(), merge_at=0.30, retire_at=0.38)
    return new_items.select("memory_type", "summary", "reinforcement", "status")


@query(
    "mark_superseded",
    f"""WITH {q.items_cte()}, u AS (SELECT mi.* REPLACE (CASE WHEN toxic = 1 THEN 'superseded' ELSE status END AS status, CASE WHEN toxic = 1 THEN {q.NOW} ELSE updated_at END AS updated_at)
      FROM mi LEFT JOIN labels USING (doc_id)) SELECT {_FINAL} FROM u""",
)
def mark_superseded(t: Tables) -> DataFrame:
    return final(memory.supersede(items(t), labelled(t).filter("toxic = 1"), now()))


@query(
    "replacement_log",
    f"""WITH {q.items_cte()} SELECT 'm' || l.doc_id AS old_item_id, n.id AS new_item_id, md5(o.summary) AS old_text, n.source_ref, 'supersede' AS relation_type
    FROM labels l JOIN mi o ON o.doc_id = l.doc_id JOIN mi n ON n.doc_id = l.doc_id + 1 WHERE toxic = 1""",
)
def replacement_log(t: Tables) -> DataFrame:
    pairs = t.labels.filter("toxic = 1").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("old_item_id"), F.concat(F.lit("m"), (F.col("doc_id") + 1).cast("string")).alias("new_item_id")
    )
    rows = memory.replacement_rows(items(t), pairs, now())
    return rows.select("old_item_id", "new_item_id", F.md5("old_summary").alias("old_text"), "source_ref", "relation_type")


@query(
    "reinforce",
    f"""WITH {q.items_cte()}, h AS (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY 1),
    u AS (SELECT mi.* REPLACE ((reinforcement + coalesce(n, 0))::INT AS reinforcement, CASE WHEN n IS NULL THEN emotional_weight ELSE greatest(emotional_weight, 4) END AS emotional_weight,
      CASE WHEN n IS NULL THEN updated_at ELSE {q.NOW} END AS updated_at) FROM mi LEFT JOIN h USING (doc_id)) SELECT {_FINAL} FROM u""",
)
def reinforce(t: Tables) -> DataFrame:
    ids = t.events.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("id"))
    return final(memory.reinforce(items(t), ids, now(), emotional_weight=4))


def undo_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items named by two messages each, a chain of replacements, and the messages to undo."""
    me, nxt = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    rows = t.conversations.select(
        me.alias("id"), F.concat(F.lit('["'), me, F.lit('","'), nxt, F.lit('"]#h:1')).alias("source_ref"),
        F.when(F.col("turn") % 2 == 0, "superseded").otherwise("active").alias("status"), now().alias("updated_at"),
    )
    chain = t.conversations.select(me.alias("old_item_id"), nxt.alias("new_item_id"))
    wanted = t.conversations.filter("role = 'assistant'").select(me.alias("message_id"))
    return rows, chain, wanted


_UNDO = """
  mm AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn + 1) AS nx, turn % 2 = 0 AS dead, role FROM conversations),
  wt AS (SELECT id AS m FROM mm WHERE role = 'assistant'),
  af AS (SELECT id FROM mm WHERE id IN (SELECT m FROM wt) OR nx IN (SELECT m FROM wt)),
  rs AS (SELECT id FROM mm WHERE (dead OR id IN (SELECT id FROM af)) AND nx IN (SELECT id FROM af))"""


@query("undo_sources", f"WITH {_UNDO} SELECT 'affected' AS kind, id FROM af UNION ALL SELECT 'restored', id FROM rs UNION ALL SELECT DISTINCT 'rollback_source', unnest([id, nx]) FROM mm WHERE id IN (SELECT id FROM af)")
def undo_sources(t: Tables) -> DataFrame:
    rows, chain, wanted = undo_inputs(t)
    return memory.undo_sources(rows, chain, wanted, now())[1]


@query("replacement_restore", f"WITH {_UNDO} SELECT id FROM mm WHERE dead AND nx IN (SELECT id FROM af)")
def replacement_restore(t: Tables) -> DataFrame:
    rows, chain, wanted = undo_inputs(t)
    gone = rows.join(wanted.withColumnRenamed("message_id", "id"), "id", "left_semi").select("id")
    before = t.conversations.filter("role = 'assistant'").select(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("id"))
    affected = gone.unionByName(rows.join(before, "id", "left_semi").select("id")).distinct()
    return memory.restore_plan(rows, chain, affected)


@query(
    "mark_processed",
    f"""WITH {q.items_cte()}, d AS (SELECT 'm' || doc_id AS id, max(CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END) AS c FROM labels GROUP BY 1)
    SELECT id, coalesce(c, '') AS candidate, CASE c WHEN 'good' THEN 'committed' WHEN 'bad' THEN 'ignored' ELSE '' END AS action, json_extract_string(extra_json, '$.category') AS category FROM mi LEFT JOIN d USING (id)""",
)
def mark_processed(t: Tables) -> DataFrame:
    good = F.when(F.col("quality") == 1, "good").otherwise("bad")
    decisions = labelled(t).select(
        good.alias("candidate_id"), F.when(F.col("quality") == 1, "committed").otherwise("ignored").alias("action"), F.array("id").alias("source_ids")
    )
    out = maintain.mark_rollup(items(t), decisions, now())
    note = F.get_json_object("extra_json", "$._rollup")
    field = lambda name: F.coalesce(F.get_json_object(note, f"$.{name}"), F.lit(""))
    return out.select("id", field("candidate_id").alias("candidate"), field("action").alias("action"), F.get_json_object("extra_json", "$.category").alias("category"))


# -- policy -----------------------------------------------------------------------------------

POLICY = """
  pe AS (SELECT user_id AS item_id, event_type, CASE event_type WHEN 'click' THEN 0.05::DOUBLE WHEN 'view' THEN 0.10::DOUBLE WHEN 'purchase' THEN 0.50::DOUBLE WHEN 'signup' THEN -0.75::DOUBLE ELSE -1.0::DOUBLE END AS r FROM events),
  pc AS (SELECT item_id, count(*) FILTER (event_type = 'click') AS c1, count(*) FILTER (event_type = 'view') AS c2, count(*) FILTER (event_type = 'purchase') AS c3,
      count(*) FILTER (event_type = 'error') AS c4, count(*) FILTER (event_type = 'signup') AS c5, sum(CAST(round(r * 1e9) AS BIGINT))::DOUBLE / 1e9 AS tr FROM pe GROUP BY 1),
  ps AS (SELECT *, tr / greatest(c1 + c2 + 2 * c3 + 2 * c4 + c5, 1) AS ar,
      0.5::DOUBLE + 0.015 * least(c1, 20) + 0.035 * least(c2, 20) + 0.09 * least(2 * c3, 10) - 0.18 * least(c4, 10) - 0.14 * least(c5, 10) - 0.12 * least(c4, 10) AS rel,
      (0.5::DOUBLE * c2 + 1.5 * c3 + 2.0 * c3) / (greatest(c1 + c2, 1) + 2 * c3 + c4 + c5) AS use FROM pc),
  pb AS (SELECT item_id, c1, c3, c4, ar, least(1.0::DOUBLE, greatest(0.0::DOUBLE, rel)) AS reliability, least(1.0::DOUBLE, greatest(0.0::DOUBLE, use)) AS usefulness,
      least(0.2::DOUBLE, greatest(-0.2::DOUBLE, 0.24 * (rel - 0.5) + 0.18 * (use - 0.35) + 0.08 * ar)) AS boost FROM ps)"""


def policy_events(t: Tables) -> DataFrame:
    names = {"click": "retrieved", "view": "injected", "purchase": "used", "signup": "superseded", "error": "corrected"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = t.events.select(F.col("user_id").alias("item_id"), table[F.col("event_type")].alias("event_type"), "ts")
    return rows.withColumn("reward", scoring.memory_reward(F.col("event_type")))


@query(
    "memory_policy_stats",
    f"WITH {POLICY} SELECT item_id, c1 AS retrieved_count, c3 AS used_count, c4 AS negative_count, round(ar, 6) AS avg_reward, round(reliability, 6) AS reliability, round(usefulness, 6) AS usefulness, round(boost, 6) AS retrieval_boost FROM pb",
)
def memory_policy_stats(t: Tables) -> DataFrame:
    out = policy.memory_policy(policy_events(t))
    names = ["avg_reward", "reliability", "usefulness", "retrieval_boost"]
    return out.select("item_id", "retrieved_count", "used_count", "negative_count", *[F.round(n, 6).alias(n) for n in names])


@query(
    "policy_rerank",
    f"""WITH {POLICY}, {_PAIRS}, r AS (SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rb FROM cs),
    b AS (SELECT query_id, id, rb, round(score + coalesce(boost, 0), 4) AS policy_score FROM r LEFT JOIN pb ON pb.item_id = r.id WHERE rb <= 8)
    SELECT query_id, id, rb AS rank_before, policy_score, row_number() OVER (PARTITION BY query_id ORDER BY policy_score DESC, rb) AS rank_after FROM b""",
)
def policy_rerank(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    hits = vector.similar(x.withColumnRenamed("id", "query_id"), x, k=8, epsilon=memory.NORM_EPSILON).withColumn("score", F.round("score", 4))
    out = policy.policy_rerank(hits, policy.memory_policy(policy_events(t)))
    return out.select("query_id", "id", *big("rank_before", "rank_after"), "policy_score")


@query(
    "rollup_candidates",
    f"""WITH {q.items_cte()}, s AS (SELECT *, {q.squash("lower(summary)", "")} AS ck, regexp_replace({q.strip(q.squash("summary"))}, '^[ \\-。；;]+|[ \\-。；;]+\\z', '', 'g') AS txt,
        {q.hot("reinforcement", "updated_at", q.NOW, "emotional_weight")} AS heat FROM mi WHERE status = 'active' AND memory_type IN ('profile', 'preference') AND {q.strip("summary")} <> ''),
    g AS (SELECT memory_type, ck, count(*) AS n, max(heat) AS heat, max(length(ck)) AS len FROM s GROUP BY ALL),
    b AS (SELECT memory_type, ck, reinforcement, emotional_weight, txt, row_number() OVER (PARTITION BY memory_type, ck ORDER BY heat DESC, id DESC) AS rn,
        first_value(txt) OVER (PARTITION BY memory_type, ck ORDER BY length(txt) DESC, txt DESC) AS longest FROM s)
    SELECT CASE g.memory_type WHEN 'profile' THEN 'identity' ELSE 'preference' END AS tag, md5(CASE g.memory_type WHEN 'profile' THEN '用户的稳定身份信息是' ELSE '' END || longest) AS content_digest,
      round(heat * 100, 2) AS score, reinforcement, emotional_weight, n AS evidence_count, len >= 12 AND contains('derdieundlelade', substr(g.ck, 1, 24)) AS existing_overlap
    FROM g JOIN b ON b.memory_type = g.memory_type AND b.ck = g.ck AND rn = 1""",
)
def rollup_candidates(t: Tables) -> DataFrame:
    out = observe.rollup_candidates(items(t), "Der die und le la de", now())
    return out.select("tag", F.md5("content").alias("content_digest"), "score", "reinforcement", "emotional_weight", "evidence_count", "existing_overlap")


@query(
    "injection_select",
    f"""WITH {_PAIRS}, h AS (SELECT query_id, id, score, lb, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM cs),
    k AS (SELECT query_id, id, score, CASE lb % 5 WHEN 0 THEN 'procedure' WHEN 1 THEN 'procedure' WHEN 2 THEN 'preference' WHEN 3 THEN 'event' ELSE 'profile' END AS mt, lb % 5 = 0 AS forced FROM h WHERE rk <= 40),
    s AS (SELECT *, CASE WHEN forced THEN 0 WHEN score < CASE mt WHEN 'procedure' THEN 0.26 ELSE 0.22 END THEN NULL WHEN mt IN ('procedure', 'preference') THEN 1 ELSE 2 END AS section FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, id) AS place FROM s WHERE section IS NOT NULL)
    SELECT query_id, id, section::INT AS section, place, CASE WHEN section > 0 AND score < CASE mt WHEN 'procedure' THEN 0.26 ELSE 0.22 END + 0.15 THEN '有印象，不确定' ELSE '' END AS confidence
    FROM p WHERE place <= CASE section WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END""",
)
def injection_select(t: Tables) -> DataFrame:
    from tidemark.operators import context

    cfg = context.InjectionConfig(thresholds={"procedure": 0.26, "preference": 0.22, "event": 0.22, "profile": 0.22}, max_events=2, max_chars=1200)
    out = context.select_injection(injection_hits(t), now(), cfg)
    return out.select("query_id", "id", F.col("section").cast("int").alias("section"), *big("place"), "confidence")


def injection_hits(t: Tables) -> DataFrame:
    x = typed_vectors(t)
    hits = vector.similar(x.withColumnRenamed("id", "query_id"), x, k=40, epsilon=memory.NORM_EPSILON)
    m = F.col("label") % 5
    kind = F.when(m < 2, "procedure").when(m == 2, "preference").when(m == 3, "event").otherwise("profile")
    info = x.select(
        "id", kind.alias("memory_type"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("summary"), F.lit("").alias("happened_at"), F.lit("").alias("source_ref"),
        F.when(m == 0, F.lit('{"tool_requirement":"shell"}')).otherwise("{}").alias("extra_json"),
    )
    return hits.join(info, "id")


@query("injection_block")
def injection_block(t: Tables) -> DataFrame:
    from tidemark.operators import context

    cfg = context.InjectionConfig(thresholds={"procedure": 0.26, "preference": 0.22, "event": 0.22, "profile": 0.22}, max_events=2, max_chars=400)
    block = context.inject_block(context.select_injection(injection_hits(t), now(), cfg), cfg)
    return block.select("query_id", "block", F.array_join(F.transform("injected_ids", lambda i: i.cast("string")), "|").alias("injected"))
