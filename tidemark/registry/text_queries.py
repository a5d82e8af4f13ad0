"""Text expressions over documents, questions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.registry import sqltext as q
from tidemark.registry.core import Tables, query


def joined(col) -> F.Column:
    return F.array_join(col, "|")


@query(
    "content_hash",
    f"""SELECT doc_id, substr(sha256({q.squash(q.strip("lower(text)"))} || lang), 1, 16) AS content_hash
    FROM documents""",
)
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.content_hash(F.col("text"), F.col("lang")).alias("content_hash"))


@query(
    "stable_ids",
    """SELECT doc_id,
      'kdoc_' || substr(sha1(source || '/' || doc_id), 1, 20) AS document_key,
      'kchunk_' || substr(sha1('kdoc_' || substr(sha1(source || '/' || doc_id), 1, 20) || ':0:' || text), 1, 20) AS chunk_key,
      'pref_' || substr(sha256(concat_ws('|', lang, source, text)), 1, 24) AS sample_key
    FROM documents""",
)
def stable_ids(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    doc = tx.stable_id("kdoc_", 20, path)
    return t.documents.select(
        "doc_id",
        doc.alias("document_key"),
        tx.stable_id("kchunk_", 20, doc, F.lit("0"), F.col("text")).alias("chunk_key"),
        tx.stable_id("pref_", 24, F.col("lang"), F.col("source"), F.col("text"), sep="|", digest="sha256").alias(
            "sample_key"
        ),
    )


@query(
    "bm25_tokens",
    f"""WITH w AS (SELECT doc_id, {q.words("text")} AS words, regexp_extract_all(lower(text), '{q.HAN}+') AS runs
      FROM documents),
    p AS (SELECT doc_id, list_concat(words, flatten(list_transform(runs, lambda r: list_concat(list_concat(
        string_split(r, ''),
        list_transform(range(1, length(r)), lambda i: substr(r, i, 2))),
        CASE WHEN length(r) <= 8 THEN [r] ELSE [] END)))) AS toks FROM w)
    SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_terms,
      md5(array_to_string(toks, '|')) AS token_digest FROM p""",
)
def bm25_tokens(t: Tables) -> DataFrame:
    toks = t.documents.select("doc_id", tx.bm25_tokens(F.col("text")).alias("toks"))
    return toks.select(
        "doc_id",
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("n_terms"),
        F.md5(joined("toks")).alias("token_digest"),
    )


@query(
    "query_terms",
    r"""WITH x AS (SELECT item_id, pos, term FROM (
        SELECT item_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_.\-]{2,}')) AS term,
          generate_subscripts(regexp_extract_all(text, '[a-zA-Z0-9_.\-]{2,}'), 1) AS pos FROM benchmark)),
    f AS (SELECT item_id, term, min(pos) AS pos FROM x GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM f)
    SELECT b.item_id, coalesce(string_agg(term, '|' ORDER BY pos), '') AS terms
    FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND rn <= 20 GROUP BY b.item_id""",
)
def query_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", joined(tx.query_terms(F.col("text"))).alias("terms"))


@query(
    "catalog_keywords",
    f"""WITH k AS (SELECT p_partkey, lower(trim(p_name)) AS s FROM part),
    e AS (SELECT p_partkey, s AS kw FROM k UNION SELECT p_partkey, unnest(regexp_split_to_array(s, '{q.SP}+')) FROM k)
    SELECT p_partkey, string_agg(kw, '|' ORDER BY kw) AS keywords FROM e WHERE kw <> '' GROUP BY p_partkey""",
)
def catalog_keywords(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", joined(F.array_sort(tx.catalog_keywords(F.col("p_name")))).alias("keywords")
    )


@query(
    "qa_normalize",
    f"""WITH n AS (SELECT conv_id, turn, {q.qa_norm("text")} AS s FROM conversations)
    SELECT conv_id, turn, s AS normal, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS n_tokens FROM n""",
)
def qa_normalize(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id",
        "turn",
        tx.qa_normalize(F.col("text")).alias("normal"),
        F.size(tx.qa_tokens(F.col("text"))).cast("bigint").alias("n_tokens"),
    )


@query(
    "char_bigrams",
    f"""WITH n AS (SELECT doc_id, {q.squash("lower(text)", "")} AS s FROM documents),
    g AS (SELECT DISTINCT doc_id, a || b AS gram FROM (
      SELECT doc_id, unnest(c[1:len(c)-1]) AS a, unnest(c[2:len(c)]) AS b
      FROM (SELECT doc_id, string_split(s, '') AS c FROM n WHERE length(s) > 1)))
    SELECT d.doc_id, count(gram) AS n_grams, md5(coalesce(string_agg(gram, '|' ORDER BY gram), '')) AS gram_digest
    FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""",
)
def char_bigrams(t: Tables) -> DataFrame:
    grams = t.documents.select("doc_id", F.array_sort(tx.char_bigrams(F.col("text"))).alias("g"))
    return grams.select(
        "doc_id", F.size("g").cast("bigint").alias("n_grams"), F.md5(joined("g")).alias("gram_digest")
    )


_COMPACT = q.strip(q.squash("text"))


@query(
    "previews",
    f"""WITH c AS (SELECT doc_id, text, {_COMPACT} AS s, {q.line_list("text")} AS ls FROM documents),
    m AS (SELECT *, length(text) - greatest(0, 2000 - length('…' || (length(text) - 2000) || ' chars truncated…')) AS o1 FROM c),
    m2 AS (SELECT *, length(text) - greatest(0, 2000 - length('…' || o1 || ' chars truncated…')) AS o2 FROM m),
    m3 AS (SELECT *, length(text) - o2 AS keep FROM m2)
    SELECT doc_id,
      CASE WHEN length(s) <= 160 THEN s ELSE {q.rstrip("substr(s, 1, 159)")} || '…' END AS preview,
      CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:3], chr(10)) || chr(10) || '...[已截断，剩余 ' || (len(ls) - 3) || ' 行]'
        ELSE array_to_string(ls, chr(10)) END AS line_preview,
      CASE WHEN length(text) <= 2000 THEN text ELSE 'Total output lines: ' || len(ls) || chr(10) || chr(10)
        || substr(text, 1, keep // 2) || '…' || o2 || ' chars truncated…'
        || substr(text, length(text) - (keep - keep // 2) + 1) END AS head_tail
    FROM m3""",
)
def previews(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.preview(c, 160).alias("preview"),
        tx.line_preview(c, 3).alias("line_preview"),
        tx.head_tail(c, 2000).alias("head_tail"),
    )


@query(
    "token_estimate",
    """SELECT doc_id, greatest(1, length(text) // 4) AS chunk_tokens, greatest(1, length(text) // 3) AS prompt_tokens
    FROM documents""",
)
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        tx.token_estimate(F.col("text"), 4).alias("chunk_tokens"),
        tx.token_estimate(F.col("text"), 3).alias("prompt_tokens"),
    )


@query(
    "clause_split",
    f"""WITH l AS (SELECT conv_id, turn, i, trim(regexp_extract({q.strip("ls[i]")}, '(?i)\\bUSER:\\s*(.+)$', 1)) AS said
        FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
          SELECT conv_id, turn, {q.line_list("'USER: ' || text")} AS ls FROM conversations WHERE role = 'user'))),
    p AS (SELECT conv_id, turn, i, j, {q.strip("ps[j]")} AS clause FROM (
        SELECT conv_id, turn, i, ps, unnest(range(1, len(ps) + 1)) AS j FROM (
          SELECT conv_id, turn, i, regexp_split_to_array(said, '[。！？；;.!?，,]\\s*') AS ps FROM l))),
    f AS (SELECT conv_id, turn, clause, min(i * 100000 + j) AS first_at FROM p WHERE length(clause) >= 4 GROUP BY ALL)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first_at) - 1 AS pos, clause FROM f""",
)
def clause_split(t: Tables) -> DataFrame:
    spoken = t.conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", tx.user_clauses(F.concat(F.lit("USER: "), F.col("text"))).alias("clauses")
    )
    return spoken.select("conv_id", "turn", F.posexplode("clauses").alias("pos", "clause")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )
