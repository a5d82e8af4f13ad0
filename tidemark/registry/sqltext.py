"""SQL fragments shared by the reference queries."""

SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
LB = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HAN = r"[\x{4E00}-\x{9FFF}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+\z', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{SP}+\z', '', 'g')"


def squash(x: str, by: str = " ") -> str:
    return rf"regexp_replace({x}, '{SP}+', '{by}', 'g')"


def words(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda w: length(w) >= 2)"
    )


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, '') END"


def line_list(x: str) -> str:
    """Lines of a text; a last empty piece is not a line."""
    return (
        f"(SELECT CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END FROM "
        f"(SELECT regexp_split_to_array({x}, '{LB}') AS a))"
    )


def key_of(x: str = "props") -> str:
    return f"CAST(json_extract_string({x}, '$.k') AS BIGINT)"


def qa_norm(x: str) -> str:
    punct = r"[!\x22#$%&\x27()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
    return strip(squash(rf"regexp_replace(lower({x}), '{punct}', '', 'g')"))


def hot(reinf: str, updated: str, now: str, weight: str, half: float = 14.0) -> str:
    hl = f"greatest({half} * (1.0 + 0.5 * least(10, greatest(0, {weight})) / 10.0), 0.1)"
    age = f"greatest((epoch_us({now}) - epoch_us({updated})) / 1000000.0::DOUBLE / 86400.0::DOUBLE, 0.0::DOUBLE)"
    return (
        f"(1.0::DOUBLE / (1.0 + exp(-ln(1.0::DOUBLE + greatest({reinf}, 0)))))"
        f" * exp(-ln(2.0::DOUBLE) / {hl} * {age})"
    )


NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# memory items made of documents; `hash` is the identity of the text within its type
KIND = "CASE lang WHEN 'en' THEN 'event' WHEN 'fr' THEN 'profile' WHEN 'de' THEN 'preference' ELSE 'procedure' END"


def items_cte() -> str:
    return f"""
  mi AS (SELECT 'm' || doc_id AS id, doc_id, {KIND} AS memory_type, text AS summary,
      substr(sha256({squash(strip("lower(text)"))} || {KIND}), 1, 16) AS content_hash, (1 + n_chars % 5)::INT AS reinforcement, (n_chars % 11)::INT AS emotional_weight,
      '{{"scope_channel":"' || source || '","category":"' || lang || '"}}' AS extra_json, '["c' || doc_id || ':1"]#h:x' AS source_ref, '' AS happened_at,
      CASE WHEN n_chars % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, {NOW} - INTERVAL (doc_id) HOUR AS created_at, {NOW} - INTERVAL (doc_id) HOUR AS updated_at FROM documents)"""
