"""Record files: scored logs, evaluation sets, dialogues; and the sinks for samples and journals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators.prefs import SAMPLE_COLUMNS

# Keys under which a JSON object may hold its rows, in this order.
WRAPPERS = ("items", "samples", "results", "runs", "records")


def _reader(spark: SparkSession, glob: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def _parsed(reader, path: str) -> DataFrame | None:
    """The files as a table, or None when there is no such file to infer a schema from."""
    try:
        return reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of all .json and .jsonl files below a path.

    A .jsonl file has one row per line. A .json file is a list of rows, one row, or an object
    that holds the rows under one of a few keys. With `schema` (of a row) nothing is inferred.
    """
    lines = _reader(spark, "*.{jsonl,JSONL}")
    whole = _reader(spark, "*.{json,JSON}").option("multiLine", "true")
    if schema is not None:
        row = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        many = T.ArrayType(row)
        wrapped = T.StructType([*row.fields, *[T.StructField(w, many) for w in WRAPPERS if w not in row.names]])
        lines, whole = lines.schema(row), whole.schema(wrapped)
    single, objects = _parsed(lines, path), _parsed(whole, path)
    if objects is None:
        return spark.createDataFrame([], "prompt string") if single is None else single
    held = [w for w in WRAPPERS if w in objects.columns and isinstance(objects.schema[w].dataType, T.ArrayType)]
    out = single
    if held:
        holder = F.coalesce(*[F.when(F.col(w).isNotNull(), F.lit(w)) for w in held])
        for w in held:
            if not isinstance(objects.schema[w].dataType.elementType, T.StructType):
                continue
            rows = objects.filter(holder == w).select(F.explode(w).alias("r")).select("r.*")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        objects = objects.filter(holder.isNull()).drop(*held)
    return objects if out is None else out.unionByName(objects, allowMissingColumns=True)


CASE_SCHEMA = (
    "name string, description string, cases array<struct<case_id:string, query:string, relevant_chunk_ids:array<string>, "
    "relevant_document_ids:array<string>, expected_keywords:array<string>, notes:string>>"
)


def _named(ids: Column) -> Column:
    kept = F.filter(ids, lambda i: tx.present(i).isNotNull())
    return F.coalesce(kept, F.array().cast("array<string>"))


def eval_cases(df: DataFrame) -> DataFrame:
    """One row per case of evaluation sets; blank ids are dropped, missing texts are empty."""
    rows = df.select(F.col("name").alias("dataset"), F.explode("cases").alias("c")).select("dataset", "c.*")
    lists = [_named(F.col(n)).alias(n) for n in ("relevant_chunk_ids", "relevant_document_ids", "expected_keywords")]
    return rows.select(
        "dataset", F.coalesce("case_id", F.lit("")).alias("case_id"), F.coalesce("query", F.lit("")).alias("query"), *lists, "notes"
    )


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return eval_cases(_reader(spark, "*.json").option("multiLine", "true").schema(CASE_SCHEMA).json(path))


HAYSTACK_SCHEMA = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, "
    "haystack_dates array<string>, haystack_sessions array<array<struct<role:string, content:string, has_answer:boolean>>>, answer_session_ids array<string>"
)


def parse_date(raw: Column) -> Column:
    """UTC time from `YYYY-MM-DD HH:MM:SS`, `YYYY-MM-DD` or `YYYY/MM/DD`; other text gives null."""
    text = tx.strip(F.coalesce(raw, F.lit("")))
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def haystack_turns(df: DataFrame) -> DataFrame:
    """Flat turns of nested sessions: one row per question, session and turn."""
    sessions = df.select(
        "question_id", "question_type", "question", "answer",
        F.col("answer_session_ids").alias("gold"),
        F.posexplode(F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))).alias("session_no", "s"),
    )
    turns = sessions.select(
        "question_id", "question_type", "question", "answer", "session_no", F.col("s.sid").alias("session_id"), F.col("s.date").alias("raw_date"),
        F.coalesce(F.array_contains("gold", F.col("s.sid")), F.lit(False)).alias("is_answer_session"),
        F.posexplode("s.turns").alias("turn_no", "t"),
    )
    return turns.select(
        *[c for c in turns.columns if c != "t"], parse_date(F.col("raw_date")).alias("session_at"), F.col("t.role").alias("role"),
        F.col("t.content").alias("content"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"),
    )


def read_haystack(spark: SparkSession, path: str) -> DataFrame:
    return haystack_turns(_reader(spark, "*.json").option("multiLine", "true").schema(HAYSTACK_SCHEMA).json(path))


def option_list(raw: Column) -> Column:
    """Items of a list literal such as `['(a) x', "(b) y"]`."""
    quoted = r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""
    one, two = F.regexp_extract_all(raw, F.lit(quoted), 1), F.regexp_extract_all(raw, F.lit(quoted), 2)
    joined = F.zip_with(one, two, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.transform(joined, lambda o: tx.strip(F.regexp_replace(o, r"\\(.)", "$1")))


def gold_label(raw: Column) -> Column:
    """`(b)` from `(b)`, `B` and the like, else null."""
    text = F.lower(tx.strip(F.coalesce(raw, F.lit(""))))
    letter = F.coalesce(F.nullif(F.regexp_extract(text, r"\(([a-z])\)", 1), F.lit("")), F.when(F.rlike(text, F.lit("^[a-z]$")), text))
    return F.concat(F.lit("("), letter, F.lit(")"))


def persona_cases(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions with their context messages up to the end index, roles split.

    `contexts`: shared_context_id, messages array<struct<role,content>>. System messages form the
    profile; blank texts and other roles are dropped; a leading `User:`/`Assistant:` is removed.
    """
    cut = F.slice("messages", F.lit(1), F.col("end_index_in_shared_context").cast("int"))

    def clean(m: Column) -> Column:
        role = F.lower(tx.strip(F.coalesce(m["role"], F.lit(""))))
        text = tx.strip(F.coalesce(m["content"], F.lit("")))
        said = F.when(role == "user", tx.strip(F.regexp_replace(text, r"(?i)^user:", ""))).when(
            role == "assistant", tx.strip(F.regexp_replace(text, r"(?i)^assistant:", ""))
        ).otherwise(text)
        return F.struct(role.alias("role"), said.alias("content"))

    joined = questions.withColumn("shared_context_id", tx.strip(F.col("shared_context_id"))).join(contexts, "shared_context_id")
    said = joined.withColumn("said", F.filter(F.transform(cut, clean), lambda m: m["content"] != ""))
    options = option_list(F.col("all_options"))
    label = gold_label(F.col("correct_answer"))
    out = said.withColumn("options", options).withColumn("gold_label", label)
    place = F.ascii(F.substring("gold_label", 2, 1)) - F.ascii(F.lit("a")) + 1
    return out.select(
        tx.strip(F.col("question_id")).alias("question_id"), tx.strip(F.coalesce("question_type", F.lit(""))).alias("question_type"),
        tx.strip(F.coalesce("user_question_or_message", F.lit(""))).alias("question"), "gold_label",
        F.try_element_at("options", place).alias("gold_option"), "options", "shared_context_id",
        F.array_join(F.transform(F.filter("said", lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n").alias("profile"),
        F.filter("said", lambda m: m["role"].isin("user", "assistant")).alias("turns"),
    )


def read_persona_cases(spark: SparkSession, questions: str, contexts: str) -> DataFrame:
    """Questions from CSV with the shared contexts of a JSON-lines file, one `{id: messages}` per line."""
    asked = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(questions)
    lines = spark.read.text(contexts).filter(F.trim("value") != "")
    held = lines.select(F.explode(F.from_json("value", "map<string,array<struct<role:string,content:string>>>")).alias("shared_context_id", "messages"))
    return persona_cases(asked, held)


def _write_lines(df: DataFrame, path: str) -> None:
    """Write JSON lines and name the files .jsonl, which is what `read_records` takes them for."""
    df.write.mode("overwrite").json(path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().toString()
        if name.endswith(".json"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(name + "l"))


def write_preferences(samples: DataFrame, path: str) -> None:
    """Full samples as JSON lines below `full`, and the three training columns below `train`."""
    full = samples.select(*[c for c in SAMPLE_COLUMNS if c in samples.columns])
    _write_lines(full, f"{path}/full")
    _write_lines(samples.select("prompt", "chosen", "rejected"), f"{path}/train")


def journal_rows(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Entries that start with `[YYYY-MM-DD`, with their day."""
    day = F.regexp_extract(F.col(entry), r"^\[(\d{4}-\d{2}-\d{2})", 1)
    return entries.withColumn("day", day).filter((F.col("day") != "") & (tx.strip(F.col(entry)) != ""))


def write_journal(entries: DataFrame, path: str, entry: str = "entry", files_per_day: int = 1) -> None:
    """One folder of text per day. A day with many entries is spread over `files_per_day` files."""
    rows = journal_rows(entries, entry)
    spread = rows.repartition("day", F.pmod(F.xxhash64(entry), F.lit(files_per_day)))
    spread.select("day", F.concat(F.col(entry), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("day").text(path)
