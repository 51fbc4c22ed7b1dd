"""The engine's tables over the given Parquet files.

orders are calls, customers are contacts, line items are the speakers of calls, conversations hold transcript turns,
events are failures and level samples, documents are passages and embeddings are voice samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("contact_id"),
        F.concat(F.lit("Call "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.floor("o_totalprice").cast("long").alias("duration_sec"),
        F.col("o_orderpriority").alias("provider"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("local_engine_"), F.lower(F.split("o_orderpriority", "-")[1]))).alias("failed_reason"),
    )


CALLS = """calls AS (SELECT o_orderkey AS call_id, o_custkey AS contact_id, 'Call ' || o_orderkey || ' ' || o_orderpriority AS title,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_orderdate::TIMESTAMP AS started_at,
  floor(o_totalprice)::BIGINT AS duration_sec, o_orderpriority AS provider,
  CASE WHEN o_orderstatus = 'P' THEN 'local_engine_' || lower(split_part(o_orderpriority, '-', 2)) END AS failed_reason FROM orders)"""


def contacts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    consent = F.when(F.col("c_custkey") % 3 == 0, '{"consent_voice":"true"}').when(F.col("c_custkey") % 3 == 1, '{"consent_voice":true}').otherwise("{}")
    return c.select(
        F.col("c_custkey").alias("contact_id"),
        F.col("c_name").alias("display_name"),
        (F.col("c_custkey") == 1).alias("is_owner"),
        F.col("c_mktsegment").alias("org"),
        F.col("c_nationkey").alias("nation_id"),
        consent.alias("attributes"),
    )


CONTACTS = """contacts AS (SELECT c_custkey AS contact_id, c_name AS display_name, c_custkey = 1 AS is_owner, c_mktsegment AS org, c_nationkey AS nation_id,
  CASE c_custkey % 3 WHEN 0 THEN '{"consent_voice":"true"}' WHEN 1 THEN '{"consent_voice":true}' ELSE '{}' END AS attributes FROM customer)"""


_DIGITS, _LETTERS = "0123456789", "abcdefghij"


def person_name(number):
    """A name that differs by a word: the digits of a number as letters, and a mark that is no part of a word."""
    return F.concat(F.translate(F.lpad(number.cast("string"), 9, "0"), _DIGITS, _LETTERS), F.lit("#1"))


def person_name_sql(number: str) -> str:
    return f"translate(lpad(({number})::VARCHAR, 9, '0'), '{_DIGITS}', '{_LETTERS}')"


def speakers(spark, sf_dir):
    """A line item is a speaker: bound if its line status is F, else only suggested with a score."""
    li = table(spark, sf_dir, "lineitem")
    bound = F.col("l_linestatus") == "F"
    contact = F.col("l_suppkey") * 3
    return li.select(
        F.col("l_orderkey").alias("call_id"),
        F.concat(F.lit("speaker:"), F.col("l_linenumber").cast("string")).alias("speaker_tag"),
        F.when(bound, contact).alias("contact_id"),
        F.when(~bound, contact).alias("suggestion_contact_id"),
        F.round(F.col("l_discount") * 10, 2).alias("suggestion_score"),
        (bound & (F.col("l_returnflag") != "N")).alias("confirmed"),
        F.col("l_quantity").alias("speech_sec"),
    )


SPEAKERS = """speakers AS (SELECT l_orderkey AS call_id, 'speaker:' || l_linenumber AS speaker_tag, CASE WHEN l_linestatus = 'F' THEN l_suppkey * 3 END AS contact_id,
  CASE WHEN l_linestatus <> 'F' THEN l_suppkey * 3 END AS suggestion_contact_id, round(l_discount * 10, 2) AS suggestion_score,
  l_linestatus = 'F' AND l_returnflag <> 'N' AS confirmed, l_quantity AS speech_sec FROM lineitem)"""


def turns(spark, sf_dir):
    """Transcript turns; a turn starts ten seconds after the one before and lasts a second per started 20 characters."""
    t = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    start = F.col("turn") * 10
    return t.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), text.alias("text"),
        start.alias("start_sec"), (start + F.ceil(F.char_length(text) / 20)).cast("long").alias("end_sec"),
    )


TURNS = """turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, turn * 10 AS start_sec,
  (turn * 10 + ceil(length(coalesce(text, '')) / 20.0))::BIGINT AS end_sec FROM conversations)"""


def passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("passage_id"), F.col("source").alias("call_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")


PASSAGES = "passages AS (SELECT doc_id AS passage_id, source AS call_id, coalesce(text, '') AS text, lang FROM documents)"


def dated_passages(spark, sf_dir):
    """passages with the time of their call, here its number."""
    return passages(spark, sf_dir).withColumn("at", F.regexp_extract("call_id", "[0-9]+", 0).try_cast("long"))


def opening_questions(spark, sf_dir):
    """The first turn of every conversation as a question; every other one is about a call, half of them about a period.
    The vector of the same number is the question's, if there is one."""
    t = table(spark, sf_dir, "conversations").where("turn = 0")
    q = t.select(
        F.col("conv_id").alias("question_id"),
        F.coalesce("text", F.lit("")).alias("question"),
        F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))).alias("call_id"),
        F.when(F.col("conv_id") % 4 >= 2, F.col("conv_id") % 10).alias("since"),
        F.when(F.col("conv_id") % 4 >= 2, F.col("conv_id") % 10 + 8).alias("until"),
    )
    return q.join(vectors(spark, sf_dir).select(F.col("vec_id").alias("question_id"), "vec"), "question_id", "left")


def embedded_passages(spark, sf_dir):
    """The passages that have a vector, that of the same number."""
    return dated_passages(spark, sf_dir).select("passage_id", "call_id", "at").join(vectors(spark, sf_dir).select(F.col("vec_id").alias("passage_id"), "vec"), "passage_id")


DATED = """dated AS (SELECT *, try_cast(regexp_extract(call_id, '[0-9]+') AS BIGINT) AS "at" FROM passages)"""
QUESTIONS = """questions AS (SELECT conv_id AS question_id, coalesce(text, '') AS question, CASE WHEN conv_id % 2 = 1 THEN 'src' || (conv_id % 20) END AS call_id,
  CASE WHEN conv_id % 4 >= 2 THEN conv_id % 10 END AS since, CASE WHEN conv_id % 4 >= 2 THEN conv_id % 10 + 8 END AS until, vec
  FROM conversations LEFT JOIN vectors ON vec_id = conv_id WHERE turn = 0)"""


def failures(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), "value", "props")


FAILURES = "failures AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type AS kind, value, props FROM events)"


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("contact_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


VECTORS = "vectors AS (SELECT vec_id, label AS contact_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"


def sql(body: str, *views: str) -> str:
    """DuckDB SQL with the tables that it names."""
    return f"WITH {', '.join(views)} {body}" if views else body
