"""Markdown, names, titles and nested fields."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents as D
from ..functions import text as T
from ..sources.tables import CALLS, PASSAGES, TURNS, calls, passages, sql, table, turns
from .base import query


@query(sql("SELECT passage_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^-{3,}$'))) AS separators, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6}\\s'))) AS headings, len(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> '')) AS n_paragraphs, NOT regexp_matches(text, '\\S') AS blank, NOT regexp_matches(text, '[*`_\\[\\]\\\\]') AS safe FROM passages", PASSAGES))
def markdown_structure(spark, sf):
    lines = F.split("text", "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return passages(spark, sf).select("passage_id", count(D.is_separator).alias("separators"), count(D.is_heading).alias("headings"), F.size(D.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), D.is_blank_markdown(F.col("text")).alias("blank"), D.is_safe_name(F.col("text")).alias("safe"))


@query(sql("SELECT passage_id, len(w) AS n, length(w[len(w)]) AS last_length, md5(w[1]) AS first FROM (SELECT passage_id, list_transform(generate_series(0, greatest(0, ceil((length(text) - 400) / 350.0)::INT)), lambda i: substr(text, (i * 350 + 1)::BIGINT, 400)) AS w FROM passages)", PASSAGES))
def sliding_char_windows(spark, sf):
    w = D.sliding_windows(F.col("text"), 400, 50)
    return passages(spark, sf).select("passage_id", w.alias("w")).select("passage_id", F.size("w").cast("long").alias("n"), F.char_length(F.element_at("w", -1)).cast("long").alias("last_length"), F.md5(F.col("w")[0]).alias("first"))


@query(sql("SELECT call_id, CASE WHEN call_id % 3 = 0 THEN 'Call · ' || strftime(started_at, '%d.%m.%Y') ELSE title END AS shown, upper(substr(provider, 1, 1)) || substr(provider, 2) AS capital, 'other' AS call_type, CASE WHEN duration_sec % 7 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, duration_sec / 100000.0)) END AS confidence FROM calls", CALLS))
def titles_and_types(spark, sf):
    shown = D.title_or(F.when(F.col("call_id") % 3 == 0, "  ").otherwise(F.col("title")), F.col("started_at"), F.col("call_id").cast("string"))
    share = F.when(F.col("duration_sec") % 7 != 0, F.col("duration_sec") / 100000.0)
    return calls(spark, sf).select("call_id", shown.alias("shown"), D.capitalised(F.col("provider")).alias("capital"), D.call_type(F.col("provider")).alias("call_type"), D.clamped(share, 0.0, 1.0, 0.5).alias("confidence"))


@query(sql("SELECT event_id, props AS object FROM (SELECT event_id, props FROM events)"))
def objects_in_answers(spark, sf):
    """The JSON object inside a chatty answer."""
    e = table(spark, sf, "events")
    return e.select("event_id", D.first_object(F.concat(F.lit('Sure } here: '), "props", F.lit(" and {more}"))).alias("object"))


@query(sql("SELECT conv_id, turn, 'with **' || speaker || '** and ' || speaker || 's' AS marked FROM turns", TURNS))
def names_in_bold(spark, sf):
    said = F.concat(F.lit("with "), F.col("speaker"), F.lit(" and "), F.col("speaker"), F.lit("s"))
    return turns(spark, sf).select("conv_id", "turn", D.bolded(said, ["user", "assistant", "system", "unknown"]).alias("marked"))


@query(sql("SELECT call_id, n_words, arg_max(lang, (n, lang)) AS lang FROM (SELECT call_id, lang, sum(len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')))::BIGINT AS n, sum(sum(len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')))) OVER (PARTITION BY call_id)::BIGINT AS n_words FROM passages GROUP BY call_id, lang) GROUP BY call_id, n_words HAVING n_words >= 8", PASSAGES))
def language_vote(spark, sf):
    """The language of most words per source, from eight words on."""
    n = passages(spark, sf).select("call_id", "lang", F.size(T.words(F.col("text"))).cast("long").alias("n")).groupBy("call_id", "lang").agg(F.sum("n").alias("n"))
    return n.groupBy("call_id").agg(F.sum("n").alias("n_words"), F.max_by("lang", F.struct("n", "lang")).alias("lang")).where("n_words >= 8")


@query(sql("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE speaker WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn, text) AS place, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn, text) = 1 AS first_of_speaker FROM turns", TURNS))
def ranked_kinds(spark, sf):
    """A custom order of kinds, and the first row of each."""
    kind = F.when(F.col("speaker") == "system", 0).when(F.col("speaker") == "user", 1).otherwise(2)
    return turns(spark, sf).select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(kind, "turn", "text")).cast("long").alias("place"), (F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy("turn", "text")) == 1).alias("first_of_speaker"))
