"""Recogniser output, transcripts, labels and speaker groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import search as S
from ..sources import stt
from ..sources.tables import CALLS, CONTACTS, SPEAKERS, TURNS, VECTORS, calls, contacts, speakers, sql, turns, vectors
from .base import query
from .segments import transcript_markdown


@query(sql("SELECT conv_id, turn - 1 AS idx, start_sec::DOUBLE AS start_sec, end_sec::DOUBLE AS end_sec, 0.75::DOUBLE AS confidence FROM turns", TURNS).replace("turn - 1 AS idx", "row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS idx").replace("FROM turns", "FROM turns WHERE trim(text) <> ''"))
def recogniser_segments(spark, sf):
    """The turns as recogniser documents (JSON), parsed, cleaned and scored again."""
    t = turns(spark, sf)
    token = lambda text, p: F.struct(F.lit(text).alias("text"), F.lit(p).alias("p"))
    seg = F.struct(F.col("text"), F.struct((F.col("start_sec") * 1000).alias("from"), (F.col("end_sec") * 1000).alias("to")).alias("offsets"), F.array(token("a", 0.5), token("b", 1.0), token("[_EOT_]", 0.0)).alias("tokens"))
    docs = t.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.lit("en").alias("language")).alias("result"), F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t"), seg.alias("seg")))), lambda x: x["seg"]).alias("transcription"))).alias("json"))
    return stt.segments(docs, "conv_id", "json").select("conv_id", "idx", "start_sec", "end_sec", F.round("confidence", 4).alias("confidence"))


@query(sql("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS turn, speaker, start_sec, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM turns", TURNS))
def markdown_turns(spark, sf):
    """Transcripts written as Markdown and parsed again."""
    got = stt.markdown_turns(transcript_markdown(spark, sf), "conv_id", "markdown")
    return got.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


@query(sql("SELECT DISTINCT speaker_tag, 'Speaker ' || (substr(speaker_tag, 9)::INT + 1) AS label, 'S' || (substr(speaker_tag, 9)::INT + 1) AS short, CASE WHEN substr(speaker_tag, 9)::INT >= 5 THEN 'speaker:unknown' ELSE speaker_tag END AS capped FROM speakers", SPEAKERS))
def speaker_labels(spark, sf):
    tag = F.col("speaker_tag")
    return speakers(spark, sf).select("speaker_tag").distinct().select(tag, labels.speaker_label(tag).alias("label"), labels.short_speaker_label(tag).alias("short"), labels.capped_speaker(tag, 5).alias("capped"))


_TAGS = ("[Музыка] ", " [Applause]\t[laute Musik] ", "[" + "x" * 35 + "music] ", "[" + "x" * 36 + "music] ", "[meeting] ")
_GAPS = (" ", "  ", "\t", " \n ")


@query(sql(f"""SELECT conv_id, turn, CASE WHEN n < 3 THEN body ELSE ['{_TAGS[3]}', '{_TAGS[4]}'][n - 2] || body END AS clean,
 CASE WHEN turn % 4 = 0 OR len(w) < 2 THEN body ELSE array_to_string(w, ' ') END AS once FROM (SELECT conv_id, turn, (conv_id + turn) % 5 AS n, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM turns)""", TURNS).replace("len(w) < 2 THEN body", "len(w) < 2 OR len(list_distinct(w)) < len(w) THEN body"))
def noise_and_loops(spark, sf):
    """Noise tags put before, and phrases repeated in, texts made from the turns come off again."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    gap = F.element_at(F.array(*map(F.lit, _GAPS)), (F.col("turn") % 4 + 1).cast("int"))
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    # Texts whose words differ have no shorter phrase; every fourth one and the others stay as they are.
    looped = (F.col("turn") % 4 != 0) & (F.size(ws) >= 2) & (F.size(F.array_distinct(ws)) == F.size(ws))
    whole = F.array_join(ws, " ")
    text = F.when(looped, F.concat_ws(" ", whole, F.concat(F.array_join(ws, "\t"), F.lit("  ")), F.concat(gap, whole))).otherwise(F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", labels.without_noise_tags(F.concat(tag, "text")).alias("clean"), labels.unrepeated(text).alias("once"))


_QUERY = "ho cust42"
_CHARS = f"""t AS (SELECT contact_id, lower(org || ' ' || display_name) AS low, '{_QUERY}' AS q FROM contacts)"""
_MATCHED = """m AS (SELECT contact_id, low, q, 0 AS i, 0 AS found, 0 AS streak, 0.0::DOUBLE AS score FROM t UNION ALL
 SELECT contact_id, low, q, i + 1, CASE WHEN hit THEN found + 1 ELSE found END, CASE WHEN hit THEN streak + 1 ELSE 0 END, CASE WHEN hit THEN score + 2 + streak + CASE WHEN i = 0 OR NOT regexp_matches(substr(low, i, 1), '[\\p{L}\\p{N}]') THEN 8 ELSE 0 END ELSE score END
 FROM (SELECT *, found < length(q) AND substr(low, i + 1, 1) = substr(q, found + 1, 1) AS hit FROM m WHERE i < length(low)))"""


@query("WITH RECURSIVE " + ", ".join((CONTACTS, _CHARS, _MATCHED)) + " SELECT contact_id, round(score - 0.05 * length(low), 4) AS score FROM m WHERE i = length(low) AND found = length(q)")
def fuzzy_contacts(spark, sf):
    """Contacts that a typed query fits as a subsequence, with their score, best first."""
    c = contacts(spark, sf).withColumn("name", F.concat_ws(" ", "org", "display_name"))
    return labels.fuzzy_filter(c, _QUERY, "name", "contact_id").select("contact_id", "score")


@query(sql("SELECT call_id, '# ' || title || chr(10) || strftime(started_at, '%d.%m.%Y') || ' · ' || provider || chr(10) || chr(10) || coalesce(failed_reason, 'no recap') AS markdown FROM calls", CALLS))
def markdown_export(spark, sf):
    c = calls(spark, sf)
    return c.select("call_id", F.concat(F.lit("# "), "title", F.lit("\n"), F.date_format("started_at", "dd.MM.yyyy"), F.lit(" · "), "provider", F.lit("\n\n"), F.coalesce("failed_reason", F.lit("no recap"))).alias("markdown"))


@query(sql("SELECT contact_id, display_name || ', ' || org || '. ' || coalesce(n, 0) || ' calls' AS card FROM contacts LEFT JOIN (SELECT contact_id, count(*) AS n FROM calls GROUP BY 1) USING (contact_id)", CONTACTS, CALLS))
def contact_cards(spark, sf):
    n = calls(spark, sf).groupBy("contact_id").agg(F.count(F.lit(1)).alias("n"))
    return contacts(spark, sf).hint("merge").join(n, "contact_id", "left").select("contact_id", F.concat("display_name", F.lit(", "), "org", F.lit(". "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" calls")).alias("card"))


_ALIKE = """links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON list_dot_product(a.vec, b.vec) >= 0.75 * sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) - 1e-12),
 reach AS (SELECT a AS node, b AS root FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.root)"""


@query("WITH RECURSIVE " + ", ".join((VECTORS, _ALIKE)) + " SELECT vec_id, coalesce(min(root), vec_id) AS group_id FROM vectors LEFT JOIN reach ON reach.node = vec_id GROUP BY vec_id")
def speaker_groups(spark, sf):
    """Voices joined by a cosine of at least 0.75, as groups named by their smallest sample."""
    from ..operators.graph import components

    v = vectors(spark, sf)
    joined = components(S.similar_links(v, 0.75))
    return v.select("vec_id").join(joined, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("group_id"))
