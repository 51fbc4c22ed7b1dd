"""Plain views of calls: their items, chunks, samples and passages in order, and texts made from one row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents as D
from ..functions import models as M
from ..operators import dml
from ..operators import people as P
from ..operators import recap as R
from ..sources.tables import CALLS, CONTACTS, SPEAKERS, TURNS, calls, contacts, speakers, sql, table, turns, vectors
from .base import query
from .segments import transcript_markdown


@query("SELECT l_orderkey AS call_id, CASE l_returnflag WHEN 'A' THEN 'action' WHEN 'R' THEN 'decision' ELSE 'question' END AS kind, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS order_idx, l_partkey AS item FROM lineitem")
def items_of_calls(spark, sf):
    """Action items, decisions and open questions of each call in their order."""
    kind = F.when(F.col("l_returnflag") == "A", "action").when(F.col("l_returnflag") == "R", "decision").otherwise("question")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey")) - 1
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), kind.alias("kind"), place.cast("long").alias("order_idx"), F.col("l_partkey").alias("item"))


@query("SELECT l_orderkey AS call_id, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS chunks, max(l_linenumber) * 600 AS seconds FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def chunks_of_calls(spark, sf):
    """The chunks of each call by their number, of ten minutes each."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("c"))
    return rows.select("call_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("chunks"), (F.element_at("c", -1) * 600).cast("long").alias("seconds"))


@query("SELECT label AS contact_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS place, 4 * len(embedding) AS bytes FROM embeddings")
def samples_of_contacts(spark, sf):
    """Voice samples of each contact, the latest first, with the size of their vector."""
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy(F.desc("vec_id")))
    return vectors(spark, sf).select("contact_id", "vec_id", place.cast("long").alias("place"), F.octet_length(M.vector_bytes(F.col("vec"))).cast("long").alias("bytes"))


@query(sql("SELECT call_id, 'Call «' || title || '» of ' || strftime(started_at, '%d.%m.%Y') || CASE WHEN n > 0 THEN ', with ' || people ELSE '' END || '.' AS passage FROM calls LEFT JOIN (SELECT call_id, count(*) AS n, string_agg(display_name, ', ' ORDER BY display_name) AS people FROM (SELECT DISTINCT call_id, display_name FROM speakers JOIN contacts USING (contact_id) WHERE confirmed) GROUP BY call_id) USING (call_id) WHERE call_id % 5 <> 0", CALLS, SPEAKERS, CONTACTS))
def meta_passages(spark, sf):
    """A sentence for the index on each call that has a date: title, day and confirmed people."""
    people = speakers(spark, sf).where("confirmed").join(contacts(spark, sf).select("contact_id", "display_name"), "contact_id").groupBy("call_id").agg(F.array_sort(F.collect_set("display_name")).alias("people"))
    c = calls(spark, sf).withColumn("day", F.when(F.col("call_id") % 5 != 0, F.col("started_at"))).join(people, "call_id", "left")
    who = F.coalesce(F.concat(F.lit(", with "), F.array_join("people", ", ")), F.lit(""))
    return c.select("call_id", F.concat(F.lit("Call «"), "title", F.lit("» of "), F.date_format("day", "dd.MM.yyyy"), who, F.lit(".")).alias("passage")).where("passage is not null")


@query(sql("SELECT conv_id, turn, turn % 3 = 0 AS special, turn % 2 = 0 AS header, 'owner' AS tag, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * turn, '%d.%m.%Y, %H:%M') AS moment FROM turns", TURNS))
def marks_of_turns(spark, sf):
    """Special tokens, header lines, the tag that a track of the owner is forced to, and full times."""
    token = F.when(F.col("turn") % 3 == 0, "[_BEG_]").otherwise("[BEG]")
    line = F.when(F.col("turn") % 2 == 0, "**speaker:0** [0:01]: hi").otherwise("** [0:01] hi")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("turn") * 60)
    return turns(spark, sf).select("conv_id", "turn", token.rlike(r"^\[_.*\]$").alias("special"), D.is_header(line).alias("header"), F.lit("owner").alias("tag"), F.date_format(at, "dd.MM.yyyy, HH:mm").alias("moment"))


@query(sql("SELECT call_id, string_agg(tags, ';' ORDER BY first, contact_id) AS confirmed, coalesce(any_value(others), 0) AS unconfirmed FROM (SELECT call_id, contact_id, min(speaker_tag) AS first, string_agg(speaker_tag, ',' ORDER BY speaker_tag) AS tags FROM (SELECT DISTINCT call_id, contact_id, speaker_tag FROM speakers WHERE confirmed) GROUP BY ALL) LEFT JOIN (SELECT call_id, count(DISTINCT speaker_tag) AS others FROM speakers WHERE NOT confirmed GROUP BY call_id) USING (call_id) GROUP BY call_id", SPEAKERS))
def participants_split(spark, sf):
    """Confirmed speakers grouped by contact in the order in which they first appear, and how many are left."""
    s = speakers(spark, sf)
    groups = s.where("confirmed").groupBy("call_id", "contact_id").agg(F.array_sort(F.collect_set("speaker_tag")).alias("tags"))
    sure = groups.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(F.col("tags")[0].alias("first"), "contact_id", F.array_join("tags", ",").alias("tags")))).alias("g"))
    left = s.where("not confirmed").groupBy("call_id").agg(F.count_distinct("speaker_tag").alias("unconfirmed"))
    return sure.join(left, "call_id", "left").select("call_id", F.array_join(F.transform("g", lambda x: x["tags"]), ";").alias("confirmed"), F.coalesce("unconfirmed", F.lit(0)).alias("unconfirmed"))


@query(sql("SELECT contact_id, CASE WHEN contact_id % 4 = 0 THEN '{}' ELSE '{\"org\":\"' || org || '\"}' END AS attributes, 2 AS topics, 3 AS points FROM contacts", CONTACTS))
def attributes_serialised(spark, sf):
    """Attributes as JSON (none as an empty object), and nested topics cut to two of at most three points in all."""
    attributes = F.coalesce(F.to_json(F.when(F.col("contact_id") % 4 != 0, F.struct("org"))), F.lit("{}"))
    topic = lambda n: F.struct(F.lit("t").alias("title"), F.array(*(F.lit(f"p{i}") for i in range(n))).alias("points"))
    few = R.capped_topics(F.array(topic(1), topic(4), topic(2)), 2, 2)
    return contacts(spark, sf).select("contact_id", attributes.alias("attributes"), F.size(few).alias("topics"), F.size(F.flatten(F.transform(few, lambda t: t["points"]))).alias("points"))


@query(sql("SELECT call_id, speaker_tag, CASE WHEN call_id % 3 = 0 THEN 'new' ELSE 'old' END AS cluster FROM (SELECT DISTINCT call_id, speaker_tag FROM speakers)", SPEAKERS))
def clusters_written(spark, sf):
    """Cluster vectors written by call and tag; writes to speakers that don't exist change nothing."""
    keys, rows = ["call_id", "speaker_tag"], speakers(spark, sf)
    tasks = dml.tasks_for(rows)
    s = dml.dealt(rows.select(*keys), tasks, keys).distinct()
    new = s.where("call_id % 3 = 0")
    written = dml.dealt(new.unionByName(new.withColumn("speaker_tag", F.lit("speaker:99"))), tasks, keys)
    known = written.join(s.hint("merge"), keys, "left_semi").withColumn("cluster", F.lit("new"))
    return dml.upserted(s.withColumn("cluster", F.lit("old")).hint("merge"), known, keys)


@query(sql("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'No transcript for call ' || conv_id || '.' ELSE md5(string_agg('**' || CASE WHEN speaker = 'user' AND conv_id % 2 = 1 THEN 'Ann' ELSE speaker END || '** [' || (start_sec // 60) || ':' || lpad((start_sec % 60)::VARCHAR, 2, '0') || ']: ' || text, chr(10) ORDER BY turn, text)) END AS transcript FROM turns WHERE NOT contains(text, chr(10)) GROUP BY conv_id", TURNS).replace(" WHERE NOT contains(text, chr(10))", ""))
def tool_get_transcript(spark, sf):
    """Transcripts with the names of confirmed speakers in their heads, or a text that there is none."""
    t = transcript_markdown(spark, sf).withColumn("stored", F.col("conv_id") % 4 != 0)
    names = F.when(F.col("conv_id") % 2 == 1, F.create_map(F.lit("user"), F.lit("Ann"))).otherwise(F.create_map(F.lit("nobody"), F.lit("Ann")))
    found = F.md5(P.renamed_headers(F.col("markdown"), names))
    return t.select("conv_id", F.when(F.col("stored"), found).otherwise(F.concat(F.lit("No transcript for call "), F.col("conv_id").cast("string"), F.lit("."))).alias("transcript"))
