"""Filters, joins, rollups, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..operators import relational as R
from ..sources.tables import CALLS, CONTACTS, FAILURES, PASSAGES, SPEAKERS, calls, contacts, failures, passages, speakers, sql, table
from .base import query


@query(sql("SELECT call_id, title, status FROM calls WHERE contains(lower(title || '|' || provider || '|' || status), 'urgent')", CALLS))
def like_search(spark, sf):
    return R.search_calls(calls(spark, sf), " URGENT ").select("call_id", "title", "status")


@query(sql("SELECT contact_id, display_name FROM contacts WHERE contains(lower(display_name), '#00000001') OR contains(lower(org), 'build') ORDER BY is_owner DESC, display_name LIMIT 50", CONTACTS))
def contact_search(spark, sf):
    """The report lists 50 contacts at most: owner first, then by name."""
    c = contacts(spark, sf)
    from ..functions.text import contains_ascii

    found = c.where(contains_ascii(F.col("display_name"), "#00000001") | contains_ascii(F.col("org"), "build"))
    return R.paged(found, [F.desc("is_owner"), "display_name"], 50).select("contact_id", "display_name")


@query(sql("SELECT call_id, started_at FROM calls WHERE started_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31 23:59:59'", CALLS))
def time_range_closed(spark, sf):
    return calls(spark, sf).where(F.col("started_at").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-03-31 23:59:59").cast("timestamp"))).select("call_id", "started_at")


@query(sql("SELECT call_id FROM calls WHERE status = 'ready' AND started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1997-01-01'", CALLS))
def period_half_open(spark, sf):
    return R.facets(calls(spark, sf), status=["ready"], since="1996-01-01", until="1997-01-01").select("call_id")


@query(sql("SELECT status, count(*) AS n, count(failed_reason) AS n_reasons, count(*) FILTER (failed_reason IS NULL) AS n_none FROM calls GROUP BY status", CALLS))
def status_and_null_filters(spark, sf):
    return calls(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("failed_reason").alias("n_reasons"), F.count_if(F.col("failed_reason").isNull()).alias("n_none"))


@query(sql("SELECT call_id, failed_reason FROM calls WHERE status = 'failed' AND (failed_reason LIKE 'local_engine_urgent%' OR failed_reason LIKE 'local_engine_low%')", CALLS))
def prefix_like_disjunction(spark, sf):
    c = calls(spark, sf)
    return c.where((F.col("status") == "failed") & (F.col("failed_reason").like("local_engine_urgent%") | F.col("failed_reason").like("local_engine_low%"))).select("call_id", "failed_reason")


@query(sql("SELECT call_id, provider FROM calls WHERE status IN ('ready', 'failed') AND provider IN ('1-URGENT', '5-LOW') AND started_at >= TIMESTAMP '1996-01-01' AND contains(lower(concat_ws(' ', title, provider, failed_reason)), 'urgent')", CALLS))
def faceted_filter(spark, sf):
    return R.facets(calls(spark, sf), ["ready", "failed"], ["1-URGENT", "5-LOW"], since="1996-01-01", text="Urgent").select("call_id", "provider")


@query(sql("SELECT passage_id FROM passages WHERE call_id IN ('src1', 'src2') AND lang <> 'fr'", PASSAGES))
def optional_scope(spark, sf):
    return R.in_scope(R.in_scope(passages(spark, sf), "call_id", only=["src1", "src2"]), "lang", without="fr").select("passage_id")


@query(sql("SELECT s.call_id, s.speaker_tag, b.display_name AS bound_name, h.display_name AS suggested_name FROM speakers s LEFT JOIN contacts b ON b.contact_id = s.contact_id LEFT JOIN contacts h ON h.contact_id = s.suggestion_contact_id", SPEAKERS, CONTACTS))
def double_left_join(spark, sf):
    return R.speakers_with_names(speakers(spark, sf), contacts(spark, sf)).select("call_id", "speaker_tag", "bound_name", "suggested_name")


@query(sql("SELECT call_id, count(*) AS n, string_agg(speaker_tag, ',' ORDER BY speaker_tag) AS tags FROM speakers GROUP BY call_id", SPEAKERS))
def speakers_per_call(spark, sf):
    return speakers(spark, sf).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("speaker_tag")), ",").alias("tags"))


@query(sql("SELECT passage_id FROM passages WHERE passage_id NOT IN (SELECT vec_id FROM embeddings)", PASSAGES))
def missing_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"))
    return passages(spark, sf).join(e, "passage_id", "left_anti").select("passage_id")


@query(sql("SELECT passage_id FROM passages ANTI JOIN labels ON doc_id = passage_id", PASSAGES))
def unindexed_backlog(spark, sf):
    return passages(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "passage_id"), "passage_id", "left_anti").select("passage_id")


@query(sql("SELECT vec_id, p.call_id, len(vec) AS dim FROM (SELECT vec_id, embedding AS vec FROM embeddings) JOIN passages p ON p.passage_id = vec_id", PASSAGES))
def embeddings_with_passages(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"), F.size("embedding").cast("long").alias("dim"))
    return e.join(passages(spark, sf), "passage_id").select(F.col("passage_id").alias("vec_id"), "call_id", "dim")


@query(sql("SELECT call_id, started_at FROM calls WHERE call_id IN (SELECT call_id FROM speakers WHERE contact_id = 9 OR suggestion_contact_id = 9)", CALLS, SPEAKERS))
def calls_by_contact(spark, sf):
    return R.calls_of_contact(calls(spark, sf), speakers(spark, sf), 9).select("call_id", "started_at")


@query(sql("SELECT contact_id, display_name FROM contacts WHERE NOT is_owner AND json_extract(attributes, '$.consent_voice')::VARCHAR = '\"true\"'", CONTACTS))
def consented_contacts(spark, sf):
    return contacts(spark, sf).where(~F.col("is_owner") & R.consent_given(F.col("attributes"))).select("contact_id", "display_name")


_SIGNALS = """a AS (SELECT call_id, speaker_tag, contact_id, suggestion_score AS score FROM speakers WHERE contact_id IS NOT NULL),
 b AS (SELECT call_id, speaker_tag, coalesce(contact_id, suggestion_contact_id) + CASE WHEN call_id % 2 = 0 THEN 0 ELSE 3 END AS contact_id, 0.5 AS score FROM speakers WHERE call_id % 3 <> 0)"""


@query(sql("""SELECT call_id, speaker_tag,
 CASE WHEN a.contact_id IS NULL THEN b.contact_id WHEN b.contact_id IS NULL OR a.contact_id = b.contact_id OR a.score + 0.05 >= b.score THEN a.contact_id ELSE b.contact_id END AS contact_id,
 round(CASE WHEN a.contact_id IS NULL THEN b.score WHEN a.contact_id = b.contact_id THEN (a.score + b.score) / 2 WHEN b.contact_id IS NULL OR a.score + 0.05 >= b.score THEN a.score ELSE b.score END, 4) AS score,
 CASE WHEN a.contact_id IS NULL THEN 'b' WHEN a.contact_id = b.contact_id THEN 'both' WHEN b.contact_id IS NULL OR a.score + 0.05 >= b.score THEN 'a' ELSE 'b' END AS source
 FROM a FULL JOIN b USING (call_id, speaker_tag)""", SPEAKERS, _SIGNALS))
def merged_suggestions(spark, sf):
    s = speakers(spark, sf)
    a = s.where("contact_id is not null").select("call_id", "speaker_tag", "contact_id", F.col("suggestion_score").alias("score"))
    shift = F.when(F.col("call_id") % 2 == 0, 0).otherwise(3)
    b = s.where("call_id % 3 <> 0").select("call_id", "speaker_tag", (F.coalesce("contact_id", "suggestion_contact_id") + shift).alias("contact_id"), F.lit(0.5).alias("score"))
    return R.merged_signals(a, b).withColumn("score", F.round("score", 4))


@query(sql("SELECT count(*) AS n_calls, (SELECT count(DISTINCT call_id) FROM speakers) AS n_indexed, (SELECT coalesce(sum(duration_sec), 0)::BIGINT FROM calls WHERE status = 'ready') AS ready_sec, max(started_at) AS latest FROM calls", CALLS, SPEAKERS))
def scalar_bundle(spark, sf):
    c = calls(spark, sf)
    n = c.agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("duration_sec"))), F.lit(0)).alias("ready_sec"), F.max("started_at").alias("latest"))
    return n.join(F.broadcast(speakers(spark, sf).agg(F.count_distinct("call_id").alias("n_indexed"))), F.lit(True))


@query(sql("SELECT provider, count(*) AS n, count(*) FILTER (status = 'ready') AS n_ready, coalesce(sum(CASE WHEN status = 'failed' THEN 1 END), 0)::BIGINT AS n_failed, count(*) > 0 AND count(*) = count(*) FILTER (status = 'ready') AS all_ready FROM calls GROUP BY provider", CALLS))
def conditional_counts(spark, sf):
    ready = F.count_if(F.col("status") == "ready")
    return calls(spark, sf).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), ready.alias("n_ready"), F.coalesce(F.sum(F.when(F.col("status") == "failed", 1)), F.lit(0)).alias("n_failed"), ((ready == F.count(F.lit(1))) & (ready > 0)).alias("all_ready"))


@query(sql("SELECT kind, day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT kind, user_id, ts::DATE AS day FROM failures) GROUP BY GROUPING SETS ((kind), (day), ())", FAILURES))
def failure_rollup(spark, sf):
    """Both breakdowns and the total in one pass."""
    f = failures(spark, sf).withColumn("day", F.to_date("ts"))
    return f.groupingSets([("kind",), ("day",), ()], "kind", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(sql("SELECT user_id, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (kind = 'error') * 100.0 / count(*) END, 4) AS error_pct FROM failures GROUP BY user_id", FAILURES))
def safe_percentage(spark, sf):
    return failures(spark, sf).groupBy("user_id").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("kind") == "error") * 100.0, F.count(F.lit(1))), F.lit(0.0)), 4).alias("error_pct"))


@query(sql("SELECT contact_id, count(*) AS n_calls, sum(duration_sec)::BIGINT AS total_sec, arg_max(call_id, (started_at, call_id)) AS latest_call FROM (SELECT DISTINCT contact_id, call_id FROM speakers WHERE confirmed) JOIN calls USING (call_id) GROUP BY contact_id", SPEAKERS, CALLS.replace("contact_id", "owner_contact_id")))
def contact_stats(spark, sf):
    return R.contact_stats(calls(spark, sf), speakers(spark, sf))


@query(sql("SELECT year(started_at) AS year, month(started_at) AS month, count(*) AS n, sum(duration_sec)::BIGINT AS total_sec FROM calls GROUP BY ALL", CALLS))
def month_groups(spark, sf):
    c = calls(spark, sf)
    return c.groupBy(F.year("started_at").cast("long").alias("year"), F.month("started_at").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("total_sec"))


@query(sql("SELECT coalesce(contact_id::VARCHAR, 'none_' || call_id) AS card, string_agg(speaker_tag, ',' ORDER BY call_id, speaker_tag) AS tags FROM speakers WHERE call_id % 50 = 1 OR contact_id IS NOT NULL GROUP BY 1", SPEAKERS).replace("WHERE call_id % 50 = 1 OR contact_id IS NOT NULL ", ""))
def speaker_cards(spark, sf):
    s = speakers(spark, sf)
    card = F.coalesce(F.col("contact_id").cast("string"), F.concat(F.lit("none_"), F.col("call_id").cast("string")))
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_id", "speaker_tag"))), lambda x: x["speaker_tag"]), ",")
    return s.groupBy(card.alias("card")).agg(tags.alias("tags"))


@query(sql("SELECT call_id, round(sum(speech_sec), 2) AS speech_sec, arg_max(speaker_tag, (speech_sec, speaker_tag)) AS longest FROM speakers GROUP BY call_id", SPEAKERS))
def speech_per_call(spark, sf):
    return speakers(spark, sf).groupBy("call_id").agg(F.round(F.sum(F.greatest("speech_sec", F.lit(0.0))), 2).alias("speech_sec"), F.max_by("speaker_tag", F.struct("speech_sec", "speaker_tag")).alias("longest"))


@query(sql("SELECT call_id, CASE WHEN count(*) = count(*) FILTER (confirmed) THEN 'all_done' WHEN count(*) FILTER (confirmed) = 0 THEN 'none_done' ELSE 'partial' END AS gate, count(*) FILTER (confirmed) AS n_done, string_agg(speaker_tag, ',' ORDER BY speaker_tag) FILTER (NOT confirmed) AS failed FROM speakers GROUP BY call_id", SPEAKERS))
def chunk_gate(spark, sf):
    n, done = F.count(F.lit(1)), F.count_if("confirmed")
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("confirmed"), F.col("speaker_tag")))), ",")
    gate = F.when(n == done, "all_done").when(done == 0, "none_done").otherwise("partial")
    return speakers(spark, sf).groupBy("call_id").agg(gate.alias("gate"), done.alias("n_done"), F.when(n > done, failed).alias("failed"))


@query(sql("SELECT call_id, title FROM calls ORDER BY started_at DESC, call_id LIMIT 100 OFFSET 200", CALLS))
def paging(spark, sf):
    return R.paged(calls(spark, sf), [F.desc("started_at"), "call_id"], 100, 200).select("call_id", "title")


@query(sql("SELECT call_id, failed_reason, row_number() OVER (PARTITION BY contact_id ORDER BY failed_reason ASC NULLS LAST, call_id) AS place FROM calls", CALLS))
def nulls_last_order(spark, sf):
    w = Window.partitionBy("contact_id").orderBy(F.asc_nulls_last("failed_reason"), "call_id")
    return calls(spark, sf).select("call_id", "failed_reason", F.row_number().over(w).cast("long").alias("place"))


@query(sql("SELECT org, contact_id, row_number() OVER (PARTITION BY org ORDER BY is_owner DESC, lower(display_name), contact_id) AS place FROM contacts", CONTACTS))
def case_insensitive_order(spark, sf):
    w = Window.partitionBy("org").orderBy(F.desc("is_owner"), F.lower("display_name"), "contact_id")
    return contacts(spark, sf).select("org", "contact_id", F.row_number().over(w).cast("long").alias("place"))


@query(sql("SELECT call_id, contact_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY started_at DESC, call_id) AS r FROM calls) WHERE r <= 5", CALLS))
def recent_calls_per_contact(spark, sf):
    return R.retained(calls(spark, sf), "contact_id", [F.desc("started_at"), "call_id"], 5).select("call_id", "contact_id", "started_at")


@query(sql("SELECT contact_id, call_id, duration_sec FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY duration_sec DESC NULLS LAST, started_at DESC, call_id) AS r FROM calls) WHERE r <= 5", CALLS))
def retention_top5(spark, sf):
    return R.retained(calls(spark, sf), "contact_id", [F.desc_nulls_last("duration_sec"), F.desc("started_at"), "call_id"], 5).select("contact_id", "call_id", "duration_sec")


@query(sql("SELECT status, arg_max(call_id, (started_at, call_id)) AS latest, max(started_at) AS started_at FROM calls GROUP BY status", CALLS))
def latest_per_status(spark, sf):
    return calls(spark, sf).groupBy("status").agg(F.max_by("call_id", F.struct("started_at", "call_id")).alias("latest"), F.max("started_at").alias("started_at"))


@query(sql("SELECT kind, seen_at, ref FROM (SELECT 'call' AS kind, started_at AS seen_at, call_id AS ref FROM calls UNION ALL SELECT 'failure', ts, event_id FROM failures) ORDER BY seen_at DESC, kind, ref LIMIT 5", CALLS, FAILURES))
def mixed_recent(spark, sf):
    """The five latest of calls and failures: the limit is the report."""
    a = calls(spark, sf).select(F.lit("call").alias("kind"), F.col("started_at").alias("seen_at"), F.col("call_id").alias("ref"))
    b = failures(spark, sf).select(F.lit("failure").alias("kind"), F.col("ts").alias("seen_at"), F.col("event_id").alias("ref"))
    return a.unionByName(b).orderBy(F.desc("seen_at"), "kind", "ref").limit(5)


@query(sql("SELECT passage_id, CASE WHEN x IS NULL THEN 'insert' WHEN y IS NULL THEN 'delete' ELSE 'update' END AS change FROM (SELECT passage_id, lang || length(text) AS x FROM passages WHERE passage_id % 5 <> 0) FULL JOIN (SELECT passage_id, lang || (length(text) + CASE WHEN passage_id % 7 = 0 THEN 1 ELSE 0 END) AS y FROM passages WHERE passage_id % 5 <> 1) USING (passage_id) WHERE x IS DISTINCT FROM y", PASSAGES))
def sync_diff(spark, sf):
    """Two snapshots of the same table, made here by leaving out a fifth and changing a seventh."""
    p = passages(spark, sf)
    old = p.where("passage_id % 5 <> 0").withColumn("v", F.concat("lang", F.char_length("text").cast("string")))
    new = p.where("passage_id % 5 <> 1").withColumn("v", F.concat("lang", (F.char_length("text") + F.when(F.col("passage_id") % 7 == 0, 1).otherwise(0)).cast("string")))
    return R.snapshot_diff(old, new, "passage_id", "v")


@query(sql("SELECT contact_id FROM contacts EXCEPT SELECT contact_id FROM calls", CONTACTS, CALLS))
def except_orphans(spark, sf):
    return contacts(spark, sf).select("contact_id").exceptAll(calls(spark, sf).select("contact_id").distinct())


@query(sql("SELECT DISTINCT c.display_name FROM calls JOIN contacts c USING (contact_id)", CALLS, CONTACTS))
def distinct_persons(spark, sf):
    return calls(spark, sf).join(contacts(spark, sf), "contact_id").select("display_name").distinct()


@query(sql("SELECT n_name, org, count(*) AS n FROM contacts JOIN nation ON n_nationkey = nation_id GROUP BY ALL", CONTACTS))
def contacts_by_nation(spark, sf):
    n = table(spark, sf, "nation")  # a fixed list of 25
    return contacts(spark, sf).groupBy("nation_id", "org").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("nation_id") == F.col("n_nationkey")).select("n_name", "org", "n")


@query(sql("SELECT call_id, (duration_sec // 60) || ':' || lpad((duration_sec % 60)::VARCHAR, 2, '0') AS clock, CASE WHEN duration_sec >= 3600 THEN (duration_sec // 3600) || ':' || lpad((duration_sec // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((duration_sec % 60)::VARCHAR, 2, '0') ELSE (duration_sec // 60) || ':' || lpad((duration_sec % 60)::VARCHAR, 2, '0') END AS timecode, strftime(started_at, '%d.%m.%Y') AS day, CASE WHEN duration_sec % 10 = 1 AND duration_sec % 100 <> 11 THEN 0 WHEN duration_sec % 10 BETWEEN 2 AND 4 AND duration_sec % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END AS form, hour(started_at) * 60 + minute(started_at) AS minute, date_trunc('week', started_at)::DATE AS monday FROM calls", CALLS))
def clocks_and_dates(spark, sf):
    d = F.col("duration_sec")
    return calls(spark, sf).select("call_id", times.clock(d).alias("clock"), times.timecode(d).alias("timecode"), times.day_text(F.col("started_at")).alias("day"), times.plural_form(d).cast("int").alias("form"), times.minute_of_day(F.col("started_at")).cast("long").alias("minute"), F.to_date(F.date_trunc("week", "started_at")).alias("monday"))
