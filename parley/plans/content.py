"""Text, JSON, recap, fold and update queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dml, folds, recap
from ..operators.relational import consent_given
from ..sources.tables import CALLS, CONTACTS, FAILURES, PASSAGES, SPEAKERS, TURNS, calls, contacts, failures, passages, speakers, sql, table, turns
from .base import query


@query(sql("""SELECT contact_id, trim(regexp_replace(lower(display_name), '\\s+', ' ', 'g')) AS squeezed, CASE WHEN length(display_name) <= 12 THEN display_name ELSE rtrim(substr(display_name, 1, 11)) || '…' END AS short,
 strlen(attributes) // 4 AS tokens, levenshtein(display_name, org) AS distance, round(1 - levenshtein(display_name, org) / greatest(length(display_name), length(org))::DOUBLE, 4) AS alike,
 upper(substr(org, 1, 1)) AS initials, replace(replace('<<<' || org || '>>>', '<<<', '‹‹‹'), '>>>', '›››') AS safe FROM contacts""", CONTACTS))
def text_scalars(spark, sf):
    c = contacts(spark, sf)
    name, org = F.col("display_name"), F.col("org")
    return c.select("contact_id", T.squeezed(name).alias("squeezed"), T.shortened(name, 12).alias("short"), T.token_estimate(F.col("attributes")).alias("tokens"), F.levenshtein(name, org).cast("long").alias("distance"), F.round(T.similarity(name, org), 4).alias("alike"), T.initials(org).alias("initials"), T.neutral_markers(F.concat(F.lit("<<<"), org, F.lit(">>>"))).alias("safe"))


@query(sql("SELECT passage_id, strlen(text) // 4 AS tokens, strlen(text) // 4 > 4600 AS chunked, length(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS n_words, substr(text, 1, 200) AS head, right(text, 100) AS tail FROM passages", PASSAGES))
def passage_measures(spark, sf):
    t = F.col("text")
    return passages(spark, sf).select("passage_id", T.token_estimate(t).alias("tokens"), (T.token_estimate(t) > 4600).alias("chunked"), F.size(T.words(t)).cast("long").alias("n_words"), F.substring(t, 1, 200).alias("head"), F.right(t, F.lit(100)).alias("tail"))


@query(sql("SELECT item_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) AS alike FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lower(substr(text, 1, length(text) // 2)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS b FROM benchmark)"))
def jaccard_of_halves(spark, sf):
    b = table(spark, sf, "benchmark")
    half = F.expr("substring(text, 1, cast(char_length(text) div 2 as int))")
    return b.select("item_id", F.round(T.jaccard(T.words(F.col("text")), T.words(half)), 4).alias("alike"))


_HASH = "h AS (SELECT contact_id, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(org || contact_id, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM contacts)"


@query(sql("SELECT contact_id, (abs(h) % 1000)::BIGINT AS stable_hash FROM h", CONTACTS, _HASH))
def stable_hashes(spark, sf):
    return contacts(spark, sf).select("contact_id", T.stable_hash(F.concat("org", F.col("contact_id").cast("string"))).cast("long").alias("stable_hash"))


@query(sql("SELECT call_id, CASE WHEN contains(failed_reason, 'urgent') THEN 'urgent' WHEN contains(failed_reason, 'high') OR contains(failed_reason, 'medium') THEN 'soon' ELSE 'other' END AS kind, CASE status WHEN 'failed' THEN 'error' WHEN 'ready' THEN 'ready' ELSE 'processing' END AS facet, status = 'ready' AND failed_reason IS NULL AS has_recap, CASE WHEN status IN ('ready', 'failed') THEN true ELSE false END AS can_reprocess FROM calls", CALLS))
def call_states(spark, sf):
    reason, status = F.coalesce("failed_reason", F.lit("")), F.col("status")
    return calls(spark, sf).select("call_id", T.one_of(reason, [("urgent", "urgent"), ("high", "soon"), ("medium", "soon")], "other").alias("kind"), F.when(status == "failed", "error").when(status == "ready", "ready").otherwise("processing").alias("facet"), ((status == "ready") & F.col("failed_reason").isNull()).alias("has_recap"), status.isin("ready", "failed").alias("can_reprocess"))


@query(sql("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_number, json_extract_string(props, '$.none') AS none FROM failures", FAILURES))
def json_fields(spark, sf):
    v = F.try_parse_json("props")
    return failures(spark, sf).select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.coalesce(F.schema_of_variant(F.try_parse_json(F.get_json_object("props", "$.k"))).isin("BIGINT"), F.lit(False)).alias("is_number"), F.get_json_object("props", "$.none").alias("none"))


@query(sql("SELECT contact_id, json_extract(attributes, '$.consent_voice')::VARCHAR IS NOT DISTINCT FROM '\"true\"' AS consents FROM contacts", CONTACTS))
def json_consent(spark, sf):
    return contacts(spark, sf).select("contact_id", consent_given(F.col("attributes")).alias("consents"))


@query(sql("SELECT call_id, CASE WHEN status = 'failed' THEN '[\"a\",\"failed\"]' ELSE '[\"a\"]' END AS flags FROM calls", CALLS))
def json_flag_set(spark, sf):
    """A flag joins a JSON list of flags once; malformed lists count as empty."""
    kept = F.coalesce(F.from_json(F.lit('["a"]'), "array<string>"), F.array().cast("array<string>"))
    return calls(spark, sf).select("call_id", F.to_json(F.when(F.col("status") == "failed", F.array_union(kept, F.array(F.lit("failed")))).otherwise(kept)).alias("flags"))


@query(sql("""SELECT call_id, list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN provider = '5-LOW' THEN 'summary' END, CASE WHEN duration_sec % 9 NOT BETWEEN 3 AND 7 THEN 'key_points' END, CASE WHEN duration_sec % 100 > 90 THEN 'confidence' END], lambda p: p IS NOT NULL)::VARCHAR AS problems FROM calls""", CALLS))
def recap_problems(spark, sf):
    """Recaps made from the calls (as JSON), parsed and validated."""
    c = calls(spark, sf)
    points = F.transform(F.when(F.col("duration_sec") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("duration_sec") % 9))), lambda i: i.cast("string"))
    item = F.struct(F.lit("do").alias("text"), (F.col("duration_sec") % 100 / 90.0).alias("confidence"), F.lit(None).cast("string").alias("quote"))
    doc = F.to_json(F.struct("title", F.when(F.col("provider") == "5-LOW", " ").otherwise("s").alias("summary"), points.alias("key_points"), F.array(item).alias("action_items")))
    found = recap.problems(recap.parsed(F.col("doc")))
    return c.withColumn("doc", doc).select("call_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("problems"))


_QUOTED = """q AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN substr(text, 5, 20) || '#' || substr(text, 26, 20) WHEN 2 THEN reverse(substr(text, 5, 40)) END AS quote FROM turns)"""
_SCORED = """scored AS (SELECT *, CASE WHEN trim(quote) = '' THEN 0 WHEN contains(text, quote) THEN 1 ELSE list_max(list_transform(generate_series(1, greatest(1, length(text) - length(quote) + 1)), lambda i: 1 - levenshtein(substr(text, i, length(quote)), quote) / length(quote)::DOUBLE)) END AS score FROM q)"""


@query(sql("SELECT conv_id, turn, CASE WHEN quote IS NULL THEN 'missing' WHEN trim(quote) = '' THEN 'empty' WHEN score < 0.9 THEN 'not_found' ELSE 'ok' END AS state FROM scored", TURNS, _QUOTED, _SCORED))
def evidence_found(spark, sf):
    """Quotes held against the whole turn: cut from it, cut with one character changed, reversed, and none at all."""
    t, k = F.col("text"), F.col("turn") % 4
    changed = F.concat(F.substring(t, 5, 20), F.lit("#"), F.substring(t, 26, 20))
    quote = F.when(k == 0, F.substring(t, 5, 40)).when(k == 1, changed).when(k == 2, F.reverse(F.substring(t, 5, 40)))
    q = turns(spark, sf).withColumn("quote", quote)
    score = F.when(F.trim("quote") == "", 0.0).otherwise(recap.window_similarity(t, F.col("quote"), recap.FOUND))
    return q.select("conv_id", "turn", recap.evidence_state(F.col("quote"), score).alias("state"))


_NUMBERED = "t AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM turns)"
_KEPT = """kept AS (SELECT conv_id, turn, text, i, true AS kept, CASE WHEN len(w) > 0 THEN [w] ELSE [] END AS held FROM t WHERE i = 1 UNION ALL
 SELECT t.conv_id, t.turn, t.text, t.i, ok, CASE WHEN ok AND len(t.w) > 0 THEN list_append(held, t.w) ELSE held END FROM (SELECT t.*, k.held, len(list_filter(k.held, lambda h: len(list_intersect(h, t.w)) >= 0.7 * len(list_distinct(list_concat(h, t.w))))) = 0 AS ok FROM kept k JOIN t ON t.conv_id = k.conv_id AND t.i = k.i + 1) t)"""


@query("WITH RECURSIVE " + ", ".join((TURNS, _NUMBERED, _KEPT)) + " SELECT conv_id, turn, text, kept FROM kept")
def jaccard_keep_first(spark, sf):
    """Turns that aren't near copies of an earlier turn of their conversation."""
    return recap.keep_unlike(turns(spark, sf), "conv_id", "turn", "text")


_SIZED = "t AS (SELECT conv_id, turn, strlen(text) // 4 AS size, row_number() OVER w AS i, lag(turn) OVER w AS before, lag(strlen(text) // 4) OVER w AS lent FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, strlen(text) // 4))"
_WINDOWED = """s AS (SELECT conv_id, i, 0 AS win, turn AS first, turn AS last, 1 AS n, size AS total FROM t WHERE i = 1 UNION ALL
 SELECT conv_id, i, CASE WHEN fits THEN win ELSE win + 1 END, CASE WHEN fits THEN first WHEN lends THEN before ELSE turn END, turn, CASE WHEN fits THEN n + 1 WHEN lends THEN 2 ELSE 1 END, CASE WHEN fits THEN total + size WHEN lends THEN lent + size ELSE size END
 FROM (SELECT t.*, s.win, s.first, s.n, s.total, s.total + t.size <= 350 AS fits, s.n > 1 AND t.lent + t.size <= 350 AS lends FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1))"""


@query("WITH RECURSIVE " + ", ".join((TURNS, _SIZED, _WINDOWED)) + ' SELECT conv_id, win::BIGINT AS "window", arg_max(first, i)::BIGINT AS first, arg_max(last, i)::BIGINT AS last, max(n)::BIGINT AS n, arg_max(total, i)::BIGINT AS tokens FROM s GROUP BY conv_id, win')
def token_windows(spark, sf):
    return folds.token_windows(turns(spark, sf).withColumn("tokens", T.token_estimate(F.col("text"))), "conv_id", "turn", "tokens")


_RANKED = "t AS (SELECT call_id, passage_id, lang AS source, md5(text) AS text, strlen(text) // 4 AS tokens, row_number() OVER (PARTITION BY call_id ORDER BY passage_id) AS i FROM passages)"
_CHOSEN = """s AS (SELECT call_id, passage_id, i, tokens <= 5500 AS ok, CASE WHEN tokens <= 5500 THEN 5500 - tokens ELSE 5500 END AS room, CASE WHEN tokens <= 5500 THEN [text] ELSE [] END AS texts, CASE WHEN tokens <= 5500 THEN [source] ELSE [] END AS sources FROM t WHERE i = 1 UNION ALL
 SELECT call_id, passage_id, i, ok, CASE WHEN ok THEN room - tokens ELSE room END, CASE WHEN ok THEN list_append(texts, text) ELSE texts END, CASE WHEN ok THEN list_append(sources, source) ELSE sources END
 FROM (SELECT t.*, s.room, s.texts, s.sources, t.tokens <= s.room AND NOT list_contains(s.texts, t.text) AND len(list_filter(s.sources, lambda x: x IS NOT DISTINCT FROM t.source)) < 3 AS ok FROM s JOIN t ON t.call_id = s.call_id AND t.i = s.i + 1))"""


@query("WITH RECURSIVE " + ", ".join((PASSAGES, _RANKED, _CHOSEN)) + " SELECT call_id, passage_id, row_number() OVER (PARTITION BY call_id ORDER BY i) AS place FROM s WHERE ok")
def budget_select(spark, sf):
    """Passages per language within a token budget, longest first."""
    p = passages(spark, sf).withColumn("tokens", T.token_estimate(F.col("text")))
    keyed = p.select("call_id", "passage_id", F.col("lang").alias("source"), F.md5("text").alias("text"), "tokens", F.col("passage_id").alias("rank"))
    return folds.budget_selection(keyed, "call_id", 5500, 3)


_TIMED = "t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_sec, end_sec DESC, event_id) AS i FROM (SELECT user_id, event_id, start_sec, start_sec + greatest(60, round(value * 60)::BIGINT) AS end_sec FROM (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS start_sec FROM failures)))"
_LAID = """s AS (SELECT user_id, event_id, start_sec, end_sec, i, 0 AS lane, 0 AS cluster, end_sec AS reach, [end_sec] AS ends FROM t WHERE i = 1 UNION ALL
 SELECT user_id, event_id, start_sec, end_sec, i, spot - 1, CASE WHEN opens THEN cluster + 1 ELSE cluster END, CASE WHEN opens THEN end_sec ELSE greatest(reach, end_sec) END, list_concat(list_append(ends[1:spot - 1], end_sec), ends[spot + 1:])
 FROM (SELECT *, coalesce(list_position(list_transform(ends, lambda e: e <= start_sec), true), len(ends) + 1)::INT AS spot FROM (SELECT t.*, s.cluster, s.reach, t.start_sec >= s.reach AS opens, CASE WHEN t.start_sec >= s.reach THEN [] ELSE s.ends END AS ends FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1)))"""


@query("WITH RECURSIVE " + ", ".join((FAILURES, _TIMED, _LAID)) + " SELECT user_id, event_id, start_sec, end_sec, lane::BIGINT AS lane, max(lane + 1) OVER (PARTITION BY user_id, cluster)::BIGINT AS width FROM s")
def lane_pack(spark, sf):
    f = failures(spark, sf)
    start = F.unix_seconds("ts")
    return folds.lanes(f.select("user_id", "event_id", start.alias("start_sec"), (start + F.greatest(F.lit(60), F.round(F.col("value") * 60).cast("long"))).alias("end_sec")), "user_id", "event_id", "start_sec", "end_sec")


_SECONDS = "t AS (SELECT user_id, event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000), event_id) AS i FROM failures)"
_COOLED = "s AS (SELECT user_id, event_id, sec, i, true AS emitted, sec AS said FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.event_id, t.sec, t.i, t.sec - s.said >= 21600, CASE WHEN t.sec - s.said >= 21600 THEN t.sec ELSE s.said END FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1)"


@query("WITH RECURSIVE " + ", ".join((FAILURES, _SECONDS, _COOLED)) + " SELECT user_id, event_id, sec, emitted FROM s")
def cooldown(spark, sf):
    return folds.cooled_down(failures(spark, sf).withColumn("sec", F.unix_seconds("ts")), "user_id", "event_id", "sec", 6 * 3600)


_BOUND = "able AS (SELECT contact_id FROM contacts WHERE NOT is_owner AND json_extract(attributes, '$.consent_voice')::VARCHAR = '\"true\"' AND contact_id IN (SELECT contact_id FROM calls GROUP BY 1 HAVING count(*) >= 2))"


@query(sql("SELECT call_id, speaker_tag, coalesce(contact_id, CASE WHEN sure THEN suggestion_contact_id END) AS contact_id, confirmed OR sure AS confirmed, sure AS auto_bound FROM (SELECT *, contact_id IS NULL AND NOT confirmed AND suggestion_score >= 0.7 AND coalesce(suggestion_contact_id IN (SELECT contact_id FROM able), false) AS sure FROM speakers)", SPEAKERS, CONTACTS, CALLS, _BOUND))
def auto_bind(spark, sf):
    c = contacts(spark, sf).withColumn("consents", consent_given(F.col("attributes")))
    return dml.auto_bound(speakers(spark, sf), c, calls(spark, sf), 0.7).select("call_id", "speaker_tag", "contact_id", "confirmed", "auto_bound")


@query(sql("SELECT call_id, title, status FROM calls WHERE call_id % 4 <> 0 UNION ALL SELECT call_id, upper(title), 'ready' FROM calls WHERE call_id % 4 = 0 UNION ALL SELECT -call_id, title, status FROM calls WHERE call_id % 4 = 0", CALLS))
def upsert(spark, sf):
    c = calls(spark, sf).select("call_id", "title", "status")
    quarter = c.where("call_id % 4 = 0")
    new = quarter.select("call_id", F.upper("title").alias("title"), F.lit("ready").alias("status")).unionByName(quarter.withColumn("call_id", -F.col("call_id")))
    return dml.upserted(c, new, ["call_id"])


@query(sql("SELECT call_id, speaker_tag FROM speakers WHERE call_id % 10 <> 0 UNION ALL SELECT DISTINCT call_id, 'owner' FROM speakers WHERE call_id % 10 = 0", SPEAKERS))
def replace_by_key(spark, sf):
    s = speakers(spark, sf).select("call_id", "speaker_tag")
    return dml.replaced(s, s.where("call_id % 10 = 0").select("call_id").distinct().withColumn("speaker_tag", F.lit("owner")), "call_id")


@query(sql("SELECT call_id, CASE WHEN status = 'processing' AND duration_sec < 50000 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' AND duration_sec < 50000 THEN 'interrupted' ELSE failed_reason END AS failed_reason FROM calls", CALLS))
def stale_sweep(spark, sf):
    stale = (F.col("status") == "processing") & (F.col("duration_sec") < 50000)
    return dml.updated(calls(spark, sf).withColumn("stale", stale), F.col("stale"), status=F.lit("failed"), failed_reason=F.lit("interrupted")).select("call_id", "status", "failed_reason")


@query(sql("SELECT call_id, speaker_tag FROM speakers WHERE call_id NOT IN (SELECT call_id FROM calls WHERE status = 'failed')", SPEAKERS, CALLS))
def cascade_delete(spark, sf):
    return dml.deleted(speakers(spark, sf), calls(spark, sf).where("status = 'failed'"), "call_id").select("call_id", "speaker_tag")


@query(sql("SELECT kind, n FROM (SELECT 'meta' AS kind, call_id AS id FROM calls UNION ALL SELECT 'transcript', conv_id FROM turns UNION ALL SELECT 'recap', passage_id FROM passages) GROUP BY kind", CALLS, TURNS, PASSAGES).replace("SELECT kind, n FROM", "SELECT kind, count(*) AS n FROM"))
def union_of_kinds(spark, sf):
    parts = [calls(spark, sf).select(F.lit("meta").alias("kind")), turns(spark, sf).select(F.lit("transcript").alias("kind")), passages(spark, sf).select(F.lit("recap").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
