"""Chunked recordings in one timeline, cutoffs, and languages of calls. Voices are the given vectors, ten to a call."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stitching as S
from ..sources import stt
from ..sources.tables import TURNS, sql, table, turns
from .base import query

# Vector n is a voice of call n / 10, chunk n % 5; each chunk has two.
_VOICES = """v AS (SELECT vec_id // 10 AS call_id, vec_id % 5 AS chunk_idx, CASE WHEN vec_id % 10 < 5 THEN CASE WHEN vec_id % 7 = 0 THEN 'owner' ELSE 'speaker:0' END ELSE CASE WHEN vec_id % 11 = 0 THEN 'speaker:unknown' ELSE 'speaker:1' END END AS tag, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
 p AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY chunk_idx, tag) AS n, tag NOT IN ('owner', 'speaker:unknown') AS fit FROM v)"""
_CLUSTERS = """reach AS (SELECT call_id, n AS node, n AS root FROM p WHERE fit UNION SELECT r.call_id, r.node, b.n FROM reach r JOIN p a ON a.call_id = r.call_id AND a.n = r.root JOIN p b ON b.call_id = a.call_id AND b.fit AND list_dot_product(a.vec, b.vec) >= 0.6 * sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))),
 roots AS (SELECT call_id, node, min(root) AS root FROM reach GROUP BY ALL), named AS (SELECT p.call_id, p.chunk_idx, p.tag, coalesce('speaker:' || (dense_rank() OVER (PARTITION BY p.call_id, root IS NULL ORDER BY root) - 1)::VARCHAR, p.tag) AS global_tag, root FROM p LEFT JOIN roots r ON r.call_id = p.call_id AND r.node = p.n),
 tags AS (SELECT call_id, chunk_idx, tag, CASE WHEN root IS NULL THEN tag ELSE global_tag END AS global_tag FROM named)"""
_CUT = "cut AS (SELECT call_id, chunk_idx, tag, CASE WHEN call_id % 2 = 0 THEN 33.5 END AS cutoff, CASE WHEN call_id % 9 = 8 AND chunk_idx = 0 THEN -1 ELSE chunk_idx * 10.0 END AS moved, chunk_idx <> 2 OR call_id % 3 <> 0 AS done FROM v)"
_LINE = "line AS (SELECT cut.call_id, cut.chunk_idx, global_tag AS speaker_tag, moved + s AS start_sec, least(moved + s + 5.0, coalesce(cutoff, 1e9)) AS end_sec FROM cut JOIN tags USING (call_id, chunk_idx, tag), (VALUES (0.0), (4.0)) g(s) WHERE done AND moved >= 0 AND moved < coalesce(cutoff, 1e9) AND moved + s < coalesce(cutoff, 1e9))"


def _voices(spark, sf):
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    tag = F.when(i % 10 < 5, F.when(i % 7 == 0, "owner").otherwise("speaker:0")).otherwise(F.when(i % 11 == 0, "speaker:unknown").otherwise("speaker:1"))
    return e.select(F.floor(i / 10).cast("long").alias("call_id"), (i % 5).alias("chunk_idx"), tag.alias("tag"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("WITH RECURSIVE " + ", ".join((_VOICES, _CLUSTERS)) + " SELECT call_id, chunk_idx, tag, global_tag FROM tags")
def speakers_across_chunks(spark, sf):
    """Voices of a call's chunks as speakers of the call."""
    return S.global_tags(_voices(spark, sf), 0.6)


def _line(spark, sf):
    v, c, k = _voices(spark, sf), F.col("call_id"), F.col("chunk_idx")
    chunks = v.select("call_id", "chunk_idx").distinct().select("call_id", "chunk_idx", F.when((k == 2) & (c % 3 == 0), "failed").otherwise("done").alias("status"), F.when((c % 9 == 8) & (k == 0), -1).otherwise(k * 10_000).alias("start_ms"), F.when(c % 2 == 0, 33_500).alias("cutoff_ms"))
    said = v.select("call_id", "chunk_idx", "tag", F.explode(F.array(F.lit(0.0), F.lit(4.0))).alias("start_sec")).withColumn("end_sec", F.col("start_sec") + 5)
    return S.stitched(said, chunks, S.global_tags(v, 0.6))


@query("WITH RECURSIVE " + ", ".join((_VOICES, _CLUSTERS, _CUT, _LINE)) + " SELECT call_id, chunk_idx, speaker_tag, start_sec::DOUBLE AS start_sec, end_sec::DOUBLE AS end_sec FROM line")
def chunks_stitched(spark, sf):
    """Segments of finished chunks on the call's timeline, under the call's speakers, up to the cutoff."""
    return _line(spark, sf)


@query("WITH RECURSIVE " + ", ".join((_VOICES, _CLUSTERS, _CUT, _LINE)) + " SELECT call_id, CASE WHEN speaker_tag = who THEN 'owner' ELSE speaker_tag END AS speaker_tag, count(*) AS n, max(end_sec)::DOUBLE AS duration FROM (SELECT *, arg_min(speaker_tag, (start_sec, speaker_tag)) OVER (PARTITION BY call_id) AS who FROM line) GROUP BY ALL")
def owners_relabelled(spark, sf):
    """The first voice of each call taken as its owner."""
    line = _line(spark, sf)
    owners = line.groupBy("call_id").agg(F.min_by("speaker_tag", F.struct("start_sec", "speaker_tag")).alias("owner_tag"))
    return S.relabelled(line, owners).groupBy("call_id", "speaker_tag").agg(F.count(F.lit(1)).alias("n"), F.max("end_sec").alias("duration"))


@query(sql("SELECT conv_id, turn, start_sec::DOUBLE AS start_sec, least(end_sec, coalesce(cut, end_sec))::DOUBLE AS end_sec, least(600.0, coalesce(cut, 600.0))::DOUBLE AS duration FROM (SELECT *, CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 * 12.5 END AS cut FROM turns) WHERE cut IS NULL OR start_sec < cut", TURNS))
def segments_clipped(spark, sf):
    """Segments up to a cutoff, and durations held to it."""
    cut = F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 3 * 12_500) / 1000
    rows = S.clipped(turns(spark, sf).withColumn("cut", cut), "cut")
    return rows.select("conv_id", "turn", F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"), S.clamped_duration(F.lit(600.0), F.col("cut")).alias("duration"))


_HEARD = """h AS (SELECT conv_id, turn, speaker, CASE turn % 7 WHEN 0 THEN '- [FOREIGN]' WHEN 1 THEN 'Thanks.' WHEN 2 THEN 'you' WHEN 3 THEN 'Subtitles by ' || speaker WHEN 4 THEN '[' || repeat('x', 19) || ']' WHEN 5 THEN '•' ELSE text END AS said, CASE turn % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.9 END AS confidence, turn % 7 AS k FROM turns)"""


def _heard(spark, sf):
    k, t = F.col("turn") % 7, turns(spark, sf)
    said = F.when(k == 0, "- [FOREIGN]").when(k == 1, "Thanks.").when(k == 2, "you").when(k == 3, F.concat(F.lit("Subtitles by "), "speaker")).when(k == 4, "[" + "x" * 19 + "]").when(k == 5, "•").otherwise(F.col("text"))
    return t.select("conv_id", "turn", "speaker", "text", said.alias("said"), F.when(F.col("turn") % 3 == 0, 0.1).when(F.col("turn") % 3 == 1, 0.9).alias("confidence"))


@query(sql("SELECT conv_id, turn, k IN (0, 3, 4, 5) OR trim(said) = '' AS artifact, k IN (1, 2) AS filler, k IN (0, 3, 4, 5) OR trim(said) = '' OR (k IN (1, 2) AND coalesce(confidence < 0.3, false)) AS hallucination FROM h", TURNS, _HEARD))
def hallucinations_found(spark, sf):
    """What a recogniser made up: tags, credits and brackets, and fillers of a low confidence."""
    t, p = F.col("said"), F.col("confidence")
    return _heard(spark, sf).select("conv_id", "turn", stt.is_artifact(t).alias("artifact"), stt.is_filler(t).alias("filler"), stt.is_hallucination(t, p).alias("hallucination"))


_SPOKEN = "w AS (SELECT conv_id, speaker, sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END) AS n FROM turns WHERE turn % 7 = 6 GROUP BY ALL UNION ALL SELECT conv_id, speaker, sum(len(string_split_regex(trim(said), '\\s+'))) FROM h WHERE k IN (1, 2) AND coalesce(confidence, 1) >= 0.3 GROUP BY ALL)"
_VOTES = "s AS (SELECT conv_id, coalesce(sum(n) FILTER (speaker = 'user'), 0) AS mic, coalesce(sum(n) FILTER (speaker <> 'user'), 0) AS other FROM w GROUP BY conv_id)"


@query(sql("SELECT conv_id, mic::BIGINT AS mic, other::BIGINT AS other, CASE WHEN other >= 8 THEN 'other' WHEN mic >= 8 THEN 'mic' END AS heard_from FROM s WHERE mic + other > 0", TURNS, _HEARD, _SPOKEN, _VOTES))
def real_words(spark, sf):
    """Words that were really said on either side, and the side that gives the call its language: the others from eight
    words on, else the owner from eight words on."""
    rows = _heard(spark, sf).where(~stt.is_hallucination(F.col("said"), F.col("confidence")))
    n = F.size(F.filter(F.split("said", r"\s+"), lambda w: w != "")).cast("long")
    own = F.col("speaker") == "user"
    sides = rows.groupBy("conv_id").agg(F.sum(F.when(own, n).otherwise(0)).alias("mic"), F.sum(F.when(~own, n).otherwise(0)).alias("other")).where("mic + other > 0")
    return sides.withColumn("heard_from", F.when(F.col("other") >= 8, "other").when(F.col("mic") >= 8, "mic"))
