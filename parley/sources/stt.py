"""Output of speech recognisers: JSON documents into rows of segments, and transcripts in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

STT = "result struct<language string>, transcription array<struct<text string, offsets struct<`from` long, `to` long>, tokens array<struct<text string, p double>>>>"

#: What recognisers write for silence, noise and credits (whole texts, then parts of texts), and what they
#: write for silence though people say it too; stems that mark a bracketed tag as noise.
ARTIFACTS = ("thanks for watching", "[blank_audio]", "(silence)", "[music]", "(music)", "[applause]", "[foreign]", "[音楽]", "[bgm]", "[♪音楽♪]", "[музыка]", "[аплодисменты]", "[смех]", "[шум]", "[тишина]")
CREDITS = ("редактор субтитров", "корректор субтитров", "субтитры подготовил", "субтитры:", "[апалькова", "[александрова", "н.александрова", "а.семкин", "subtitles by", "transcribed by", "продолжение следует")
FILLERS = ("you", "thank you", "thanks", "bye", "goodbye")
NOISE = ("музык", "music", "musique", "musik", "muzyk", "applause", "аплодис", "смех", "laughter", "шум", "noise", "silence", "тишина")
_MARKERS = "-–—•*"


def unmarked(text: Column) -> Column:
    """Trimmed text without the dialogue marks before it."""
    return F.trim(F.regexp_replace(F.trim(text), rf"^[{_MARKERS}]+", ""))


def is_artifact(text: Column) -> Column:
    """What nobody says: nothing, a known tag or credit, a bracketed `foreign`, or a bracket of over 20 characters."""
    own = unmarked(text)
    low = F.lower(own)
    credit = F.lit(False)
    for part in CREDITS:
        credit = credit | low.contains(part)
    foreign = (F.regexp_replace(low, r"[^\p{L}\p{N}]+", "") == "foreign") & own.contains("[")
    return (own == "") | low.isin(*ARTIFACTS) | credit | foreign | (own.startswith("[") & own.endswith("]") & (F.char_length(own) > 20))


def is_filler(text: Column) -> Column:
    """One of FILLERS, whatever marks stand around it."""
    return F.lower(F.trim(F.regexp_replace(unmarked(text), r"^[\p{Punct}…]+|[\p{Punct}…]+$", ""))).isin(*FILLERS)


def is_hallucination(text: Column, confidence: Column) -> Column:
    """An artifact, or a filler of a known confidence under 0.3; fillers of unknown confidence stay."""
    return is_artifact(text) | (is_filler(text) & F.coalesce(confidence < 0.30, F.lit(False)))


def mean_probability(tokens: Column) -> Column:
    """Over finite probabilities of tokens that aren't special ([_...]); null without any."""
    kept = F.filter(tokens, lambda t: t["p"].isNotNull() & ~F.isnan(t["p"]) & ~F.coalesce(t["text"].rlike(r"^\[_.*\]$"), F.lit(False)))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, t: s + t["p"]) / F.size(kept))


def segments(documents: DataFrame, key: str, json: str) -> DataFrame:
    """key, idx, start_sec, end_sec, text, confidence, language, duration_sec of recogniser documents.

    Inverted, blank and hallucinated segments go; malformed documents give none. duration_sec is the end of the last
    segment that stays, in document order.
    """
    parsed = documents.select(key, F.from_json(json, STT, {"mode": "PERMISSIVE"}).alias("d"))
    rows = parsed.select(key, F.col("d.result.language").alias("language"), F.posexplode("d.transcription").alias("idx", "s"))
    rows = rows.select(key, "language", F.col("idx").cast("long").alias("idx"), (F.col("s.offsets.from") / 1000).alias("start_sec"), (F.col("s.offsets.to") / 1000).alias("end_sec"), F.trim("s.text").alias("text"), mean_probability(F.col("s.tokens")).alias("confidence"))
    kept = rows.where((F.col("start_sec") <= F.col("end_sec")) & ~is_hallucination(F.col("text"), F.col("confidence")))
    return kept.withColumn("duration_sec", F.max_by("end_sec", "idx").over(Window.partitionBy(key)))


HEADER = r"^\*\*(.+?)\*\* \[(\d+):([0-5]\d)\]:(.*)$"


def markdown_turns(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """key, turn, speaker, start_sec, text of transcripts: a header line `**tag** [m:ss]: text` begins a turn, the lines
    up to the next one belong to it. Lines before the first header are left out."""
    lines = documents.select(key, F.posexplode(F.split(markdown, "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(HEADER)
    numbered = lines.withColumn("turn", F.sum(head.cast("long")).over(order)).where("turn > 0")
    part = lambda i: F.regexp_extract("line", HEADER, i)
    body = F.when(head, part(4)).otherwise(F.col("line"))
    rows = numbered.select(key, "turn", "line_no", F.when(head, part(1)).alias("speaker"), F.when(head, part(2).try_cast("long") * 60 + part(3).try_cast("long")).alias("start_sec"), F.trim(body).alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda r: r["body"]), " ")
    return rows.groupBy(key, "turn").agg(F.max("speaker").alias("speaker"), F.max("start_sec").alias("start_sec"), F.trim(text).alias("text"))


SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speakerTag", T.StringType())])


def write_raw(turns: DataFrame, path: str) -> None:
    """A JSON artifact per call with its segments in order."""
    seg = F.struct(F.col("start_sec").cast("double").alias("start"), F.col("end_sec").cast("double").alias("end"), "text", F.col("speaker").alias("speakerTag"))
    turns.groupBy("conv_id").agg(F.lit(1).alias("version"), F.array_sort(F.collect_list(seg)).alias("merged")).write.option("compression", "gzip").json(path)
