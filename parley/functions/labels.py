"""Labels, names and states of calls and speakers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.stt import NOISE


def speaker_label(tag: Column) -> Column:
    """Owner, Unknown, Speaker N+1 for speaker:N, or the tag itself."""
    n = F.regexp_extract(tag, r"^speaker:(\d+)$", 1).try_cast("int")
    return F.when(tag == "owner", "Owner").when(tag == "speaker:unknown", "Unknown").when(n.isNotNull(), F.concat(F.lit("Speaker "), (n + 1).cast("string"))).otherwise(tag)


def short_speaker_label(tag: Column) -> Column:
    n = F.regexp_extract(tag, r"^speaker:(\d+)$", 1).try_cast("int")
    return F.when(tag == "owner", "O").when(n.isNotNull(), F.concat(F.lit("S"), (n + 1).cast("string"))).otherwise("?")


def capped_speaker(tag: Column, most: int = 10) -> Column:
    """speaker:N of the tenth and later speakers is unknown."""
    n = F.regexp_extract(tag, r"^speaker:(\d+)$", 1).try_cast("int")
    return F.when(n >= most, "speaker:unknown").otherwise(tag)


def is_placeholder(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin("", "unknown", "null", "none", "n/a", "speaker"), F.lit(True))


def without_noise_tags(text: Column) -> Column:
    """Leading [...] tags of at most 40 characters inside that name a noise are taken off, one after another."""
    tag = rf"\s*\[(?=[^\]]{{0,40}}\])(?iu:[^\]]*(?:{'|'.join(NOISE)})[^\]]*)\]"
    return F.regexp_replace(F.regexp_replace(text, f"^(?:{tag})+", ""), r"^\s+|\s+$", "")


def unrepeated(text: Column) -> Column:
    """A text that is one phrase three times or more (and six words at least) becomes the phrase, its words parted by one
    blank; the shortest phrase counts, and any white space parts words. Other texts are trimmed only."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")

    def phrase(ws: Column) -> Column:
        # A text has the period p if it equals itself p words on; only divisors of its length come into question.
        n = F.size(ws)
        tried = F.when(n >= 6, F.sequence(F.lit(1), F.floor(n / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
        fits = F.filter(tried, lambda p: (n % p == 0) & (F.slice(ws, F.lit(1), n - p) == F.slice(ws, p + 1, n - p)))
        return F.when(F.size(fits) > 0, F.array_join(F.slice(ws, F.lit(1), fits[0]), " "))

    return F.coalesce(F.transform(F.array(F.split(trimmed, r"\s+")), phrase)[0], trimmed)


def folded(text: Column) -> Column:
    """Lower case, ё as е."""
    return F.translate(F.lower(text), "ё", "е")


def fuzzy_score(text: Column, query: str) -> Column:
    """Each query character in order: 1 and the streak so far (its own hit counted) each, 8 more at a word's start, less
    0.05 per character of the text; null if they don't all occur, 0 for an empty query."""
    wanted = query.lower().replace("ё", "е")
    if not wanted:
        return F.lit(0.0)
    low = folded(text)
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("streak"), F.lit(0.0).alias("score"), F.lit(" ").alias("last")),
        lambda s, c: F.when(
            c == F.substring(F.lit(wanted + "\0"), s["at"] + 1, F.lit(1)),
            F.struct((s["at"] + 1).alias("at"), (s["streak"] + 1).alias("streak"), (s["score"] + 2 + s["streak"] + F.when(s["last"].rlike(r"[\p{L}\p{N}]"), 0.0).otherwise(8.0)).alias("score"), c.alias("last")),
        ).otherwise(F.struct(s["at"].alias("at"), F.lit(0).alias("streak"), s["score"].alias("score"), c.alias("last"))),
    )
    return F.when(state["at"] == len(wanted), F.round(state["score"] - 0.05 * F.char_length(low), 4))


def fuzzy_filter(rows, query: str, text: str, order: str):
    """The rows that fit a query, with score, best first and then in their order; an empty query lets all pass."""
    scored = rows.withColumn("score", fuzzy_score(F.col(text), query)).where("score is not null")
    return scored.orderBy(F.desc("score"), order) if query else scored.orderBy(order)


def processing_via(engine: Column, provider: Column, path: Column) -> Column:
    """local for a local engine or provider, cloud_byo for own keys, cloud_managed for another provider, else null."""
    p = F.coalesce(provider, F.lit(""))
    return F.when(F.coalesce(engine, F.lit("")).startswith("local") | (p == "local"), "local").when(path == "byo", "cloud_byo").when(p != "", "cloud_managed")
