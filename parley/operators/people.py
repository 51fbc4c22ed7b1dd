"""Contacts with their identifiers, participants, and the voice samples of confirmed speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def normal_identifiers(rows: DataFrame) -> DataFrame:
    """contact_id, kind, value, label of rows (and ord): trimmed, blank ones left out, the first of each kind and value."""
    clean = rows.select("contact_id", "ord", F.trim("kind").alias("kind"), F.trim("value").alias("value"), blank_to_null(F.col("label")).alias("label")).where("kind <> '' and value <> ''")
    first = F.row_number().over(Window.partitionBy("contact_id", "kind", "value").orderBy("ord"))
    return clean.withColumn("_n", first).where("_n = 1").select("contact_id", "kind", "value", "label")


def with_identifiers(contacts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """contacts with the list of their identifiers, by kind and value."""
    lists = identifiers.groupBy("contact_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "label"))).alias("identifiers"))
    none = F.array().cast("array<struct<kind:string,value:string,label:string>>")
    return contacts.join(lists, "contact_id", "left").withColumn("identifiers", F.coalesce("identifiers", none))


def synced(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The identifiers after contacts of `wanted` were saved: theirs become the wanted ones, others stay."""
    saved = wanted.select("contact_id").distinct()
    return stored.join(saved, "contact_id", "left_anti").unionByName(wanted)


def created(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """contacts and new ones with a name; blank optional fields become null and known ids change nothing."""
    optional = [c for c in contacts.columns if c not in ("contact_id", "display_name", "is_owner")]
    clean = new.where(F.trim("display_name") != "").withColumn("display_name", F.trim("display_name"))
    for c in optional:
        if dict(clean.dtypes)[c] == "string":
            clean = clean.withColumn(c, blank_to_null(F.col(c)))
    return contacts.unionByName(clean.join(contacts.select("contact_id"), "contact_id", "left_anti").select(contacts.columns))


def without_contacts(contacts: DataFrame, gone: DataFrame) -> DataFrame:
    """contacts without those of gone (contact_id); the owner stays."""
    doomed = gone.select("contact_id").distinct().withColumn("_gone", F.lit(True))
    return contacts.join(doomed, "contact_id", "left").where("is_owner or _gone is null").drop("_gone")


def with_owner(contacts: DataFrame, owner: DataFrame) -> DataFrame:
    """contacts, and the given owner if there is none yet."""
    has = contacts.where("is_owner").select(F.lit(True).alias("_has")).limit(1)
    return contacts.unionByName(owner.join(F.broadcast(has), F.lit(True), "left_anti").select(contacts.columns))


def confirmed(speakers: DataFrame, commands: DataFrame, contacts: DataFrame, samples: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(speakers, samples) after commands (call_id, speaker_tag, contact_id, at), the last one per speaker.

    A confirmed speaker is bound, its suggestion goes; its cluster vector becomes a sample of the contact if that consents,
    and each contact keeps its `most` latest samples.
    """
    last = commands.groupBy("call_id", "speaker_tag").agg(F.max_by(F.struct("contact_id", "at"), F.struct("at", "contact_id")).alias("c"))
    joined = speakers.join(last, ["call_id", "speaker_tag"], "left")
    told = F.col("c").isNotNull()
    bound = joined.withColumn("contact_id", F.coalesce("c.contact_id", "contact_id")).withColumn("confirmed", F.col("confirmed") | told)
    bound = bound.withColumn("suggestion_contact_id", F.when(~told, F.col("suggestion_contact_id")))
    agree = contacts.where("consents").select("contact_id")
    new = joined.where(told & F.col("cluster").isNotNull()).select(F.col("c.contact_id").alias("contact_id"), F.col("call_id").alias("source_call"), F.col("c.at").alias("at"), "cluster").join(agree, "contact_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy(F.desc("at"), F.desc("source_call")))
    kept = samples.unionByName(new.select(samples.columns)).withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    return bound.drop("c"), kept


def participants(speakers: DataFrame, contacts: DataFrame) -> DataFrame:
    """call_id, known (lines of the distinct confirmed contacts, in order of appearance, and a note if others remain),
    names (map from tag to display name of the confirmed); known is null without confirmed ones."""
    # Only confirmed rows of a contact are joined: the others share a null contact and would meet in one task.
    may = F.coalesce(F.col("confirmed") & F.col("contact_id").isNotNull(), F.lit(False))
    slim = speakers.select("call_id", "speaker_tag", "contact_id", F.col("confirmed"))
    none = F.lit(None).cast("string")
    rows = slim.where(may).join(contacts.select("contact_id", "display_name", "org"), "contact_id", "left").unionByName(slim.where(~may).withColumns({"display_name": none, "org": none}))
    sure = F.col("confirmed") & F.col("display_name").isNotNull()
    person = F.struct("speaker_tag", "contact_id", F.concat(F.lit("- "), "display_name", F.coalesce(F.concat(F.lit(" ("), "org", F.lit(")")), F.lit(""))).alias("line"))
    found = rows.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.when(sure, person))).alias("people"),
        F.max(~sure).alias("others"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(sure, F.struct("speaker_tag", "display_name"))))).alias("names"),
    )
    first = F.filter("people", lambda p, i: ~F.exists(F.slice("people", F.lit(1), i), lambda q: q["contact_id"] == p["contact_id"]))
    lines = F.transform(first, lambda p: p["line"])
    note = F.when(F.col("others"), F.array(F.lit("Everyone else is named by tag."))).otherwise(F.array().cast("array<string>"))
    return found.select("call_id", F.when(F.size("people") > 0, F.array_join(F.concat(lines, note), "\n")).alias("known"), "names")


def renamed_headers(markdown: Column, names: Column) -> Column:
    """A transcript whose header lines `**tag** [m:ss]: ...` have the display name in place of a known tag."""

    def line(x):
        tag = F.regexp_extract(x, r"^\*\*(.*?)\*\* \[.*\]:", 1)
        known = F.when(tag != "", F.try_element_at(names, tag))
        return F.when(known.isNotNull(), F.concat(F.lit("**"), known, F.lit("**"), F.substring(x, F.char_length(tag) + 5, F.char_length(x)))).otherwise(x)

    return F.array_join(F.transform(F.split(markdown, "\n"), line), "\n")


def suggested(speakers: DataFrame, hints: DataFrame, contacts: DataFrame) -> DataFrame:
    """speakers with suggestions of hints (call_id, speaker_tag, hint_id, hint_score): unknown contacts are dropped, scores
    held to 0..1, and bound speakers keep what they have."""
    known = hints.join(contacts.select(F.col("contact_id").alias("hint_id")), "hint_id", "left_semi")
    best = known.groupBy("call_id", "speaker_tag").agg(F.max_by("hint_id", F.struct("hint_score", -F.col("hint_id"))).alias("hint_id"), F.max("hint_score").alias("hint_score"))
    joined = speakers.join(best, ["call_id", "speaker_tag"], "left")
    free = F.col("contact_id").isNull() & F.col("hint_id").isNotNull()
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("hint_score")))
    return joined.withColumn("suggestion_contact_id", F.when(free, F.col("hint_id")).otherwise(F.col("suggestion_contact_id"))).withColumn("suggestion_score", F.when(free, score).otherwise(F.col("suggestion_score"))).drop("hint_id", "hint_score")
