"""Contacts, identifiers, participants and voice samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people as P
from ..operators.relational import consent_given
from ..operators.graph import numbered
from ..sources.tables import CALLS, CONTACTS, SPEAKERS, VECTORS, calls, contacts, speakers, sql, vectors
from .base import query

_RAW = """raw AS (SELECT contact_id, ord, CASE ord WHEN 0 THEN 'email ' WHEN 1 THEN 'email' WHEN 2 THEN ' phone' ELSE 'phone' END AS kind,
 CASE ord WHEN 0 THEN ' c' || contact_id || '@x ' WHEN 1 THEN 'c' || contact_id || '@x' WHEN 2 THEN CASE WHEN contact_id % 3 = 0 THEN '  ' ELSE '+' || contact_id END ELSE '+' || (contact_id + 1) END AS value, CASE ord WHEN 1 THEN 'work' WHEN 2 THEN ' ' ELSE org END AS label FROM contacts, generate_series(0, 3) g(ord))"""
_IDS = "ids AS (SELECT contact_id, trim(kind) AS kind, trim(value) AS value, nullif(trim(arg_min(label, ord)), '') AS label FROM raw WHERE trim(value) <> '' GROUP BY ALL)"


def _raw(spark, sf):
    c, i = F.col("contact_id"), F.col("contact_id").cast("string")
    one = lambda n, kind, value, label: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), value.alias("value"), label.alias("label"))
    rows = F.array(
        one(0, "email ", F.concat(F.lit(" c"), i, F.lit("@x ")), F.col("org")), one(1, "email", F.concat(F.lit("c"), i, F.lit("@x")), F.lit("work")),
        one(2, " phone", F.when(c % 3 == 0, "  ").otherwise(F.concat(F.lit("+"), i)), F.lit(" ")), one(3, "phone", F.concat(F.lit("+"), (c + 1).cast("string")), F.col("org")),
    )
    return contacts(spark, sf).select("contact_id", F.inline(rows))


@query(sql("SELECT * FROM ids", CONTACTS, _RAW, _IDS))
def identifiers_normalised(spark, sf):
    return P.normal_identifiers(_raw(spark, sf))


@query(sql("SELECT c.contact_id, display_name, count(kind) AS n, coalesce(string_agg(kind || ':' || value, ',' ORDER BY kind, value), '') AS identifiers FROM contacts c LEFT JOIN (SELECT * FROM ids WHERE contact_id % 2 = 0) i USING (contact_id) GROUP BY ALL", CONTACTS, _RAW, _IDS))
def contacts_with_identifiers(spark, sf):
    got = P.with_identifiers(contacts(spark, sf), P.normal_identifiers(_raw(spark, sf)).where("contact_id % 2 = 0"))
    told = F.array_join(F.transform("identifiers", lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), ",")
    return got.select("contact_id", "display_name", F.size("identifiers").cast("long").alias("n"), told.alias("identifiers"))


@query(sql("SELECT contact_id, kind, value FROM ids WHERE contact_id % 4 <> 0 UNION ALL SELECT contact_id, 'phone', '+00' FROM contacts WHERE contact_id % 4 = 0", CONTACTS, _RAW, _IDS))
def identifiers_synced(spark, sf):
    """Saving a contact replaces its identifiers."""
    new = contacts(spark, sf).where("contact_id % 4 = 0").select("contact_id", F.lit("phone").alias("kind"), F.lit("+00").alias("value"), F.lit(None).cast("string").alias("label"))
    return P.synced(P.normal_identifiers(_raw(spark, sf)), new).select("contact_id", "kind", "value")


@query(sql("SELECT contact_id, display_name, org FROM contacts UNION ALL SELECT -contact_id, 'New', nullif(trim(CASE WHEN contact_id % 2 = 0 THEN ' ' ELSE org END), '') FROM contacts WHERE contact_id % 10 IN (1, 2)", CONTACTS))
def contacts_created(spark, sf):
    """New contacts join, blank fields become null; nameless and known ones change nothing."""
    c = contacts(spark, sf)
    new = c.where("contact_id % 10 < 4").select(F.when(F.col("contact_id") % 10 == 3, F.col("contact_id")).otherwise(-F.col("contact_id")).alias("contact_id"), F.when(F.col("contact_id") % 10 == 0, "  ").otherwise(" New ").alias("display_name"), F.lit(False).alias("is_owner"), F.when(F.col("contact_id") % 2 == 0, " ").otherwise(F.col("org")).alias("org"), "nation_id", "attributes")
    return P.created(c, new).select("contact_id", "display_name", "org")


@query(sql("SELECT contact_id, is_owner FROM contacts WHERE contact_id % 7 <> 1 OR is_owner", CONTACTS))
def contacts_deleted(spark, sf):
    """Deletes contacts, the owner among them, who stays."""
    c = contacts(spark, sf)
    return P.without_contacts(c, c.where("contact_id % 7 = 1")).select("contact_id", "is_owner")


@query(sql("SELECT contact_id, display_name FROM contacts WHERE NOT is_owner UNION ALL SELECT -1, 'Me'", CONTACTS))
def owner_ensured(spark, sf):
    """Without an owner the given one is added; with one nothing changes."""
    c = contacts(spark, sf)
    owner = c.where("is_owner").withColumn("contact_id", F.lit(-1).cast(c.schema["contact_id"].dataType)).withColumn("display_name", F.lit("Me"))
    return P.with_owner(P.with_owner(c.where("not is_owner"), owner), owner.withColumn("display_name", F.lit("Other"))).select("contact_id", "display_name")


@query(sql("SELECT contact_id, display_name, org, row_number() OVER (ORDER BY is_owner DESC, display_name, contact_id) AS place, NOT is_owner AS hinted FROM contacts", CONTACTS))
def contact_briefs(spark, sf):
    """Contacts in the order of lists (owner first, then by name), with whether they are hinted to a model."""
    placed = numbered(contacts(spark, sf).select("contact_id", "display_name", "org", "is_owner"), [F.desc("is_owner"), "display_name", "contact_id"], "place")
    return placed.select("contact_id", "display_name", "org", "place", (~F.col("is_owner")).alias("hinted"))


_VOICED = "s AS (SELECT *, call_id % 1000 AS at, CASE WHEN call_id % 3 <> 0 THEN call_id END AS cluster FROM speakers WHERE speaker_tag = 'speaker:1'), one AS (SELECT call_id, any_value(s) AS s FROM s GROUP BY call_id HAVING count(*) = 1)"
_TOLD = "told AS (SELECT s.call_id, s.suggestion_contact_id AS contact_id, s.at, s.cluster FROM one WHERE s.suggestion_contact_id IS NOT NULL AND s.call_id % 2 = 0)"


def _voiced(spark, sf):
    s = speakers(spark, sf).where("speaker_tag = 'speaker:1'").withColumn("at", F.col("call_id") % 1000).withColumn("cluster", F.when(F.col("call_id") % 3 != 0, F.col("call_id")))
    single = s.groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("call_id")
    return s.join(single, "call_id", "left_semi")


def _confirmed(spark, sf):
    s = _voiced(spark, sf)
    commands = s.where("suggestion_contact_id is not null and call_id % 2 = 0").select("call_id", "speaker_tag", F.col("suggestion_contact_id").alias("contact_id"), "at")
    older = commands.withColumn("at", F.col("at") - 1).withColumn("contact_id", F.lit(-5).cast("long"))
    people = contacts(spark, sf).withColumn("consents", consent_given(F.col("attributes")))
    samples = s.select("contact_id", F.col("call_id").alias("source_call"), "at", "cluster").where("contact_id is not null and call_id % 5 = 0")
    return P.confirmed(s.drop("at"), commands.unionByName(older), people, samples)


@query(sql("SELECT s.call_id, coalesce(told.contact_id, s.contact_id) AS contact_id, s.confirmed OR told.call_id IS NOT NULL AS confirmed, CASE WHEN told.call_id IS NULL THEN s.suggestion_contact_id END AS suggestion_contact_id FROM one LEFT JOIN told ON told.call_id = s.call_id", SPEAKERS, _VOICED, _TOLD))
def speakers_confirmed(spark, sf):
    """The last confirmation of each speaker binds it and takes its suggestion."""
    return _confirmed(spark, sf)[0].select("call_id", "contact_id", "confirmed", "suggestion_contact_id")


@query(sql("SELECT contact_id, source_call FROM (SELECT contact_id, call_id AS source_call, told.at FROM told JOIN (SELECT contact_id FROM contacts WHERE json_extract(attributes, '$.consent_voice')::VARCHAR = '\"true\"') USING (contact_id) WHERE cluster IS NOT NULL UNION ALL SELECT s.contact_id, s.call_id, s.at FROM one WHERE s.contact_id IS NOT NULL AND s.call_id % 5 = 0) x QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY x.at DESC, source_call DESC) <= 5", CONTACTS, SPEAKERS, _VOICED, _TOLD))
def samples_retained(spark, sf):
    """Confirmed voices of consenting contacts become samples; each contact keeps its five latest."""
    return _confirmed(spark, sf)[1].select("contact_id", "source_call")


_KNOWN = "k AS (SELECT s.call_id, speaker_tag, s.contact_id, display_name, org, confirmed AND display_name IS NOT NULL AS sure FROM speakers s LEFT JOIN contacts USING (contact_id))"
_FIRSTS = "f AS (SELECT call_id, contact_id, min(speaker_tag) AS tag, any_value('- ' || display_name || ' (' || org || ')') AS line FROM k WHERE sure GROUP BY ALL), o AS (SELECT call_id, bool_or(NOT sure) AS others FROM k GROUP BY call_id)"


@query(sql("SELECT o.call_id, CASE WHEN count(f.line) > 0 THEN string_agg(f.line, chr(10) ORDER BY f.tag, f.contact_id) || CASE WHEN any_value(others) THEN chr(10) || 'Everyone else is named by tag.' ELSE '' END END AS known FROM o LEFT JOIN f USING (call_id) GROUP BY o.call_id", SPEAKERS, CONTACTS, _KNOWN, _FIRSTS))
def participants_block(spark, sf):
    """The distinct confirmed people of a call, and a note if others remain."""
    return P.participants(speakers(spark, sf).dropDuplicates(["call_id", "speaker_tag", "contact_id", "confirmed"]), contacts(spark, sf)).select("call_id", "known")


@query(sql("SELECT call_id, '**Ann** [0:05]: hi' || chr(10) || CASE WHEN call_id % 2 = 0 THEN '**Bob B** [1:00]: so' ELSE '**speaker:1** [1:00]: so' END || chr(10) || '**speaker:0** no header' || chr(10) || '**speaker:9** [2:00]: x' AS markdown FROM calls", CALLS))
def headers_renamed(spark, sf):
    """Tags in the heads of turns become the names of confirmed speakers; other lines stay."""
    text = F.lit("**speaker:0** [0:05]: hi\n**speaker:1** [1:00]: so\n**speaker:0** no header\n**speaker:9** [2:00]: x")
    names = F.when(F.col("call_id") % 2 == 0, F.create_map(F.lit("speaker:0"), F.lit("Ann"), F.lit("speaker:1"), F.lit("Bob B"))).otherwise(F.create_map(F.lit("speaker:0"), F.lit("Ann")))
    return calls(spark, sf).select("call_id", P.renamed_headers(text, names).alias("markdown"))


_HINTED = "h AS (SELECT call_id, speaker_tag, max(contact_id) AS hint_id, max(score) AS score FROM (SELECT call_id, speaker_tag, call_id % 2000 AS contact_id, call_id % 4 - 1.5 AS score FROM speakers WHERE call_id % 3 = 0) WHERE contact_id IN (SELECT contact_id FROM contacts) GROUP BY ALL)"


@query(sql("SELECT call_id, speaker_tag, CASE WHEN contact_id IS NULL AND hint_id IS NOT NULL THEN hint_id ELSE suggestion_contact_id END AS suggestion_contact_id, CASE WHEN contact_id IS NULL AND hint_id IS NOT NULL THEN least(1, greatest(0, score)) ELSE suggestion_score END::DOUBLE AS suggestion_score FROM speakers LEFT JOIN h USING (call_id, speaker_tag)", SPEAKERS, CONTACTS, _HINTED))
def hints_applied(spark, sf):
    """Hints of a model become suggestions where the contact is known and the speaker isn't bound."""
    s = speakers(spark, sf)
    hints = s.where("call_id % 3 = 0").select("call_id", "speaker_tag", (F.col("call_id") % 2000).alias("hint_id"), (F.col("call_id") % 4 - 1.5).alias("hint_score"))
    return P.suggested(s, hints, contacts(spark, sf)).select("call_id", "speaker_tag", "suggestion_contact_id", "suggestion_score")


@query(sql("SELECT vec_id, 4 * len(vec) AS bytes, len(vec) AS dim, true AS same, round(sqrt(list_sum(list_transform(vec, lambda x: (x / sqrt(list_dot_product(vec, vec))) * (x / sqrt(list_dot_product(vec, vec)))))), 4) AS norm FROM vectors", VECTORS))
def vector_codec(spark, sf):
    """Vectors as little-endian 32-bit bytes and back, their dimension from the bytes, and their normal form."""
    from ..functions import models as M
    from ..operators.search import dot

    v = vectors(spark, sf).select("vec_id", "vec", M.vector_bytes(F.col("vec")).alias("blob"))
    back = v.select("vec_id", "vec", "blob", M.bytes_vector(F.col("blob")).alias("back"), M.normalised(F.col("vec")).alias("unit"))
    same = F.forall(F.zip_with("vec", "back", lambda a, b: a.cast("float") == b), lambda x: x)
    return back.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), (F.octet_length("blob") / 4).cast("long").alias("dim"), same.alias("same"), F.round(F.sqrt(dot(F.col("unit"), F.col("unit"))), 4).alias("norm"))


@query(sql("SELECT vec_id, round(list_dot_product(m, m) / n2, 4) AS norm, round(m[1] / sqrt(n2), 4) AS first FROM (SELECT vec_id, m, list_dot_product(m, m) AS n2 FROM (SELECT vec_id, list_transform(list_zip(vec, list_reverse(vec)), lambda z: (z[1] + z[2]) / 2) AS m FROM vectors))", VECTORS))
def tokens_pooled(spark, sf):
    """Token vectors pooled where their mask is set: of three, the vector, its reverse and a masked one."""
    from ..functions import models as M
    from ..operators.search import dot

    v = F.col("vec")
    made = M.pooled(F.array(v, F.reverse(v), F.transform(v, lambda x: x * 100)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return vectors(spark, sf).select("vec_id", made.alias("p")).select("vec_id", F.round(dot(F.col("p"), F.col("p")), 4).alias("norm"), F.round(F.col("p")[0], 4).alias("first"))
