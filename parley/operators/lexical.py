"""A stored inverted index over passages, and BM25 for tables of questions served from it.

Postings stand in blocks of a word and a zone (passages of about one length), sorted by the first four characters of the
word: an exact term and all words behind a prefix term share these, so terms meet words by an equi-join, and a scan for
some terms skips what lies between. Zones spread the blocks of a frequent word over all files. A search gathers zones to
shelves of passages; each shelf merges the postings of its asked terms once, and then meets each deal of questions once, so
that a question costs additions over arrays and no rows between it and a zone. An index grows by generations: passages
added, and passages that are gone or replaced.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded_words
from .bitmaps import in_bitmap, row_bitmap
from .graph import removed, shared_folder, stored

K1, B = 1.2, 0.75
MOST_TERMS = 12
#: Characters of a word by which postings are sorted; no prefix term is shorter.
HEAD = 4
#: Passages of a zone, about, over all lengths, and how many such parts make the shelf that a task of a search has in memory.
ZONE_ROWS, FIRST_ZONES = 8192, 1
#: Passes of questions that meet a shelf in one task, about, and those that a task has as Python objects at once. The
#: shelves are sent once for each QUESTIONS.
QUESTIONS, ASKED_AT_ONCE = 262_144, 4_096
#: Terms that are broadcast, and heads that are pushed to the scan; with more of them a search goes by a bitmap of heads, and
#: the rest joins by shuffles.
FEW_TERMS, FEW_HEADS = 20_000, 2_000
#: Postings of a shelf that are merged at once, and scores that are held by their greatest to find the best.
MERGED_AT_ONCE, SCORES = 1 << 19, 128
#: Scopes of a shelf that are remembered.
SCOPES = 256
#: Decimals of a score: sums in another order don't change who is best.
DIGITS = 9
POSTINGS = ["head", "word", "zone", "n", "occurrences", "entries"]
SCHEMA = "head string, word string, zone int, n long, occurrences long, entries array<struct<passage_id:bigint,tf:bigint,dl:bigint,call_id:string,at:bigint>>"
#: Words that say nothing about what is asked, a list for each language. They decide what is found.
STOP_WORDS = {
    "ru": frozenset(
        """
        что чем чём кто кого как где когда почему зачем сколько какой какая какое какие по
        за на не ни но же ли бы из до от об под при для про
        это эти этот эта там тут был были было была есть будет мы вы он она
        они нам вам его нас вас их такой такая такое итог итоге итогу всё все или
        сегодня вчера позавчера назад неделю неделе недели неделя месяц месяца месяце году года год квартал квартала
        квартале прошлой прошлом прошлый прошлую прошлого
        """.split()
    ),
    "en": frozenset("the and for was what who when where how why did does about with from that this which have has are were our you they".split()),
}


# ---- terms ----------------------------------------------------------------------------------------------------------


def query_terms(question: Column, languages=("en", "ru")) -> Column:
    """An array of (term, prefix) of a question: its words of two characters on, no stop words unless all are (no list,
    no stop words), the first twelve. Words of six characters on become prefixes, so that endings don't matter; marks go
    as they do in the index. A word that is asked twice counts twice."""
    found = F.filter(folded_words(question), lambda w: F.char_length(w) >= 2)
    stop = sorted(set().union(*(STOP_WORDS[x] for x in languages)))
    kept = F.filter(found, lambda w: ~w.isin(stop)) if stop else found
    chosen = F.slice(F.when(F.size(kept) > 0, kept).otherwise(found), 1, MOST_TERMS)

    def term(w: Column) -> Column:
        long = F.char_length(w) >= 6
        stem = F.when(long, F.substring(w, F.lit(1), F.greatest(F.lit(HEAD), F.char_length(w) - 2))).otherwise(w)
        return F.struct(stem.alias("term"), long.alias("prefix"))

    return F.transform(chosen, term)


def asked_terms(questions: DataFrame, languages=("en", "ru")) -> DataFrame:
    """question_id, term, prefix, times of questions (question_id, question)."""
    terms = questions.select("question_id", F.inline(query_terms(F.coalesce("question", F.lit("")), languages)))
    return terms.groupBy("question_id", "term", "prefix").agg(F.count(F.lit(1)).alias("times"))


# ---- the index ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """What is stored under folder; generation numbers count from 0."""

    spark: SparkSession
    folder: str

    def manifest(self) -> list:
        """A row for each generation: generation, parts, passages, words."""
        return self.spark.read.parquet(f"{self.folder}/manifest").orderBy("generation").collect()

    def postings(self, schema: str = SCHEMA) -> DataFrame:
        """The blocks of all generations, each with its number; of their entries just what a schema names."""
        read = self.spark.read.schema(schema)
        made = [read.parquet(f"{self.folder}/postings-{m.generation}").withColumn("generation", F.lit(m.generation)) for m in self.manifest()]
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out

    def gone(self) -> DataFrame | None:
        """passage_id, below: postings of generations before `below` no longer count. None in the first generation."""
        later = [m.generation for m in self.manifest() if m.generation]
        if not later:
            return None
        return self.spark.read.parquet(*(f"{self.folder}/gone-{g}" for g in later)).groupBy("passage_id").agg(F.max("below").alias("below"))

    def live(self, entries: DataFrame) -> DataFrame:
        """entries (passage_id, generation, ...) without those of passages that are gone or replaced."""
        gone = self.gone()
        if gone is None:
            return entries
        return entries.join(gone, "passage_id", "left").where(F.col("generation") >= F.coalesce("below", F.lit(0))).drop("below")

    def passages(self) -> DataFrame:
        """passage_id, dl, call_id, at, generation of every passage that is live."""
        read = self.spark.read
        made = [read.parquet(f"{self.folder}/lengths-{m.generation}").withColumn("generation", F.lit(m.generation)) for m in self.manifest()]
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return self.live(out)

    def lengths(self) -> DataFrame:
        """passage_id, dl of every passage that is live."""
        return self.passages().select("passage_id", "dl")


def _place(passages: DataFrame) -> list[Column]:
    """call_id, at of passages, null where they aren't there."""
    return [F.col(c).cast(t).alias(c) if c in passages.columns else F.lit(None).cast(t).alias(c) for c, t in (("call_id", "string"), ("at", "long"))]


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("passage_id"), F.lit(parts)).cast("int")


def blocks_of(passages: DataFrame, parts: int) -> DataFrame:
    """The posting blocks of passages (passage_id, text and, if there, call_id and at)."""
    words = passages.select(F.col("passage_id").cast("long").alias("passage_id"), *_place(passages), F.sort_array(folded_words(F.coalesce("text", F.lit("")))).alias("ws"))
    dl = F.size("ws").cast("long")
    zone = F.floor(F.log2(dl + 1)).cast("int") * parts + _part(parts)
    starts = F.expr("filter(sequence(0, size(ws) - 1), i -> i = 0 or ws[i] <> ws[i - 1])")
    counted = F.expr("transform(starts, (s, j) -> struct(ws[s] as word, cast(coalesce(get(starts, j + 1), size(ws)) - s as bigint) as tf))")
    # A passage is moved as one row to the task of its zone, its sorted words as one string (equal ones side by side pack
    # well), and only there parted into words; the number of tasks grows with that of zones, so that none grows.
    packed = words.select("passage_id", "call_id", "at", dl.alias("dl"), zone.alias("zone"), F.array_join("ws", " ").alias("packed"))
    moved = packed.repartitionById(4 * parts, F.col("zone")).withColumn("ws", F.when(F.col("dl") > 0, F.split("packed", " ")))
    moved = moved.select("*", F.when(F.col("dl") > 0, starts).alias("starts"))
    rows = moved.select("zone", "passage_id", "dl", "call_id", "at", F.inline(counted)).withColumn("head", F.substring("word", 1, HEAD))
    return rows.sortWithinPartitions("head", "word", "zone", "passage_id").mapInArrow(_runs, SCHEMA)


def _runs(batches):
    """Posting blocks of rows sorted by word and zone: a block for each run. At most a run is held besides a batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = _starts(rows)
        held = rows.slice(int(starts[-1])) if len(starts) else None
        if len(starts) > 1:
            yield _blocks(rows.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield _blocks(held, np.zeros(1, dtype=np.int64))


def _starts(rows: pa.Table) -> np.ndarray:
    n = rows.num_rows
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (rows.column(x).combine_chunks() for x in ("word", "zone"))]
    return np.flatnonzero(np.concatenate([[True], new[0] | new[1]]))


def _blocks(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    first, own = rows.take(pa.array(starts)), rows.combine_chunks()
    flat = {c: pa.concat_arrays(own.column(c).chunks) for c in ("passage_id", "tf", "dl", "call_id", "at")}
    kind = pa.struct([(c, a.type) for c, a in flat.items()])
    entries = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), pa.StructArray.from_arrays(list(flat.values()), fields=list(kind)))
    counts = np.diff(np.append(starts, rows.num_rows)), np.add.reduceat(flat["tf"].to_numpy(), starts)
    one = lambda c: pa.concat_arrays(first.column(c).chunks)
    return pa.RecordBatch.from_arrays([one("head"), one("word"), one("zone"), *(pa.array(c, pa.int64()) for c in counts), entries], names=POSTINGS)


def _added(index: Index, passages: DataFrame, generation: int, parts: int, gone: tuple[int, int] = (0, 0)) -> None:
    """Writes a generation; it counts once its row stands in the manifest."""
    spark, at = index.spark, index.folder
    blocks_of(passages, parts).write.option("compression", "zstd").parquet(f"{at}/postings-{generation}")
    lengths = passages.select(F.col("passage_id").cast("long").alias("passage_id"), F.size(folded_words(F.coalesce("text", F.lit("")))).cast("long").alias("dl"), *_place(passages))
    lengths.write.parquet(f"{at}/lengths-{generation}")
    n, words = spark.read.parquet(f"{at}/lengths-{generation}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    row = [(generation, parts, n - gone[0], words - gone[1])]
    spark.createDataFrame(row, "generation int, parts int, passages long, words long").write.mode("append").parquet(f"{at}/manifest")


def build_index(passages: DataFrame, folder: str | None = None) -> Index:
    """An index over passages with unique passage_id (long); null texts count as empty. Without passages it answers nothing."""
    index = Index(passages.sparkSession, folder or f"{shared_folder(passages.sparkSession)}/index-{uuid.uuid4().hex}")
    _added(index, passages, 0, max(1, -(-passages.count() // ZONE_ROWS)))
    return index


def changed_index(index: Index, added: DataFrame, removed: DataFrame | None = None) -> Index:
    """The index with passages added (replacing those of the same id) and others (passage_id) removed: a new generation."""
    last = index.manifest()[-1]
    ids = added.select(F.col("passage_id").cast("long").alias("passage_id"))
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col("passage_id").cast("long").alias("passage_id")))
    old = index.lengths().join(ids.distinct(), "passage_id")
    old.withColumn("below", F.lit(last.generation + 1)).write.parquet(f"{index.folder}/gone-{last.generation + 1}")
    less = index.spark.read.parquet(f"{index.folder}/gone-{last.generation + 1}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    _added(index, added, last.generation + 1, last.parts, (less[0], less[1]))
    return index


# ---- serving --------------------------------------------------------------------------------------------------------


def term_blocks(index: Index, terms: DataFrame) -> DataFrame:
    """term, prefix, zone, n, entries: the weighted postings of each asked term, a block a zone. A written table."""
    asked = stored(terms.select("term", "prefix").distinct().withColumn("head", F.substring("term", 1, HEAD)), "asked")
    postings, few = index.postings(), asked.count()
    heads = [r.head for r in asked.select("head").distinct().limit(FEW_HEADS + 1).collect()]
    if len(heads) <= FEW_HEADS:
        postings = postings.where(F.col("head").isin(heads))
    met = postings.join(F.broadcast(asked) if few <= FEW_TERMS else asked, "head").where(F.when(F.col("prefix"), F.startswith("word", "term")).otherwise(F.col("word") == F.col("term")))
    made, gone = index.manifest(), index.gone()
    mean = max(1e-9, sum(m.words for m in made) / max(1, sum(m.passages for m in made)))
    weight = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    entry = lambda e, tf: F.struct(e["passage_id"].alias("passage_id"), weight(tf, e["dl"]).alias("weight"), tf.alias("tf"), e["dl"].alias("dl"), e["call_id"].alias("call_id"), e["at"].alias("at"))
    # A block of an exact term is what it is; blocks of the words behind a prefix are merged, and those with entries that
    # may be gone are gone through.
    parted = met.where("prefix") if gone is None else met
    entries = index.live(parted.select("term", "prefix", "zone", "generation", F.inline("entries")))
    summed = entries.repartition("term", "prefix", "zone").groupBy("term", "prefix", "zone", "passage_id").agg(F.sum("tf").alias("tf"), *(F.min(c).alias(c) for c in ("dl", "call_id", "at")))
    listed = summed.groupBy("term", "prefix", "zone").agg(F.collect_list(entry({c: F.col(c) for c in ("passage_id", "dl", "call_id", "at")}, F.col("tf"))).alias("entries"))
    if gone is None:
        exact = met.where("not prefix").select("term", "prefix", "zone", F.transform("entries", lambda e: entry(e, e["tf"])).alias("entries"))
        listed = listed.unionByName(exact)
    return stored(listed.select("term", "prefix", "zone", F.size("entries").cast("long").alias("n"), "entries"), "term-blocks")


def rarity(index: Index, blocks: DataFrame) -> DataFrame:
    """term, prefix, idf, floored just above zero."""
    n = sum(m.passages for m in index.manifest())
    df = blocks.where("term is not null").groupBy("term", "prefix").agg(F.sum("n").alias("df"))
    return df.select("term", "prefix", F.greatest(F.lit(1e-6), F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


def term_hits(index: Index, terms: DataFrame) -> DataFrame:
    """term, prefix, passage_id, tf, dl of the passages that have a term (term, prefix)."""
    return term_blocks(index, terms).select("term", "prefix", F.inline("entries")).select("term", "prefix", "passage_id", "tf", "dl")


def passes(questions: DataFrame, everywhere: int = 12, own: int = 8, others: int = 4) -> DataFrame:
    """question_id, part, only_call, other_than, most, since, until: what is searched for each question (question_id and,
    if there, call_id, since, until). A question about a call asks that call first and then all others."""
    has = lambda c, t: (F.col(c) if c in questions.columns else F.lit(None)).cast(t)
    part = lambda n, only, other, most: F.struct(F.lit(n).alias("part"), only.cast("string").alias("only_call"), other.cast("string").alias("other_than"), F.lit(most).alias("most"))
    none, call = F.lit(None), F.col("_call")
    split = F.when(call.isNull(), F.array(part(0, none, none, everywhere))).otherwise(F.array(part(0, call, none, own), part(1, none, call, others)))
    rows = questions.select("question_id", has("call_id", "string").alias("_call"), has("since", "long").alias("since"), has("until", "long").alias("until"))
    return rows.select("question_id", "since", "until", F.inline(split))


def in_scope(call: Column, at: Column) -> Column:
    """Whether a passage of a call at a time is within only_call, other_than and [since, until) of a pass; null call
    or time is outside of any that is set."""
    inside = F.col("only_call").isNull() | call.eqNullSafe(F.col("only_call"))
    inside &= F.col("other_than").isNull() | (call.isNotNull() & (call != F.col("other_than")))
    return inside & (F.col("since").isNull() | F.coalesce(at >= F.col("since"), F.lit(False))) & (F.col("until").isNull() | F.coalesce(at < F.col("until"), F.lit(False)))


def best_of(rows: DataFrame, group: list[str], n: int, key: str = "passage_id") -> DataFrame:
    """rows with rank: the n best of each group by score and then key. Spark cuts each task's rows to n before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


#: A row for each asked term of a shelf (its passages by their places among the shelf's, and how often they have it) and one
#: without a term for the shelf's passages.
SHELF = "shelf int, term string, prefix boolean, n long, places array<int>, tfs array<int>, ids array<long>, dls array<long>, calls array<string>, ats array<long>"


def _spans(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in flatten(), and the end of the last."""
    return np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _shelved(key, postings: pa.Table, others: pa.Table) -> pa.Table:
    """For a cogroup of the posting blocks of a shelf and its passages and asked terms: rows of SHELF."""
    own = others.filter(pc.is_valid(others.column("passage_id"))).sort_by("passage_id")
    kinds = [("shelf", pa.int32()), ("term", pa.string()), ("prefix", pa.bool_()), ("n", pa.int64()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]
    kinds += [("ids", pa.list_(pa.int64())), ("dls", pa.list_(pa.int64())), ("calls", pa.list_(pa.string())), ("ats", pa.list_(pa.int64()))]
    schema, shelf = pa.schema(kinds), key[0].as_py()
    if not postings.num_rows or not own.num_rows:
        return schema.empty_table()
    whole = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.concat_arrays(own.column(c).chunks)) for c in ("passage_id", "dl", "call_id", "at")]
    out = [pa.RecordBatch.from_arrays([pa.array([shelf], pa.int32()), *(pa.nulls(1, t) for _, t in kinds[1:6]), *whole], schema=schema)]
    # Blocks in the order of their words: what a term asks for is one stretch of postings.
    order = pc.sort_indices(postings.column("word"))
    words, lists = postings.column("word").take(order).to_pylist(), {c: postings.column(c).take(order).combine_chunks() for c in ("ids", "tfs")}
    lists = {c: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()}
    starts, flat = _spans(lists["ids"]), lists["ids"].flatten().to_numpy()
    tf, ids = lists["tfs"].flatten().to_numpy(), own.column("passage_id").to_numpy()
    of, its = postings.column("generation").take(order).to_numpy(), own.column("generation").to_numpy()
    del postings, lists, order
    place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1).astype(np.int32)
    live = ids[place] == flat
    if len(set(of.tolist()) | set(its.tolist())) > 1:
        live &= its[place] == np.repeat(of, np.diff(starts))
    del flat
    asked = others.filter(pc.is_valid(others.column("term")))
    found = []  # term, prefix and the bounds of its postings
    for term, prefix in zip(asked.column("term").to_pylist(), asked.column("prefix").to_pylist(), strict=True):
        low = bisect_left(words, term)
        high = bisect_left(words, term + chr(0x10FFFF), low) if prefix else bisect_right(words, term, low)
        if low < high:
            found.append((term, prefix, int(starts[low]), int(starts[high])))
    while found:
        n, held = 0, 0
        while n < len(found) and (not n or held + found[n][3] - found[n][2] <= MERGED_AT_ONCE):
            held += found[n][3] - found[n][2]
            n += 1
        now, found = found[:n], found[n:]
        low, size = np.array([x[2] for x in now]), np.array([x[3] - x[2] for x in now])
        at = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(held)
        term = np.repeat(np.arange(n), size)[live[at]]
        at = at[live[at]]
        both = term.astype(np.int64) * len(ids) + place[at]  # words behind a prefix that a passage has count together
        by = np.argsort(both, kind="stable")
        both = both[by]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        summed = np.add.reduceat(tf[at[by]], first) if len(first) else np.zeros(0, dtype=np.int32)
        counts = np.bincount(both[first] // len(ids), minlength=n)
        ends = np.append(0, np.cumsum(counts))
        has = np.flatnonzero(counts)
        cuts = ends[np.append(has, n)]  # terms without postings have no row
        arrays = [pa.array(np.full(len(has), shelf), pa.int32()), pa.array([now[i][0] for i in has], pa.string()), pa.array([now[i][1] for i in has], pa.bool_()), pa.array(counts[has], pa.int64())]
        arrays += [_lists(both[first] % len(ids), cuts, pa.int32()), _lists(summed, cuts, pa.int32()), *(pa.nulls(len(has), t) for _, t in kinds[6:])]
        out.append(pa.RecordBatch.from_arrays(arrays, schema=schema))
    return pa.Table.from_batches(out, schema)


def shelves(index: Index, terms: DataFrame) -> tuple[DataFrame, int]:
    """The postings of asked terms (term, prefix) by shelves, as a written table (SHELF), and the number of shelves."""
    asked = stored(terms.select("term", "prefix").distinct().withColumn("_head", F.substring("term", 1, HEAD)), "asked")
    slim = "head string, word string, zone int, entries array<struct<passage_id:bigint,tf:bigint>>"
    postings, few, parts = index.postings(slim), asked.count(), index.manifest()[-1].parts
    shelves, heads = -(-parts // FIRST_ZONES), asked.select("_head").distinct()
    listed = [r._head for r in heads.limit(FEW_HEADS + 1).collect()]
    if len(listed) <= FEW_HEADS:
        postings = postings.where(F.col("head").isin(listed))
    if few <= FEW_TERMS:
        fits = F.when(F.col("prefix"), F.startswith("word", "term")).otherwise(F.col("word") == F.col("term"))
        postings = postings.join(F.broadcast(asked), (F.col("head") == F.col("_head")) & fits, "left_semi")
    else:  # what passes the bitmap and isn't asked is left out within its shelf
        n = heads.count()
        postings = in_bitmap(postings, F.xxhash64("head"), row_bitmap(heads.select(F.xxhash64("_head").alias("h")), "h", n), n, "_met").where("_met")
    shelf = lambda part: F.pmod(part, F.lit(shelves)).alias("shelf")
    slim = postings.select(shelf(F.pmod("zone", F.lit(parts))), "word", "generation", F.col("entries.passage_id").alias("ids"), F.col("entries.tf").cast("array<int>").alias("tfs"))
    own = index.passages().select(shelf(_part(parts)), "passage_id", "generation", "dl", "call_id", "at")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"), "term", "prefix")
    others = own.unionByName(sent, allowMissingColumns=True)
    sides = [x.repartitionById(shelves, F.col("shelf")).groupBy("shelf") for x in (slim, others)]
    made = sides[0].cogroup(sides[1]).applyInArrow(_shelved, SHELF)
    made = stored(made, "term-shelves")
    removed(asked)
    return made, shelves


def _scope(calls: np.ndarray, names: dict, at: np.ndarray, dated: np.ndarray):
    """A function that says which passages of a shelf a scope holds: numbers of 1 and 0, or None for all."""

    def made(only, other, since, until):
        inside = np.ones(len(calls), dtype=bool)
        if only is not None:
            inside &= calls == names.get(only, -2)
        if other is not None:
            inside &= (calls != names.get(other, -2)) & (calls >= 0)
        if since is not None:
            inside &= dated & (at >= since)
        if until is not None:
            inside &= dated & (at < until)
        return inside.astype(np.float64)

    held: dict = {}

    def scope(*key):
        if key == (None,) * 4:
            return None
        if key not in held:
            if len(held) >= SCOPES:
                held.clear()
            held[key] = made(*key)
        return held[key]

    return scope


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the positive scores that may be among the n best, rounded; the length is a multiple of SCORES."""
    most = score.reshape(-1, SCORES).max(1)
    # So many scores of different groups reach the n-th of the groups' greatest.
    least = np.partition(most, -n)[-n] - 10.0 ** (1 - DIGITS) if len(most) > n else 0.0
    return np.flatnonzero(score >= least if least > 0 else score)


def _shelf_scores(n: int, mean: float):
    """For a cogroup of a shelf and the questions of a deal: the n best passages of each pass there."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = [("question_id", asked.schema.field("question_id").type), ("part", pa.int32()), ("passage_id", pa.int64()), ("call_id", pa.string()), ("score", pa.float64())]
        own = blocks.filter(pc.is_null(blocks.column("term")))
        if not own.num_rows or not asked.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds})
        ids, dl, call, at = (pa.concat_arrays(own.column(c).chunks).flatten() for c in ("ids", "dls", "calls", "ats"))
        rows = len(ids)
        code = call.dictionary_encode()
        calls = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        scope = _scope(calls, {c: i for i, c in enumerate(code.dictionary.to_pylist())}, at.fill_null(0).to_numpy(), at.is_valid().to_numpy(zero_copy_only=False))
        of = blocks.filter(pc.is_valid(blocks.column("term")))
        place, tf, spans = np.zeros(0, dtype=np.int64), np.zeros(0), {}
        if of.num_rows:
            lists = {c: pa.concat_arrays(of.column(c).chunks) for c in ("places", "tfs")}
            place, tf, ends = lists["places"].flatten().to_numpy().astype(np.int64), lists["tfs"].flatten().to_numpy().astype(np.float64), _spans(lists["places"]).tolist()
            marks = zip(of.column("prefix").to_pylist(), of.column("term").to_pylist(), strict=True)
            spans = {("*" if p else "=") + t: (a, b) for (p, t), a, b in zip(marks, ends[:-1], ends[1:], strict=True)}
            del lists
        del blocks, of
        weight = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * dl.to_numpy() / mean))[place])
        del tf
        total = np.zeros(-(-rows // SCORES) * SCORES)
        within, whole = np.zeros_like(total), {}

        def add(term: str, idf: float) -> None:
            a, b = spans.get(term, (0, 0))
            if 4 * (b - a) < rows:
                total[place[a:b]] += idf * weight[a:b]
                return
            if term not in whole:  # a frequent word is added as a whole
                whole[term] = np.zeros(rows)
                whole[term][place[a:b]] = weight[a:b]
            total[:rows] += idf * whole[term]

        asked, last, at_row = asked.sort_by("question_id"), None, 0
        of_row, places, scores = [], [], []
        for piece in asked.to_batches(max_chunksize=ASKED_AT_ONCE):
            for question, terms, idfs, *inside in zip(*(piece.column(c).to_pylist() for c in ("question_id", "terms", "idfs", "only_call", "other_than", "since", "until")), strict=True):
                if question != last or not at_row:  # the passes of a question share its scores
                    total[:] = 0.0
                    for term, idf in zip(terms.split(" "), idfs, strict=True):
                        add(term, idf)
                    last = question
                mask, score = scope(*inside), total
                if mask is not None:
                    np.multiply(total[:rows], mask, out=within[:rows])
                    score = within
                found = _best(score, n)
                rounded = np.round(score[found], DIGITS)
                best = np.argsort(-rounded, kind="stable")[:n]  # places rise with ids
                of_row.append(np.full(len(best), at_row))
                places.append(found[best])
                scores.append(rounded[best])
                at_row += 1
        of_row, places = pa.array(np.concatenate(of_row)), pa.array(np.concatenate(places))
        values = [asked.column("question_id").take(of_row), asked.column("part").take(of_row), ids.take(places), call.take(places), pa.array(np.concatenate(scores), pa.float64())]
        return pa.table(dict(zip((k for k, _ in kinds), values, strict=True)), pa.schema(kinds))

    return run


def search(index: Index, questions: DataFrame, asked: DataFrame, n: int, languages=("en", "ru"), scratch: list | None = None) -> DataFrame:
    """question_id, part, passage_id, call_id, score, rank: the n best passages by BM25 for each pass (rows of passes()).

    questions: question_id, question. A question without terms, or whose terms occur nowhere, has no rows. Every passage
    that has a term of a question is scored. The written tables that the result reads are added to scratch, so that a caller
    who has stored it can remove them.
    """
    terms = asked_terms(questions.join(asked.select("question_id").distinct(), "question_id", "left_semi"), languages)
    blocks, number = shelves(index, terms)
    wanted = terms.join(rarity(index, blocks), ["term", "prefix"]).select("question_id", F.concat(F.when(F.col("prefix"), "*").otherwise("="), "term").alias("term"), (F.col("idf") * F.col("times")).alias("idf"))
    listed = wanted.groupBy("question_id").agg(F.collect_list(F.struct("term", "idf")).alias("wanted"))  # MOST_TERMS of each
    listed = listed.select("question_id", F.array_join("wanted.term", " ").alias("terms"), F.col("wanted.idf").alias("idfs"))
    wanted = stored(asked.select("question_id", F.col("part").cast("int").alias("part"), "only_call", "other_than", "since", "until").join(listed, "question_id"), "wanted")
    if scratch is not None:
        scratch += [blocks, wanted]
    deals = max(1, -(-wanted.count() // QUESTIONS))
    every = lambda name, most: F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias(name)
    meeting = lambda shelf, deal: (shelf * deals + deal).alias("meeting")
    deal = F.pmod(F.xxhash64("question_id"), F.lit(deals)).cast("int")
    held = blocks.select("*", every("deal", deals)).select("*", meeting(F.col("shelf"), F.col("deal"))).drop("deal", "shelf")
    met = wanted.select("*", every("shelf", number)).select("*", meeting(F.col("shelf"), deal)).drop("shelf")
    sides = [x.repartitionById(number * deals, F.col("meeting")).groupBy("meeting") for x in (held, met)]  # a task a meeting
    made = index.manifest()
    mean = max(1e-9, sum(m.words for m in made) / max(1, sum(m.passages for m in made)))
    kind = asked.schema["question_id"].dataType.simpleString()
    found = sides[0].cogroup(sides[1]).applyInArrow(_shelf_scores(n, mean), f"question_id {kind}, part int, passage_id long, call_id string, score double")
    return best_of(found, ["question_id", "part"], n)


def all_scores(index: Index, questions: DataFrame, languages=("en", "ru")) -> DataFrame:
    """question_id, passage_id, score of every passage that has a term of a question (question_id, question)."""
    terms = asked_terms(questions, languages)
    blocks = term_blocks(index, terms)
    wanted = terms.join(rarity(index, blocks), ["term", "prefix"])
    rows = wanted.join(blocks.select("term", "prefix", "entries"), ["term", "prefix"]).select("question_id", "idf", "times", F.inline("entries"))
    return rows.groupBy("question_id", "passage_id").agg(F.round(F.sum(F.col("times") * F.col("idf") * F.col("weight")), DIGITS).alias("score"))


def tool_search(index: Index, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The passage tool for a table of requests (question_id, question, call_id, limit): the hits (question_id,
    passage_id, call_id, score, rank) and, for requests without a word of two characters, question_id with a note.

    The tool has no stop words. A limit is held within 1 and 50, and is 10 where null.
    """
    has = questions.withColumn("terms", F.size(query_terms(F.coalesce("question", F.lit("")), ())))
    notes = has.where("terms = 0").select("question_id", F.lit("query has no searchable tokens").alias("note"))
    most = F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(F.col("limit").cast("int"), F.lit(10)))).alias("most")
    asked = questions.select("question_id", F.lit(0).alias("part"), F.col("call_id").cast("string").alias("only_call"), F.lit(None).cast("string").alias("other_than"), most, F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    hits = search(index, questions, asked, 50, ()).join(asked.select("question_id", "most"), "question_id").where("rank <= most")
    return hits.select("question_id", "passage_id", "call_id", "score", "rank"), notes
