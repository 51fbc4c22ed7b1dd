"""Order MinHash fingerprints, in DataFrame expressions alone.

A text's k-mers are runs of K words, numbered by occurrence so that repeats differ. Each numbered k-mer falls into one
of BINS bins by its hash; a bin selects its ELL least k-mers, puts them back into text order and hashes the tuple.
Texts whose selected k-mers agree but stand in another order get other signatures, so likeness follows edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, BINS, ELL = 3, 32, 2
#: Bits of a k-mer's place in a packed number; longer texts share places, still in order.
PLACE = 23
MOST_BUCKETS, BUCKET_ROWS = 2000, 512


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def signature(column: str) -> Column:
    """The signatures of the occupied bins of a text column, as array<long> (bin in the high half); empty for a text without words.

    A text of fewer than K words is one k-mer. White space between words doesn't count.
    """
    low = (1 << PLACE) - 1
    run = f"shiftright({{}}, {PLACE})"
    words = r"filter(split(text_, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    place = f"cast(i div (size(ws) div {1 << PLACE} + 1) as bigint)"
    kmer = "xxhash64(" + ", ".join(f"ws[i + {j}]" for j in range(K)) + ")"
    kmers = f"""case when size(ws) >= {K} then transform(sequence(0, size(ws) - {K}), i -> shiftleft({kmer} & {(1 << 63 - PLACE) - 1}L, {PLACE}) | {place})
                 when size(ws) > 0 then array(shiftleft(xxhash64(array_join(ws, ' ')) & {(1 << 63 - PLACE) - 1}L, {PLACE}))
                 else cast(array() as array<bigint>) end"""
    same = lambda back: f"{run.format(f'ks[i - {back}]')} = {run.format('x')}"
    # The first place of a longer run of equal k-mers, by bisection: lower and upper end in one number.
    target = f"shiftleft({run.format('x')}, {PLACE})"
    middle = "cast((shiftright(a, 32) + (a & 4294967295L)) div 2 as int)"
    bisect = f"aggregate(sequence(1, 31), cast(i as bigint), (a, s) -> case when shiftright(a, 32) >= (a & 4294967295L) then a when ks[{middle}] >= {target} then (a & -4294967296L) | {middle} else shiftleft(cast({middle} + 1 as bigint), 32) | (a & 4294967295L) end, a -> a & 4294967295L)"
    occurrence = f"case when i < 1 or not ({same(1)}) then 0L when i < 2 or not ({same(2)}) then 1L when i < 3 or not ({same(3)}) then 2L else i - {bisect} end"
    hashed = f"xxhash64({run.format('x')}, {occurrence})"
    width = (BINS - 1).bit_length()
    hash_bits = 63 - PLACE - width
    numbered = _let(hashed, "h", f"shiftleft(((h & {BINS - 1}L) * {1 << hash_bits}L) + (shiftrightunsigned(h, 16) & {(1 << hash_bits) - 1}L), {PLACE}) | (x & {low}L)")
    bin_ = lambda x: f"shiftright({x}, {PLACE + hash_bits})"
    least = f"filter(ps, (x, j) -> j < {ELL} or {bin_(f'ps[j - {ELL}]')} <> {bin_('x')})"
    # ELL is 2: the second of a bin is part of the first one's tuple.
    told = f"""transform(cs, (x, j) -> case
        when j > 0 and {bin_('cs[j - 1]')} = {bin_('x')} then null
        when j + 1 < size(cs) and {bin_('cs[j + 1]')} = {bin_('x')} then shiftleft({bin_('x')}, 32) | (4294967295L & if((x & {low}L) <= (cs[j + 1] & {low}L), xxhash64({run.format('x')}, {run.format('cs[j + 1]')}), xxhash64({run.format('cs[j + 1]')}, {run.format('x')})))
        else shiftleft({bin_('x')}, 32) | (4294967295L & xxhash64({run.format('x')})) end)"""
    body = _let(least, "cs", f"filter({told}, y -> y is not null)")
    body = _let(f"sort_array(transform(ks, (x, i) -> {numbered}))", "ps", body)
    body = _let(f"sort_array({kmers})", "ks", body)
    body = _let(words, "ws", body)
    return F.expr(body.replace("text_", f"`{column}`"))


def fingerprint(signatures: Column) -> Column:
    """Ten hex digits for each occupied bin."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins occupied in either text whose signatures agree; 1 for two texts without words."""
    bins = F.size(F.array_union(F.transform(a, lambda s: F.shiftright(s, 32)), F.transform(b, lambda s: F.shiftright(s, 32))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins).cast("double")


def with_next(docs: DataFrame, carried: list[str], prepare=lambda df: df) -> DataFrame:
    """prepare(docs) with next_<c> for each carried column: that of the next row by falling order_id (not null), after
    the last of the first. Rows of one order_id are ordered by the first carried column.

    Rows are dealt into ranges of order_id of near equal counts, each sorted on its own; the first rows of a range are
    also sent, as ghosts, to the end of the range before it. No range meets more than its own rows.
    """
    n = docs.count()
    if not n:
        return prepare(docs).select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    bounds = docs.agg(F.percentile_approx("order_id", [i / buckets for i in range(1, buckets)] or [1.0], 10 * buckets + 100)).first()[0]
    bounds = sorted(set(bounds)) if buckets > 1 else []
    lower = F.size(F.filter(F.array(*(F.lit(int(b)).cast("long") for b in bounds)), lambda b: b < F.col("order_id"))) if bounds else F.lit(0)
    placed = docs.withColumn("bucket", lower)
    tops = sorted((r.bucket, r.top) for r in placed.groupBy("bucket").agg(F.max("order_id").alias("top")).collect())  # MOST_BUCKETS at most
    before = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    ghosts = docs.sparkSession.createDataFrame(before, "order_id long, target int")
    marked = prepare(placed).join(F.broadcast(ghosts), "order_id", "left")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost"))
    both = F.array(own, F.struct(F.col("target").alias("at"), F.lit(True).alias("ghost")))
    dealt = marked.withColumn("place", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(both)))
    falling = Window.partitionBy("place.at").orderBy("place.ghost", F.desc("order_id"), *carried[:1])
    led = dealt.select("*", *(F.lead(c).over(falling).alias(f"next_{c}") for c in carried))
    return led.where(~F.col("place.ghost")).drop("bucket", "target", "place")


def order_minhash_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    A null text is empty. The edited text has its last third (floor) replaced by the start of the next row's text, by
    falling key; null keys come last, rows of one key follow each other by text. An only row is its own next. Texts
    may be of any length that a row can hold; their words are sorted within the row. Other columns are not read; an empty
    table gives no rows.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("order_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    led = with_next(slim, ["text", "own"], lambda df: df.withColumn("own", signature("text")))
    cut = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    led = led.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    led = led.select("*", signature("edited").alias("other"))
    return led.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
