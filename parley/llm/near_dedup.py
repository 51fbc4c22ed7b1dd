"""Near-duplicate groups: SimHash links, completed by a prefix filter, so that no similar pair is lost.

Fingerprints of five-word shingles meet by the generalised pigeonhole of simhash.py. Texts of a Jaccard similarity of 0.8
differ in 9.7 of 64 bits on average, which no affordable tolerance reaches, so texts also meet under a prefix filter:
with all shingles in one order, two sets of that similarity share one of their first n - ceil(0.8 n) + 1 shingles. Pairs
that met are held against each other by bitmaps of their shingles, which bound the similarity from above; the rest form
families, which hold every similar pair. Within a family, texts of a Jaccard similarity of five-word shingles of at
least 0.8 are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import fresh, in_bitmap, join_groups, row_bitmap, small_batches, text_views, written
from ..operators.graph import components

WORDS_EACH, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of texts that meet by SimHash may differ.
TOLERANCE = 3
#: Texts of a family, and their MB, compared in one task. In a larger family texts meet LEADERS of it, in up to ROUNDS
#: rounds, and the pairs that these leave open in blocks of half as many.
FAMILY, FAMILY_MB, LEADERS, ROUNDS = 5_000, 64, 64, 8
#: Rows whose shingles are counted, the rows from which on a shingle is common, and so many of the most common ones.
#: These only steer the cost: the filter is whole in any order of the shingles.
COUNTED, COMMON, MOST_COMMON = 20_000, 3, 200_000
#: Rows under one shingle that meet in pairs; of more, neighbours meet first and then those that are still apart, in
#: blocks of half of BLOCK rows.
PAIRED, BLOCK = 8, 8_000
#: Bytes of the bitmap of a text's shingles: of up to MANY shingles, and of more.
BITMAP, LARGE_BITMAP, MANY = 256, 2048, 1600
#: The shingle of texts without words.
NO_SHINGLE = np.uint64(0)


def common_shingles(slim: DataFrame) -> np.ndarray:
    """The most common shingles of a sample of rows, the most common last: a list of a fixed size."""

    def run(batches):
        for batch in batches:
            sets = [np.zeros(0, dtype=np.uint64), *map(shingles, text_views(batch.column("text")))]
            yield pa.RecordBatch.from_pydict({"s": np.concatenate(sets).view(np.int64)})

    every = max(1, slim.count() // COUNTED)
    counts = slim.where(F.pmod(F.xxhash64("digest"), F.lit(every)) == 0).select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas()
    return found["s"].to_numpy(dtype=np.int64).view(np.uint64)[::-1].copy()


def prefix_of(own: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first n - ceil(SIMILARITY n) + 1 of a text's shingles (ascending): the others by value, then the common ones
    by place. common ascends and place has the rank of each."""
    if not len(own):
        return np.array([NO_SHINGLE])
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, place[at] + 1, 0), kind="stable")]
    return own[: len(own) - math.ceil(SIMILARITY * len(own) - 1e-9) + 1]


def prefixes(slim: DataFrame) -> DataFrame:
    """digest, doc_id, n (distinct shingles), fp (SimHash of all shingles), bits (bitmap), prefix for digest, doc_id, text."""
    found = common_shingles(slim)
    order = np.argsort(found)
    common, place = found[order], order  # order[i]: the rank of the i-th by value

    def run(batches):
        for batch in batches:
            n, fps, bits, out = [], [], [], []
            for view in text_views(batch.column("text")):
                parts = list(simhash.shingle_hashes(view, WORDS_EACH))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
                n.append(len(own))
                fps.append(simhash.fingerprint_of(parts))
                bits.append(bitmap_of(own))
                out.append(prefix_of(own, common, place).view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(bits, pa.binary()), lists], names=["digest", "doc_id", "n", "fp", "bits", "prefix"])

    return slim.mapInArrow(run, "digest string, doc_id long, n long, fp long, bits binary, prefix array<long>")


def bitmap_of(own: np.ndarray) -> bytes:
    """A bit for each shingle, by its hash."""
    bits = np.zeros((BITMAP if len(own) <= MANY else LARGE_BITMAP) * 8, dtype=bool)
    bits[own % np.uint64(len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n_a: np.ndarray, bits_a: list, n_b: np.ndarray, bits_b: list) -> np.ndarray:
    """Whether the bitmaps of pairs leave room for SIMILARITY: sets differ in at least as many shingles as bitmaps in bits."""
    out = np.zeros(len(n_a), dtype=bool)
    large_a, large_b = (np.array([len(x) > BITMAP for x in y], dtype=bool) for y in (bits_a, bits_b))
    for large in (True, False):
        at = np.flatnonzero((large_a & large_b) == large)
        for some in np.split(at, range(4096, len(at), 4096)):
            x, y = (np.stack([as_size(z[i], large) for i in some]) if len(some) else np.zeros((0, 1), np.uint64) for z in (bits_a, bits_b))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            every = n_a[some] + n_b[some]
            out[some] = (every - apart) / 2 >= SIMILARITY / (1 + SIMILARITY) * every - 1e-6
    return out


def as_size(bits: bytes, large: bool) -> np.ndarray:
    """A bitmap in 64-bit words; a large one folded to the small size unless large is wanted."""
    words = np.frombuffer(bits, dtype="<u8")
    return words if large or len(bits) == BITMAP else np.bitwise_or.reduce(words.reshape(-1, BITMAP // 8), axis=0)


def meet(batches):
    """a, b, crowd for rows s, n, place, row_id sorted by s, n, row_id: pairs of rows that share a shingle (crowd false),
    and shingles with their rows where more than PAIRED share one (crowd true).

    Up to PAIRED rows of a shingle are paired where their sizes, and the shingles after this one, allow SIMILARITY; if
    this is the first shingle that they share, a similar pair passes. Of more rows, neighbours by size are paired.
    """
    kept: list[np.ndarray] = []

    def found(s, n, place, row):
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(s)))
        many = np.repeat(sizes > PAIRED, sizes)
        a, b = [], []
        for step in range(1, PAIRED):
            x = np.flatnonzero(s[step:] == s[:-step])
            if not len(x):
                break
            y = x + step
            after = np.minimum(n[x] - place[x], n[y] - place[y])
            near = (n[x] >= SIMILARITY * n[y] - 1e-9) & (row[x] != row[y])
            near &= np.where(many[x], step == 1, after * (1 + SIMILARITY) >= SIMILARITY * (n[x] + n[y]) - 1e-6)
            a.append(row[x[near]])
            b.append(row[y[near]])
        a, b = np.concatenate([np.zeros(0, dtype=np.int64), *a]), np.concatenate([np.zeros(0, dtype=np.int64), *b])
        crowd = np.append(np.zeros(len(a), dtype=bool), np.ones(int(many.sum()), dtype=bool))
        return pa.RecordBatch.from_pydict({"a": np.append(a, s[many]), "b": np.append(b, row[many]), "crowd": crowd})

    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "place", "row_id")]
        got = [np.concatenate([k, g]) for k, g in zip(kept, got, strict=True)] if kept else got
        last = int(np.searchsorted(got[0], got[0][-1]))  # this shingle may go on in the next batch
        yield found(*(g[:last] for g in got))
        if not last and len(got[0]) > PAIRED + 1:  # a long run: its links are given, its last rows stay
            yield found(*got)
            got = [g[-PAIRED - 1 :] for g in got]
        kept = [g[last:] for g in got]
    if kept:
        yield found(*kept)


def fingerprint_links(marked: DataFrame, rows: int) -> DataFrame:
    """Links a, b of rows whose fingerprints differ in at most TOLERANCE bits, joined as all such links would join them."""
    nodes = written(marked.groupBy("fp").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("rows")), "near-fingerprints")
    of = lambda c: nodes.select(F.col("fp").alias(c), F.col("least").alias(f"row_{c}"))
    apart = simhash.links(nodes.select("fp"), TOLERANCE).join(of("a"), "a").join(of("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    same = join_groups(marked.select("row_id", "fp"), nodes.where("rows > 1"), "fp", "rows", rows)
    return apart.unionByName(same.where("row_id <> least").select(F.col("row_id").alias("a"), F.col("least").alias("b")))


def verified_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The distinct pairs a, b whose bitmaps may_be_alike()."""
    of = lambda c: marked.select(F.col("row_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    joined = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(of("a"), "a").join(of("b"), "b")

    def run(batches):
        for batch in batches:
            n = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
            bits = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            good = pa.array(may_be_alike(n[0], bits[0], n[1], bits[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(good)

    return joined.mapInArrow(run, "a long, b long")


def link_crowd(table: pa.Table) -> pa.Table:
    """Links a, b between rows of one shingle and of several roots that join what all pairs which may_be_alike() join."""
    table = table.combine_chunks()
    rows, roots, n = (table.column(c).to_numpy() for c in ("row_id", "root", "n"))
    bits = table.column("bits").to_pylist()
    sizes = np.array([len(x) > BITMAP for x in bits])
    small = np.stack([as_size(x, False) for x in bits])
    large = np.zeros((len(bits), LARGE_BITMAP // 8 if sizes.any() else 0), dtype=np.uint64)
    for i in np.flatnonzero(sizes):
        large[i] = as_size(bits[i], True)
    _, group = np.unique(roots, return_inverse=True)
    out = []
    for i in range(len(rows)):
        at = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(at):
            continue
        fits = np.minimum(n[at], n[i]) >= SIMILARITY * np.maximum(n[at], n[i]) - 1e-9
        at = at[fits]
        both = sizes[at] & sizes[i]
        apart = np.empty(len(at), dtype=np.int64)
        apart[~both] = np.bitwise_count(small[at[~both]] ^ small[i]).sum(1, dtype=np.int64)
        apart[both] = np.bitwise_count(large[at[both]] ^ large[i]).sum(1, dtype=np.int64)
        every = n[at] + n[i]
        for j in at[(every - apart) / 2 >= SIMILARITY / (1 + SIMILARITY) * every - 1e-6].tolist():
            if group[j] != group[i]:
                out.append((rows[i], rows[j]))
                group[group == group[j]] = group[i]
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def crowd_links(crowds: DataFrame, known: DataFrame, marked: DataFrame) -> DataFrame:
    """Links between rows (b) under one shingle (a) that known (node, root) leaves apart; in blocks, each with each other."""
    placed = crowds.join(known.select(F.col("node").alias("b"), "root"), "b", "left").select("a", "b", F.coalesce("root", "b").alias("root"))
    apart = placed.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = apart.select("a", F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / BLOCK)).cast("int").alias("k"))
    rows = placed.join(apart, "a").join(marked.select(F.col("row_id").alias("b"), "n", "bits"), "b")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("b"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.where("k = 1 or own <> other").select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("b").alias("row_id"), "root", "n", "bits")
    return rows.groupBy("a", "i", "j").applyInArrow(link_crowd, "a long, b long")


def families(marked: DataFrame, rows: int) -> DataFrame:
    """row_id, family of the rows that may be alike to another row."""
    firsts = marked.select("row_id", "n", F.posexplode("prefix").alias("place", "s")).select("s", "n", F.col("place").cast("long").alias("place"), "row_id")
    met = written(firsts.repartition("s").sortWithinPartitions("s", "n", "row_id").mapInArrow(meet, "a long, b long, crowd boolean").distinct(), "near-met")
    pairs = met.where("not crowd").select("a", "b").unionByName(fingerprint_links(marked, rows))
    known = written(components(verified_pairs(pairs, marked)), "near-known")
    more = written(crowd_links(met.where("crowd").select("a", "b"), known, marked), "near-crowds")
    if not more.isEmpty():
        known = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return known.select(F.col("node").alias("row_id"), F.col("root").alias("family"))


def shingles(view) -> np.ndarray:
    parts = list(simhash.shingle_hashes(view, WORDS_EACH))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least SIMILARITY; two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def link_family(table: pa.Table) -> pa.Table:
    """Links a, b between rows of one family that join just what all its similar pairs join.

    A prefix filter finds candidates: with shingles in one order, the rarest first, similar sets share one of their
    first n - ceil(SIMILARITY n) + 1. Rows that are joined already are no candidates any more.
    """
    table = table.combine_chunks()
    rows = table.column("row_id").to_pylist()
    sets = [shingles(v) for c in table.column("text").chunks for v in text_views(c)]
    values, inverse, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    single = int((counts == 1).sum())  # ranks below have no partner
    sets = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(x) for x in sets])[:-1])] if sets else []
    prefixes = [x[: len(x) - math.ceil(SIMILARITY * len(x) - 1e-9) + 1] for x in sets]
    prefixes = [x[x >= single].tolist() if len(s) else [-1] for x, s in zip(prefixes, sets, strict=True)]
    postings: dict[int, list[int]] = {}
    for i, prefix in enumerate(prefixes):
        for p in prefix:
            postings.setdefault(p, []).append(i)
    flat, lengths = np.concatenate([*sets, np.full(1, len(values))]), np.array([len(x) for x in sets])
    starts, held = np.cumsum(lengths) - lengths, np.zeros(len(values) + 1, dtype=bool)

    def similar(seed: int, tried: set[int]) -> list[int]:
        if len(tried) < 16:
            return [i for i in tried if alike(sets[seed], sets[i])]
        held[sets[seed]] = True
        both = np.add.reduceat(held[flat], starts, dtype=np.int64) * (lengths > 0)  # with all rows at once
        held[sets[seed]] = False
        good = both >= SIMILARITY * (lengths + lengths[seed] - both) - 1e-9
        return [i for i in tried if good[i]]

    left, out = set(range(len(rows))), []
    for start in sorted(range(len(rows)), key=lambda i: rows[i]):
        if start not in left:
            continue
        left.discard(start)
        front = [start]
        while front:
            seed, tried = front.pop(), set()
            for p in prefixes[seed]:
                postings[p] = [i for i in postings[p] if i in left]
                tried.update(postings[p])
            for i in similar(seed, tried):
                left.discard(i)
                front.append(i)
                out.append((rows[i], rows[seed]))
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def follow(table: pa.Table) -> pa.Table:
    """a, b, linked of each row a and each leader b (lead) of one slice with a distance (1 - similarity) of at most
    twice that of alike ones."""
    table = table.combine_chunks()
    rows, lead = table.column("row_id").to_pylist(), table.column("lead").to_pylist()
    views = [v for c in table.column("text").chunks for v in text_views(c)]
    heads = [(rows[i], shingles(views[i])) for i, x in enumerate(lead) if x]
    lengths = np.array([len(h) for _, h in heads], dtype=np.int64)
    flat, starts = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in heads)]), np.cumsum(lengths) - lengths
    out = []
    for row, is_lead, view in zip(rows, lead, views, strict=True):
        if is_lead or not heads:
            continue
        mine = shingles(view)
        held = np.zeros(len(flat) + 1, dtype=bool)
        if len(mine):
            held[:-1] = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        both = np.add.reduceat(held, starts, dtype=np.int64) * (lengths > 0)
        every = lengths + len(mine) - both
        for i in np.flatnonzero(both >= (2 * SIMILARITY - 1) * every - 1e-6).tolist():
            if heads[i][0] != row:
                out.append((row, heads[i][0], bool(both[i] >= SIMILARITY * every[i] - 1e-9)))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])


def in_blocks(n: str, size: str):
    """The blocks of n rows and size bytes, two of which a task may hold."""
    return F.greatest(F.lit(1), F.ceil(2 * F.col(n) / FAMILY), F.ceil(2 * F.col(size) / (FAMILY_MB << 20))).cast("int")


def large_links(rows: DataFrame) -> DataFrame:
    """Links a, b of rows (row_id, family, text, blocks) that join just what all similar pairs of a family join.

    In a round, LEADERS of a family's rows meet all its rows that nothing is linked to yet; a row that is like a leader
    takes no part in later rounds. If a is linked to leader c and b is like a, then b took part in that round and is, by
    the triangle inequality of the Jaccard distance, linked to c too or on its border: at most twice as far from it.
    So what is left are pairs of a border with what was linked to its leader, unless both are joined already, and
    pairs of the rows that no round linked. Those meet in blocks, each block with each other one.
    """
    active, turn = written(rows, "near-big"), 0
    texts, met_all, waiting = active.select("row_id", "text"), [], active.count()
    while waiting and turn < ROUNDS:
        # Leaders: the rows of least hash, chosen per slice of the family first and then among those.
        thin = active.select("family", "row_id", F.xxhash64("row_id", F.lit(turn)).alias("draw"), F.pmod(F.xxhash64("row_id"), F.lit(1024)).alias("slice"))
        first = thin.withColumn("rank", F.row_number().over(Window.partitionBy("family", "slice").orderBy("draw"))).where(f"rank <= {LEADERS}")
        chosen = first.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("draw"))).where(f"rank <= {LEADERS}").select("family", "row_id")
        leaders = written(active.join(chosen, ["family", "row_id"], "left_semi"), "near-leaders")
        own = active.select("family", F.pmod(F.xxhash64("row_id", F.lit(-1)), "blocks").cast("int").alias("slice"), "row_id", "text", F.lit(False).alias("lead"))
        sent = leaders.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slice"), "row_id", "text", F.lit(True).alias("lead"))
        met = written(own.unionByName(sent).groupBy("family", "slice").applyInArrow(follow, "a long, b long, linked boolean"), "near-met")
        met_all.append(met)
        now = leaders.select("row_id").unionByName(met.where("linked").select(F.col("a").alias("row_id"))).distinct()
        active = written(active.join(now, "row_id", "left_anti"), "near-active")
        left, turn = active.count(), turn + 1
        waiting, few = left, 4 * (waiting - left) < waiting
        if few:
            break
    met = met_all[0]
    for x in met_all[1:]:
        met = met.unionByName(x)
    linked = met.where("linked").select("a", "b")
    # A row's own leader is that of the round in which it was linked first: it took part in no later one.
    cluster = linked.groupBy("a").agg(F.min("b").alias("g")).select("g", F.col("a").alias("row_id"), F.lit(1).alias("side"))
    roots = written(components(linked), "near-roots")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    border = met.where("not linked").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    border = border.where("coalesce(root_a, a) <> coalesce(root_b, b)").select(F.col("b").alias("g"), F.col("a").alias("row_id"), F.lit(0).alias("side"))
    border = written(border, "near-border")
    sides = border.unionByName(cluster.join(border.select("g").distinct(), "g", "left_semi")).join(texts, "row_id")
    sides = written(sides, "near-sides")
    size = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.octet_length("text"))), F.lit(0)).alias(f"size{side}")
    count = lambda side: F.sum((F.col("side") == side).cast("long")).alias(f"n{side}")
    counts = sides.groupBy("g").agg(count(0), size(0), count(1), size(1)).where("n0 > 0 and n1 > 0").select("g", in_blocks("n0", "size0").alias("k0"), in_blocks("n1", "size1").alias("k1"))
    placed = sides.join(counts, "g").withColumn("own", F.pmod(F.xxhash64("row_id", F.lit(-2)), F.when(F.col("side") == 0, F.col("k0")).otherwise(F.col("k1"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("k1")).otherwise(F.col("k0")) - 1)))
    across = placed.select(F.lit(0).alias("kind"), "g", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"), "row_id", "text")
    counts = active.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).select("family", in_blocks("n", "size").alias("k"))
    placed = active.join(counts, "family").withColumn("own", F.pmod(F.xxhash64("row_id", F.lit(-2)), "k").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("k = 1 or own <> other")
    within = placed.select(F.lit(1).alias("kind"), F.col("family").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row_id", "text")
    rest = across.unionByName(within).groupBy("kind", "g", "i", "j").applyInArrow(link_family, "a long, b long")
    return linked.unionByName(rest)


def digest_of(key: str, text: str):
    """What tells rows apart: SHA-256 over key and text. Rows that agree in both are repeats of one row."""
    k, t = F.coalesce(F.col(f"`{key}`").cast("long").cast("string"), F.lit("none")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.sha2(F.concat(k, F.lit("|"), t).cast("binary"), 256)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, group of the rows to drop: those of a group but for the one of the smallest key (null keys last).

    A null text is empty; empty texts are alike. Rows equal in key and text count as one. Every pair of alike rows joins
    a group, however long the texts. A family over FAMILY rows or FAMILY_MB is held by no task: large_links() joins the
    same rows as one task would. An empty table gives no rows; further columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.count()
    slim = docs.select(digest_of(key, text).alias("digest"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = written(prefixes(slim).withColumn("row_id", F.monotonically_increasing_id()), "near-marked")
    # Repeats of a row have all shingles in common and so one family; the first stands for them.
    member = families(marked, rows).join(marked.select("row_id", "digest", "doc_id"), "row_id")
    member = written(member.groupBy("digest").agg(F.min(F.struct("row_id", "family", "doc_id")).alias("m")).select("digest", "m.*"), "near-families")
    some = in_bitmap(slim, F.xxhash64("digest"), row_bitmap(member.select(F.xxhash64("digest").alias("h")), "h", rows), rows, "member").where("member")
    texts = written(some.select("digest", "text").dropDuplicates(["digest"]).join(member.select("digest", "row_id", "family"), "digest").select("row_id", "family", "text"), "near-texts")
    sizes = texts.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = written(sizes.where((F.col("n") > FAMILY) | (F.col("size") > FAMILY_MB << 20)).select("family", in_blocks("n", "size").alias("blocks")), "near-large")
    links = texts.join(large, "family", "left_anti").groupBy("family").applyInArrow(link_family, "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(large_links(texts.join(large, "family")))
    groups = written(components(links).join(member.select(F.col("row_id").alias("node"), "doc_id", "digest"), "node"), "near-groups")
    stays = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    joined = join_groups(groups, written(stays, "near-stays"), "root", "rows", rows)
    return joined.where("node <> stays.node").select("digest", F.col("root").alias("group"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() doesn't drop; only rows near those move."""
    rows, gone = docs.count(), written(near_duplicates(docs, key, text).select("digest").distinct(), "near-gone")
    digest, name = fresh(docs, "digest"), fresh(docs, "gone")
    told = docs.withColumn(digest, digest_of(key, text))
    flagged = in_bitmap(told, F.xxhash64(digest), row_bitmap(gone.select(F.xxhash64("digest").alias("h")), "h", rows), rows, name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = flagged.where(F.col(name)).join(gone.select(F.col("digest").alias(digest)), digest, "left_anti")
    return flagged.where(~F.col(name)).select(*columns).unionByName(doubtful.select(*columns))
