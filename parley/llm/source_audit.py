"""How the wording of each source departs from that of other sources and of its language.

1. Where its rows lie, each shard sets pointers to the starts of the words in its Arrow buffers and sorts them by
   multikey quicksort (eight bytes at a time, three ways). A run of equal words, in which the pointers of one source
   stand together, gives the counts of that word and of its documents per source.
2. Counts meet by language and word; words of enough documents are kept.
3. Divergence is summed over the words that two sources share; the words that one of them lacks follow from how often
   its counts occur, as all words that a source lacks have one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, small_batches, written

#: Bytes that words are made of: ASCII letters and all of other letters' bytes.
_IS_WORD = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Of eight bytes read, those before the end of a word.
_HEADS = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], dtype=np.uint64)
#: Bytes of text in a slice, and pointers that are sorted without further partitioning.
SLICE, SMALL = 24 << 20, 1 << 14
#: Sources of a block, and rows of a shard of words (on average).
BLOCK, SHARD_ROWS = 128, 200_000
#: Parts into which the rows of one source are dealt where they are joined.
SALTS = 64


# ---- pointers -------------------------------------------------------------------------------------------------------


def word_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the words in data; bounds are the ends of its rows, over which no word reaches."""
    inside = _IS_WORD[data]
    after = np.append(inside[1:], False)
    after[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    before = np.append(False, inside[:-1])
    before[bounds[bounds < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, ends, np.searchsorted(bounds, starts, side="right")


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): the pointers by their words' bytes, equal ones as they came, and the places where a new word begins.

    data has eight bytes behind its last word, and no word holds a zero byte.
    """
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)

    def keys(pointers, depth):
        at = starts[pointers] + depth
        left = np.clip(ends[pointers] - at, 0, 8)
        return windows[np.minimum(at, len(windows) - 1)].view(">u8").ravel().astype(np.uint64) & _HEADS[left]

    n = len(starts)
    order, head = np.arange(n), np.zeros(n, dtype=bool)
    key = keys(order, 0) if n else np.zeros(0, dtype=np.uint64)
    todo = [(0, n, 0)] if n else []
    while todo:
        low, high, depth = todo.pop()
        own, by = order[low:high], key[low:high]
        if high - low > SMALL:
            sample = np.sort(by[:: max(1, (high - low) // 63)])
            pivot = sample[len(sample) // 2]
            less, same = by < pivot, by == pivot
            more = ~(less | same)
            parts = (own[less], own[same], own[more])
            order[low:high] = np.concatenate(parts)
            a, b = low + len(parts[0]), high - len(parts[2])
            key[low:high] = np.concatenate((by[less], by[same], by[more]))
            todo += [x for x in ((low, a, depth), (b, high, depth)) if x[0] < x[1]]
            if int(pivot) & 255:
                key[a:b] = keys(order[a:b], depth + 8)
                todo.append((a, b, depth + 8))
            else:
                head[a] = True
            continue
        place = np.argsort(by, kind="stable")
        order[low:high], by = own[place], by[place]
        first = np.append(True, by[1:] != by[:-1])
        group = np.cumsum(first)
        open_ = np.flatnonzero((by & np.uint64(255) != 0) & ~(first & np.append(first[1:], True)))
        while len(open_):  # words that share all bytes so far and go on
            depth += 8
            members = order[low:high][open_]
            deeper = keys(members, depth)
            place = np.lexsort((deeper, group[open_]))
            order[low + open_] = members[place]
            deeper, groups = deeper[place], group[open_]
            new = np.append(True, (deeper[1:] != deeper[:-1]) | (groups[1:] != groups[:-1]))
            first[open_] |= new
            group = np.cumsum(first)
            alone = new & np.append(new[1:], True)
            open_ = open_[(deeper & np.uint64(255) != 0) & ~alone]
        head[low:high] = first
    return order, np.flatnonzero(head)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the words, one behind the other."""
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    return offsets, data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _padded(data: np.ndarray) -> np.ndarray:
    return np.append(_LOWERED[data], np.zeros(8, dtype=np.uint8))


def long_text_counts(data: np.ndarray, piece: int) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of one long text: pieces that end between words give their distinct words, which are sorted again."""
    found, counts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        part = _padded(data[at:end])
        starts, ends, _ = word_pointers(part[:-8], np.array([end - at]))
        order, heads = pointer_sort(part, starts, ends)
        offsets, words = _gathered(part, starts[order[heads]], ends[order[heads]])
        found.append(np.insert(words, offsets[1:], 0))
        counts.append(np.diff(np.append(heads, len(order))))
        at = end
    all_, n = _padded(np.concatenate(found)), np.concatenate(counts)
    starts, ends, _ = word_pointers(all_[:-8], np.array([len(all_) - 8]))
    order, heads = pointer_sort(all_, starts, ends)
    words = _strings(*_gathered(all_, starts[order[heads]], ends[order[heads]]))
    return words, np.add.reduceat(n[order], heads) if len(heads) else np.zeros(0, dtype=np.int64)


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def slice_counts(rows: pa.Table, slice_bytes: int = SLICE):
    """Batches of lang, source, term, n, docs for some documents (lang, source, text, without nulls).

    Each lang and source has a row of the term '' too, with its documents.
    """
    rows = rows.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    langs, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang, source = langs.indices.to_numpy(), sources.indices.to_numpy()
    text = rows.column("text").combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], dtype="<i4", count=len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)

    def told(in_lang, of, terms, n, docs):
        columns = [pa.DictionaryArray.from_arrays(pa.array(np.full(len(of), in_lang, dtype=np.int32)), langs.dictionary).cast(pa.string()), pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int32)), sources.dictionary).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*columns, terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=COUNTS)

    edges = np.append(np.flatnonzero(np.append(True, lang[1:] != lang[:-1])), len(lang))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, many = np.unique(source[a:b], return_counts=True)
        yield told(lang[a], own, pa.array([""] * len(own)), np.zeros(len(own)), many)
        sizes = np.diff(offsets[a : b + 1])
        for r in (np.flatnonzero(sizes > slice_bytes) + a).tolist():
            terms, n = long_text_counts(data[offsets[r] : offsets[r + 1]], slice_bytes)
            yield told(lang[a], np.full(len(n), source[r]), terms, n, np.ones(len(n)))
        short = np.flatnonzero(sizes <= slice_bytes)
        if len(short) < b - a:  # without the long texts between them
            part = np.concatenate([data[offsets[a + i] : offsets[a + i + 1]] for i in short.tolist()] or [data[:0]])
        else:
            part = data[offsets[a] : offsets[b]]
        part = _padded(part)
        starts, ends, row = word_pointers(part[:-8], np.cumsum(sizes[short]))
        order, heads = pointer_sort(part, starts, ends)
        if not len(order):
            continue
        of, row = source[a + short][row[order]], row[order]
        new = np.zeros(len(order), dtype=bool)
        new[heads] = True
        new[1:] |= of[1:] != of[:-1]
        at = np.flatnonzero(new)
        new[1:] |= row[1:] != row[:-1]  # a run's documents
        starts, ends = starts[order[at]], ends[order[at]]
        terms = _strings(*_gathered(part, starts, ends))
        yield told(lang[a], of[at], terms, np.diff(np.append(at, len(order))), np.add.reduceat(new.astype(np.int64), at))


def shard_counts(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """lang, source, term, n, docs: the counts of each slice of each shard, to be summed."""
    small_batches(docs.sparkSession)
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def count(batches):
        held, size = [], 0
        for batch in batches:
            if held and size + batch.nbytes > slice_bytes:
                yield from slice_counts(pa.Table.from_batches(held), slice_bytes)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from slice_counts(pa.Table.from_batches(held), slice_bytes)

    return slim.mapInArrow(count, "lang string, source string, term string, n long, docs long")


# ---- divergence -----------------------------------------------------------------------------------------------------


def share(count: str, all_: str, words: str) -> Column:
    """1 + floor(10^9 (count + 1) / (all + words)), exact for counts up to 2 * 10^14; 10^9 is 32000 * 31250."""
    up, by = f"(({count}) + 1) * 32000", f"greatest(({all_}) + ({words}), 1)"
    return F.expr(f"1 + ({up}) div {by} * 31250 + ({up}) % {by} * 31250 div {by}")


def departure(p, q):
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1."""
    return (p - q) * (p - q) // q


def pair_sums(rows: pa.Table) -> pa.Table:
    """lang, source, item, value of the pairs of sources in one shard of words, between one block of sources and another.

    rows: lang, low, high (blocks), shard, source, block, term, p, lacking, terms, words. Each source has a row of the
    term ''; with the first shard the words that both lack are added.
    """
    sources = rows.column("source").combine_chunks().dictionary_encode()
    code, names = sources.indices.to_numpy(), sources.dictionary
    term = rows.column("term").combine_chunks().dictionary_encode()
    bare = pc.equal(rows.column("term"), "").to_numpy()
    columns = {c: rows.column(c).to_numpy() for c in ("p", "lacking", "block", "terms", "words")}
    k = len(names)
    lacking, block, terms = (np.zeros(k, dtype=np.int64) for _ in range(3))
    for own, c in ((lacking, "lacking"), (block, "block"), (terms, "terms")):
        own[code[bare]] = columns[c][bare]
    low, high, shard = (rows.column(c)[0].as_py() for c in ("low", "high", "shard"))
    wanted = block[:, None] != block[None, :] if low != high else ~np.eye(k, dtype=bool)
    total = np.zeros((k, k), dtype=np.int64)
    order = np.argsort(term.indices.to_numpy()[~bare], kind="stable")
    of, p, word = code[~bare][order], columns["p"][~bare][order], term.indices.to_numpy()[~bare][order]

    by_source = np.argsort(of, kind="stable")
    for own in np.split(by_source, np.flatnonzero(np.diff(of[by_source])) + 1):  # the words of one source, as if no other had them
        if len(own):
            s = of[own[0]]
            values, many = np.unique(p[own], return_counts=True)
            total[s] += (many[:, None] * departure(values[:, None], lacking[None, :])).sum(0)
            total[:, s] += (many[:, None] * departure(lacking[None, :], values[:, None])).sum(0)

    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.append(first, len(word)))
    cuts = np.searchsorted(np.cumsum(many * many), np.arange(1, 1 + int((many * many).sum()) // 1_000_000) * 1_000_000)
    flat = total.reshape(-1)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):  # words that both have
        runs = np.repeat(many[a:b], many[a:b])
        if len(runs):
            left = np.repeat(np.arange(first[a], first[a] + len(runs)), runs)
            start = np.repeat(np.repeat(first[a:b], many[a:b]), runs)
            right = start + np.arange(len(left)) - np.repeat(np.cumsum(runs) - runs, runs)
            use = wanted[of[left], of[right]]
            g, h = of[left[use]], of[right[use]]
            x, y, zx, zy = p[left[use]], p[right[use]], lacking[g], lacking[h]
            np.add.at(flat, g * k + h, departure(x, y) - departure(x, zy) - departure(zx, y) + departure(zx, zy))
    if shard == 0:
        total += (columns["words"][0] - terms[:, None] - terms[None, :]) * departure(lacking[:, None], lacking[None, :])
    g, h = np.nonzero(wanted)
    return pa.table({"lang": pa.repeat(rows.column("lang")[0], len(g)), "source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "value": total[g, h]})


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, slice_bytes: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: how each source departs from each other one and from its language.

    Null lang, source and text count as ''. A document is a row, so repeated rows and rows of one key count each. Words
    are told apart by their bytes, A-Z lower-cased; those in at least least_docs documents of a language are kept. Part
    `pair` has every other source of the language, part `term` the `top` kept words that the source uses more than its
    language. Ties are ordered by item in UTF-8. A source without words has its rows of part `pair` too; an only source
    has none; without kept words all values are 0. Texts may be of any length (a long one is cut between words and
    counted as one document) and so may words; an empty table gives no rows. Other columns are not read.
    """
    docs_ = Window.partitionBy("lang", "term")
    counts = shard_counts(docs, slice_bytes).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(docs_).alias("in_docs"),
        F.sum("n").over(docs_).alias("in_lang"),
        (F.row_number().over(docs_.orderBy("source")) == 1).alias("head"),
    )
    kept = written(counts.where((F.col("in_docs") >= least_docs) | (F.col("term") == "")).drop("in_docs"), "audit-terms")
    real = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count_if(real).alias("terms"), F.count_if(real & F.col("head")).alias("heads"))
    langs = groups.groupBy("lang").agg(
        F.sum("n_source").alias("n_lang"),
        F.sum("heads").alias("words"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum("terms") / SHARD_ROWS)).cast("int").alias("shards"),
    )
    groups = written(groups.drop("heads").join(langs, "lang"), "audit-groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    salted = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = kept.where(real).select("lang", "source", "term", "n", "in_lang", salt).join(salted, ["lang", "source", "salt"])
    rows = rows.withColumn("p", share("n", "n_source", "words"))

    used = rows.select("lang", "source", "term", "p", share("in_lang", "n_lang", "words").alias("q")).where("p > q")
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    used = used.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    block = lambda df: df.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    roster = block(groups).select("*", F.lit("").alias("term"), F.lit(0).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    words = block(rows).withColumn("shard", F.pmod(F.xxhash64("term", F.lit(1)), F.col("shards")).cast("int"))
    fields = ("lang", "source", "block", "term", "p", "shard", share("0", "n_source", "words").alias("lacking"), "terms", "words")
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("low"), F.greatest(b, "block").alias("high")))
    dealt = roster.select(*fields, F.explode(meetings).alias("meeting")).unionByName(words.select(*fields, F.explode(meetings).alias("meeting")))
    dealt = dealt.select("*", "meeting.low", "meeting.high").drop("meeting")
    summed = dealt.groupBy("lang", "low", "high", "shard").applyInArrow(pair_sums, "lang string, source string, item string, value long")
    pairs = summed.groupBy("lang", "source", F.lit("pair").alias("part"), "item").agg(F.sum("value").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(used)


def divergence_sql() -> str:
    """The same rows, every source of a language held against every other over all kept words."""
    p = lambda c, n: f"1 + (1000000000::HUGEINT * ({c} + 1)) // greatest({n} + v, 1)"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        l AS (SELECT g.lang, coalesce(sum(k.n), 0) AS n, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY g.lang),
        g AS (SELECT s.lang, s.source, l.v, l.n AS ln, coalesce(sum(c.n), 0) AS n
              FROM (SELECT DISTINCT lang, source FROM d) s JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source, l.v, l.n),
        f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.n")} AS p, {p("k.n", "g.ln")} AS q
              FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        m AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""
