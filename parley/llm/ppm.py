"""Scoring by prediction with partial matching over bytes.

The model is a trie of byte contexts kept as tables, one per depth: how often each symbol followed each context in the
training texts. A symbol that a context has not seen escapes to the next shorter context, where the symbols of the
longer one are excluded; escapes are estimated by method D. The code length of a text is the sum over its bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, bucketed, crc_mod, small_batches, text_bytes, text_views, written

#: Never a byte of UTF-8: stands before a text as often as contexts are long, and once after it.
EDGE = 0xFF
PIECE = 1 << 20


def gram_codes(normal: bytes, order: int) -> np.ndarray:
    """For every byte of a text and its end: the byte with the `order` bytes before it, as one number."""
    data = np.frombuffer(bytes([EDGE]) * order + normal + bytes([EDGE]), dtype=np.uint8)
    n = len(normal) + 1
    code = np.zeros(n, dtype=np.int64)
    for i in range(order + 1):
        code = code << 8 | data[i : i + n]
    return code


def text_grams(normal: bytes, order: int):
    """gram_codes() piece by piece, so that a very long text needs bounded memory."""
    if len(normal) < PIECE:
        yield gram_codes(normal, order)
        return
    data = bytes([EDGE]) * order + normal + bytes([EDGE])
    for at in range(order, len(data), PIECE):
        part = data[at - order : at + PIECE]
        yield gram_codes(part[order:-1], order) if at == order and len(part) == len(data) else _inner(part, order)


def _inner(part: bytes, order: int) -> np.ndarray:
    data = np.frombuffer(part, dtype=np.uint8)
    n = len(data) - order
    code = np.zeros(n, dtype=np.int64)
    for i in range(order + 1):
        code = code << 8 | data[i : i + n]
    return code


class Counter:
    """Counts of numbers in training texts, and the numbers of other texts with a count of 0.

    Numbers are sorted and counted piece by piece; the pieces are merged now and then, so that memory follows the
    distinct numbers.
    """

    def __init__(self):
        self.waiting = {True: [], False: []}
        self.size = {True: 0, False: 0}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, train: bool) -> None:
        self.waiting[train].append(codes)
        self.size[train] += len(codes)
        if self.size[train] > PIECE:
            self._count(train)

    def _count(self, train: bool) -> None:
        if self.waiting[train]:
            keys, counts = np.unique(np.concatenate(self.waiting[train]).astype(np.int64), return_counts=True)
            self.parts.append((keys, counts * int(train)))
            self.waiting[train], self.size[train] = [], 0
            self.held += len(keys)
            if self.held > 4 * PIECE:
                self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        if not len(keys):
            self.parts, self.held = [(keys, np.zeros(0, dtype=np.int64))], 0
            return
        ranked = np.argsort(keys, kind="stable")
        keys = keys[ranked]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        counts = np.add.reduceat(np.concatenate([c for _, c in self.parts])[ranked], starts)
        self.parts, self.held = [(keys[starts], counts)], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) in ascending order."""
        self._count(True)
        self._count(False)
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._merge()
        return self.parts[0]


class Lookup:
    """Values by number, in an open table: every number asked for must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        at = np.full(1 << bits, -1, dtype=np.int32)
        left, place = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = at[place] < 0
            at[place[free]] = left[free]  # of several for one place one stays
            away = at[place] != left
            left, place = left[away], (place[away] + 1) & self.mask
        self.keys, self.values = np.full(1 << bits, -2, dtype=np.int64), np.zeros(1 << bits)
        full = at >= 0
        self.keys[full], self.values[full] = keys[at[full]], values[at[full]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        away = np.flatnonzero(self.keys[place] != keys)
        while len(away):
            place[away] = (place[away] + 1) & self.mask
            away = away[self.keys[place[away]] != keys[away]]
        return self.values[place]


def model_tables(counts: DataFrame, order: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per depth: grams (gram, c) and contexts (context, n, q, below).

    counts: gram, c > 0 of the greatest depth. n and q: occurrences and distinct symbols of the context; below: how
    often its symbols follow the context that is one byte shorter.
    """
    grams = {order: counts}
    for d in range(order - 1, -1, -1):
        keep = (1 << 8 * (d + 1)) - 1
        grams[d] = written(grams[d + 1].groupBy(F.col("gram").bitwiseAND(F.lit(keep)).alias("gram")).agg(F.sum("c").alias("c")), "ppm-depth")
    tables = {}
    for d in range(order, -1, -1):
        own = grams[d]
        if d:
            keep = (1 << 8 * d) - 1
            lower = grams[d - 1].select(F.col("gram").alias("shorter"), F.col("c").alias("c_below"))
            own = own.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(keep)))
            # At depth 0 there are at most 256 grams and at depth 1 at most 65,536.
            own = own.join(F.broadcast(lower) if d <= 2 else lower, "shorter")
        else:
            own = own.withColumn("c_below", F.lit(0).cast("long"))
        contexts = own.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("q"), F.sum("c_below").alias("below"))
        tables[d] = grams[d], written(contexts, "ppm-contexts")
    return tables


def gram_scores(unseen: DataFrame, tables: dict, order: int) -> DataFrame:
    """gram, value: log10 of the probability of the gram's last byte after the others, for all grams of the model and
    those of unseen (gram), which the model has not at its greatest depth."""
    grams, contexts = tables[order]
    top = F.shiftright("gram", 8).alias("context")
    seen = grams.select("gram", "c", top).join(contexts, "context").select("gram", F.log10((2 * F.col("c") - 1) / (2.0 * F.col("n"))).alias("value"))
    state = unseen.select("gram", top).join(contexts, "context", "left").select(
        "gram",
        F.coalesce(F.log10(F.col("q") / (2.0 * F.col("n"))), F.lit(0.0)).alias("value"),
        F.coalesce("below", F.lit(0)).alias("ex_n"),
        F.coalesce("q", F.lit(0)).alias("ex_q"),
        F.lit(False).alias("done"),
    )
    for d in range(order - 1, -1, -1):
        grams, contexts = tables[d]
        keep = F.lit((1 << 8 * (d + 1)) - 1)
        state = state.withColumn("key", F.col("gram").bitwiseAND(keep)).withColumn("context", F.shiftright("key", 8))
        grams = grams.select(F.col("gram").alias("key"), "c")
        # Proven bounds: at most 65,536 grams up to depth 1 and 65,536 contexts up to depth 2.
        state = state.join(F.broadcast(grams) if d <= 1 else grams, "key", "left")
        state = state.join(F.broadcast(contexts) if d <= 2 else contexts, "context", "left")
        n, q = F.col("n") - F.col("ex_n"), F.col("q") - F.col("ex_q")
        known = F.col("n").isNotNull() & ~F.col("done")
        step = F.when(~known, 0.0).when(F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / (2.0 * n))).when(n > 0, F.log10(q / (2.0 * n))).otherwise(0.0)
        state = state.select(
            "gram",
            (F.col("value") + step).alias("value"),
            F.when(known, F.col("below")).otherwise(F.col("ex_n")).alias("ex_n"),
            F.when(known, F.col("q")).otherwise(F.col("ex_q")).alias("ex_q"),
            (F.col("done") | (known & F.col("c").isNotNull())).alias("done"),
        )
    rest = F.log10(1.0 / F.greatest(F.lit(1), 256 - F.col("ex_q")))
    return seen.unionByName(state.select("gram", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + rest).alias("value")))


#: Keys of one table: grams of up to 7 bytes are below WORDS, words above it by their hash; ENDS counts texts.
WORDS, ENDS = 1 << 62, -1


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 2 | WORDS for w in words), dtype=np.int64, count=len(words))


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending keys as gaps and their values, compressed."""
    raw = np.diff(keys, prepend=np.int64(0)).tobytes() + values.astype("<f8").tobytes()
    return len(keys).to_bytes(4, "little") + zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = np.ascontiguousarray(np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(8, 2 * n).T)
    return np.cumsum(raw[:n].view("<i8").ravel()), raw[n:].view("<f8").ravel()


def score_documents(docs: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = 5, block_mb: float = 32) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train: a condition over the columns of docs; rows where it holds are learned from. Texts are lower-cased (A-Z); null
    is empty. base_score: add-one unigram model over words and an end; score: log10 probability of the text's bytes and
    its end. Nothing to learn from gives every byte the same probability. An empty table gives no rows.

    Every block of rows sends its distinct grams and words with their training counts, and gets back the scores of just
    those; so neither the driver nor a broadcast holds the model. order: at most 6.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, size = text_bytes(slim)
    blocks = block_count(size + rows, block_mb, 6)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")  # a task per block

    def texts_of(table: pa.Table):
        for batch in table.to_batches():
            yield from zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), (bytes(v).lower() for v in text_views(batch.column("text"))), strict=True)

    def gather(table: pa.Table) -> pa.Table:
        counts, ends = Counter(), 0
        for _, learn, normal in texts_of(table):
            ends += learn
            for codes in text_grams(normal, order):
                counts.add(codes, learn)
            counts.add(word_keys(normal.split()), learn)
        counts.add(np.array([ENDS]), False)
        keys, n = counts.merged()
        n[0] = ends  # ENDS is the least number
        return pa.table({"block": np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int32), "key": keys, "n": n})

    found = bucketed(dealt.groupBy("block").applyInArrow(gather, "block int, key long, n long"), "key", "ppm")
    totals = written(found.groupBy("key").agg(F.sum("n").alias("c")), "ppm-totals")
    words = totals.where(F.col("key") >= WORDS)
    n_words, n_distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_ends = totals.where(F.col("key") == ENDS).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_all, n_kinds = int(n_words + n_ends), int(n_distinct + (n_ends > 0))
    grams = totals.where((F.col("key") >= 0) & (F.col("key") < WORDS)).withColumnRenamed("key", "gram")
    scores = gram_scores(grams.where("c = 0"), model_tables(grams.where("c > 0"), order), order).withColumnRenamed("gram", "key")
    values = scores.unionByName(words.select("key", F.col("c").cast("double").alias("value")))

    def send(batches):
        """The rows of each block, packed."""
        for batch in batches:
            block, keys, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "key", "value"))
            ranked = np.lexsort((keys, block))
            starts = np.flatnonzero(np.diff(block[ranked], prepend=-1))
            parts = np.split(ranked, starts[1:]) if len(ranked) else []
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[p[0]]) for p in parts], pa.int32()), "data": pa.array([packed(keys[p], value[p]) for p in parts], pa.binary())})

    joined = found.select("block", "key").join(values, "key").select("block", "key", "value").sortWithinPartitions("block")
    wanted = joined.mapInArrow(send, "block int, data binary").repartitionById(blocks, "block")
    floor = float(np.log10(1.0 / (n_all + n_kinds + 1)))

    def apply(table: pa.Table, known: pa.Table) -> pa.Table:
        parts = [unpacked(d) for d in known.column("data").to_pylist()]
        keys, values = (np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i in (0, 1))
        known_ = Lookup(keys.astype(np.int64), values)
        del parts, keys, values
        end = float(np.log10(n_ends + 1))
        out = {name: [] for name in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for doc_id, learn, normal in texts_of(table):
            counts = known_[word_keys(normal.split())]
            n_tokens = len(counts) + 1
            score = sum(float(known_[part].sum()) for part in text_grams(normal, order))
            base = float(np.log10(counts + 1).sum()) + end + n_tokens * floor
            n_known = int((counts > 0).sum()) + int(n_ends > 0)
            for name, value in zip(out, (doc_id, not learn, n_tokens, n_known, n_all, base, score), strict=True):
                out[name].append(value)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def ppm_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """score_documents() with the rows whose crc32(key) mod 7 is 2 held out."""
    return score_documents(docs, crc_mod(key, 7) != 2, key)
