"""Byte-level BPE by recursive DuckDB queries, one DuckDB database per Spark task.

A text is split by the tokenizer's pattern. Words that the task hasn't met before become rows (word, position, token);
the recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of least
rank until no pair merges. Ordered aggregation turns positions back into lists, and token ids back into bytes.

A word of more than SHORT bytes is contracted in overlapping pieces. A token list is the encoding of its bytes if and
only if each two neighbouring tokens are the encoding of theirs, so pieces may be joined at any token that both have at
the same place; where two have none in common, they are contracted again as one longer piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_views

#: Words that a task remembers with their tokens, and the longest of them in characters.
REMEMBERED, LONGEST = 1_500_000, 64
#: Bytes of a word up to which it is contracted whole. Pieces of longer ones start every SHORT / 2 bytes.
SHORT = 64
#: Bytes of a query's words times those of the longest one.
HELD = 4_000_000
#: Words and tokens handled by one query.
WORDS, TOKENS = 20_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> pd.DataFrame:
    """Every way to join two tokens into a third: lhs, rhs, rank (the id of the result)."""
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pd.DataFrame(pairs, columns=["lhs", "rhs", "rank"])


# A row knows the position of its right neighbour; `code` is the rank of the pair, its
# position and its neighbour's in one number, so that the least code of a word is its leftmost pair of least rank.
CONTRACT = """
WITH RECURSIVE state(word, pos, token, next_pos, step) AS (
    SELECT word, pos, token, pos + 1, 0 FROM start
    UNION ALL (
    WITH pairs AS (
        SELECT a.*, b.next_pos AS after, (m.rank::BIGINT << 40) | (a.pos::BIGINT << 20) | a.next_pos AS code
        FROM state a LEFT JOIN state b ON b.word = a.word AND b.pos = a.next_pos
        LEFT JOIN merges m ON m.lhs = a.token AND m.rhs = b.token
    ), least AS (
        SELECT word, min(code) AS best FROM pairs GROUP BY word HAVING min(code) IS NOT NULL
    )
    SELECT word, pos, CASE WHEN pos = ((best >> 20) & 1048575) THEN (best >> 40)::INT ELSE token END,
           CASE WHEN pos = ((best >> 20) & 1048575) THEN after ELSE next_pos END, step + 1
    FROM pairs JOIN least USING (word) WHERE pos <> (best & 1048575)
    )
)
SELECT word, list(token ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) last USING (word, step)
GROUP BY word
"""

DECODE = """
SELECT doc, array_to_string(list(v.hex ORDER BY t.pos), '') AS hex
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY doc ORDER BY doc
"""


class Codec:
    """Encodes and decodes by a rank table (bytes of a token to its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.known = ranks, {}
        self.size_of = dict(zip(ranks.values(), map(len, ranks), strict=True))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.split = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.db.execute("SET enable_progress_bar = false")
        merges = merge_rows(ranks)  # noqa: F841  read by DuckDB
        self.db.execute("CREATE TABLE merges AS SELECT lhs::INT AS lhs, rhs::INT AS rhs, rank::INT AS rank FROM merges")
        vocabulary = pd.DataFrame({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INT AS id, hex FROM vocabulary")

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, in order: a word that is a token is that token, others are contracted."""
        out = [[self.ranks[w]] if w in self.ranks else None for w in words]
        short = [i for i, x in enumerate(out) if x is None and len(words[i]) <= SHORT]
        for i, ids in zip(short, self._contracted([words[i] for i in short]), strict=True):
            out[i] = ids
        long_ = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(long_, self._long([words[i] for i in long_]), strict=True):
            out[i] = ids
        return out

    def _contracted(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words, from queries of bounded size: a query holds every step of its words."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            end, held = at, 0
            while end < len(order) and (end == at or (held + len(words[order[end]])) * len(words[order[end]]) <= HELD):
                held += len(words[order[end]])
                end += 1
            part = [words[i] for i in order[at:end]]
            sizes = np.array([len(w) for w in part])
            raw = np.frombuffer(b"".join(part), dtype=np.uint8)
            word = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            pos = (np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            self.db.register("start", pa.table({"word": word, "pos": pos, "token": self.single[raw]}))
            for i, ids in self.db.execute(CONTRACT).fetchall():
                out[order[at + i]] = ids
            self.db.unregister("start")
            at = end
        return out

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """The ids of long words, joined from those of their pieces; the pieces of a word grow until all neighbours have a
        token in common."""
        out: list[list[int]] = [[]] * len(words)
        known: list[dict] = [{} for _ in words]  # of each word: piece to its tokens with their places
        size = dict.fromkeys(range(len(words)), SHORT)
        tries = dict.fromkeys(size, 0)
        pieces = {i: pieces_of(len(words[i]), SHORT) for i in size}
        while size:
            new = [(i, p) for i in size for p in dict.fromkeys(pieces[i]) if p not in known[i]]
            for (i, (a, b)), ids in zip(new, self._contracted([words[i][a:b] for i, (a, b) in new]), strict=True):
                starts = a + np.append(0, np.cumsum([self.size_of[x] for x in ids])[:-1])
                known[i][a, b] = list(zip(starts.tolist(), ids, strict=True))
            for i in list(size):
                cuts, joined = joints(pieces[i], known[i])
                tries[i] += 1
                if len(cuts) == len(pieces[i]) - 1:
                    starts, ends = [0, *cuts], [*cuts, len(words[i])]
                    out[i] = [x for p, a, b in zip(pieces[i], starts, ends, strict=True) for at, x in known[i][p] if a <= at < b]
                    del size[i]
                elif tries[i] % 3:
                    pieces[i] = joined
                else:
                    size[i] *= 2
                    known[i], pieces[i] = {}, pieces_of(len(words[i]), size[i])
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Remembers the ids (little-endian 32-bit numbers) of words, from queries of bounded size. Returns the ids of
        those too long to be remembered."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        long_, batch, held = {}, [], 0

        def flush():
            for w, ids in zip(batch, self.contract([w.encode() for w in batch]), strict=True):
                (self.known if len(w) <= LONGEST else long_)[w] = struct.pack(f"<{len(ids)}I", *ids)

        for w in new:
            batch.append(w)
            held += len(w)
            if len(batch) >= WORDS or held >= TOKENS // 8:
                flush()
                batch, held = [], 0
        if batch:
            flush()
        return long_

    def encode(self, texts: list[str]):
        """For each text its ids as arrays, piece by piece; words that several texts share are contracted once."""
        for group in _groups(texts, 1 << 20):
            if len(group) == 1:
                words = (m.group() for m in self.split.finditer(group[0]))
                pieces = []
                while part := list(islice(words, TOKENS)):
                    pieces.append(self._ids(part, self.learn(set(part))))
                yield pieces
                continue
            split = [self.split.findall(t) for t in group]
            long_ = self.learn(set().union(*split))
            for part in split:
                yield [self._ids(part, long_)]

    def _ids(self, words: list[str], long_: dict[str, bytes]) -> np.ndarray:
        known = self.known
        ids = [known[w] if w in known else long_[w] for w in words] if long_ else map(known.__getitem__, words)
        return np.frombuffer(b"".join(ids), dtype="<u4")

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list, by ordered aggregation."""
        sizes = np.array([len(x) for x in ids])
        if not sizes.sum():
            return [b""] * len(ids)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        flat = np.concatenate(ids).astype(np.int32)
        self.db.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("tokens")
        return [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]


def _groups(texts: list[str], size: int):
    """Neighbouring texts of up to size characters together; a longer text alone."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > size:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """Overlapping pieces of n bytes: one of `size` bytes every size / 2."""
    return [(at, min(n, at + size)) for at in range(0, max(1, n - size // 2), size // 2)]


def joints(pieces: list, known: dict) -> tuple[list[int], list]:
    """(where neighbouring pieces are joined: at a token that both have, near the middle of what they share; the pieces
    with those made one that have none)."""
    cuts, joined, least = [], [pieces[0]], 0
    for before, piece in zip(pieces[:-1], pieces[1:], strict=True):
        common = [t for t, _ in set(known[piece]).intersection(known[before]) if t > least]
        if common:
            middle = (piece[0] + before[1]) / 2
            least = min(common, key=lambda t: (abs(t - middle), t))
            cuts.append(least)
            joined.append(piece)
        elif joined[-1] == before:
            joined[-1] = (before[0], piece[1])
        else:  # the piece before has just become longer; this one is looked at again
            joined.append(piece)
    return cuts, joined


_CODECS: dict[tuple, Codec] = {}


def codec_of(ranks: dict[bytes, int], pattern: str) -> Codec:
    """A Python worker's codec, kept over tasks."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) per row. A null or empty text has no ids; special tokens are ordinary text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # a vocabulary: its size doesn't follow the rows

    def run(batches):
        codec = codec_of(*shared.value)
        for batch in batches:
            ids = codec.encode([str(v, "utf-8") for v in text_views(batch.column("text"))])
            for at in range(0, batch.num_rows, 64):
                some = [np.concatenate(p) if p else np.zeros(0, "<u4") for p in islice(ids, 64)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)), pa.array([x.astype(np.int32) for x in some], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, decoded (binary) per row of doc_id, ids."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        codec = codec_of(*shared.value)
        for batch in batches:
            ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in batch.column("ids")]
            for at in range(0, len(ids), 64):
                some = ids[at : at + 64]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)), pa.array(codec.decode(some), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def bpe_report(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded again in the same task.

    A null text is empty and has no ids; equal texts and repeated rows give equal answers, each row its own. Texts and
    unbroken words may be of any length. An empty table gives no rows; further columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        codec = codec_of(*shared.value)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = [str(v, "utf-8") for v in text_views(batch.column("text"))]
            out, waiting, held = [], [], 0

            def flush():
                for (k, n, digest), raw in zip([w[:3] for w in waiting], codec.decode([w[3] for w in waiting]), strict=True):
                    out.append((k, n, digest, hashlib.sha256(raw).hexdigest()))

            for k, pieces in zip(keys, codec.encode(texts), strict=True):
                if sum(map(len, pieces)) > TOKENS:  # a very long text: hashed piece by piece
                    ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
                    for p in pieces:
                        ids.update(p.tobytes())
                        raw.update(codec.decode([p])[0])
                        n += len(p)
                    out.append((k, n, ids.hexdigest(), raw.hexdigest()))
                    continue
                ids = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
                waiting.append((k, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), ids))
                held += len(ids)
                if held > TOKENS:
                    flush()
                    waiting, held = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
