"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Where its rows lie, each block hashes its texts and sends every owner of a hash range its sorted distinct hashes, as
   Golomb-Rice coded gaps, with a bit for each hash that the block itself holds twice. Texts don't move.
2. An owner merges what it got and answers every block with a bitmap: which of its hashes occur more than once.
3. Only texts behind a set bit (the suspects) are shuffled and compared byte for byte; equal ones are counted before the
   shuffle, so a text that a third of all rows share sends one row per task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, in_bitmap, join_groups, row_bitmap, written

#: Rows of a block at most.
BLOCK_ROWS = 200_000


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted unsigned values as Golomb-Rice coded gaps.

    Layout: one byte with the parameter k; the quotients in unary; the k-bit remainders. bits is the width of a value.
    """
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = min(bits, max(0, int(math.log2(mean)) if mean >= 1 else 0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary)
    return bytes([k]) + len(head).to_bytes(4, "little") + head.tobytes() + np.packbits(remainders.ravel()).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    k, head = code[0], int.from_bytes(code[1:5], "little")
    unary = np.unpackbits(np.frombuffer(code, np.uint8, head, 5))
    ends = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=5 + head))[: n * k].reshape(n, k).astype(np.uint64)
        gaps += (rest << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def answer_messages(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner's messages (block, n, code, twice) to bitmaps: bit i is set if the i-th hash occurs more than once in all."""
    parts = [golomb_decode(code, n) for code, n in zip(messages["code"], messages["n"], strict=True)]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    own = [np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(messages["twice"], messages["n"], strict=True)]
    repeated = np.bincount(inverse, weights=np.concatenate(own), minlength=len(counts)) > 0
    twice = ((counts > 1) | repeated)[inverse]
    bitmaps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(p) for p in parts])[:-1])]
    return messages[["owner", "block", "n"]].assign(bitmap=bitmaps)


def normal_text(text: str | Column) -> Column:
    """What equal texts share: A-Z lower-cased, null as the empty text."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


MARKS = "block long, line long, doc_id long, hash long, text_sha256 string, owner long, n long, code binary, twice binary"


def marked_rows(docs: DataFrame, key: str, text: str, owner_rows: int) -> tuple[DataFrame, int]:
    """(a written table with block, line, doc_id, hash, text_sha256 and suspect of every row, the number of rows)."""
    rows = docs.count()
    owners = max(1, math.ceil(rows / owner_rows))
    bits = min(56, max(24, math.ceil(math.log2(rows + 2)) + 14))  # of a fingerprint; one false suspect in 2^14 rows
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), normal_text(text).alias("normal"))
    thin = slim.select("doc_id", F.xxhash64("normal").alias("hash"), F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"))
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "binary": pa.binary()}.get(x.split()[1], pa.int64())) for x in MARKS.split(", ")])

    def send(batches):
        """The rows, numbered, and after those of a block its messages."""
        first = TaskContext.get().partitionId() << 24
        number, line, held = first, 0, []

        def told():
            distinct, counts = np.unique(np.concatenate(held), return_counts=True)
            to = ((distinct >> np.uint64(max(0, bits - 32))) * np.uint64(owners) >> np.uint64(min(32, bits))).astype(np.int64)
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            own, twice = np.split(distinct, starts[1:]), np.split(counts > 1, starts[1:])
            columns = {"block": [number] * len(own), "owner": to[starts], "n": [len(p) for p in own], "code": [golomb_encode(p, bits) for p in own], "twice": [np.packbits(t).tobytes() for t in twice]}
            return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(len(own), f.type)) for f in schema}, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if line + part.num_rows > BLOCK_ROWS and held:
                    yield told()
                    number, line, held = number + 1, 0, []
                n = part.num_rows
                held.append(part.column("hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits))
                columns = {"block": np.full(n, number), "line": np.arange(line, line + n)} | {c: part.column(c) for c in ("doc_id", "hash", "text_sha256")}
                yield pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in schema}, schema=schema)
                line += n
        if held:
            yield told()

    sent = written(thin.mapInArrow(send, MARKS), "exact-sent")
    messages = sent.where("owner is not null").select("owner", "block", "n", "code", "twice")
    bitmaps = messages.groupBy("owner").applyInPandas(answer_messages, "owner long, block long, n long, bitmap binary")

    def mark(own: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of a block with what the owners say of their hashes."""
        answers = sorted(answers.to_pylist(), key=lambda a: a["owner"])
        flags = np.concatenate([np.unpackbits(np.frombuffer(a["bitmap"], np.uint8), count=a["n"]) for a in answers])
        hashes = own.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        _, inverse = np.unique(hashes, return_inverse=True)
        return own.append_column("suspect", pa.array(flags[inverse].astype(bool)))

    names = ["block", "line", "doc_id", "hash", "text_sha256"]
    own = sent.where("owner is null").select(names)
    marked = own.groupBy("block").cogroup(bitmaps.groupBy("block")).applyInArrow(mark, "block long, line long, doc_id long, hash long, text_sha256 string, suspect boolean")
    return written(marked, "exact-marked"), rows


def suspect_texts(docs: DataFrame, text: str, marked: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """docs with a column (its name is returned) that is true for all suspects, and for few other rows."""
    name = fresh(docs, "suspect")
    return in_bitmap(docs, F.xxhash64(normal_text(text)), row_bitmap(marked.where("suspect").select("hash"), "hash", rows), rows, name), name


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", owner_rows: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is the empty text. Of equal texts the row with
    the largest key stays; a null key loses to any other. Of rows with both text and key equal exactly one is kept.
    An empty table gives no rows; texts may be of any length. Further columns of docs, whatever their names, are not read.
    """
    marked, rows = marked_rows(docs, key, text, owner_rows)
    flagged, name = suspect_texts(docs, text, marked, rows)
    same = flagged.where(F.col(f"`{name}`")).select(normal_text(text).alias("normal")).groupBy("normal").agg(F.count(F.lit(1)).alias("n"))
    same = same.select(F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"), "n").groupBy("text_sha256").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    best = marked.where("suspect").groupBy("text_sha256").agg(F.max(F.struct("doc_id", "block", "line")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    sure = F.when((F.col("texts") == 1) & (F.col("n") == F.col("group_size")), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one digest differ, or the table changed")))
    groups = written(best.join(same, "text_sha256").select("text_sha256", "best", sure.alias("group_size")).where("group_size > 1"), "exact-groups")
    joined = join_groups(marked.select("block", "line", "doc_id", "text_sha256"), groups, "text_sha256", "group_size", rows)
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("best.block") == F.col("block")) & (F.col("best.line") == F.col("line")))).alias("kept"),
        "text_sha256",
    )


def keep_first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", owner_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup() keeps: one of each set of equal texts.

    Rows behind no set bit stay where they are; suspects meet by their bytes and the best of each text stays. Nulls,
    ties, repeated rows, empty and very long texts and an empty table are as in exact_dedup(); columns may have any name.
    """
    marked, rows = marked_rows(docs, key, text, owner_rows)
    flagged, name = suspect_texts(docs, text, marked, rows)
    suspect, columns = F.col(f"`{name}`"), [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    best = flagged.where(suspect).groupBy(normal_text(text).alias(name)).agg(F.max_by(F.struct(*columns), rank).alias("row")).select("row.*")
    return flagged.where(~suspect).select(*columns).unionByName(best)
