"""Bitmaps of bounded size that spare shuffles, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of a row_bitmap() at most: 16 MB, whatever the number of rows.
MOST_BITS = 27


def _bits(rows: int) -> int:
    return min(MOST_BITS, max(15, (16 * max(1, rows)).bit_length()))


def _place(value: Column, rows: int) -> Column:
    """A place from 1 to the bits of the bitmap for so many rows."""
    return F.pmod(value, F.lit(1 << _bits(rows))) + 1


def row_bitmap(hashes: DataFrame, column: str, rows: int) -> DataFrame:
    """bucket, bits: a bitmap of hashes in pieces of 4 KB; at most 2^MOST_BITS bits for any number of rows.

    It only spares work: with more rows than bits, more of them pass in_bitmap() and meet the exact test after it.
    """
    place = hashes.select(_place(F.col(column), rows).alias("p"))
    return place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def bitmap_bytes(bitmap: DataFrame, rows: int) -> bytes:
    """A row_bitmap() in one piece (16 MB at most): the bit of a hash h is bit h mod 8 of byte (h mod bits) / 8."""
    out = bytearray(1 << (_bits(rows) - 3))
    for r in bitmap.toLocalIterator():
        out[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def in_bitmap(df: DataFrame, hash_: Column, bitmap: DataFrame, rows: int, name: str) -> DataFrame:
    """df with the boolean column `name`: whether the hash of the row is in the bitmap (which is broadcast: 16 MB at most)."""
    at, bucket, bits = (fresh(df, x) for x in ("bit_at", "bit_bucket", "bit_set"))
    placed = df.withColumn(at, _place(hash_, rows))
    placed = placed.withColumn(bucket, F.bitmap_bucket_number(F.col(at))).withColumn(at, F.bitmap_bit_position(F.col(at)).cast("int"))
    joined = placed.join(F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left")
    test = F.expr(f"shiftright(cast(conv(hex(substring(`{bits}`, `{at}` div 8 + 1, 1)), 16, 10) as int), `{at}` % 8) & 1 = 1")
    return joined.withColumn(name, F.coalesce(test, F.lit(False))).drop(at, bucket, bits)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row per key, with its number of rows) without a hot task.

    Groups of over a thousandth of all rows are fewer than a thousand and are broadcast; the rest are joined by a
    shuffle in which no key has more rows than that. rows and groups should be written tables: each is read twice.
    """
    hot = groups.where(F.col(size) * 1000 > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * 1000 <= total), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)
