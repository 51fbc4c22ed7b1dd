"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitmaps import fresh, in_bitmap, join_groups, row_bitmap  # noqa: F401
from ..operators.graph import shared_folder
from ..operators.graph import stored as written  # noqa: F401

#: Letters whose case the operators fold; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by key: later groupings and joins by it need no shuffle."""
    spark = df.sparkSession
    parts = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(table)
    read = spark.table(table)
    read.schema  # noqa: B018  resolved here, as the catalog forgets the table; its files stay
    spark.sql(f"DROP TABLE `{table}`")
    return read


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bounds what one Arrow batch brings into a Python worker, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of all texts): two numbers."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(size)


def block_count(size: int, block_mb: float, least: int = 1) -> int:
    return max(least, math.ceil(size / (block_mb * (1 << 20))))


def text_views(column) -> list[memoryview]:
    """The UTF-8 bytes of each row of an Arrow string column, without a copy; null is empty."""
    column = column.cast("string") if str(column.type) != "string" else column
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4", count=len(column) + 1 + column.offset)[column.offset :]
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def crc_mod(key: str, divisor: int):
    """crc32 of the key as text, modulo divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor
