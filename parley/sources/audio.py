"""WAV files as arrays of mono samples, through Spark's binary file source."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, rate int, channels int, samples array<float>"


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples as the mean of channels from -1 to 1) of 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
        return w.getframerate(), w.getnchannels(), (raw.astype(np.float32) / 32768).mean(1)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """Every .wav below path. A file is decoded in one task; long recordings are stored as chunk files."""

    def read(batches):
        for batch in batches:
            rows = [(p, *decode(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, SCHEMA)


def chunk_index(path: Column) -> Column:
    """The number of the chunk folder that a file lies in."""
    return F.regexp_extract(path, r"/(\d+)/[^/]*$", 1).try_cast("int")


def slice_of(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples from start to end (seconds), held to what there is."""
    first = F.greatest(F.lit(0), F.floor(start * rate)).cast("int")
    last = F.least(F.size(samples), F.floor(end * rate).cast("int"))
    return F.slice(samples, first + 1, F.greatest(F.lit(0), last - first))


def joined(chunks: DataFrame, key: str) -> DataFrame:
    """key, rate, samples: the chunks (idx, rate, samples) of each key one after another; other rates than the first
    are an error."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "rate", "samples")))
    made = chunks.groupBy(key).agg(ordered.alias("c"), F.count_distinct("rate").alias("rates"))
    return made.select(key, F.col("c")[0]["rate"].alias("rate"), F.when(F.col("rates") == 1, F.flatten(F.transform("c", lambda x: x["samples"]))).otherwise(F.raise_error(F.lit("chunks of several rates"))).alias("samples"))


def rms(samples: Column) -> Column:
    """Root mean square, from 0 to 1; 0 for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.when(F.size(samples) > 0, F.least(F.lit(1.0), F.sqrt(total / F.size(samples)))).otherwise(0.0)


def peaks(samples: Column, rate: Column, start: Column, end: Column, n: int) -> Column:
    """The largest magnitude in each of n equal parts of the stretch from start to end (seconds), over the largest of
    all. Samples after the last whole part are left out; parts beyond the stretch are 0, and so is all of silence."""

    def of(part: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.size(part) / n).cast("int"))
        top = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_max(F.transform(F.slice(part, i * width + 1, width), lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
        return F.transform(F.array(top), lambda t: F.when(F.array_max(t) > 0, F.transform(t, lambda x: x / F.array_max(t))).otherwise(t))[0]

    return F.transform(F.array(slice_of(samples, rate, start, end)), of)[0]


def wav_bytes(samples: Column, rate: Column) -> Column:
    """Mono samples as 16-bit WAV files: held to -1..1, scaled and cut to whole numbers."""

    def one(xs, hz):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(hz))
            w.writeframes((np.clip(np.asarray(xs, dtype=float), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    @F.pandas_udf("binary")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([one(x, hz) for x, hz in zip(s, r, strict=True)])

    return run(samples, rate)


def wav_samples(data: Column) -> Column:
    """struct(rate, channels, samples) of WAV files held in a column."""

    @F.pandas_udf("struct<rate:int,channels:int,samples:array<float>>")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(d)) for d in files], columns=["rate", "channels", "samples"])

    return run(data)


def duration_ms(samples: Column, rate: Column) -> Column:
    return F.floor(F.size(samples) * 1000 / rate).cast("long")


def duration_by_size(data: Column) -> Column:
    """Seconds of a WAV file by its size and the byte rate in its header, whatever the header says of the data's size;
    null for what is no WAV file or has no byte rate."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("double")
    rate = byte(29) + byte(30) * 256 + byte(31) * 65536 + byte(32) * 16777216
    ok = (F.octet_length(data) >= 44) & (F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 9, 4)) == "57415645") & (rate > 0)
    return F.when(ok, (F.octet_length(data) - 44) / rate)


def slice_or_error(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """slice_of(), where an end at or before the start is an error."""
    return F.when(end > start, slice_of(samples, rate, start, end)).otherwise(F.raise_error(F.lit("the end of a slice isn't after its start")))


def promoted_roots(files: DataFrame) -> DataFrame:
    """files (call_id, chunk_idx, path; the file of the whole call has no chunk_idx): a whole file becomes chunk 0 where
    other chunks exist and chunk 0 doesn't."""
    chunks = files.where("chunk_idx is not null")
    lacking = chunks.groupBy("call_id").agg(F.min("chunk_idx").alias("least")).where("least > 0").select("call_id")
    whole = files.where("chunk_idx is null")
    moved = whole.join(lacking, "call_id", "left_semi").withColumn("chunk_idx", F.lit(0).cast(files.schema["chunk_idx"].dataType))
    return chunks.unionByName(moved.select(files.columns)).unionByName(whole.join(lacking, "call_id", "left_anti").select(files.columns))
