"""WAV files by ranges of frames: the header is read first, then only the bytes that are asked for.

Files are opened through pyarrow's file systems by URI, so driver and executors see the same shared storage. Folders are
listed and headers read in tasks; the driver sees neither. No task holds more than a range, however long a recording is.

Recordings that are written stand in packs (.wavs): whole WAV files, each with its name in a LIST chunk, one behind the other.
A file of its own for each costs an inode, a block of the disk and two calls, and a folder has no room for tens of millions.
A recording of a pack has the path pack.wavs#start-end/name.wav, which is read like any other.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import stored

#: Frames of a batch, about; files of more than twice as many bytes are long.
TASK_FRAMES = 1 << 20
#: Bytes of a pack at most (a longer recording has a pack of its own), and those that are read of it at once.
PACK_BYTES, WINDOW = 2 * TASK_FRAMES, 1 << 18
PACKED = re.compile(r"(.*\.wavs)#(\d+)-(\d+)/.*", re.DOTALL)
RANGES = "path string, rate int, channels int, frames long, first long, samples array<float>"


@dataclass(frozen=True)
class Wav:
    rate: int
    channels: int
    kind: str  # numpy type of a sample
    at: int  # of the first frame
    frames: int

    @property
    def block(self) -> int:
        return self.channels * np.dtype(self.kind).itemsize


@lru_cache(maxsize=1024)
def _folder(uri: str):
    return stores.FileSystem.from_uri(uri)


def _located(uri: str):
    """The file system and the path of a URI; that of a folder is looked up once for all its plainly named files."""
    folder, _, name = uri.rpartition("/")
    if folder.endswith(("/", ":")) or not re.fullmatch(r"[\w.-]+", name, re.ASCII):
        return stores.FileSystem.from_uri(uri)
    store, path = _folder(folder)
    return store, f"{path.rstrip('/')}/{name}"


class Pack:
    """A file of which short stretches are read by windows, as what stands beside them is mostly asked for next."""

    def __init__(self, uri: str):
        store, path = _located(uri)
        self.uri, self.file = uri, store.open_input_file(path)
        self.whole, self.at, self.held = self.file.size(), 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if n > WINDOW // 4:
            return self.file.read_at(n, at)
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(WINDOW, max(0, self.whole - at)), at)
        return self.held[at - self.at : at - self.at + n]

    def close(self) -> None:
        self.file.close()


class Stretch:
    """The bytes of a pack from start to end, as a file of their own."""

    def __init__(self, pack: Pack, start: int, end: int, owned: bool = False):
        self.pack, self.start, self.end, self.owned = pack, start, min(end, pack.whole), owned

    def size(self) -> int:
        return max(0, self.end - self.start)

    def read_at(self, n: int, at: int) -> bytes:
        return self.pack.read_at(max(0, min(n, self.size() - at)), self.start + at)

    def close(self) -> None:
        if self.owned:
            self.pack.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def opened(uri: str, pack: Pack | None = None):
    """The file of a path; that of a recording in `pack`, if that is it, without opening it again."""
    packed = PACKED.fullmatch(uri)
    if packed:
        own = pack is None or pack.uri != packed[1]
        return Stretch(Pack(packed[1]) if own else pack, int(packed[2]), int(packed[3]), own)
    store, path = _located(uri)
    return store.open_input_file(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many parts as keep all cores busy: files that are small in bytes still take their time."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def header(file) -> Wav:
    """What a file says of itself: 16-bit PCM or 32-bit floats of any number of channels. A recording that was never
    finished (no size, or more than there is) goes to the end of its file; other content raises ValueError."""
    size, at, kind, rate, channels = file.size(), 12, None, 0, 0
    head = file.read_at(12, 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no WAV file")
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
            if tag == 0xFFFE and length >= 26:  # the real tag stands further on
                (tag,) = struct.unpack("<H", file.read_at(2, at + 32))
            kind = {(1, 16): "<i2", (3, 32): "<f4"}.get((tag, bits))
            if kind is None or not channels:
                raise ValueError(f"samples of format {tag} with {bits} bits and {channels} channels aren't read")
        if name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            there = size - at - 8
            length = there if not length or length > there else length
            return Wav(rate, channels, kind, at + 8, length // (channels * np.dtype(kind).itemsize))
        at += 8 + length + length % 2
    raise ValueError("no samples")


def frames_of(file, wav: Wav, first: int, n: int) -> np.ndarray:
    """n frames from the first on (as many as there are), channels folded to their mean."""
    first = min(max(0, first), wav.frames)
    n = max(0, min(n, wav.frames - first))
    raw = np.frombuffer(file.read_at(n * wav.block, wav.at + first * wav.block), wav.kind).reshape(-1, wav.channels).astype(np.float32)
    return (raw / np.float32(32768) if wav.kind == "<i2" else raw).mean(1, dtype=np.float32)


def named(name: str) -> bytes:
    """The LIST chunk that names a recording."""
    title = name.encode() + b"\0"
    title += b"\0" * (len(title) % 2)
    return struct.pack("<4sI4s4sI", b"LIST", 12 + len(title), b"INFO", b"INAM", len(title)) + title


def recordings_of(pack: Pack):
    """The path, the start and the end of each recording in a pack."""
    at = 0
    while at < pack.whole:
        head = pack.read_at(32, at)
        if len(head) < 32 or head[:4] != b"RIFF" or head[8:16] != b"WAVELIST" or head[20:28] != b"INFOINAM":
            raise ValueError("no pack of WAV files")
        size, length = struct.unpack("<4xI", head[:8])[0], struct.unpack("<I", head[28:])[0]
        name = pack.read_at(length, at + 32).rstrip(b"\0").decode()
        end = at + 8 + size
        if end > pack.whole:
            raise ValueError("a pack ends within a recording")
        yield f"{pack.uri}#{at}-{end}/{name}.wav", at, end
        at = end


def _root(uri: str) -> str:
    """What stands before a path of the URI's file system."""
    _, path = stores.FileSystem.from_uri(uri)
    return uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"


def _listed(spark: SparkSession, uri: str) -> DataFrame:
    """path, size of each .wav file and .wavs pack below a URI; the folders of a level are listed by as many tasks as there
    are cores."""
    store, path = stores.FileSystem.from_uri(uri)
    info, kind, root = store.get_file_info(path), "path string, size long, folder boolean", _root(uri)
    if info.type == stores.FileType.File:
        return spark.createDataFrame([(root + path, info.size)], "path string, size long")

    def look(batches):
        for batch in batches:
            for own in batch.column("path").to_pylist():
                at, inner = stores.FileSystem.from_uri(own)
                found = at.get_file_info(stores.FileSelector(inner))
                rows = [(root + f.path, f.size, f.type == stores.FileType.Directory) for f in found if f.type == stores.FileType.Directory or f.type == stores.FileType.File and f.path.lower().endswith((".wav", ".wavs"))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "size", "folder"])

    folders, levels = spark.createDataFrame([(root + path,)], "path string"), []
    while not levels or not folders.isEmpty():
        levels.append(stored(dealt(folders).mapInArrow(look, kind), "folders"))
        folders = levels[-1].where("folder").select("path")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("not folder").select("path", "size")


def wav_ranges(spark: SparkSession, uri: str, frames: int = 1 << 20, skip_unreadable: bool = False) -> DataFrame:
    """A row for each range of at most `frames` frames of each .wav file below a URI and of each recording in .wavs packs
    there. With skip_unreadable files that aren't WAV files are passed over; else they are an error. Short recordings are
    read by the task that opens them; the ranges of long ones are dealt to tasks of their own."""
    names = ["path", "rate", "channels", "frames", "first", "samples"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float32())]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def looked(path: str, read: bool, pack: Pack | None = None) -> list[tuple]:
        try:
            with opened(path, pack) as file:
                wav = header(file)
                starts = range(0, max(1, wav.frames), frames)
                return [(path, wav.rate, wav.channels, wav.frames, at, frames_of(file, wav, at, frames) if read else None) for at in starts]
        except (ValueError, OSError):
            if not skip_unreadable:
                raise
            return []

    def unpacked(path: str, read: bool):
        pack = None
        try:
            pack = Pack(path)
            for own, start, end in recordings_of(pack):
                if (end - start <= 2 * TASK_FRAMES) == read:
                    yield from looked(own, read, pack)
        except (ValueError, OSError):
            if not skip_unreadable:
                raise
        finally:
            if pack is not None:
                pack.close()

    def look(read: bool, each=looked):
        def run(batches):
            for batch in batches:
                rows, held = [], 0
                for path in batch.column("path").to_pylist():
                    for row in each(path, read):
                        rows.append(row)
                        held += 0 if row[5] is None else len(row[5])
                        if held >= TASK_FRAMES or len(rows) >= 10_000:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

        return run

    def fetch(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names[:5]), strict=True):
                with opened(row[0]) as file:
                    yield table([(*row, frames_of(file, header(file), row[4], frames))])

    packed = F.lower("path").endswith(".wavs")
    listed = _listed(spark, uri)
    files, packs = listed.where(~packed), listed.where(packed)
    short = dealt(files.where(F.col("size") <= 2 * TASK_FRAMES)).select("path").mapInArrow(look(True), RANGES)
    long = dealt(files.where(F.col("size") > 2 * TASK_FRAMES)).select("path").mapInArrow(look(False), RANGES)
    # Only a pack of more bytes can have a long recording.
    short = short.unionByName(dealt(packs).select("path").mapInArrow(look(True, unpacked), RANGES))
    long = long.unionByName(dealt(packs.where(F.col("size") > 2 * TASK_FRAMES)).select("path").mapInArrow(look(False, unpacked), RANGES))
    return short.unionByName(dealt(long).mapInArrow(fetch, RANGES))


def slices(wanted: DataFrame) -> DataFrame:
    """wanted (path, start_sec, end_sec and others) with rate and samples: only the bytes of a slice are read. Bounds are
    rounded to whole frames and held to what there is; an end before the start is an error, an equal one gives no samples."""
    kind = StructType([*wanted.schema.fields, *StructType.fromDDL("rate int, samples array<float>").fields])

    def read(batches):
        now, file, wav, pack = None, None, None, None
        for batch in batches:
            rates, samples = [], []
            for uri, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start_sec", "end_sec")), strict=True):
                if end < start:
                    raise ValueError(f"a slice of {uri} ends before it starts")
                if uri != now:  # slices of one file that follow each other open it once
                    if file is not None:
                        file.close()
                    packed = PACKED.fullmatch(uri)
                    if packed and (pack is None or pack.uri != packed[1]):
                        if pack is not None:
                            pack.close()
                        pack = Pack(packed[1])
                    file = opened(uri, pack)
                    now, wav = uri, header(file)
                first, last = (int(np.floor(min(max(0.0, x) * wav.rate, 2.0**62) + 0.5)) for x in (start, end))
                rates.append(wav.rate)
                samples.append(frames_of(file, wav, first, last - first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float32()))], names=[*batch.schema.names, "rate", "samples"])
        for x in (file, pack):
            if x is not None:
                x.close()

    return wanted.mapInArrow(read, kind)


def joined_ranges(parts: DataFrame, key: str) -> DataFrame:
    """key, rate, frames: the length of the recording that the chunk files (key, idx, uri) of each key make, by their
    headers. Chunks that can't be read are passed over; a key without a readable chunk, or with several rates, is an error."""

    def look(batches):
        for batch in batches:
            rate, frames = [], []
            for uri in batch.column("uri").to_pylist():
                try:
                    with opened(uri) as file:
                        wav = header(file)
                    rate.append(wav.rate)
                    frames.append(wav.frames)
                except (ValueError, OSError):
                    rate.append(None)
                    frames.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rate, pa.int32()), pa.array(frames, pa.int64())], names=[key, "rate", "frames"])

    kind = parts.schema[key].dataType.simpleString()
    made = parts.select(key, "uri").mapInArrow(look, f"{key} {kind}, rate int, frames long").groupBy(key).agg(F.min("rate").alias("low"), F.max("rate").alias("high"), F.sum("frames").alias("frames"))
    bad = F.when(F.col("low").isNull(), F.raise_error(F.lit("no chunk can be read"))).when(F.col("low") != F.col("high"), F.raise_error(F.lit("chunks of several rates")))
    return made.select(key, F.coalesce(bad.cast("int"), F.col("low")).alias("rate"), "frames")


def wav_bytes_of(name: str, rate: int, channels: int, is_float: bool, samples) -> bytes:
    """A whole WAV file: samples (mono) copied to channel 0 and halved in others, and its name."""
    x = np.asarray(samples, dtype=np.float64)
    x = np.stack([x] + [x / 2] * (channels - 1), axis=1)
    data = x.astype("<f4").tobytes() if is_float else (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    width, title = 4 if is_float else 2, named(name)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3 if is_float else 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(title) + len(data), b"WAVE") + title + fmt + struct.pack("<4sI", b"data", len(data)) + data


def write_wavs(recordings: DataFrame, folder: str) -> DataFrame:
    """path, frames: recordings (name, rate, channels, is_float, samples: mono, copied to channel 0 and halved in others)
    written to packs under a shared folder of their own, in the task that has them. A task that runs again writes the same
    packs anew, as its recordings are sorted by name; a pack stands under its name once it is whole."""

    def write(batches):
        task, number, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, []

        def packed():
            nonlocal number, held, size, rows
            store, path = _located(f"{folder}/{task:06d}-{number:06d}.wavs")
            made = f"{path}.{uuid.uuid4().hex}.part"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(made) as out:
                out.write(b"".join(held))
            store.move(made, path)
            paths = pa.array([f"{folder}/{task:06d}-{number:06d}.wavs#{start}-{end}/{name}.wav" for name, start, end, _ in rows], pa.string())
            batch = pa.RecordBatch.from_arrays([paths, pa.array([r[3] for r in rows], pa.int64())], names=["path", "frames"])
            number, held, size, rows = number + 1, [], 0, []
            return batch

        for batch in batches:
            for name, rate, channels, is_float, samples in zip(*(batch.column(c).to_pylist() for c in ("name", "rate", "channels", "is_float", "samples")), strict=True):
                file = wav_bytes_of(name, rate, channels, is_float, samples)
                if rows and size + len(file) > PACK_BYTES:
                    yield packed()
                held.append(file)
                rows.append((name, size, size + len(file), len(samples)))
                size += len(file)
        if rows:
            yield packed()

    rows = recordings.select("name", "rate", "channels", "is_float", "samples").sortWithinPartitions("name")
    return rows.mapInArrow(write, "path string, frames long")
