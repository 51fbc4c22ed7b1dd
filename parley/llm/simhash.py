"""SimHash near-duplicates found by a generalised pigeonhole.

The 64 bits of a fingerprint are dealt into m parts, correlated bits together. If two fingerprints differ in at most t
bits and the thresholds t_i of the parts add up to t - m + 1, they differ in at most t_i bits in some part (-1: the part
is not probed). A dynamic program chooses m and unequal t_i by the rows that probes need and the candidates expected
from them. Fingerprints meet under the keys of their parts and are verified on all bits.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, small_batches, text_views, written
from ..operators.graph import components

BITS = 64
SEED = 42
#: Words hashed at once, so that very long texts need bounded memory.
PIECE = 1 << 15


def shingle_hashes(view, words_each: int):
    """XXH64 of each shingle of a text, piece by piece: A-Z lower-cased, words without ASCII white space."""
    words = bytes(view).lower().split()
    if not words:
        return
    if len(words) < words_each:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - words_each + 1, PIECE):
        part = words[at : at + PIECE + words_each - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        n = len(part) - words_each + 1
        yield np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words_each - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint_of(hashes) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without any."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for part in hashes:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) per row; a null text is empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = [fingerprint_of(shingle_hashes(v, words_each)) for v in text_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


# ---- the plan -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    mask: int
    threshold: int  # bits in which a probe may differ within the part


def bit_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size; each grows from its most correlated pair by the bit closest to the group."""
    left, groups = set(range(BITS)), []
    strength = np.abs(correlation) - np.eye(BITS)
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        sub = strength[np.ix_(rest, rest)]
        first = rest[int(sub.max(1).argmax())]
        group = [first]
        left.discard(first)
        while len(group) < size:
            rest = sorted(left)
            nearest = rest[int(strength[np.ix_(rest, group)].mean(1).argmax())]
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds (one per part, from costs[i]) that add up to total, by dynamic programming over parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in own.items():
                if used + t not in then or cost + more < then[used + t][0]:
                    then[used + t] = (cost + more, [*chosen, t])
        best = then
    return best.get(total, (float("inf"), []))


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def plan(fps: DataFrame, tolerance: int, most_parts: int = 4, probes: int = 512, row_cost: float = 40.0) -> list[Part]:
    """Parts and thresholds for the distinct fingerprints in fps (column fp).

    Bit correlations come from all fingerprints; candidate counts from up to about `probes` of them against all. Both
    only steer the cost: any allocation finds every link. row_cost: a shuffled row in units of a verified candidate.
    """

    def moments(batches):
        joint, single, n = np.zeros((BITS, BITS)), np.zeros(BITS), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            joint += bits.T @ bits
            single += bits.sum(0)
            n += len(x)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "both": joint.ravel(), "rows": np.full(BITS * BITS, float(n))})

    got = fps.mapInArrow(moments, "i long, j long, both double, rows double").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("rows").alias("rows")).toPandas()
    n = float(got["rows"].max()) if len(got) else 0.0
    if n < 2:
        return []
    joint = np.zeros((BITS, BITS))
    joint[got["i"], got["j"]] = got["both"] / n
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(np.outer(mean * (1 - mean), mean * (1 - mean)), 1e-12))
    correlation = (joint - np.outer(mean, mean)) / spread
    options = [[mask_of(g) for g in bit_groups(correlation, m)] for m in range(1, min(most_parts, tolerance + 1) + 1)]
    masks = sorted({x for o in options for x in o})
    every = max(1, int(n // probes))
    chosen = np.array([r.fp for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(4 * probes).collect()], dtype=np.int64).view(np.uint64)

    def distances(batches):
        counts = np.zeros((len(masks), tolerance + 1))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 4096):
                apart = x[at : at + 4096, None] ^ chosen
                for k, mask in enumerate(masks):
                    d = np.bitwise_count(apart & np.uint64(mask))
                    for t in range(tolerance + 1):
                        counts[k, t] += (d <= t).sum()
        k, t = np.indices(counts.shape)
        yield pa.RecordBatch.from_pydict({"k": k.ravel(), "t": t.ravel(), "n": counts.ravel()})

    met = fps.mapInArrow(distances, "k long, t long, n double").groupBy("k", "t").agg(F.sum("n").alias("n")).collect()
    candidates = {(masks[r.k], r.t): r.n / max(1, len(chosen)) * n for r in met}
    best: tuple[float, list[Part]] = (float("inf"), [])
    for option in options:
        costs = []
        for mask in option:
            width, own = mask.bit_count(), {-1: 0.0}
            for t in range(tolerance + 1):
                own[t] = row_cost * n * sum(comb(width, d) for d in range(t + 1)) + candidates[mask, t]
            costs.append(own)
        cost, thresholds = allocate(costs, tolerance - len(option) + 1)
        if cost < best[0]:
            best = cost, [Part(m, t) for m, t in zip(option, thresholds, strict=True) if t >= 0]
    return best[1]


# ---- probing and verifying ------------------------------------------------------------------------------------------


def flips(part: Part) -> np.ndarray:
    """All masks within the part of 1 to threshold bits."""
    bits = [b for b in range(BITS) if part.mask >> b & 1]
    return np.array([mask_of(x) for d in range(1, part.threshold + 1) for x in itertools.combinations(bits, d)], dtype=np.uint64)


def link_run(fps: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one run as all links within tolerance would, one per joined fingerprint."""
    left, a, b = fps, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            seed, front = front[0], front[1:]
            near = np.bitwise_count(left ^ seed) <= tolerance
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), seed, dtype=np.uint64))
                b.append(got)
                front = np.concatenate([front, got])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_runs(runs: np.ndarray, fps: np.ndarray, tolerance: int, short: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal numbers in `runs` (ascending). Long runs are joined by link_run()."""
    starts = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1)) if len(runs) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(runs)))
    a, b = [], []
    long_ = np.repeat(sizes > short, sizes)
    for start, size in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        x, y = link_run(np.unique(fps[start : start + size]), tolerance)
        a.append(x)
        b.append(y)
    runs, fps = runs[~long_], fps[~long_]
    for s in range(1, min(short, int(sizes.max(initial=1)))):
        same = np.flatnonzero(runs[s:] == runs[:-s])
        if not len(same):
            break
        x, y = fps[same], fps[same + s]
        near = (np.bitwise_count(x ^ y) <= tolerance) & (x != y)
        a.append(x[near])
        b.append(y[near])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, tolerance: int) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that differ in at most tolerance bits.

    They connect exactly what all such links connect; within a key that many fingerprints share, one link per
    fingerprint is given instead of all pairs.
    """
    parts = plan(fps, tolerance)
    masks = [(np.uint64(p.mask), flips(p)) for p in parts]

    def keys(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (mask, around) in enumerate(masks):
                step = max(1, 200_000 // (len(around) + 1))
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    key = some & mask
                    every, owner = np.concatenate([key, (key[:, None] ^ around).ravel()]), np.concatenate([some, np.repeat(some, len(around))])
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(every), number, dtype=np.int32), "key": every.view(np.int64), "fp": owner.view(np.int64)})

    def verify(batches):
        kept: list[np.ndarray] = []  # the run that the next batch may go on with
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "fp")]
            got = [np.concatenate([k, g]) for k, g in zip(kept, got, strict=True)] if kept else got
            new = np.append(True, (np.diff(got[0]) != 0) | (np.diff(got[1]) != 0))
            last = int(np.flatnonzero(new)[-1])
            yield found(np.cumsum(new)[:last], got[2][:last])
            kept = [g[last:] for g in got]
        if kept:
            yield found(np.ones(len(kept[2]), dtype=np.int64), kept[2])

    def found(runs, fps_):
        a, b = link_runs(runs, np.ascontiguousarray(fps_).view(np.uint64), tolerance)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    if not parts:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    met = fps.mapInArrow(keys, "part int, key long, fp long").repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return met.mapInArrow(verify, "a long, b long")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 3, tolerance: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest key reachable by links).

    Fingerprints link at tolerance or fewer differing bits, equal ones always. A null or empty text has fingerprint
    zero and links like any other. Repeated rows are rows of the same component; an empty table gives no rows.
    """
    marked = written(fingerprints(docs, key, text, words_each), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    joined = written(components(links(nodes.select("fp"), tolerance)), "simhash-components")
    lowest = joined.join(nodes, joined["node"] == nodes["fp"]).select("node", "root", "least")
    groups = lowest.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = lowest.join(groups, "root").select(F.col("node").alias("fp"), "component_id")
    named = written(nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    return join_groups(marked, named, "fp", "rows", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
