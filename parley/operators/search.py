"""Vectors of speakers, quotes in passages, and how good a search is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import squeezed
from .bitmaps import bitmap_bytes, in_bitmap, row_bitmap
from .graph import stored

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for other lengths, empty vectors, near zero norms and numbers that aren't finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 1e-12), dot(a, b) / norm).otherwise(0.0)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def nearest(vectors: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """The n vectors most alike to one query vector (one row: q), by cosine and then id. n is the size of the report."""
    scored = vectors.join(F.broadcast(query), F.lit(True)).select("vec_id", "contact_id", cosine(F.col("vec"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(n)


def centroids(vectors: DataFrame, key: str = "contact_id") -> DataFrame:
    """The normalised mean vector of each key; keys whose mean is zero are left out."""
    parts = vectors.select(key, F.posexplode("vec").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.withColumn("norm", norm).where("norm > 1e-12").select(key, F.transform("mean", lambda x: x / F.col("norm")).alias("vec"))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """hit_rate and mrr over queries. results: query_id, item, rank from 1; relevant: query_id, item."""
    first = results.where(F.col("rank") <= k).join(relevant, ["query_id", "item"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    asked = relevant.select("query_id").distinct().join(first, "query_id", "left")
    return asked.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


#: Words of an item under which it meets passages.
GRAM = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _runs(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch (hs: hashes of words) and the hashes of their runs of n words."""
    lists = batch.column("hs")
    lengths, words = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words)) >= n)
    run = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        run = (run ^ words[at + k]) * _FACTOR
        run ^= run >> np.uint64(29)
    return row[at], run


def _keys(batches):
    """item_id, item, h of items (and n): the least hash of a run of n words."""
    for batch in batches:
        least = np.full(batch.num_rows, np.iinfo(np.int64).max)
        own = batch.column("n").to_numpy()
        for n in np.unique(own):
            row, run = _runs(batch, int(n))
            mine = own[row] == n
            np.minimum.at(least, row[mine], run[mine].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), pa.array(least)], names=["item_id", "item", "h"])


def occurrences(passages: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, passage_id: the passages in which the words of an item (lower-cased) stand in a row, as whole words.

    An item meets passages under one run of GRAM of its words, or under all of them if it has fewer; a bitmap of these
    runs (16 MB at most) leaves out other runs where they are made. What met is verified on the texts. Items without
    words occur nowhere.
    """
    split = lambda: F.filter(F.split(squeezed(F.col("text")), " "), lambda w: w != "")
    hashes = lambda ws: F.transform(ws, lambda w: F.xxhash64(w)).alias("hs")
    own = items.select("item_id", F.concat(F.lit(" "), F.array_join(split(), " "), F.lit(" ")).alias("item"), hashes(split()))
    own = stored(own.withColumn("n", F.least(F.lit(GRAM), F.size("hs"))).where("n > 0"))
    lengths = [r.n for r in own.select("n").distinct().collect()]  # GRAM at most
    if not lengths:
        return passages.select(F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"), "passage_id").where(F.lit(False))
    keys = stored(own.mapInArrow(_keys, StructType([own.schema["item_id"], own.schema["item"], StructField("h", LongType())])))
    rows = keys.count()
    known = passages.sparkSession.sparkContext.broadcast(bitmap_bytes(row_bitmap(keys, "h", rows), rows))

    def told(batches):
        bits = np.frombuffer(known.value, dtype=np.uint8)
        for batch in batches:
            found = [_runs(batch, n) for n in lengths]
            row, run = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            place = run & np.uint64(8 * len(bits) - 1)
            met = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            h, order = run[met].view(np.int64), row[met]
            yield pa.RecordBatch.from_arrays([batch.column("passage_id").take(pa.array(order)), pa.array(h)], names=["passage_id", "h"])

    runs = passages.select("passage_id", hashes(split())).mapInArrow(told, StructType([passages.schema["passage_id"], StructField("h", LongType())]))
    met = runs.join(keys.select("item_id", "h"), "h")
    pairs = stored(met.select("item_id", "passage_id").distinct())
    found = row_bitmap(pairs.select(F.xxhash64("passage_id").alias("h")), "h", rows)
    texts = in_bitmap(passages.select("passage_id", "text"), F.xxhash64("passage_id"), found, rows, "met").where("met")
    whole = F.concat(F.lit(" "), F.array_join(split(), " "), F.lit(" "))
    return pairs.join(texts.select("passage_id", whole.alias("whole")), "passage_id").join(keys.select("item_id", "item"), "item_id").where(F.contains("whole", "item")).select("item_id", "passage_id")


#: Vectors of a cell that one task compares with as many others, the vectors for which there is one pivot, and so many
#: pivots at most. They steer the cost, never the links.
BLOCK, FOR_A_PIVOT, MOST_PIVOTS = 4096, 2048, 1024


def link_cell(least: float):
    """For applyInPandas: links a, b that join what all similar pairs of a cell join; across sides only, if kind is 0."""
    import numpy as np
    import pandas as pd

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        unit = np.array(cell["vec"].tolist(), dtype=np.float64)
        norms = np.sqrt((unit * unit).sum(1))
        unit /= norms[:, None]
        ids, sides, within, out = cell["vec_id"].to_numpy(), cell["side"].to_numpy(), bool(cell["kind"].iloc[0]), []
        lonely = [((unit[i : i + 512] @ unit.T) >= least - 1e-9).sum(1) < 2 for i in range(0, len(ids), 512)]
        left = np.flatnonzero(~np.concatenate(lonely))
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                seed = front.pop()
                both = norms[left] * norms[seed]
                near = (unit[left] @ unit[seed] >= least - 1e-12) & (both > 1e-12) & np.isfinite(both)
                near &= within | (sides[left] != sides[seed])
                got, left = left[near], left[~near]
                front.extend(got.tolist())
                out += [(ids[i], ids[seed]) for i in got]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def similar_links(vectors: DataFrame, least: float) -> DataFrame:
    """a, b: links between vectors (vec_id, vec) that join just what all pairs with a cosine of at least `least` join.

    Equal vectors are linked to the first and compared as one. Each vector lives in the cell of the pivot of the least
    angle and visits the cells of later pivots unless no vector there can be alike: the angle to the pivot exceeds the
    cell's largest by more than that of `least` (triangle inequality), or the plane between both pivots is further away
    than alike vectors are. Cells are compared in blocks. Without clusters nothing is spared and all pairs are compared.
    """
    import numpy as np
    import pyarrow as pa

    usable = vectors.where(F.forall("vec", lambda x: x.isNotNull())).withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec")))).where("norm > 0 and not isnan(norm) and norm < double('infinity')")
    first = stored(usable.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.first("norm").alias("norm")))
    equal = usable.where("norm * norm > 1e-12").join(first.select("vec", F.col("vec_id").alias("b")), "vec").select(F.col("vec_id").alias("a"), "b").where("a <> b")
    few = max(1, min(MOST_PIVOTS, first.count() // FOR_A_PIVOT))
    chosen = [np.array(r.vec) / r.norm for r in first.orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).collect()]  # MOST_PIVOTS rows at most
    by_size: dict[int, tuple] = {}
    for size in {len(x) for x in chosen}:
        numbers = [i for i, x in enumerate(chosen) if len(x) == size]
        by_size[size] = np.array(numbers), np.array([chosen[i] for i in numbers])

    def homes(batches):
        for batch in batches:
            home, angle = [], []
            for vec, norm in zip(batch.column("vec").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                if len(vec) not in by_size:
                    home.append(-len(vec))  # a size without a pivot is a cell of its own
                    angle.append(0.0)
                    continue
                numbers, pivots = by_size[len(vec)]
                cosines = pivots @ (np.array(vec) / norm)
                home.append(int(numbers[cosines.argmax()]))
                angle.append(float(np.arccos(min(1.0, max(-1.0, cosines.max())))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), batch.column("norm"), pa.array(home, pa.int64()), pa.array(angle, pa.float64())], names=["vec_id", "vec", "norm", "home", "angle"])

    kind = first.schema["vec_id"].dataType.simpleString()
    lived = stored(first.select("vec_id", "vec", "norm").mapInArrow(homes, f"vec_id {kind}, vec array<double>, norm double, home long, angle double"))
    reach = {r.home: r.reach for r in lived.groupBy("home").agg(F.max("angle").alias("reach")).where("home >= 0").collect()}  # a row for each pivot

    def visits(batches):
        alike, apart = np.arccos(least), np.sqrt(2 - 2 * least)
        for batch in batches:
            out = []
            for vec, norm, home in zip(batch.column("vec").to_pylist(), batch.column("norm").to_pylist(), batch.column("home").to_pylist(), strict=True):
                if home < 0:
                    out.append([])
                    continue
                numbers, pivots = by_size[len(vec)]
                cosines, own = pivots @ (np.array(vec) / norm), int(np.searchsorted(numbers, home))
                limits = np.array([reach.get(int(q), -10.0) for q in numbers])
                far = np.arccos(np.clip(cosines, -1, 1)) > limits + alike + 1e-6
                between = np.maximum(np.sqrt(((pivots - pivots[own]) ** 2).sum(1)), 1e-12)
                far |= (cosines[own] - cosines) / between > apart + 1e-3
                out.append(numbers[~far & (numbers > home)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), batch.column("home"), pa.array(out, pa.list_(pa.int64()))], names=["vec_id", "vec", "home", "cells"])

    went = stored(lived.mapInArrow(visits, f"vec_id {kind}, vec array<double>, home long, cells array<long>"))
    own = went.select(F.col("home").alias("cell"), F.lit(0).alias("side"), "vec_id", "vec")
    guests = went.select(F.explode("cells").alias("cell"), F.lit(1).alias("side"), "vec_id", "vec")
    sizes = own.select("cell", "side").unionByName(guests.select("cell", "side")).groupBy("cell").agg(*(F.ceil(F.sum((F.col("side") == x).cast("long")) / BLOCK).cast("int").alias(f"k{x}") for x in (0, 1)))
    sizes = stored(sizes)
    number = lambda k: F.pmod(F.xxhash64("vec_id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    met = own.join(sizes, "cell").withColumn("n", number("k0"))
    inner = met.withColumn("o", every("k0")).where("k0 = 1 or n <> o").select(F.lit(1).alias("kind"), "cell", F.least("n", "o").alias("i"), F.greatest("n", "o").alias("j"), "side", "vec_id", "vec")
    hosts = met.where("k1 > 0").withColumn("o", every("k1")).select(F.lit(0).alias("kind"), "cell", F.col("n").alias("i"), F.col("o").alias("j"), "side", "vec_id", "vec")
    come = guests.join(sizes, "cell").withColumn("n", number("k1")).withColumn("o", every("k0")).select(F.lit(0).alias("kind"), "cell", F.col("o").alias("i"), F.col("n").alias("j"), "side", "vec_id", "vec")
    cells = inner.unionByName(hosts).unionByName(come)
    links = cells.groupBy("kind", "cell", "i", "j").applyInPandas(link_cell(least), "a long, b long")
    return links.unionByName(equal.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
