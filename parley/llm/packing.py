"""Best-fit packing into sequences of several permitted lengths.

Documents are cut at the largest length. Groups of pieces are packed on their own: longest first, each into the open
bin that it fills best; if none fits, the bin size of least expected cost is opened. At the end each bin shrinks to the
smallest permitted length that holds its contents. Several opening policies are tried and the cheapest result stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (256, 512, 1024, 2048)
    fixed: float = 32.0  # cost of a sequence of any length, in tokens
    quadratic: float = 1 / 8192  # cost of attention for each token pair, in tokens
    group_pieces: int = 20_000  # pieces packed together, about; the number of groups grows with the table
    hot_rows: int = 1_000  # the rows of a key with more than these are dealt over the groups each on its own

    def cost(self, size: int) -> float:
        return self.fixed + size + self.quadratic * size * size


def word_tokens(text: Column) -> Column:
    """Words and one end-of-document token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1


class OpenBins:
    """Open bins by the room they have left; the fullest that still fits is found from a bit set of rooms."""

    def __init__(self):
        self.rooms, self.at = 0, {}

    def put(self, room: int, bin_: int) -> None:
        if room > 0:
            self.at.setdefault(room, []).append(bin_)
            self.rooms |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of the least room of at least length, the oldest such bin first."""
        fitting = self.rooms >> length
        if not fitting:
            return None
        room = length + (fitting & -fitting).bit_length() - 1
        bins = self.at[room]
        bin_ = bins.pop(0)
        if not bins:
            del self.at[room]
            self.rooms &= ~(1 << room)
        return room, bin_


def opened(length: int, rest: int, sizes: list[int], settings: Settings) -> int:
    """The permitted size of least cost per token that it may come to hold; rest: tokens still to be placed."""
    return min((s for s in sizes if s >= length), key=lambda s: (settings.cost(s) / min(s, rest), s))


def pack(lengths: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, size of each bin) for lengths in descending order, the cheapest of the opening policies."""
    best = None
    for least in sorted(settings.sizes):
        sizes = [s for s in sorted(settings.sizes) if s >= least]
        open_, bins, held, rest = OpenBins(), np.empty(len(lengths), dtype=np.int64), [], int(lengths.sum())
        for i, n in enumerate(lengths.tolist()):
            got = open_.take(n)
            if got is None:
                size = opened(n, rest, sizes, settings)
                got = size, len(held)
                held.append(0)
            room, b = got
            bins[i] = b
            held[b] += n
            rest -= n
            open_.put(room - n, b)
        final = np.array([min(s for s in settings.sizes if s >= h) for h in held], dtype=np.int64)
        total = sum(settings.cost(s) for s in final.tolist())
        if best is None or total < best[0]:
            best = total, bins, final
    return best[1], best[2]


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), tokens: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_size, bin_tokens, position (of the piece in its bin).

    tokens: the length of a row (default: words and an end token, so that null and empty texts have 1; a length under
    1 gives no piece). Ties are broken by key and piece. Repeated rows are packed each on its own, those of a key that
    many share (null too) in several groups; an empty table gives no rows. Other columns are not read.
    """
    largest = max(settings.sizes)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (word_tokens(F.col(text)) if tokens is None else tokens).cast("long").alias("length"))
    # A row's place is stored with it, so that a repeated task deals it alike.
    rows = written(rows.where("length > 0").withColumn("place", F.monotonically_increasing_id()), "packing")
    pieces = int(rows.agg(F.coalesce(F.sum(F.ceil(F.col("length") / largest)), F.lit(0))).first()[0])
    groups = max(1, math.ceil(pieces / settings.group_pieces))
    often = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > settings.hot_rows).select(F.col("doc_id").alias("often_id"), F.lit(True).alias("often"))
    rows = rows.join(often, F.col("doc_id").eqNullSafe(F.col("often_id")), "left").withColumn("place", F.when(F.col("often"), F.col("place")))
    cut = rows.select("doc_id", "length", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(largest).cast("long"))).alias("start"))
    cut = cut.select("doc_id", "start", "place", F.least(F.col("length") - F.col("start"), F.lit(largest)).alias("n_tokens"))
    # A null place leaves the hash as it is: rows of other keys are dealt by key and start alone.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "place"), F.lit(groups))).drop("place")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, sizes = pack(group["n_tokens"].to_numpy(), settings)
        group["bin_size"] = sizes[bins]
        group["bin_tokens"] = group.groupby(bins)["n_tokens"].transform("sum")
        group["position"] = group.groupby(bins)["n_tokens"].cumsum() - group["n_tokens"]
        group["bin_id"] = group["group"].astype(str) + "-" + pd.Series(bins).astype(str)
        group["piece"] = group["start"] // largest
        return group[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_size", "bin_tokens", "position"]]

    return dealt.groupBy("group").applyInPandas(run, "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_size long, bin_tokens long, position long")
