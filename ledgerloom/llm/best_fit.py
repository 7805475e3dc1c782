"""Variable-capacity best-fit packing.

Documents go, longest first, to the open sequence whose room fits them best.  Several sequence lengths are permitted;
where nothing fits, a bin is opened at the least-cost length of a set that holds the piece, and every bin is finally
downsized to the shortest permitted length that holds its contents.  Which lengths to open is optimised jointly: every
set of permitted lengths with the longest in it is tried in each shard, and the one of the least total cost wins.  A bin
of c tokens costs c + c * c / ATTENTION: the linear part of a step and its attention.

Texts longer than the longest sequence are cut into pieces of that length and a rest, so nothing is dropped.  Shards of
about ``shard_rows`` pieces are packed apart, by a digest of the document's identity; their number grows with the input,
and each leaves a few bins part full, a loss of the order of 1 / shard_rows.  Equal rows are counted, then numbered, so that
many of them are spread over the shards like any others.

Defined results: a text of length 0 or null takes no room and has no bin (null bin_id, capacity 0); equal rows are packed
each by itself; null doc_id is an id like any other; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, repeated, written
from .fair_mix import SIZE

CAPACITIES = (256, 512, 1024, 2048, 4096)
ATTENTION = 32768
SHARD_ROWS = 50_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION


def _packed(sizes: list[int], opened: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (descending), and what each bin holds."""
    room_of: list[list[int]] = [[] for _ in range(opened[-1] + 1)]  # open bins by room
    some = bytearray(opened[-1] + 1)  # 1 where room_of has a bin
    bins, offsets, held = [], [], []
    for size in sizes:
        room = some.find(1, size)
        if room < 0:
            room, b = min((c for c in opened if c >= size), key=cost), len(held)
            held.append(0)
        else:
            b = room_of[room].pop()
            if not room_of[room]:
                some[room] = 0
        bins.append(b)
        offsets.append(held[b])
        held[b] += size
        if room > size:
            room_of[room - size].append(b)
            some[room - size] = 1
    return bins, offsets, held


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (positive, at most the longest capacity), and the capacity of each bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best = None
    for opened in (x for k in range(len(capacities)) for x in combinations(capacities[:-1], k)):
        bins, offsets, held = _packed([sizes[i] for i in order], (*opened, capacities[-1]))
        final = [min(c for c in capacities if c >= h) for h in held]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, offsets, final
    _, bins, offsets, final = best
    at = np.empty(len(sizes), np.int64)
    at[order] = np.arange(len(sizes))
    return [bins[i] for i in at], [offsets[i] for i in at], final


def best_fit(df: DataFrame, size: str, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, size, piece, start, length, bin_id, offset, capacity``, a row per piece of each row of ``df``.

    ``size``: SQL for a row's tokens.  bin_id is shard * 2 ** 32 + number within the shard.
    """
    capacities = tuple(sorted(capacities))
    longest = capacities[-1]
    rows = df.select("doc_id", F.expr(f"cast({size} as bigint)").alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    rows = written(rows.groupBy("doc_id", "size", "h").agg(F.count(F.lit(1)).alias("n")), "pack-rows")
    pieces = repeated(rows.where("size > 0"), "n", "copy").select("doc_id", "size", "h", "copy", F.explode(F.expr(f"sequence(0L, (size - 1) div {longest})")).alias("piece"))
    n = rows.agg(F.sum(F.expr(f"n * ((greatest(size, 0) + {longest - 1}) div {longest})"))).first()[0] or 0
    pieces = pieces.select(
        "doc_id", "size", "piece", F.expr(f"piece * {longest}").alias("start"), F.expr(f"least({longest}, size - piece * {longest})").alias("length"),
        F.expr(f"pmod(xxhash64(h, copy, piece), {max(1, -(-n // shard_rows))})").alias("shard"),
    )

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(shard["length"].tolist(), capacities)
        return shard.assign(
            bin_id=(shard["shard"].to_numpy() << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64), capacity=np.array(final, np.int64)[bins],
        ).drop(columns="shard")

    # Arrow hands a column with nulls to pandas as floats, which would round large ids.
    pieces = pieces.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    schema = "doc_id bigint, known boolean, size bigint, piece bigint, start bigint, length bigint, bin_id bigint, offset bigint, capacity bigint"
    out = pieces.groupBy("shard").applyInPandas(packed, schema).withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
    none = repeated(rows.where("size <= 0"), "n", "copy").selectExpr("doc_id", "size", "0L AS piece", "0L AS start", "0L AS length", "cast(null as bigint) AS bin_id", "0L AS offset", "0L AS capacity")
    return out.unionByName(none)


def query(spark, sf_dir):
    return best_fit(documents(spark, sf_dir).select("doc_id", "text"), SIZE)
