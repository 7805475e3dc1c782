"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have four segments of 16 bits on a ring.  If two differ in at most 3 bits, some chain of consecutive
segments starts at which every prefix of l segments differs in at most floor(3 l / 4) bits: none in the first, one in
the first two, two in the first three.  So such a pair agrees in one segment and in one half of the next one, which is
the key of eight tables; the longer chains prune what meets in a bucket before the full Hamming check.

Scale: equal texts meet in one distinct fingerprint, by a partial aggregate.  Buckets are runs of a sorted partition,
compared in blocks by numpy, and give a spanning set of links, never all pairs.  A bucket of more than ``HOT_BUCKET``
fingerprints is split by a second key (one of four tenths-of-bits pieces that at most three differences leave equal);
above ``ENUMERATE`` in such a part, neighbours are looked up by flipping up to three of the free bits, whose cost is
linear.  All ways are exact.

Defined results: null text is an empty text, whose fingerprint is zero and links like any other; equal rows share
fingerprint and component; null doc_id is never a component's name unless no other is there; an empty table gives none.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_udf, written
from .components import components

MAX_BITS = 3
SHINGLE = 3
HOT_BUCKET = 2000
ENUMERATE = 200_000
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The contract's 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, 42)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, bits = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        stop = min(n, at + _BLOCK)
        h = np.array([digest(line[a : b - 1], 42) for a, b in zip(ends[at:stop], ends[at + SHINGLE : stop + SHINGLE])], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _signed_fingerprints(texts: list[str | None]) -> list[int]:
    return np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64).tolist()


_fingerprints = text_udf(T.LongType(), _signed_fingerprints)


def fingerprint_column(text):
    """The fingerprint as a bigint with the same bits."""
    return _fingerprints(text)


def _flips(free: int) -> np.ndarray:
    bits = [1 << b for b in range(64) if free >> b & 1]
    return np.array([sum(c) for k in (1, 2, 3) for c in combinations(bits, k)], dtype=np.uint64)


def _joined(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def bucket_links(x: np.ndarray, start: int, free: int) -> list[tuple[int, int]]:
    """Links (indices) that span the Hamming graph within one bucket of distinct fingerprints.

    ``start``: the ring segment that the bucket's fingerprints share; ``free``: the bits that may differ.
    """
    n = len(x)
    ring = [0xFFFF << 16 * ((start + k) % 4) for k in range(4)]
    two, three = np.uint64(ring[0] | ring[1]), np.uint64(ring[0] | ring[1] | ring[2])
    parent, out = np.arange(n), []

    def link(i: int, j: int) -> None:
        a, b = _joined(parent, i), _joined(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    if n > ENUMERATE:
        order = np.argsort(x)
        y = x[order]
        for flip in _flips(free):
            at = np.minimum(np.searchsorted(y, y ^ flip), n - 1)
            for i in np.flatnonzero((y[at] == y ^ flip) & (at > np.arange(n))):
                link(int(order[i]), int(order[at[i]]))
        return out
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count((x[at : at + step, None] ^ x[None, at:]) & two) <= 1)
        i, j = i[i < j] + at, j[i < j] + at
        d = x[i] ^ x[j]
        good = np.bitwise_count(d & three) <= 2
        i, j, d = i[good], j[good], d[good]
        good = np.bitwise_count(d) <= MAX_BITS
        i, j = i[good], j[good]
        for a, b in zip(i.tolist(), j.tolist()):
            link(a, b)
    return out


def _bucket_runs(batches):
    """Rows (t, key, fp) sorted by (t, key) to links (a, b); a run of equal keys is a bucket."""
    held: list[pd.DataFrame] = []

    def links(rows: pd.DataFrame):
        key, t, x = rows["key"].to_numpy(), rows["t"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1])) + 1).tolist(), len(key)]
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                for i, j in bucket_links(x[lo:hi], int(t[lo]) // 2 % 4, _free_bits(int(t[lo]))):
                    a.append(lo + i)
                    b.append(lo + j)
        signed = x.view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[b]})

    for rows in batches:
        if len(rows):
            last = rows.iloc[-1]
            tail = (rows["key"] == last["key"]) & (rows["t"] == last["t"])
            done = rows[~tail]
            if len(done) == 0 and held and held[0].iloc[0]["key"] == last["key"] and held[0].iloc[0]["t"] == last["t"]:
                held.append(rows)
                continue
            yield links(pd.concat([*held, done]))
            held = [rows[tail]]
    if held:
        yield links(pd.concat(held))


def _segment(fp: str, k: int) -> str:
    return f"(shiftrightunsigned({fp}, {16 * (k % 4)}) & 65535L)"


def _half(k: int, half: int) -> int:
    return 0xFF << (16 * (k % 4) + 8 * half)


def _free_bits(t: int) -> int:
    """Table t < 8: segment t // 2 and half t % 2 of the next are fixed.  Above: also piece t // 8 - 1 of the rest."""
    start, half = t % 8 // 2, t % 2
    free = ~((0xFFFF << 16 * start) | _half(start + 1, half)) & ((1 << 64) - 1)
    return free & ~_piece(t % 8, t // 8 - 1) if t >= 8 else free


def _piece(table: int, k: int) -> int:
    """The k-th quarter of a table's 40 free bits, as a mask."""
    free = _free_bits(table)
    bits = [1 << b for b in range(64) if free >> b & 1]
    return sum(bits[10 * k : 10 * k + 10])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that span the graph of distinct fingerprints ``fp`` at 3 or fewer differing bits."""
    tables = ", ".join(f"struct({2 * i + h} AS t, {_segment('fp', i)} << 8 | (shiftrightunsigned({_segment('fp', i + 1)}, {8 * h}) & 255L) AS key)" for i in range(4) for h in range(2))
    index = fps.select("fp", F.expr(f"inline(array({tables}))"))
    sizes = index.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = written(index.join(sizes, ["t", "key"]), "ring-index")
    hot = found.where(F.col("n") > HOT_BUCKET)
    # Of 40 free bits in four pieces, three differences leave one piece equal; its value extends the key.
    pieces = ", ".join("CASE t {} END".format(" ".join(f"WHEN {t} THEN struct(t + {8 * (k + 1)} AS t, xxhash64(key, fp & {_signed(_piece(t, k))}L) AS key)" for t in range(8))) for k in range(4))
    parts = hot.select("fp", F.expr(f"inline(array({pieces}))"))
    rows = found.where(F.col("n") <= HOT_BUCKET).select("t", "key", "fp").unionByName(parts.select("t", "key", "fp"))
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInPandas(_bucket_runs, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp, th, root, component_id`` for each row of ``df`` (doc_id, text).

    component_id is the smallest doc_id reachable, root a fingerprint that names the component where ids are null too, th
    a 64-bit digest of the text, which with doc_id tells rows apart.
    """
    rows = written(df.select("doc_id", fingerprint_column(F.col(text)).alias("fp"), F.xxhash64(text).alias("th")), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(links(fps.select("fp")))
    roots = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = roots.select("fp", "root").join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return rows.join(named, "fp").select("doc_id", "fp", "th", "root", "component_id")


def query(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
