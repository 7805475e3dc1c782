"""Connected components of links between distinct keys.

Up to ``WHOLE`` links are one task's work, whose time and memory that bound limits: rounds of joins cost a small graph
some sixty stages of tasks that hold next to nothing.  More links go through alternating large and small stars.  Each
round is two aggregates and two equi-joins; a node with very many links is summed map-side first and its join is
one that adaptive execution can split.  Rounds end when the links are stars round each component's smallest key; their
number is logarithmic in the number of nodes.  Every round is a written table, so executors may be lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, written

WHOLE = 1 << 20


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the links (a, b) between 0..n-1 connect: each number that is not its component's smallest, and that one."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _whole(batches):
    """All links (a, b) to rows (node, root)."""
    links = [np.column_stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    names, number = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *links]), return_inverse=True)
    links.clear()
    a, b = number.reshape(-1, 2).T
    node, root = stars(len(names), a, b)
    label = np.arange(len(names))
    label[node] = root
    for at in range(0, len(names), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 16)]), pa.array(names[label[at : at + (1 << 16)]])], ["node", "root"])
    del names, number, a, b, node, root, label
    release()


def _star(pairs: DataFrame, emit) -> DataFrame:
    """pairs: (u, v), grouped by u; emit: the condition on the pairs whose v is linked to the smallest key round u."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u").where(emit).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b: bigint); root is the smallest node of its component.

    Self-links and repeated links do no harm; nodes without a link to another node may be absent; no links, no rows.
    """
    links = written(links.where("a <> b"), "links")
    if links.count() <= WHOLE:
        out = written(links.coalesce(1).mapInArrow(_whole, "node bigint, root bigint"), "components")
        forget(links)
        return out
    seen = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # The centre u itself is linked to the smallest key as well.
        small = _star(down.unionAll(down.select("u", F.col("u").alias("v")).distinct()), F.lit(True)).where("a <> b").distinct()
        following = written(small, "links")
        state = following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        forget(links)
        links = following
        if state == seen:
            break
        seen = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
