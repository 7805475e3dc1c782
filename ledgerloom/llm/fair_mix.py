"""Weighted fair queueing over sources.

Every document of a source, in a shuffled order that a digest of its identity fixes, gets a virtual finish time: the
source's tokens up to and with it, divided by the source's target weight.  Up to ``max_epochs`` passes of a source
follow each other.  All copies are sorted by finish time and cut where the total budget is spent; sources that run out
leave their share to the rest, which is the weighted water level.

Scale: cumulative sums run in two levels.  Rows are dealt to buckets of a source's shuffled order (a few thousand rows
each, however large the source), bucket totals are summed by a plain aggregate, and only totals meet in a window.  Equal
rows are one row with a count until they are numbered at the end, so that none of them crowds a bucket.  The global cut
works alike over equal slices of virtual time, at most ``MAX_SLICES``.  One window ranks the sources, a row each.
DataFrame expressions only.

Defined results: null text has size 0; null source is a source of its own, last in order; a document of size 0 takes 0;
equal rows tie and are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, documents, repeated, sql_regex, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 4000
MAX_SLICES = 1 << 20
#: What fixes a document's place in its source's shuffled order.
IDENTITY = "concat(coalesce(cast(doc_id as string), ''), ':', coalesce(text, ''))"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, rows, target, level`` from rows (source, size, n), n of them alike; one row per source.

    Sources saturate in the order of size / weight.  With the first k of them full, the rest would share what is left
    by weight, at a level that is never above the true one and equals it for the right k: the level is the largest.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.expr("size * n")).alias("source_size"), F.sum("n").alias("rows"))
    totals = totals.withColumn("rank", F.expr("row_number() OVER (ORDER BY source NULLS LAST)"))
    totals = totals.withColumn("weight", F.expr(f"get(array({', '.join(map(str, weights))}), pmod(rank - 1, {len(weights)}))"))
    by_level = "ORDER BY source_size / weight, rank"
    totals = totals.withColumn("grand", F.expr("sum(source_size) OVER ()"))
    totals = totals.withColumn("full_before", F.expr(f"coalesce(sum({max_epochs} * source_size) OVER ({by_level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    totals = totals.withColumn("weight_left", F.expr(f"sum(weight) OVER () - sum(weight) OVER ({by_level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + weight"))
    # The level, were this source the first that is not full.
    totals = totals.withColumn("at", F.expr("(grand - full_before) / weight_left"))
    totals = totals.withColumn("level", F.expr("max(at) OVER ()"))
    return totals.withColumn("target", F.expr(f"cast(least(cast({max_epochs} * source_size as double), level * weight) as double)")).select(
        "source", "source_size", "rows", "rank", "weight", "target", "level", "grand"
    )


def fair_mix(df: DataFrame, size: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS, keep=(), identity: str = IDENTITY) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, copies, taken`` for each row of ``df`` (doc_id, source, ...).

    ``size`` and ``identity`` are SQL expressions over df's columns.  ``copies`` is how often the mix holds the document.  ``row`` holds
    the columns of df named in ``keep``; texts need not travel along.
    """
    spark = df.sparkSession
    # Read once: the sizes feed the totals, the buckets and the result.
    rows = df.select("doc_id", "source", F.expr(f"cast({size} as bigint)").alias("size"), F.expr(f"md5({identity})").alias("h"), F.struct(F.lit(0).alias("_"), *[df[c] for c in keep]).alias("row"))
    rows = written(rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    targets = written(source_targets(rows, weights, max_epochs), "mix-targets")
    # Level one: buckets of about bucket_rows rows in each source's shuffled order (32 bits of the digest, in order).
    unit = "conv(substr(h, 1, 8), 16, 10)"
    placed = rows.join(targets, rows.source.eqNullSafe(targets.source)).select(
        "row", "doc_id", rows.source, "size", "h", "n", "source_size", "rank", "weight", "target", "grand", "level",
        F.expr(f"cast(floor(cast({unit} as double) * ceil(rows / {bucket_rows}) / 4294967296) as bigint)").alias("b"),
    )
    totals = placed.groupBy("source", "b").agg(F.sum(F.expr("size * n")).alias("bucket_size"))
    before = totals.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source").orderBy("b")) - F.col("bucket_size"))
    k = before.select(F.col("source").alias("s2"), F.col("b").alias("b2"), "before")
    placed = placed.join(k, placed.source.eqNullSafe(k.s2) & (placed.b == k.b2)).drop("s2", "b2")
    inside = W.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("upto", F.col("before") + F.sum(F.expr("size * n")).over(inside))
    placed = repeated(placed.drop("before", "b", "h"), "n", "i").withColumn("cum", F.expr("upto - size * (n - i)"))
    queue = written(placed.drop("upto", "n", "i"), "mix-queue")
    # Level two: every copy's finish time, in slices of virtual time.  The budget is spent in one of the slices round
    # the level, since each source lags by less than a document; rows are ordered in that slice alone.
    n = min(MAX_SLICES, max(1, -(-queue.count() // bucket_rows)))
    finish = "((epoch * source_size + cum) / weight)"
    copies = queue.where("size > 0").select("size", "grand", "level", "rank", "source_size", "cum", "weight", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", F.expr(finish)).withColumn("slice", F.expr(f"cast(floor(finish / level * {n}) as bigint)"))
    slices = copies.groupBy("slice").agg(F.sum("size").alias("slice_size"), F.max("grand").alias("grand"))
    ends = slices.withColumn("end", F.sum("slice_size").over(W.orderBy("slice")))
    at, spent = ends.where("end > grand").agg(F.min("slice"), F.min_by(F.expr("end - slice_size"), "slice")).first()
    if at is None:
        taken = F.lit(max_epochs)
    else:
        order = W.orderBy("finish", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
        over = copies.where(F.col("slice") == at).withColumn("sum", F.sum("size").over(order)).where(F.col("sum") + F.lit(spent) > F.col("grand"))
        last, rank = over.agg(F.min(F.struct("finish", "rank")).alias("m")).select("m.finish", "m.rank").first()
        # Finish times of one source differ, so (finish, rank of the source) is a strict order of the copies.
        taken = F.expr(f"size(filter(sequence(0, {max_epochs - 1}), epoch -> {finish} < {last!r}D OR ({finish} = {last!r}D AND rank < {rank})))")
    return queue.select("row", "doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def query(spark, sf_dir):
    out = fair_mix(documents(spark, sf_dir).select("doc_id", "source", "text"), SIZE)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


SIZE = f"coalesce(regexp_count(text, {sql_regex(WORD)}), 0)"

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    CAST(sum(source_size) OVER () AS BIGINT) AS grand FROM s),
f AS (SELECT *,
    CAST(grand - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lv FROM w),
t AS (SELECT *, max(lv) OVER () AS level FROM f),
q AS (
  SELECT d.*, t.source_size, t.weight, t.grand, t.rank, least(CAST(3 * t.source_size AS DOUBLE), t.level * t.weight) AS target,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
    row_number() OVER () AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r, size, grand, rank, (epoch * source_size + cum) / weight AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0),
k AS (SELECT r, count(*) AS copies FROM (
    SELECT r, grand, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS spent FROM c)
  WHERE spent <= grand GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken,
  CAST(coalesce(copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN k USING (r)
"""
