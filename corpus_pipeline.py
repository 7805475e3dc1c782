"""A training corpus from ``documents``: quality, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.  Rows are told apart by doc_id and digests of their contents, so different texts under one doc_id, or
under none, are judged each by itself.  Equal rows count as copies of each other.  The mix repeats a document's row as
often as it holds it.  Empty input gives empty output in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import best_fit, fair_mix, kn_quality, secret_links, simhash_ring
from ledgerloom.llm.common import documents, repeated, written


def _key(*digested: str):
    """doc_id and a digest of the columns named."""
    return F.struct("doc_id", F.xxhash64(*digested).alias("th")).alias("key")


def _keyed(docs: DataFrame, *digested: str) -> DataFrame:
    """``key, row``: the row's key and the row."""
    return docs.select(_key(*digested), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's fence.  Their keys alone go through the model's groups."""
    judged = kn_quality.classify(docs.select("doc_id", "lang", "text", _key("text", "lang")), kn_quality.trusted_ids(spark, sf_dir), keep=("lang", "key"))
    kept = judged.where("kept").select("row.key").distinct()
    return _keyed(docs, "text", "lang").join(kept.hint("merge"), "key", "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the least by doc_id (null last), then by the text's digest."""
    found = simhash_ring.near_duplicates(docs)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m"))
    stays = least.select(F.struct("m.doc_id", "m.th").alias("key"))
    once = _keyed(docs, "text").groupBy("key").agg(F.first("row").alias("row"))
    return once.join(stays.hint("merge"), "key", "left_semi").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text."""
    return secret_links.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix of sources holds it; equal rows add up."""
    keyed = _keyed(docs, *docs.columns)
    sized = keyed.select("key", "row.doc_id", "row.source", "row.text")
    taken = fair_mix.fair_mix(sized, fair_mix.SIZE, keep=("key",)).groupBy("row.key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    once = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return repeated(once.join(taken.hint("merge"), "key"), "copies", "i").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return best_fit.best_fit(docs, fair_mix.SIZE)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("packing", packing),
]

#: SQL expresses neither the smoothed n-gram model nor the fingerprints; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
