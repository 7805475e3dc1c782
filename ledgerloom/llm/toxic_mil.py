"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of its words and of their beginnings
(inflected words share them); the document's is their noisy-or, 1 - prod(1 - p).  Weights are learned from document labels alone, through the noisy-or, and then point at the
sentences that offend.

Scale: the fit takes a bounded sample of labelled rows (``rows_per_class`` ids of each label and as many rows at most,
those with the smallest digests of doc_id and text, and of them ``sample_chars`` characters at most, whole rows in that
order); only the sampled ids are broadcast, and no other text is shuffled.  Scoring is one pass over whole texts.

Defined results: null and empty texts have no sentence and score 0; words of a sentence count once; a document with
contradictory label rows counts as toxic; without both labels in the sample every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_udf, written

ROWS_PER_CLASS = 2000
SAMPLE_CHARS = 64 << 20
MIN_ROWS = 4  # a word is a feature if so many sampled documents have it ...
MIN_Z = 3.0  # ... and its share in the two classes differs by so many standard errors
MAX_FEATURES = 20_000
THRESHOLD = 0.7
OFFENDING = 0.5
MAX_SENTENCE_WORDS = 60  # longer ones are cut, so that a text without marks has sentences too
PREFIXES = (4, 5, 6, 7, 8)  # beginnings that are features, written with a trailing "*"
_SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")
_TOKEN = re.compile(r"[^\W\d_]+")


def sentences(text: str):
    """(start, end, words) of each sentence of a text that has a word."""
    for m in _SENTENCE.finditer(text):
        words = _TOKEN.findall(m[0].lower())
        if len(words) <= MAX_SENTENCE_WORDS:
            if words:
                yield m.start(), m.end(), words
        else:
            places = list(_TOKEN.finditer(m[0]))
            for at in range(0, len(places), MAX_SENTENCE_WORDS):
                part = places[at : at + MAX_SENTENCE_WORDS]
                yield m.start() + part[0].start(), m.start() + part[-1].end(), [p[0].lower() for p in part]


def features(words) -> set[str]:
    return {*words, *(w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k)}


def _bag_features(text: str | None) -> set[str]:
    return set().union(*(features(words) for _, _, words in sentences(text or "")))


def selected(sample: DataFrame) -> list[str]:
    """Features of the sample (text, toxic) whose document shares differ between the labels by more than chance.

    The counts of all features stay on the executors; at most MAX_FEATURES names come to the driver.
    """
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n0 or not n1:
        return []

    def bags(batches):
        for rows in batches:
            found = [(w, y) for t, y in zip(rows["text"], rows["toxic"]) for w in _bag_features(t)]
            yield pd.DataFrame(found, columns=["w", "y"])

    counts = sample.select("text", "toxic").mapInPandas(bags, "w string, y int").groupBy("w").agg(F.sum("y").alias("a1"), F.count(F.lit(1)).alias("a"))
    share = f"(a / {n0 + n1})"
    z = F.expr(f"abs(a1 / {n1} - (a - a1) / {n0}) / sqrt(greatest({share} * (1 - {share}) * {1 / n1 + 1 / n0}, 1e-18D))")
    return [r["w"] for r in counts.where(f"a >= {MIN_ROWS}").withColumn("z", z).where(f"z >= {MIN_Z}").orderBy(F.desc("z"), "w").limit(MAX_FEATURES).collect()]


class Model:
    def __init__(self, weight: dict[str, float], bias: float):
        self.weight, self.bias = weight, bias
        #: No feature of a word is known unless its first letters are.
        self.first = {w.rstrip("*")[: PREFIXES[0]] for w in weight}

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text, and (start, end, probability) of its offending sentences."""
        clean, offending, known, first, k = 0.0, [], self.weight.keys(), self.first, PREFIXES[0]
        if not text or not self.weight:
            return 0.0, offending
        none = -float(np.logaddexp(0, self.bias))
        for start, end, words in sentences(text):
            near = [w for w in words if w[:k] in first]
            hits = known & features(near) if near else None
            if hits:
                z = self.bias + sum(self.weight[w] for w in sorted(hits))
                clean -= float(np.logaddexp(0, z))
                if z >= np.log(OFFENDING / (1 - OFFENDING)):
                    offending.append((start, end, float(1 / (1 + np.exp(-z)))))
            else:
                clean += none
        return float(-np.expm1(clean)), offending


def train(texts: list[str], labels: list[int], names: list[str], rounds: int = 300, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Full-batch Adam on the log-likelihood of the document labels under the noisy-or."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model({}, -50.0)
    index = {w: i for i, w in enumerate(names)}
    doc, sent, feat, n = [], [], [], 0
    for d, text in enumerate(texts):
        for _, _, words in sentences(text or ""):
            doc.append(d)
            for w in sorted(features(words) & index.keys()):
                sent.append(n)
                feat.append(index[w])
            n += 1
    doc, sent, feat = np.array(doc, np.int64), np.array(sent, np.int64), np.array(feat, np.int64)
    x, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    x[-1] = -6.0
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(sent, x[feat], n)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, -np.logaddexp(0, z), len(y))  # log of the chance that no sentence is toxic
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        g = p * np.where(y[doc] == 1, -(np.exp(clean) / toxic)[doc], 1.0)
        grad = np.append(np.bincount(feat, g[sent], len(names)), g.sum()) / len(y) + ridge * np.append(x[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({w: float(x[i]) for i, w in enumerate(names)}, float(x[-1]))


def fit(df: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from ``df`` (doc_id, text) and ``labels`` (doc_id, toxic), from at most rows_per_class rows a label."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    picked = []
    for label in (0, 1):
        rate = min(1.0, 2.0 * rows_per_class / max(1, counts.get(label, 0)))
        few = marks.where((F.col("toxic") == label) & (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= rate))
        picked += few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).collect()
    if not picked:
        return Model({}, -50.0)
    spark = df.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id bigint, toxic int")
    # At most 2 * rows_per_class ids: a bound that the caller sets.
    found = df.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").withColumn("h", F.xxhash64("doc_id", "text"))
    found = found.orderBy("h").limit(2 * rows_per_class)
    found = found.withColumn("upto", F.expr("sum(length(coalesce(text, ''))) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)"))
    sample = written(found.where(F.col("upto") <= sample_chars).select("doc_id", "text", "toxic").repartition(8), "toxic-sample")
    names = selected(sample)
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], names)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``toxicity`` (score, offending: start, end, probability in characters)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])

    def scored(texts):
        found = [shared.value.score(x) for x in texts]
        return [{"score": a, "offending": [dict(zip(span.names, x)) for x in b]} for a, b in found]

    return df.select("*", text_udf(kind, scored)(F.col(text)).alias("toxicity"))


def query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held))
    out = score(docs.withColumn("held_out", held), model)
    return out.select(
        "doc_id", "held_out", "toxicity.score",
        F.when(F.col("toxicity.score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
        F.size("toxicity.offending").alias("n_offending"),
    )
