"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The units are characters as they are (code points of any script, no classes and no alphabet; runs of white space are one
blank), in n-grams of ``ORDER`` = 5 with ORDER - 1 blanks before each text.  Trusted text is that of documents labelled
as good; all of it is counted.

1. Groups.  Every task packs its rows into groups of about ``GROUP_CHARS`` characters, each one compressed row of a table
   that is bucketed by group, so that later joins by group move no text.
2. Model.  n-grams of the trusted texts are counted by group and summed in shards by n-gram; continuation counts,
   discounts, back-off weights and probabilities come from joins between the count tables of neighbouring orders.
3. Sharded count joins.  Each group sends every n-gram that it holds once to the shards; the distinct ones meet the
   tables of all orders, and their bits return to the groups that asked.
4. The bits of a text's n-grams add up to its perplexity.  Texts are scored once, and the scored rows are written.

Scale: no table of the model or of answers is collected or broadcast; a task holds one group.  What moves is the distinct
n-grams of each group, which grow with the corpus.  Scoring goes over slices of ``SLICE`` characters, so a very long text
needs no more memory than its own size.

Thresholds: in each language, from the trusted documents' bits per character, median + ``SPREAD`` * (95 % quantile -
median), at least ``MARGIN`` above the median, from exact quantiles of bits rounded to a thousandth.  A document of n
characters is judged by (n * bits + PRIOR * median) / (n + PRIOR), so that short texts are not rejected by chance.

Defined results: null and empty texts have 0 characters and the median of their language (kept); null lang is a language
of its own; a language without trusted documents takes the quantiles of all; without trusted text nothing is rejected
(threshold null); rows keep their multiplicity and all their columns; null doc_id is never trusted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, forget, group_parts, group_texts, packed_groups, release, written

ORDER = 5
SPREAD = 3.0
MARGIN = 0.3  # bits a character
MEDIAN, HIGH = 0.5, 0.95
PRIOR = 100
GROUP_CHARS = 32 << 20
SLICE = 1 << 18
PIECE = 1 << 16
FEW_LANGUAGES = 100_000  # fences of so many languages are broadcast; more of them are joined by a shuffle
_PAD = " " * (ORDER - 1)
#: Odd multipliers: an n-gram's digest within its group is a sum over its code points.
_MULTIPLIERS = np.random.default_rng(5).integers(1 << 62, 1 << 64, ORDER, dtype=np.uint64) | np.uint64(1)

# An n-gram's key is its code points, 21 bits each, as a number: a holds the bits from 63 on, b those below.
_CHAR, _PAIR = (1 << 21) - 1, (1 << 42) - 1


def clean(text: str | None) -> str:
    return " ".join(text.split()) if text else ""


def key_of(gram: str) -> tuple[int, int]:
    """(a, b) of an n-gram."""
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value >> 63, value & (1 << 63) - 1


def _context(a: str, b: str) -> tuple[str, str]:
    """SQL for the key without its last character."""
    return f"shiftrightunsigned({a}, 21)", f"(shiftrightunsigned({b}, 21) | shiftleft({a} & {_CHAR}L, 42))"


def _suffix(a: str, b: str, order: int) -> tuple[str, str]:
    """SQL for the key of the last ``order`` characters."""
    if order > 3:
        return f"({a} & {(1 << 21 * (order - 3)) - 1}L)", b
    return "0L", f"({b} & {(1 << 21 * order) - 1}L)" if order < 3 else b


# ---- n-grams of texts -------------------------------------------------------------------------------------------


def slices(texts):
    """(owners, n-grams of each part, digests of the n-grams, their first places, code points) of a few texts at a time.

    ``texts``: any iterable; owners are places in it.
    """

    def made(owners: list[int], parts: list[str]):
        sizes = np.array([len(p) - ORDER + 1 for p in parts], np.int64)
        s = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(s) - ORDER + 1
        g = s[:n] * _MULTIPLIERS[0]
        for k in range(1, ORDER):
            g += s[k : k + n] * _MULTIPLIERS[k]
        # The places where one part's last characters meet the next part are no n-grams.
        ends = np.cumsum(sizes + ORDER - 1)[:-1]
        keep = np.ones(n, bool)
        for k in range(1, ORDER):
            keep[ends - k] = False
        return owners, sizes, g[keep], np.flatnonzero(keep), s

    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        padded = _PAD + text
        for at in range(0, len(text), SLICE):
            owners.append(i)
            parts.append(padded[at : at + SLICE + ORDER - 1])
            size += len(parts[-1])
            if size >= SLICE:
                yield made(owners, parts)
                owners, parts, size = [], [], 0
    if parts:
        yield made(owners, parts)


def _keys(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = [s[at + k].astype(np.int64) for k in range(ORDER)]
    return c[0] << 21 | c[1], c[2] << 42 | c[3] << 21 | c[4]


def distinct_grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, a, b, occurrences) of each n-gram of the texts, sorted by digest."""
    known, a, b, n = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    for _, _, g, places, s in slices(texts):
        codes, u = pd.factorize(g)
        first = np.empty(len(u), np.int64)
        first[codes[::-1]] = places[::-1]
        order = np.argsort(u)
        u, first, more = u[order], first[order], np.bincount(codes, minlength=len(u))[order]
        # What is known is only counted; the rest is put in its place, so that no more than the distinct n-grams is copied.
        at = np.searchsorted(known, u)
        old = np.zeros(len(u), bool)
        old[at < len(known)] = known[at[at < len(known)]] == u[at < len(known)]
        n[at[old]] += more[old]
        if not old.all():
            at, new = at[~old], ~old
            known, n = np.insert(known, at, u[new]), np.insert(n, at, more[new])
            x, y = _keys(s, first[new])
            a, b = np.insert(a, at, x), np.insert(b, at, y)
    return known, a, b, n


def _pieces(batch: pa.RecordBatch):
    """A large batch ``PIECE`` rows at a time, which the JVM then holds one by one; an empty one as it is."""
    for at in range(0, max(1, batch.num_rows), PIECE):
        yield batch.slice(at, PIECE)


# ---- groups of rows ---------------------------------------------------------------------------------------------


def grouped(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``grp, ids, blob``: the rows of ``df`` (doc_id, ...) with clean texts; ``keep``: the columns that come back, all if None."""
    return packed_groups(df, text, keep, GROUP_CHARS, "kn-groups", clean)


def trusted_places(groups: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """``grp, trusted``: the places in each group of the rows whose doc_id is trusted; ids alone are shuffled."""
    rows = groups.select("grp", F.posexplode("ids").alias("place", "doc_id")).where("doc_id IS NOT NULL")
    return rows.join(trusted_ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("grp").agg(F.collect_list("place").alias("trusted"))


# ---- the model --------------------------------------------------------------------------------------------------


def _counted(batches):
    for batch in batches:
        for blob, places in zip(batch.column("blob"), batch.column("trusted")):
            mine = set(places.as_py())
            _, a, b, n = distinct_grams(t for i, t in enumerate(group_texts(blob)) if i in mine)
            yield from _pieces(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"]))
            del a, b, n
            release()


def count_grams(groups: DataFrame, places: DataFrame) -> DataFrame:
    """``a, b, n``: the occurrences of every n-gram of the trusted texts, summed in shards by n-gram."""
    mine = groups.select("grp", "blob").join(places, "grp").select("blob", "trusted")
    return mine.mapInArrow(_counted, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Modified Kneser-Ney by joins of count tables: for each order, from 1, (``a, b, p``) and (``a, b, back``).

    ``p`` is the interpolated probability of a seen n-gram, ``back`` the weight that a seen context gives to the next
    lower order.  Orders below the highest count left neighbours; below the first, all characters seen and one unseen
    are equally likely.
    """
    raw, out = [counts], []
    for order in range(ORDER - 1, 0, -1):
        a, b = _suffix("a", "b", order)
        raw.insert(0, written(raw[0].selectExpr(f"{a} AS a", f"{b} AS b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "kn-raw"))
    kinds = raw[0].count() + 1
    for order, table in enumerate(raw, 1):
        n = {r["n"]: r["c"] for r in table.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if n1 and n2 and n3 else [0.5, 0.75, 0.9]
        d1, d2, d3 = (min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))
        ha, hb = _context("a", "b")
        table = table.selectExpr("a", "b", "n", f"{ha} AS ha", f"{hb} AS hb")
        context = table.groupBy("ha", "hb").agg(
            F.sum("n").alias("total"),
            (F.expr(f"{d1} * count_if(n = 1) + {d2} * count_if(n = 2) + {d3} * count_if(n >= 3)") / F.sum("n")).alias("back"),
        )
        joined = table.join(context, ["ha", "hb"]).withColumn("own", F.expr(f"(n - CASE n WHEN 1 THEN {d1} WHEN 2 THEN {d2} ELSE {d3} END) / total"))
        if order == 1:
            joined = joined.withColumn("p", F.expr(f"own + back / {kinds}"))
        else:
            sa, sb = _suffix("a", "b", order - 1)
            lower = out[-1][0].selectExpr("a AS sa", "b AS sb", "p AS q")
            joined = joined.withColumn("sa", F.expr(sa)).withColumn("sb", F.expr(sb)).join(lower, ["sa", "sb"]).withColumn("p", F.expr("own + back * q"))
        backs = context.selectExpr("ha AS a", "hb AS b", "back")
        out.append((written(joined.select("a", "b", "p"), "kn-order"), written(backs, "kn-back")))
    for table in raw[:-1]:
        forget(table)
    return out


def bits_of(grams: DataFrame, orders: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``a, b, bits`` of distinct n-grams (a, b): each order's tables are joined, and the highest order that saw it gives p."""
    out = grams
    for order in range(ORDER, 0, -1):
        seen, backs = orders[order - 1]
        a, b = _suffix("a", "b", order)
        ha, hb = _context(a, b)
        out = out.withColumn("x", F.expr(a)).withColumn("y", F.expr(b)).withColumn("hx", F.expr(ha)).withColumn("hy", F.expr(hb))
        out = out.join(seen.selectExpr("a AS x", "b AS y", f"p AS p{order}"), ["x", "y"], "left")
        out = out.join(backs.selectExpr("a AS hx", "b AS hy", f"back AS back{order}"), ["hx", "hy"], "left").drop("x", "y", "hx", "hy")
    p = f"1D / {orders[0][0].count() + 1}"
    for order in range(1, ORDER + 1):
        p = f"coalesce(p{order}, coalesce(back{order}, 1D) * {p})"
    return out.selectExpr("a", "b", f"cast(-log2(greatest({p}, 1e-300D)) AS float) AS bits")


# ---- scores -----------------------------------------------------------------------------------------------------


def _asked(batches):
    for batch in batches:
        for grp, blob in zip(batch.column("grp"), batch.column("blob")):
            _, a, b, _ = distinct_grams(group_texts(blob))
            # Neighbours in the order of the keys compress well.
            i = np.lexsort((b, a))
            yield from _pieces(pa.RecordBatch.from_arrays([pa.array(np.full(len(a), grp.as_py(), np.int64)), pa.array(i.astype(np.int32)), pa.array(a[i]), pa.array(b[i])], ["grp", "i", "a", "b"]))
            del a, b, i
            release()


def sums(texts, answer) -> dict[int, float]:
    """The bits of each text that has any; ``answer(digests)`` gives those of the sorted distinct n-grams of all of them.

    ``texts()``: an iterator over the texts; it is gone through twice, so that no more than a slice is held.
    """
    every, total = np.zeros(0, np.uint64), {}
    held = []
    for _, _, g, _, _ in slices(texts()):
        held.append(pd.unique(g))
        if len(held) > 7:
            every, held = np.unique(np.concatenate([every, *held])), []
    every = np.unique(np.concatenate([every, *held]))
    bits = answer(every).astype(np.float64)
    for owners, sizes, g, _, _ in slices(texts()):
        codes, u = pd.factorize(g)
        upto = np.concatenate([[0.0], np.cumsum(bits[np.searchsorted(every, u)][codes])])
        ends = np.cumsum(sizes)
        for i, x in zip(owners, (upto[ends] - upto[ends - sizes]).tolist()):
            total[i] = total.get(i, 0.0) + x
    return total


def _scored(schema: pa.Schema):
    def of(batches):
        for batch in batches:
            for blob, trusted, answers in zip(*(batch.column(c) for c in ("blob", "trusted", "x"))):
                found = answers.values
                given = np.zeros(0 if found is None else len(found), np.float32)
                if len(given):
                    given[found.field("i").to_numpy()] = found.field("bits").to_numpy()
                total, good, at = sums(lambda b=blob: group_texts(b), lambda _, g=given: g), set(trusted.as_py() or []), 0
                for part in group_parts(blob):
                    n = part.num_rows
                    chars = np.array([len(t) for t in part.column("t").to_pylist()], np.int64)
                    per = np.array([total.get(at + i, 0.0) for i in range(n)]) / np.maximum(chars, 1)
                    row = part.column("row").cast(schema.field("row").type)
                    yield pa.RecordBatch.from_arrays([row, pa.array(per), pa.array(chars), pa.array([at + i in good for i in range(n)], pa.bool_())], schema=schema)
                    at += n
                release()

    return of


def scores(df: DataFrame, trusted_ids: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row, bits, chars, trusted`` for each row of ``df``, written; ``row`` is a struct of the columns in ``keep``."""
    groups = grouped(df, text, keep)
    places = written(trusted_places(groups, trusted_ids), "kn-trusted")
    counts = written(count_grams(groups, places), "kn-counts", batch_rows=1)
    orders = smoothed(counts)
    forget(counts)
    asked = groups.select("grp", "blob").mapInArrow(_asked, "grp bigint, i int, a bigint, b bigint")
    bits = written(bits_of(asked.select("a", "b").distinct(), orders), "kn-bits", batch_rows=1)
    answers = asked.join(bits.hint("merge"), ["a", "b"]).select("grp", F.struct("i", "bits").alias("x")).groupBy("grp").agg(F.collect_list("x").alias("x"))
    whole = groups.select("grp", "blob").join(places.hint("merge"), "grp", "left").join(answers.hint("merge"), "grp", "left")
    row = df.select(*(df.columns if keep is None else keep)).schema
    kind = T.StructType([T.StructField("row", row), T.StructField("bits", T.DoubleType()), T.StructField("chars", T.LongType()), T.StructField("trusted", T.BooleanType())])
    out = written(whole.select("blob", "trusted", "x").mapInArrow(_scored(to_arrow_schema(kind)), kind), "kn-scores", batch_rows=1)
    for table in (groups, places, bits, *(t for pair in orders for t in pair)):
        forget(table)
    return out


def quantiles(rows: DataFrame) -> DataFrame:
    """``key, median, high`` from rows (key, bits); the key null stands for all rows.

    Bits are rounded to a thousandth and counted, so a key has at most some ten thousand counts however many rows.
    """
    counts = rows.select("key", F.expr("cast(round(bits * 1000) as bigint)").alias("b")).groupBy("key", "b").count()
    both = counts.unionByName(counts.groupBy("b").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("key"), "b", "count"))
    ranked = both.selectExpr("key", "b", "sum(count) OVER (PARTITION BY key ORDER BY b) AS upto", "sum(count) OVER (PARTITION BY key) AS n")
    at = lambda q: F.expr(f"min(CASE WHEN upto >= {q} * n THEN b END) / 1000")
    return ranked.groupBy("key").agg(at(MEDIAN).alias("median"), at(HIGH).alias("high"))


def classify(df: DataFrame, trusted_ids: DataFrame, spread: float = SPREAD, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the columns of ``df`` (doc_id, lang, text, ...) in ``keep``, lang among them, or all), ``bits,
    chars, judged, threshold, kept`` for each row."""
    scored = scores(df, trusted_ids, text, keep)
    key = F.concat(F.lit("="), F.coalesce(F.col("row.lang"), F.lit("\x00null")))
    fences = written(quantiles(scored.where("trusted AND chars > 0").select(key.alias("key"), "bits")), "kn-fences")
    whole = fences.where("key IS NULL").first()
    mine = fences.where("key IS NOT NULL").withColumnRenamed("key", "k")
    mine = F.broadcast(mine) if fences.count() <= FEW_LANGUAGES else mine.hint("merge")
    of_all = lambda c: F.lit(None if whole is None else whole[c]).cast("double")
    out = scored.join(mine, key == mine["k"], "left").withColumn("m", F.coalesce("median", of_all("median"))).withColumn("h", F.coalesce("high", of_all("high")))
    judged = F.expr(f"(bits * chars + coalesce(m, bits) * {PRIOR}) / (chars + {PRIOR})")
    out = out.withColumn("judged", judged).withColumn("threshold", F.expr(f"m + greatest({MARGIN}D, {spread}D * (h - m))"))
    return out.select("row", "bits", "chars", "judged", "threshold", F.expr("coalesce(judged <= threshold, true)").alias("kept"))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def query(spark, sf_dir):
    out = classify(documents(spark, sf_dir).select("doc_id", "lang", "text"), trusted_ids(spark, sf_dir), keep=("doc_id", "lang"))
    return out.select("row.doc_id", F.round("bits", 6).alias("bits"), "chars", F.round("judged", 6).alias("judged"), "threshold", "kept")
