"""The n-gram model against dictionaries of strings, and verdicts against plain quantiles."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, kn_quality

from .test_operators import ODD, docs, prose

PAD = " " * (kn_quality.ORDER - 1)


def _strings(texts):
    for t in texts:
        padded = PAD + " ".join((t or "").split())
        yield from (padded[i : i + kn_quality.ORDER] for i in range(len(padded) - len(PAD)))


def plain_model(texts):
    """Interpolated modified Kneser-Ney: probability of an n-gram's last character after the others."""
    n, counts = kn_quality.ORDER, {}
    counts[n] = Counter(_strings(texts))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(x[1:] for x in counts[k + 1])
    kinds = len(counts[1]) + 1
    discount, total, classes = {}, Counter(), {}
    for k, c in counts.items():
        of = Counter(c.values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        y = [0.5, 0.75, 0.9]
        if n1 and n2 and n3:
            q = n1 / (n1 + 2 * n2)
            y = [1 - 2 * q * n2 / n1, 2 - 3 * q * n3 / n2, 3 - 4 * q * n4 / n3]
        discount[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(y, 1)]
        for x, m in c.items():
            total[k, x[:-1]] += m
            classes.setdefault((k, x[:-1]), [0, 0, 0])[min(m, 3) - 1] += 1

    def p(x):
        k = len(x)
        if k == 0:
            return 1 / kinds
        low, t = p(x[1:]), total[k, x[:-1]]
        if not t:
            return low
        m = counts[k][x]
        back = sum(u * v for u, v in zip(classes[k, x[:-1]], discount[k])) / t
        return (m - discount[k][min(m, 3) - 1] if m else 0) / t + back * low

    return p


def _texts(rng):
    return [prose(rng, rng.randint(30, 90)) + rng.choice([" Straße, 12 (é)!", " 漢字かな \U0001f600", "\x00 nul", "."]) for _ in range(30)]


def _trusted(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id bigint")


def test_bits_and_verdicts_against_dictionaries(spark):
    """Every text's bits, and every verdict from plain quantiles."""
    rng = random.Random(7)
    texts = [*_texts(rng), "the sun Zebra 99 ## alpha", *("".join(rng.choice("#$%&*!QXZ") for _ in range(400)) for _ in range(4)), *ODD]
    trusted = range(24)
    p = plain_model([texts[i] for i in trusted])
    rows = {r.row.doc_id: r for r in kn_quality.classify(docs(spark, texts), _trusted(spark, [*trusted, None])).collect()}
    want = []
    for i, t in enumerate(texts):
        found = [-math.log2(p(x)) for x in _strings([t])]
        want.append((sum(found) / max(1, len(found)), len(found)))
        assert rows[i].chars == len(found) and rows[i].bits == pytest.approx(want[i][0], rel=1e-4, abs=1e-4)
        assert rows[i].row.text == t
    good = sorted(round(want[i][0] * 1000) for i in trusted)
    at = lambda q: next(x for k, x in enumerate(good, 1) if k >= q * len(good)) / 1000
    fence = at(0.5) + max(kn_quality.MARGIN, kn_quality.SPREAD * (at(0.95) - at(0.5)))
    for i, (bits, chars) in enumerate(want):
        assert rows[i].threshold == pytest.approx(fence, abs=0.002)
        judged = (bits * chars + at(0.5) * kn_quality.PRIOR) / (chars + kn_quality.PRIOR)
        assert abs(judged - fence) < 0.01 or rows[i].kept == (judged <= fence)
    assert [rows[i].kept for i in (31, 32, 33, 34)] == [False] * 4 and rows[35].kept


def test_keys_keep_every_code_point():
    texts = ["ab\x00c\U0010ffff漢d", "aaaaaaaaaaaa"]
    _, a, b, n = kn_quality.distinct_grams(texts)
    assert Counter(dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))) == Counter(kn_quality.key_of(x) for x in _strings(texts))


def test_scrambled_text_of_any_script_is_rejected(spark):
    rng = random.Random(3)
    scripts = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x4E00 + 300)}
    rows, trusted = [], []
    for lang, letters in scripts.items():
        words = ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        for _ in range(30):
            trusted.append(len(rows))
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(80)), lang))
        for kind in ("good", "bad"):
            for _ in range(10):
                text = " ".join(rng.choice(words) for _ in range(80))
                rows.append((len(rows), text if kind == "good" else "".join(c if c == " " else chr(rng.choice(letters)) for c in text), lang))
    got = kn_quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), _trusted(spark, trusted))
    for r in got.collect():
        assert r.kept == (r.row.doc_id % 50 < 40)


def test_thousands_of_languages_and_no_trusted_text(spark, monkeypatch):
    rows = [(i, f"alpha beta gamma {i}", f"l{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    few = kn_quality.classify(df, _trusted(spark, range(3000)))
    kept = sorted((r.row.doc_id, r.kept) for r in few.collect())
    monkeypatch.setattr(kn_quality, "FEW_LANGUAGES", 5)
    assert sorted((r.row.doc_id, r.kept) for r in kn_quality.classify(df, _trusted(spark, range(3000))).collect()) == kept
    none = kn_quality.classify(df.limit(5), _trusted(spark, [])).collect()
    assert all(r.kept and r.threshold is None for r in none) and len(none) == 5


def test_sums_do_not_depend_on_slices(monkeypatch):
    texts = ["abc " * 50, "", "xyz"]
    answer = lambda g: (g % np.uint64(7)).astype(float)
    want = kn_quality.sums(lambda: iter(texts), answer)
    monkeypatch.setattr(kn_quality, "SLICE", 9)
    got = kn_quality.sums(lambda: iter(texts), answer)
    assert got.keys() == want.keys() == {0, 2} and all(got[i] == pytest.approx(want[i]) for i in got)


def test_bucketed_joins_move_one_side(spark):
    df = common.bucketed(spark.range(50).withColumnRenamed("id", "grp"), "grp", "t")
    joined = df.join(spark.range(50).withColumnRenamed("id", "grp").hint("merge"), "grp")
    assert joined.count() == 50 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def _handed(texts, rows=1000):
    """Batches (row, id, t) as Spark hands them to a worker: each in one piece of memory."""
    for at in range(0, len(texts), rows):
        part = texts[at : at + rows]
        ids = pa.array(range(at, at + len(part)), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids], ["doc_id"]), ids, pa.array(part, pa.string())], ["row", "id", "t"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()


def test_a_group_is_held_as_its_blob_alone(monkeypatch):
    """While a worker packs a group, it holds what is compressed, not the texts; nothing is lost or moved."""
    monkeypatch.setattr(common, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(11)
    texts = [prose(rng, 20) + "  x" * 600 if i % 50 else None for i in range(9000)]
    clean = [kn_quality.clean(t) for t in texts]
    size, held, before = sum(map(len, clean)), [0], pa.total_allocated_bytes()

    def watched():
        for batch in _handed(texts, 250):
            held.append(pa.total_allocated_bytes() - before)
            yield batch

    groups = list(common._packed(size * 2 // 3, kn_quality.clean)(watched()))
    assert max(held) < size / 4
    assert [g.column("grp")[0].as_py() for g in groups] == [3 << 24, (3 << 24) + 1]
    assert [t for g in groups for t in common.group_texts(g.column("blob")[0])] == clean
    rows = [r["doc_id"] for g in groups for part in common.group_parts(g.column("blob")[0]) for r in part.column("row").to_pylist()]
    assert rows == list(range(9000)) == [i for g in groups for i in g.column("ids")[0].as_py()]


def test_distinct_grams_copy_little(monkeypatch):
    """Parts that share n-grams and parts that don't add up, and memory stays near the size of the answer."""
    monkeypatch.setattr(kn_quality, "SLICE", 1 << 14)
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(200)] * 2
    tracemalloc.start()
    try:
        g, a, b, n = kn_quality.distinct_grams(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = Counter(_strings(texts))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == {kn_quality.key_of(x): c for x, c in want.items()}
    assert (g[1:] > g[:-1]).all()
    assert peak < 2 * 32 * len(g)


def test_wide_answers_go_out_in_pieces(monkeypatch):
    """n-grams of a group leave the worker some rows at a time: all of them, once each, numbered by their digests."""
    monkeypatch.setattr(kn_quality, "PIECE", 100)
    rng = random.Random(5)
    texts = _texts(rng)
    batch = next(_handed(texts))
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, batch.select(["row", "t"]).schema) as out:
        out.write_batch(batch.select(["row", "t"]))
    group = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([packed.getvalue().to_pybytes()], pa.binary()), pa.array([list(range(30))])], ["grp", "blob", "trusted"])
    _, a, b, n = kn_quality.distinct_grams(texts)
    asked, counted = list(kn_quality._asked([group])), list(kn_quality._counted([group]))
    assert max(x.num_rows for x in (*asked, *counted)) == 100
    rows = [tuple(r.values()) for x in asked for r in x.to_pylist()]
    assert sorted(rows, key=lambda r: r[1]) == list(zip([7] * len(a), range(len(a)), a.tolist(), b.tolist()))
    assert [tuple(r.values()) for x in counted for r in x.to_pylist()] == list(zip(a.tolist(), b.tolist(), n.tolist()))
    empty = group.set_column(2, "trusted", pa.array([[]], pa.list_(pa.int64())))
    assert [x.num_rows for x in kn_quality._counted([empty])] == [0]
