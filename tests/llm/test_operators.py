"""Each operator against brute force on small texts, with nulls, empty texts, ties, repeated rows and odd columns."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import best_fit, common, components, cross_parse, fair_mix, image_copies, kn_quality, line_rules, phrase_automata, secret_links, simhash_ring, toxic_mil

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "of", "the", "and", "omega", "sun", "tree")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "a b", "Ünï çödé 漢字 \U0001f600", "x" * 5000, "w " * 3000]


# ---- defined results on odd input -------------------------------------------------------------------------------


def odd_table(spark):
    """Nulls in every column, equal rows, null ids, and columns whose names the operators use themselves."""
    rows = [(i if i % 5 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None) for i, t in enumerate(ODD + ODD[:4])]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS size", "2 AS h", "'z' AS row", "3 AS t", "4 AS w", "5 AS fp", "6 AS base", "7 AS th", "8 AS spans", "9 AS lm", "10 AS quality")


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, empty):
    df = odd_table(spark)
    df = df.where("false") if empty else df
    n = 0 if empty else len(ODD) + 6
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 1)], "doc_id bigint, toxic int")
    outs = {
        "lines": line_rules.line_rules(df), "mix": fair_mix.fair_mix(df, fair_mix.SIZE), "simhash": simhash_ring.near_duplicates(df),
        "lang": cross_parse.identify(df, cross_parse.fit(df)), "toxic": toxic_mil.score(df, toxic_mil.fit(df, labels)),
        "secrets": secret_links.scan(df), "redact": secret_links.redact(df), "passages": phrase_automata.dedup_passages(df),
        "quality": kn_quality.classify(df, labels.select("doc_id")), "pack": best_fit.best_fit(df, fair_mix.SIZE),
        "images": image_copies.image_copies(df.select(F.col("doc_id").alias("image_id"), F.encode("text", "utf-8").alias("image"))),
    }
    for name, out in outs.items():
        assert len(out.collect()) == n, name
    assert outs["redact"].columns == df.columns


# ---- 1 ----------------------------------------------------------------------------------------------------------


def _image(rng):
    a = np.kron(rng.normal(0, 1, (30, 40)), np.ones((4, 4)))
    a = image_copies._box(image_copies._box(a)) / 81
    return (a - a.min()) / (a.max() - a.min()) * 200 + 20


def test_edited_images_share_a_class(spark):
    rng, rows, of = np.random.default_rng(3), [], {}
    for i in range(8):
        a = _image(rng)
        for edit in (a, a[20:100, 30:150], a * 0.7 + 30, np.rot90(a), a + rng.normal(0, 2, a.shape), a):
            of[len(rows)] = i
            rows.append((len(rows), bytearray(image_copies.encode(edit))))
    rows += [(900, None), (901, bytearray(b"P5 junk")), (902, bytearray(b"P5 4 4 255\n" + bytes(16)))]
    got = {r.image_id: r.class_id for r in image_copies.image_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    assert all(got[k] == 6 * i for k, i in of.items()) and all(got[k] == k for k in (900, 901, 902))


def test_image_links_are_all_shared_keys(spark):
    """The class is what shared consensus keys reach, by brute force over all pairs."""
    rng = np.random.default_rng(9)
    images = [_image(rng) for _ in range(3)]
    images += [images[0][10:, 5:], np.vstack([images[0][:60], images[1][:60]])]
    df = spark.createDataFrame([(i, bytearray(image_copies.encode(a))) for i, a in enumerate(images)], "image_id bigint, image binary")
    got = {r.image_id: r.class_id for r in image_copies.image_copies(df).collect()}
    assert got[3] == got[4] == got[1] == 0 and got[2] == 2


def test_short_pages_have_corners_and_share_a_class(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((20, 40, 96, 120, 200))]
    sheets = image_copies._sheets(texts + texts)
    assert image_copies.CELL >= 4 and all(len(image_copies.corners(image_copies.decode(x))) >= 3 for x in sheets)
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(sheets)], "image_id bigint, image binary")
    got = {r.image_id: r.class_id for r in image_copies.image_copies(df).collect()}
    assert got == {i: i % len(texts) for i in range(2 * len(texts))}


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_line_rules(spark):
    good = "\n".join(prose(random.Random(i), 12) + "." for i in range(8))
    noisy = good + "\n" + "\n".join(["home | news | mail | login | shop | help"] * 30)
    texts = [good, good + "\nHome | About | Contact | Login\nAll rights reserved.\nshort one", noisy, "same words here " * 40, "W#*! " * 60]
    rows = line_rules.line_rules(docs(spark, texts)).collect()
    assert [r.kept for r in rows] == [True, True, False, False, False]
    assert rows[1].clean_text == good and rows[1].n_failed_lines == 3
    for r, text in zip(rows, texts):
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)


def test_words_of_a_line_are_counted_whatever_blanks_surround_them(spark):
    good = "\n".join(prose(random.Random(i), 12) + "." for i in range(8))
    texts = [good + "\nHome page\nNews today", good + "\r\nHome page\r\nNews today\r\n", good + "\n\tHome page\n\tNews today\x0b"]
    assert [r.n_failed_lines for r in line_rules.line_rules(docs(spark, texts)).collect()] == [2, 2, 2]


# ---- 3 ----------------------------------------------------------------------------------------------------------


def _phrases(probe, clean):
    """Greedy longest matches by substring search; a character that the text lacks is a phrase."""
    i = n = 0
    while i < len(probe):
        j = i + 1
        while j <= len(probe) and probe[i:j] in clean:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("block,lanes", [(1024, 4096), (16, 7), (3, 1)])
def test_phrases_against_plain_matching(monkeypatch, block, lanes):
    """Exact phrases of whole texts, whatever the blocks; also where a match spans many of them."""
    monkeypatch.setattr(cross_parse, "BLOCK", block)
    monkeypatch.setattr(cross_parse, "_LANES", lanes)
    rng = random.Random(1)
    clean = cross_parse._letters("".join(rng.choice("abc ") for _ in range(300)))
    model = cross_parse.Model({"x": clean, "y": "abcabcabc"})
    probes = ["abcdabc", "abcddabc", "ddd", "a", clean[10:250] + "d" + clean[:90], clean]
    probes += ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 400))) for _ in range(25)]
    got = model.phrases(probes)
    assert got[:3, 1].tolist() == [3, 4, 3]
    assert got.tolist() == [[_phrases(p, clean), _phrases(p, "abcabcabc")] for p in probes]


def test_many_scripts_keep_their_own_symbols():
    """Languages whose characters are rare over all samples, by plain substring matching."""
    rng = random.Random(4)
    scripts = {"el": range(0x3B1, 0x3CA), "en": range(0x61, 0x7B), "ja": range(0x3041, 0x3097), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x4E00 + 400)}
    vocabulary = {k: ["".join(chr(rng.choice(v)) for _ in range(4)) for _ in range(150)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    samples = {k: text(k, {"en": 900}.get(k, 300)) for k in scripts}
    model = cross_parse.Model(samples)
    probes = [(k, text(k, 30)) for k in scripts for _ in range(4)]
    assert model.predict([t for _, t in probes])[0] == [k for k, _ in probes]
    probes += [("", samples["zh"][100:400] + samples["el"][50:90]), ("", samples["ja"][7:300])]
    assert model.phrases([t for _, t in probes]).tolist() == [[_phrases(t, samples[k]) for k in model.languages] for _, t in probes]


def test_all_picked_rows_are_learned_from(spark):
    """A very long row leaves room for the others: every row has a letter that no other has."""
    rows = [(i, chr(0x4E00 + i) + " abc" * (20_000 if i % 7 == 0 else 5), "xx") for i in range(200)]
    model = cross_parse.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_chars=8000)
    assert all(model.place[0x4E00 + i] for i in range(200))
    assert len(cross_parse._even([t for _, t, _ in rows], 8000)) <= 8000
    assert cross_parse._even(["abcdef", "x", "abcdef"], 11) == "abcd x abcd"


def test_languages_held_out(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "keit", "ver"]}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(n)) + "."
    train = spark.createDataFrame([(i, text(k, 40), k) for i, k in enumerate(["aa", "bb"] * 20)], "doc_id bigint, text string, lang string")
    model = cross_parse.fit(train)
    probe = spark.createDataFrame([(text(k, 12), k) for k in ["aa", "bb"] * 10] + [("123 !?", "und"), (None, "und"), ("", "und")], "text string, k string")
    rows = cross_parse.identify(probe, model).collect()
    assert all(r.language.lang_pred == r.k and 0 <= r.language.score <= 1 for r in rows)


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_toxic_sentences_are_found(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(160):
        s = [prose(rng, 9) + "." for _ in range(6)]
        if i % 2:
            s[rng.randrange(6)] = prose(rng, 4) + " horrid scoundrel " + prose(rng, 3) + "."
        texts.append(" ".join(s))
        labels.append((i, i % 2))
    df = docs(spark, texts)
    model = toxic_mil.fit(df, spark.createDataFrame(labels[:100], "doc_id bigint, toxic int"))
    rows = toxic_mil.score(df.orderBy("doc_id"), model).collect()
    for i, r in enumerate(rows):
        assert (r.toxicity.score >= 0.7) == bool(i % 2)
        if i % 2:
            assert any("horrid" in r.text[o.start : o.end] for o in r.toxicity.offending)
    assert model.score("")[0] == 0.0


# ---- 5 ----------------------------------------------------------------------------------------------------------


def _fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps):
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_fingerprints_and_classes(spark):
    rng = random.Random(5)
    base = [prose(rng, 400) for _ in range(12)]
    texts = [*ODD, *base, *[b.replace(b.split()[5], "changed") for b in base], base[0], None]
    rows = {r.doc_id: r for r in simhash_ring.near_duplicates(docs(spark, texts)).collect()}
    fps = [_fingerprint(t) for t in texts]
    assert [rows[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [rows[i].component_id for i in range(len(texts))] == _classes(fps)


@pytest.mark.parametrize("hot", [1, 2000])
def test_links_of_crowded_fingerprints(spark, monkeypatch, hot):
    """Clusters within a few bits, through the plain buckets, the split ones and the lookup of flipped bits."""
    monkeypatch.setattr(simhash_ring, "HOT_BUCKET", hot)
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    root = {r.node % (1 << 64): r.root for r in components.components(simhash_ring.links(df)).collect()}
    want = _classes(fps)
    for i, j in itertools.combinations(range(len(fps)), 2):
        same = fps[i] in root and fps[j] in root and root[fps[i]] == root[fps[j]]
        assert same == (want[i] == want[j])
    x = np.array(fps, np.uint64)[:60]
    monkeypatch.setattr(simhash_ring, "ENUMERATE", 10)
    got = simhash_ring.bucket_links(x, 0, (1 << 64) - 1) if hot == 1 else None
    if got is not None:
        pairs = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
        assert {tuple(sorted(p)) for p in got} <= pairs


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("whole", [-1, 1 << 20])
def test_components_in_one_task_and_in_rounds_are_those_of_plain_search(spark, monkeypatch, whole):
    monkeypatch.setattr(components, "WHOLE", whole)
    rng = random.Random(8)
    names = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(120)]
    chain = sorted(names[100:], key=lambda _: rng.random())
    links = [(rng.choice(names[:100]), rng.choice(names[:100])) for _ in range(80)] + list(zip(chain, chain[1:])) * 2 + [(None, names[0])]
    root = {n: n for n in names}
    for a, b in [x for x in links if x[0] is not None] * 120:
        root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    assert {n: got.get(n, n) for n in names} == root and set(got) <= set(names) and len(set(root.values())) > 10


def test_components_of_few_links_take_few_tasks(spark):
    """Rounds of joins, some of a dozen stages each, took most of the time where shuffles have many partitions."""
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)], "a bigint, b bigint").coalesce(1)
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert components.components(links).select("root").distinct().count() == 2
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(s.numTasks for s in stages if s) < 60


# ---- 7 ----------------------------------------------------------------------------------------------------------


def test_secret_spans_and_links(spark):
    key, sha = "AKIA" + "Q7" * 9, "0f" * 20
    texts = [
        f'password = "hunter22" and API_KEY:abc and secret=tok:abcdefgh {key} x {sha}',
        "user=bob " + "x " * 50 + "passwd: s3cr3tvalue https://host/x", "user=bob alone https://host/x", "user=bob " + "y " * 300 + "token=abcdefghij",
        "AbcDefGhiJkl1234567890 near login: ann and password=qwerty12", "AbcDefGhiJkl1234567890 on its own", "Pässword é token='üa' " + "token=abcdef" * 2,
    ]
    rows = sorted(secret_links.scan(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    kinds = lambda spans: [secret_links.KINDS[s.k] for s in spans]
    assert kinds(rows[0].base) == ["assign", "access", "hex"] and rows[0].base[0].start == 0
    assert kinds(rows[1].added) == ["login", "endpoint"] and rows[2].added == [] and rows[3].added == []
    assert sorted(kinds(rows[4].added)) == ["login", "opaque"] and rows[5].added == []
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r, t in zip(rows, texts):
        want = [m.span() for m in pattern.finditer(t) if len(m[2]) >= 6]
        assert [(s.start, s.end) for s in r.base if s.k == 0] == want
    clean = {r.doc_id: r.text for r in secret_links.redact(docs(spark, texts)).collect()}
    assert clean[0] == f"[SECRET]\" and API_KEY:abc and secret=tok:abcdefgh [SECRET] x [SECRET]" and clean[2] == texts[2]


def test_secrets_of_a_text_with_many(spark):
    """Positions of thousands of spans in one text, and weak ones within strong ones, by plain search."""
    rng = random.Random(31)
    def some(signs, n):
        return "".join(rng.choice(signs) for _ in range(n))
    makes = [
        lambda: "password=" + some("abcXYZ019", rng.randint(3, 12)), lambda: "AKIA" + some("QRST0123", rng.randint(10, 20)), lambda: some("0123456789abcdef", rng.randint(20, 40)),
        lambda: "user: " + some("abc.", rng.randint(2, 9)), lambda: some("abcABC019_", rng.randint(15, 60)), lambda: "tok" + some("éa字", 3), lambda: "token='user=" + some("abc", 7),
    ]
    text = " ".join(rng.choice(makes)() for _ in range(20_000))
    rows = secret_links._rows(docs(spark, [text, "", None, "user=bob"]), "text", "many").collect()
    for r in rows:
        t = {0: text, 3: "user=bob"}.get(r.doc_id, "")
        want = {k: [m for m in re.finditer(p.replace("\\x20", " "), t)] for k, p in secret_links.PATTERNS.items()}
        want["assign"] = [m for m in want["assign"] if len(m[2]) >= 6]
        want["opaque"] = [m for m in want["opaque"] if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        base = sorted((*m.span(), secret_links.KINDS.index(k)) for k in secret_links.BASE for m in want[k])
        taken = np.zeros(len(t) + 1, bool)
        for a, b, _ in base:
            taken[a:b] = True
        weak = [(*m.span(), secret_links.KINDS.index(k)) for k in ("login", "opaque", "endpoint") for m in want[k] if k == "endpoint" or not taken[m.start() : m.end()].any()]
        assert [tuple(x) for x in r.base] == base and sorted(tuple(x) for x in r.weak) == sorted(weak)


# ---- 8 ----------------------------------------------------------------------------------------------------------


def _passages(texts, window=35):
    from collections import Counter

    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_passages_against_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(phrase_automata, "HOT_STRETCHES", hot)
    rng = random.Random(10)
    shared = prose(rng, 60).split()
    texts = list(ODD)
    for i in range(12):
        own = prose(rng, rng.randint(5, 150)).split()
        at, a, b = rng.randint(0, len(own)), rng.randint(0, 20), rng.randint(36, 60)
        texts.append(" ".join(own[:at] + shared[a:b] + own[at:]))
    # An anchor that recurs in other company only: a group in which nothing is confirmed.
    texts += [prose(rng, 30) + " one two three four five six seven eight nine " + prose(rng, 30) for _ in range(6)]
    texts += [texts[-1], prose(rng, 34), " ".join(shared[:34]), (prose(rng, 40) + "\n") * 3, "again " * 100]
    want = _passages(texts)
    got = {r.row.doc_id: r for r in phrase_automata.dedup_passages(docs(spark, texts)).collect()}
    assert [got[i].kept_text for i in range(len(texts))] == want
    assert [got[i].n_words - got[i].n_removed for i in range(len(texts))] == [len(w.split()) for w in want]
    # Rows without ids are told apart all the same.
    none = phrase_automata.dedup_passages(docs(spark, texts).withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    assert sorted((r.row.text or "", r.kept_text) for r in none) == sorted(zip([t or "" for t in texts], want))


def test_words_of_coded_texts():
    """The words and their places are those of the word grammar, whatever blanks there are; stretches give them back."""
    import pyarrow as pa

    rng = random.Random(21)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\u00a0", "\u2003", "a", "é", "字"]
    texts = [None, "", " ", "a", " a", "a ", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    words = [WORD.findall(t or "") for t in texts]
    for given in (texts, [pa.array(texts[:7], pa.string()), pa.array([], pa.string()), pa.array(texts, pa.string()).slice(7)]):
        coded = phrase_automata.Coded(given)
        assert coded.sizes.tolist() == [len(w) for w in words]
        assert coded.words.take(pa.array(coded.ids)).to_pylist() == [x for w in words for x in w]
        assert coded.texts(coded.ends - coded.sizes, coded.sizes).to_pylist() == [" ".join(w) for w in words]
        kept = np.array([i % 3 > 0 for i in range(len(coded.ids))])
        want = [" ".join(x for j, x in enumerate(w, int(e) - len(w)) if j % 3 > 0) for w, e in zip(words, coded.ends)]
        assert coded.texts(coded.ends - coded.sizes, coded.sizes, kept).to_pylist() == want
    for none in ([], [pa.array([], pa.string())]):
        assert phrase_automata.Coded(none).sizes.tolist() == [] and len(phrase_automata.anchors(phrase_automata.Coded(none))[0]) == 0


def test_located_in_many_shards(monkeypatch):
    """Every occurrence of every passage, by plain search, whatever the size of the automata."""
    rng = random.Random(12)
    texts = ["", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(30))]
    coded = phrase_automata.Coded(texts)
    passages = [coded.ids[i : i + rng.randint(3, 9)] for i in rng.sample(range(len(coded.ids) - 10), 25)]
    want, start = [], 0
    for text in texts:
        w = coded.ids[start : start + len(text.split())].tolist()
        start += len(w)
        own = [False] * len(w)
        for p in passages:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p.tolist():
                    own[i : i + len(p)] = [True] * len(p)
        want += own
    for words in (1 << 19, 12):
        monkeypatch.setattr(phrase_automata, "AUTOMATON_WORDS", words)
        assert phrase_automata.located(coded, passages).tolist() == want


def test_anchors_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(13)
    coded = phrase_automata.Coded([prose(rng, n) for n in (10, 35, 36, 200, 0, 34, 90, 500)])
    want = [x.tolist() for x in phrase_automata.anchors(coded)]
    assert sum(want[2]) == sum(max(0, n - 34) for n in coded.sizes.tolist())
    monkeypatch.setattr(phrase_automata, "_PART_WORDS", 40)
    assert [x.tolist() for x in phrase_automata.anchors(coded)] == want


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(11)
    texts = [*ODD, *[prose(rng, rng.choice([3, 40, 300, 700])) for _ in range(150)], "w " * 9000]
    rows = best_fit.best_fit(docs(spark, texts), fair_mix.SIZE, shard_rows=60).collect()
    bins, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.offset, r.length, r.capacity))
    for i, t in enumerate(texts):
        n = len(WORD.findall(t or ""))
        assert sum(x for _, x in pieces[i]) == n and all(a + x == b for (a, x), (b, _) in itertools.pairwise(sorted(pieces[i])))
    for parts in bins.values():
        parts.sort()
        used = sum(x for _, x, _ in parts)
        assert all(a + x == b for (a, x, _), (b, _, _) in itertools.pairwise(parts)) and parts[0][0] == 0
        assert {c for _, _, c in parts} == {min(c for c in best_fit.CAPACITIES if c >= used)}


def test_lengths_are_optimised_jointly():
    """The result is the least cost over every set of lengths that bins may be opened at, by a plain best fit."""
    def plain(sizes, opened, capacities):
        bins = []
        for x in sorted(sizes, reverse=True):
            fits = [b for b in bins if b[0] - sum(b[1]) >= x]
            if fits:
                min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(x)
            else:
                bins.append((min(c for c in opened if c >= x), [x]))
        return sum(best_fit.cost(min(c for c in capacities if c >= sum(b[1]))) for b in bins)

    rng = random.Random(31)
    for top in (40, 200, 256):
        sizes, caps = [rng.randint(1, top) for _ in range(120)], (32, 64, 128, 256)
        sets = [(*x, 256) for k in range(4) for x in itertools.combinations(caps[:-1], k)]
        got = sum(map(best_fit.cost, best_fit.pack(sizes, caps)[2]))
        assert got == pytest.approx(min(plain(sizes, x, caps) for x in sets))


def test_packing_takes_the_best_room():
    bins, offsets, final = best_fit.pack([4096, 3000, 1000, 900, 96, 100], (256, 4096))
    assert bins[2] == bins[1] and final[bins[0]] == 4096 and len(set(bins)) == len(final)
    sizes = [random.Random(12).randint(1, 256) for _ in range(300)]
    total = lambda caps: sum(map(best_fit.cost, best_fit.pack(sizes, caps)[2]))
    assert total((256, 512, 1024)) <= min(total((256,)), total((1024,)))


# ---- 10 ---------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "c", "c", "c", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = fair_mix.fair_mix(df, fair_mix.SIZE, bucket_rows=50).collect()
    size, target = {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
        target[r.source] = r.target
    # The water level by bisection.
    weight = dict(zip([*sorted(k for k in size if k), None], (5, 2, 1, 5)))
    low, high = 0.0, 10.0 * sum(size.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * size[k], weight[k] * mid) for k in size) < sum(size.values()) else (low, mid)
    for k in size:
        assert target[k] == pytest.approx(min(3 * size[k], weight[k] * low), rel=1e-6)
        assert abs(sum(r.taken for r in out if r.source == k) - target[k]) <= 2 * 60
    assert all(0 <= r.taken <= 3 * r.size for r in out) and sum(r.taken for r in out) <= sum(size.values())
    again = fair_mix.fair_mix(df.repartition(5), fair_mix.SIZE, bucket_rows=50).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


# ---- pipeline and queries ---------------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    texts = [prose(rng, rng.randint(60, 120)) + "." for _ in range(50)]
    texts += ["".join(rng.choice("#$%QXZ!") for _ in range(300)) for _ in range(3)] + [texts[0], texts[1], texts[2] + " token=abcdef123456", ""]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(corpus_pipeline.STAGES) == 5
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [i for i, t in enumerate(texts) if not (t and t[0] in "#$%QXZ!")]
    root = dict(zip(kept, _classes([_fingerprint(texts[i]) for i in kept])))
    alone = [i for k, i in enumerate(kept) if root[i] == k]
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = common.written(stage(spark, step, str(tmp_path)), name)
        assert step.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        assert sorted(r.doc_id for r in step.collect()) == (kept if name == "quality" else alone)
    clean = {r.doc_id: r.text for r in step.collect()}
    assert all("abcdef123456" not in t for t in clean.values())
    mixed = corpus_pipeline.mix(spark, step, str(tmp_path))
    taken = {r.doc_id: r.copies for r in fair_mix.fair_mix(step, fair_mix.SIZE).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in taken.items() for _ in range(n))
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: n * len(WORD.findall(clean[i])) for i, n in taken.items() if n}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, tmp_path, empty):
    import corpus_pipeline

    df = odd_table(spark)
    spark.createDataFrame([(1, 1, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = df.where("false") if empty else df
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, df, str(tmp_path)), name)
        if name == "packing":
            assert out.count() >= df.count()
        else:
            assert out.columns == df.columns and out.count() <= 3 * df.count()
        if name == "near_duplicates":
            texts = [r.text for r in df.collect()]
            roots = _classes([_fingerprint(t) for t in texts])
            assert out.count() == len(set(roots))


def test_texts_that_share_an_id_are_judged_apart(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (9, b), (None, c), (None, c), (None, a), (4, prose(rng, 200))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    out = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(3, a), (7, b), (0, c), rows[-1]])


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_many_equal_rows_and_null_ids_are_spread(spark, ids):
    """Packing and mixing of rows that share identity: no shard or bucket takes them all, and nothing is lost."""
    n = 60_000
    df = spark.range(n).selectExpr("cast(null as bigint) AS doc_id" if ids == "null" else "5L AS doc_id", "'a b c' AS text" if ids == "equal" else "repeat('a b ', cast(1 + id % 9 as int)) AS text", "'s' AS source")
    packed = best_fit.best_fit(df, fair_mix.SIZE, shard_rows=10_000)
    shards = {r[0]: r[1] for r in packed.groupBy(F.expr("bin_id div 4294967296")).count().collect()}
    assert len(shards) >= 6 and sum(shards.values()) == n and max(shards.values()) < 15_000
    mixed = fair_mix.fair_mix(df, fair_mix.SIZE)
    total, taken = mixed.agg(F.sum("size"), F.sum("taken")).first()
    assert mixed.count() == n and total == taken


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_queries_against_sql(spark):
    import os

    import duckdb

    from ledgerloom.llm import registry

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in os.listdir(sf):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, sf)
        cols = sorted(got.columns)
        want = db.sql(sql).select(*[f'"{c}"' for c in cols]).fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect()), name


def test_contract_digests(spark):
    """Fixed answers of the contract's digests for one text."""
    text = "token=abcdef1 AKIA" + "B" * 16
    row = secret_links.scan(docs(spark, [text])).first()
    assert [(s.k, s.start, s.end) for s in row.base] == [(0, 0, 13), (1, 14, 34)]
    assert hashlib.sha256(b"assign:0:13,access:14:34").hexdigest() == hashlib.sha256(",".join(f"{secret_links.KINDS[s.k]}:{s.start}:{s.end}" for s in row.base).encode()).hexdigest()


def test_split_hamming_buckets_lose_no_link(spark, monkeypatch):
    """The words of crowded buckets are those of a comparison of every pair; null ids do not pool their images."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2, (40, 128))
    rows = []
    for bits in base:
        for _ in range(5):
            other = bits.copy()
            other[rng.choice(128, int(rng.integers(0, 4)), replace=False)] ^= 1
            rows.append(np.packbits(other).view("<i8"))
    x = np.unique(np.array(rows), axis=0)
    monkeypatch.setattr(image_copies, "HOT_BUCKET", 1)
    df = spark.createDataFrame([tuple(r) for r in x.tolist()], "lo bigint, hi bigint")
    got = df.select("lo", "hi", F.xxhash64("lo", "hi").alias("word")).join(image_copies.visual_words(df), "word", "left").collect()
    root = {(r.lo, r.hi): r.word if r.root is None else r.root for r in got}
    u = x.view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None]).sum(axis=2)
    reach = d <= image_copies.MAX_BITS
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    same = np.array([[root[tuple(a)] == root[tuple(b)] for b in x.tolist()] for a in x.tolist()])
    assert (same == reach).all() and reach.sum() > len(x)
    a, b = _image(rng), _image(rng)
    pair = [(None, bytearray(image_copies.encode(a))), (None, bytearray(image_copies.encode(b))), (4, bytearray(image_copies.encode(a)))]
    out = image_copies.image_copies(spark.createDataFrame(pair, "image_id bigint, image binary")).collect()
    assert sorted(r.class_id for r in out if r.image_id is not None) == [4] and sum(r.class_id is None for r in out) == 2
    assert sorted(r.n_corners for r in out) == sorted([len(image_copies.corners(image_copies.decode(image_copies.encode(i)))) for i in (a, a, b)])


def _plain_keys(table, word):
    """An image's triangles, one corner at a time: of each, the words and the shape of its two nearest of the same level."""
    keys = set()
    for level in {r[0] for r in table}:
        some = [(r, w) for r, w in zip(table, word) if r[0] == level]
        for i, (r, _) in enumerate(some):
            far = sorted(((q[1] - r[1]) ** 2 + (q[2] - r[2]) ** 2, j) for j, (q, _) in enumerate(some))
            far = [j for d, j in far if d >= (4 * image_copies.MIN_SIDE) ** 2][:2]
            if len(far) < 2:
                continue
            three = sorted([some[i], *(some[j] for j in far)], key=lambda x: x[1])
            apart = np.hypot(*(np.array(some[far[0]][0][1:3]) - some[far[1]][0][1:3]))
            if apart < 4 * image_copies.MIN_SIDE or len({w for _, w in three}) < 3:
                continue
            key = []
            for p in range(3):
                (a, w), (b, _), (c, _) = (three[(p + k) % 3] for k in range(3))
                u, v = (b[1:3] - a[1:3]) / 4, (c[1:3] - a[1:3]) / 4
                turns = (np.arctan2(u[0] * v[1] - u[1] * v[0], u @ v), a[3] / 1000 - np.arctan2(u[1], u[0]))
                key += [w, *(int(np.rint(x / (2 * np.pi) * image_copies.SHAPE_BINS)) % image_copies.SHAPE_BINS for x in turns)]
            keys.add(tuple(key))
    return keys


def test_classes_and_keys_are_those_of_all_pairs_however_the_images_are_grouped(spark):
    """Words, triangles and classes by brute force; an id's empty image links it to no other id."""
    rng = np.random.default_rng(21)
    images = [_image(rng)[:70, :90] for _ in range(4)]
    images += [images[0][10:, 5:], np.rot90(images[1]), np.vstack([images[2][:45], images[3][:45]]), images[0] + rng.normal(0, 2, images[0].shape), images[2]]
    data = [image_copies.encode(a) for a in images]
    rows = [(i, bytearray(x)) for i, x in enumerate(data)] + [(0, None), (1, None), (None, bytearray(data[0])), (20, None)]
    tables = [image_copies.corners(image_copies.decode(x)) for x in data]
    together = image_copies.corner_tables([image_copies.decode(x) for x in data])
    assert all(np.array_equal(a, b) for a, b in zip(tables, together)) and all(len(t) >= 10 for t in tables)

    flat = np.concatenate(tables)
    bits = np.ascontiguousarray(flat[:, 4:]).view(np.uint64)
    label = np.arange(len(flat))
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2) <= image_copies.MAX_BITS
    for _ in range(20):
        label = np.where(near, label[None], len(flat)).min(axis=1)
    digest = spark.createDataFrame(flat[:, 4:].tolist(), "lo bigint, hi bigint").select(F.xxhash64("lo", "hi")).collect()
    word = np.array([min(digest[j][0] for j in np.flatnonzero(label == x)) for x in label])
    ends = np.cumsum([0, *map(len, tables)])
    keys = [_plain_keys(t, word[a:b].tolist()) for t, a, b in zip(tables, ends, ends[1:])]
    of = list(range(len(images)))
    for _ in of:
        of = [min(of[j] for j in range(len(images)) if j == i or data[i] == data[j] or keys[i] & keys[j]) for i in range(len(images))]
    assert len(set(of)) > 1 and of[4] == of[0] == 0 and of[8] == 2
    want = sorted([(i, len(tables[i]), of[i], len(keys[i])) for i in range(len(images))] + [(0, 0, 0, 0), (1, 0, 1, 0), (20, 0, 20, 0)])
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "image_id bigint, image binary").repartition(parts)
        assert image_copies.image_groups(df).count() <= parts  # a row for many images, none for each corner
        got = [tuple(r) for r in image_copies.image_copies(df).collect()]
        assert sorted(r for r in got if r[0] is not None) == want
        assert [r[1:] for r in got if r[0] is None] == [(len(tables[0]), None, len(keys[0]))]


def test_the_triangles_of_a_large_image_need_no_table_of_all_pairs():
    rng = np.random.default_rng(4)
    n = 4000
    table = np.column_stack([np.zeros(n), rng.integers(0, 40_000, (n, 2)), rng.integers(-3000, 3000, n), np.arange(n)]).astype(np.int64)
    tracemalloc.start()
    of, key = image_copies.triangles(np.zeros(n, np.int64), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(key) > n // 2 and not of.any() and peak < 64e6  # a table of 4000 x 4000 takes 128 MB
