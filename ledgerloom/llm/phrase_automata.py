"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text; words in a window whose sequence starts anywhere else go.

1. Groups.  Every task packs its rows into groups, each one compressed row of a bucketed table, so that no later step
   moves whole texts.
2. Anchors.  Each window points at the least digest among its runs of ``ANCHOR`` words (the leftmost on ties), so equal
   windows point at equal runs, and a text of n words has about 2 n / 29 anchors.  Anchors are counted over all groups;
   only windows at an anchor found twice or more can repeat.
3. Confirmation.  Each group sends its distinct stretches of windows round recurring anchors, with their numbers; by
   anchor, windows are compared word for word and counted.  Runs of windows found twice or more are passages.
4. Automata.  Passages return to the groups that hold their stretches and are compiled there into Aho-Corasick automata
   of bounded size, a symbol a word; all texts of the group stream through them whole, which locates every occurrence.
   A text that holds a passage holds its anchor, so its group has that passage.

Scale: work is linear in the text; what moves is anchors' digests and distinct stretches.  An anchor with more than
``HOT_STRETCHES`` stretches is dealt by salts of its windows: a stretch goes to the salts of its own windows, at most 28,
and each salt counts its share of them.  There are so many salts that each holds about HOT_STRETCHES / 2 stretches,
however many the anchor has.  Stages are written tables.

Defined results: null text has no words; texts under WINDOW words lose nothing; equal rows count as occurrences of each
other; a row's identity is its place in its group, so doc_ids may be null or repeated.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import documents, forget, group_parts, packed_groups, written

WINDOW = 35
ANCHOR = 8
HOT_STRETCHES = 1000
HOT_BROADCAST = 10_000  # hot anchors; more of them are joined by a shuffle
GROUP_CHARS = 16 << 20
AUTOMATON_WORDS = 1 << 18
RADIX = 48
_PART_WORDS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Coded:
    """Texts as places in a list of their distinct words, in the order in which those are found.

    ``texts``: arrays of strings, or strings.  Words are split and numbered column-wise; no loop goes over words.
    """

    def __init__(self, texts):
        arrays = [t if isinstance(t, pa.Array) else pa.array([t], pa.string()) for t in texts]
        lists = [pc.ascii_split_whitespace(pc.fill_null(a, "")) for a in arrays]
        coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode()
        self.words: pa.Array = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        ids = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]])
        # Blanks at either end of a text leave an empty word, which is none.
        empty = pc.index(self.words, "").as_py()
        if empty >= 0:
            word = ids != empty
            ends = np.cumsum(sizes)
            before = np.concatenate([[0], np.cumsum(word)])
            sizes = before[ends] - before[ends - sizes]
            ids = ids[word]
        self.ids, self.sizes, self.ends = ids, sizes, np.cumsum(sizes)

    def texts(self, starts: np.ndarray, sizes: np.ndarray, kept: np.ndarray | None = None) -> pa.Array:
        """The words of each stretch (its first word's place, its words), or those ``kept`` marks, joined by spaces."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        if kept is not None:
            stay = kept[places]
            offsets = np.concatenate([[0], np.cumsum(stay)])[offsets]
            places = places[stay]
        words = self.words.cast(pa.large_string()).take(pa.array(self.ids[places]))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words), pa.scalar(" ", pa.large_string()))


def _of_group(blob: pa.Scalar) -> Coded:
    return Coded([part.column("t") for part in group_parts(blob)])


def anchors(coded: Coded, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first window, windows) of each anchor; every window of the texts is counted at one anchor."""
    import xxhash

    digest = np.array([xxhash.xxh64_intdigest(w) for w in coded.words.to_pylist()], np.uint64)
    out = [(np.zeros(0, np.int64),) * 3]
    cuts, doc = [0], 0
    while cuts[-1] < len(coded.ids):
        # Whole texts at a time, about _PART_WORDS words of them.
        doc = max(int(np.searchsorted(coded.ends, cuts[-1] + _PART_WORDS, "right")), int(np.searchsorted(coded.ends, cuts[-1], "right")) + 1)
        cuts.append(int(coded.ends[min(doc, len(coded.ends)) - 1]))
    for lo, hi in zip(cuts, cuts[1:]):
        h = digest[coded.ids[lo:hi]]
        n = len(h) - anchor + 1
        if len(h) < window:
            continue
        run = h[:n].copy()
        for k in range(1, anchor):
            run = run * _MULTIPLIER + h[k : n + k]
        run ^= run >> np.uint64(29)
        run *= np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(32)
        # at[i]: the leftmost least run among `span` of them from i, by doubling.
        width, span, at = window - anchor + 1, 1, np.arange(n, dtype=np.int32)
        while span * 2 <= width:
            left, right = at[: len(at) - span], at[span:]
            at = np.where(run[left] <= run[right], left, right)
            span *= 2
        if width > span:
            left, right = at[: len(at) - (width - span)], at[width - span :]
            at = np.where(run[left] <= run[right], left, right)
        # Windows that run over the end of their text are none.
        whole = np.ones(len(at) + 1, bool)
        whole[-1] = False
        ends = coded.ends[(coded.ends > lo) & (coded.ends < hi)] - lo
        for k in range(1, window):
            whole[(ends - k)[(ends >= k) & (ends - k < len(at))]] = False
        new = np.concatenate([[True], (at[1:] != at[:-1]) | ~whole[:-2]]) & whole[:-1]
        first = np.flatnonzero(new)
        if len(first):
            out.append((run[at[first]].view(np.int64), first + lo, np.add.reduceat(whole[:-1].astype(np.int64), first)))
    return tuple(np.concatenate(x) for x in zip(*out))


def stretches(coded: Coded, recurring: np.ndarray, window: int, anchor: int):
    """The distinct stretches at recurring anchors, in the order they are found: (anchor, first window, windows, times)."""
    a, first, n = anchors(coded, window, anchor)
    keep = np.isin(a, recurring)
    found: dict[tuple, list] = {}
    for x, start, k in zip(a[keep].tolist(), first[keep].tolist(), n[keep].tolist()):
        key = (x, coded.ids[start : start + k + window - 1].tobytes())
        if key in found:
            found[key][3] += 1
        else:
            found[key] = [x, start, k, 1]
    return list(found.values())


def confirmed(stretches: list[bytes], counts: list[int], salts: list[tuple[int, int]], window: int = WINDOW) -> list[list[int]]:
    """For each stretch the ranges [from, to, from, to ...] of its windows that are found twice or more.

    ``counts``: how often each stretch occurs.  ``salts``: (share, shares) of the windows that a stretch counts here.
    """
    texts = [" " + s.decode("latin-1") + " " for s in stretches]
    seen: dict[str, int] = {}
    windows = []
    for t, n, (share, shares) in zip(texts, counts, salts):
        ends = list(accumulate((len(w) + 1 for w in t[1:-1].split(" ")), initial=0))
        own = [t[ends[i] : ends[i + window] + 1] for i in range(len(ends) - window)]
        windows.append(own)
        for w in own:
            if shares == 1 or zlib.crc32(w.encode("latin-1")) % shares == share:
                seen[w] = seen.get(w, 0) + n
    return [_runs([i for i, w in enumerate(own) if seen.get(w, 0) >= 2]) for own in windows]


def _runs(places: list[int]) -> list[int]:
    out: list[int] = []
    for i in places:
        if out and out[-1] == i:
            out[-1] = i + 1
        else:
            out += [i, i + 1]
    return out


def _symbols(n: int) -> tuple[np.ndarray, int]:
    """Codes of n words, of equal width: an automaton's nodes are searched one child after the other, so few symbols.

    The first symbol of a code is no other's, which keeps matches at whole words.
    """
    width = 1
    while RADIX**width < n:
        width += 1
    digits = [np.arange(n) // RADIX**k % RADIX + 1 + RADIX * (k > 0) for k in range(width)]
    return np.column_stack(digits).astype(np.uint32), width


def located(coded: Coded, passages: list[np.ndarray]) -> np.ndarray:
    """For each word of the texts, whether a passage (an array of word places) that occurs there covers it."""
    import ahocorasick

    change = np.zeros(len(coded.ids) + 1, np.int64)
    passages = list({p.tobytes(): p for p in passages}.values())
    # Texts begin and end where a match cannot go on.
    begins, stops = np.zeros(len(coded.ids), bool), np.zeros(len(coded.ids), bool)
    some = coded.sizes > 0
    begins[(coded.ends - coded.sizes)[some]] = True
    stops[coded.ends[some] - 1] = True
    at = 0
    while at < len(passages):
        shard, size = [], 0
        while at < len(passages) and (not shard or size + len(passages[at]) <= AUTOMATON_WORDS):
            shard.append(passages[at])
            size += len(passages[at])
            at += 1
        own = np.unique(np.concatenate(shard))
        place = np.full(len(coded.words), -1, np.int32)
        place[own] = np.arange(len(own), dtype=np.int32)
        symbols, width = _symbols(len(own))
        automaton = ahocorasick.Automaton()
        for p in shard:
            automaton.add_word(symbols[place[p]].tobytes().decode("utf-32-le"), len(p))
        automaton.make_automaton()
        # A word that the shard lacks leads every automaton back to its root: what lies between two of them is streamed,
        # unless it is shorter than any passage.
        here = place[coded.ids]
        known = here >= 0
        left, right = np.roll(known, 1), np.roll(known, -1)
        starts = np.flatnonzero(known & (begins | ~left))
        ends = np.flatnonzero(known & (stops | ~right)) + 1
        long = ends - starts >= min(map(len, shard))
        found, sizes = [], []
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            for last, n in automaton.iter(symbols[here[start:end]].tobytes().decode("utf-32-le")):
                found.append(start + (last + 1) // width)
                sizes.append(n)
        found, sizes = np.array(found, np.int64), np.array(sizes, np.int64)
        np.add.at(change, found - sizes, 1)
        np.add.at(change, found, -1)
    return np.cumsum(change)[:-1] > 0


# ---- steps over groups ------------------------------------------------------------------------------------------


def _counted(window: int, anchor: int):
    def of(batches):
        for batch in batches:
            for grp, blob in zip(batch.column("grp"), batch.column("blob")):
                a, n = np.unique(anchors(_of_group(blob), window, anchor)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), grp.as_py(), np.int64)), pa.array(a), pa.array(n.astype(np.int32))], ["grp", "a", "n"])

    return of


def _cut(window: int, anchor: int):
    def of(batches):
        for batch in batches:
            for grp, blob, recurring in zip(*(batch.column(c) for c in ("grp", "blob", "anchors"))):
                coded = _of_group(blob)
                found = stretches(coded, recurring.values.to_numpy(), window, anchor)
                # A stretch is named by the place of its first window, which no other of its group has.
                for at in range(0, len(found), 5000):
                    some = found[at : at + 5000]
                    texts = coded.texts(np.array([x[1] for x in some]), np.array([x[2] for x in some]) + window - 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x[0] for x in some], pa.int64()), pa.array([grp.as_py()] * len(some), pa.int64()), pa.array([x[1] for x in some], pa.int32()),
                        texts.cast(pa.large_binary()).cast(pa.binary()), pa.array([x[3] for x in some], pa.int64()),
                    ], ["a", "grp", "i", "stretch", "n"])

    return of


def _salted(window: int):
    def of(batches):
        """Each stretch once per salt that one of its windows has; a few hundred stretches at a time."""
        for rows in (b.iloc[i : i + 500] for b in batches for i in range(0, len(b), 500)):
            at, salts = [], []
            for i, (stretch, k) in enumerate(zip(rows["stretch"], rows["salts"])):
                words = stretch.split(b" ")
                own = {zlib.crc32(b" " + b" ".join(words[j : j + window]) + b" ") % k for j in range(len(words) - window + 1)}
                at += [i] * len(own)
                salts += sorted(own)
            yield rows.iloc[at].reset_index(drop=True).assign(salt=salts)[_COLUMNS]

    return of


_COLUMNS = ["a", "grp", "i", "stretch", "n", "salt", "salts"]


def _confirmed(window: int):
    def of(batches):
        """Rows sorted by (a, salt); a group of them is handled whole, many small ones together."""
        held: list[pd.DataFrame] = []
        size = 0

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            runs = confirmed(rows["stretch"].tolist(), rows["n"].tolist(), list(zip(rows["salt"], rows["salts"])), window)
            keep = np.array([bool(r) for r in runs], bool)
            # Of type object even where no window is confirmed, as Arrow makes lists of nothing else.
            return pd.DataFrame({"grp": rows["grp"].to_numpy()[keep], "i": rows["i"].to_numpy()[keep], "runs": pd.Series([r for r in runs if r], dtype=object)})

        for rows in batches:
            if not len(rows):
                continue
            last = rows.iloc[-1]
            tail = ((rows["a"] == last["a"]) & (rows["salt"] == last["salt"])).to_numpy()
            whole = rows[~tail]
            if len(whole) == 0 and held and held[-1]["a"].iloc[-1] == last["a"] and held[-1]["salt"].iloc[-1] == last["salt"]:
                held.append(rows)
                size += len(rows)
                continue
            if size + len(whole) >= 2000:
                yield done(pd.concat([*held, whole]).reset_index(drop=True))
                held, size = [rows[tail]], int(tail.sum())
            else:
                held += [whole, rows[tail]]
                size += len(rows)
        if held:
            yield done(pd.concat(held).reset_index(drop=True))

    return of


def _without(window: int, schema: pa.Schema):
    def of(batches):
        for batch in batches:
            for blob, covers in zip(batch.column("blob"), batch.column("covers")):
                coded = _of_group(blob)
                places: dict[int, set[int]] = {}
                for cover in covers.as_py() or []:
                    for lo, hi in zip(cover["runs"][::2], cover["runs"][1::2]):
                        places.setdefault(cover["i"], set()).update(range(lo, hi))
                passages = []
                for start, own in sorted(places.items()):
                    runs = _runs(sorted(own))
                    passages += [coded.ids[start + lo : start + hi + window - 1] for lo, hi in zip(runs[::2], runs[1::2])]
                gone = located(coded, passages)
                starts, doc = coded.ends - coded.sizes, 0
                kept, counts = ~gone, np.concatenate([[0], np.cumsum(gone)])
                for part in group_parts(blob):
                    first, n_words = starts[doc : doc + part.num_rows], coded.sizes[doc : doc + part.num_rows]
                    doc += part.num_rows
                    n_removed = counts[first + n_words] - counts[first]
                    row = part.column("row").cast(schema.field("row").type)
                    texts = coded.texts(first, n_words, kept).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([row, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), texts], schema=schema)

    return of


def dedup_passages(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the columns of ``df`` (doc_id, text, ...) in ``keep``, or all), ``n_words, n_removed, kept_text``."""
    groups = packed_groups(df, text, keep, GROUP_CHARS, "phrase-groups")
    found = written(groups.select("grp", "blob").mapInArrow(_counted(window, anchor), "grp bigint, a bigint, n int"), "anchors", batch_rows=1)
    twice = written(found.groupBy("a").agg(F.sum("n").alias("c")).where("c >= 2").select("a"), "recurring")
    recurring = written(found.join(twice.hint("merge"), "a", "left_semi").groupBy("grp").agg(F.collect_list("a").alias("anchors")), "group-anchors")
    forget(found)
    forget(twice)
    whole = groups.select("grp", "blob").join(recurring.hint("merge"), "grp")
    cut = written(whole.mapInArrow(_cut(window, anchor), "a bigint, grp bigint, i int, stretch binary, n bigint"), "stretches", batch_rows=1)
    many = cut.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_STRETCHES)
    many = written(many.select("a", F.expr(f"cast(ceil({window - anchor + 1} * c / {HOT_STRETCHES}) as int)").alias("salts")), "hot-anchors")
    few = F.broadcast(many) if many.count() <= HOT_BROADCAST else many.hint("merge")
    cold = cut.join(few, "a", "left_anti").selectExpr("*", "0 AS salt", "1 AS salts").select(_COLUMNS)
    hot = cut.join(few, "a").mapInPandas(_salted(window), "a bigint, grp bigint, i int, stretch binary, n bigint, salt int, salts int")
    dealt = cold.unionAll(hot).repartition("a", "salt").sortWithinPartitions("a", "salt")
    covers = written(dealt.mapInPandas(_confirmed(window), "grp bigint, i int, runs array<int>"), "covers")
    forget(cut)
    forget(many)
    covers = written(covers.groupBy("grp").agg(F.collect_list(F.struct("i", "runs")).alias("covers")), "group-covers")
    whole = groups.select("grp", "blob").join(covers.hint("merge"), "grp", "left")
    row = df.select(*(df.columns if keep is None else keep)).schema
    kind = T.StructType([T.StructField("row", row), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return whole.select("blob", "covers").mapInArrow(_without(window, to_arrow_schema(kind)), kind)


def query(spark, sf_dir):
    out = dedup_passages(documents(spark, sf_dir).select("doc_id", "text"), keep=("doc_id",))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n >= 2),
gone AS (SELECT DISTINCT r, i + k AS p FROM t, (SELECT unnest(range(0, {WINDOW})) AS k)),
x AS (SELECT r, list(p) AS gone, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS kept FROM words ANTI JOIN gone
  ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (r) LEFT JOIN kept USING (r)
"""
