"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language parses a text greedily into longest matches; each match and each
character that the automaton has never seen is a phrase.  Phrases cost log2 of the automaton's text length each, so
languages with more text are not favoured; the least cost per character wins.

Scale: the automata are fitted on the driver from a bounded sample (``rows_per_language`` rows and ``sample_chars``
letters of each language, of every row an even share, longer where others are short; at most ``max_languages``
languages).  Every character of a language's sample has a symbol of its own; an automaton has at most 2 * sample_chars
states and 3 * sample_chars transitions, those of the language's 63 most frequent characters in a dense table and the
others in a sorted list, so the broadcast has a proven bound.  Whole texts are parsed, in blocks of ``BLOCK`` symbols
that all advance together in numpy; matches go on from block to block, so phrases are those of the whole text.

Defined results: null text and text without a letter give ``und`` with score 0; rows without lang teach nothing; ties
go to the language first in code point order; no labelled row at all gives ``und`` everywhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_udf

SAMPLE_CHARS = 30_000
ROWS_PER_LANGUAGE = 200
MAX_LANGUAGES = 200
#: Symbols of an automaton whose transitions are in the dense table; those above are in a sorted list.
ALPHABET = 64
BLOCK = 1024
_LANES = 4096
_OTHERS = re.compile(r"[\W\d_]+")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    link, length, step, last = [-1], [0], [{}], 0
    for c in symbols:
        new = len(step)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


_START = np.int32(-(1 << 31))


def parsing_table(step: list[dict[int, int]], n_symbols: int) -> np.ndarray:
    """Next state for (state, symbol), times n_symbols; the sign bit marks that a phrase starts at the symbol.

    A phrase starts where no match goes on and wherever the state is the root: at a text's first symbol and after a symbol
    that the root does not know, which is a phrase by itself.  Symbols from n_symbols on are left to ``sparse_table``.
    """
    table = np.zeros((len(step), n_symbols), np.int32)
    for c, to in step[0].items():
        if c < n_symbols:
            table[:, c] = to * n_symbols
    table |= _START
    for state, edges in enumerate(step[1:], 1):
        for c, to in edges.items():
            if c < n_symbols:
                table[state, c] = to * n_symbols
    return table.reshape(-1)


def sparse_table(step: list[dict[int, int]], n_symbols: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For symbols from n_symbols to size: sorted keys (state * size + symbol), their entries, and each symbol's own.

    Entries are those of ``parsing_table``; a symbol's own entry holds where no key does.
    """
    found = sorted((state * size + c, to * n_symbols) for state, edges in enumerate(step) if state for c, to in edges.items() if c >= n_symbols)
    own = np.zeros(size, np.int32)
    for c, to in step[0].items():
        own[c] = to * n_symbols
    keys, entries = np.array(found, np.int64).reshape(-1, 2).T
    return np.ascontiguousarray(keys), entries.astype(np.int32), own | _START


def _letters(text: str) -> str:
    """Lower case; runs of anything but letters are one blank."""
    return _OTHERS.sub(" ", text.lower())


class Model:
    """Fitted automata: ``predict(texts)`` gives languages and scores."""

    def __init__(self, samples: dict[str, str], sample_chars: int = SAMPLE_CHARS):
        self.languages = sorted(samples)
        texts = {k: _letters(v)[:sample_chars] for k, v in samples.items()}
        chars = sorted(set().union(*texts.values()))
        #: Character to its place among those of all samples; 0 stands for every character that is absent from them.
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbols, self.tables, self.sparse, self.sizes, self.cost = [], [], [], [], []
        for k in self.languages:
            codes = self.place[_codes(texts[k])]
            # A language's own symbols, the most frequent first; 0 for what its sample lacks.
            own, n = np.unique(codes, return_counts=True)
            symbol = np.zeros(len(chars) + 1, np.int32)
            symbol[own[np.argsort(-n, kind="stable")]] = np.arange(1, len(own) + 1)
            step = suffix_automaton(symbol[codes].tolist())
            size = min(ALPHABET, len(own) + 1)
            self.symbols.append(symbol)
            self.sizes.append(size)
            self.tables.append(parsing_table(step, size))
            self.sparse.append(sparse_table(step, size, len(own) + 1))
            self.cost.append(np.log2(max(2, len(texts[k]))))

    def _entries(self, k: int, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The entries of language k's automaton for states and symbols."""
        size, (keys, entries, own) = self.sizes[k], self.sparse[k]
        rare = np.flatnonzero(symbols >= size)
        if not len(rare):
            return self.tables[k][state + symbols]
        out = self.tables[k][state + np.where(symbols < size, symbols, 0)]
        if not len(keys):
            out[rare] = own[symbols[rare]]
            return out
        key = (state[rare] // size).astype(np.int64) * len(own) + symbols[rare]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out[rare] = np.where(keys[i] == key, entries[i], own[symbols[rare]])
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        blocks, owner = [], []
        for i, text in enumerate(texts):
            s = self.place[_codes(text)]
            for at in range(0, len(s), BLOCK):
                blocks.append(s[at : at + BLOCK])
                owner.append(i)
        owner = np.array(owner, np.int64)
        entering = np.zeros(len(self.languages), np.int32)  # the states at the first of some blocks, where it goes on
        for at in range(0, len(blocks), _LANES):
            mine, who = blocks[at : at + _LANES], owner[at : at + _LANES]
            goes_on = np.concatenate([[at > 0 and owner[at - 1] == who[0]], who[1:] == who[:-1]])
            sizes = np.array([len(b) for b in mine])
            order = np.argsort(-sizes, kind="stable")
            grid = np.zeros((int(sizes.max()), len(mine)), np.int32)
            for lane, i in enumerate(order.tolist()):
                grid[: sizes[i], lane] = mine[i]
            lane_of = np.empty(len(mine), np.int64)
            lane_of[order] = np.arange(len(mine))
            for k in range(len(self.languages)):
                counts, entering[k] = self._parsed(k, self.symbols[k][grid], sizes[order], lane_of, goes_on, entering[k])
                np.add.at(out[:, k], who, counts)
        return out

    def _parsed(self, k: int, symbols: np.ndarray, sizes: np.ndarray, lane_of: np.ndarray, goes_on: np.ndarray, entering: int) -> tuple[np.ndarray, int]:
        """Phrases that start in each block (in text order), and the state after the last one.

        All blocks advance together, each as if its text began there.  A block that continues a text is then parsed from
        the true state until a phrase starts at the same symbol in both parses, from where on they are one.
        """
        active = np.searchsorted(-sizes, -np.arange(len(symbols)), side="left")
        starts, state = np.zeros(symbols.shape, bool), np.zeros(len(sizes), np.int32)
        for t in range(len(symbols)):
            m = active[t]
            entry = self._entries(k, state[:m], symbols[t, :m])
            starts[t, :m] = entry < 0
            state[:m] = entry & 0x7FFFFFFF
        counts = starts.sum(axis=0)
        final = state[lane_of]
        total, pending = counts[lane_of].astype(np.int64), np.flatnonzero(goes_on)
        while len(pending):
            before = np.where(pending > 0, final[np.maximum(pending, 1) - 1], entering)
            lanes = lane_of[pending]
            true, true_starts, own_starts = before.astype(np.int32), np.zeros(len(pending), np.int64), np.zeros(len(pending), np.int64)
            left, changed = np.flatnonzero(before != 0), []
            total[pending] = counts[lanes]
            t = 0
            while len(left):
                over = t >= sizes[lanes[left]]
                changed.append(left[over])
                left = left[~over]
                if not len(left):
                    break
                entry = self._entries(k, true[left], symbols[t, lanes[left]])
                own = starts[t, lanes[left]]
                same = (entry < 0) & own
                met = left[same]
                total[pending[met]] += true_starts[met] - own_starts[met]
                true_starts[left] += entry < 0
                own_starts[left] += own
                true[left] = entry & 0x7FFFFFFF
                left = left[~same]
                t += 1
            changed = np.concatenate(changed) if changed else np.zeros(0, np.int64)
            total[pending[changed]] += true_starts[changed] - own_starts[changed]
            moved = pending[changed][final[pending[changed]] != true[changed]]
            final[pending[changed]] = true[changed]
            pending = moved + 1
            pending = pending[pending < len(final)]
            pending = pending[goes_on[pending]]
        return total, int(final[-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [_letters(t).strip() if t and any(map(str.isalpha, t)) else "" for t in texts]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(clean) if t]
        if not some or not self.languages:
            return lang, score
        bits = self.phrases([clean[i] for i in some]) * np.array(self.cost)
        best = bits.argmin(axis=1)
        share = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0))
        share = share.max(axis=1) / share.sum(axis=1)
        for i, b, s in zip(some, best, share):
            lang[i], score[i] = self.languages[b], float(s)
        return lang, score


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _even(rows: list[str], chars: int) -> str:
    """The starts of all rows, in order, within ``chars`` letters: what short rows leave is shared by the longer ones.

    Blanks between rows keep words apart.
    """
    cut, left = [""] * len(rows), chars - max(0, len(rows) - 1)
    for k, i in enumerate(sorted(range(len(rows)), key=lambda i: len(rows[i]))):
        cut[i] = rows[i][: max(1, left // (len(rows) - k))]
        left -= len(cut[i])
    return " ".join(cut)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Automata from a bounded sample of the labelled rows of ``df`` (doc_id, text, lang).

    The sample is the rows with the smallest digests of doc_id in each language: the rate at which rows pass before they
    are ranked leaves a few times ``rows_per_language`` of them, however large a language is.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64("doc_id").alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model({})
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("lang") == k, F.lit(min(1.0, 3.0 * rows_per_language / n))).otherwise(rate)
    few = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= rate)
    picked = few.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, text)")).where(F.col("k") <= rows_per_language)
    # Only so much of a row can enter the automaton.
    picked = picked.select("lang", "k", F.substring("text", 1, 2 * sample_chars).alias("text")).orderBy("lang", "k").collect()
    samples: dict[str, list[str]] = {}
    for r in picked:
        samples.setdefault(r["lang"], []).append(_letters(r["text"]).strip())
    return Model({k: _even(v, sample_chars) for k, v in samples.items()}, sample_chars)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``language`` (lang_pred, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def parsed(texts):
        return [{"lang_pred": a, "score": b} for a, b in zip(*shared.value.predict(texts))]

    return df.select("*", text_udf(kind, parsed, 512)(F.col(text)).alias("language"))


def query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0")
    model = fit(docs.where(~F.coalesce(held, F.lit(True))))
    out = identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")
