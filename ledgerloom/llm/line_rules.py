"""Line-first cleaning: rules on punctuation, navigation and boilerplate judge each line, failing lines go, and a
document that loses too much of its text goes as a whole.  DataFrame expressions only; one scan, no shuffle.

Defined results: a null text counts as empty; an empty text has no words, so its base rules fail; rows keep their
multiplicity; other columns pass through untouched, whatever their names, in a struct that the caller unpacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, sql_regex, words_sql

#: Phrases of site furniture, matched in the lower-cased line.
BOILERPLATE = (
    r"cookie policy|accept (all )?cookies|uses cookies|enable javascript|lorem ipsum|all rights reserved|"
    r"privacy policy|terms of (use|service)|sign in|sign up|subscribe (now|to)|click here|read more|"
    r"copyright ©|© ?[0-9]{4}|licensed under|released under the"
)
SYMBOLS = "#*$%&|<>!"
SEPARATORS = "|›»•·>"
TERMINAL = r"[.!?…。！？:;\"'”’»)\]][\x20\x09-\x0D]*\z"

MIN_LINE_WORDS = 3  # a line without a terminal mark needs so many words
MAX_SYMBOL_PERCENT = 15  # of a line's characters
MIN_SEPARATORS = 3  # of a navigation line, and at least a quarter of its words
MAX_LOSS_PERCENT = 50  # of a document's characters in lines with a word


def line_failed_sql(line: str) -> str:
    """Spark SQL that is true where a line with a word fails a rule."""
    size = f"regexp_count({line}, {sql_regex(WORD)})"
    number = lambda of: f"(length({line}) - length(translate({line}, '{of}', '')))"
    return (
        f"((NOT {line} rlike {sql_regex(TERMINAL)} AND {size} < {MIN_LINE_WORDS})"
        f" OR 100 * {number(SYMBOLS)} > {MAX_SYMBOL_PERCENT} * length({line})"
        f" OR ({number(SEPARATORS)} >= {MIN_SEPARATORS} AND 4 * {number(SEPARATORS)} >= {size})"
        f" OR lower({line}) rlike {sql_regex(BOILERPLATE)})"
    )


def line_rules(df: DataFrame, text: str = "text", max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """One row per row of ``df``: ``row`` (the row as a struct), ``clean_text`` (the lines that pass), the base counts
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``base_failed``, ``n_lines``, ``n_failed_lines``,
    ``kept``."""
    spaced = sql_regex(r"[^\x20\x09-\x0D]")
    step = df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).withColumn("t", F.expr(f"coalesce(row.`{text}`, '')"))
    step = step.select("row", "t", F.expr(words_sql("t")).alias("w"), F.expr(f"filter(split(t, '\\n'), l -> l rlike {spaced})").alias("l"))
    windows = "CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) ELSE array() END"
    step = step.select(
        "row", "l",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.expr(f"cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(l) - size(array_distinct(l)) as bigint)").alias("n_dup_lines"),
        F.expr(windows).alias("h"),
        F.expr(f"filter(l, x -> NOT {line_failed_sql('x')})").alias("good"),
    )
    # Only texts with a repeated window pay for the sort that finds where its occurrences are.
    step = step.withColumn("p", F.expr("CASE WHEN size(h) = size(array_distinct(h)) THEN cast(array() as array<struct<h:bigint,p:int>>) ELSE sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i))) END"))
    step = step.withColumn("p", F.expr("CASE WHEN size(p) = 0 THEN cast(array() as array<int>) ELSE sort_array(transform(filter(p, (x, i) -> coalesce(x.h = get(p, i - 1).h, false) OR coalesce(x.h = get(p, i + 1).h, false)), x -> x.p)) END"))
    step = step.withColumn("n_repeat_words", F.expr("aggregate(p, named_struct('n', 0L, 'to', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.to), 'to', x), a -> a.n)"))
    chars = "aggregate({}, 0L, (a, x) -> a + length(x))"
    step = step.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return step.select(
        "row",
        F.expr("array_join(good, '\\n')").alias("clean_text"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr("cast(size(l) as bigint)").alias("n_lines"),
        F.expr("cast(size(l) - size(good) as bigint)").alias("n_failed_lines"),
        F.expr(f"NOT base_failed AND 100 * ({chars.format('l')} - {chars.format('good')}) <= {max_loss_percent} * {chars.format('l')}").alias("kept"),
    )


def query(spark, sf_dir):
    from .common import documents

    out = line_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", *[c for c in out.columns if c not in ("row", "clean_text")], F.sha2("clean_text", 256).alias("clean_sha256"))


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SIZE = f"len(regexp_extract_all(x, {_duck(WORD)}))"
_LESS = "(length(x) - length(translate(x, '{}', '')))"
_FAILED = (
    f"((NOT regexp_matches(x, {_duck(TERMINAL)}) AND {_SIZE} < {MIN_LINE_WORDS})"
    f" OR 100 * {_LESS.format(SYMBOLS)} > {MAX_SYMBOL_PERCENT} * length(x)"
    f" OR ({_LESS.format(SEPARATORS)} >= {MIN_SEPARATORS} AND 4 * {_LESS.format(SEPARATORS)} >= {_SIZE})"
    f" OR regexp_matches(lower(x), {_duck(BOILERPLATE)}))"
)
ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
b AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, l,
    list_filter(l, lambda x: NOT {_FAILED}) AS good FROM a),
c AS (SELECT b.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS chars,
    coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS good_chars FROM b LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(good) AS BIGINT) AS n_failed_lines,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * (chars - good_chars) <= {MAX_LOSS_PERCENT} * chars AS kept,
  sha256(array_to_string(good, chr(10))) AS clean_sha256
FROM c
"""
