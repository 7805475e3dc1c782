"""Secret scans with multipart credential linking.

Strong finds (``assign``, ``access``, ``hex``) are reported wherever they are.  Weak candidates (``login``: a user or
client name; ``opaque``: a long mixed token; ``endpoint``: a service address) are reported only when their complement
stands within ``SCOPE`` characters, start to start: a login or an endpoint needs a secret part, an opaque token an
identifier.  The interval join deals parts to blocks of SCOPE characters, keeps the first and last start of each part
kind in a block, and meets a candidate's own block and its two neighbours: linear in the candidates, exact.

DataFrame expressions only: a regular expression's matches and the gaps between them give every span's position.
Offsets are code points, ends exclusive.

Defined results: null text counts as empty; equal rows get equal results; null doc_id is an identity of its own with its
text; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, sql_regex, written

SCOPE = 200
CHUNK = 128  # spans of a text that are handled together; results do not depend on it


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_IS = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + ")" + _IS + "([A-Za-z0-9+/_.=-]+)"
#: A run shorter than these holds no match from any of its later starts, so the bounds can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LOGIN = "(" + _either_case("client_?id|access_key_id|account_?name|username|user|login") + ")" + _IS + "([A-Za-z0-9._@-]{3,})"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x20\x09-\x0D\"'<>]+"

KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, LOGIN, OPAQUE, ENDPOINT)))
BASE = KINDS[:3]
#: The part that a kind can be, and the part that a weak kind needs.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "login": "id", "opaque": "secret", "endpoint": "place"}
NEEDS = {"login": "secret", "opaque": "id", "endpoint": "secret"}
_SPANS = "array<struct<start:bigint,end:bigint,k:int>>"


def _spans(kind: str) -> str:
    """Spark SQL: (start, end, k) of the matches of a kind in t, where the kind's rule on a match holds."""
    regex, k = sql_regex(PATTERNS[kind]), KINDS.index(kind)
    rule = {
        "assign": f"length(regexp_extract(y.m, {regex}, 2)) >= 6",
        "opaque": "y.m rlike '[0-9]' AND y.m rlike '[a-z]' AND y.m rlike '[A-Z]'",
    }.get(kind)
    span = "array<struct<start:bigint,end:bigint,m:string>>"
    # regexp_extract_all runs first; texts without a match are not split.  Positions are running sums, in two levels: an
    # array grows by CHUNK matches, and one of such arrays by one, so that a text's matches are not copied each time.
    pairs = f"zip_with(slice(split(t, {regex}), 1, size(m)), m, (g, m) -> named_struct('g', g, 'm', m))"
    chunks = f"transform(array({pairs}), z -> transform(sequence(0L, (size(z) - 1) div {CHUNK}), i -> slice(z, cast(i * {CHUNK} + 1 as int), {CHUNK})))[0]"
    step = "named_struct('at', b.at + length(x.g) + length(x.m), 'out', concat(b.out, array(named_struct('start', b.at + length(x.g), 'end', b.at + length(x.g) + length(x.m), 'm', x.m))))"
    part = f"aggregate(c, named_struct('at', a.at, 'out', cast(array() as {span})), (b, x) -> {step})"
    grown = f"transform(array({part}), y -> named_struct('at', y.at, 'out', concat(a.out, array(y.out))))[0]"
    found = f"aggregate({chunks}, named_struct('at', 0L, 'out', cast(array() as array<{span}>)), (a, c) -> {grown}, a -> flatten(a.out))"
    found = f"transform(array(regexp_extract_all(t, {regex}, 0)), m -> CASE WHEN size(m) = 0 THEN cast(array() as {span}) ELSE {found} END)[0]"
    kept = f"filter({found}, y -> {rule})" if rule else found
    return f"transform({kept}, y -> named_struct('start', y.start, 'end', y.end, 'k', {k}))"


def _rows(df: DataFrame, text: str, name: str) -> DataFrame:
    """``doc_id, th, base, weak`` for each row; th tells texts of one doc_id apart."""
    step = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.select("doc_id", "t", F.xxhash64("t").alias("th"), *[F.expr(_spans(k)).alias(k) for k in KINDS])
    step = step.withColumn("base", F.expr("sort_array(concat(assign, access, hex))"))
    # An opaque token or a login within a strong find is that find.
    # Strong finds are met in chunks of neighbours, each with its bounds.
    bounds = "named_struct('lo', get(p, 0).start, 'hi', array_max(transform(p, y -> y.end)), 'p', p)"
    step = step.withColumn("near", F.expr(f"transform(transform(sequence(0L, (size(base) - 1) div {CHUNK}), i -> slice(base, cast(i * {CHUNK} + 1 as int), {CHUNK})), p -> {bounds})"))
    meets = "exists(near, c -> c.lo < x.end AND x.start < c.hi AND exists(c.p, b -> b.start < x.end AND x.start < b.end))"
    outside = "filter({0}, x -> NOT coalesce(" + meets + ", false))"
    weak = f"concat({outside.format('login')}, {outside.format('opaque')}, endpoint)"
    slim = step.select("doc_id", "th", "base", F.expr(f"cast({weak} as {_SPANS})").alias("weak"))
    return written(slim, name)


def _case(values: dict) -> str:
    return "CASE k {} END".format(" ".join(f"WHEN {KINDS.index(a)} THEN '{b}'" for a, b in values.items()))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, th, added``: for each identity the weak spans whose complement is in scope."""
    some = rows.where(F.size("weak") > 0)
    parts = some.select("doc_id", "th", F.expr("inline(concat(base, weak))")).distinct()
    parts = parts.withColumn("role", F.expr(_case(ROLE))).withColumn("block", F.expr(f"start div {scope}"))
    ends = parts.groupBy("doc_id", "th", "role", "block").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    wanted = parts.withColumn("needs", F.expr(_case(NEEDS))).where("needs IS NOT NULL")
    wanted = wanted.select("doc_id", "th", "start", "end", "k", F.col("needs").alias("role"), F.explode(F.expr("array(block - 1, block, block + 1)")).alias("block"))
    met = wanted.alias("w").join(
        ends.alias("e"),
        F.expr("w.doc_id <=> e.doc_id AND w.th = e.th AND w.role = e.role AND w.block = e.block"),
    ).where(F.expr(f"(e.block = w.start div {scope}) OR (e.block < w.start div {scope} AND w.start - e.last <= {scope}) OR (e.block > w.start div {scope} AND e.first - w.start <= {scope})"))
    return met.groupBy("w.doc_id", "w.th").agg(F.sort_array(F.collect_set(F.struct("w.start", "w.end", "w.k"))).alias("added"))


def scan(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, th, base, added`` for each row of ``df``: strong spans, and weak ones that are linked.

    A span is (start, end, k), k an index of KINDS; both arrays are sorted by start, then kind.
    """
    rows = _rows(df, text, "secret-rows")
    found = linked(rows, scope).select(F.col("doc_id").alias("d2"), F.col("th").alias("th2"), "added")
    out = rows.join(found, rows.doc_id.eqNullSafe(found.d2) & (rows.th == found.th2), "left")
    by = "array_sort({}, (a, b) -> CASE WHEN a.start <> b.start THEN cast(sign(a.start - b.start) as int) ELSE a.k - b.k END)"
    return out.select("doc_id", "th", F.expr(by.format("base")).alias("base"), F.expr(by.format(f"coalesce(added, cast(array() as {_SPANS}))")).alias("added"))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``; all columns, and the rows' multiplicity, stay."""
    found = scan(df, text, scope).select("doc_id", "th", F.expr("array_sort(concat(base, added))").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])
    found = found.select(F.col("doc_id").alias("__d"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    # Spans in order; each keeps the text since the furthest end so far, and the last one the rest.
    walk = (
        "aggregate(__spans, named_struct('at', 0L, 'out', ''), (a, x) -> CASE WHEN x.start >= a.at"
        f" THEN named_struct('at', x.end, 'out', concat(a.out, substring(`{text}`, cast(a.at + 1 as int), cast(x.start - a.at as int)), '{mark}'))"
        f" ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END, a -> concat(a.out, substring(`{text}`, cast(a.at + 1 as int))))"
    )
    joined = df.join(found, df.doc_id.eqNullSafe(found["__d"]) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == found["__th"]), "left")
    return joined.select(*[F.expr(f"CASE WHEN __spans IS NULL THEN `{text}` ELSE {walk} END").alias(text) if c == text else df[c] for c in df.columns])


def _digest(spans: str) -> str:
    name = f"get(array({', '.join(map(repr, KINDS))}), x.k)"
    return f"array_join(transform({spans}, x -> concat({name}, ':', x.start, ':', x.end)), ',')"


def query(spark, sf_dir):
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}")
    every = "array_sort(concat(base, added), (a, b) -> CASE WHEN a.start <> b.start THEN cast(sign(a.start - b.start) as int) ELSE a.k - b.k END)"
    return out.select("doc_id", *map(count, BASE), F.expr(f"sha2({_digest('base')}, 256)").alias("base_sha256"), F.expr(_digest(every)).alias("spans"), F.expr("cast(size(added) as bigint)").alias("n_linked"))


def _duck(kind: str) -> str:
    regex, k = "'" + PATTERNS[kind].replace("'", "''") + "'", KINDS.index(kind)
    rule = {
        "assign": f"length(regexp_extract(x.m, {regex}, 2)) >= 6",
        "opaque": "regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[a-z]') AND regexp_matches(x.m, '[A-Z]')",
    }.get(kind, "true")
    at = "list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)"
    return f"""SELECT r, doc_id, {k} AS k, CAST(x.s AS BIGINT) AS s, CAST(x.s + length(x.m) AS BIGINT) AS e FROM (
    SELECT r, doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 's': {at}}})) AS x FROM (
      SELECT r, doc_id, regexp_extract_all(t, {regex}) AS m, string_split_regex(t, {regex}) AS g FROM d)) WHERE {rule}"""


_NAME = "['assign', 'access', 'hex', 'login', 'opaque', 'endpoint'][k + 1] || ':' || s || ':' || e"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({' UNION ALL '.join(_duck(k) for k in KINDS)}),
b AS (SELECT * FROM p WHERE k < 3),
w AS (SELECT * FROM p WHERE k >= 3 AND (k = 5 OR NOT EXISTS (
  SELECT 1 FROM b WHERE b.r = p.r AND b.s < p.e AND p.s < b.e))),
u AS (SELECT *, k IN (1, 3) AS is_id, k IN (0, 2, 4) AS is_secret FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
l AS (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM u WHERE u.r = w.r AND abs(u.s - w.s) <= {SCOPE}
  AND CASE WHEN w.k = 4 THEN u.is_id ELSE u.is_secret END)),
ba AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
  string_agg({_NAME}, ',' ORDER BY s, k) AS v FROM b GROUP BY r),
al AS (SELECT r, count(*) FILTER (k >= 3) AS n, string_agg({_NAME}, ',' ORDER BY s, k) AS v
  FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(ba.v, '')) AS base_sha256, coalesce(al.v, '') AS spans, coalesce(n, 0) AS n_linked
FROM d LEFT JOIN ba USING (r) LEFT JOIN al USING (r)
"""
