"""Queries of the scalar kernel and of diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import kernel as K
from ledgerloom.operators import findings as D
from ledgerloom.plans.adapters import ENTRIES, REPORTS, entries, registry, REGISTRY, reports, table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("F01_canonical_struct", """SELECT p_partkey, '{"brand":"' || p_brand || '","key":' || p_partkey || ',"name":"' || p_name || '","none":null}' AS body FROM part""")
def f01(spark, d):
    return table(spark, d, "part").select("p_partkey", K.canonical_struct({"name": F.col("p_name"), "key": F.col("p_partkey"), "brand": F.col("p_brand"), "none": F.lit(None).cast("string")}).alias("body"))


@query("F01_canonical_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS body FROM events")
def f01b(spark, d):
    return table(spark, d, "events").select("event_id", K.canonical_json("props").alias("body"))


@query("F02_digest", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def f02(spark, d):
    return table(spark, d, "documents").select("doc_id", K.digest(F.col("text")).alias("digest"))


@query("F03_code_point_compare", "SELECT page_id, CASE WHEN url < html THEN -1 WHEN url > html THEN 1 ELSE 0 END AS c FROM pages")
def f03(spark, d):
    return table(spark, d, "pages").select("page_id", K.code_point_compare(F.col("url"), F.col("html")).alias("c"))


@query("F04_array_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY string_split(p_name, ' '), p_partkey) AS INTEGER) AS place FROM part")
def f04(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "row_number() OVER (PARTITION BY p_brand ORDER BY split(p_name, ' '), p_partkey) AS place")


_REF = "CASE p_partkey % 4 WHEN 0 THEN p_name || '@' || p_size WHEN 1 THEN p_brand || '@1@' || p_size WHEN 2 THEN p_name || '@0' ELSE p_name END"
_SREF = "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '@', p_size) WHEN 1 THEN concat(p_brand, '@1@', p_size) WHEN 2 THEN concat(p_name, '@0') ELSE p_name END"


@query("F05_exact_reference", f"SELECT p_partkey, regexp_full_match({_REF}, '.+@[1-9][0-9]*') AS exact FROM part")
def f05(spark, d):
    return table(spark, d, "part").select("p_partkey", K.is_exact_reference(F.expr(_SREF)).alias("exact"))


@query("F06_reference_identity", f"SELECT p_partkey, regexp_extract({_REF}, '^(.+)@([1-9][0-9]*)$', 1) AS identity, regexp_extract({_REF}, '^(.+)@([1-9][0-9]*)$', 2) AS revision FROM part")
def f06(spark, d):
    return table(spark, d, "part").select("p_partkey", K.reference_identity(F.expr(_SREF)).alias("identity"), K.reference_revision(F.expr(_SREF)).alias("revision"))


_CODE = "CASE event_id % 4 WHEN 0 THEN 'shop.' || event_type || '/seen' WHEN 1 THEN 'shop.web.' || event_type || '/x-1' WHEN 2 THEN event_type || '/seen' ELSE 'Shop.' || event_type || '/seen' END"
_SCODE = "CASE event_id % 4 WHEN 0 THEN concat('shop.', event_type, '/seen') WHEN 1 THEN concat('shop.web.', event_type, '/x-1') WHEN 2 THEN concat(event_type, '/seen') ELSE concat('Shop.', event_type, '/seen') END"


@query("F07_diagnostic_code", rf"SELECT event_id, regexp_full_match({_CODE}, '[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)+/[a-z][a-z0-9-]*') AS ok FROM events")
def f07(spark, d):
    return table(spark, d, "events").select("event_id", K.is_diagnostic_code(F.expr(_SCODE)).alias("ok"))


@query("F08_section_id", "SELECT DISTINCT p_type, regexp_full_match(lower(p_type), '[a-z][a-z0-9-]*') AS lower_ok, regexp_full_match(p_type, '[a-z][a-z0-9-]*') AS ok FROM part")
def f08(spark, d):
    return table(spark, d, "part").select("p_type", K.is_section_id(F.lower("p_type")).alias("lower_ok"), K.is_section_id(F.col("p_type")).alias("ok")).distinct()


@query("F09_calendar_date", "SELECT o_orderkey, TRY_CAST('2023-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_custkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS ok FROM orders")
def f09(spark, d):
    day = "concat('2023-', lpad(cast(o_orderkey % 14 as string), 2, '0'), '-', lpad(cast(o_custkey % 33 as string), 2, '0'))"
    return table(spark, d, "orders").select("o_orderkey", K.is_calendar_date(F.expr(day)).alias("ok"))


@query("F10_is_sorted", "SELECT p_partkey, string_split(p_name, ' ') = list_sort(string_split(p_name, ' ')) AS sorted FROM part")
def f10(spark, d):
    return table(spark, d, "part").select("p_partkey", K.is_sorted(F.split("p_name", " ")).alias("sorted"))


@query("F11_same_array", "SELECT doc_id, coalesce([lang, source] = CASE WHEN doc_id % 3 = 0 THEN [source, lang] WHEN doc_id % 3 = 1 THEN [lang, source] END, false) AS same FROM documents")
def f11(spark, d):
    return table(spark, d, "documents").select("doc_id", K.same_array(F.array("lang", "source"), F.expr("CASE WHEN doc_id % 3 = 0 THEN array(source, lang) WHEN doc_id % 3 = 1 THEN array(lang, source) END")).alias("same"))


_KEYS = """CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k": 1, "z": 2}' ELSE '{"a": 1, "k": {"q": 2}}' END"""


@query("F12_keys_exactly", f"SELECT event_id, list_sort(json_keys({_KEYS})) = ['k'] AS exact FROM events")
def f12(spark, d):
    return table(spark, d, "events").select("event_id", K.keys_exactly(F.expr(_KEYS), ["k"]).alias("exact"))


@query("F13_unknown_keys", f"SELECT event_id, array_to_string(list_sort(list_filter(json_keys({_KEYS}), lambda x: x <> 'k')), ',') AS unknown FROM events")
def f13(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(K.unknown_keys(F.expr(_KEYS), ["k"]), ",").alias("unknown"))


_PATH = "CASE doc_id % 8 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN path || '/' WHEN 3 THEN '../' || path WHEN 4 THEN 'a//' || path WHEN 5 THEN 'C:' || path WHEN 6 THEN './' || path ELSE 'x\\y' END"
_SPATH = _PATH.replace("'/' || path", "concat('/', path)").replace("path || '/'", "concat(path, '/')").replace("'../' || path", "concat('../', path)").replace("'a//' || path", "concat('a//', path)").replace("'C:' || path", "concat('C:', path)").replace("'./' || path", "concat('./', path)").replace("'x\\y'", "'x\\\\y'")


@query("F14_normal_path", rf"""WITH {ENTRIES}, p AS (SELECT doc_id, {_PATH} AS path FROM entries)
SELECT doc_id, NOT (path = '' OR regexp_matches(path, '^[A-Za-z]:') OR contains(path, '\') OR len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0) AS ok FROM p""")
def f14(spark, d):
    return entries(spark, d).select("doc_id", K.is_normal_path(F.expr(_SPATH)).alias("ok"))


@query("F15_git_path", rf"""WITH {ENTRIES}, p AS (SELECT doc_id, {_PATH} AS p FROM entries),
q AS (SELECT doc_id, CASE WHEN starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') THEN 'absolute-path'
  WHEN list_contains(string_split(p, '/'), '..') THEN 'parent-escape' WHEN ends_with(p, '/') THEN 'unnormalizable-path' END AS rejected,
  array_to_string(list_filter(string_split(p, '/'), lambda s: s NOT IN ('', '.')), '/') AS path FROM p)
SELECT doc_id, CASE WHEN rejected IS NULL THEN path END AS path, rejected FROM q""")
def f15(spark, d):
    return entries(spark, d).select("doc_id", K.git_path(F.expr(_SPATH)).alias("g")).select("doc_id", "g.path", "g.rejected")


@query("F16_symlink_escape", f"WITH {ENTRIES} SELECT doc_id, doc_id % 5 > 2 OR doc_id % 7 = 0 AS escapes FROM entries")
def f16(spark, d):
    target = F.expr("CASE WHEN doc_id % 7 = 0 THEN '/etc' ELSE concat(repeat('../', cast(doc_id % 5 as int)), './x') END")
    return entries(spark, d).select("doc_id", K.symlink_escapes(F.col("path"), target).alias("escapes"))


_GLOB = "en/**/*7?.md"


@query("F18_glob_match", f"WITH {ENTRIES} SELECT doc_id, regexp_full_match(path, 'en(/[^/]*)*/[^/]*7[^/]\\.md', 's') AS fits FROM entries")
def f18(spark, d):
    return entries(spark, d).select("doc_id", K.glob_match(F.col("path"), _GLOB).alias("fits"))


@query("F17_glob_compile", """SELECT pattern, rejected FROM (VALUES ('a', NULL), ('*.md', NULL), ('**', NULL), ('**/x', NULL), ('a/**', NULL), ('a/**/**/b', NULL), ('', 'empty'), ('/a', 'absolute'), ('a//b', 'empty-segment'),
  ('a/../b', 'dot-segment'), ('[a]', 'unsupported-syntax'), ('a**', 'unsupported-syntax'), ('***', 'unsupported-syntax'), ('a\\b', 'unsupported-syntax'), ('a?c', NULL)) v(pattern, rejected)""")
def f17(spark, d):
    rows = []
    for p in ("a", "*.md", "**", "**/x", "a/**", "a/**/**/b", "", "/a", "a//b", "a/../b", "[a]", "a**", "***", "a\\b", "a?c"):
        try:
            K.glob_regex(p)
            rows.append((p, None))
        except K.GlobRejected as e:
            rows.append((p, e.args[0]))
    return spark.createDataFrame(rows, "pattern string, rejected string")


@query("F19_anchor", r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(translate(trim(split_part(text, chr(10), 1), ' ' || chr(9) || chr(13) || chr(12) || chr(11)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\x0B]+', '-', 'g'), '[\x00-,./:-\x5E`{-\x7F]', '', 'g'), ''), 'heading') AS anchor FROM documents""")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id", K.anchor_base(F.split("text", "\n")[0]).alias("anchor"))


@query("F20_section_marker", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 's-' || source END AS section FROM documents")
def f20(spark, d):
    marker = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('<!-- docs:section id="s-', source, '" -->') WHEN 1 THEN concat(' <!-- docs:section id="s-', source, '" -->') ELSE '<!-- docs:section id="S" -->' END""")
    return table(spark, d, "documents").select("doc_id", K.section_of_marker(marker, "docs").alias("section"))


@query("F24_constraint_id", "SELECT p_partkey, 'dependency:P' || p_partkey // 2 || '->P' || p_partkey AS id FROM part")
def f24(spark, d):
    from ledgerloom.operators.planning import constraint_id

    return table(spark, d, "part").select("p_partkey", constraint_id(F.expr("concat('P', p_partkey div 2)"), F.expr("concat('P', p_partkey)")).alias("id"))


@query("F26_topic_counts", """SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS local, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS inherited FROM conversations GROUP BY conv_id""")
def f26(spark, d):
    kind = F.expr("CASE role WHEN 'user' THEN 'local' WHEN 'assistant' THEN 'inherited' ELSE 'not-applicable' END")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.struct(kind.alias("resolution"))))).alias("m"))
    return rows.select("conv_id", K.topic_count(F.col("m"), "local").alias("local"), K.topic_count(F.col("m"), "inherited").alias("inherited"))


@query("F27_canonical_entries", """SELECT c_nationkey, md5(string_agg('{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '"}', ',' ORDER BY '{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '"}')) AS entries FROM customer GROUP BY c_nationkey""")
def f27(spark, d):
    one = K.canonical_struct({"id": F.col("c_custkey"), "seg": F.col("c_mktsegment")})
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list(one)), ",")).alias("entries"))


@query("F28_executable_token", "SELECT page_id, list_bool_or(list_transform([" + ", ".join(f"'{t}'" for t in K.EXECUTABLE_TOKENS) + "], lambda t: contains(url, t))) AS url_bad, contains(html, '<') AS html_bad FROM pages")
def f28(spark, d):
    return table(spark, d, "pages").select("page_id", K.has_executable_token(F.col("url")).alias("url_bad"), K.has_executable_token(F.col("html")).alias("html_bad"))


@query("F29_json_strings", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'k,z' ELSE 'a,k,q' END AS strings FROM events")
def f29(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(K.json_strings(F.expr(_KEYS)), ",").alias("strings"))


@query("F30_closed_json", "SELECT event_id, event_id % 3 <> 2 AS closed FROM events")
def f30(spark, d):
    return table(spark, d, "events").select("event_id", K.is_closed_json(F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[1, 2.5]' ELSE '{\"k\": NaN}' END")).alias("closed"))


@query("F31_commit_or_tag", "SELECT doc_id, doc_id % 3 < 2 AS exact FROM documents")
def f31(spark, d):
    return table(spark, d, "documents").select("doc_id", K.is_exact_commit_or_tag(F.expr("CASE doc_id % 3 WHEN 0 THEN substr(sha2(text, 256), 1, 40) WHEN 1 THEN concat('v1.', doc_id, '.0') ELSE 'main' END")).alias("exact"))


@query("F32_phase_of_code", "SELECT code, CASE WHEN code IN ('invalid-profile', 'unknown-field', 'missing-field') THEN 'load' ELSE 'conformance' END AS phase FROM (VALUES ('invalid-profile'), ('unknown-field'), ('missing-field'), ('floating-ref'), ('unknown-mapping')) v(code)")
def f32(spark, d):
    from ledgerloom.operators.profile import phase_of

    rows = spark.createDataFrame([(c,) for c in ("invalid-profile", "unknown-field", "missing-field", "floating-ref", "unknown-mapping")], "code string")
    return rows.select("code", phase_of(F.col("code")).alias("phase"))


@query("F33_exit_code", "SELECT DISTINCT event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 ELSE 4 END AS exit_code FROM events")
def f33(spark, d):
    outcome = F.expr("CASE event_type WHEN 'signup' THEN 'valid' WHEN 'purchase' THEN 'invalid-input' ELSE event_type END")
    return table(spark, d, "events").select("event_type", K.exit_code(outcome).alias("exit_code")).distinct()


# ---- diagnostics ------------------------------------------------------------------------------------------------


def _drafts(spark, d):
    rows = reports(spark, d)
    found = rows.selectExpr("'report-' || verdict AS code", "check_id AS subject", "CASE WHEN verdict = 'unresolved' THEN 'evidence' WHEN verdict = 'fail' THEN 'gates' ELSE 'input' END AS cls")
    return D.drafts(found, "checks", "report")


_DRAFT = f"""{REPORTS}, draft AS (
  SELECT 'report-' || verdict AS code, check_id AS subject, CASE verdict WHEN 'unresolved' THEN 'evidence' WHEN 'fail' THEN 'gates' ELSE 'input' END AS category,
    CASE verdict WHEN 'unresolved' THEN 'unresolved' ELSE 'fail' END AS v FROM reports)"""


@query("D02_drafts", f"WITH {_DRAFT} SELECT code, category, v AS verdict, subject, count(*) AS n FROM draft GROUP BY ALL")
def d02(spark, d):
    return _drafts(spark, d).groupBy("code", "category", "verdict", F.col("subjects")[0].alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query("D01_draft_findings", f"WITH {_DRAFT} SELECT 'invalid-field' AS code, 'diagnostic.code' AS subject, 'input' AS cls FROM draft")
def d01(spark, d):
    return D.draft_findings(_drafts(spark, d).drop("location").withColumn("location", F.lit(None).cast("string")))


@query("D06_finalized", f"""WITH {_DRAFT} SELECT DISTINCT code, subject, 'sha256:' || sha256('{{"category":"' || category || '","causes":[],"code":"' || code || '","help":[],"location":null,"origin":"checks","parameters":{{}},"phase":"report","ruleId":"' || code || '","severity":"error","subjects":["' || subject || '"],"verdict":"' || v || '"}}') AS digest FROM draft""")
def d06(spark, d):
    return D.finalized(_drafts(spark, d)).select("code", F.col("subjects")[0].alias("subject"), "digest")


@query("D07_outcome", f"WITH {_DRAFT} SELECT max(CASE WHEN category = 'input' THEN 2 WHEN v IN ('fail', 'unresolved') THEN 1 ELSE 0 END) AS exit_code, 'invalid-input' AS outcome FROM draft")
def d07(spark, d):
    return D.outcome(_drafts(spark, d))


@query("D08_ordered_findings", f"WITH {_DRAFT} SELECT code, subject, category AS cls FROM draft")
def d08(spark, d):
    return D.ordered(_drafts(spark, d).select("code", F.col("subjects")[0].alias("subject"), F.col("category").alias("cls")))


@query("D09_coalesced", f"WITH {_DRAFT} SELECT DISTINCT code, subject, category AS cls FROM draft")
def d09(spark, d):
    return D.coalesced(_drafts(spark, d).select("code", F.col("subjects")[0].alias("subject"), F.col("category").alias("cls")))


@query("D10_declarations", """WITH v(kind, field, required) AS (VALUES ('user', 'k', true), ('user', 't', false), ('assistant', 'k', true), ('assistant', 'r', true)),
c AS (SELECT conv_id || '/' || turn AS decl_id, CASE WHEN turn = 5 THEN 'tool' ELSE role END AS kind, CASE turn % 3 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'r'] ELSE ['t'] END AS keys FROM conversations),
f AS (SELECT decl_id, kind, unnest(keys) AS field FROM c WHERE kind IN (SELECT kind FROM v))
SELECT 'unknown-declaration-kind' AS code, decl_id AS subject, 'input' AS cls FROM c WHERE kind NOT IN (SELECT kind FROM v)
UNION ALL SELECT 'unknown-field', decl_id || '.' || field, 'input' FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.kind = f.kind AND v.field = f.field)
UNION ALL SELECT 'missing-field', decl_id || '.' || v.field, 'input' FROM c JOIN v ON c.kind = v.kind WHERE required AND NOT list_contains(keys, v.field)""")
def d10(spark, d):
    vocabulary = spark.createDataFrame([("user", "k", True), ("user", "t", False), ("assistant", "k", True), ("assistant", "r", True)], "kind string, field string, required boolean")
    rows = table(spark, d, "conversations").selectExpr("concat(conv_id, '/', turn) AS decl_id", "CASE WHEN turn = 5 THEN 'tool' ELSE role END AS kind", "CASE turn % 3 WHEN 0 THEN array('k') WHEN 1 THEN array('k', 'r') ELSE array('t') END AS keys")
    return D.declaration_findings(rows, vocabulary)
