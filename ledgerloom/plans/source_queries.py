"""Queries of sources, renderings, profiles and the facade, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import kernel as K
from ledgerloom.operators import profile, shapes
from ledgerloom.plans.adapters import table
from ledgerloom.sources import git_source, json_files

Q, SQL = {}, {}
FINDINGS = "code string, subject string"


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("S02_json_gate", "SELECT event_id, event_id % 3 = 1 AS invalid, CASE WHEN event_id % 3 <> 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def s02(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 1 THEN substr(props, 1, length(props) - 1) ELSE props END").alias("body"))
    out = json_files.parsed(rows, "body", T.StructType([T.StructField("k", T.LongType())]))
    return out.select("event_id", "invalid", F.when(~F.col("invalid"), F.col("value.k")).alias("k"))


@query("S05_sarif_results", "SELECT 'shop.' || event_type || '/seen' AS ruleId, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS level, 'shop.' || event_type || '/seen: ' || event_id || ', ' || user_id AS message FROM events")
def s05(spark, d):
    rows = table(spark, d, "events").selectExpr("concat('shop.', event_type, '/seen') AS code", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity", "array(cast(event_id as string), cast(user_id as string)) AS subjects")
    return json_files.sarif_results(rows)


def _listing(spark, d, line: str):
    """One listing per source of documents, lines ended by NUL."""
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.expr(line))), "").alias("listing"))


@query("S10_tree", "SELECT '100644' AS mode, CASE WHEN doc_id % 9 = 0 THEN 'commit' ELSE 'blob' END AS type, sha1(text) AS blob, lang || '/a b' || doc_id AS path FROM documents")
def s10(spark, d):
    return git_source.parse_tree(_listing(spark, d, "concat('100644 ', CASE WHEN doc_id % 9 = 0 THEN 'commit' ELSE 'blob' END, ' ', sha1(text), '\\t', lang, '/a b', doc_id, '\\0')"))


@query("S11_status", "SELECT CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '?' ELSE 'u' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'M.' END AS state, lang || '/a b' || doc_id AS path FROM documents")
def s11(spark, d):
    line = """CASE doc_id % 3 WHEN 0 THEN concat('1 M. N... 100644 100644 100644 ', sha1(text), ' ', sha1(text), ' ', lang, '/a b', doc_id, '\\0')
      WHEN 1 THEN concat('? ', lang, '/a b', doc_id, '\\0') ELSE concat('u UU N... 100644 100644 100644 100644 ', sha1(text), ' ', sha1(text), ' ', sha1(text), ' ', lang, '/a b', doc_id, '\\0') END"""
    return git_source.parse_status(_listing(spark, d, line))


@query("S12_raw_diff", "SELECT CASE doc_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'D' END AS status, CASE WHEN doc_id % 3 = 1 THEN repeat('0', 40) ELSE sha1(text) END AS old_blob, CASE WHEN doc_id % 3 = 2 THEN repeat('0', 40) ELSE sha1(text || 'x') END AS new_blob, lang || '/a b' || doc_id AS path FROM documents")
def s12(spark, d):
    line = """concat(':100644 100644 ', CASE WHEN doc_id % 3 = 1 THEN repeat('0', 40) ELSE sha1(text) END, ' ', CASE WHEN doc_id % 3 = 2 THEN repeat('0', 40) ELSE sha1(concat(text, 'x')) END, ' ',
      CASE doc_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'D' END, '\\0', lang, '/a b', doc_id, '\\0')"""
    return git_source.parse_diff(_listing(spark, d, line))


@query("S08_compare", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status FROM documents WHERE doc_id % 4 <> 3")
def s08(spark, d):
    """The full outer join of a comparison, over two states of the documents."""
    rows = table(spark, d, "documents").selectExpr("doc_id", "sha1(text) AS blob")
    before = rows.where("doc_id % 4 <> 0").select("doc_id", F.col("blob").alias("old"))
    after = rows.where("doc_id % 4 <> 1").select("doc_id", F.expr("CASE WHEN doc_id % 4 = 2 THEN 'x' ELSE blob END").alias("new"))
    both = before.join(after, "doc_id", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("doc_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("status"))


@query("S13_byte_digest", "SELECT p_partkey, 'sha256:' || sha256('[' || array_to_string(list_transform(string_split(p_name, ''), lambda c: ascii(c)), ',') || ']') AS digest FROM part")
def s13(spark, d):
    return table(spark, d, "part").select("p_partkey", K.byte_list_digest(F.encode("p_name", "utf-8")).alias("digest"))


@query("S17_ref_grammar", "SELECT doc_id, doc_id % 6 < 2 AS exact FROM documents")
def s17(spark, d):
    ref = F.expr("CASE doc_id % 6 WHEN 0 THEN concat('feature/', source) WHEN 1 THEN concat('v', doc_id, '.0') WHEN 2 THEN concat(source, '..main') WHEN 3 THEN concat(source, '//x') WHEN 4 THEN concat(source, '.lock') ELSE concat('-', source) END")
    return table(spark, d, "documents").select("doc_id", K.is_exact_git_ref(ref).alias("exact"))


@query("S18_object_ids", "SELECT doc_id, doc_id % 3 < 2 AS ok FROM documents")
def s18(spark, d):
    name = F.expr("CASE doc_id % 3 WHEN 0 THEN sha1(text) WHEN 1 THEN sha2(text, 256) ELSE upper(sha1(text)) END")
    return table(spark, d, "documents").select("doc_id", name.rlike(K.OBJECT_ID).alias("ok"))


@F.pandas_udf(T.BooleanType())
def _holds(documents: pd.Series) -> pd.Series:
    return documents.map(lambda x: json_files.embedded_digest_holds(x, "digest"))


@query("A05_verify_projection", "SELECT event_id, event_id % 5 <> 2 AS holds FROM events")
def a05(spark, d):
    body = """concat('{"k":', get_json_object(props, '$.k'), ',"type":"', event_type, '"}')"""
    document = f"""concat('{{"type": "', event_type, '", "digest": "sha256:', CASE WHEN event_id % 5 = 2 THEN 'no' ELSE sha2({body}, 256) END, '", "k": ', get_json_object(props, '$.k'), '}}')"""
    return table(spark, d, "events").select("event_id", _holds(F.expr(document)).alias("holds"))


@query("V01_contract_findings", "SELECT * FROM (VALUES ('contract-invalid', 'contractRevision'), ('contract-invalid', 'criteria'), ('contract-invalid', 'extra'), ('contract-invalid', 'sections.requiredSectionIds'), ('contract-invalid', 'topics.resolutions')) v(code, subject)")
def v01(spark, d):
    value = {"schema": "s", "contractId": "c", "contractRevision": 0, "description": "d", "documentKind": "k", "sections": {"ordering": "exact", "requiredSectionIds": ["a", "a"]}, "topics": {"closedSet": ["t"], "resolutions": [], "inheritanceApplicability": ["adopts"]}, "references": {"exactFields": shapes.REFERENCE_FIELDS}, "criteria": {}, "extra": 1}
    return spark.createDataFrame(shapes.contract_findings(value, "s"), FINDINGS)


@query("V02_catalog_findings", "SELECT * FROM (VALUES ('catalog-candidate-duplicate', 'c1'), ('catalog-design-id-duplicate', 'c1'), ('catalog-invalid', 'c1:coverage'), ('catalog-release-field-forbidden', 'tarball')) v(code, subject)")
def v02(spark, d):
    entry = {"componentId": "c1", "designId": "d1", "artifactType": "t", "designRequirement": "full", "coverage": "all", "owner": "o"}
    value = {"schema": "s", "catalogId": "c", "catalogRevision": 1, "targetReleaseIntent": "1", "status": "x", "candidates": [entry, {**entry, "coverage": ""}], "externalRelations": [], "deferredCapabilities": [], "tarball": 1}
    return spark.createDataFrame(shapes.catalog_findings(value, "s"), FINDINGS)


@query("V04_registrations_findings", "SELECT * FROM (VALUES ('registrations-invalid', 'registrationsRevision'), ('registrations-invalid', 'schema')) v(code, subject)")
def v04(spark, d):
    return spark.createDataFrame(shapes.registrations_findings({"schema": "other", "registrationsId": "r", "registrations": []}, "s"), FINDINGS)


@query("V06_sections_conform", "SELECT doc_id, n_chars > 2000 AS conform FROM documents")
def v06(spark, d):
    found = F.expr("CASE WHEN n_chars > 2000 THEN array('scope', 'detail') ELSE array('detail', 'scope') END")
    return table(spark, d, "documents").select("doc_id", K.same_array(found, F.array(F.lit("scope"), F.lit("detail"))).alias("conform"))


_PROFILE = {
    "schema": "p@2", "profileId": "p", "documentContracts": ["a", "a@1", "a@2"], "gateMacros": [], "moduleLocks": [{"moduleId": "x", "lockedRevision": "x"}], "diagnosticHelp": [{"code": "acme.core/x", "help": ["h"]}],
    "relationRoleMappings": [{"mappingId": "m", "mappingRevision": 1, "relationKind": "impact", "assignedRole": "owner", "explanation": "why"}], "extra": 1,
}


@query("O01_profile_findings", """SELECT * FROM (VALUES ('unknown-field', 'profile.extra'), ('missing-field', 'profile.profileRevision'), ('incompatible-revision', 'profile.schema'), ('floating-ref', 'profile.documentContracts[0]'),
  ('duplicate-identity', 'profile.documentContracts[2]'), ('unknown-mapping', 'profile.relationRoleMappings[0].assignedRole'), ('consumer-term-in-core-contract', 'profile.diagnosticHelp[0].code'), ('floating-ref', 'profile.moduleLocks[0].lockedRevision')) v(code, subject)""")
def o01(spark, d):
    return spark.createDataFrame(profile.profile_findings(_PROFILE, "p@1", "acme"), FINDINGS)


@query("O06_profile_digest", """SELECT 'sha256:' || sha256('{"diagnosticHelp":[],"documentContracts":["a@2","b@1"],"gateMacros":[],"moduleLocks":[],"profileId":"p","profileRevision":3,"relationRoleMappings":[],"schema":"p@1"}') AS digest, 'valid' AS outcome""")
def o06(spark, d):
    value = {"schema": "p@1", "profileId": "p", "profileRevision": 3, "documentContracts": ["b@1", "a@2"], "gateMacros": [], "relationRoleMappings": [], "diagnosticHelp": [], "moduleLocks": []}
    out = profile.conformance(value, "p@1", "acme")
    return spark.createDataFrame([(out["digest"], out["outcome"])], "digest string, outcome string")


@query("O08_profile_help", "SELECT 'invalid-field' AS code, 'profile.profileId' AS subject, 'ask us,then wait' AS help")
def o08(spark, d):
    value = {"schema": "p@1", "profileId": "", "profileRevision": 3, "documentContracts": [], "gateMacros": [], "relationRoleMappings": [], "diagnosticHelp": [{"code": "acme.x/invalid-field", "help": ["then wait", "ask us"]}], "moduleLocks": []}
    found = profile.conformance(value, "p@1", "acme", help_prefix="acme.x/")["findings"]
    return spark.createDataFrame([(c, s, ",".join(h)) for c, s, h in found], "code string, subject string, help string")


@query("O09_recommendations", "SELECT * FROM (VALUES ('automatic-discovery', 'catalog.automaticDiscovery'), ('duplicate-identity', 'catalog.recommendations[1]'), ('unlocked-recommendation', 'catalog.recommendations[0].exact-commit-or-tag'), ('unlocked-recommendation', 'catalog.recommendations[1].exact-commit-or-tag')) v(code, subject)")
def o09(spark, d):
    entry = {"applicable-diagnostic": "a.b/c", "digest": "sha256:" + "0" * 64, "exact-commit-or-tag": "main", "license": "MIT", "path": "p", "source-repository": "r"}
    found = profile.recommendation_findings({"schema": "c", "catalogId": "c", "catalogRevision": 1, "automaticDiscovery": True, "recommendations": [entry, entry]}, "c")
    return spark.createDataFrame(found, FINDINGS)
