"""Queries of design closure and scope, with their SQL, over facts derived from supplier.

Supplier k is component Ck with design Dk and document DOC-k; faults are planted by k's remainders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import closure as C
from ledgerloom.plans.adapters import table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def facts(spark, d) -> C.Facts:
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k")
    ref = "named_struct('document_id', concat('DOC-', {0}), 'document_revision', {1}, 'section_id', '{2}', 'applicability', {3})"
    inherited = ref.format("k - k % 2 + (k + 1) % 2", "1L", "scope", "CASE WHEN k % 23 = 1 THEN 'overrides' WHEN k % 23 = 2 THEN 'bends' ELSE 'adopts' END")
    none = "cast(array() as array<struct<document_id:string,document_revision:bigint,section_id:string,applicability:string>>)"
    local = f"named_struct('resolution', 'local', 'section_id', CASE WHEN k % 29 = 3 THEN 'lost' ELSE 'scope' END, 'refs', {none}, 'reason', cast(null as string))"
    other = f"named_struct('resolution', 'inherited', 'section_id', cast(null as string), 'refs', CASE WHEN k % 31 = 4 THEN {none} ELSE array({inherited}) END, 'reason', cast(null as string))"
    apart = f"named_struct('resolution', 'not-applicable', 'section_id', cast(null as string), 'refs', {none}, 'reason', CASE WHEN k % 37 = 5 THEN '' ELSE 'no need' END)"
    empty = "cast(array() as array<string>)"
    registrations = s.where("k % 41 <> 6").selectExpr(
        "k AS pos", "concat('C', k) AS component_id", "CASE WHEN k % 13 = 5 THEN concat('X', k) ELSE concat('D', k) END AS design_id", "CASE WHEN k % 43 = 7 THEN 0L ELSE 1L END AS design_revision",
        "CASE WHEN k % 17 = 3 THEN 'odd' ELSE 'full' END AS design_requirement", "CASE WHEN k % 19 = 8 THEN 'superseded' WHEN k % 5 = 0 THEN 'proposed' ELSE 'accepted' END AS status", "cast(null as string) AS supersedes",
        "named_struct('document_id', concat('DOC-', k), 'document_revision', CASE WHEN k % 47 = 9 THEN 2L ELSE 1L END) AS document_ref",
        f"CASE WHEN k % 11 = 10 THEN map('scope', {local}, 'extra', {apart}) ELSE map('scope', {local}, 'risk', {other}, 'cost', {apart}) END AS topic_coverage",
        "array(concat('api', k, '@1')) AS provided_contract_refs", "array(concat('api', k - 1, CASE WHEN k % 7 = 2 THEN '@2' ELSE '@1' END)) AS required_contract_refs",
        "array(concat('state', k div 2 * CASE WHEN k % 6 < 2 THEN 1 ELSE 0 END + CASE WHEN k % 6 < 2 THEN 0 ELSE 1000000 + k END, '@1')) AS produced_state_refs",
        *[f"CASE WHEN k % 53 = 11 THEN array('loose') ELSE {empty} END AS {c}" for c in C.OTHER_REFS[1:2]], *[f"{empty} AS {c}" for c in C.OTHER_REFS[2:]],
        "CASE WHEN k % 10 = 4 THEN cast(array() as array<struct<criterion_id:string,section_id:string>>) ELSE array(named_struct('criterion_id', concat('crit', k), 'section_id', CASE WHEN k % 59 = 12 THEN 'gone' ELSE 'scope' END)) END AS acceptance_criteria",
    )
    extra = registrations.where("pos % 61 = 13").withColumn("component_id", F.expr("concat('C', pos + 900000)"))
    return C.Facts(
        sections=["scope", "detail"], topics=["scope", "risk", "cost"], minimum=1,
        candidates=s.selectExpr("k", "concat('C', k) AS component_id", "concat('D', k) AS design_id", "'package' AS artifact_type", "'full' AS design_requirement", "'all' AS coverage", "'team' AS owner"),
        registry=s.selectExpr("k", "concat('DOC-', k) AS document_id", "1L AS document_revision", "concat('d/', k, '.md') AS path", "'accepted' AS status", "CASE WHEN k % 14 = 6 THEN array('scope') ELSE array('scope', 'detail') END AS section_ids"),
        documents=s.where("k % 12 <> 7").selectExpr("concat('DOC-', k) AS document_id", "concat('# ', k) AS markdown"),
        index=s.where("k % 15 <> 8").selectExpr("concat('DOC-', k) AS artifact_id", "array('scope', 'detail') AS section_ids"),
        registrations=registrations.unionByName(extra),
    )


_BASE = """WITH s AS (SELECT s_suppkey AS k FROM supplier),
reg AS (SELECT k, 'C' || k AS c FROM s WHERE k % 41 <> 6 UNION ALL SELECT k, 'C' || (k + 900000) FROM s WHERE k % 41 <> 6 AND k % 61 = 13),
r AS (SELECT *, CASE WHEN k % 19 = 8 THEN 'superseded' WHEN k % 5 = 0 THEN 'proposed' ELSE 'accepted' END AS status, k % 47 <> 9 AS found, k % 11 = 10 AS odd, k < (SELECT count(*) FROM s) AS x FROM reg)
"""
_RULES = {
    "K01_document_missing": ("document-missing", "SELECT 'DOC-' || k AS subject FROM s WHERE k % 12 = 7"),
    "K02_document_unindexed": ("document-unindexed", "SELECT 'DOC-' || k AS subject FROM s WHERE k % 15 = 8"),
    "K03_document_sections": ("document-sections-mismatch", "SELECT 'DOC-' || k AS subject FROM s WHERE k % 15 <> 8 AND k % 14 = 6"),
    "K05_field_invalid": ("registration-field-invalid", "SELECT c || ':designRequirement' AS subject FROM r WHERE k % 17 = 3 UNION ALL SELECT c || ':designRevision' FROM r WHERE k % 43 = 7"),
    "K06_reference_not_exact": ("reference-not-exact", "SELECT c || ':consumed_state_refs:loose' AS subject FROM r WHERE k % 53 = 11"),
    "K07_document_ref_unresolved": ("document-ref-unresolved", "SELECT c AS subject FROM r WHERE NOT found"),
    "K08_contract_sections": ("contract-sections-mismatch", "SELECT 'DOC-' || k AS subject FROM r WHERE found AND k % 14 = 6"),
    "K09_topic_unknown": ("topic-unknown", "SELECT c || ':extra' AS subject FROM r WHERE odd"),
    "K10_topic_missing": ("topic-missing", "SELECT c || ':' || t AS subject FROM r, (SELECT unnest(['risk', 'cost']) AS t) WHERE odd"),
    "K11_topic_resolution": ("topic-resolution-invalid", "SELECT c || ':risk' AS subject FROM r WHERE NOT odd AND k % 31 = 4 UNION ALL SELECT c || ':cost' FROM r WHERE NOT odd AND k % 37 = 5"),
    "K12_section_unresolved": ("section-unresolved", "SELECT c || ':lost' AS subject FROM r WHERE k % 29 = 3 AND found"),
    "K13_overrides_forbidden": ("inheritance-overrides-forbidden", "SELECT c || ':risk' AS subject FROM r WHERE NOT odd AND k % 31 <> 4 AND k % 23 = 1"),
    "K13_applicability": ("inheritance-applicability-invalid", "SELECT c || ':risk' AS subject FROM r WHERE NOT odd AND k % 31 <> 4 AND k % 23 = 2"),
    "K14_reference_unresolved": ("reference-unresolved", "SELECT c || ':risk' AS subject FROM r WHERE NOT odd AND k % 31 <> 4 AND k - k % 2 + (k + 1) % 2 NOT IN (SELECT k FROM s)"),
    "K15_criterion_unresolved": ("criterion-unresolved", "SELECT c || ':gone' AS subject FROM r WHERE found AND k % 10 <> 4 AND k % 59 = 12"),
    "K16_registration_orphan": ("registration-orphan", "SELECT c AS subject FROM r WHERE c NOT IN (SELECT 'C' || k FROM s)"),
    "K17_design_id": ("design-id-mismatch", "SELECT c AS subject FROM r WHERE c = 'C' || k AND k % 13 = 5"),
    "K18_registration_missing": ("registration-missing", "SELECT 'C' || k AS subject FROM s WHERE k % 41 = 6"),
    "K18_registration_duplicate": ("registration-duplicate", "SELECT 'C' || k AS subject FROM s WHERE false"),
    "K19_not_retained": ("registration-not-retained", "SELECT c AS subject FROM r WHERE c = 'C' || k AND status = 'superseded'"),
    "K20_criterion_missing": ("criterion-missing", "SELECT c AS subject FROM r WHERE c = 'C' || k AND status <> 'superseded' AND k % 10 = 4"),
    "K21_contract_revision": ("contract-revision-mismatch", "SELECT DISTINCT 'api' || (k - 1) AS subject FROM r WHERE k % 7 = 2 AND k - 1 IN (SELECT k FROM r)"),
    "K22_contract_edge": ("contract-edge-mismatch", "SELECT DISTINCT 'api' || (k - 1) || CASE WHEN k % 7 = 2 THEN '@2' ELSE '@1' END AS subject FROM r WHERE k % 7 = 2 OR k - 1 NOT IN (SELECT k FROM r)"),
    "K23_truth_owner": ("truth-owner-duplicate", "SELECT 'state' || CASE WHEN k % 6 < 2 THEN k // 2 ELSE 1000000 + k END || '@1' AS subject FROM r GROUP BY 1 HAVING count(*) > 1"),
    "K24_inheritance_cycle": ("inheritance-cycle", "SELECT DISTINCT 'DOC-' || a.k AS subject FROM r a JOIN r b ON b.k = a.k - a.k % 2 + (a.k + 1) % 2 WHERE NOT a.odd AND a.k % 31 <> 4 AND NOT b.odd AND b.k % 31 <> 4 UNION SELECT 'DOC-' || k FROM r WHERE false"),
}


_PART_OF = {"K01": C.document_rules, "K02": C.document_rules, "K03": C.document_rules, "K05": None, "K06": C.field_rules, "K07": C.reference_rules, "K08": C.reference_rules, "K09": C.topic_rules, "K10": C.topic_rules, "K11": C.topic_rules, "K12": C.topic_rules, "K13": C.inheritance_rules, "K14": C.inheritance_rules, "K15": C.criterion_rules, "K20": C.criterion_rules, "K16": C.candidate_rules, "K17": C.candidate_rules, "K18": C.candidate_rules, "K19": C.candidate_rules, "K21": C.contract_rules, "K22": C.contract_rules, "K23": C.contract_rules, "K24": C.inheritance_cycles}


def _rule(name: str, code: str):
    part = _PART_OF[name[:3]] or (lambda f: C.field_rules(f).unionByName(C.candidate_rules(f)))
    return lambda spark, d: part(facts(spark, d)).where(F.col("code") == code).select("code", "subject")


for _name, (_code, _sql) in _RULES.items():
    query(_name, f"{_BASE} SELECT '{_code}' AS code, subject FROM ({_sql})")(_rule(_name, _code))


@query("K04_unknown_fields", "SELECT 'registration-field-unknown' AS code, 'C' || s_suppkey || ':' || k AS subject, 'gates' AS cls FROM supplier, (SELECT unnest(['extra', 'note']) AS k) WHERE s_suppkey % 9 = 1")
def k04(spark, d):
    body = """concat('{"componentId":"C', s_suppkey, '","status":"accepted"', CASE WHEN s_suppkey % 9 = 1 THEN ',"note":1,"extra":{"a":2}' ELSE '' END, '}')"""
    return C.unknown_fields(table(spark, d, "supplier").selectExpr("concat('C', s_suppkey) AS component_id", f"{body} AS body"))


@query("K26_closure_members", f"""{_BASE}, kept AS (SELECT * FROM r WHERE c = 'C' || k AND status <> 'superseded')
SELECT 'C' || s.k AS component_id, 'D' || s.k AS design_id, CAST(CASE WHEN kept.k IS NULL THEN NULL WHEN s.k % 43 = 7 THEN 0 ELSE 1 END AS BIGINT) AS revision, kept.status, CASE WHEN kept.k IS NOT NULL THEN 'DOC-' || s.k END AS document_id,
  CAST(CASE WHEN kept.k IS NOT NULL THEN 1 END AS BIGINT) AS n_local, CAST(CASE WHEN kept.k IS NOT NULL THEN CASE WHEN odd THEN 0 ELSE 1 END END AS BIGINT) AS n_inherited, CAST(CASE WHEN kept.k IS NOT NULL THEN 1 END AS BIGINT) AS n_not_applicable,
  CAST(CASE WHEN kept.k IS NOT NULL THEN CASE WHEN s.k % 10 = 4 THEN 0 ELSE 1 END END AS BIGINT) AS n_criteria FROM s LEFT JOIN kept ON kept.k = s.k""")
def k26(spark, d):
    return C.closure_members(facts(spark, d))


_ALL = " UNION ALL ".join(f"SELECT '{code}' AS code, subject FROM ({sql})" for code, sql in _RULES.values())


@query("K27_closure_counts", f"{_BASE} SELECT count(*) AS all_findings, count(DISTINCT code || '|' || subject) AS distinct_findings, 'invalid' AS outcome FROM ({_ALL})")
def k27(spark, d):
    return C.closure_counts(C.closure_findings(facts(spark, d)))


# ---- scope ------------------------------------------------------------------------------------------------------


def baseline(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k")
    return s.where("k % 16 <> 9").selectExpr(
        "k AS pos", "CASE WHEN k % 33 = 10 THEN concat('Z', k) ELSE concat('C', k) END AS component_id", "CASE WHEN k % 35 = 11 THEN concat('D', k - 1) ELSE concat('D', k) END AS design_id", "1L AS design_revision",
        "named_struct('document_id', concat('DOC-', k), 'document_revision', 1L) AS document_ref",
        "CASE WHEN k % 21 = 12 THEN 'sha256:short' WHEN k % 21 = 13 THEN concat('sha256:', sha2('x', 256)) ELSE concat('sha256:', sha2(concat('# ', k), 256)) END AS dossier_digest",
    )


@query("B03_baseline_findings", f"""{_BASE}, m AS (SELECT k, CASE WHEN k % 33 = 10 THEN 'Z' || k ELSE 'C' || k END AS c FROM s WHERE k % 16 <> 9),
t AS (SELECT m.*, CASE WHEN k % 21 = 12 THEN 'baseline-member-invalid' WHEN k % 33 = 10 THEN 'baseline-member-unknown' WHEN k % 35 = 11 THEN 'baseline-member-component-mismatch'
  WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.c = m.c AND status <> 'superseded') OR k % 13 = 5 OR k % 43 = 7 OR k % 47 = 9 THEN 'baseline-member-design-mismatch'
  WHEN k % 12 = 7 OR k % 21 = 13 THEN 'baseline-dossier-digest-mismatch' END AS code FROM m)
SELECT code, c || CASE WHEN k % 21 = 12 THEN ':dossierDigest' ELSE '' END AS subject, 'gates' AS cls FROM t WHERE code IS NOT NULL
UNION ALL SELECT 'baseline-member-missing', 'C' || k, 'gates' FROM s WHERE 'C' || k NOT IN (SELECT c FROM m WHERE k % 21 <> 12)
UNION ALL SELECT 'registration-not-accepted', c, 'gates' FROM r WHERE c = 'C' || k AND status = 'proposed'""")
def b03(spark, d):
    return C.baseline_findings(facts(spark, d), baseline(spark, d))


@query("B02_baseline_header", "SELECT * FROM (VALUES ('baseline-invalid', 'acceptedAt'), ('baseline-invalid', 'acceptedBy:principalType'), ('baseline-not-accepted', 'BL')) v(code, subject)")
def b02(spark, d):
    header = {"baselineId": "BL", "baselineRevision": 1, "targetRelease": "1.0.0", "status": "proposed", "acceptedAt": "2024-02-30", "acceptedBy": {"principalType": "robot", "principalId": "p"}}
    return spark.createDataFrame(C.baseline_header_findings(header, "1.0.0"), "code string, subject string")


def bom(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k")
    return s.where("k % 18 <> 1").selectExpr(
        "k AS pos", "CASE WHEN k % 20 = 2 THEN concat('Y', k) ELSE concat('C', k) END AS id", "CASE WHEN k % 22 = 3 THEN '0.9.0' ELSE '1.0.0' END AS version", "'package' AS type",
        "named_struct('design_id', concat('D', CASE WHEN k % 24 = 4 THEN k - 1 ELSE k END), 'design_revision', CASE WHEN k % 26 = 5 THEN 0L ELSE 1L END, 'baseline_id', 'BL', 'baseline_revision', CASE WHEN k % 28 = 6 THEN 2L ELSE 1L END) AS design_ref",
        "CASE WHEN k % 30 = 7 THEN cast(array() as array<struct<gate_id:string,criterion_ids:array<string>>>) WHEN k % 30 = 8 THEN array(named_struct('gate_id', 'g', 'criterion_ids', cast(array() as array<string>))) ELSE array(named_struct('gate_id', 'g', 'criterion_ids', CASE WHEN k % 32 = 9 THEN array(concat('crit', k), 'a') ELSE array(concat('crit', k)) END)) END AS completion_gates",
    )


@query("B13_bom_findings", f"""{_BASE}, m AS (SELECT k, CASE WHEN k % 20 = 2 THEN 'Y' || k ELSE 'C' || k END AS id FROM s WHERE k % 18 <> 1), good AS (SELECT * FROM m WHERE k % 26 <> 5), known AS (SELECT * FROM good WHERE id = 'C' || k),
own AS (SELECT k, 'C' || k AS c, k % 10 = 4 AS bare FROM r WHERE c = 'C' || k AND status <> 'superseded'),
des AS (SELECT CASE WHEN k % 13 = 5 THEN 'X' || k ELSE 'D' || k END AS did, c FROM r WHERE status <> 'superseded' AND k % 43 <> 7),
b AS (SELECT known.*, 'D' || CASE WHEN k % 24 = 4 THEN k - 1 ELSE k END AS did FROM known), g AS (SELECT * FROM known WHERE k % 30 NOT IN (7, 8))
SELECT 'scope-bom-invalid' AS code, id || ':version' AS subject FROM m WHERE k % 22 = 3 UNION ALL SELECT 'scope-bom-invalid', id || ':designRef' FROM m WHERE k % 26 = 5
UNION ALL SELECT 'scope-bom-member-unknown', id FROM good WHERE id <> 'C' || k UNION ALL SELECT 'scope-bom-member-missing', 'C' || k FROM s WHERE 'C' || k NOT IN (SELECT id FROM m)
UNION ALL SELECT 'design-ref-unresolved', id FROM b WHERE did NOT IN (SELECT did FROM des)
UNION ALL SELECT 'design-ref-component-mismatch', id FROM b WHERE did IN (SELECT did FROM des) AND NOT EXISTS (SELECT 1 FROM des WHERE des.did = b.did AND des.c = b.id)
UNION ALL SELECT 'design-ref-baseline-mismatch', id FROM known WHERE k % 28 = 6
UNION ALL SELECT 'scope-bom-invalid', id || ':completionGates' FROM known WHERE k % 30 = 7 UNION ALL SELECT 'scope-bom-gate-invalid', id || ':g' FROM known WHERE k % 30 = 8
UNION ALL SELECT 'scope-bom-criterion-order', id || ':g' FROM g WHERE k % 32 = 9 UNION ALL SELECT 'scope-bom-criterion-unknown', id || ':a' FROM g WHERE k % 32 = 9
UNION ALL SELECT 'scope-bom-criterion-unknown', id || ':crit' || k FROM g WHERE k NOT IN (SELECT k FROM own WHERE NOT bare)
UNION ALL SELECT 'scope-bom-criterion-missing', id FROM known WHERE k % 30 = 8 AND k IN (SELECT k FROM own WHERE NOT bare)""")
def b13(spark, d):
    return C.bom_member_findings(facts(spark, d), bom(spark, d), {"version": "1.0.0", "type": "package"}, ("BL", 1)).select("code", "subject")


@query("B23_retained", f"{_BASE} SELECT c AS component_id FROM r WHERE status <> 'superseded'")
def b23(spark, d):
    return facts(spark, d).retained.select("component_id")


@query("K25_facts_digest", "SELECT 'sha256:' || sha256('[' || string_agg('{\"componentId\":\"C' || s_suppkey || '\",\"designId\":\"D' || s_suppkey || '\"}', ',' ORDER BY '{\"componentId\":\"C' || s_suppkey || '\",\"designId\":\"D' || s_suppkey || '\"}') || ']') AS digest FROM supplier")
def k25(spark, d):
    return C.facts_digest(facts(spark, d).candidates, {"componentId": F.col("component_id"), "designId": F.col("design_id")})
