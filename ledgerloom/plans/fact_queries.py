"""Queries of graphs, planning, selectors, ledgers, evidence and change plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import governance as V
from ledgerloom.operators import graph as G
from ledgerloom.operators import planning as L
from ledgerloom.operators import selectors as S
from ledgerloom.plans import adapters as A

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


# ---- graphs -----------------------------------------------------------------------------------------------------


@query("G01_canonical_nodes", "SELECT 'P' || p_partkey AS id, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS sort_key FROM part")
def g01(spark, d):
    return G.canonical(A.part_graph(spark, d)[0])


@query("G02_graph_findings", """WITH n AS (SELECT 'P' || p_partkey // 2 AS id FROM part WHERE p_partkey % 3 <> 0)
SELECT 'duplicate-node-id' AS code, id AS subject, 'input' AS cls FROM n GROUP BY id HAVING count(*) > 1""")
def g02(spark, d):
    nodes, edges = A.part_graph(spark, d)
    return G.graph_findings(A.table(spark, d, "part").where("p_partkey % 3 <> 0").selectExpr("concat('P', p_partkey div 2) AS id", "'' AS sort_key"), edges)


@query("G03_unresolved_endpoints", f"""WITH {A.PART_GRAPH}, n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0)
SELECT 'unresolved-endpoint' AS code, id || '.from' AS subject, 'input' AS cls FROM e WHERE s NOT IN (SELECT k FROM n)
UNION ALL SELECT 'unresolved-endpoint', id || '.to', 'input' FROM e WHERE t NOT IN (SELECT k FROM n)""")
def g03(spark, d):
    nodes, edges = A.part_graph(spark, d)
    return G.graph_findings(nodes.where("cast(sort_key as bigint) % 5 <> 0"), edges)


@query("G04_adjacency", """WITH o AS (SELECT 'P' || l_partkey AS id, md5(string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_orderkey || '-' || l_linenumber)) AS e, count(*) AS n FROM lineitem GROUP BY 1),
i AS (SELECT 'S' || l_suppkey AS id, md5(string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_orderkey || '-' || l_linenumber)) AS e, count(*) AS n FROM lineitem GROUP BY 1),
n AS (SELECT 'P' || p_partkey AS id FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier)
SELECT id, coalesce(o.e, md5('')) AS out_md5, coalesce(o.n, 0) AS n_out, coalesce(i.e, md5('')) AS in_md5, coalesce(i.n, 0) AS n_in FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def g04(spark, d):
    out = G.adjacency(*A.pair_graph(spark, d))
    side = lambda c: (F.md5(F.array_join(f"{c}_edges", ",")).alias(f"{c}_md5"), F.size(f"{c}_edges").cast("long").alias(f"n_{c}"))
    return out.select("id", *side("out"), *side("in"))


@query("G05_reachable", """SELECT 'R1' AS id UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def g05(spark, d):
    return G.reachable(*A.place_tree(spark, d), spark.createDataFrame([("R1",)], "id string"))


_REACH = f"""WITH RECURSIVE {A.SUPPLIER_GRAPH},
r(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.a, g.t FROM r JOIN g ON g.s = r.b),
c AS (SELECT x.a AS k, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query("G06_strong_components", f"{_REACH} SELECT 'S' || k AS id, 'S' || root AS component FROM c")
def g06(spark, d):
    return G.strong_components(*A.supplier_graph(spark, d))


@query("G07_condensed", f"{_REACH} SELECT id, 'link' AS role, 'S' || a.root AS src_component, 'S' || b.root AS dst_component FROM g JOIN c a ON a.k = s JOIN c b ON b.k = t WHERE a.root <> b.root")
def g07(spark, d):
    return G.condensed(*A.supplier_graph(spark, d))[1]


_WAVES = f"""WITH RECURSIVE {A.PART_GRAPH},
r(n, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT t FROM e) UNION SELECT e.t, d + 1 FROM r JOIN e ON e.s = r.n)"""


@query("G08_waves", f"{_WAVES} SELECT 'P' || n AS id, CAST(max(d) AS BIGINT) AS wave FROM r GROUP BY n")
def g08(spark, d):
    return G.waves(*A.part_graph(spark, d))


@query("G09_cycle_witness", f"""{_REACH}, f AS (SELECT s, min(t) AS t FROM g JOIN c a ON a.k = s JOIN c b ON b.k = t WHERE a.root = b.root GROUP BY s),
w(n, k) AS (SELECT (SELECT min(s) FROM f), 0 UNION ALL SELECT f.t, k + 1 FROM w JOIN f ON f.s = w.n WHERE k < 1000),
u AS (SELECT n, min(k) AS k, count(*) AS times FROM w GROUP BY n)
SELECT 'S' || n AS id, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS pos FROM u WHERE times > 1""")
def g09(spark, d):
    return spark.createDataFrame(list(enumerate(G.cycle_witness(*A.supplier_graph(spark, d)))), "pos bigint, id string").select("id", "pos")


_LONG = f"""WITH RECURSIVE {A.PART_GRAPH},
r(n, v) AS (SELECT p_partkey, CAST(0 AS DOUBLE) FROM part WHERE p_partkey NOT IN (SELECT t FROM e) UNION SELECT e.t, v + w FROM r JOIN e ON e.s = r.n),
best AS (SELECT n, max(v) AS v FROM r GROUP BY n)"""


@query("G10_longest_paths", f"""{_LONG}, o AS (SELECT e.t, e.id, b.v + e.w AS v, row_number() OVER (PARTITION BY e.t ORDER BY b.v + e.w DESC, e.id) AS k FROM e JOIN best b ON b.n = e.s)
SELECT 'P' || n AS id, best.v AS value, o.id AS via_edge, false AS overflow FROM best LEFT JOIN o ON o.t = n AND k = 1""")
def g10(spark, d):
    return G.longest_paths(*A.part_graph(spark, d))


@query("G11_overflow", f"""{_WAVES.replace('AS w FROM', 'AS w FROM')}, bad AS (SELECT DISTINCT n FROM (SELECT t AS n FROM e WHERE t = 40 UNION ALL SELECT 0 WHERE false)),
x(n) AS (SELECT n FROM bad UNION SELECT e.t FROM x JOIN e ON e.s = x.n)
SELECT 'P' || p_partkey AS id, p_partkey IN (SELECT n FROM x) AS overflow FROM part""")
def g11(spark, d):
    nodes, edges = A.part_graph(spark, d)
    heavy = F.when(F.col("dst").isin("P20", "P40"), F.lit(1.7e308)).otherwise(F.lit(1.0))
    return G.longest_paths(nodes, edges.withColumn("weight", heavy)).select("id", "overflow")


@query("G12_critical_path", f"""{_LONG}, o AS (SELECT e.t, e.s, row_number() OVER (PARTITION BY e.t ORDER BY b.v + e.w DESC, e.id) AS k FROM e JOIN best b ON b.n = e.s),
w(n, back) AS (SELECT (SELECT n FROM best ORDER BY v DESC, n LIMIT 1), 0 UNION ALL SELECT o.s, back + 1 FROM w JOIN o ON o.t = w.n AND o.k = 1)
SELECT CAST(max(back) OVER () - back AS BIGINT) AS pos, 'P' || n AS id FROM w""")
def g12(spark, d):
    nodes, edges = A.part_graph(spark, d)
    path = G.critical_path(nodes, edges, G.longest_paths(nodes, edges))
    return spark.createDataFrame(list(enumerate(path)), "pos bigint, id string")


@query("G15_weak_components", "SELECT 'P' || p_partkey AS id, 'P0' AS component FROM part")
def g15(spark, d):
    return G.weak_components(*A.part_graph(spark, d))


# ---- planning ---------------------------------------------------------------------------------------------------

_DEP = "'dependency:P' || p || '->P' || k"
_FAULTY = """f AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 10 WHEN 0 THEN [p_partkey] WHEN 1 THEN [-1] WHEN 2 THEN [p_partkey // 2, p_partkey // 2] ELSE [p_partkey // 2] END) AS p FROM part)"""


@query("L01_problem_findings", f"""WITH {_FAULTY}
SELECT 'dependency-self' AS code, {_DEP} AS subject, 'input' AS cls FROM f WHERE k = p
UNION ALL SELECT 'dependency-unresolved', {_DEP}, 'input' FROM f WHERE k <> p AND p NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'dependency-duplicate', {_DEP}, 'input' FROM (SELECT k, p FROM f WHERE k <> p AND p >= 0 GROUP BY k, p HAVING count(*) > 1)""")
def l01(spark, d):
    return L.problem_findings(A.faulty_tasks(spark, d), max_tasks=10**9, max_dependencies=10**9)


@query("L02_shape_findings", "SELECT 'problem-invalid' AS code, CASE WHEN p_partkey % 2 = 0 THEN 'taskId' ELSE 'dependsOn' END AS subject, 'input' AS cls FROM part WHERE p_partkey % 100 < 2")
def l02(spark, d):
    t = A.tasks(spark, d)
    n = "cast(substr(task_id, 2) as bigint) % 100"
    return L.shape_findings(t.selectExpr(f"CASE WHEN {n} = 0 THEN '' ELSE task_id END AS task_id", f"CASE WHEN {n} = 1 THEN null ELSE depends_on END AS depends_on"))


@query("L03_dimension_findings", "SELECT * FROM (VALUES ('dimension-unknown', 'speed'), ('problem-invalid', 'time')) v(code, subject)")
def l03(spark, d):
    return spark.createDataFrame(L.dimension_findings(["time", "speed", "time"]), "code string, subject string")


@query("L04_duplicate_tasks", "SELECT 'task-duplicate' AS code, 'P' || p_partkey // 2 AS subject, 'input' AS cls FROM part GROUP BY p_partkey // 2 HAVING count(*) > 1")
def l04(spark, d):
    return L.duplicate_tasks(A.table(spark, d, "part").selectExpr("concat('P', p_partkey div 2) AS task_id"))


@query("L08_budget_findings", f"WITH {A.TASKS} SELECT 'budget-exhausted' AS code, 'tasks' AS subject, 'input' AS cls FROM tasks HAVING count(*) > 100 UNION ALL SELECT 'budget-exhausted', 'dependencies', 'input' FROM dep HAVING count(*) > 1000")
def l08(spark, d):
    return L.budget_findings(A.tasks(spark, d), 100, 1000)


@query("L09_constraints", f"WITH {A.TASKS} SELECT {_DEP} AS constraint_id FROM dep")
def l09(spark, d):
    return L.constraints(A.tasks(spark, d))


@query("L10_unsupported_dimensions", "SELECT * FROM (VALUES ('unsupported-dimension', 'resource'), ('unsupported-dimension', 'time')) v(code, subject)")
def l10(spark, d):
    return spark.createDataFrame(L.dimension_findings(["time", "dependency", "resource"]), "code string, subject string")


@query("L12_planning_waves", f"{_WAVES} SELECT 'P' || n AS task_id, CAST(max(d) AS BIGINT) AS wave FROM r GROUP BY n")
def l12(spark, d):
    outcome, _, waves = L.schedule(A.tasks(spark, d), max_tasks=10**9, max_dependencies=10**9)
    assert outcome == "valid"
    return waves


@query("L12_facts_digest", f"""WITH {A.TASKS}, j AS (SELECT task_id, '{{"dependsOn":[' || array_to_string(list_sort(list_transform(deps, lambda x: '"P' || x || '"')), ',') || '],"taskId":"' || task_id || '"}}' AS j FROM tasks)
SELECT 'sha256:' || sha256('{{"dimensions":["dependency"],"tasks":[' || string_agg(j, ',' ORDER BY task_id) || ']}}') AS facts_digest FROM j""")
def l12b(spark, d):
    return L.facts_digest(A.tasks(spark, d))


@query("L13_ordering_graph", f"WITH {A.TASKS} SELECT {_DEP} AS id, 'P' || p AS src, 'P' || k AS dst FROM dep")
def l13(spark, d):
    return L.ordering_graph(A.tasks(spark, d))[1].select("id", "src", "dst")


# ---- selectors --------------------------------------------------------------------------------------------------

_SELECTORS = {
    "P01_all": ({"all": [{"kind": {"any": ["en", "de"]}}, {"status": {"any": ["accepted"]}}]}, "kind IN ('en', 'de') AND status = 'accepted'"),
    "P02_any": ({"any": [{"owner": {"any": ["src1"]}}, {"artifactId": "DOC-7"}]}, "owner = 'src1' OR artifact_id = 'DOC-7'"),
    "P03_not": ({"not": {"tag": {"any": ["fr", "src3"]}}}, "NOT (list_has_any(tags, ['fr', 'src3']))"),
    "P04_artifact_id": ({"artifactId": "DOC-3"}, "artifact_id = 'DOC-3'"),
    "P05_path": ({"path": "de/*/1*.md"}, "regexp_full_match(path, 'de/[^/]*/1[^/]*\\.md')"),
    "P06_kind": ({"kind": {"any": ["es"]}}, "kind = 'es'"),
    "P07_status": ({"status": {"any": ["proposed", "superseded"]}}, "status IN ('proposed', 'superseded')"),
    "P08_owner": ({"owner": {"any": ["src2", "src5"]}}, "owner IN ('src2', 'src5')"),
    "P09_tag": ({"tag": {"any": ["es", "src7"]}}, "list_has_any(tags, ['es', 'src7'])"),
    "P10_reference": ({"reference": {"target": "DOC-0", "role": "derives"}}, "artifact_id IN (SELECT from_artifact_id FROM relations WHERE target_artifact_id = 'DOC-0' AND role = 'derives')"),
    "P11_traceability": ({"traceability": {"target": "DOC-0"}}, "false"),
    "P12_diagnostic": ({"any": [{"diagnostic": "a.b/c"}, {"artifactId": "DOC-1"}]}, "artifact_id = 'DOC-1'"),
    "P13_namespace": ({"not": {"namespace": "a"}}, "true"),
}


def _selection(source):
    return lambda spark, d: S.matched(A.entries_with_relations(spark, d), S.compile_selector(source)).select("artifact_id")


for _name, (_source, _where) in _SELECTORS.items():
    query(_name, f"WITH {A.ENTRIES}, {A.RELATIONS} SELECT artifact_id FROM entries WHERE {_where}")(_selection(_source))


@query("P14_invalid_selectors", "SELECT * FROM (VALUES ('selector'), ('selector.all'), ('selector.kind'), ('selector.min'), ('selector.path')) v(subject)")
def p14(spark, d):
    found = []
    for source in ({}, {"all": []}, {"kind": {"any": []}}, {"kind": {"any": ["a"]}, "min": -1}, {"path": "a**"}):
        try:
            S.compile_selector(source)
        except S.InvalidSelector as e:
            found += [(x,) for x in e.args[0]]
    return spark.createDataFrame(found, "subject string")


@query("P17_unresolved_targets", "SELECT 'selector.any[1].reference' AS subject")
def p17(spark, d):
    selector = S.compile_selector({"any": [{"reference": {"target": "DOC-1"}}, {"reference": {"target": "DOC-none"}}]})
    return spark.createDataFrame([(x,) for x in S.unresolved_targets(A.entries(spark, d), selector)], "subject string")


@query("P18_select", f"WITH {A.ENTRIES} SELECT artifact_id FROM entries WHERE kind = 'en' AND owner = 'src4' AND NOT status = 'accepted'")
def p18(spark, d):
    source = {"all": [{"kind": {"any": ["en"]}}, {"owner": {"any": ["src4"]}}, {"not": {"status": {"any": ["accepted"]}}}], "min": 0}
    return S.select_documents(A.entries_with_relations(spark, d), source)["matches"]


@query("P19_cardinality", "SELECT 'selector' AS subject, true AS violated")
def p19(spark, d):
    try:
        S.select_documents(A.entries_with_relations(spark, d), {"artifactId": "DOC-1", "min": 2})
        found = []
    except S.InvalidSelector as e:
        found = [(x, True) for x in e.args[0]]
    return spark.createDataFrame(found, "subject string, violated boolean")


@query("P20_zero_match", "SELECT * FROM (VALUES ('default', 'zero-match-diagnostic'), ('min 0', NULL), ('min 1', 'zero-match-diagnostic')) v(selection, diagnostic)")
def p20(spark, d):
    e = A.entries_with_relations(spark, d)
    cases = {"default": {}, "min 0": {"min": 0}, "min 1": {"min": 1}}
    return spark.createDataFrame([(k, S.select_documents(e, {"namespace": "none", **v})["diagnostic"]) for k, v in cases.items()], "selection string, diagnostic string")


@query("P21_explain", f"""WITH {A.ENTRIES}, m AS (SELECT artifact_id, kind = 'en' AS a, owner = 'src1' AS b, status = 'accepted' AS c FROM entries)
SELECT artifact_id, array_to_string(list_filter([
  'selector:' || CASE WHEN a AND (b OR c) THEN 'admitted' ELSE 'rejected' END, 'selector.all[0]:' || CASE WHEN a THEN 'admitted' ELSE 'rejected' END,
  CASE WHEN a THEN 'selector.all[1]:' || CASE WHEN b OR c THEN 'admitted' ELSE 'rejected' END END,
  CASE WHEN a THEN 'selector.all[1].any[0]:' || CASE WHEN b THEN 'admitted' ELSE 'rejected' END END,
  CASE WHEN a AND NOT b THEN 'selector.all[1].any[1]:' || CASE WHEN c THEN 'admitted' ELSE 'rejected' END END], lambda x: x IS NOT NULL), ' ') AS trace FROM m""")
def p21(spark, d):
    source = {"all": [{"kind": {"any": ["en"]}}, {"any": [{"owner": {"any": ["src1"]}}, {"status": {"any": ["accepted"]}}]}]}
    out = S.explained(A.entries_with_relations(spark, d), S.compile_selector(source))
    return out.select("artifact_id", F.array_join(F.transform("trace", lambda x: F.concat(x["subject"], F.lit(":"), x["outcome"])), " ").alias("trace"))


# ---- registry, ledger, evidence, macros -------------------------------------------------------------------------


@query("R01_registry", f"""WITH {A.ENTRIES}, {A.REGISTRY}, {A.INDEX}, j AS (SELECT document_id, r.section_ids AS a, f.section_ids AS b, artifact_id FROM registry r LEFT JOIN found f ON document_id = artifact_id)
SELECT CASE WHEN artifact_id IS NULL THEN 'registry-document-unindexed' ELSE 'document-sections-mismatch' END AS code, document_id AS subject, 'gates' AS cls FROM j WHERE artifact_id IS NULL OR a <> b""")
def r01(spark, d):
    return V.registry_findings(A.registry(spark, d), A.index_sections(spark, d))


@query("V03_registry_shape", f"""WITH {A.ENTRIES}, {A.REGISTRY}, s AS (SELECT document_id, CASE WHEN document_revision <= 0 THEN 'documentRevision' WHEN starts_with(path, '/') THEN 'path'
  WHEN status NOT IN ('proposed', 'accepted', 'superseded') THEN 'status' WHEN len(list_distinct(section_ids)) <> len(section_ids) THEN 'sectionIds' END AS f FROM registry)
SELECT 'registry-invalid' AS code, document_id || ':' || f AS subject, 'input' AS cls FROM s WHERE f IS NOT NULL""")
def v03(spark, d):
    return V.registry_shape(A.registry(spark, d))


@query("F25_ledger_records", f"WITH RECURSIVE {A.LEDGER} SELECT ledger_id, pos, record_id, record_digest FROM ledger")
def f25(spark, d):
    return A.ledger(spark, d).select("ledger_id", "pos", "record_id", "record_digest")


@query("R04_ledger_findings", f"""WITH RECURSIVE {A.LEDGER}, {A.TAMPERED}, t AS (SELECT *, lag(record_digest) OVER (PARTITION BY ledger_id ORDER BY pos) AS before, row_number() OVER (PARTITION BY ledger_id, record_id ORDER BY pos) AS nth FROM tampered)
SELECT 'ledger-record-duplicate' AS code, record_id AS subject, 'gates' AS cls FROM t WHERE nth > 1
UNION ALL SELECT 'ledger-genesis-invalid', record_id, 'gates' FROM t WHERE pos = 0 AND previous_record_digest IS NOT NULL
UNION ALL SELECT 'ledger-chain-broken', record_id, 'gates' FROM t WHERE pos > 0 AND previous_record_digest IS DISTINCT FROM before
UNION ALL SELECT 'ledger-record-digest-mismatch', record_id, 'gates' FROM t WHERE record_digest IS DISTINCT FROM {A.OWN_DIGEST}""")
def r04(spark, d):
    return V.ledger_findings(A.tampered(spark, d))


def _heads(spark, d):
    base = A.ledger(spark, d).withColumn("ledger_revision", F.lit(2))
    n = F.expr("cast(substr(ledger_id, 2) as bigint)")
    head = A.tampered(spark, d).where(~((n % 9 == 1) & (F.col("pos") == 1))).where(n % 17 != 3).withColumn("ledger_revision", F.when(n % 19 == 2, 1).otherwise(3))
    return base, head


_HEADS = f"""{A.LEDGER}, {A.TAMPERED}, head AS (SELECT *, CASE WHEN CAST(substr(ledger_id, 2) AS BIGINT) % 19 = 2 THEN 1 ELSE 3 END AS rev FROM tampered
  WHERE NOT (CAST(substr(ledger_id, 2) AS BIGINT) % 9 = 1 AND pos = 1) AND CAST(substr(ledger_id, 2) AS BIGINT) % 17 <> 3)"""


@query("R06_append_findings", f"""WITH RECURSIVE {_HEADS}
SELECT 'ledger-identity-mismatch' AS code, ledger_id AS subject, 'gates' AS cls FROM (SELECT DISTINCT ledger_id FROM ledger) WHERE ledger_id NOT IN (SELECT ledger_id FROM head)
UNION ALL SELECT DISTINCT 'ledger-revision-regressed', ledger_id, 'gates' FROM head WHERE rev < 2
UNION ALL SELECT 'ledger-record-removed', l.record_id, 'gates' FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.ledger_id = l.ledger_id AND h.pos = l.pos)
UNION ALL SELECT 'ledger-record-mutated', l.record_id, 'gates' FROM ledger l JOIN head h ON h.ledger_id = l.ledger_id AND h.pos = l.pos
  WHERE h.record_id <> l.record_id OR h.payload_digest <> l.payload_digest OR h.previous_record_digest IS DISTINCT FROM l.previous_record_digest""")
def r06(spark, d):
    return V.append_findings(*_heads(spark, d))


@query("R13_ledger_counts", f"WITH RECURSIVE {_HEADS}, b AS (SELECT ledger_id, count(*) AS b FROM ledger WHERE pos < 3 GROUP BY 1) SELECT ledger_id, count(*) AS verified, count(*) - any_value(b) AS appended, any_value(b) AS base FROM head JOIN b USING (ledger_id) GROUP BY ledger_id")
def r13(spark, d):
    base, head = _heads(spark, d)
    return V.ledger_counts(base.where("pos < 3"), head)


@query("M01_expand_macro", "SELECT check_id, CAST(check_revision AS BIGINT) AS check_revision FROM (VALUES ('A', 1), ('B', 2), ('C', 1)) v(check_id, check_revision)")
def m01(spark, d):
    out = V.expand_macro({"root": [("inner", 1), ("C", 1)], "inner": [("A", 1), ("B", 2)]}, "root")
    return spark.createDataFrame(out["checks"], "check_id string, check_revision bigint")


@query("M02_macro_findings", """SELECT 'gate-macro-invalid' AS code, 'm-' || event_id AS subject, 'input' AS cls FROM events WHERE event_id % 10 = 0
UNION ALL SELECT 'gate-macro-executable-content', 'm-' || event_id, 'input' FROM events WHERE event_id % 10 = 3""")
def m02(spark, d):
    macros = A.table(spark, d, "events").selectExpr(
        "concat('m-', event_id) AS macro_id", "array(named_struct('check_id', event_type, 'check_revision', CASE WHEN event_id % 10 = 0 THEN 0L ELSE 1L END)) AS expands_to",
        "CASE WHEN event_id % 10 = 3 THEN '{\"run\": \"eval(x)\"}' ELSE props END AS parameters",
    )
    return V.macro_findings(macros)


@query("M04_macro_faults", "SELECT * FROM (VALUES ('none', 'gate-macro-unresolved', 'none'), ('a', 'gate-macro-cycle', 'a'), ('d0', 'gate-macro-bound-exhausted', 'd0')) v(entry, code, subject)")
def m04(spark, d):
    library = {"a": [("b", 1)], "b": [("a", 1)]} | {f"d{i}": [(f"d{i + 1}", 1), (f"d{i + 1}", 1)] for i in range(12)}
    found = [(e, *V.expand_macro(library, e).values()) for e in ("none", "a", "d0")]
    return spark.createDataFrame(found, "entry string, code string, subject string")


_DEFS = "(VALUES " + ", ".join(map(str, A.DEFINED)) + ") v(check_id, check_revision)"


@query("M07_evidence_findings", f"""WITH {A.REPORTS}
, named AS (SELECT *, check_id || '@' || check_revision AS subject, CASE WHEN verdict = 'unresolved' THEN 'evidence' ELSE 'gates' END AS cls FROM reports)
SELECT 'evidence-check-unbound' AS code, subject, cls FROM named r WHERE NOT EXISTS (SELECT 1 FROM {_DEFS} WHERE v.check_id = r.check_id AND v.check_revision = r.check_revision)
UNION ALL SELECT 'evidence-snapshot-mismatch', subject, cls FROM named WHERE snapshot_identity <> 'snap-1'
UNION ALL SELECT 'evidence-unresolved', subject, cls FROM named WHERE verdict = 'unresolved' AND value > 5""")
def m07(spark, d):
    defs = spark.createDataFrame(A.DEFINED, "check_id string, check_revision bigint")
    return V.evidence_findings(A.reports(spark, d), defs, F.lit("snap-1"), F.col("value") > 5)


# ---- change plan ------------------------------------------------------------------------------------------------


def _plan(spark, d):
    entries = A.entries(spark, d)
    mapped = V.mapped_relations(A.relations(spark, d), A.role_map(spark))
    return entries, mapped, entries.where("doc_id % 97 = 5").select("artifact_id")


_ORDER = f"{A.ENTRIES}, {A.RELATIONS}, changed AS (SELECT artifact_id AS a FROM entries WHERE doc_id % 97 = 5), o AS (SELECT target_artifact_id AS p, from_artifact_id AS q, CASE role WHEN 'requires' THEN 'normative-dependency' ELSE 'derivation' END AS e, role, relation_id FROM relations), cl(a) AS (SELECT a FROM changed UNION SELECT q FROM cl JOIN o ON p = a)"


@query("C01_role_map_findings", "SELECT * FROM (VALUES ('mapping-entry-duplicate', 'requires'), ('mapping-role-unknown', 'likes:friend'), ('role-mapping-invalid', 'entries')) v(code, subject)")
def c01(spark, d):
    return spark.createDataFrame(V.role_map_findings([("requires", "impact"), ("requires", "derivation"), ("likes", "friend"), ("", "impact")]), "code string, subject string")


@query("C04_changed_unresolved", "SELECT 'changed-artifact-unresolved' AS code, 'DOC-x' || doc_id AS subject, 'input' AS cls FROM documents WHERE doc_id % 97 = 6")
def c04(spark, d):
    entries, mapped, changed = _plan(spark, d)
    more = entries.where("doc_id % 97 = 6").selectExpr("concat('DOC-x', doc_id) AS artifact_id")
    return V.change_findings(entries, mapped, changed.unionAll(more))


@query("C05_stale_evidence", f"WITH {A.ENTRIES} SELECT artifact_id FROM entries WHERE doc_id % 3 = 1")
def c05(spark, d):
    entries = A.entries(spark, d)
    return V.stale_evidence(entries, entries.selectExpr("artifact_id", "CASE WHEN doc_id % 3 = 1 THEN 'sha256:old' ELSE content_digest END AS snapshot_identity"))


@query("C07_external_targets", f"WITH {A.ENTRIES}, {A.RELATIONS} SELECT 'relation-target-external' AS code, relation_id AS subject, 'input' AS cls FROM relations WHERE target_artifact_id = 'DOC-0'")
def c07(spark, d):
    rel = A.relations(spark, d).withColumn("external", F.col("target_artifact_id") == "DOC-0")
    return V.external_targets(V.mapped_relations(rel, A.role_map(spark)))


@query("C08_ordering_edges", f"WITH RECURSIVE {_ORDER} SELECT p AS prerequisite_id, q AS dependent_id, e AS edge_role, role AS relation_role, relation_id FROM o")
def c08(spark, d):
    return V.ordering_edges(_plan(spark, d)[1])


@query("C09_impact_edges", f"WITH RECURSIVE {_ORDER} SELECT q AS src, p AS dst FROM o WHERE role = 'derives'")
def c09(spark, d):
    mapped = V.mapped_relations(A.relations(spark, d), A.role_map(spark, (("derives", "impact"),)))
    return V.impact_edges(mapped)


@query("C10_ordering_closure", f"WITH RECURSIVE {_ORDER} SELECT a AS id FROM cl")
def c10(spark, d):
    entries, mapped, changed = _plan(spark, d)
    nodes, edges = V.as_graph(entries, V.ordering_edges(mapped))
    return G.reachable(nodes, edges, changed.select(F.col("artifact_id").alias("id")))


@query("C13_dispositions", f"""WITH RECURSIVE {_ORDER}
SELECT artifact_id, CASE WHEN artifact_id IN (SELECT a FROM changed) THEN 'revise'
  WHEN artifact_id IN (SELECT a FROM cl) THEN CASE WHEN EXISTS (SELECT 1 FROM o WHERE q = artifact_id AND e = 'derivation' AND p IN (SELECT a FROM cl)) THEN 'rebuild' ELSE 'revalidate' END
  WHEN doc_id % 5 = 1 THEN 'invalidate-evidence' ELSE 'unchanged' END AS disposition,
  artifact_id IN (SELECT a FROM changed) AS changed, false AS review_scope FROM entries""")
def c13(spark, d):
    entries, mapped, changed = _plan(spark, d)
    bindings = entries.selectExpr("artifact_id", "CASE WHEN doc_id % 5 = 1 THEN 'sha256:old' ELSE content_digest END AS snapshot_identity")
    return V.dispositions(entries, mapped, changed, bindings)


@query("C12_review_scope", f"""WITH RECURSIVE {_ORDER}, im(a) AS (SELECT a FROM changed UNION SELECT p FROM im JOIN o ON q = a AND role = 'derives')
SELECT artifact_id, CASE WHEN artifact_id IN (SELECT a FROM changed) THEN 'revise' WHEN artifact_id IN (SELECT a FROM im) THEN 'review-required' ELSE 'unchanged' END AS disposition FROM entries""")
def c12(spark, d):
    entries, _, changed = _plan(spark, d)
    mapped = V.mapped_relations(A.relations(spark, d), A.role_map(spark, (("derives", "impact"),)))
    return V.dispositions(entries, mapped, changed).select("artifact_id", "disposition")


@query("C15_ordering_cycle", "SELECT 'ordering-cycle' AS code, subject, 'gates' AS cls FROM (VALUES ('DOC-0'), ('DOC-1'), ('DOC-2')) v(subject)")
def c15(spark, d):
    rows = [("a", "DOC-0", "requires", "DOC-1", False), ("b", "DOC-1", "requires", "DOC-2", False), ("c", "DOC-2", "requires", "DOC-0", False), ("d", "DOC-3", "requires", "DOC-0", False)]
    rel = spark.createDataFrame(rows, "relation_id string, from_artifact_id string, role string, target_artifact_id string, external boolean")
    entries, _, changed = _plan(spark, d)
    return V.change_plan(entries, V.mapped_relations(rel, A.role_map(spark)), changed)[1]


@query("C17_affected_waves", f"""WITH RECURSIVE {_ORDER}, i AS (SELECT p, q FROM o WHERE p IN (SELECT a FROM cl) AND q IN (SELECT a FROM cl)),
r(n, d) AS (SELECT a, 0 FROM cl WHERE a NOT IN (SELECT q FROM i) UNION SELECT i.q, d + 1 FROM r JOIN i ON i.p = r.n)
SELECT n AS id, CAST(max(d) AS BIGINT) AS wave FROM r GROUP BY n""")
def c17(spark, d):
    return V.change_plan(*_plan(spark, d))[3]
