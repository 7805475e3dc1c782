import pytest

from ledgerloom import api
from ledgerloom.operators import governance as V
from ledgerloom.operators import planning as L
from ledgerloom.operators import profile, selectors, shapes

TASK = "task_id string, depends_on array<string>"


def plan(spark, rows, **kw):
    return L.schedule(spark.createDataFrame(rows, TASK), **kw)


def test_eight_tasks(spark):
    rows = [("A", []), ("B", ["A"]), ("C", ["A"]), ("D", ["B"]), ("E", ["B", "C"]), ("F", ["C"]), ("G", ["D", "E"]), ("H", ["F", "G"])]
    outcome, _, waves = plan(spark, rows)
    got = {}
    for r in waves.collect():
        got.setdefault(r.wave, set()).add(r.task_id)
    assert outcome == "valid" and got == {0: {"A"}, 1: {"B", "C"}, 2: {"D", "E", "F"}, 3: {"G"}, 4: {"H"}}
    assert L.constraints(spark.createDataFrame(rows, TASK)).count() == 10
    a, b = (L.facts_digest(spark.createDataFrame(r, TASK)).first()[0] for r in (rows, rows[::-1]))
    assert a == b


@pytest.mark.parametrize("rows, outcome, codes", [
    ([("A", ["B"]), ("B", ["A"])], "invalid", {"dependency-cycle"}), ([("A", ["A"])], "invalid-input", {"dependency-self"}),
    ([("A", []), ("A", [])], "invalid-input", {"task-duplicate"}), ([("A", ["Z"])], "invalid-input", {"dependency-unresolved"}),
    ([("A", []), ("B", ["A", "A"])], "invalid-input", {"dependency-duplicate"}), ([("", None)], "invalid-input", {"problem-invalid"}),
])
def test_faulty_plans(spark, rows, outcome, codes):
    got, found, waves = plan(spark, rows)
    assert (got, waves) == (outcome, None) and {r.code for r in found.collect()} == codes


def test_dimensions_and_budgets(spark):
    assert plan(spark, [("A", [])], active=["time"])[0] == "invalid-input"
    assert plan(spark, [("A", []), ("B", [])], max_tasks=1)[1].first().code == "budget-exhausted"


ENTRY = "artifact_id string, path string, kind string, status string, owner string, tags array<string>, relations array<struct<kind:string,role:string,target_artifact_id:string>>, content_digest string"
DOCS = [
    ("doc-a", "docs/guide/a.md", "guide", "active", "team-a", ["release", "web"], [("reference", "normative-dependency", "doc-z")], "d-a"),
    ("doc-z", "docs/ref/z.md", "reference", "draft", "team-b", ["release"], [("traceability", None, "doc-a")], "d-z"),
    ("doc-m", "src/internal/m.md", "spec", "active", "team-a", ["draft"], [], "d-m"),
]


@pytest.mark.parametrize("selector, want", [
    ({"path": "docs/**"}, ["doc-a", "doc-z"]), ({"all": [{"status": {"any": ["active"]}}, {"not": {"kind": {"any": ["spec"]}}}]}, ["doc-a"]),
    ({"reference": {"target": "doc-z", "role": "normative-dependency"}}, ["doc-a"]), ({"reference": {"target": "doc-z", "role": "other"}, "min": 0}, []),
    ({"traceability": {"target": "doc-a"}}, ["doc-z"]), ({"any": [{"tag": {"any": ["web"]}}, {"artifactId": "doc-m"}]}, ["doc-a", "doc-m"]),
])
def test_selection(spark, selector, want):
    out = selectors.select_documents(spark.createDataFrame(DOCS, ENTRY), selector)
    assert [r[0] for r in out["matches"].collect()] == want


def test_selection_faults_and_trace(spark):
    entries = spark.createDataFrame(DOCS, ENTRY)
    for bad in ({}, {"all": []}, {"kind": {"any": ["a"]}, "owner": {"any": ["b"]}}, {"path": "a**"}, {"reference": {"target": "none"}}, {"artifactId": "doc-a", "min": 2}):
        assert api.select_documents(entries, bad)["outcome"] == "invalid-input"
    out = selectors.select_documents(entries, {"any": [{"kind": {"any": ["guide"]}}, {"owner": {"any": ["team-b"]}}], "min": 0})
    trace = {r.artifact_id: [(x.subject, x.outcome) for x in r.trace] for r in out["trace"].collect()}
    assert trace["doc-a"] == [("selector", "admitted"), ("selector.any[0]", "admitted")]
    assert trace["doc-m"][-1] == ("selector.any[1]", "rejected")
    assert selectors.select_documents(entries, {"namespace": "x", "min": 1})["diagnostic"] == "zero-match-diagnostic"


REL = "relation_id string, from_artifact_id string, role string, target_artifact_id string, external boolean"


def change(spark, relations, roles, changed, bindings=None):
    entries = spark.createDataFrame(DOCS, ENTRY)
    rel = spark.createDataFrame(relations, REL)
    bound = spark.createDataFrame(bindings, "artifact_id string, snapshot_identity string") if bindings else None
    out = api.compile_change_plan(entries, rel, roles, changed_ids=changed, bindings=bound)
    got = {r.artifact_id: r.disposition for r in out["artifacts"].collect()} if out["artifacts"] is not None else None
    return out["outcome"], got, out


def test_change_plans(spark):
    rel = [("r1", "doc-a", "requires", "doc-z", False)]
    outcome, got, out = change(spark, rel, [("requires", "normative-dependency")], ["doc-z"])
    assert outcome == "valid" and got == {"doc-a": "revalidate", "doc-z": "revise", "doc-m": "unchanged"}
    assert {r.id: r.wave for r in out["waves"].collect()} == {"doc-z": 0, "doc-a": 1}
    assert change(spark, rel, [("requires", "derivation")], ["doc-z"])[1]["doc-a"] == "rebuild"
    both = [("i1", "doc-a", "touches", "doc-z", False), ("i2", "doc-z", "touches", "doc-a", False)]
    assert change(spark, both, [("touches", "impact")], ["doc-a"])[1] == {"doc-a": "revise", "doc-z": "review-required", "doc-m": "unchanged"}
    loop = [("r1", "doc-a", "requires", "doc-z", False), ("r2", "doc-z", "requires", "doc-a", False)]
    assert change(spark, loop, [("requires", "derivation")], ["doc-m"])[0] == "invalid"
    assert change(spark, rel, [("requires", "derivation")], ["doc-m"], [("doc-z", "old")])[1]["doc-z"] == "invalidate-evidence"
    assert change(spark, rel, [("requires", "derivation")], ["doc-none"])[0] == "invalid-input"
    assert change(spark, [("r", "doc-a", "requires", "x", True)], [("requires", "derivation")], ["doc-a"])[0] == "invalid-input"


def chain(spark, n):
    return V.chained(spark.createDataFrame([("L", i, f"rec-{i}", f"payload-{i}") for i in range(n)], "ledger_id string, pos bigint, record_id string, payload_digest string"))


def test_ledgers(spark):
    from pyspark.sql import functions as F

    head = chain(spark, 4)
    assert V.ledger_findings(head).count() == 0
    base = chain(spark, 3).withColumn("ledger_revision", F.lit(1))
    codes = lambda h, r=2: sorted({x.code for x in V.append_findings(base, h.withColumn("ledger_revision", F.lit(r))).collect()})
    assert codes(head) == [] and codes(head, 0) == ["ledger-revision-regressed"] and codes(head.where("pos <> 2")) == ["ledger-record-removed"]
    mutated = head.withColumn("payload_digest", F.when(F.col("pos") == 1, "x").otherwise(F.col("payload_digest")))
    assert codes(mutated) == ["ledger-record-mutated"] and [x.code for x in V.ledger_findings(mutated).collect()] == ["ledger-record-digest-mismatch"]
    assert codes(head.withColumn("ledger_id", F.lit("other"))) == ["ledger-identity-mismatch", "ledger-record-removed"]
    assert {x.code for x in V.ledger_findings(head.where("pos > 0")).collect()} == {"ledger-chain-broken"}


def test_macros():
    library = {"root": [("inner", 1), ("C", 1)], "inner": [("A", 1), ("B", 1)]}
    assert V.expand_macro(library, "root") == {"checks": [("A", 1), ("B", 1), ("C", 1)], "expanded": 2}


def test_profiles_and_catalogs():
    good = {"schema": "p@1", "profileId": "p", "profileRevision": 1, "documentContracts": ["b@1", "a@2"], "gateMacros": [], "relationRoleMappings": [{"mappingId": "m", "mappingRevision": 1, "relationKind": "impact", "assignedRole": "ordering-edge", "explanation": "why"}], "diagnosticHelp": [], "moduleLocks": [{"moduleId": "x", "lockedRevision": "x@3"}]}
    out = profile.conformance(good, "p@1", "acme")
    assert out["outcome"] == "valid" and out["ordering"] == ["impact"]
    assert out["digest"] == profile.conformance({**good, "documentContracts": ["a@2", "b@1"]}, "p@1", "acme")["digest"]
    bad = {**good, "documentContracts": ["a", "a@1", "a@2"], "extra": 1, "moduleLocks": [{"moduleId": "x", "lockedRevision": "x"}], "diagnosticHelp": [{"code": "acme.core/x", "help": ["h"]}], "schema": "p@2"}
    del bad["gateMacros"]
    assert {c for c, _ in profile.profile_findings(bad, "p@1", "acme")} == {"floating-ref", "duplicate-identity", "unknown-field", "missing-field", "consumer-term-in-core-contract", "incompatible-revision"}
    entry = {"applicable-diagnostic": "a.b/c", "digest": "sha256:" + "0" * 64, "exact-commit-or-tag": "main", "license": "MIT", "path": "p", "source-repository": "r"}
    found = profile.recommendation_findings({"schema": "c", "catalogId": "c", "catalogRevision": 1, "automaticDiscovery": True, "recommendations": [entry, entry]}, "c")
    assert {c for c, _ in found} == {"automatic-discovery", "unlocked-recommendation", "duplicate-identity"}
    catalog = {"schema": "s", "catalogId": "c", "catalogRevision": 1, "targetReleaseIntent": "1", "status": "x", "candidates": [], "externalRelations": [], "deferredCapabilities": [], "license": "MIT"}
    assert shapes.catalog_findings(catalog, "s") == [("catalog-release-field-forbidden", "license")]
    contract = {"schema": "s", "contractId": "c", "contractRevision": 1, "description": "d", "documentKind": "k", "sections": {"ordering": "exact", "requiredSectionIds": ["a"]}, "topics": {"closedSet": ["t"], "resolutions": ["local", "inherited", "not-applicable"], "inheritanceApplicability": ["adopts"]}, "references": {"exactFields": shapes.REFERENCE_FIELDS}, "criteria": {"minimumPerRegistration": 1, "fields": shapes.CRITERION_FIELDS}}
    assert shapes.contract_findings(contract, "s") == []
    assert shapes.contract_findings({**contract, "sections": {"ordering": "loose"}, "contractRevision": 0}, "s") == [("contract-invalid", "contractRevision"), ("contract-invalid", "sections.ordering")]
