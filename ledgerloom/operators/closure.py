"""Design closure and scope admissibility: rules over registrations, registries, baselines and bills of members.

``Facts`` holds one DataFrame per kind of fact and the contract's few values.  Every rule is a query giving (code,
subject) rows; a compiler is their union.  Registrations are one row each, with typed nested columns:
``component_id, design_id, design_revision, design_requirement, status, supersedes, document_ref struct<document_id,
document_revision>, topic_coverage map<string, struct<resolution, section_id, refs array<struct<document_id,
document_revision, section_id, applicability>>, reason>>, acceptance_criteria array<struct<criterion_id, section_id>>``
and eight ``array<string>`` columns of references.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions import kernel as K
from ledgerloom.functions.stages import staged
from ledgerloom.operators import graph
from ledgerloom.operators.findings import every, rule

#: Closed vocabularies.
REQUIREMENTS = ("full", "projection", "compatibility")
STATUSES = ("proposed", "accepted", "superseded")
RETAINED = ("proposed", "accepted")
RESOLUTIONS = ("local", "inherited", "not-applicable")
APPLICABILITY = ("adopts", "narrows", "specializes")
CONTRACT_REFS = ("provided_contract_refs", "required_contract_refs")
OTHER_REFS = (
    "produced_state_refs", "consumed_state_refs", "issued_authority_refs", "required_authority_refs",
    "emitted_observation_refs", "deployment_dependency_refs",
)

#: The fields of a registration as JSON.
REGISTRATION_FIELDS = (
    "designId", "componentId", "designRevision", "designRequirement", "status", "documentRef", "topicCoverage",
    "providedContractRefs", "requiredContractRefs", "producedStateRefs", "consumedStateRefs", "issuedAuthorityRefs",
    "requiredAuthorityRefs", "emittedObservationRefs", "deploymentDependencyRefs", "acceptanceCriteria", "supersedes",
)


def _true(x):
    return F.coalesce(x, F.lit(False))


@dataclass
class Facts:
    sections: list[str]
    topics: list[str]
    minimum: int
    candidates: DataFrame
    registry: DataFrame
    documents: DataFrame
    index: DataFrame
    registrations: DataFrame
    applicability: tuple[str, ...] = APPLICABILITY

    @cached_property
    def rows(self) -> DataFrame:
        """Registrations with the sections of the document that they resolve to, or null."""
        found = self.registry.select(F.struct("document_id", "document_revision").alias("ref"), F.col("section_ids").alias("found"))
        r = self.registrations
        return r.join(found, (r.document_ref.document_id == found.ref.document_id) & (r.document_ref.document_revision == found.ref.document_revision), "left").drop("ref")

    @cached_property
    def coverage(self) -> DataFrame:
        return self.rows.select("component_id", "found", F.explode("topic_coverage").alias("topic", "t"))

    @cached_property
    def retained(self) -> DataFrame:
        """The one retained registration of each component that has exactly one."""
        keep = self.registrations.where(F.col("status").isin(*RETAINED))
        one = keep.groupBy("component_id").count().where("count = 1").select("component_id")
        return keep.join(one, "component_id", "left_semi")


# ---- closure ----------------------------------------------------------------------------------------------------


def document_rules(f: Facts) -> DataFrame:
    """Registry documents that have no text, no index entry, or other sections than the index found."""
    index = f.index.select(F.col("artifact_id").alias("document_id"), F.col("section_ids").alias("indexed"))
    both = f.registry.join(index, "document_id")
    return every(
        rule(f.registry.join(f.documents.where("markdown IS NOT NULL"), "document_id", "left_anti"), "document-missing", "document_id", "gates"),
        rule(f.registry.join(index, "document_id", "left_anti"), "document-unindexed", "document_id", "gates"),
        rule(both.where(~K.same_array(F.col("section_ids"), F.col("indexed"))), "document-sections-mismatch", "document_id", "gates"),
    )


def field_rules(f: Facts) -> DataFrame:
    """Fields of the wrong form, and references that are not exact."""
    r = f.rows
    bad = [
        (_true(F.length("design_id") > 0), "designId"), (_true(F.col("design_revision") > 0), "designRevision"),
        (_true(F.col("design_requirement").isin(*REQUIREMENTS)), "designRequirement"), (_true(F.col("status").isin(*STATUSES)), "status"),
        (F.col("supersedes").isNull() | (F.col("supersedes") != ""), "supersedes"), (F.col("document_ref").isNotNull(), "documentRef"),
        (F.col("topic_coverage").isNotNull(), "topicCoverage"),
        (_true(F.forall("acceptance_criteria", lambda c: _true((c["criterion_id"] != "") & (c["section_id"] != "")))), "acceptanceCriteria"),
        *[(_true(F.forall(c, lambda x: _true(x != ""))), c) for c in (*CONTRACT_REFS, *OTHER_REFS)],
    ]
    names = F.filter(F.array(*[F.when(~ok, n) for ok, n in bad]), lambda x: x.isNotNull())
    wrong = r.select("component_id", F.explode(names).alias("n"))
    inexact = lambda c: F.filter(c, lambda x: (x != "") & ~K.is_exact_reference(x))
    contracts = r.select("component_id", F.explode(F.concat(*map(inexact, CONTRACT_REFS))).alias("x"))

    def named(c: str):
        return F.transform(inexact(c), lambda x: F.concat(F.lit(f"{c}:"), x))

    others = r.select("component_id", F.explode(F.concat(*map(named, OTHER_REFS))).alias("x"))
    subject = "concat(component_id, ':', {})"
    return every(
        rule(wrong, "registration-field-invalid", subject.format("n"), "gates"),
        rule(contracts, "contract-ref-not-exact", subject.format("x"), "gates"), rule(others, "reference-not-exact", subject.format("x"), "gates"),
    )


def unknown_fields(raw: DataFrame, fields=REGISTRATION_FIELDS) -> DataFrame:
    """Unknown keys of registrations as JSON texts (component_id, body), before a typed reading drops them."""
    rows = raw.select("component_id", F.explode(K.unknown_keys(F.col("body"), list(fields))).alias("k"))
    return rule(rows, "registration-field-unknown", "concat(component_id, ':', k)", "gates")


def reference_rules(f: Facts) -> DataFrame:
    """Document references that resolve to nothing, and documents with other sections than the contract's."""
    r = f.rows.where("document_ref IS NOT NULL")
    want = F.array(*map(F.lit, f.sections))
    return every(
        rule(r.where("found IS NULL"), "document-ref-unresolved", "component_id", "gates"),
        rule(r.where(F.col("found").isNotNull() & ~K.same_array(F.col("found"), want)), "contract-sections-mismatch", "document_ref.document_id", "gates"),
    )


def topic_rules(f: Facts) -> DataFrame:
    """Unknown and missing topics, and resolutions of the wrong form: one CASE, since the first fault hides the others."""
    c = f.coverage
    known = F.col("topic").isin(f.topics)
    missing = f.rows.where("topic_coverage IS NOT NULL").select("component_id", F.explode(F.array_except(F.array(*map(F.lit, f.topics)), F.map_keys("topic_coverage"))).alias("topic"))
    t = F.col("t")
    none = (F.coalesce(F.size(t.refs), F.lit(-1)) == 0)
    local = _true(t.section_id != "") & none & t.reason.isNull()
    inherited = t.section_id.isNull() & t.reason.isNull() & _true(F.size(t.refs) > 0)
    apart = _true(t.reason != "") & t.section_id.isNull() & none
    sound = F.when(t.resolution == "local", local).when(t.resolution == "inherited", inherited).when(t.resolution == "not-applicable", apart).otherwise(False)
    subject = "concat(component_id, ':', topic)"
    lost = c.where(known & sound & (t.resolution == "local") & F.col("found").isNotNull() & ~_true(F.array_contains("found", t.section_id)))
    return every(
        rule(c.where(~known), "topic-unknown", subject, "gates"), rule(missing, "topic-missing", subject, "gates"),
        rule(c.where(known & ~sound), "topic-resolution-invalid", subject, "gates"),
        rule(lost, "section-unresolved", "concat(component_id, ':', t.section_id)", "gates"),
    )


def inheritance_rules(f: Facts) -> DataFrame:
    """Inherited references: their form, their applicability, and whether document, revision and section are there."""
    refs = f.coverage.where(F.col("topic").isin(f.topics) & (F.col("t.resolution") == "inherited") & F.col("t.section_id").isNull() & F.col("t.reason").isNull())
    refs = refs.select("component_id", "topic", F.explode("t.refs").alias("x")).select("component_id", "topic", "x.*")
    formed = _true((F.col("document_id") != "") & (F.col("document_revision") > 0) & (F.col("section_id") != ""))
    good = refs.where(formed)
    held = f.registry.select("document_id", "document_revision", F.explode("section_ids").alias("section_id")).distinct()
    subject = "concat(component_id, ':', topic)"
    return every(
        rule(refs.where(~formed), "reference-not-exact", subject, "gates"),
        rule(good.where("applicability = 'overrides'"), "inheritance-overrides-forbidden", subject, "gates"),
        rule(good.where(~_true(F.col("applicability").isin("overrides", *f.applicability))), "inheritance-applicability-invalid", subject, "gates"),
        rule(good.join(held, ["document_id", "document_revision", "section_id"], "left_anti"), "reference-unresolved", subject, "gates"),
    )


def criterion_rules(f: Facts) -> DataFrame:
    c = f.rows.where("found IS NOT NULL").select("component_id", "found", F.explode("acceptance_criteria").alias("c")).where("c.section_id <> '' AND c.criterion_id <> ''")
    few = f.retained.join(f.candidates, "component_id", "left_semi").where(F.size("acceptance_criteria") < f.minimum)
    return every(
        rule(c.where(~F.array_contains("found", F.col("c.section_id"))), "criterion-unresolved", "concat(component_id, ':', c.section_id)", "gates"),
        rule(few, "criterion-missing", "component_id", "gates"),
    )


def candidate_rules(f: Facts) -> DataFrame:
    """Registrations against candidates: orphans, other designs, none, several, none retained."""
    mine = f.candidates.select("component_id", F.col("design_id").alias("want"), F.col("design_requirement").alias("need"))
    both = f.registrations.join(mine, "component_id")
    n = f.registrations.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*RETAINED)).alias("kept"))
    counted = f.candidates.join(n, "component_id", "left")
    other = both.where(F.col("design_requirement").isin(*REQUIREMENTS) & (F.col("design_requirement") != F.col("need")))
    return every(
        rule(f.registrations.join(mine, "component_id", "left_anti"), "registration-orphan", "component_id", "gates"),
        rule(both.where(~F.col("design_id").eqNullSafe(F.col("want"))), "design-id-mismatch", "component_id", "gates"),
        rule(other, "registration-field-invalid", "concat(component_id, ':designRequirement')", "gates"),
        rule(counted.where("n IS NULL"), "registration-missing", "component_id", "gates"),
        rule(counted.where("n > 1"), "registration-duplicate", "component_id", "gates"),
        rule(counted.where("n > 0 AND kept = 0"), "registration-not-retained", "component_id", "gates"),
    )


def contract_rules(f: Facts) -> DataFrame:
    """Contracts of one identity in several revisions, required ones that nothing provides, state with two owners."""
    side = lambda c: f.registrations.select(F.explode(c).alias("ref")).where(K.is_exact_reference(F.col("ref"))).withColumn("identity", K.reference_identity(F.col("ref"))).withColumn("revision", K.reference_revision(F.col("ref")))
    provided, required = side(CONTRACT_REFS[0]), side(CONTRACT_REFS[1])
    revisions = provided.unionByName(required).groupBy("identity").agg(F.count_distinct("revision").alias("n"))
    states = f.registrations.select(F.explode("produced_state_refs").alias("ref")).groupBy("ref").count()
    return every(
        rule(revisions.where("n > 1"), "contract-revision-mismatch", "identity", "gates"),
        rule(required.select("ref").distinct().join(provided, "ref", "left_anti"), "contract-edge-mismatch", "ref", "gates"),
        rule(states.where("count > 1"), "truth-owner-duplicate", "ref", "gates"),
    )


def _back_slices(n: int, order: np.ndarray, cut: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Nodes on a slice of the depth-first path that an edge closes; starts and targets in canonical order."""
    state, on, path, at = np.zeros(n, np.int8), np.zeros(n, bool), [], {}
    for s in range(n):
        if state[s]:
            continue
        stack = [(s, cut[s])]
        state[s] = 1
        at[s] = 0
        path.append(s)
        while stack:
            v, k = stack.pop()
            if k == cut[v + 1]:
                state[v] = 2
                path.pop()
                continue
            stack.append((v, k + 1))
            w = int(dst[order[k]])
            if state[w] == 1:
                on[path[at[w] :]] = True
            elif state[w] == 0:
                state[w], at[w] = 1, len(path)
                path.append(w)
                stack.append((w, cut[w]))
    return on


def inheritance_cycles(f: Facts) -> DataFrame:
    """Documents on a cycle that a depth-first walk over inheritance closes; not the strong components, by definition."""
    refs = f.registrations.select(F.col("document_ref.document_id").alias("src"), F.explode(F.map_values("topic_coverage")).alias("t")).where("t.resolution = 'inherited' AND src IS NOT NULL")
    edges = staged(refs.select("src", F.explode("t.refs.document_id").alias("dst")).where("dst IS NOT NULL").distinct(), "inheritance")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("sort_key", F.col("id"))
    lines = edges.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.col("dst").alias("sort_key"), F.lit("inherits").alias("role"), "src", "dst", F.lit(None).cast("double").alias("weight"))

    def solve(ids, src, dst, _):
        order = np.lexsort((dst, src))
        on = _back_slices(len(ids), order, np.searchsorted(src[order], np.arange(len(ids) + 1)), dst)
        return pd.DataFrame({"id": pd.Series([x for x, y in zip(ids, on) if y], dtype=object)})

    # Giant components: a depth-first order has no distributed form, so all of them run whole.
    found = graph.grouped_whole(nodes, lines, solve, "id string")
    return rule(found, "inheritance-cycle", "id", "gates")


def closure_findings(f: Facts) -> DataFrame:
    return every(document_rules(f), field_rules(f), reference_rules(f), topic_rules(f), inheritance_rules(f), criterion_rules(f), candidate_rules(f), contract_rules(f), inheritance_cycles(f))


def closure_members(f: Facts) -> DataFrame:
    """One row per candidate: its retained registration, document and topic counts, as far as there is one."""
    kept = f.retained.select(
        "component_id", F.col("design_revision").alias("revision"), "status", F.col("document_ref.document_id").alias("document_id"),
        *[K.topic_count(F.col("topic_coverage"), k).alias("n_" + k.replace("-", "_")) for k in RESOLUTIONS], F.size("acceptance_criteria").cast("long").alias("n_criteria"),
    )
    return f.candidates.select("component_id", "design_id").join(kept, "component_id", "left").orderBy("component_id")


def closure_counts(findings: DataFrame) -> DataFrame:
    """``all_findings`` before, ``distinct_findings`` after identical ones coalesce, and the outcome."""
    n = findings.agg(F.count(F.lit(1)).alias("all_findings"), F.count_distinct("code", "subject").alias("distinct_findings"))
    return n.select("*", F.when(F.col("all_findings") == 0, "valid").otherwise("invalid").alias("outcome"))


# ---- scope ------------------------------------------------------------------------------------------------------


def baseline_header_findings(baseline: dict | None, target: str) -> list[tuple[str, str]]:
    """(code, subject) of a baseline's own fields."""
    if not isinstance(baseline, dict):
        return [("baseline-missing", "architectureBaseline")]
    by = baseline.get("acceptedBy")
    checks = {
        "baselineId": isinstance(baseline.get("baselineId"), str) and baseline["baselineId"] != "",
        "baselineRevision": _positive(baseline.get("baselineRevision")), "targetRelease": baseline.get("targetRelease") == target,
        "status": baseline.get("status") in STATUSES, "acceptedAt": _date(baseline.get("acceptedAt")),
        "acceptedBy": isinstance(by, dict) and set(by) == {"principalType", "principalId"},
    }
    if checks["acceptedBy"]:
        checks |= {"acceptedBy:principalType": by["principalType"] == "human", "acceptedBy:principalId": isinstance(by["principalId"], str) and by["principalId"] != ""}
    found = [("baseline-invalid", k) for k, ok in checks.items() if not ok]
    if checks["baselineId"] and checks["baselineRevision"] and baseline.get("status") != "accepted":
        found.append(("baseline-not-accepted", baseline["baselineId"]))
    return sorted(found)


def _positive(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


def _date(x) -> bool:
    from datetime import date

    try:
        return isinstance(x, str) and len(x) == 10 and date.fromisoformat(x).isoformat() == x
    except ValueError:
        return False


def baseline_members(f: Facts, members: DataFrame) -> DataFrame:
    """Members (pos, component_id, design_id, design_revision, document_ref, dossier_digest) with their first fault."""
    formed = [
        (_true((F.col("design_id") != "") & (F.col("design_revision") > 0)), "designId"),
        (_true((F.col("document_ref.document_id") != "") & (F.col("document_ref.document_revision") > 0)), "documentRef"),
        (_true(F.col("dossier_digest").rlike(r"\Asha256:[0-9a-f]{64}\z")), "dossierDigest"),
    ]
    form = F.coalesce(*[F.when(~ok, n) for ok, n in formed])
    sound = members.withColumn("form", form).withColumn("nth", F.when(F.col("form").isNull(), F.row_number().over(W.partitionBy("component_id", F.col("form").isNull()).orderBy("pos"))))
    owner = f.candidates.select(F.col("design_id").alias("d"), F.col("component_id").alias("owner"))
    kept = f.retained.select(F.col("component_id").alias("rc"), F.struct("design_id", "design_revision", "document_ref").alias("kept"))
    text = f.documents.select(F.col("document_id").alias("doc"), K.digest(F.col("markdown")).alias("text_digest"))
    known = f.candidates.select(F.col("component_id").alias("known"))
    j = sound.join(known, sound.component_id == known.known, "left").join(owner, sound.design_id == owner.d, "left").join(kept, sound.component_id == kept.rc, "left").join(text, sound.document_ref.document_id == text.doc, "left")
    code = (
        F.when(F.col("form").isNotNull(), "baseline-member-invalid").when(F.col("nth") > 1, "baseline-member-duplicate")
        .when(F.col("known").isNull(), "baseline-member-unknown").when(F.col("owner") != F.col("component_id"), "baseline-member-component-mismatch")
        .when(~F.struct("design_id", "design_revision", "document_ref").eqNullSafe(F.col("kept")), "baseline-member-design-mismatch")
        .when(~F.col("dossier_digest").eqNullSafe(F.col("text_digest")), "baseline-dossier-digest-mismatch")
    )
    return j.select("component_id", "design_id", "design_revision", "form", code.alias("code"))


def baseline_findings(f: Facts, members: DataFrame) -> DataFrame:
    found = baseline_members(f, members)
    subject = F.concat_ws(":", "component_id", "form")
    seen = found.where("form IS NULL").select("component_id")
    pending = f.retained.join(f.candidates, "component_id", "left_semi").where("status <> 'accepted'")
    return every(
        found.where("code IS NOT NULL").select("code", subject.alias("subject"), F.lit("gates").alias("cls")),
        rule(f.candidates.join(seen, "component_id", "left_anti"), "baseline-member-missing", "component_id", "gates"),
        rule(pending, "registration-not-accepted", "component_id", "gates"),
    )


def bom_member_findings(f: Facts, members: DataFrame, constants: dict[str, str], baseline: tuple[str, int] | None) -> DataFrame:
    """Members (pos, id, version, type, layer, owner, design_ref struct<design_id, design_revision, baseline_id,
    baseline_revision>, completion_gates array<struct<gate_id, criterion_ids>>) against constants and registrations."""
    off = F.filter(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in constants.items()]), lambda x: x.isNotNull())
    rows = members.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    first = rows.where("nth = 1")
    formed = _true((F.col("design_ref.design_id") != "") & (F.col("design_ref.design_revision") > 0) & (F.col("design_ref.baseline_id") != "") & (F.col("design_ref.baseline_revision") > 0))
    good = first.where(formed)
    known = good.join(f.candidates.select(F.col("component_id").alias("id")), "id", "left_semi")
    refs = f.registrations.where(F.col("status").isin(*RETAINED)).groupBy(F.col("design_id").alias("rd"), F.col("design_revision").alias("rr")).agg(F.collect_set("component_id").alias("owners"))
    bound = known.join(refs, (known.design_ref.design_id == refs.rd) & (known.design_ref.design_revision == refs.rr), "left")
    rules = [
        rule(rows.select("id", F.explode(off).alias("c")), "scope-bom-invalid", "concat(id, ':', c)", "gates"),
        rule(rows.where("nth > 1"), "scope-bom-invalid", "concat(id, ':member-duplicate')", "gates"),
        rule(first.where(~formed), "scope-bom-invalid", "concat(id, ':designRef')", "gates"),
        rule(good.join(f.candidates.select(F.col("component_id").alias("id")), "id", "left_anti"), "scope-bom-member-unknown", "id", "gates"),
        rule(f.candidates.join(first.select(F.col("id").alias("component_id")), "component_id", "left_anti"), "scope-bom-member-missing", "component_id", "gates"),
        rule(bound.where("owners IS NULL"), "design-ref-unresolved", "id", "gates"),
        rule(bound.where(~F.array_contains("owners", F.col("id"))), "design-ref-component-mismatch", "id", "gates"),
        gate_findings(f, known),
    ]
    if baseline:
        other = ~(_true(F.col("design_ref.baseline_id") == baseline[0]) & _true(F.col("design_ref.baseline_revision") == baseline[1]))
        rules.append(rule(known.where(other), "design-ref-baseline-mismatch", "id", "gates"))
    return every(*rules)


def gate_findings(f: Facts, members: DataFrame) -> DataFrame:
    """Completion gates: form, order, repetition, and the criteria of the member's registration, both ways."""
    gates = members.select("id", F.posexplode("completion_gates").alias("pos", "g")).select("id", "pos", "g.*")
    formed = _true((F.col("gate_id") != "") & (F.size("criterion_ids") > 0) & F.forall("criterion_ids", lambda c: _true(c != "")))
    good = gates.where(formed)
    name = F.when(F.col("gate_id") != "", F.col("gate_id")).otherwise("completionGates")
    each = good.select("id", F.explode("criterion_ids").alias("c"))
    ids = good.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gate_id"))), lambda x: x["gate_id"]).alias("ids"))
    wanted = f.retained.select(F.col("component_id").alias("id"), F.explode("acceptance_criteria.criterion_id").alias("c")).join(members.where(F.size("completion_gates") > 0), "id", "left_semi").distinct()
    at = "concat(id, ':', {})"
    return every(
        rule(members.where("completion_gates IS NULL OR size(completion_gates) = 0"), "scope-bom-invalid", "concat(id, ':completionGates')", "gates"),
        rule(gates.where(~formed).withColumn("n", F.coalesce(name, F.lit("completionGates"))), "scope-bom-gate-invalid", at.format("n"), "gates"),
        rule(good.where(~K.is_sorted(F.col("criterion_ids"))), "scope-bom-criterion-order", at.format("gate_id"), "gates"),
        rule(ids.where(~K.is_sorted(F.col("ids"))), "scope-bom-gate-order", "id", "gates"),
        rule(good.groupBy("id", "gate_id").count().where("count > 1"), "scope-bom-gate-duplicate", at.format("gate_id"), "gates"),
        rule(each.groupBy("id", "c").count().where("count > 1"), "scope-bom-criterion-duplicate", at.format("c"), "gates"),
        rule(each.distinct().join(wanted, ["id", "c"], "left_anti"), "scope-bom-criterion-unknown", at.format("c"), "gates"),
        rule(wanted.join(each, ["id", "c"], "left_anti").select("id").distinct(), "scope-bom-criterion-missing", "id", "gates"),
    )


def facts_digest(rows: DataFrame, fields: dict) -> DataFrame:
    """One row: the digest of the canonical texts of all rows, sorted; admission bounds the number of facts."""
    return rows.agg(K.digest(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(K.canonical_struct(fields))), ","), F.lit("]"))).alias("digest"))
