"""The facade: each capability as a function over DataFrames or JSON values, with one envelope for outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.functions import kernel as K
from ledgerloom.operators import closure, docindex, findings, governance, planning, profile, selectors
from ledgerloom.sources import git_source
from ledgerloom.sources.json_files import embedded_digest_holds


def envelope(found: DataFrame | list, origin: str, phase: str, **body) -> dict:
    """Outcome, exit code and finalized diagnostics of findings, with what the computation gave."""
    if isinstance(found, list):
        spark = body.pop("spark")
        found = spark.createDataFrame([(c, s, "input") for c, s, *_ in found], findings.FINDING)
    drafts = findings.drafts(found, origin, phase)
    fold = findings.outcome(drafts).first()
    diagnostics = findings.finalized(drafts)
    return {"outcome": fold["outcome"], "exit_code": fold["exit_code"], "diagnostics": diagnostics, "count": diagnostics.count(), **body}


def compile_planning(tasks: DataFrame, active=None, **budgets) -> dict:
    _, found, waves = planning.schedule(tasks, active, **budgets)
    return envelope(found, "planning", "schedule", waves=waves)


def check_design_closure(facts: closure.Facts) -> dict:
    """The projection is given whatever the outcome."""
    return envelope(closure.closure_findings(facts), "governance", "closure", members=closure.closure_members(facts))


def compile_governance(facts: closure.Facts, baseline: dict | None, baseline_members: DataFrame, bom_members: DataFrame, constants: dict[str, str], target: str) -> dict:
    header = closure.baseline_header_findings(baseline, target)
    bound = (baseline["baselineId"], baseline["baselineRevision"]) if baseline and not header else None
    rules = [closure.closure_findings(facts), closure.baseline_findings(facts, baseline_members), closure.bom_member_findings(facts, bom_members, constants, bound)]
    if header:
        spark = bom_members.sparkSession
        rules.append(spark.createDataFrame([(c, s, "gates") for c, s in header], findings.FINDING))
    return envelope(findings.every(*rules), "governance", "scope", members=closure.closure_members(facts))


def compile_change_plan(entries: DataFrame, relations: DataFrame, role_map: list[tuple[str, str]], selector=None, changed_ids: list[str] | None = None, bindings: DataFrame | None = None) -> dict:
    """Exactly one of ``selector`` and ``changed_ids`` names what changed."""
    spark = entries.sparkSession
    faults = governance.role_map_findings(role_map)
    if (selector is None) == (changed_ids is None):
        faults.append(("changed-source-invalid", "changed"))
    changed = None
    if not faults and selector is not None:
        try:
            changed = selectors.select_documents(entries, selector)["matches"]
        except selectors.InvalidSelector as e:
            faults += [("changed-selector-invalid", x) for x in e.args[0]]
    if faults:
        return envelope(faults, "governance", "change-plan", spark=spark, artifacts=None, waves=None)
    if changed is None:
        changed = spark.createDataFrame([(x,) for x in changed_ids], "artifact_id string")
    mapped = governance.mapped_relations(relations, spark.createDataFrame(role_map, "relation_role string, edge_role string"))
    _, found, artifacts, waves = governance.change_plan(entries, mapped, changed, bindings)
    return envelope(found, "governance", "change-plan", artifacts=artifacts, waves=waves)


def build_document_index(sources: DataFrame, namespace: str, budgets: dict = docindex.BUDGETS) -> dict:
    entries, relations, found = docindex.build_index(sources, namespace, budgets)
    return envelope(found, "document-index", "index", entries=entries, relations=relations)


def select_documents(entries: DataFrame, selector) -> dict:
    try:
        result = selectors.select_documents(entries, selector)
    except selectors.InvalidSelector as e:
        return envelope([("invalid-selector", x) for x in e.args[0]], "selectors", "select", spark=entries.sparkSession)
    return {"outcome": "valid", "exit_code": 0, **result}


explain_selector = select_documents


def load_profile(value, schema: str, owner: str) -> dict:
    found = profile.profile_findings(value, schema, owner)
    body = None if found else profile.canonical_profile(value)
    return {"outcome": "invalid-input" if found else "valid", "findings": found, "profile": body, "digest": None if found else K.digest_of(body)}


run_profile_conformance = profile.conformance
git_snapshots = git_source


def verify_projection(document: str, field: str) -> dict:
    """A projection whose digest is not that of its other fields is invalid, without a diagnostic."""
    holds = embedded_digest_holds(document, field)
    return {"outcome": "valid" if holds else "invalid", "exit_code": 0 if holds else 1, "diagnostics": []}
