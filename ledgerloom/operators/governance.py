"""Registries, append-only ledgers, gate macros, evidence and change plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions import kernel as K
from ledgerloom.functions.stages import staged
from ledgerloom.operators import graph
from ledgerloom.operators.findings import every, rule

# ---- registry ---------------------------------------------------------------------------------------------------


def registry_findings(registry: DataFrame, index: DataFrame) -> DataFrame:
    """registry (document_id, section_ids) against index (artifact_id, section_ids): unindexed, or other sections."""
    joined = registry.join(index.select("artifact_id", F.col("section_ids").alias("found")), registry.document_id == index.artifact_id, "left")
    code = F.when(F.col("artifact_id").isNull(), "registry-document-unindexed").when(~K.same_array(F.col("section_ids"), F.col("found")), "document-sections-mismatch")
    return joined.select(code.alias("code"), F.col("document_id").alias("subject"), F.lit("gates").alias("cls")).where("code IS NOT NULL")


def registry_shape(registry: DataFrame) -> DataFrame:
    """Unique ids, positive revisions, normal paths, a closed status, unique section ids."""
    field = (
        F.when(F.col("document_revision").isNull() | (F.col("document_revision") <= 0), "documentRevision")
        .when(~K.is_normal_path(F.col("path")), "path").when(~F.col("status").isin("proposed", "accepted", "superseded"), "status")
        .when((F.size("section_ids") != F.size(F.array_distinct("section_ids"))) | F.exists("section_ids", lambda s: ~K.is_section_id(s)), "sectionIds")
    )
    bad = registry.withColumn("f", field).where("f IS NOT NULL")
    twice = registry.groupBy("document_id").count().where("count > 1")
    return every(rule(bad, "registry-invalid", "concat(document_id, ':', f)"), rule(twice, "registry-invalid", "document_id"))


# ---- ledger -----------------------------------------------------------------------------------------------------


def record_digest(record_id, payload_digest, previous):
    return K.digest(K.canonical_struct({"recordId": record_id, "payloadDigest": payload_digest, "previousRecordDigest": previous}))


def chained(entries: DataFrame) -> DataFrame:
    """A ledger from (ledger_id, pos, record_id, payload_digest): each record digests its predecessor's digest.

    One fold per ledger, in order; a ledger is one chain by definition.
    """
    rows = entries.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("pos", "record_id", "payload_digest"))).alias("r"))
    kind = "array<struct<pos:bigint,record_id:string,payload_digest:string,previous_record_digest:string,record_digest:string>>"

    def link(acc, x):
        last = F.get(acc, F.size(acc) - 1)["record_digest"]
        new = F.struct(x["pos"].cast("bigint").alias("pos"), x["record_id"].alias("record_id"), x["payload_digest"].alias("payload_digest"), last.alias("previous_record_digest"), record_digest(x["record_id"], x["payload_digest"], last).alias("record_digest"))
        return F.concat(acc, F.array(new))

    return rows.select("ledger_id", F.inline(F.aggregate("r", F.array().cast(kind), link)))


def ledger_findings(head: DataFrame) -> DataFrame:
    """Rules on one state of ledgers: duplicates, genesis, links, digests."""
    by = W.partitionBy("ledger_id").orderBy("pos")
    rows = head.withColumn("before", F.lag("record_digest").over(by)).withColumn("nth", F.row_number().over(W.partitionBy("ledger_id", "record_id").orderBy("pos")))
    first = F.col("pos") == 0
    own = record_digest(F.col("record_id"), F.col("payload_digest"), F.col("previous_record_digest"))
    return every(
        rule(rows.where("nth > 1"), "ledger-record-duplicate", "record_id", "gates"),
        rule(rows.where(first & F.col("previous_record_digest").isNotNull()), "ledger-genesis-invalid", "record_id", "gates"),
        rule(rows.where(~first & ~F.col("previous_record_digest").eqNullSafe(F.col("before"))), "ledger-chain-broken", "record_id", "gates"),
        rule(rows.where(~F.col("record_digest").eqNullSafe(own)), "ledger-record-digest-mismatch", "record_id", "gates"),
    )


def append_findings(base: DataFrame, head: DataFrame) -> DataFrame:
    """What a head may not do to its base: regress, drop or change records."""
    keys = ["ledger_id", "pos"]
    facts = ("record_id", "payload_digest", "previous_record_digest", "record_digest")
    joined = base.alias("b").join(head.alias("h"), keys, "left")
    here = F.col("h.record_id").isNotNull()
    same = F.lit(True)
    for c in facts:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}"))
    revisions = base.groupBy("ledger_id").agg(F.max("ledger_revision").alias("b")).join(head.groupBy("ledger_id").agg(F.max("ledger_revision").alias("h")), "ledger_id", "left")
    return every(
        rule(revisions.where("h IS NULL"), "ledger-identity-mismatch", "ledger_id", "gates"),
        rule(revisions.where("h < b"), "ledger-revision-regressed", "ledger_id", "gates"),
        rule(joined.where(~here), "ledger-record-removed", "b.record_id", "gates"),
        rule(joined.where(here & ~same), "ledger-record-mutated", "b.record_id", "gates"),
    )


def ledger_counts(base: DataFrame, head: DataFrame) -> DataFrame:
    """``ledger_id, verified, appended, base``."""
    b = base.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("base"))
    h = head.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("verified"))
    n = F.coalesce("base", F.lit(0)).cast("long")
    return h.join(b, "ledger_id", "left").select("ledger_id", "verified", (F.col("verified") - n).alias("appended"), n.alias("base"))


# ---- gate macros and evidence -----------------------------------------------------------------------------------

MACRO_VISITS = 1000


def macro_findings(macros: DataFrame) -> DataFrame:
    """macros (macro_id, expands_to array<struct<check_id, check_revision>>, parameters JSON text)."""
    bad = (
        F.col("macro_id").isNull() | (F.col("macro_id") == "") | F.col("expands_to").isNull() | (F.size("expands_to") == 0)
        | F.exists("expands_to", lambda x: x["check_id"].isNull() | (x["check_id"] == "") | x["check_revision"].isNull() | (x["check_revision"] <= 0))
        | ~F.coalesce(K.is_closed_json(F.col("parameters")), F.lit(False))
    )
    texts = F.concat(F.array("macro_id"), F.transform("expands_to", lambda x: x["check_id"]), F.coalesce(K.json_strings(F.col("parameters")), F.array().cast("array<string>")))
    unsafe = macros.where(F.exists(texts, K.has_executable_token))
    twice = macros.groupBy("macro_id").count().where("count > 1")
    return every(
        rule(macros.where(bad), "gate-macro-invalid", "macro_id"), rule(twice, "gate-macro-invalid", "macro_id"),
        rule(unsafe, "gate-macro-executable-content", "macro_id"),
    )


def expand_macro(library: dict[str, list[tuple[str, int]]], entry: str) -> dict:
    """Leaf checks of a macro, depth first, each visit counted; libraries are small and order decides the faults."""
    if entry not in library:
        return {"code": "gate-macro-unresolved", "subject": entry}
    leaves, seen, visits = set(), set(), 0
    stack: list[tuple[str, bool]] = [(entry, False)]
    path: list[str] = []
    while stack:
        name, leaving = stack.pop()
        if leaving:
            path.pop()
            continue
        if name in path:
            return {"code": "gate-macro-cycle", "subject": name}
        visits += 1
        if visits > MACRO_VISITS:
            return {"code": "gate-macro-bound-exhausted", "subject": entry}
        seen.add(name)
        path.append(name)
        stack.append((name, True))
        for check, revision in reversed(library[name]):
            if check in library:
                stack.append((check, False))
            else:
                leaves.add((check, revision))
    return {"checks": sorted(leaves), "expanded": len(seen)}


def evidence_findings(reports: DataFrame, definitions: DataFrame, snapshot, required=None) -> DataFrame:
    """reports (report_id, check_id, check_revision, snapshot_identity, verdict) that are unbound, of another snapshot,
    or unresolved where required.  ``snapshot``: the expected identity; ``required``: a boolean Column."""
    named = reports.withColumn("subject", F.concat("check_id", F.lit("@"), F.col("check_revision").cast("string")))
    # A report that settles nothing turns all its findings into matters of evidence.
    named = named.withColumn("cls", F.when(F.col("verdict") == "unresolved", "evidence").otherwise("gates"))
    unbound = named.join(definitions, ["check_id", "check_revision"], "left_anti")
    other = named.where(~F.col("snapshot_identity").eqNullSafe(snapshot))
    open_ = named.where((F.col("verdict") == "unresolved") & (F.lit(True) if required is None else required))
    found = (("evidence-check-unbound", unbound), ("evidence-snapshot-mismatch", other), ("evidence-unresolved", open_))
    return every(*(df.select(F.lit(code).alias("code"), "subject", "cls") for code, df in found))


# ---- change plan ------------------------------------------------------------------------------------------------

#: The roles an edge can play; the first two order.
EDGE_ROLES = ("normative-dependency", "derivation", "validation", "history", "navigation", "impact")
ORDERING_ROLES = EDGE_ROLES[:2]
#: Dispositions, strongest first.
DISPOSITIONS = ("revise", "rebuild", "revalidate", "invalidate-evidence", "review-required", "unchanged")


def role_map_findings(role_map: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(code, subject) of mapping entries (relation role, edge role): one that no edge plays, or a role mapped twice."""
    found, seen = [], set()
    for relation, edge in role_map:
        if not relation:
            found.append(("role-mapping-invalid", "entries"))
        elif edge not in EDGE_ROLES:
            found.append(("mapping-role-unknown", f"{relation}:{edge}"))
        elif relation in seen:
            found.append(("mapping-entry-duplicate", relation))
        else:
            seen.add(relation)
    return sorted(found)


def mapped_relations(relations: DataFrame, role_map: DataFrame) -> DataFrame:
    """Relations (relation_id, from_artifact_id, role, target_artifact_id, external) with the role their edge plays."""
    return relations.join(role_map.withColumnRenamed("relation_role", "role"), "role")


def external_targets(mapped: DataFrame) -> DataFrame:
    return rule(mapped.where(F.col("external") & F.col("edge_role").isin(*ORDERING_ROLES, "impact")), "relation-target-external", "relation_id")


def ordering_edges(mapped: DataFrame) -> DataFrame:
    """The target of an ordering relation is the prerequisite, its source the dependent."""
    rows = mapped.where(F.col("edge_role").isin(*ORDERING_ROLES))
    return rows.select(F.col("target_artifact_id").alias("prerequisite_id"), F.col("from_artifact_id").alias("dependent_id"), "edge_role", F.col("role").alias("relation_role"), "relation_id")


def impact_edges(mapped: DataFrame) -> DataFrame:
    return mapped.where("edge_role = 'impact'").select(F.col("from_artifact_id").alias("src"), F.col("target_artifact_id").alias("dst"))


def stale_evidence(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """Artifacts whose evidence was taken of other content."""
    return bindings.join(entries, "artifact_id").where("snapshot_identity <> content_digest").select("artifact_id").distinct()


def as_graph(entries: DataFrame, ordering: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = entries.select(F.col("artifact_id").alias("id"), F.col("artifact_id").alias("sort_key"))
    name = F.concat("prerequisite_id", F.lit("->"), "dependent_id", F.lit(":"), "relation_id")
    return nodes, ordering.select(name.alias("id"), name.alias("sort_key"), F.col("edge_role").alias("role"), F.col("prerequisite_id").alias("src"), F.col("dependent_id").alias("dst"), F.lit(None).cast("double").alias("weight"))


def dispositions(entries: DataFrame, mapped: DataFrame, changed: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """``artifact_id, disposition, changed, review_scope`` of every entry."""
    ordering = staged(ordering_edges(mapped), "ordering")
    nodes, edges = as_graph(entries, ordering)
    starts = changed.select(F.col("artifact_id").alias("id"))
    closure = staged(graph.reachable(nodes, edges, starts).select(F.col("id").alias("artifact_id")), "closure")
    impact = impact_edges(mapped)
    impact = impact.select(F.concat("src", F.lit("->"), "dst").alias("id"), F.lit("").alias("sort_key"), F.lit("impact").alias("role"), "src", "dst", F.lit(None).cast("double").alias("weight"))
    scope = graph.reachable(nodes, impact, starts).select(F.col("id").alias("artifact_id"), F.lit(True).alias("in_scope"))
    inbound = ordering.join(closure.select(F.col("artifact_id").alias("prerequisite_id")), "prerequisite_id", "left_semi").groupBy(F.col("dependent_id").alias("artifact_id")).agg(F.bool_or(F.col("edge_role") == "derivation").alias("derived"))
    out = entries.select("artifact_id").join(changed.select("artifact_id", F.lit(True).alias("is_changed")), "artifact_id", "left")
    out = out.join(closure.withColumn("in_closure", F.lit(True)), "artifact_id", "left").join(inbound, "artifact_id", "left").join(scope, "artifact_id", "left")
    stale = F.lit(None).cast("boolean")
    if bindings is not None:
        out = out.join(stale_evidence(entries, bindings).withColumn("is_stale", F.lit(True)), "artifact_id", "left")
        stale = F.col("is_stale")
    found = (
        F.when(F.col("is_changed"), "revise").when(F.col("in_closure") & F.col("derived"), "rebuild").when(F.col("in_closure"), "revalidate")
        .when(stale, "invalidate-evidence").when(F.col("in_scope"), "review-required").otherwise("unchanged")
    )
    return out.select("artifact_id", found.alias("disposition"), F.coalesce("is_changed", F.lit(False)).alias("changed"), (found == "review-required").alias("review_scope"))


def change_findings(entries: DataFrame, mapped: DataFrame, changed: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    found = [rule(changed.join(entries, "artifact_id", "left_anti"), "changed-artifact-unresolved", "artifact_id"), external_targets(mapped)]
    if bindings is not None:
        found.append(rule(bindings.join(entries, "artifact_id", "left_anti"), "evidence-binding-unresolved", "artifact_id"))
    return every(*found)


def affected_waves(entries: DataFrame, ordering: DataFrame, closure: DataFrame) -> DataFrame:
    """Waves of the graph that the changed artifacts and their dependents induce."""
    nodes, edges = as_graph(entries.join(closure, "artifact_id", "left_semi"), ordering)
    ends = closure.select(F.col("artifact_id").alias("src"))
    inside = edges.join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select(edges.columns)
    return graph.waves(nodes, inside)


def change_plan(entries: DataFrame, mapped: DataFrame, changed: DataFrame, bindings: DataFrame | None = None):
    """(outcome, findings, artifacts or None, waves or None)."""
    found = change_findings(entries, mapped, changed, bindings)
    if not found.isEmpty():
        return "invalid-input", found, None, None
    ordering = staged(ordering_edges(mapped), "ordering")
    nodes, edges = as_graph(entries, ordering)
    broken = graph.graph_findings(nodes, edges)
    if not broken.isEmpty():
        return "invalid", broken.withColumn("code", F.lit("ordering-graph-invalid")), None, None
    spark = entries.sparkSession
    try:
        graph.waves(nodes, edges)
    except graph.NotADag as e:
        return "invalid", spark.createDataFrame([("ordering-cycle", x, "gates") for x in e.args[0]], "code string, subject string, cls string"), None, None
    closure = staged(graph.reachable(nodes, edges, changed.select(F.col("artifact_id").alias("id"))).select(F.col("id").alias("artifact_id")), "closure")
    return "valid", found, dispositions(entries, mapped, changed, bindings), affected_waves(entries, ordering, closure)
