"""Closed selector algebra: nested JSON compiled to one Column per node, with a trace of what short circuits visit.

Entries: ``artifact_id, path, kind, status, owner, tags array<string>, relations array<struct<kind, role,
target_artifact_id>>``.  Terms on diagnostics and namespaces are legal and never match an entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import kernel as K

MAX_SOURCE, MAX_DEPTH, MAX_PATTERN = 100_000, 64, 4_096
_SETS = {"kind": "kind", "status": "status", "owner": "owner"}
_TEXTS = ("artifactId", "path", "diagnostic", "namespace")


class InvalidSelector(ValueError):
    """``args[0]``: the sorted subjects at fault."""


@dataclass
class Node:
    """A node of the compiled tree; ``matches`` is its Column, ``targets`` the artifacts that it names."""

    subject: str
    form: str
    matches: Column
    children: list[Node] = field(default_factory=list)
    targets: list[tuple[str, str]] = field(default_factory=list)

    def everything(self):
        yield self
        for child in self.children:
            yield from child.everything()


@dataclass
class Selector:
    root: Node
    low: int | None = None
    high: int | None = None


def _relation(kind: str, target: str, role: str | None) -> Column:
    def fits(r):
        found = (r["kind"] == kind) & (r["target_artifact_id"] == target)
        return found & (r["role"] == role) if role is not None else found

    return F.coalesce(F.exists("relations", fits), F.lit(False))


def _names(value) -> list[str] | None:
    """The members of {"any": [names]}."""
    if isinstance(value, dict) and set(value) == {"any"} and isinstance(value["any"], list) and value["any"]:
        if all(isinstance(x, str) and x for x in value["any"]):
            return value["any"]
    return None


def compile_selector(source) -> Selector:
    """The tree of a selector; every fault is collected before ``InvalidSelector`` is raised."""
    faults: list[str] = []
    bounds: dict[str, int | None] = {"min": None, "max": None}

    def leaf(subject: str, form: str, value) -> Node | None:
        at, targets, matches = f"{subject}.{form}", [], None
        if form in _TEXTS and isinstance(value, str) and value:
            if form == "artifactId":
                matches = F.col("artifact_id") == value
            elif form == "path" and len(value) <= MAX_PATTERN:
                try:
                    matches = K.glob_match(F.col("path"), value)
                except K.GlobRejected:
                    pass
            elif form != "path":
                matches = F.lit(False)
        elif form in (*_SETS, "tag") and (names := _names(value)):
            matches = F.arrays_overlap("tags", F.array(*map(F.lit, names))) if form == "tag" else F.col(_SETS[form]).isin(names)
        elif form in ("reference", "traceability") and isinstance(value, dict):
            allowed = {"target", "role"} if form == "reference" else {"target"}
            role = value.get("role")
            if set(value) <= allowed and isinstance(value.get("target"), str) and value["target"] and (role is None or isinstance(role, str) and role):
                targets = [(at, value["target"])]
                matches = _relation(form, value["target"], role)
        if matches is None:
            faults.append(at)
            return None
        return Node(subject, form, F.coalesce(matches, F.lit(False)), targets=targets)

    def visit(node, subject: str, depth: int) -> Node | None:
        if not isinstance(node, dict) or depth > MAX_DEPTH:
            faults.append(subject)
            return None
        forms = [k for k in node if k in _FORMS]
        for k, v in node.items():
            if k in bounds and depth == 1:
                if isinstance(v, int) and not isinstance(v, bool) and v >= 0:
                    bounds[k] = v
                else:
                    faults.append(f"{subject}.{k}")
            elif k not in _FORMS:
                faults.append(f"{subject}.{k}")
        if len(forms) != 1:
            faults.append(subject)
            return None
        form, value = forms[0], node[forms[0]]
        if form in ("all", "any"):
            if not isinstance(value, list) or not value:
                faults.append(f"{subject}.{form}")
                return None
            children = [visit(c, f"{subject}.{form}[{i}]", depth + 1) for i, c in enumerate(value)]
            if None in children:
                return None
            return Node(subject, form, reduce(and_ if form == "all" else or_, [c.matches for c in children]), children)
        if form == "not":
            child = visit(value, f"{subject}.not", depth + 1)
            return child and Node(subject, form, ~child.matches, [child])
        return leaf(subject, form, value)

    if len(K.canonical(source)) > MAX_SOURCE:
        raise InvalidSelector(["selector"])
    root = visit(source, "selector", 1)
    if bounds["min"] is not None and bounds["max"] is not None and bounds["min"] > bounds["max"]:
        faults.append("selector")
    if faults or root is None:
        raise InvalidSelector(sorted(set(faults)))
    return Selector(root, bounds["min"], bounds["max"])


_FORMS = ("all", "any", "not", *_TEXTS, *_SETS, "tag", "reference", "traceability")


def unresolved_targets(entries: DataFrame, selector: Selector) -> list[str]:
    """Subjects of the terms whose target is no entry; any of them fails the selection."""
    named = [t for n in selector.root.everything() for t in n.targets]
    if not named:
        return []
    rows = entries.sparkSession.createDataFrame(named, "subject string, artifact_id string")
    return sorted(r[0] for r in rows.join(entries.select("artifact_id"), "artifact_id", "left_anti").select("subject").collect())


def matched(entries: DataFrame, selector: Selector) -> DataFrame:
    return entries.where(selector.root.matches).orderBy("artifact_id")


def _visited(node: Node, seen: Column):
    """(subject, outcome, visited) in preorder: a child is visited unless an elder one has decided."""
    yield node.subject, node.matches, seen
    ahead = seen
    for child in node.children:
        yield from _visited(child, ahead)
        if node.form in ("all", "any"):
            ahead = ahead & (child.matches if node.form == "all" else ~child.matches)


def explained(entries: DataFrame, selector: Selector) -> DataFrame:
    """``artifact_id, trace``: for each entry the visited nodes and whether they admitted or rejected it."""
    steps = [
        F.struct(F.lit(s).alias("subject"), F.when(m, "admitted").otherwise("rejected").alias("outcome"), v.alias("visited"))
        for s, m, v in _visited(selector.root, F.lit(True))
    ]
    seen = F.filter(F.array(*steps), lambda x: x["visited"])
    return entries.select("artifact_id", F.transform(seen, lambda x: F.struct(x["subject"].alias("subject"), x["outcome"].alias("outcome"))).alias("trace"))


def select_documents(entries: DataFrame, source) -> dict:
    """Matches in order, trace, and what the cardinality says; raises InvalidSelector."""
    selector = compile_selector(source)
    twice = entries.groupBy("artifact_id").count().where("count > 1")
    if not twice.isEmpty():
        raise InvalidSelector(["index"])
    if lost := unresolved_targets(entries, selector):
        raise InvalidSelector(lost)
    found = matched(entries, selector)
    n = found.count()
    if n and ((selector.low is not None and n < selector.low) or (selector.high is not None and n > selector.high)):
        raise InvalidSelector(["selector"])
    note = "zero-match-diagnostic" if n == 0 and selector.low != 0 else None
    return {"matches": found.select("artifact_id"), "trace": explained(entries, selector), "count": n, "diagnostic": note}
