"""Dependency planning: tasks (task_id, depends_on array<string>) to validated constraints and waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions import kernel as K
from ledgerloom.operators import graph
from ledgerloom.operators.findings import every, rule

MAX_TASKS, MAX_DEPENDENCIES = 10_000, 100_000
#: The planning dimensions, of which only the first is solved.
DIMENSIONS = ("dependency", "assignment", "gate", "placement", "release-train", "resource", "time")


def constraint_id(prerequisite, task):
    return F.concat(F.lit("dependency:"), prerequisite, F.lit("->"), task)


def dependencies(tasks: DataFrame) -> DataFrame:
    """``task_id, pos, prerequisite``."""
    return tasks.select("task_id", F.posexplode("depends_on").alias("pos", "prerequisite"))


def dependency_findings(tasks: DataFrame) -> DataFrame:
    """Per dependency the first rule that it breaks: to itself, to no task, or stated twice."""
    known = tasks.select(F.col("task_id").alias("prerequisite")).distinct().withColumn("known", F.lit(True))
    rows = dependencies(tasks).join(known, "prerequisite", "left")
    cid = constraint_id(F.col("prerequisite"), F.col("task_id"))
    sound = (F.col("task_id") != F.col("prerequisite")) & F.col("known")
    nth = F.row_number().over(W.partitionBy("task_id", "prerequisite").orderBy("pos"))
    code = (
        F.when(F.col("task_id") == F.col("prerequisite"), "dependency-self")
        .when(F.col("known").isNull(), "dependency-unresolved").when(sound & (nth > 1), "dependency-duplicate")
    )
    return rows.select(code.alias("code"), cid.alias("subject"), F.lit("input").alias("cls")).where("code IS NOT NULL")


def duplicate_tasks(tasks: DataFrame) -> DataFrame:
    return rule(tasks.groupBy("task_id").count().where("count > 1"), "task-duplicate", "task_id")


def shape_findings(tasks: DataFrame) -> DataFrame:
    bad = tasks.where("task_id IS NULL OR task_id = ''")
    none = tasks.where("depends_on IS NULL OR exists(depends_on, x -> x IS NULL OR x = '')")
    return every(rule(bad, "problem-invalid", F.lit("taskId")), rule(none, "problem-invalid", F.lit("dependsOn")))


def dimension_findings(active: list[str] | None) -> list[tuple[str, str]]:
    """(code, subject) of the active dimensions: empty, unknown, repeated, or not supported."""
    if active is None:
        return []
    if not active:
        return [("problem-invalid", "activeDimensions")]
    found = [("dimension-unknown", d) for d in active if d not in DIMENSIONS]
    found += [("problem-invalid", d) for i, d in enumerate(active) if d in active[:i]]
    return sorted(found) or sorted(("unsupported-dimension", d) for d in active if d != DIMENSIONS[0])


def budget_findings(tasks: DataFrame, max_tasks: int = MAX_TASKS, max_dependencies: int = MAX_DEPENDENCIES) -> DataFrame:
    n = tasks.agg(F.count(F.lit(1)).alias("t"), F.coalesce(F.sum(F.size("depends_on")), F.lit(0)).alias("d"))
    return every(rule(n.where(F.col("t") > max_tasks), "budget-exhausted", F.lit("tasks")), rule(n.where(F.col("d") > max_dependencies), "budget-exhausted", F.lit("dependencies")))


def problem_findings(tasks: DataFrame, max_tasks: int = MAX_TASKS, max_dependencies: int = MAX_DEPENDENCIES) -> DataFrame:
    """All findings; semantic rules speak only of a sound shape."""
    shape = shape_findings(tasks)
    if not shape.isEmpty():
        return shape
    return every(duplicate_tasks(tasks), dependency_findings(tasks), budget_findings(tasks, max_tasks, max_dependencies))


def constraints(tasks: DataFrame) -> DataFrame:
    """``constraint_id`` of every dependency, in order."""
    return dependencies(tasks).select(constraint_id(F.col("prerequisite"), F.col("task_id")).alias("constraint_id")).orderBy("constraint_id")


def ordering_graph(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks as nodes, dependencies as edges from the prerequisite."""
    nodes = tasks.select(F.col("task_id").alias("id"), F.col("task_id").alias("sort_key"))
    cid = constraint_id(F.col("prerequisite"), F.col("task_id"))
    edges = dependencies(tasks).select(cid.alias("id"), cid.alias("sort_key"), F.lit("dependency").alias("role"), F.col("prerequisite").alias("src"), F.col("task_id").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return nodes, edges


def facts_digest(tasks: DataFrame, active: list[str] | None = None) -> DataFrame:
    """One row: the digest of dimensions and tasks, whatever their order; budgets do not enter.

    The canonical text of all tasks is one value by definition; admission (the task budget) bounds it beforehand.
    """
    one = K.canonical_struct({"dependsOn": F.array_sort("depends_on"), "taskId": F.col("task_id")})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task_id", one.alias("j")))), lambda x: x["j"]), ",")
    dims = K.canonical(sorted(active or [DIMENSIONS[0]]))
    return tasks.agg(body.alias("b")).select(K.digest(F.concat(F.lit(f'{{"dimensions":{dims},"tasks":['), F.col("b"), F.lit("]}"))).alias("facts_digest"))


def schedule(tasks: DataFrame, active: list[str] | None = None, max_tasks: int = MAX_TASKS, max_dependencies: int = MAX_DEPENDENCIES):
    """(outcome, findings, waves or None): nothing partial is given where a rule fails."""
    spark = tasks.sparkSession
    stated = dimension_findings(active)
    if stated:
        return "invalid-input", spark.createDataFrame([(c, s, "input") for c, s in stated], "code string, subject string, cls string"), None
    found = problem_findings(tasks, max_tasks, max_dependencies)
    if not found.isEmpty():
        return "invalid-input", found, None
    nodes, edges = ordering_graph(tasks)
    try:
        return "valid", found, graph.waves(nodes, edges).select(F.col("id").alias("task_id"), "wave")
    except graph.NotADag as e:
        return "invalid", spark.createDataFrame([("dependency-cycle", x, "gates") for x in e.args[0]], "code string, subject string, cls string"), None
