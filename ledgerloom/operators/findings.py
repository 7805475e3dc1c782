"""Findings and diagnostics: rules give (code, subject, class) rows; drafts are finalized and folded to one outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import kernel as K

FINDING = "code string, subject string, cls string"

#: The closed vocabularies of a diagnostic and its fields.
VERDICTS = ("pass", "fail", "warning", "not-applicable", "unresolved")
SEVERITIES = ("error", "warning")
CATEGORIES = ("input", "evidence", "gates", "extension", "internal")
DRAFT_FIELDS = (
    "code", "origin", "category", "phase", "verdict", "severity", "ruleId", "location", "subjects", "parameters",
    "causes", "help",
)

#: The verdict of a finding's class.
VERDICT_OF_CLASS = {"input": "fail", "gates": "fail", "evidence": "unresolved"}


def rule(df: DataFrame, code: str, subject, cls: str = "input") -> DataFrame:
    """The rows of ``df`` as findings of one code; ``subject`` is a Column or SQL."""
    subject = F.expr(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"), F.lit(cls).alias("cls"))


def every(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def ordered(findings: DataFrame) -> DataFrame:
    """By code, then subject, in code point order."""
    return findings.orderBy("code", "subject")


def coalesced(findings: DataFrame, *more: str) -> DataFrame:
    """Identical issues once, in order; ``more``: further columns of the order (witness, location)."""
    return findings.distinct().orderBy("code", "subject", *more)


def drafts(findings: DataFrame, origin: str, phase: str) -> DataFrame:
    """Findings as diagnostic drafts: the class is the category and decides the verdict."""
    verdict = F.coalesce(*[F.when(F.col("cls") == c, v) for c, v in VERDICT_OF_CLASS.items()], F.lit("fail"))
    none = F.array().cast("array<string>")
    return findings.select(
        "code", F.lit(origin).alias("origin"), F.col("cls").alias("category"), F.lit(phase).alias("phase"),
        verdict.alias("verdict"), F.lit("error").alias("severity"), F.col("code").alias("ruleId"),
        F.lit(None).cast("string").alias("location"), F.array("subject").alias("subjects"),
        F.lit("{}").alias("parameters"), none.alias("causes"), none.alias("help"),
    )


def draft_findings(rows: DataFrame) -> DataFrame:
    """Rules on drafts: every field there, code in its grammar, verdict, severity and category of their vocabularies."""
    there = [c for c in DRAFT_FIELDS if c in rows.columns and c != "location"]
    absent = F.array(*[F.when(F.col(c).isNull(), c) for c in there], *[F.lit(c) for c in DRAFT_FIELDS if c not in rows.columns])
    missing = rows.select(F.explode(F.filter(absent, lambda x: x.isNotNull())).alias("f"))
    wrong = F.array(
        F.when(~K.is_diagnostic_code(F.col("code")), "code"),
        *[F.when(~F.col(c).isin(*v), c) for c, v in (("verdict", VERDICTS), ("severity", SEVERITIES), ("category", CATEGORIES))],
    )
    invalid = rows.select(F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("f"))
    subject = F.concat(F.lit("diagnostic."), F.col("f"))
    return every(rule(missing, "missing-field", subject), rule(invalid, "invalid-field", subject))


def finalized(rows: DataFrame) -> DataFrame:
    """Drafts with sorted lists and their digest, equal ones once, by code, subjects, digest."""
    lists = ("causes", "help", "subjects")
    sorted_rows = rows.select(*[F.array_sort(c).alias(c) if c in lists else F.col(c) for c in DRAFT_FIELDS])
    body = {c: F.col(c) for c in DRAFT_FIELDS if c not in ("location", "parameters")}
    # location and parameters are canonical JSON texts already; a placeholder keeps their places in the record.
    text = K.canonical_struct({**body, "location": F.lit("\x01location"), "parameters": F.lit("\x01parameters")})
    text = F.replace(text, F.lit('"\\u0001location"'), F.coalesce("location", F.lit("null")))
    text = F.replace(text, F.lit('"\\u0001parameters"'), F.col("parameters"))
    out = sorted_rows.withColumn("digest", K.digest(text)).dropDuplicates(["digest"])
    return out.orderBy("code", "subjects", "digest")


def outcome(rows: DataFrame) -> DataFrame:
    """One row (exit_code, outcome): the gravest of the diagnostics (category, verdict); `input` whatever its verdict."""
    grade = (
        F.when(F.col("category") == "internal", 4).when(F.col("category") == "extension", 3)
        .when(F.col("category") == "input", 2).when(F.col("verdict").isin("fail", "unresolved"), 1).otherwise(0)
    )
    worst = rows.agg(F.coalesce(F.max(grade), F.lit(0)).alias("exit_code"))
    return worst.select("exit_code", F.get(F.array(*map(F.lit, K.OUTCOMES)), F.col("exit_code")).alias("outcome"))


def declaration_findings(declared: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Declarations (decl_id, kind, keys array<string>) against a closed vocabulary (kind, field, required boolean)."""
    kinds = vocabulary.select("kind").distinct()
    unknown = declared.join(kinds, "kind", "left_anti")
    fields = declared.join(kinds, "kind").select("decl_id", "kind", F.explode("keys").alias("field"))
    extra = fields.join(vocabulary, ["kind", "field"], "left_anti")
    needed = declared.join(vocabulary.where("required"), "kind").where(~F.array_contains("keys", F.col("field")))
    subject = F.concat("decl_id", F.lit("."), "field")
    return every(
        rule(unknown, "unknown-declaration-kind", "decl_id"), rule(extra, "unknown-field", subject), rule(needed, "missing-field", subject)
    )
