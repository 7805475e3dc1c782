"""JSON requests in, JSON, SARIF and terminal renderings out."""

from __future__ import annotations

import json
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions import kernel as K


class Unreadable(OSError):
    pass


def read_request(path: str | None) -> str:
    """The whole text of a named file, or of standard input."""
    try:
        return sys.stdin.read() if path is None else open(path, encoding="utf-8").read()
    except (OSError, UnicodeDecodeError) as e:
        raise Unreadable("input-unreadable") from e


def read_facts(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON documents, one per file: rejected ones keep their text."""
    kept = StructType([*schema.fields, StructField("_corrupt", StringType())])
    rows = spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select(F.lit("invalid-json").alias("code"), F.col("_corrupt").alias("text"))


def parsed(texts: DataFrame, column: str, schema: StructType) -> DataFrame:
    """JSON texts as a struct column ``value``, and ``invalid`` where the text is not such JSON."""
    value = F.from_json(F.col(column), StructType([*schema.fields, StructField("_corrupt", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return texts.withColumn("value", value).withColumn("invalid", F.col("value").isNull() | F.col("value._corrupt").isNotNull())


def write_atomic(path: str, data: bytes) -> None:
    """The file whole or not at all: a temporary one in its folder takes its name."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        os.replace(name, path)
    except OSError:
        if os.path.exists(name):
            os.unlink(name)
        raise


def render_json(value) -> str:
    """Two blanks of indent, keys as they come, a final line end."""
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """``ruleId, level, message`` of diagnostics (code, severity, subjects)."""
    return diagnostics.select(F.col("code").alias("ruleId"), F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level"), F.concat("code", F.lit(": "), F.array_join("subjects", ", ")).alias("message"))


def render_sarif(diagnostics: list[dict], tool: str) -> str:
    results = [{"ruleId": x["code"], "level": "error" if x["severity"] == "error" else "warning", "message": {"text": f"{x['code']}: {', '.join(x['subjects'])}"}} for x in diagnostics]
    return render_json({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool}}, "results": results}]})


def render_terminal(command: str, outcome: str, diagnostics: list[dict]) -> tuple[str, str]:
    """(summary for stdout, diagnostics for stderr)."""
    lines = "".join(f"{x['severity']} {x['code']}: {', '.join(x['subjects'])}\n" for x in diagnostics)
    return f"{command}: {outcome} ({len(diagnostics)} diagnostics)\n", lines


def embedded_digest_holds(document: str, field: str) -> bool:
    """Whether a document's digest field is the digest of the rest of it."""
    value = K.parse_json(document)
    return isinstance(value, dict) and value.get(field) == K.digest_of({k: v for k, v in value.items() if k != field})
