"""``python -m ledgerloom.cli COMMAND [--input FILE] [--output FILE] [--format json|sarif|terminal]``.

A request is one JSON object; lists of records in it become DataFrames.  The exit code is the outcome's.
"""

from __future__ import annotations

import sys

from ledgerloom import api
from ledgerloom.functions import kernel as K
from ledgerloom.sources import json_files

FORMATS = ("json", "sarif", "terminal")
OPTIONS = ("--input", "--output", "--format")


def parse_arguments(argv: list[str]) -> tuple[dict, list[tuple[str, str]]]:
    """(invocation, findings)."""
    if not argv or argv[0] not in COMMANDS:
        return {}, [("unknown-command", argv[0] if argv else "")]
    found, call = [], {"command": argv[0], "--format": "json"}
    rest = argv[1:]
    while rest:
        name = rest.pop(0)
        if not name.startswith("--"):
            found.append(("unexpected-argument", name))
        elif name not in OPTIONS:
            found.append(("unknown-option", name))
        elif not rest:
            found.append(("missing-option", name))
        else:
            call[name] = rest.pop(0)
    if call["--format"] not in FORMATS:
        found.append(("invalid-option-value", "--format"))
    return call, found


def _planning(spark, request):
    tasks = spark.createDataFrame([(t["taskId"], t["dependsOn"]) for t in request["tasks"]], "task_id string, depends_on array<string>")
    out = api.compile_planning(tasks, request.get("activeDimensions"))
    waves = out["waves"]
    return out | {"waves": None if waves is None else [r.asDict() for r in waves.orderBy("wave", "task_id").collect()]}


def _sources(spark, rows):
    schema = "artifact_id string, path string, version string, content string, content_digest string, blob_sha string, kind string, status string, owner string, tags array<string>, references array<struct<kind:string,role:string,target:struct<artifact_id:string,revision:bigint,external:boolean>>>"
    return spark.createDataFrame(rows, schema)


def _index(spark, request):
    out = api.build_document_index(_sources(spark, request["sources"]), request["namespace"])
    return out | {k: None if out[k] is None else [r.asDict(True) for r in out[k].collect()] for k in ("entries", "relations")}


def _select(spark, request):
    rows = spark.createDataFrame(request["entries"], "artifact_id string, path string, kind string, status string, owner string, tags array<string>, relations array<struct<kind:string,role:string,target_artifact_id:string>>")
    out = api.select_documents(rows, request["selector"])
    return out | {k: [r.asDict(True) for r in out[k].collect()] for k in ("matches", "trace") if k in out}


def _profile(spark, request):
    return api.run_profile_conformance(request["profile"], request["schema"], request["owner"])


def _verify(spark, request):
    return api.verify_projection(K.canonical(request["document"]), request["field"])


def _plan(spark, request):
    entries = spark.createDataFrame(request["entries"], "artifact_id string, path string, kind string, status string, owner string, tags array<string>, content_digest string, relations array<struct<kind:string,role:string,target_artifact_id:string>>")
    rel = spark.createDataFrame(request["relations"], "relation_id string, from_artifact_id string, kind string, role string, target_artifact_id string, external boolean")
    out = api.compile_change_plan(entries, rel, [tuple(x) for x in request["roleMap"]], request.get("selector"), request.get("changed"))
    return out | {k: None if out[k] is None else [r.asDict() for r in out[k].collect()] for k in ("artifacts", "waves")}


COMMANDS = {"planning": _planning, "index": _index, "select": _select, "explain": _select, "profile": _profile, "change-plan": _plan, "verify": _verify}


def run(argv: list[str], spark=None) -> int:
    """Runs one command; whatever fails unexpectedly is an internal error with its exit code, not a traceback."""
    try:
        return _run(argv, spark)
    except Exception as e:
        print(f"error internal-error: {type(e).__name__}", file=sys.stderr)
        return K.OUTCOMES.index("internal-error")


def _run(argv: list[str], spark) -> int:
    call, found = parse_arguments(argv)
    if not found:
        try:
            request = K.parse_json(json_files.read_request(call.get("--input")))
        except json_files.Unreadable:
            found = [("input-unreadable", call.get("--input") or "stdin")]
        except ValueError:
            found = [("invalid-json", call.get("--input") or "stdin")]
    if found:
        for code, subject in found:
            print(f"error {code}: {subject}", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    try:
        out = COMMANDS[call["command"]](spark, request)
    except (KeyError, TypeError) as e:
        print(f"error invalid-input: {e}", file=sys.stderr)
        return 2
    diagnostics = out.get("diagnostics") or []
    if not isinstance(diagnostics, list):
        diagnostics = [r.asDict() for r in diagnostics.collect()]
    body = out | {"diagnostics": diagnostics}
    if call["--format"] == "terminal":
        text, lines = json_files.render_terminal(call["command"], out["outcome"], diagnostics)
        print(lines, end="", file=sys.stderr)
    else:
        text = json_files.render_json(body) if call["--format"] == "json" else json_files.render_sarif(diagnostics, "ledgerloom")
    if "--output" in call:
        json_files.write_atomic(call["--output"], text.encode())
    else:
        print(text, end="")
    return out.get("exit_code", K.OUTCOMES.index(out["outcome"]))


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
