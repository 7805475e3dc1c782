"""Read-only git sources: trees, comparisons and workspaces as DataFrames with the digest of every file's bytes.

Only five reading subcommands can run, with nothing but PATH in their environment.  Listings are text that Spark parses;
blobs are read on the driver under budgets, since a repository is a local folder there.
"""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import kernel as K

READS = ("cat-file", "diff-tree", "ls-tree", "rev-parse", "status")
#: The stderr texts that tell failures apart, in order.
_FAILURES = (
    ("ambiguous-ref", ("is ambiguous",)), ("repository-unreachable", ("not a git repository", "cannot change to", "dubious ownership")),
    ("unknown-ref", ("unknown revision", "bad revision", "needed a single revision", "not a valid object name")),
    ("missing-object", ("missing blob", "could not get object info", "bad object", "unable to read")),
)


class GitError(RuntimeError):
    """``args[0]``: the class of the failure."""


@dataclass
class Budgets:
    files: int = 5_000
    file_bytes: int = 1 << 20
    output_bytes: int = 16 << 20
    total_bytes: int = 256 << 20

    def __post_init__(self):
        if any(not isinstance(v, int) or v <= 0 for v in vars(self).values()):
            raise GitError("invalid-budgets")


def run_git(root: str, command: str, *args: str, budgets: Budgets | None = None, data: bytes | None = None) -> bytes:
    if command not in READS:
        raise GitError("disallowed-subcommand")
    if any("\0" in a for a in args):
        raise GitError("invalid-request")
    done = subprocess.run(["git", "-C", root, "--no-optional-locks", command, *args], input=data, capture_output=True, env={"PATH": os.environ.get("PATH", "")})
    if done.returncode:
        said = done.stderr.decode("utf-8", "replace").lower()
        raise GitError(next((k for k, texts in _FAILURES if any(t in said for t in texts)), "process-failure"))
    if len(done.stdout) > (budgets or Budgets()).output_bytes:
        raise GitError("budget-exceeded")
    return done.stdout


def exact_ref(ref: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._/-]*", ref) or ".." in ref or "//" in ref or ref.endswith(("/", ".lock")):
        raise GitError("invalid-ref")
    return ref


def resolve(root: str, ref: str) -> str:
    found = run_git(root, "rev-parse", "--verify", exact_ref(ref) + "^{commit}").decode().strip()
    if not re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", found):
        raise GitError("unexpected-git-output")
    return found


def parse_tree(listing: DataFrame, column: str = "listing") -> DataFrame:
    """``mode, type, blob, path`` of NUL-ended ``ls-tree -r -z`` output."""
    line = F.explode(F.filter(F.split(column, "\x00"), lambda x: x != "")).alias("line")
    part = lambda k: F.regexp_extract("line", r"(?s)\A(\d{6}) (blob|commit|tree) ([0-9a-f]+)\t(.*)\z", k)
    return listing.select(line).select(part(1).alias("mode"), part(2).alias("type"), part(3).alias("blob"), part(4).alias("path"))


def parse_status(listing: DataFrame, column: str = "listing") -> DataFrame:
    """``kind, state, path`` of NUL-ended ``status --porcelain=v2 -z`` output without renames."""
    line = F.explode(F.filter(F.split(column, "\x00"), lambda x: x != "")).alias("line")
    kind = F.substring("line", 1, 1)
    path = F.when(kind == "1", F.regexp_extract("line", r"(?s)\A1 (?:\S+ ){7}(.*)\z", 1)).when(kind == "u", F.regexp_extract("line", r"(?s)\Au (?:\S+ ){9}(.*)\z", 1)).otherwise(F.substring("line", 3, 1 << 20))
    return listing.select(line).where(~F.col("line").startswith("#")).select(kind.alias("kind"), F.when(kind == "1", F.substring("line", 3, 2)).alias("state"), path.alias("path"))


def parse_diff(listing: DataFrame, column: str = "listing") -> DataFrame:
    """``status, old_blob, new_blob, path`` of NUL-ended raw ``diff-tree -r -z`` output."""
    pairs = F.explode(F.regexp_extract_all(column, F.lit("(?s):(\\d{6} \\d{6} [0-9a-f]+ [0-9a-f]+ [A-Z]\\x00[^\\x00]+)\\x00"), F.lit(1))).alias("line")
    part = lambda k: F.regexp_extract("line", r"(?s)\A\d{6} \d{6} ([0-9a-f]+) ([0-9a-f]+) ([A-Z])\x00(.*)\z", k)
    return listing.select(pairs).select(part(3).alias("status"), part(1).alias("old_blob"), part(2).alias("new_blob"), part(4).alias("path"))


def _files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    out = spark.createDataFrame(rows, "path string, byte_class string, blob string, bytes binary")
    return out.select("path", "byte_class", "blob", F.octet_length("bytes").cast("long").alias("byte_count"), K.byte_list_digest("bytes").alias("digest"))


def _blobs(root: str, entries: list[tuple[str, str]], byte_class: str, budgets: Budgets) -> list[tuple]:
    if len(entries) > budgets.files:
        raise GitError("budget-exceeded")
    rows, total = [], 0
    for path, blob in entries:
        data = run_git(root, "cat-file", "blob", blob, budgets=budgets)
        total += len(data)
        if len(data) > budgets.file_bytes or total > budgets.total_bytes:
            raise GitError("budget-exceeded")
        rows.append((path, byte_class, blob, data))
    return rows


def _tree(spark: SparkSession, root: str, commit: str, budgets: Budgets) -> list[tuple[str, str]]:
    text = run_git(root, "ls-tree", "-r", "-z", commit, budgets=budgets).decode("utf-8", "replace")
    rows = parse_tree(spark.createDataFrame([(text,)], "listing string")).collect()
    if any(r["type"] == "commit" for r in rows):
        raise GitError("submodule-contents")
    if any(not r["path"] for r in rows):
        raise GitError("unexpected-git-output")
    return sorted((r["path"], r["blob"]) for r in rows)


def snapshot_commit(spark: SparkSession, root: str, ref: str, budgets: Budgets | None = None) -> DataFrame:
    """``path, byte_class, blob, byte_count, digest`` of every file of a commit."""
    budgets = budgets or Budgets()
    return _files(spark, _blobs(root, _tree(spark, root, resolve(root, ref), budgets), "committed", budgets))


def snapshot_compare(spark: SparkSession, root: str, base: str, head: str, budgets: Budgets | None = None) -> DataFrame:
    """Files that differ between two commits, each side bound; an added or deleted file has a null side."""
    a, b = (snapshot_commit(spark, root, r, budgets).select("path", F.struct("blob", "digest").alias(side)) for r, side in ((base, "before"), (head, "after")))
    both = a.join(b, "path", "full").where("NOT (before.blob <=> after.blob)")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return both.select("path", status.alias("status"), F.col("before.blob").alias("old_blob"), F.col("after.blob").alias("new_blob"), F.col("before.digest").alias("old_digest"), F.col("after.digest").alias("new_digest")).orderBy("path")


def snapshot_workspace(spark: SparkSession, root: str, budgets: Budgets | None = None) -> DataFrame:
    """Head, index, unstaged and untracked bytes, told apart by ``byte_class``."""
    budgets = budgets or Budgets()
    head = snapshot_commit(spark, root, "HEAD", budgets).withColumn("byte_class", F.lit("head"))
    text = run_git(root, "status", "--porcelain=v2", "-z", "--untracked-files=all", "--no-renames", budgets=budgets).decode("utf-8", "replace")
    rows = parse_status(spark.createDataFrame([(text,)], "listing string")).collect()
    if any(r["kind"] == "u" for r in rows):
        raise GitError("unmerged-path")
    indexed, loose = [], []
    for r in rows:
        name = os.path.join(root, r["path"])
        if os.path.islink(name):
            if _escapes(r["path"], os.readlink(name)):
                raise GitError("unsafe-path")
            continue
        if r["kind"] == "1" and r["state"][0] != "." and r["state"][0] != "D":
            indexed.append((r["path"], run_git(root, "rev-parse", ":" + r["path"]).decode().strip()))
        if (r["kind"] == "?" or r["state"] and r["state"][1] == "M") and os.path.isfile(name):
            if os.path.getsize(name) > budgets.file_bytes:
                raise GitError("budget-exceeded")
            with open(name, "rb") as f:
                loose.append((r["path"], "untracked" if r["kind"] == "?" else "unstaged", None, f.read()))
    return head.unionByName(_files(spark, _blobs(root, indexed, "index", budgets) + loose)).orderBy("path", "byte_class")


def _escapes(path: str, target: str) -> bool:
    return target.startswith("/") or os.path.normpath(os.path.join(os.path.dirname(path), target)).split("/")[0] == ".."
