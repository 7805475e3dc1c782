import json
import os
import subprocess

import pytest

from ledgerloom import cli
from ledgerloom.functions.markdown import parse_blocks
from ledgerloom.operators import docindex as X
from ledgerloom.sources import git_source, json_files


def kinds(text):
    return [b.kind or b.type for b in parse_blocks(text)]


@pytest.mark.parametrize("text, want", [
    ("# A\n\ntext\nmore\n", ["heading", "paragraph"]), ("A\nB\n===\n", ["heading"]), ("```\n# no\n```\n# yes", ["code", "heading"]), ("    code\n\n    more\ntext", ["code", "paragraph"]),
    ("* a\n* b\n\n  c\n\n> q\nlazy\n\n---\n", ["list", "blockquote", "thematic-break"]), ("<div>\n# no\n\n# yes", ["html", "heading"]), ("<!-- a\n\nb -->\ntext", ["html", "paragraph"]),
    ("[a]: /x 'y'\n[b]: /z\ntext", ["definition", "definition", "paragraph"]), ("1. a\n2. b\n\nx\n2. no", ["list", "paragraph"]), ("text\n# h\n- i", ["paragraph", "heading", "list"]), ("a\r\rb\r\n\r\n# c", ["paragraph", "paragraph", "heading"]),
    ("- a\n\n- b\n\ntext", ["list", "paragraph"]), ("~~~ x\nopen", ["code"]), ("#no\n\n####### no", ["paragraph", "paragraph"]), ("", []), ("- - -\n***", ["thematic-break", "thematic-break"]),
])
def test_blocks(text, want):
    assert kinds(text) == want


def test_heading_text_and_spans():
    blocks = parse_blocks("# A *b* `c` [d](e) ![f](g) <i>h</i> &amp; \\* #\n\n  \U0001f600x\n---\n")
    assert [(b.depth, b.text) for b in blocks] == [(1, "A b c d  h & *"), (2, "\U0001f600x")]
    assert blocks[1].span == (3, 3, blocks[0].span[5] + 4, 4, 4, blocks[0].span[5] + 11)


SOURCE = "artifact_id string, path string, version string, content string, content_digest string, blob_sha string, kind string, status string, owner string, tags array<string>, references array<struct<kind:string,role:string,target:struct<artifact_id:string,revision:bigint,external:boolean>>>"


def source(name, content, references=(), digest=None):
    from ledgerloom.functions.kernel import digest_of

    return (name, f"d/{name}.md", "1", content, digest or digest_of(content), None, "guide", "active", "team", ["b", "a"], list(references))


def test_anchors_escalate():
    assert X.disambiguated(["details"] * 3) == ["details", "details-2", "details-3"]
    assert X.disambiguated(["details", "details-2", "details"]) == ["details", "details-2", "details-3"]


@pytest.mark.parametrize("text, sections, codes", [
    ('<!-- docs:section id="s" -->\n\n\n# H', ["s"], []), ('<!-- docs:section id="s" -->\n\ntext', [], ["marker-not-followed-by-heading"]), ('<!-- docs:section id="s" -->', [], ["marker-not-followed-by-heading"]),
    ('   <!-- docs:section id="s" -->\n# H', [], []), ('    <!-- docs:section id="s" -->\n# H', [], []), ('> <!-- docs:section id="s" -->\n\n# H', [], []),
    ('<!-- docs:section id="s" -->\n# H\n<!-- docs:section id="s" -->\n# I', ["s"], ["duplicate-section-id"]), ('<!-- docs:section id="s" -->\ntext\n\n<!-- docs:section id="s" -->\n# I', ["s"], ["marker-not-followed-by-heading"]),
])
def test_sections(spark, text, sections, codes):
    found, faults = X.sections(X.blocks(spark.createDataFrame([source("a", text)], SOURCE)), "docs")
    assert [r.section_id for r in found.collect()] == sections and [r.code for r in faults.collect()] == codes


def test_index_is_all_or_nothing(spark):
    rows = [source("a", "# One\n\n## One"), source("b", "text", [("reference", "requires", ("a", 1, False))])]
    entries, relations, found = X.build_index(spark.createDataFrame(rows, SOURCE), "docs")
    assert found.count() == 0 and relations.first().relation_id == '{"from":"b","kind":"reference","revision":1,"role":"requires","to":"a"}'
    first = entries.orderBy("artifact_id").first()
    assert [h.anchor for h in first.headings] == ["one", "one-2"] and first.tags == ["a", "b"]
    digest = X.index_digest(entries).first()[0]
    again = X.build_index(spark.createDataFrame(rows[::-1], SOURCE), "docs")[0]
    assert X.index_digest(again).first()[0] == digest
    bad = [source("a", "x", [("reference", None, ("none", None, False))]), source("b", "y", digest="sha256:no")]
    entries, _, found = X.build_index(spark.createDataFrame(bad, SOURCE), "docs")
    assert entries is None and {r.code for r in found.collect()} == {"unresolved-relation-target", "content-digest-mismatch"}


def test_cache_is_only_verified(spark):
    rows = spark.createDataFrame([source("a", "# x"), source("b", "# x"), source("c", "y")], SOURCE)
    fresh = X.cache_entries(rows, "c", 1)
    assert fresh.count() == 2 and X.cache_findings(fresh, fresh).count() == 0


def _git(root, *args):
    env = {"PATH": os.environ["PATH"], "HOME": str(root), "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


def test_git_snapshots(spark, tmp_path):
    _git(tmp_path, "init", "-q")
    (tmp_path / "a.txt").write_text("#$")
    (tmp_path / "b.txt").write_text("b")
    _git(tmp_path, "add", ".")
    _git(tmp_path, "commit", "-qm", "one")
    _git(tmp_path, "tag", "v1")
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("c")
    _git(tmp_path, "add", "c.txt")
    (tmp_path / "d.txt").write_text("d")
    work = {(r.path, r.byte_class) for r in git_source.snapshot_workspace(spark, str(tmp_path)).collect()}
    assert work == {("a.txt", "head"), ("b.txt", "head"), ("a.txt", "unstaged"), ("c.txt", "index"), ("d.txt", "untracked")}
    _git(tmp_path, "rm", "-q", "b.txt")
    _git(tmp_path, "commit", "-qam", "two")
    assert {(r.path, r.status) for r in git_source.snapshot_compare(spark, str(tmp_path), "v1", "HEAD").collect()} == {("a.txt", "modified"), ("b.txt", "deleted"), ("c.txt", "added")}
    first = git_source.snapshot_commit(spark, str(tmp_path), "v1").where("path = 'a.txt'").first()
    from ledgerloom.functions.kernel import digest_of

    assert first.byte_count == 2 and first.digest == digest_of("[35,36]")
    for ref, why in (("none", "unknown-ref"), ("a..b", "invalid-ref")):
        with pytest.raises(git_source.GitError, match=why):
            git_source.snapshot_commit(spark, str(tmp_path), ref)
    with pytest.raises(git_source.GitError, match="disallowed-subcommand"):
        git_source.run_git(str(tmp_path), "push")
    with pytest.raises(git_source.GitError, match="budget-exceeded"):
        git_source.snapshot_commit(spark, str(tmp_path), "HEAD", git_source.Budgets(files=1))


def test_command_line(spark, tmp_path, capsys):
    path, out = tmp_path / "r.json", tmp_path / "o.json"
    path.write_text(json.dumps({"tasks": [{"taskId": "A", "dependsOn": []}, {"taskId": "B", "dependsOn": ["A"]}]}))
    assert cli.run(["planning", "--input", str(path), "--output", str(out)], spark) == 0
    assert json.loads(out.read_text())["waves"] == [{"task_id": "A", "wave": 0}, {"task_id": "B", "wave": 1}]
    path.write_text(json.dumps({"tasks": [{"taskId": "A", "dependsOn": ["A"]}]}))
    assert cli.run(["planning", "--input", str(path), "--format", "sarif"], spark) == 2
    assert json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["ruleId"] == "dependency-self"
    path.write_text("{")
    for args in (["planning", "--input", str(path)], ["nothing"], ["planning", "--odd", "x"], ["planning", "--input", str(tmp_path / "none")], ["planning", "--format", "xml"]):
        assert cli.run(args, spark) == 2
    document = {"a": 1, "digest": ""}
    from ledgerloom.functions.kernel import digest_of

    document["digest"] = digest_of({"a": 1})
    assert json_files.embedded_digest_holds(json.dumps(document), "digest")
    path.write_text(json.dumps({"document": {**document, "a": 2}, "field": "digest"}))
    assert cli.run(["verify", "--input", str(path)], spark) == 1


def test_unexpected_failures_are_contained(spark, monkeypatch, tmp_path, capsys):
    def broken(spark, request):
        raise RuntimeError("secret detail")

    monkeypatch.setitem(cli.COMMANDS, "planning", broken)
    path = tmp_path / "in.json"
    path.write_text("{}")
    assert cli.run(["planning", "--input", str(path)], spark) == 4
    assert capsys.readouterr().err == "error internal-error: RuntimeError\n"
