"""The structural index of Markdown documents.

Sources: ``artifact_id, path, version, content, content_digest, blob_sha, kind, status, owner, tags array<string>,
references array<struct<kind, role, target struct<artifact_id, revision, external>>>``.  Documents become block rows by
one Arrow pass; headings, anchors, sections and relations follow by windows and joins.  One document is one row
throughout, so the work scales with the number of documents; only what a document holds is collected, per document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ledgerloom.functions import kernel as K
from ledgerloom.functions.markdown import parse_blocks
from ledgerloom.operators.findings import every, rule

#: The default budgets of an index.
BUDGETS = {"documents": 10_000, "codeUnits": 2_000_000, "astNodes": 500_000, "relations": 1_000, "headingUnits": 2_000}
_SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("start_line", "start_column", "start_offset", "end_line", "end_column", "end_offset")])
_BLOCK = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("type", T.StringType()), T.StructField("block_kind", T.StringType()),
    T.StructField("depth", T.LongType()), T.StructField("text", T.StringType()), T.StructField("value", T.StringType()), T.StructField("span", _SPAN),
])


@F.pandas_udf(T.ArrayType(_BLOCK))
def block_column(contents: pd.Series) -> pd.Series:
    def rows(content):
        return [
            {"pos": i, "type": b.type, "block_kind": b.kind, "depth": b.depth, "text": b.text, "value": b.value, "span": dict(zip(_SPAN.names, b.span))}
            for i, b in enumerate(parse_blocks(content if isinstance(content, str) else ""))
        ]

    return pd.Series([rows(c) for c in contents])


def code_units(text) -> F.Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def source_findings(sources: DataFrame, budgets: dict = BUDGETS) -> DataFrame:
    """Shape, tags, relations, budgets and digests of the sources."""
    empty = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("artifact_id", "version", "kind", "status", "owner")], F.when(~K.is_normal_path(F.col("path")), "path"), F.when(F.col("content").isNull(), "content"))
    fields = sources.select("artifact_id", F.explode(F.filter(empty, lambda x: x.isNotNull())).alias("f"))
    tags = sources.where(F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull() | (t == "")) | (F.size(F.array_distinct("tags")) != F.size("tags")))
    refs = sources.select("artifact_id", F.posexplode("references").alias("pos", "r"))
    wrong = ~F.coalesce(F.col("r.kind").isin("reference", "traceability"), F.lit(False)) | ((F.col("r.kind") != "reference") & F.col("r.role").isNotNull()) | (F.coalesce("r.target.artifact_id", F.lit("")) == "") | (F.coalesce("r.target.revision", F.lit(1)) <= 0)
    over = sources.where((code_units(F.col("content")) > budgets["codeUnits"]) | (F.size("references") > budgets["relations"]))
    digest = sources.where(~F.col("content_digest").eqNullSafe(K.digest(F.col("content"))))
    at = F.concat("artifact_id", F.lit(".references["), "pos", F.lit("]"))
    return every(
        rule(fields, "invalid-field", "concat(artifact_id, '.', f)"), rule(tags, "invalid-field", "concat(artifact_id, '.tags')"),
        rule(refs.where(wrong), "invalid-field", at), rule(over, "budget-exhausted", "artifact_id"), rule(digest, "content-digest-mismatch", "artifact_id"),
    )


def budgets_sound(budgets: dict) -> bool:
    return set(budgets) == set(BUDGETS) and all(isinstance(v, int) and not isinstance(v, bool) and v > 0 for v in budgets.values())


def blocks(sources: DataFrame) -> DataFrame:
    """``artifact_id, pos, type, block_kind, depth, text, value, span``: the root blocks of every document."""
    return sources.select("artifact_id", F.inline(block_column("content")))


def block_findings(found: DataFrame, budgets: dict = BUDGETS) -> DataFrame:
    many = found.groupBy("artifact_id").count().where(F.col("count") > budgets["astNodes"])
    long = found.where((F.col("type") == "heading") & (code_units(F.col("text")) > budgets["headingUnits"]))
    return every(rule(many, "budget-exhausted", "artifact_id"), rule(long, "budget-exhausted", "artifact_id"))


def disambiguated(bases: list[str]) -> list[str]:
    """Anchors of a document's slugs in order: a repeated slug counts on until no earlier anchor has its name."""
    given, times, out = set(), {}, []
    for base in bases:
        times[base] = times.get(base, 0) + 1
        k = times[base]
        name = base if k == 1 else f"{base}-{k}"
        while name in given:
            k += 1
            name = f"{base}-{k}"
        given.add(name)
        out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchor_column(bases: pd.Series) -> pd.Series:
    return pd.Series([disambiguated(list(b)) for b in bases])


def headings(found: DataFrame) -> DataFrame:
    """``artifact_id, pos, ordinal, heading_id, depth, text, anchor, span``; ordinals follow the document from 1."""
    rows = found.where("type = 'heading'").withColumn("base", K.anchor_base(F.col("text")))
    docs = rows.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("pos", "depth", "text", "base", "span"))).alias("h"))
    named = docs.select("artifact_id", "h", anchor_column(F.transform("h", lambda x: x["base"])).alias("anchors"))
    out = named.select("artifact_id", F.posexplode(F.arrays_zip("h", "anchors")).alias("i", "x"))
    return out.select(
        "artifact_id", "x.h.pos", (F.col("i") + 1).cast("long").alias("ordinal"), F.concat("artifact_id", F.lit("#h"), F.col("i") + 1).alias("heading_id"),
        "x.h.depth", "x.h.text", F.col("x.anchors").alias("anchor"), "x.h.span",
    )


def sections(found: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(``artifact_id, pos, section_id``, findings): a marker binds the heading block right behind it, an id once."""
    ahead = W.partitionBy("artifact_id").orderBy("pos")
    marked = found.withColumn("next", F.lead("type").over(ahead)).withColumn("section_id", F.when(F.col("type") == "html", K.section_of_marker(F.col("value"), namespace))).where("section_id IS NOT NULL")
    good = marked.where("next = 'heading'").withColumn("nth", F.row_number().over(W.partitionBy("artifact_id", "section_id").orderBy("pos")))
    subject = "concat(artifact_id, ':', section_id)"
    return good.where("nth = 1").select("artifact_id", "pos", "section_id"), every(
        rule(marked.where("next IS NULL OR next <> 'heading'"), "marker-not-followed-by-heading", subject),
        rule(good.where("nth > 1"), "duplicate-section-id", subject),
    )


def relation_id(source, kind, revision, role, target):
    return K.canonical_struct({"from": source, "kind": kind, "revision": revision, "role": role, "to": target})


def relations(sources: DataFrame) -> DataFrame:
    """``relation_id, artifact_id, pos, kind, role, target_artifact_id, revision, external`` as declared."""
    rows = sources.select("artifact_id", F.posexplode("references").alias("pos", "r"))
    rid = relation_id(F.col("artifact_id"), F.col("r.kind"), F.col("r.target.revision"), F.col("r.role"), F.col("r.target.artifact_id"))
    return rows.select(rid.alias("relation_id"), "artifact_id", "pos", "r.kind", "r.role", F.col("r.target.artifact_id").alias("target_artifact_id"), "r.target.revision", F.coalesce("r.target.external", F.lit(False)).alias("external"))


def resolved_relations(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations in order, findings).  An id that two sources share leaves the universe of targets entirely."""
    ids = sources.groupBy("artifact_id").count()
    universe = ids.where("count = 1").select(F.col("artifact_id").alias("target_artifact_id"))
    rows = relations(sources)
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("relation_id").orderBy("artifact_id", "pos"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("relation_id")))
    at = F.concat("artifact_id", F.lit(".references["), "pos", F.lit("]"))
    found = every(
        rule(ids.where("count > 1"), "duplicate-artifact-id", "artifact_id"),
        rule(sources.groupBy("path").count().where("count > 1"), "duplicate-path", "path"),
        rule(first.where("nth = 1 AND n > 1"), "duplicate-relation", at),
        rule(first.where("nth = 1 AND NOT external").join(universe, "target_artifact_id", "left_anti"), "unresolved-relation-target", at),
        rule(first.where("nth = 1 AND external").join(universe, "target_artifact_id", "left_semi"), "external-target-contradiction", at),
    )
    kept = first.where("nth = 1").select("relation_id", F.col("artifact_id").alias("from_artifact_id"), "kind", "role", "target_artifact_id", "revision", "external")
    return kept.orderBy("relation_id"), found


def snapshot(sources: DataFrame) -> DataFrame:
    return sources.withColumn("tags", F.array_sort("tags"))


def index_entries(sources: DataFrame, namespace: str) -> DataFrame:
    """``artifact_id, path, kind, status, owner, tags, content_digest, headings, sections, entry_digest``."""
    found = blocks(sources)
    heads = headings(found).groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading_id", "depth", "text", "anchor"))).alias("headings"))
    bound = sections(found, namespace)[0].groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section_id"))), lambda x: x["section_id"]).alias("sections"))
    rows = snapshot(sources).select("artifact_id", "path", "kind", "status", "owner", "tags", "content_digest")
    rows = rows.join(heads, "artifact_id", "left").join(bound, "artifact_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
    parts = F.transform(F.coalesce("headings", F.array().cast("array<struct<ordinal:bigint,heading_id:string,depth:bigint,text:string,anchor:string>>")), lambda h: F.struct(h["anchor"].alias("anchor"), h["depth"].alias("depth"), h["heading_id"].alias("headingId"), h["text"].alias("text")))
    body = K.canonical_struct({
        "artifactId": F.col("artifact_id"), "contentDigest": F.col("content_digest"), "headings": parts, "kind": F.col("kind"), "owner": F.col("owner"),
        "path": F.col("path"), "sections": F.col("sections"), "status": F.col("status"), "tags": F.col("tags"),
    })
    return rows.withColumn("entry_digest", K.digest(body))


def index_digest(entries: DataFrame) -> DataFrame:
    """One row: the digest over all entry digests in the order of their ids; admission bounds the number of documents."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("artifact_id", "entry_digest"))), lambda x: F.concat(F.lit('"'), x["entry_digest"], F.lit('"'))), ",")
    return entries.agg(K.digest(F.concat(F.lit('{"entries":['), body, F.lit("]}"))).alias("index_digest"))


def build_index(sources: DataFrame, namespace: str, budgets: dict = BUDGETS):
    """(entries or None, relations or None, findings): any finding voids the whole index."""
    if not budgets_sound(budgets):
        raise ValueError("budget-exhausted: budgets")
    kept, related = resolved_relations(sources)
    found = blocks(sources)
    findings = every(source_findings(sources, budgets), block_findings(found, budgets), sections(found, namespace)[1], related)
    if sources.count() > budgets["documents"]:
        findings = findings.unionByName(rule(sources.limit(1), "budget-exhausted", F.lit("documents")))
    if not findings.isEmpty():
        return None, None, findings
    return index_entries(sources, namespace), kept, findings


# ---- cache ------------------------------------------------------------------------------------------------------


def cache_entries(sources: DataFrame, compiler_id: str, compiler_revision: int) -> DataFrame:
    """``content_digest, compiler_id, compiler_revision, value_json, derivation_digest``, once per content."""
    once = sources.dropDuplicates(["content_digest"]).select("content_digest", F.to_json(block_column("content")).alias("value_json"))
    return once.select("content_digest", F.lit(compiler_id).alias("compiler_id"), F.lit(compiler_revision).alias("compiler_revision"), "value_json", K.digest(F.col("value_json")).alias("derivation_digest"))


def cache_findings(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """A cache is only ever verified: its keys, its own digests, and its values against fresh work."""
    keys = ["content_digest", "compiler_id", "compiler_revision"]
    bad = cache.where(~F.coalesce(F.col("content_digest").rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False)) | (F.col("compiler_revision") <= 0))
    torn = cache.where(~F.col("derivation_digest").eqNullSafe(K.digest(F.col("value_json"))))
    other = cache.alias("c").join(fresh.alias("f"), keys).where(~F.col("c.value_json").eqNullSafe(F.col("f.value_json"))).select("content_digest")
    return every(rule(bad, "invalid-cache-key", "content_digest"), rule(torn, "cache-entry-corrupt", "content_digest"), rule(other, "cache-entry-corrupt", "content_digest")).distinct()


def compiler_sound(identity) -> bool:
    return isinstance(identity, dict) and set(identity) == {"compilerId", "compilerRevision"} and isinstance(identity["compilerId"], str) and bool(re.fullmatch(r"\S+", identity["compilerId"])) and isinstance(identity["compilerRevision"], int) and identity["compilerRevision"] > 0
