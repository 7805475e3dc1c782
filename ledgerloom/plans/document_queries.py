"""Queries of the document index, with their SQL.

The driver's documents hold no Markdown, so each is wrapped: a marker, a title, its text in a code fence, two headings
of one name, a list and a quote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import docindex as X
from ledgerloom.plans import adapters as A

Q, SQL = {}, {}
NAMESPACE = "docs"


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def sources(spark, d):
    marker = f"""concat('<!-- {NAMESPACE}:section id="s-', source, '" -->\\n')"""
    tail = """CASE doc_id % 5 WHEN 0 THEN concat('<!-- docs:section id="s-', source, '" -->\\n## Again\\n') WHEN 1 THEN '<!-- docs:section id="lost" -->\\n\\nText.\\n' ELSE '* one\\n* two\\n\\n> quoted\\n' END"""
    content = f"concat({marker}, '# Doc *', doc_id, '* of `', source, '`\\n\\n~~~~\\n', text, '\\n~~~~\\n\\nDetails\\n---\\n\\n## Details\\n\\n', {tail})"
    rows = A.table(spark, d, "documents").withColumn("content", F.expr(content))
    return rows.selectExpr(
        "doc_id", "concat('DOC-', doc_id) AS artifact_id", "concat(lang, '/', doc_id, '.md') AS path", "'1' AS version", "content",
        "CASE WHEN doc_id % 31 = 4 THEN 'sha256:old' ELSE concat('sha256:', sha2(content, 256)) END AS content_digest", "cast(null as string) AS blob_sha",
        "lang AS kind", "'active' AS status", "source AS owner", "CASE WHEN doc_id % 41 = 2 THEN array(lang, lang) ELSE array(source, lang) END AS tags",
        """CASE WHEN doc_id % 10 = 1 THEN array(named_struct('kind', 'reference', 'role', 'requires', 'target', named_struct('artifact_id', concat('DOC-', doc_id - 1), 'revision', 1L, 'external', false)),
             named_struct('kind', 'reference', 'role', 'requires', 'target', named_struct('artifact_id', concat('DOC-', doc_id - 1), 'revision', 1L, 'external', false)))
           WHEN doc_id % 10 = 2 THEN array(named_struct('kind', 'traceability', 'role', cast(null as string), 'target', named_struct('artifact_id', 'DOC-none', 'revision', cast(null as bigint), 'external', false)))
           WHEN doc_id % 10 = 3 THEN array(named_struct('kind', 'reference', 'role', 'history', 'target', named_struct('artifact_id', 'DOC-0', 'revision', cast(null as bigint), 'external', true)))
           ELSE array() END AS references""",
    )


@query("X01_source_findings", """SELECT 'invalid-field' AS code, 'DOC-' || doc_id || '.tags' AS subject, 'input' AS cls FROM documents WHERE doc_id % 41 = 2
UNION ALL SELECT 'content-digest-mismatch', 'DOC-' || doc_id, 'input' FROM documents WHERE doc_id % 31 = 4""")
def x01(spark, d):
    return X.source_findings(sources(spark, d))


_KINDS = """SELECT doc_id, 'html' AS t FROM documents UNION ALL SELECT doc_id, 'heading' FROM documents UNION ALL SELECT doc_id, 'code' FROM documents
  UNION ALL SELECT doc_id, 'heading' FROM documents UNION ALL SELECT doc_id, 'heading' FROM documents
  UNION ALL SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['html', 'heading'] WHEN 1 THEN ['html', 'paragraph'] ELSE ['list', 'blockquote'] END) FROM documents"""


@query("X06_blocks", f"SELECT 'DOC-' || doc_id AS artifact_id, t AS kind, count(*) AS n FROM ({_KINDS}) GROUP BY ALL")
def x06(spark, d):
    found = X.blocks(sources(spark, d))
    return found.groupBy("artifact_id", F.coalesce("block_kind", "type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("X08_headings", """WITH h AS (
  SELECT doc_id, 1 AS ordinal, 1 AS depth, 'Doc ' || doc_id || ' of ' || source AS text, 'doc-' || doc_id || '-of-' || source AS anchor FROM documents
  UNION ALL SELECT doc_id, 2, 2, 'Details', 'details' FROM documents UNION ALL SELECT doc_id, 3, 2, 'Details', 'details-2' FROM documents
  UNION ALL SELECT doc_id, 4, 2, 'Again', 'again' FROM documents WHERE doc_id % 5 = 0)
SELECT 'DOC-' || doc_id AS artifact_id, CAST(ordinal AS BIGINT) AS ordinal, 'DOC-' || doc_id || '#h' || ordinal AS heading_id, CAST(depth AS BIGINT) AS depth, text, anchor FROM h""")
def x08(spark, d):
    return X.headings(X.blocks(sources(spark, d))).select("artifact_id", "ordinal", "heading_id", "depth", "text", "anchor")


@query("X09_anchors", "SELECT * FROM (VALUES (0, 'details'), (1, 'details-2'), (2, 'details-3')) v(pos, anchor)")
def x09(spark, d):
    return spark.createDataFrame(list(enumerate(X.disambiguated(["details", "details-2", "details"]))), "pos int, anchor string")


@query("X10_sections", "SELECT 'DOC-' || doc_id AS artifact_id, CAST(0 AS BIGINT) AS pos, 's-' || source AS section_id FROM documents")
def x10(spark, d):
    return X.sections(X.blocks(sources(spark, d)), NAMESPACE)[0]


@query("X10_section_findings", """SELECT 'duplicate-section-id' AS code, 'DOC-' || doc_id || ':s-' || source AS subject, 'input' AS cls FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'marker-not-followed-by-heading', 'DOC-' || doc_id || ':lost', 'input' FROM documents WHERE doc_id % 5 = 1""")
def x10b(spark, d):
    return X.sections(X.blocks(sources(spark, d)), NAMESPACE)[1]


@query("X11_relation_findings", """SELECT 'duplicate-relation' AS code, 'DOC-' || doc_id || '.references[0]' AS subject, 'input' AS cls FROM documents WHERE doc_id % 10 = 1
UNION ALL SELECT 'unresolved-relation-target', 'DOC-' || doc_id || '.references[0]', 'input' FROM documents WHERE doc_id % 10 = 2
UNION ALL SELECT 'external-target-contradiction', 'DOC-' || doc_id || '.references[0]', 'input' FROM documents WHERE doc_id % 10 = 3""")
def x11(spark, d):
    return X.resolved_relations(sources(spark, d))[1]


@query("X12_duplicate_sources", """SELECT 'duplicate-artifact-id' AS code, 'DOC-' || doc_id // 2 AS subject, 'input' AS cls FROM documents GROUP BY doc_id // 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate-path', lang, 'input' FROM documents GROUP BY lang HAVING count(*) > 1""")
def x12(spark, d):
    rows = sources(spark, d).withColumn("artifact_id", F.expr("concat('DOC-', doc_id div 2)")).withColumn("path", F.col("kind"))
    return X.resolved_relations(rows.withColumn("references", F.slice("references", 1, 0)))[1]


@query("X13_relations", """WITH r AS (SELECT 'DOC-' || doc_id AS f, CASE doc_id % 10 WHEN 2 THEN 'traceability' ELSE 'reference' END AS k, CASE doc_id % 10 WHEN 1 THEN '1' ELSE 'null' END AS v,
  CASE doc_id % 10 WHEN 1 THEN '"requires"' WHEN 2 THEN 'null' ELSE '"history"' END AS o, CASE doc_id % 10 WHEN 1 THEN 'DOC-' || (doc_id - 1) WHEN 2 THEN 'DOC-none' ELSE 'DOC-0' END AS t FROM documents WHERE doc_id % 10 IN (1, 2, 3))
SELECT '{"from":"' || f || '","kind":"' || k || '","revision":' || v || ',"role":' || o || ',"to":"' || t || '"}' AS relation_id, f AS from_artifact_id, t AS target_artifact_id FROM r""")
def x13(spark, d):
    return X.resolved_relations(sources(spark, d))[0].select("relation_id", "from_artifact_id", "target_artifact_id")


_CONTENT = """'<!-- docs:section id="s-' || source || '" -->' || chr(10) || '# Doc *' || doc_id || '* of `' || source || '`' || chr(10) || chr(10) || '~~~~' || chr(10) || text || chr(10) || '~~~~' || chr(10) || chr(10)
    || 'Details' || chr(10) || '---' || chr(10) || chr(10) || '## Details' || chr(10) || chr(10) || CASE doc_id % 5 WHEN 0 THEN '<!-- docs:section id="s-' || source || '" -->' || chr(10) || '## Again' || chr(10)
    WHEN 1 THEN '<!-- docs:section id="lost" -->' || chr(10) || chr(10) || 'Text.' || chr(10) ELSE '* one' || chr(10) || '* two' || chr(10) || chr(10) || '> quoted' || chr(10) END"""
_HEAD = """'{{"anchor":"{0}","depth":{1},"headingId":"DOC-' || doc_id || '#h{2}","text":"{3}"}}'"""
_ENTRY = f"""WITH c AS (SELECT *, CASE WHEN doc_id % 31 = 4 THEN 'sha256:old' ELSE 'sha256:' || sha256({_CONTENT}) END AS cd,
  {_HEAD.format("doc-' || doc_id || '-of-' || source || '", 1, 1, "Doc ' || doc_id || ' of ' || source || '")} || ',' || {_HEAD.format("details", 2, 2, "Details")} || ',' || {_HEAD.format("details-2", 2, 3, "Details")}
  || CASE WHEN doc_id % 5 = 0 THEN ',' || {_HEAD.format("again", 2, 4, "Again")} ELSE '' END AS heads,
  '"' || array_to_string(list_sort(CASE WHEN doc_id % 41 = 2 THEN [lang, lang] ELSE [source, lang] END), '","') || '"' AS tags FROM documents),
x AS (SELECT 'DOC-' || doc_id AS artifact_id, 'sha256:' || sha256('{{"artifactId":"DOC-' || doc_id || '","contentDigest":"' || cd || '","headings":[' || heads || '],"kind":"' || lang || '","owner":"' || source
  || '","path":"' || lang || '/' || doc_id || '.md","sections":["s-' || source || '"],"status":"active","tags":[' || tags || ']}}') AS entry_digest, doc_id, source FROM c)"""


@query("X16_entry_digests", f"{_ENTRY} SELECT artifact_id, entry_digest, CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 3 END AS n_headings, 's-' || source AS sections FROM x")
def x16(spark, d):
    return X.index_entries(sources(spark, d), NAMESPACE).select("artifact_id", "entry_digest", F.size("headings").alias("n_headings"), F.array_join("sections", ",").alias("sections"))


@query("X16_index_digest", f"{_ENTRY} SELECT 'sha256:' || sha256('{{\"entries\":[' || string_agg('\"' || entry_digest || '\"', ',' ORDER BY artifact_id) || ']}}') AS index_digest FROM x")
def x16b(spark, d):
    return X.index_digest(X.index_entries(sources(spark, d), NAMESPACE))


@query("X19_cache_findings", "SELECT DISTINCT 'cache-entry-corrupt' AS code, content_digest AS subject, 'input' AS cls FROM (SELECT 'sha256:' || sha256(text) AS content_digest, doc_id FROM documents) WHERE substr(content_digest, 8, 1) IN ('0', '1')")
def x19(spark, d):
    rows = A.table(spark, d, "documents").selectExpr("text AS content", "concat('sha256:', sha2(text, 256)) AS content_digest")
    fresh = X.cache_entries(rows, "blocks", 1)
    head = F.substring("content_digest", 8, 1)
    torn = fresh.withColumn("value_json", F.when(head == "0", "[]").otherwise(F.col("value_json")))
    return X.cache_findings(torn.withColumn("derivation_digest", F.when(head == "1", "sha256:no").otherwise(F.col("derivation_digest"))), fresh)
