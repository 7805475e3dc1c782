"""Fixed mappings from the driver's tables to the entities of the library, and the same mappings as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.operators import governance


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark, d) -> DataFrame:
    """Documents as index entries; quality labels decide the status."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "proposed").otherwise("superseded")
    return docs.select(
        "doc_id", F.expr("concat('DOC-', doc_id)").alias("artifact_id"), F.expr("concat(lang, '/', source, '/', doc_id, '.md')").alias("path"),
        F.col("lang").alias("kind"), status.alias("status"), F.col("source").alias("owner"),
        F.expr("array(lang, source)").alias("tags"), F.expr("concat('sha256:', sha2(text, 256))").alias("content_digest"),
    )


ENTRIES = """entries AS (
  SELECT d.doc_id, 'DOC-' || d.doc_id AS artifact_id, lang || '/' || source || '/' || d.doc_id || '.md' AS path, lang AS kind,
    CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'proposed' ELSE 'superseded' END AS status, source AS owner,
    [lang, source] AS tags, 'sha256:' || sha256(text) AS content_digest
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""


def relations(spark, d) -> DataFrame:
    """Each document requires the one before it in its source (in runs of 16); a copy derives from the first text."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("t"))
    run = docs.withColumn("before", F.lag("doc_id").over(W.partitionBy("source", F.expr("doc_id div 320")).orderBy("doc_id")))
    chain = run.where("before IS NOT NULL").selectExpr("doc_id", "before AS target", "'requires' AS role")
    first = docs.groupBy("t").agg(F.min("doc_id").alias("target"))
    copies = docs.join(first, "t").where("doc_id <> target").selectExpr("doc_id", "target", "'derives' AS role")
    both = chain.unionByName(copies)
    return both.selectExpr(
        "concat('DOC-', doc_id, '>', role, '>DOC-', target) AS relation_id", "concat('DOC-', doc_id) AS from_artifact_id", "'reference' AS kind",
        "role", "concat('DOC-', target) AS target_artifact_id", "false AS external",
    )


RELATIONS = """rel0 AS (
  SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, doc_id // 320 ORDER BY doc_id) AS target, 'requires' AS role FROM documents
  UNION ALL
  SELECT doc_id, target, 'derives' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS target FROM documents) WHERE doc_id <> target),
relations AS (
  SELECT 'DOC-' || doc_id || '>' || role || '>DOC-' || target AS relation_id, 'DOC-' || doc_id AS from_artifact_id, 'reference' AS kind,
    role, 'DOC-' || target AS target_artifact_id, false AS external FROM rel0 WHERE target IS NOT NULL)"""

ROLE_MAP = [("requires", "normative-dependency"), ("derives", "derivation")]


def role_map(spark, pairs=tuple(ROLE_MAP)) -> DataFrame:
    return spark.createDataFrame(list(pairs), "relation_role string, edge_role string")


def entries_with_relations(spark, d) -> DataFrame:
    own = relations(spark, d).groupBy(F.col("from_artifact_id").alias("artifact_id")).agg(F.collect_list(F.struct("kind", "role", "target_artifact_id")).alias("relations"))
    none = F.array().cast("array<struct<kind:string,role:string,target_artifact_id:string>>")
    return entries(spark, d).join(own, "artifact_id", "left").withColumn("relations", F.coalesce("relations", none))


def part_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """A DAG over part: k div 2 -> k and k div 3 -> k."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("w"))
    nodes = part.select(F.expr("concat('P', k)").alias("id"), F.expr("lpad(cast(k as string), 12, '0')").alias("sort_key"))
    edge = lambda n: part.where(f"k div {n} <> k").selectExpr(f"concat('e{n}-', k) AS id", f"concat(lpad(cast(k as string), 12, '0'), '-{n}') AS sort_key", "'dependency' AS role", f"concat('P', k div {n}) AS src", "concat('P', k) AS dst", "w AS weight")
    return nodes, edge(2).unionByName(edge(3))


PART_GRAPH = """e AS (
  SELECT 'e2-' || p_partkey AS id, p_partkey // 2 AS s, p_partkey AS t, CAST(p_size AS DOUBLE) AS w FROM part WHERE p_partkey // 2 <> p_partkey
  UNION ALL SELECT 'e3-' || p_partkey, p_partkey // 3, p_partkey, CAST(p_size AS DOUBLE) FROM part WHERE p_partkey // 3 <> p_partkey)"""


def tasks(spark, d) -> DataFrame:
    """Parts as tasks that depend on k div 2 and k div 3."""
    deps = "array_distinct(filter(array(k div 2, k div 3), x -> x <> k))"
    return table(spark, d, "part").selectExpr("p_partkey AS k").selectExpr("concat('P', k) AS task_id", f"transform({deps}, x -> concat('P', x)) AS depends_on")


TASKS = """tasks AS (SELECT p_partkey AS k, 'P' || p_partkey AS task_id, list_sort(list_distinct(list_filter([p_partkey // 2, p_partkey // 3],
    lambda x: x <> p_partkey))) AS deps FROM part),
dep AS (SELECT k, task_id, unnest(deps) AS p FROM tasks)"""


def faulty_tasks(spark, d) -> DataFrame:
    """Parts as tasks with planted faults: some on themselves, some on nothing, some stated twice."""
    deps = "CASE k % 10 WHEN 0 THEN array(k) WHEN 1 THEN array(-1L) WHEN 2 THEN array(k div 2, k div 2) ELSE array(k div 2) END"
    return table(spark, d, "part").selectExpr("p_partkey AS k").selectExpr("concat('P', k) AS task_id", f"transform({deps}, x -> concat('P', x)) AS depends_on")


def supplier_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """A graph with cycles over supplier: k -> 2k mod n for every k, k -> k + 1 mod n for k under n / 4."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    s = s.crossJoin(F.broadcast(n))  # one row
    nodes = s.selectExpr("concat('S', k) AS id", "lpad(cast(k as string), 12, '0') AS sort_key")
    edge = lambda name, to, where: s.where(where).selectExpr(f"concat('{name}-', k) AS id", f"concat(lpad(cast(k as string), 12, '0'), '-{name}') AS sort_key", "'link' AS role", "concat('S', k) AS src", f"concat('S', {to}) AS dst", "cast(null as double) AS weight")
    return nodes, edge("d", "2 * k % n", "true").unionByName(edge("n", "(k + 1) % n", "4 * k < n"))


SUPPLIER_GRAPH = """n AS (SELECT count(*) AS n FROM supplier),
g AS (SELECT 'd-' || s_suppkey AS id, s_suppkey AS s, 2 * s_suppkey % n AS t FROM supplier, n
  UNION ALL SELECT 'n-' || s_suppkey, s_suppkey, (s_suppkey + 1) % n FROM supplier, n WHERE 4 * s_suppkey < n)"""


def pair_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """The multigraph of lineitem: part -> supplier, an edge per line."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edges = l.selectExpr("concat(l_orderkey, '-', l_linenumber) AS id", "lpad(cast(l_orderkey as string), 12, '0') AS sort_key", "'line' AS role", "concat('P', l_partkey) AS src", "concat('S', l_suppkey) AS dst", "cast(null as double) AS weight")
    node = lambda t, k, p: table(spark, d, t).selectExpr(f"concat('{p}', {k}) AS id", f"lpad(cast({k} as string), 12, '0') AS sort_key")
    return node("part", "p_partkey", "P").unionByName(node("supplier", "s_suppkey", "S")), edges


def place_tree(spark, d) -> tuple[DataFrame, DataFrame]:
    """region -> nation -> customer -> orders."""
    steps = [("nation", "n_regionkey", "R", "n_nationkey", "N"), ("customer", "c_nationkey", "N", "c_custkey", "C"), ("orders", "o_custkey", "C", "o_orderkey", "O")]
    nodes = table(spark, d, "region").selectExpr("concat('R', r_regionkey) AS id", "'' AS sort_key")
    edges = None
    for name, up, p, key, q in steps:
        t = table(spark, d, name)
        nodes = nodes.unionAll(t.selectExpr(f"concat('{q}', {key}) AS id", "'' AS sort_key"))
        e = t.selectExpr(f"concat('{q}', {key}) AS id", "'' AS sort_key", "'part-of' AS role", f"concat('{p}', {up}) AS src", f"concat('{q}', {key}) AS dst", "cast(null as double) AS weight")
        edges = e if edges is None else edges.unionAll(e)
    return nodes, edges


def ledger(spark, d) -> DataFrame:
    """Conversations as chained ledgers."""
    c = table(spark, d, "conversations").selectExpr("concat('L', conv_id) AS ledger_id", "turn AS pos", "concat('L', conv_id, '/', turn) AS record_id", "concat('sha256:', sha2(text, 256)) AS payload_digest")
    return governance.chained(c)


_RECORD = """'sha256:' || sha256('{"payloadDigest":"' || {p} || '","previousRecordDigest":' || coalesce('"' || {q} || '"', 'null') || ',"recordId":"' || {r} || '"}')"""


def _record(p: str, q: str, r: str) -> str:
    return _RECORD.replace("{p}", p).replace("{q}", q).replace("{r}", r)


LEDGER = f"""entry AS (
  SELECT 'L' || conv_id AS ledger_id, turn AS pos, 'L' || conv_id || '/' || turn AS record_id, 'sha256:' || sha256(text) AS payload_digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
ledger AS (
  SELECT ledger_id, pos, record_id, payload_digest, i, CAST(NULL AS VARCHAR) AS previous_record_digest, {_record('payload_digest', 'NULL', 'record_id')} AS record_digest FROM entry WHERE i = 1
  UNION ALL
  SELECT e.ledger_id, e.pos, e.record_id, e.payload_digest, e.i, l.record_digest, {_record('e.payload_digest', 'l.record_digest', 'e.record_id')}
  FROM ledger l JOIN entry e ON e.ledger_id = l.ledger_id AND e.i = l.i + 1)"""


def tampered(spark, d) -> DataFrame:
    """The ledgers with planted faults: payloads, links, genesis and ids."""
    odd = "cast(substr(ledger_id, 2) as bigint)"
    return ledger(spark, d).selectExpr(
        "ledger_id", "pos", f"CASE WHEN {odd} % 11 = 5 AND pos = 2 THEN concat(ledger_id, '/1') ELSE record_id END AS record_id",
        f"CASE WHEN {odd} % 7 = 0 AND pos = 1 THEN 'sha256:00' ELSE payload_digest END AS payload_digest",
        f"CASE WHEN {odd} % 5 = 2 AND pos = 3 THEN 'sha256:11' WHEN {odd} % 13 = 4 AND pos = 0 THEN 'sha256:22' ELSE previous_record_digest END AS previous_record_digest",
        "record_digest",
    )


TAMPERED = """tampered AS (
  SELECT ledger_id, pos,
    CASE WHEN CAST(substr(ledger_id, 2) AS BIGINT) % 11 = 5 AND pos = 2 THEN ledger_id || '/1' ELSE record_id END AS record_id,
    CASE WHEN CAST(substr(ledger_id, 2) AS BIGINT) % 7 = 0 AND pos = 1 THEN 'sha256:00' ELSE payload_digest END AS payload_digest,
    CASE WHEN CAST(substr(ledger_id, 2) AS BIGINT) % 5 = 2 AND pos = 3 THEN 'sha256:11'
      WHEN CAST(substr(ledger_id, 2) AS BIGINT) % 13 = 4 AND pos = 0 THEN 'sha256:22' ELSE previous_record_digest END AS previous_record_digest,
    record_digest FROM ledger)"""
OWN_DIGEST = _record("payload_digest", "previous_record_digest", "record_id")


def reports(spark, d) -> DataFrame:
    """Events as evidence reports."""
    verdict = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'unresolved' ELSE 'warning' END"
    return table(spark, d, "events").selectExpr("concat('E', event_id) AS report_id", "event_type AS check_id", "user_id % 4 + 1 AS check_revision", "concat('snap-', event_id % 5) AS snapshot_identity", f"{verdict} AS verdict", "value")


REPORTS = """reports AS (
  SELECT 'E' || event_id AS report_id, event_type AS check_id, user_id % 4 + 1 AS check_revision, 'snap-' || event_id % 5 AS snapshot_identity,
    CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'unresolved' ELSE 'warning' END AS verdict, value FROM events)"""
DEFINED = [("click", 1), ("click", 2), ("view", 1), ("purchase", 3), ("error", 1), ("error", 2), ("error", 3), ("signup", 4)]


def registry(spark, d) -> DataFrame:
    """Documents as registry records; the declared sections follow the length, some revisions and statuses are off."""
    return entries(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").selectExpr(
        "artifact_id AS document_id", "CASE WHEN doc_id % 50 = 7 THEN 0L ELSE doc_id % 3 + 1 END AS document_revision",
        "CASE WHEN doc_id % 40 = 3 THEN concat('/', path) ELSE path END AS path", "CASE WHEN doc_id % 60 = 9 THEN 'lost' ELSE status END AS status",
        "CASE WHEN doc_id % 70 = 4 THEN array('scope', 'scope') WHEN n_chars > 2000 THEN array('scope', 'detail') ELSE array('scope') END AS section_ids",
    )


REGISTRY = """registry AS (
  SELECT artifact_id AS document_id, CASE WHEN doc_id % 50 = 7 THEN 0 ELSE doc_id % 3 + 1 END AS document_revision,
    CASE WHEN doc_id % 40 = 3 THEN '/' || path ELSE path END AS path, CASE WHEN doc_id % 60 = 9 THEN 'lost' ELSE status END AS status,
    CASE WHEN doc_id % 70 = 4 THEN ['scope', 'scope'] WHEN n_chars > 2000 THEN ['scope', 'detail'] ELSE ['scope'] END AS section_ids
  FROM entries JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"""


def index_sections(spark, d) -> DataFrame:
    """What an index found in two thirds of the documents; a few have other sections."""
    return table(spark, d, "documents").where("doc_id % 3 <> 1").selectExpr("concat('DOC-', doc_id) AS artifact_id", "CASE WHEN n_chars > 2000 AND doc_id % 10 <> 0 THEN array('scope', 'detail') ELSE array('scope') END AS section_ids")


INDEX = """found AS (SELECT 'DOC-' || doc_id AS artifact_id,
    CASE WHEN n_chars > 2000 AND doc_id % 10 <> 0 THEN ['scope', 'detail'] ELSE ['scope'] END AS section_ids FROM documents WHERE doc_id % 3 <> 1)"""
