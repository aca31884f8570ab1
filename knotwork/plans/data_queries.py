"""Queries of the data problems that belong to the core: p1 to p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import current, history, orphans, shred, treeagg
from knotwork.plans.tables import table
from knotwork.session import spool


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = history.build_history(table(spark, sf_dir, "devicerequest_history"))
    return history.versions(store).select(
        F.col("key").alias("id"), F.col("seq_from").alias("txid_from"), F.col("seq_to").alias("txid_to")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treeagg.heavy_ids(table(spark, sf_dir, "edges")).select("side", "node_id")


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treeagg.edge_profile(table(spark, sf_dir, "edges"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = orphans.orphan_ledger(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))
    return ledger.select(F.col("ref_id").alias("embed_id"), "side").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.snapshot(orphans.orphan_ledger(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")))


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after three batches: all references and the labelled nodes; nodes without label arrive late; nodes
    without attributes are deleted, and the references without a label come again."""
    nodes, edges = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")
    refs = orphans.references(edges)
    state = orphans.advance(orphans.empty_state(spark), refs, orphans.parents(nodes.where("label is not null")))
    state = orphans.advance(
        orphans.OrphanState(spool(state.index), spool(state.ledger), refs), new_parents=orphans.parents(nodes.where("label is null"))
    )
    gone = nodes.where("attributes is null").select(F.col("id").alias("ref"))
    state = orphans.advance(
        orphans.OrphanState(spool(state.index), spool(state.ledger), refs), orphans.references(edges.where("label is null")), deleted=gone
    )
    return orphans.snapshot(state.ledger)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        shred.objects(shred.shred(table(spark, sf_dir, name), name, "id", "resource", values=False))
        for name in ("devicerequest", "fhir_transaction")
    ]
    return parts[0].unionByName(parts[1])


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        shred.shred(table(spark, sf_dir, name), name, "id", "resource") for name in ("devicerequest", "fhir_transaction")
    ]
    rows = parts[0].unionByName(parts[1])
    return rows.groupBy("tbl", "element", "parent_element").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("columns")).alias("n_values")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.apply_changes(None, table(spark, sf_dir, "devicerequest_history")).select("id", "txid")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_profile": p2_profile,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_batches": p3_batches,
    "p4_found": p4_found,
    "p4_tables": p4_tables,
    "p5_found": p5_found,
}

_USABLE = """
WITH known AS (
  SELECT id, txid, ts, resource, lower(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS st
  FROM devicerequest_history WHERE id IS NOT NULL AND txid IS NOT NULL
), usable AS (
  SELECT id, txid, ts, resource, st = 'deleted' AS gone FROM known
  WHERE st = 'deleted' OR (st IN ('created','updated','recreated') AND json_valid(resource) AND json_type(CASE WHEN json_valid(resource) THEN resource END) = 'OBJECT')
  QUALIFY row_number() OVER (PARTITION BY id, txid ORDER BY ts DESC NULLS LAST, resource DESC NULLS LAST, st = 'deleted') = 1
)
"""

_TOPS = """
WITH docs AS (
  SELECT 'devicerequest' AS tbl, id AS record_key, resource FROM devicerequest UNION ALL
  SELECT 'fhir_transaction', id::VARCHAR, resource FROM fhir_transaction
), once AS (
  SELECT tbl, record_key, CASE WHEN json_type(resource) = 'VARCHAR' THEN resource ->> '$' ELSE resource END AS doc
  FROM (SELECT tbl, record_key, CASE WHEN json_valid(resource) THEN resource END AS resource FROM docs) x
), tops AS (SELECT tbl, record_key, doc FROM (SELECT *, CASE WHEN json_valid(doc) THEN doc END AS ok FROM once) x WHERE json_type(ok) = 'OBJECT')
"""

_TREE_PATH = "regexp_replace(replace(t.fullkey, '\"', ''), '^\\$\\.?', '')"

SQL = {
    "p1_found": _USABLE
    + """, content AS (
  SELECT u.id, u.txid, any_value(gone) AS gone, list_sort(list(t.fullkey || '=' || t.type || coalesce(t.atom::VARCHAR, '')) FILTER (
    WHERE NOT gone AND t.fullkey <> '$.meta' AND NOT starts_with(t.fullkey, '$.meta.') AND NOT starts_with(t.fullkey, '$.meta['))) AS body
  FROM (SELECT id, txid, gone, CASE WHEN gone THEN '{}' ELSE resource END AS doc FROM usable) u, json_tree(u.doc) t GROUP BY u.id, u.txid
), steps AS (
  SELECT id, txid, gone, gone OR lag(gone) OVER w IS NULL OR lag(gone) OVER w OR lag(body) OVER w IS DISTINCT FROM body AS point
  FROM content WINDOW w AS (PARTITION BY id ORDER BY txid)
), points AS (SELECT id, txid, gone, lead(txid) OVER (PARTITION BY id ORDER BY txid) AS next FROM steps WHERE point)
SELECT id, txid AS txid_from, coalesce(next, -1) AS txid_to FROM points WHERE NOT gone
""",
    "p4_found": f"""
{_TOPS}
SELECT DISTINCT tbl, record_key, regexp_replace({_TREE_PATH}, '\\.?[^.]+$', '') AS parent_path, {_TREE_PATH} AS path
FROM tops, json_tree(tops.doc) t WHERE t.type = 'OBJECT' AND t.fullkey <> '$'
""",
    "p4_tables": f"""
WITH RECURSIVE {_TOPS.strip().removeprefix("WITH")}, numbered AS (SELECT *, row_number() OVER () AS rid FROM tops),
nodes_of AS (
  SELECT n.tbl, n.rid, {_TREE_PATH} AS path, t.type FROM numbered n, json_tree(n.doc) t
), named AS (
  SELECT *, regexp_replace(path, '(\\[[0-9]+\\])+$', '') AS field, path LIKE '%]' AS repeated FROM nodes_of
), owned AS (
  SELECT *, regexp_extract(field, '[^.]+$') AS element, regexp_replace(field, '\\.?[^.]+$', '') AS parent_path FROM named
), objects AS (
  SELECT o.*, coalesce(nullif(regexp_extract(regexp_replace(parent_path, '(\\[[0-9]+\\])+$', ''), '[^.]+$'), ''), tbl) AS above
  FROM owned o WHERE type = 'OBJECT' AND path <> ''
), tables AS (
  SELECT tbl, element FROM objects GROUP BY 1, 2 HAVING bool_or(repeated) OR count(DISTINCT above) > 1
), marked AS (
  SELECT o.tbl, o.rid, o.path, o.parent_path, o.element, o.repeated OR t.element IS NOT NULL AS own_row
  FROM objects o LEFT JOIN tables t USING (tbl, element)
), climb AS (
  SELECT tbl, rid, path, element, own_row, parent_path AS at FROM marked
  UNION ALL
  SELECT c.tbl, c.rid, c.path, c.element, c.own_row, m.parent_path FROM climb c JOIN marked m ON m.rid = c.rid AND m.path = c.at AND NOT m.own_row
), placed AS (
  SELECT c.tbl, c.rid, c.path, c.element, c.own_row, c.at AS row_path, coalesce(m.element, c.tbl) AS row_element
  FROM climb c LEFT JOIN marked m ON m.rid = c.rid AND m.path = c.at WHERE c.at = '' OR m.own_row
), rows_of AS (
  SELECT tbl, rid, path, element, row_element AS parent_element FROM placed WHERE own_row
  UNION ALL SELECT tbl, rid, '', tbl, NULL FROM numbered
), owner AS (
  SELECT tbl, rid, path, CASE WHEN own_row THEN path ELSE row_path END AS row_path FROM placed
  UNION ALL SELECT tbl, rid, '', '' FROM numbered
), fields AS (
  SELECT tbl, rid, field, any_value(parent_path) AS holder, max(CASE WHEN path = field THEN type END) AS kind,
    count_if(type = 'OBJECT') AS n_objects, count_if(path <> field AND type NOT IN ('OBJECT', 'ARRAY', 'NULL')) AS n_beside
  FROM owned WHERE path <> '' GROUP BY 1, 2, 3
), counted AS (
  SELECT o.rid, o.row_path, sum(CASE WHEN kind = 'OBJECT' THEN 0 WHEN kind <> 'ARRAY' THEN 1 WHEN n_objects > 0 THEN n_beside ELSE 1 END) AS n
  FROM fields f JOIN owner o ON o.rid = f.rid AND o.path = f.holder GROUP BY 1, 2
)
SELECT r.tbl, r.element, r.parent_element, count(*) AS n_rows, sum(coalesce(c.n, 0))::BIGINT AS n_values
FROM rows_of r LEFT JOIN counted c ON c.rid = r.rid AND c.row_path = r.path GROUP BY 1, 2, 3
""",
    "p2_found": """
SELECT side, node_id FROM (
  SELECT 'source' AS side, source AS node_id FROM edges UNION ALL SELECT 'target', target FROM edges) x
WHERE node_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM edges)
""",
    "p2_profile": """
SELECT side, node_id, label, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_edges,
       min(created_at) AS first_at, max(created_at) AS last_at
FROM (SELECT 'source' AS side, source AS node_id, label, created_at FROM edges
      UNION ALL SELECT 'target', target, label, created_at FROM edges) x
WHERE node_id IS NOT NULL GROUP BY 1, 2, 3, 4
""",
    "p3_found": """
SELECT DISTINCT embed_id, side FROM (
  SELECT embed_id, 'source' AS side, source AS ref, created_at FROM edges
  UNION ALL SELECT embed_id, 'target', target, created_at FROM edges) e
WHERE ref IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM nodes n WHERE n.id = e.ref
  AND (n.created_at IS NULL OR e.created_at IS NULL OR n.created_at <= e.created_at))
""",
    "p3_report": """
WITH refs AS (
  SELECT DISTINCT embed_id, side, ref, created_at AS made FROM (
    SELECT embed_id, 'source' AS side, source AS ref, created_at FROM edges
    UNION ALL SELECT embed_id, 'target', target, created_at FROM edges) e WHERE ref IS NOT NULL),
idx AS (SELECT id, min(created_at) AS first_at, bool_or(created_at IS NULL) AS untimed FROM nodes WHERE id IS NOT NULL GROUP BY id),
led AS (
  SELECT side, strftime(made AT TIME ZONE 'UTC', '%Y-%m') AS month, idx.id IS NULL AS waiting,
         strftime(first_at AT TIME ZONE 'UTC', '%Y-%m') AS came
  FROM refs LEFT JOIN idx ON idx.id = ref WHERE idx.id IS NULL OR (NOT untimed AND first_at > made))
SELECT 'edges' AS tbl, side, month, count(*) AS orphans, count_if(waiting) AS waiting, count_if(NOT waiting) AS resolved,
       count_if(NOT waiting AND came = month) AS resolved_in_month
FROM led GROUP BY 1, 2, 3
""",
    "p3_batches": """
WITH refs AS (
  SELECT DISTINCT embed_id, side, ref, created_at AS made FROM (
    SELECT embed_id, 'source' AS side, source AS ref, created_at FROM edges
    UNION ALL SELECT embed_id, 'target', target, created_at FROM edges) e WHERE ref IS NOT NULL),
one AS (SELECT id, min(created_at) AS first_at, bool_or(created_at IS NULL) AS untimed FROM nodes WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY id),
two AS (SELECT id, min(created_at) AS first_at, bool_or(created_at IS NULL) AS untimed FROM nodes WHERE id IS NOT NULL AND label IS NULL GROUP BY id),
gone AS (SELECT DISTINCT id FROM nodes WHERE attributes IS NULL AND id IS NOT NULL),
led AS (
  SELECT side, made, gone.id IS NOT NULL AS deleted, gone.id IS NOT NULL OR (one.id IS NULL AND two.id IS NULL) AS waiting,
    CASE WHEN two.untimed THEN NULL WHEN one.id IS NULL THEN two.first_at ELSE least(one.first_at, two.first_at) END AS came
  FROM refs LEFT JOIN one ON one.id = ref LEFT JOIN two ON two.id = ref LEFT JOIN gone ON gone.id = ref
  WHERE gone.id IS NOT NULL OR one.id IS NULL OR (NOT one.untimed AND one.first_at > made))
SELECT 'edges' AS tbl, side, strftime(made AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans, count_if(waiting) AS waiting,
       count_if(NOT waiting) AS resolved,
       count_if(NOT waiting AND strftime(came AT TIME ZONE 'UTC', '%Y-%m') = strftime(made AT TIME ZONE 'UTC', '%Y-%m')) AS resolved_in_month
FROM led GROUP BY 1, 2, 3
""",
    "p5_found": _USABLE
    + """
SELECT id, txid FROM (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY id ORDER BY txid DESC) = 1) x WHERE NOT gone
""",
}
