"""Queries of lookups, collections, drawings and merges over the stored tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import jsonschema
from knotwork.operators import collection, current, export, lookup, mutate, ontology, retrieve, traverse, vector
from knotwork.plans import graph_view as gv
from knotwork.plans.data_queries import _TOPS, _USABLE
from knotwork.plans.graph_queries import _CUST, _DIST, _TYPES, _customers, _knn_sql, _vector_of, _vectors
from knotwork.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return add


_OUTER = r"lower(regexp_replace(status, '^\s+|\s+$', '', 'g'))"


@query(
    _USABLE
    + f""", base AS (
  SELECT id, txid, ts, resource FROM devicerequest WHERE id IS NOT NULL AND {_OUTER} <> 'deleted'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY txid DESC NULLS LAST, ts DESC NULLS LAST, resource DESC NULLS LAST) = 1
), last AS (SELECT id, txid, gone FROM usable QUALIFY row_number() OVER (PARTITION BY id ORDER BY txid DESC) = 1),
merged AS (
  SELECT id, txid, false AS gone, 0 AS side FROM base UNION ALL SELECT id, txid, gone, 1 FROM last
)
SELECT id, txid FROM (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY id ORDER BY txid DESC NULLS LAST, side DESC) = 1) x WHERE NOT gone
"""
)
def p5_merge(spark, d):
    """The feed applied to the store's own current rows."""
    order = (F.col("txid").desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("resource").desc_nulls_last())
    from knotwork.operators.changefeed import status_of
    from knotwork.operators.mutate import keep_one

    stored = table(spark, d, "devicerequest").where(F.col("id").isNotNull() & (status_of("status") != "deleted"))
    base = keep_one(stored, ["id"], *order)
    return current.apply_changes(base, table(spark, d, "devicerequest_history")).select("id", "txid")


_FIRST = "(SELECT source_id, source_type, target_id, target_type, resource FROM relations WHERE target_id IS NOT NULL AND json_valid(resource) ORDER BY embed_id LIMIT 1)"


@query(
    f"""SELECT min(r.embed_id) AS embed_id FROM relations r, {_FIRST} f WHERE r.source_id = f.source_id AND r.source_type = f.source_type
AND r.target_id = f.target_id AND r.target_type = f.target_type AND json_valid(r.resource) AND json(r.resource)::VARCHAR = json(f.resource)::VARCHAR"""
)
def relation_lookup(spark, d):
    relations = table(spark, d, "relations")
    valid = F.try_parse_json("resource").isNotNull()
    first = relations.where(F.col("target_id").isNotNull() & valid).orderBy("embed_id").first()
    return lookup.relation(relations, (first.source_id, first.source_type), (first.target_id, first.target_type), first.resource)


@query("SELECT name, name IN (SELECT resource_type FROM devicerequest) AS present FROM (VALUES ('DeviceRequest'), ('Patient'), ('no such type')) t(name)")
def resource_type_present(spark, d):
    own = table(spark, d, "devicerequest")
    names = ["DeviceRequest", "Patient", "no such type"]
    return spark.createDataFrame([(n, lookup.resource_type_exists(own, n)) for n in names], "name string, present boolean")


@query("""SELECT embed_id FROM relations WHERE source_id = (SELECT min(source_id) FROM relations) OR target_id = (SELECT min(source_id) FROM relations)
ORDER BY embed_id LIMIT 10""")  # fmt: skip
def resource_embed_ids(spark, d):
    relations = table(spark, d, "relations")
    return lookup.relation_embed_ids(relations, relations.agg(F.min("source_id")).first()[0])


@query(
    gv.sql(
        "SELECT id, min(hop) AS hop FROM walk WHERE hop <= (SELECT min(hop) FROM walk WHERE id = 'p9') GROUP BY id",
        """walk(id, hop) AS (SELECT id, 0 FROM gn WHERE id = 'r1' UNION SELECT target, hop + 1 FROM walk JOIN ge ON source = walk.id WHERE hop < 6)""",
    )
)
def traverse_stop_at(spark, d):
    return traverse.reachable(gv.nodes(spark, d), gv.edges(spark, d), "r1", stop_at="p9")


@query(
    gv.sql(
        """SELECT step, id FROM (SELECT len(p) - 1 - i AS step, p[i + 1] AS id FROM back, range(0, 7) t(i) WHERE p[len(p)] = 'r1' AND i < len(p)) x""",
        """walk(id, hop) AS (SELECT 'r1', 0 UNION SELECT target, hop + 1 FROM walk JOIN ge ON source = walk.id WHERE hop < 6)""",
        "least AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id)",
        "via AS (SELECT a.id, min(ge.source) AS before FROM least a JOIN ge ON ge.target = a.id JOIN least b ON b.id = ge.source AND b.hop = a.hop - 1 GROUP BY 1)",
        "back(p) AS (SELECT ['p9'] UNION ALL SELECT list_append(p, before) FROM back JOIN via ON via.id = p[len(p)])",
    )
)
def shortest_path_nodes(spark, d):
    return traverse.shortest_path(gv.edges(spark, d), "r1", "p9")


@query("SELECT embed_id, source, target, label FROM edges WHERE embed_id IN (SELECT embed_id FROM (SELECT DISTINCT embed_id FROM edges ORDER BY 1 LIMIT 40) x)")
def fetch_edges_by_embed_ids(spark, d):
    edges = table(spark, d, "edges")
    ids = [r.embed_id for r in edges.select("embed_id").where("embed_id is not null").distinct().orderBy("embed_id").limit(40).collect()]
    return vector.fetch_by_embed_ids(edges, ids).select("embed_id", "source", "target", "label")


_RESOURCE_VECTORS = """rv AS (SELECT DISTINCT r.resource_type, r.embed_id, n.vector_node AS v FROM devicerequest r JOIN nodes_embedding n USING (embed_id)
WHERE len(n.vector_node) = 64 AND NOT list_contains(list_transform(n.vector_node, lambda x: x IS NULL OR isnan(x)), true) AND r.resource_type = 'DeviceRequest'),
q AS (SELECT v FROM rv ORDER BY embed_id LIMIT 1)"""


@query(
    f"""WITH {_RESOURCE_VECTORS}, top AS (SELECT embed_id, {_DIST.format(a="rv.v", b="q.v")} AS distance FROM rv, q ORDER BY distance, embed_id LIMIT 8)
SELECT DISTINCT top.embed_id, r.id, round(distance, 9) AS distance FROM top JOIN devicerequest r USING (embed_id) WHERE r.resource_type = 'DeviceRequest'"""
)
def knn_resources(spark, d):
    """Resources with the node vectors of the same number, searched within one type."""
    own = table(spark, d, "devicerequest")
    sound = table(spark, d, "nodes_embedding").where((F.size("vector_node") == 64) & ~F.exists("vector_node", lambda v: v.isNull() | F.isnan(v)))
    vectors = own.join(sound, "embed_id").select("resource_type", "embed_id", F.col("vector_node").alias("vector")).distinct()
    first = vectors.where("resource_type = 'DeviceRequest'").orderBy("embed_id").first()
    hits = vector.search_resources(own, vectors, [float(x) for x in first["vector"]], "DeviceRequest", 8, None)
    return hits.select("embed_id", "id", F.round("distance", 9).alias("distance")).distinct()


_MIXED = """mixed AS (
  SELECT 'node' AS kind, embed_id, label, v FROM (SELECT DISTINCT embed_id, label FROM nodes) n JOIN (
    SELECT DISTINCT embed_id, vector_node AS v FROM nodes_embedding WHERE len(vector_node) = 64 AND NOT list_contains(list_transform(vector_node, lambda x: isnan(x)), true)) USING (embed_id)
  UNION SELECT 'edge', embed_id, relation, v FROM (SELECT DISTINCT embed_id, relation FROM relations) r JOIN (
    SELECT DISTINCT embed_id, vector_relations AS v FROM relations_embedding WHERE len(vector_relations) = 64 AND NOT list_contains(list_transform(vector_relations, lambda x: isnan(x)), true)) USING (embed_id)),
q AS (SELECT v FROM mixed WHERE kind = 'node' ORDER BY embed_id LIMIT 1)"""


def _mixed(spark, d):
    sound = lambda name, c: table(spark, d, name).where((F.size(c) == 64) & ~F.exists(c, lambda v: F.isnan(v))).select("embed_id", F.col(c).alias("vector")).distinct()
    nodes = table(spark, d, "nodes").select("embed_id", "label").distinct()
    links = table(spark, d, "relations").select("embed_id", F.col("relation").alias("label")).distinct()
    rows = collection.rows_of(nodes, sound("nodes_embedding", "vector_node"), "node").unionByName(
        collection.rows_of(links, sound("relations_embedding", "vector_relations"), "edge")
    )
    first = rows.where("kind = 'node'").orderBy(F.col("id").cast("long")).first()
    return rows, [float(x) for x in first["vector"]]


@query(f"""WITH {_MIXED} SELECT kind, embed_id::VARCHAR AS id, round({_DIST.format(a="mixed.v", b="q.v")}, 9) AS distance FROM mixed, q
ORDER BY {_DIST.format(a="mixed.v", b="q.v")}, kind, embed_id::VARCHAR LIMIT 12""")
def knn_collection(spark, d):
    """The nearest of one mixed collection of node and edge vectors."""
    rows, query_vector = _mixed(spark, d)
    return collection.search(rows, query_vector, 12).select("kind", "id", F.round("distance", 9).alias("distance"))


@query(f"""WITH {_MIXED}, top AS (SELECT embed_id, label, {_DIST.format(a="mixed.v", b="q.v")} AS distance FROM mixed, q WHERE kind = 'edge'
ORDER BY distance, embed_id::VARCHAR LIMIT 12)
SELECT embed_id::VARCHAR AS id, row_number() OVER (ORDER BY embed_id DESC, distance) AS place FROM top""")
def knn_collection_sorted(spark, d):
    """The nearest edges of the collection in the order of a metadata field."""
    rows, query_vector = _mixed(spark, d)
    hits = collection.search(rows, query_vector, 12, kind="edge", sort_by="embed_id", descending=True).collect()
    return spark.createDataFrame([(r.id, i + 1) for i, r in enumerate(hits)], "id string, place long")  # 12 rows


@query("""SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'node' AS kind, embed_id FROM nodes WHERE embed_id IS NOT NULL
UNION SELECT 'edge', embed_id FROM relations WHERE embed_id IS NOT NULL) x GROUP BY 1""")
def collection_counts(spark, d):
    """Pieces of every stored node and relation added twice, one of each whole deleted and added again: one row each."""
    row = lambda name, kind: table(spark, d, name).where("embed_id is not null").select(
        F.col("embed_id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.lit("{}").alias("metadata"), F.array(F.lit(1.0).cast("float")).alias("vector")
    ).distinct()
    rows = row("nodes", "node").unionByName(row("relations", "edge"))
    pieces = rows.withColumn("id", F.concat("id", F.lit("_0")))
    held = collection.add(collection.add(rows.where("false"), pieces), pieces)
    held = collection.delete(held, rows.where("kind = 'edge'"))
    held = collection.add(held, pieces.where("kind = 'edge'"))
    return held.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CLASS_ROWS = ", ".join(
    f"('{c}', '{p}', '{ontology.type_name(t)}')" if p else f"('{c}', NULL, NULL)" for c, ps in _TYPES.items() for p, t in (ps.items() or [(None, None)])
)


@query(f"""WITH o(class, property, range) AS (VALUES {_CLASS_ROWS})
SELECT DISTINCT class AS source, range AS target, property AS label FROM o WHERE range IN (SELECT class FROM o) AND range <> class AND property IS NOT NULL""")
def ontology_edges(spark, d):
    return ontology.class_graph(ontology.from_types(spark, _TYPES))[1]


@query(f"""WITH RECURSIVE {_TOPS.strip().removeprefix("WITH")}, o(class, property, range) AS (VALUES {_CLASS_ROWS}),
t AS (SELECT row_number() OVER () AS rid, record_key::BIGINT AS bundle, doc FROM tops WHERE tbl = 'fhir_transaction' AND doc ->> '$.resourceType' = 'Bundle'),
entries AS (
  SELECT rid, e.value AS entry FROM t, json_each(t.doc, '$.entry') e WHERE json_type(t.doc, '$.entry') = 'ARRAY'
  UNION ALL SELECT rid, t.doc -> '$.entry' FROM t WHERE json_type(t.doc, '$.entry') = 'OBJECT'
), found(rid, parent, label, kind, body) AS (
  SELECT rid, 'Bundle', 'instance_of', entry ->> '$.resource.resourceType', entry -> '$.resource' FROM entries
  WHERE json_type(entry) = 'OBJECT' AND json_type(entry, '$.resource') = 'OBJECT' AND json_type(entry, '$.resource.resourceType') = 'VARCHAR' AND entry ->> '$.resource.resourceType' <> ''
  UNION ALL
  SELECT rid, kind, key, item ->> '$.resourceType', item FROM (
    SELECT f.rid, f.kind, p.key, unnest(CASE WHEN p.type = 'ARRAY' THEN json_extract(p.value, '$[*]') ELSE [p.value] END) AS item FROM found f, json_each(f.body) p) x
  WHERE json_type(item) = 'OBJECT' AND json_type(item, '$.resourceType') = 'VARCHAR' AND item ->> '$.resourceType' <> ''
), fields AS (
  SELECT 'Bundle' AS parent, p.key AS label FROM t, json_each(t.doc) p WHERE p.key <> 'entry'
  UNION SELECT kind, key FROM (
    SELECT f.kind, p.key, unnest(CASE WHEN p.type = 'ARRAY' THEN json_extract(p.value, '$[*]') ELSE [p.value] END) AS item FROM found f, json_each(f.body) p) x
  WHERE json_type(item) <> 'OBJECT' OR NOT json_exists(item, '$.resourceType')
)
SELECT DISTINCT parent AS source, kind AS target FROM found
UNION SELECT f.parent, o.range FROM fields f JOIN o ON o.class = f.parent AND o.property = f.label WHERE o.range IN (SELECT class FROM o)""")
def bundle_type_pairs(spark, d):
    from knotwork.operators import bundle

    return bundle.type_edges(table(spark, d, "fhir_transaction"), ontology.from_types(spark, _TYPES)).select("source", "target")


@query("""SELECT embed_id, attributes AS raw, CASE WHEN attributes IS NULL THEN '' ELSE attributes END AS label FROM nodes
WHERE attributes IS NULL OR NOT json_valid(attributes)""")
def dot_labels_of_texts(spark, d):
    """Labels of documents that are no objects: the text as it is."""
    rows = table(spark, d, "nodes").where(F.col("attributes").isNull() | F.try_parse_json("attributes").isNull())
    return rows.select("embed_id", F.col("attributes").alias("raw"), export.label_of().alias("label"))


_DOC = "CASE WHEN json_valid(attributes) THEN json(attributes)::VARCHAR ELSE attributes END"


@query(f"""WITH base AS (SELECT source, target, {_DOC} AS doc FROM edges WHERE label IS NOT NULL),
new AS (SELECT DISTINCT source, target, {_DOC} AS doc FROM edges WHERE attributes IS NOT NULL),
added AS (SELECT source, target FROM new WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.source = new.source AND b.target = new.target AND b.doc = new.doc))
SELECT source, target, count(*) AS n FROM (SELECT source, target FROM base UNION ALL SELECT source, target FROM added) x GROUP BY 1, 2""")
def add_edges_to_stored(spark, d):
    """All edges offered to a table that holds those with a label already."""
    edges = table(spark, d, "edges")
    new = edges.where("attributes is not null").select("source", "target", "label", "attributes")
    added = mutate.add_edges(table(spark, d, "nodes"), edges.where("label is not null"), new, stamp=False)
    return added.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


_GONE = "(SELECT id FROM nodes WHERE label IS NULL AND id IS NOT NULL)"


@query(f"""SELECT 'node' AS kind, embed_id FROM nodes WHERE id IS NULL OR id NOT IN {_GONE}
UNION ALL SELECT 'edge', embed_id FROM edges WHERE (source IS NULL OR source NOT IN {_GONE}) AND (target IS NULL OR target NOT IN {_GONE})""")
def cascade_delete_rows(spark, d):
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    left, links = mutate.remove_nodes(nodes, edges, nodes.where("label is null").select("id"))
    return left.select(F.lit("node").alias("kind"), "embed_id").unionByName(links.select(F.lit("edge").alias("kind"), "embed_id"))


_ORDERED = "oe AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, o_orderkey AS embed_id FROM orders)"


def _ordered(spark, d):
    """Orders as edges from their customer."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"),
        F.lit("ORDERED").alias("label"), F.lit("{}").alias("attributes"), F.col("o_orderkey").alias("embed_id"),
    )


@query(f"""WITH {_knn_sql(5)}, {_CUST}, {_ORDERED}, hit AS (SELECT source, target FROM knn JOIN oe USING (embed_id)),
seeds AS (SELECT id FROM cu WHERE embed_id IN (SELECT embed_id FROM knn) UNION SELECT source FROM hit UNION SELECT target FROM hit)
SELECT DISTINCT id, label, attributes FROM cu WHERE id IN (SELECT id FROM seeds)
OR id IN (SELECT unnest([source, target]) FROM oe WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds))""")
def search_subgraph_both(spark, d):
    """Nodes around the nearest nodes and the nearest edges."""
    return retrieve.search_subgraph(
        _customers(spark, d), _ordered(spark, d), _vectors(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 5, None
    )[0]


@query(f"""WITH {_CUST}, {_ORDERED}, pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS embed_id, {_DIST.format(a="e.embedding", b="q.embedding")} AS distance
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
seeds AS (SELECT query_id, cu.id FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, embed_id) <= 3) x JOIN cu USING (embed_id)),
near AS (SELECT * FROM seeds UNION SELECT query_id, target FROM seeds JOIN oe ON source = id UNION SELECT query_id, source FROM seeds JOIN oe ON target = id)
SELECT DISTINCT query_id, near.id FROM near JOIN cu ON cu.id = near.id""")
def retrieve_many(spark, d):
    """Queries are the vectors whose id is divisible by 50, against all."""
    queries = _vectors(spark, d).where("embed_id % 50 = 0").withColumnRenamed("embed_id", "query_id")
    found = retrieve.retrieve_batch(_customers(spark, d), _ordered(spark, d), _vectors(spark, d), queries, 3, None)
    return found.select("query_id", "id").distinct()


_NAMED = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "mrn": {"type": "string"}}}


@query("""SELECT DISTINCT embed_id FROM (SELECT embed_id, label, CASE WHEN json_valid(attributes) THEN attributes END AS doc FROM nodes) n
WHERE json_type(doc) = 'OBJECT' AND (label NOT IN ('Symptom', 'Medication') OR label IS NULL
  OR (json_type(doc, '$.name') = 'VARCHAR' AND coalesce(json_type(doc, '$.mrn'), 'VARCHAR') = 'VARCHAR'))""")
def schema_valid_nodes(spark, d):
    """Nodes whose document meets the schema of their label; labels without one take any object."""
    nodes = table(spark, d, "nodes")
    return nodes.where(jsonschema.meets_by_type("attributes", "label", {"Symptom": _NAMED, "Medication": _NAMED})).select("embed_id").distinct()


@query(f"SELECT class, property, range FROM (VALUES {_CLASS_ROWS}) o(class, property, range)")
def ontology_table(spark, d):
    return ontology.from_types(spark, _TYPES)


@query("SELECT embed_id, id AS own FROM nodes WHERE id IS NOT NULL")
def own_id_in_document(spark, d):
    nodes = table(spark, d, "nodes").where("id is not null").withColumn("attributes", mutate.with_own_id())
    return nodes.select("embed_id", F.get_json_object("attributes", "$.id").alias("own"))


@query("""SELECT DISTINCT embed_id, doc ->> '$.id' AS id, doc ->> '$.resourceType' AS label FROM (
  SELECT embed_id, CASE WHEN json_valid(resource) THEN resource END AS doc FROM devicerequest) r
WHERE json_type(doc) = 'OBJECT' AND doc ->> '$.id' IS NOT NULL AND doc ->> '$.resourceType' IS NOT NULL""")
def resources_as_nodes(spark, d):
    sound = table(spark, d, "devicerequest").where(F.try_parse_json("resource").isNotNull())
    return ontology.resource_nodes(sound.select("embed_id", "resource"), keep=("embed_id",)).select("embed_id", "id", "label").distinct()


# Queries whose functions stand with the other graph queries.
SQL["ontology_class_graph"] = SQL["ontology_edges"]
SQL["find_nodes_like"] = """WITH cur AS (SELECT id, embed_id, label FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, embed_id DESC) = 1),
first AS (SELECT label FROM cur WHERE label ILIKE '%vital%' ORDER BY embed_id, id LIMIT 1)
SELECT id, label FROM cur WHERE lower(label) = (SELECT lower(label) FROM first) ORDER BY embed_id LIMIT 1"""
