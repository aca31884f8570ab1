"""Queries of the graph engine's own operators, each over whole tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import jsontext, typed
from knotwork.functions.jsontext import json_tree
from knotwork.operators import bundle, export, extract, lookup, merge, mutate, ontology, resources, retrieve, traverse, vector
from knotwork.plans import graph_view as gv
from knotwork.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes: props are their document."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label"), F.col("props").alias("attributes"), F.col("event_id").alias("embed_id")
    )


def _event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edges from user to event type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"),
        F.lit("DID").alias("label"), F.col("props").alias("attributes"), F.col("event_id").alias("embed_id"),
    )


_EVENT_EDGES = "ev AS (SELECT 'u' || user_id AS source, event_type AS target, 'DID' AS label, props AS attributes, event_id AS embed_id FROM events)"

# Point lookups.


@query(gv.sql("SELECT attributes FROM gn WHERE id = 'c17'"))
def lookup_node_by_id(spark, d):
    return lookup.node_by_id(gv.nodes(spark, d), "c17")


@query(gv.sql("SELECT label FROM gn WHERE id = 'o5'"))
def lookup_label(spark, d):
    return lookup.node_label(gv.nodes(spark, d), "o5")


@query(gv.sql("SELECT DISTINCT label FROM gn WHERE label = 'ASIA'"))
def lookup_type(spark, d):
    return lookup.node_type(gv.nodes(spark, d), "ASIA")


@query(gv.sql("SELECT id FROM gn WHERE label = 'HOUSEHOLD' ORDER BY embed_id, id LIMIT 1"))
def lookup_id_by_type(spark, d):
    return lookup.id_by_type(gv.nodes(spark, d), "HOUSEHOLD")


@query(gv.sql("SELECT id FROM gn ORDER BY embed_id, id LIMIT 10"))
def list_ids_limit(spark, d):
    return lookup.ids(gv.nodes(spark, d))


@query(gv.sql("SELECT id, label FROM gn WHERE label ILIKE '%RING%'"))
def label_like(spark, d):
    return lookup.nodes_like_label(gv.nodes(spark, d), "RING", None).select("id", "label")


@query(gv.sql("SELECT embed_id FROM gn WHERE id = 'p9'"))
def embed_id_of_node(spark, d):
    return lookup.embed_id_of(gv.nodes(spark, d), "p9")


@query(gv.sql("SELECT embed_id FROM ge WHERE source = 'c17' OR target = 'c17' ORDER BY embed_id LIMIT 10"))
def embed_ids_of_edges(spark, d):
    return lookup.edge_embed_ids(gv.edges(spark, d), "c17")


@query(gv.sql("SELECT id FROM gn WHERE embed_id = 172"))
def id_of_embed_id(spark, d):
    return lookup.id_of(gv.nodes(spark, d), 172)


@query(f"WITH {_EVENT_EDGES} SELECT embed_id FROM ev WHERE source = 'u8' AND target = 'error' AND json(attributes) = json('{{ \"k\":69}}') ORDER BY embed_id LIMIT 1")
def edge_by_identity(spark, d):
    return lookup.edge_by_identity(_event_edges(spark, d), "u8", "error", '{ "k":69}')


# Attribute predicates.


@query("SELECT event_id::VARCHAR AS id FROM events WHERE json_extract(props, '$.k')::BIGINT = 30")
def attr_pred_eq(spark, d):
    return lookup.find(_events(spark, d), typed.clause("k", "=", 30), "id")


@query("SELECT event_id::VARCHAR AS id FROM events WHERE json_extract(props, '$.k')::BIGINT > 70")
def attr_pred_gt(spark, d):
    return lookup.find(_events(spark, d), typed.clause("k", ">", 70), "id")


@query("SELECT event_id::VARCHAR AS id FROM events WHERE json_extract(props, '$.k')::VARCHAR LIKE '%7%'")
def attr_pred_like(spark, d):
    return lookup.find(_events(spark, d), typed.clause("k", "LIKE", "%7%"), "id")


@query("""SELECT event_id::VARCHAR AS id FROM events WHERE (json_extract(props, '$.k')::BIGINT > 20 AND json_extract(props, '$.k')::BIGINT < 60
OR json_extract(props, '$.k')::BIGINT = 5) AND NOT json_extract(props, '$.k')::BIGINT = 30""")
def attr_pred_and_or_not(spark, d):
    c = typed.clause
    condition = typed.join_clauses([c("k", ">", 20), c("k", "<", 60), c("k", "=", 5), c("k", "=", 30)], ["AND", "OR", "NOT"])
    return lookup.find(_events(spark, d), condition, "id")


_OK = "CASE WHEN json_valid(attributes) THEN attributes END"


@query(f"SELECT DISTINCT embed_id FROM nodes WHERE json_extract_string({_OK}, '$.city') ILIKE '%port%'")
def attr_nodes_like(spark, d):
    return lookup.find(table(spark, d, "nodes"), typed.clause("city", "LIKE", "%port%"), "embed_id").distinct()


@query(f"SELECT DISTINCT embed_id FROM edges WHERE json_type({_OK}, '$.weight') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND json_extract({_OK}, '$.weight')::DOUBLE > 0.5")
def attr_edges_gt(spark, d):
    return lookup.find(table(spark, d, "edges"), typed.clause("weight", ">", 0.5) & (typed.extract("attributes", "weight")[0] == 1), "embed_id").distinct()


@query(f"SELECT DISTINCT embed_id FROM edges WHERE json_extract_string({_OK}, '$.relation.code') = 'uses'")
def attr_nested_eq(spark, d):
    return lookup.find(table(spark, d, "edges"), typed.clause("relation.code", "=", "uses"), "embed_id").distinct()


@query(f"""SELECT DISTINCT embed_id FROM (SELECT embed_id, {_OK} AS doc FROM edges) e, json_tree(e.doc) t
WHERE t.type = 'VARCHAR' AND t.atom ->> '$' = 'signed'""")
def json_tree_any(spark, d):
    return lookup.find_in_tree(table(spark, d, "edges"), "signed").select("embed_id").distinct()


@query(f"""SELECT DISTINCT embed_id FROM (SELECT embed_id, {_OK} AS doc FROM edges) e, json_tree(e.doc) t
WHERE t.key = 'batch' AND t.type = 'VARCHAR' AND t.atom ->> '$' LIKE 'B1%'""")
def json_tree_key(spark, d):
    tree = lookup.find_in_tree(table(spark, d, "edges"), "B1", ">", "batch").select("embed_id").distinct()
    below = lookup.find_in_tree(table(spark, d, "edges"), "B2", "<", "batch").select("embed_id").distinct()
    return tree.join(below, "embed_id", "left_semi")


@query("SELECT count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::DOUBLE AS total FROM events")
def json_tree_scan(spark, d):
    tree = json_tree(table(spark, d, "events"), "event_id", "props").where("key = 'k'")
    return tree.agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("total"))


@query("SELECT event_id AS embed_id FROM events ORDER BY json_extract(props, '$.k')::BIGINT DESC, event_id LIMIT 50")
def attr_sort_top(spark, d):
    return _events(spark, d).orderBy(*typed.order_by("k", True), "embed_id").limit(50).select("embed_id")


# Neighbourhoods.


@query(gv.sql("SELECT DISTINCT source, target, label, attributes, embed_id FROM ge WHERE source = 'n3' OR target = 'n3'"))
def incident_edges(spark, d):
    return traverse.incident_edges(gv.edges(spark, d), "n3")


@query(gv.sql("SELECT target, label, attributes FROM ge WHERE source = 'n3' ORDER BY embed_id LIMIT 10"))
def out_edges(spark, d):
    return traverse.out_edges(gv.edges(spark, d), "n3")


@query(gv.sql("SELECT source, label, attributes FROM ge WHERE target = 'p9' ORDER BY embed_id LIMIT 10"))
def in_edges(spark, d):
    return traverse.in_edges(gv.edges(spark, d), "p9")


@query(gv.sql("SELECT source, target, label, attributes, embed_id FROM ge WHERE target = 'p9'"))
def one_way_in(spark, d):
    return traverse.one_way(gv.edges(spark, d), "p9", "in")


@query("""SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x
WHERE id IS NOT NULL GROUP BY id""")
def degree(spark, d):
    return traverse.degrees(table(spark, d, "edges"))


@query(gv.sql("""SELECT DISTINCT id, label, attributes FROM gn WHERE id IN (
SELECT unnest([source, target]) FROM ge WHERE source = 'c17' OR target = 'c17')"""))
def neighbors_of_node(spark, d):
    return traverse.neighbours_of(gv.nodes(spark, d), gv.edges(spark, d), spark.createDataFrame([("c17",)], "id string"), None)


@query(gv.sql("""SELECT DISTINCT id, label, attributes FROM gn WHERE id IN (
SELECT unnest([source, target]) FROM (SELECT * FROM ge WHERE source IN ('n3', 'c17') OR target IN ('n3', 'c17') ORDER BY embed_id LIMIT 5) x)"""))
def neighbors_of_edge(spark, d):
    ends = spark.createDataFrame([("n3",), ("c17",)], "id string")
    return traverse.neighbours_of(gv.nodes(spark, d), gv.edges(spark, d), ends, 5)


# Traversal.


@query(gv.sql("SELECT id FROM reach", "reach(id) AS (SELECT id FROM gn WHERE id = 'r1' UNION SELECT target FROM reach JOIN ge ON source = reach.id)"))
def traverse_outbound(spark, d):
    return traverse.reachable(gv.nodes(spark, d), gv.edges(spark, d), "r1").select("id")


@query(gv.sql("SELECT id FROM reach", "reach(id) AS (SELECT id FROM gn WHERE id = 'p9' UNION SELECT source FROM reach JOIN ge ON target = reach.id)"))
def traverse_inbound(spark, d):
    return traverse.reachable(gv.nodes(spark, d), gv.edges(spark, d), "p9", "in").select("id")


@query("""WITH RECURSIVE seed AS (SELECT min(source) AS id FROM edges WHERE source IN (SELECT id FROM nodes)),
reach(id) AS (SELECT id FROM seed UNION SELECT target FROM reach JOIN edges ON source = reach.id WHERE target IS NOT NULL) SELECT id FROM reach""")
def traverse_stored_edges(spark, d):
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    seed = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").agg(F.min("source")).first()[0]
    return traverse.reachable(nodes, edges, seed).select("id")


@query(gv.sql("""SELECT gn.id, '()' AS mark, gn.attributes AS body FROM gn JOIN near ON near.id = gn.id
UNION SELECT target, '->', attributes FROM ge JOIN near ON source = near.id
UNION SELECT source, '<-', attributes FROM ge JOIN near ON target = near.id""",
"""near(id) AS (SELECT id FROM gn WHERE id = 's2' UNION
(SELECT CASE WHEN source = near.id THEN target ELSE source END FROM near JOIN ge ON source = near.id OR target = near.id))"""))  # fmt: skip
def traverse_bodies(spark, d):
    return traverse.traverse_bodies(gv.nodes(spark, d), gv.edges(spark, d), "s2")


@query("""WITH RECURSIVE r AS (SELECT source_id AS a, target_id AS b FROM relations WHERE target_id IS NOT NULL AND source_id IS NOT NULL),
two_way AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
near(id) AS (SELECT min(a) FROM r UNION SELECT b FROM near JOIN two_way ON a = near.id) SELECT id FROM near""")
def connected_component(spark, d):
    relations = traverse.as_edges(table(spark, d, "relations"))
    seed = relations.where("source is not null and target is not null").agg(F.min("source")).first()[0]
    return traverse.component(relations, seed)


@query(gv.sql("SELECT min(hop) AS length FROM walk WHERE id = 'p9'", """walk(id, hop) AS (SELECT 'r1', 0 UNION
SELECT target, hop + 1 FROM walk JOIN ge ON source = walk.id WHERE hop < 6)"""))
def shortest_path_length(spark, d):
    path = traverse.shortest_path(gv.edges(spark, d), "r1", "p9")
    return path.agg(F.max("step").alias("length"))


_FIRST_RELATED = "(SELECT min(target_id) FROM relations)"


@query(f"SELECT source_id, source_type, resource FROM relations WHERE target_id = {_FIRST_RELATED}")
def relation_in_edges(spark, d):
    relations = table(spark, d, "relations")
    return traverse.relation_in(relations, relations.agg(F.min("target_id")).first()[0])


@query("SELECT target_id, target_type, resource FROM relations WHERE source_id = (SELECT min(source_id) FROM relations)")
def relation_out_edges(spark, d):
    relations = table(spark, d, "relations")
    return traverse.relation_out(relations, relations.agg(F.min("source_id")).first()[0])


@query("""SELECT embed_id, source_id, target_id FROM relations WHERE source_id = (SELECT min(source_id) FROM relations)
OR target_id = (SELECT min(source_id) FROM relations)""")
def relation_connections(spark, d):
    relations = table(spark, d, "relations")
    return traverse.relation_touching(relations, relations.agg(F.min("source_id")).first()[0]).select("embed_id", "source_id", "target_id")


# Vectors.


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("embed_id"), F.col("embedding").alias("vector"))


def _vector_of(spark, d, vec_id):
    return [float(x) for x in _vectors(spark, d).where(F.col("embed_id") == vec_id).first()["vector"]]


def _customers(spark, d):
    """Customers whose key is a vec_id, as nodes with that vector."""
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("label"),
        F.concat(F.lit('{"name":"'), "c_name", F.lit('","nation":'), F.col("c_nationkey").cast("string"), F.lit("}")).alias("attributes"),
        F.col("c_custkey").cast("long").alias("embed_id"),
    )


_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def _knn_sql(k: int, vec_id: int = 0) -> str:
    return (
        "knn AS (SELECT e.vec_id AS embed_id, " + _DIST.format(a="e.embedding", b="q.embedding")
        + f" AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY distance, e.vec_id LIMIT {k})"
    )


_CUST = """cu AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS label,
'{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS attributes, c_custkey AS embed_id, c_nationkey FROM customer)"""


@query(f"WITH {_knn_sql(10)} SELECT embed_id, distance FROM knn")
def knn_ids_only(spark, d):
    return vector.nearest(_vectors(spark, d), _vector_of(spark, d, 0), 10)


@query(f"WITH {_knn_sql(10)}, {_CUST} SELECT embed_id, id, label, attributes, distance FROM knn JOIN cu USING (embed_id)")
def knn_nodes(spark, d):
    return vector.search_nodes(_customers(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 10, None)


@query(f"WITH {_knn_sql(50)}, {_CUST} SELECT embed_id, id, label, attributes, distance FROM knn JOIN cu USING (embed_id) WHERE distance < 1.2")
def knn_threshold(spark, d):
    return vector.search_nodes(_customers(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 50, 1.2)


@query(f"WITH {_knn_sql(20)}, {_CUST} SELECT id, row_number() OVER (ORDER BY c_nationkey DESC, embed_id) AS place FROM knn JOIN cu USING (embed_id)")
def knn_sort_attr(spark, d):
    hits = vector.search_nodes(_customers(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 20, None, "nation", True)
    return spark.createDataFrame([(r.id, i + 1) for i, r in enumerate(hits.collect())], "id string, place long")  # 20 rows


@query(f"WITH {_knn_sql(10)}, {_EVENT_EDGES} SELECT embed_id, source, target, label, attributes, distance FROM knn JOIN ev USING (embed_id)")
def knn_edges_desc(spark, d):
    return vector.search_edges(_event_edges(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 10, None, True)


@query(f"WITH {_CUST} SELECT embed_id, id, label, attributes FROM cu WHERE embed_id IN (3, 7, 11, 29)")
def fetch_nodes_by_embed_ids(spark, d):
    return vector.fetch_by_embed_ids(_customers(spark, d), [3, 7, 11, 29], "name", True)


_BATCH = (
    "pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS embed_id, " + _DIST.format(a="e.embedding", b="q.embedding")
    + " AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"
)


@query(f"""WITH {_BATCH} SELECT query_id, embed_id, round(distance, 9) AS distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, embed_id) <= 3""")
def knn_batch(spark, d):
    """Queries are the vectors whose id is divisible by 50, against all."""
    queries = _vectors(spark, d).where("embed_id % 50 = 0").withColumnRenamed("embed_id", "query_id")
    return vector.nearest_batch(_vectors(spark, d), queries, 3).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_BATCH} SELECT query_id FROM pairs WHERE query_id <> embed_id GROUP BY query_id HAVING min(distance) >= 1.1""")
def is_unique_batch(spark, d):
    queries = _vectors(spark, d).where("embed_id % 50 = 0").withColumnRenamed("embed_id", "query_id")
    return vector.unique_batch(_vectors(spark, d), queries, 1.1, exclude_self=True)


@query("SELECT count(*) AS n FROM nodes_embedding WHERE vector_node IS NULL OR len(vector_node) <> 64")
def vectors_wrong_dimension(spark, d):
    from knotwork.schema import wrong_dimension

    vectors = table(spark, d, "nodes_embedding").withColumnRenamed("vector_node", "vector")
    return wrong_dimension(vectors, 64).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT embed_id FROM nodes_embedding WHERE embed_id NOT IN (SELECT embed_id FROM nodes WHERE embed_id IS NOT NULL)")
def vectors_without_node(spark, d):
    vectors = table(spark, d, "nodes_embedding")
    return mutate.remove_vectors(vectors, table(spark, d, "nodes")).select("embed_id").distinct()


def _subgraph(spark, d):
    return retrieve.search_subgraph(_customers(spark, d), gv.edges(spark, d), _vectors(spark, d), _vectors(spark, d).where("false"), _vector_of(spark, d, 0), 5, None)


@query(gv.sql("""SELECT DISTINCT id, label, attributes FROM cu WHERE embed_id IN (SELECT embed_id FROM knn) OR id IN (
SELECT unnest([source, target]) FROM ge WHERE source IN (SELECT 'c' || embed_id FROM knn) OR target IN (SELECT 'c' || embed_id FROM knn))""",
_knn_sql(5), _CUST))
def search_subgraph_nodes(spark, d):
    return _subgraph(spark, d)[0]


@query(f"WITH {_knn_sql(5)}, {_EVENT_EDGES} SELECT DISTINCT source, target, label, attributes FROM knn JOIN ev USING (embed_id)")
def search_subgraph_edges(spark, d):
    return retrieve.search_subgraph(
        _customers(spark, d), _event_edges(spark, d), _vectors(spark, d), _vectors(spark, d), _vector_of(spark, d, 0), 5, None
    )[1]


@query("""WITH v AS (SELECT DISTINCT embed_id, vector_relations AS v FROM relations_embedding WHERE len(vector_relations) = 64),
q AS (SELECT v FROM v WHERE embed_id = (SELECT min(embed_id) FROM v)),
top AS (SELECT embed_id, """ + _DIST.format(a="v.v", b="q.v") + """ AS distance FROM v, q ORDER BY distance, embed_id LIMIT 10)
SELECT DISTINCT embed_id, source_id AS source, target_id AS target, relation AS label, round(distance, 9) AS distance FROM top JOIN relations USING (embed_id)""")
def knn_relations(spark, d):
    vectors = table(spark, d, "relations_embedding").withColumnRenamed("vector_relations", "vector").where("size(vector) = 64").distinct()
    query = [float(x) for x in vectors.orderBy("embed_id").first()["vector"]]
    hits = vector.search_edges(traverse.as_edges(table(spark, d, "relations")), vectors, query, 10, None)
    return hits.select("embed_id", "source", "target", "label", F.round("distance", 9).alias("distance")).distinct()


@query()
def find_nodes_like(spark, d):
    embedder = vector.HashingEmbedder(64)
    nodes = mutate.current_nodes(table(spark, d, "nodes"))
    vectors = nodes.select("embed_id", embedder.column(F.col("label")).alias("vector")).where("vector is not null")
    return retrieve.nodes_like(nodes, vectors, "vital", embedder, 0.9).select("id", "label")


# Changes.


def _half(spark, d):
    """Two overlapping halves of the graph's orders, as stored and as new nodes."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("label"),
        F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('"}')).alias("attributes"),
        F.col("o_orderkey").alias("embed_id"), "o_orderstatus",
    )
    return rows.where("o_orderstatus <> 'P'").drop("o_orderstatus"), rows.where("o_orderstatus <> 'F'").drop("o_orderstatus", "embed_id")


@query("""WITH old AS (SELECT 'o' || o_orderkey AS id, o_orderkey AS embed_id FROM orders WHERE o_orderstatus <> 'P'),
fresh AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT id, embed_id FROM old UNION ALL SELECT id, (SELECT max(embed_id) FROM old) + row_number() OVER (ORDER BY id) FROM fresh""")
def add_nodes_ignore_existing(spark, d):
    old, new = _half(spark, d)
    return mutate.add_nodes(old, new, "id", stamp=False).select("id", "embed_id")


@query("""WITH e AS (SELECT DISTINCT source, target, CASE WHEN json_valid(attributes) THEN json(attributes)::VARCHAR ELSE attributes END AS doc FROM edges)
SELECT count(*) AS n, count(DISTINCT source) AS n_sources FROM e
WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) AND doc IS NOT NULL""")
def add_edges_checked(spark, d):
    nodes = table(spark, d, "nodes")
    new = table(spark, d, "edges").where("attributes is not null").select("source", "target", "label", "attributes")
    none = table(spark, d, "edges").where("false")
    added = mutate.add_edges(nodes, none, new, stamp=False)
    return added.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


@query("""WITH e AS (SELECT DISTINCT source, target, embed_id, CASE WHEN json_valid(attributes) THEN json(attributes)::VARCHAR ELSE attributes END AS doc FROM edges)
SELECT source, target, max(embed_id) AS embed_id FROM e GROUP BY source, target, doc""")
def edge_dedup_replace(spark, d):
    return mutate.replace_duplicates(table(spark, d, "edges")).select("source", "target", "embed_id")


@query("""WITH old AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
new AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT 'u' || coalesce(old.user_id, new.user_id) AS id, o.event_type AS a, n.event_type AS b,
coalesce(json_extract(n.props, '$.k'), json_extract(o.props, '$.k'))::VARCHAR AS k
FROM old FULL JOIN new ON old.user_id = new.user_id LEFT JOIN events o ON o.event_id = old.e LEFT JOIN events n ON n.event_id = new.e""")
def upsert_merge(spark, d):
    e = table(spark, d, "events")

    def last(parity: int, field: str) -> DataFrame:
        rows = e.where(F.col("event_id") % 2 == parity)
        own = mutate.keep_one(rows, ["user_id"], F.col("event_id").desc())
        document = jsontext.with_field("props", field, F.col("event_type"))
        return own.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.lit("user").alias("label"), document.alias("attributes"), F.col("event_id").alias("embed_id"))

    merged = mutate.upsert_nodes(last(0, "a"), last(1, "b").drop("embed_id"), stamp=False)
    return merged.select("id", *(F.get_json_object("attributes", f"$.{c}").alias(c) for c in ("a", "b", "k")))


@query("""SELECT (SELECT count(*) FROM nodes WHERE id IS NULL OR id NOT IN (SELECT id FROM nodes WHERE label IS NULL AND id IS NOT NULL)) AS n_nodes,
(SELECT count(*) FROM edges WHERE (source IS NULL OR source NOT IN (SELECT id FROM nodes WHERE label IS NULL AND id IS NOT NULL))
AND (target IS NULL OR target NOT IN (SELECT id FROM nodes WHERE label IS NULL AND id IS NOT NULL))) AS n_edges""")
def cascade_delete(spark, d):
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    left = mutate.remove_nodes(nodes, edges, nodes.where("label is null").select("id"))
    counts = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in zip(left, ("n_nodes", "n_edges"))]
    return spark.createDataFrame([(counts[0].first()[0], counts[1].first()[0])], "n_nodes long, n_edges long")


@query(gv.sql("SELECT md5(source) AS source, md5(target) AS target, label FROM ge"))
def insert_graph_remap(spark, d):
    _, edges, _ = mutate.remap_graph(gv.nodes(spark, d).drop("embed_id"), gv.edges(spark, d), "md5")
    return edges.select("source", "target", "label")


@query("SELECT DISTINCT label FROM nodes WHERE label IS NOT NULL")
def add_node_types(spark, d):
    types = table(spark, d, "nodes").where("label is not null").select("id", "label", F.lit("{}").alias("attributes"))
    from knotwork.schema import empty

    return mutate.add_node_type(empty(spark, "nodes"), types).select("label")


@query("SELECT (SELECT max(embed_id) + 1 FROM nodes) AS next_node, (SELECT max(embed_id) + 1 FROM edges) AS next_edge")
def id_allocation(spark, d):
    return spark.createDataFrame(
        [(mutate.next_id(table(spark, d, "nodes")), mutate.next_id(table(spark, d, "edges")))], "next_node long, next_edge long"
    )


@query("""SELECT id, embed_id FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, embed_id DESC) = 1""")
def current_nodes(spark, d):
    return mutate.current_nodes(table(spark, d, "nodes")).select("id", "embed_id")


# Merging.


def _merged(spark, d):
    return merge.resolve_chains(merge.similar_pairs(_customers(spark, d), _vectors(spark, d), 1.2, None))


_MERGED = [
    _CUST,
    "prs AS (SELECT q.vec_id AS q, e.vec_id AS e, " + _DIST.format(a="e.embedding", b="q.embedding") + """ AS distance
    FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id AND e.vec_id IN (SELECT embed_id FROM cu) AND q.vec_id IN (SELECT embed_id FROM cu))""",
    "top AS (SELECT * FROM prs QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, e) = 1)",
    "lnk AS (SELECT 'c' || q AS a, 'c' || e AS b FROM top WHERE distance < 1.2 UNION SELECT 'c' || e, 'c' || q FROM top WHERE distance < 1.2)",
    "clo(a, b) AS (SELECT a, b FROM lnk UNION SELECT clo.a, lnk.b FROM clo JOIN lnk ON clo.b = lnk.a)",
    "mrg AS (SELECT a AS id, min(b) AS survivor FROM clo GROUP BY a HAVING min(b) < a)",
]


@query(gv.sql("SELECT id, survivor FROM mrg", *_MERGED))
def merge_pairs(spark, d):
    return _merged(spark, d)


@query(gv.sql("""SELECT source, target, embed_id FROM (SELECT coalesce(s.survivor, source) AS source, coalesce(t.survivor, target) AS target, embed_id,
s.survivor IS NOT NULL OR t.survivor IS NOT NULL AS moved FROM ge LEFT JOIN mrg s ON s.id = source LEFT JOIN mrg t ON t.id = target) x
WHERE NOT (moved AND source = target)""", *_MERGED))
def merge_rewire(spark, d):
    return merge.rewire(gv.edges(spark, d), _merged(spark, d)).select("source", "target", "embed_id")


def _user_merge(spark, d):
    """Users with the same remainder by 10 are one: survivor u<remainder>; users below 10 stay."""
    users = table(spark, d, "events").select("user_id").distinct().where("user_id >= 10")
    return users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("survivor"))


@query("""SELECT 'u' || (user_id % 10) AS survivor, 'k' AS key, sum(json_extract(props, '$.k')::BIGINT)::DOUBLE AS num FROM events
WHERE user_id >= 10 GROUP BY 1""")
def merge_fold_attrs(spark, d):
    folded = merge.fold_attributes(merge.incident(_event_edges(spark, d), _user_merge(spark, d)))
    return folded.select("survivor", "key", "num")


@query("""SELECT 'u' || (user_id % 10) AS survivor, 'user,' || string_agg(event_type || ',', '' ORDER BY event_id) AS label FROM events
WHERE user_id >= 10 GROUP BY 1""")
def merge_labels(spark, d):
    edges = _event_edges(spark, d).withColumn("label", F.col("target"))
    survivors = _user_merge(spark, d).select(F.col("survivor").alias("id")).distinct().withColumn("label", F.lit("user"))
    return merge.fold_labels(survivors, merge.incident(edges, _user_merge(spark, d)))


@query(gv.sql("""SELECT n.id, n.label || coalesce(',' || t.more, '') AS label FROM cu n LEFT JOIN (
  SELECT survivor, string_agg(label || ',', '' ORDER BY embed_id, place) AS more FROM (
    SELECT m.survivor, g.label, g.embed_id, 0 AS place FROM ge g JOIN mrg m ON m.id = g.source
    UNION ALL SELECT m.survivor, g.label, g.embed_id, 1 FROM ge g JOIN mrg m ON m.id = g.target) x GROUP BY 1) t ON t.survivor = n.id
WHERE n.id NOT IN (SELECT id FROM mrg)""", *_MERGED))
def merge_nodes(spark, d):
    """The nodes after the whole of a merge by similarity."""
    return merge.merge_by_similarity(_customers(spark, d), gv.edges(spark, d), _vectors(spark, d), 1.2, None)[0].select("id", "label")


# Versioned resources.


def _operations(spark, d):
    e = table(spark, d, "events")
    op = F.expr("case event_id % 5 when 0 then 'add' when 1 then 'update' when 2 then 'update' when 3 then 'remove' else 'add' end")
    return e.select(
        F.col("event_type").alias("resource_type"), F.col("user_id").cast("string").alias("id"), op.alias("op"), F.col("props").alias("body"), F.col("event_id").alias("seq"), "ts"
    )


def _store(spark, d):
    from knotwork.schema import empty

    return resources.apply_operations(empty(spark, "resources"), empty(spark, "resource_history"), _operations(spark, d))


_OPS = """ops AS (SELECT event_type AS resource_type, user_id::VARCHAR AS id, event_id, ts, props AS body,
CASE event_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'update' WHEN 3 THEN 'remove' ELSE 'add' END AS op,
row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS txid FROM events),
line AS (SELECT *, coalesce(lag(op) OVER w, 'remove') <> 'remove' AS present,
last_value(CASE WHEN op <> 'remove' THEN body END IGNORE NULLS) OVER (PARTITION BY resource_type, id ORDER BY txid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
FROM ops WINDOW w AS (PARTITION BY resource_type, id ORDER BY txid))"""
_LOG = """SELECT resource_type, id, txid, CASE WHEN op = 'add' AND present THEN 'created' WHEN op = 'update' THEN 'updated'
WHEN op = 'remove' AND present THEN 'deleted' END AS status, CASE WHEN op = 'update' THEN body ELSE held END AS resource FROM line"""


@query(f"WITH {_OPS} SELECT * FROM ({_LOG}) x WHERE status IS NOT NULL")
def resource_history(spark, d):
    return _store(spark, d)[1].select("resource_type", "id", "txid", "status", "resource")


@query(f"""WITH {_OPS} SELECT resource_type, id, txid, CASE WHEN op = 'update' THEN 'updated' WHEN present THEN 'recreated' ELSE 'created' END AS status, body AS resource
FROM (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY resource_type, id ORDER BY txid DESC) = 1) x WHERE op <> 'remove'""")
def resource_current(spark, d):
    return _store(spark, d)[0].select("resource_type", "id", "txid", "status", "resource")


@query(f"WITH {_OPS} SELECT resource_type, count(*) AS n FROM ({_LOG}) x WHERE status = 'deleted' GROUP BY 1")
def resource_deleted(spark, d):
    return _store(spark, d)[1].where("status = 'deleted'").groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, txid FROM (SELECT event_type, user_id::VARCHAR AS id, event_id AS txid, event_id % 5 = 3 AS gone FROM events WHERE event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events)
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1) x WHERE NOT gone""")
def resource_as_of(spark, d):
    log = _operations(spark, d).select("resource_type", "id", F.col("seq").alias("txid"), F.expr("case when op = 'remove' then 'deleted' else 'updated' end").alias("status"))
    first, last = log.agg(F.min("txid"), F.max("txid")).first()
    return resources.as_of(log, (first + last) // 2).select("id", "txid")


@query("SELECT DISTINCT resource FROM devicerequest WHERE resource_type = 'DeviceRequest' AND id = (SELECT min(id) FROM devicerequest WHERE resource_type = 'DeviceRequest')")
def resource_by_id(spark, d):
    own = table(spark, d, "devicerequest")
    first = own.where("resource_type = 'DeviceRequest'").agg(F.min("id")).first()[0]
    return lookup.resource(own, first, "DeviceRequest").distinct()


@query("SELECT id FROM devicerequest WHERE resource_type = 'DeviceRequest' ORDER BY id LIMIT 10")
def resource_ids(spark, d):
    return lookup.resource_ids(table(spark, d, "devicerequest"), "DeviceRequest")


@query("""SELECT count(*) AS n FROM relations WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM devicerequest WHERE status = 'deleted' AND id IS NOT NULL))
AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM devicerequest WHERE status = 'deleted' AND id IS NOT NULL))""")
def relations_of_removed(spark, d):
    removed = table(spark, d, "devicerequest").where("status = 'deleted'")
    return resources.drop_relations(table(spark, d, "relations"), removed).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_id, target_id, max(n) AS copies FROM (SELECT source_id, source_type, target_id, target_type, resource, count(*) AS n FROM relations
WHERE source_id IS NOT NULL AND source_type IS NOT NULL AND target_id IS NOT NULL AND target_type IS NOT NULL GROUP BY ALL) x GROUP BY 1, 2""")
def relations_unique(spark, d):
    from knotwork.schema import empty

    raw = table(spark, d, "relations").dropna(subset=["source_id", "source_type", "target_id", "target_type"]).drop("embed_id")
    added = resources.add_relations(empty(spark, "relations"), raw)
    ends = ["source_id", "source_type", "target_id", "target_type"]
    copies = raw.groupBy(*ends, "resource").agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for c in ends:
        same = same & (added[c] == copies[c])
    joined = added.join(copies, same & added["resource"].eqNullSafe(copies["resource"])).select(added["source_id"], added["target_id"], "n")
    return joined.groupBy("source_id", "target_id").agg(F.max("n").alias("copies"))


# Ontologies, bundles, text, export.

# A small ontology over the documents of the nodes table.
_TYPES = {
    "Medication": {"name": "string", "birthDate": "date", "city": "string", "phone": "string", "mrn": "string"},
    "Symptom": {"name": "string", "body": "string"},
    "Organization": {},
    "Memory": {"name": "List[HumanName]", "identifier": "List[Identifier]", "gender": "code", "contact": "ContactPoint"},
    "Bundle": {"type": "code", "entry": "List[BundleEntry]", "total": "int"},
    "DeviceRequest": {"subject": "Patient", "requester": "Practitioner", "note": "List[Annotation]", "identifier": "List[Identifier]"},
    "Observation": {"subject": "Patient", "component": "List[Component]"},
    "Patient": {"name": "List[HumanName]", "gender": "code"},
    "Practitioner": {},
}


@query(f"""WITH n AS (SELECT DISTINCT id, label, {_OK} AS doc FROM nodes),
f AS (SELECT id, label, doc, CASE WHEN json_type(doc) = 'OBJECT' THEN list_sort(list_filter(list_distinct(json_keys(doc)), lambda x: x <> 'id')) ELSE [] END AS fields FROM n)
SELECT DISTINCT id FROM f WHERE label = 'Organization' OR label = 'Practitioner'
OR (label = 'Medication' AND fields = ['birthDate', 'city', 'mrn', 'name', 'phone']) OR (label = 'Symptom' AND fields = ['body', 'name'])
OR (label = 'Memory' AND fields = ['contact', 'gender', 'identifier', 'name']) OR (label = 'Patient' AND fields = ['gender', 'name'])
OR (label = 'Bundle' AND fields = ['entry', 'total', 'type']) OR (label = 'DeviceRequest' AND fields = ['identifier', 'note', 'requester', 'subject'])
OR (label = 'Observation' AND fields = ['component', 'subject'])""")
def ontology_match(spark, d):
    nodes = table(spark, d, "nodes").select("id", "label", "attributes")
    return ontology.match(nodes, ontology.from_types(spark, _TYPES)).where("valid").select("id").distinct()


@query()
def bundle_type_edges(spark, d):
    return bundle.type_edges(table(spark, d, "fhir_transaction"), ontology.from_types(spark, _TYPES))


@query()
def ontology_class_graph(spark, d):
    return ontology.class_graph(ontology.from_types(spark, _TYPES))[1]


@query()
def text_to_graph_rule(spark, d):
    return extract.text_to_graph(table(spark, d, "documents"))[1]


@query(gv.sql("""SELECT a, b, label FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, label, embed_id FROM ge)  x
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY embed_id DESC) = 1"""))
def edge_list_undirected(spark, d):
    return export.undirected_edges(gv.edges(spark, d)).select("a", "b", "label")


@query(gv.sql("""SELECT 0 AS ord, 'digraph {' AS line UNION ALL SELECT 3, '}'
UNION ALL SELECT 1, '  "' || id || '" [label="' || label || '"];' FROM gn
UNION ALL SELECT 2, '  "' || source || '" -> "' || target || '" [label="' || label || '"];' FROM ge"""))
def dot_export(spark, d):
    return export.dot_lines(gv.nodes(spark, d), gv.edges(spark, d))


@query(gv.sql("""SELECT 0 AS ord, 'digraph {' AS line UNION ALL SELECT 3, '}'
UNION ALL SELECT 1, '  "' || id || '" [label="' || label || '"];' FROM gn WHERE id IN (SELECT unnest([source, target]) FROM ge WHERE source = 'n3' OR target = 'n3')
UNION ALL SELECT 2, '  "' || source || '" -> "' || target || '" [label="' || label || '"];' FROM ge WHERE source = 'n3' OR target = 'n3'"""))
def dot_around_node(spark, d):
    return export.dot_around(gv.nodes(spark, d), gv.edges(spark, d), ["n3"])


@query(gv.sql("""SELECT h.n AS head, t.n AS tail, label FROM ge JOIN num h ON h.id = source JOIN num t ON t.id = target""",
"num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM gn) x)"))
def edge_index_arrays(spark, d):
    return export.index_arrays(gv.nodes(spark, d), gv.edges(spark, d))[1]
