"""The graph engine on hand-made graphs: lookups, traversal, changes, merging, resources, export, facade."""

import random
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from knotwork.api import Edge, EdgeInput, GraphDB, KnowledgeGraph, Node, ResourceDB, visualize_graph
from knotwork.functions import typed
from knotwork.functions.jsontext import json_tree, merge, minify
from knotwork.operators import bundle, export, extract, lookup, mutate, ontology, resources, retrieve, traverse, vector
from knotwork.operators import merge as merging
from knotwork.schema import TABLES, empty, wrong_dimension
from knotwork.sources import files
from knotwork.sources.store import SnapshotStore


def edges_of(spark, *pairs):
    rows = [(a, b, "e", "{}", i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "source string, target string, label string, attributes string, embed_id long")


def nodes_of(spark, *ids):
    return spark.createDataFrame([(i, "N", json.dumps({"id": i}), n) for n, i in enumerate(ids)], "id string, label string, attributes string, embed_id long")


JSON_TYPES = ["3", "2.5", '"3"', '"x"', "true", "null", None, "[1]", '{"n":1}']


def typed_rows(spark):
    rows = [(i, "{}" if v is None else f'{{"k": {v}}}') for i, v in enumerate(JSON_TYPES)] + [(9, "no json"), (10, None)]
    return spark.createDataFrame(rows, "embed_id long, attributes string")


@pytest.mark.parametrize(
    "predicate,value,want",
    [("=", 3, {0}), ("=", "3", {2}), ("=", True, {4}), (">", 2, {0, 1, 2, 3, 7, 8}), (">", "3", {3, 7, 8}), ("<", 3, {1, 4}), ("<", "x", {0, 1, 2, 4, 7}), ("LIKE", "%3%", {0, 2}), ("LIKE", "X", {3}), ("=", None, set())],
)
def test_typed_comparison(spark, predicate, value, want):
    if (predicate, value) in ((">", "3"), ("<", "x")):  # lists and objects compare as text
        want = {i for i, t in ((2, "3"), (3, "x"), (7, "[1]"), (8, '{"n":1}')) if (t > value if predicate == ">" else t < value)} | ({0, 1, 4} if predicate == "<" else set())
    assert {r.embed_id for r in typed_rows(spark).where(typed.clause("k", predicate, value)).collect()} == want


def test_order_and_joiners(spark):
    order = [r.embed_id for r in typed_rows(spark).where("embed_id < 7").orderBy(*typed.order_by("k"), "embed_id").collect()]
    assert order == [5, 6, 4, 1, 0, 2, 3]
    assert typed.order_by("") == []
    with pytest.raises(ValueError):
        typed.clause("k", "!=", 1)
    with pytest.raises(ValueError):
        typed.join_clauses([F.lit(True)], ["AND"])


def test_json_text(spark):
    df = spark.createDataFrame([(1, '{"b": [1, {"a": "x"}], "c": null}'), (2, "x"), (3, None), (4, '{"b":')], "r long, d string")
    tree = {(r.fullkey, r.type, r.num, r.text) for r in json_tree(df, "r", "d").collect()}
    assert ("$.b[0]", "number", 1.0, None) in tree and ("$.b[1].a", "text", None, "x") in tree and ("$.c", "null", None, None) in tree
    assert len(tree) == 6
    assert [r.m for r in df.orderBy("r").select(minify("d").alias("m")).collect()] == ['{"b":[1,{"a":"x"}],"c":null}', None, None, None]
    merged = spark.createDataFrame([('{"a":1,"b":2}', '{"b":3}'), (None, '{"a":1}'), ('{"a":1}', None)], "o string, n string")
    assert [r.m for r in merged.select(merge("o", "n").alias("m")).collect()] == ['{"a":1,"b":3}', '{"a":1}', '{"a":1}']


def test_traversal(spark):
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("y", "a"))
    nodes = nodes_of(spark, "a", "b", "c", "d", "y")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(traverse.reachable(nodes, edges, "a")) == {"a", "b", "c", "x"}
    assert ids(traverse.reachable(nodes, edges, "a", "in")) == {"a", "b", "c", "y"}
    assert ids(traverse.reachable(nodes, edges, "a", max_hops=1)) == {"a", "b"}
    assert ids(traverse.reachable(nodes, edges, "a", stop_at="b")) == {"a", "b"}
    assert ids(traverse.reachable(nodes, edges, "nobody")) == set()
    assert ids(traverse.component(edges, "x")) == {"a", "b", "c", "x", "y"}
    path = [r.id for r in traverse.shortest_path(edges, "y", "c").orderBy("step").collect()]
    assert path == ["y", "a", "b", "c"]
    assert traverse.shortest_path(edges, "x", "a").count() == 0
    assert [r.id for r in traverse.shortest_path(edges, "a", "a").collect()] == ["a"]
    derived = edges.groupBy("source", "target").count()
    assert ids(traverse.reachable(nodes, derived, "a")) == {"a", "b", "c", "x"}


def test_bodies_and_neighbours(spark):
    edges = edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("z", "a"), ("a", "b"))
    nodes = nodes_of(spark, "a", "b", "c", "d", "z")
    rows = {(r.id, r.mark) for r in traverse.traverse_bodies(nodes, edges, "d").collect()}
    assert {m for _, m in rows} == {"()", "->", "<-"} and {i for i, m in rows if m == "()"} == {"a", "b", "c", "d", "z"}
    assert ("z", "<-") in rows and ("z", "->") not in rows
    one = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in traverse.neighbours_of(nodes, edges, one, None).collect()} == {"a", "b", "c", "z"}
    assert {r.id for r in traverse.neighbours_of(nodes, edges, one, 1).collect()} == {"a", "b"}
    assert traverse.out_edges(edges, "a", 2).count() == 2 and traverse.in_edges(edges, "a").count() == 1
    assert {r.id: r.degree for r in traverse.degrees(edges).collect()}["a"] == 4


def test_add_nodes_and_edges(spark):
    nodes = nodes_of(spark, "a", "b")
    new = spark.createDataFrame([("b", "X", "{}"), ("c", "X", "{}"), ("c", "Y", "{}"), (None, "X", "{}")], "id string, label string, attributes string")
    grown = mutate.add_nodes(nodes, new)
    assert {(r.id, r.label, r.embed_id) for r in grown.collect()} == {("a", "N", 0), ("b", "N", 1), ("c", "X", 2)}
    more = spark.createDataFrame(
        [("a", "b", "x", '{"k": 1, "j": 2}'), ("a", "b", "y", '{"k":1,"j":2}'), ("a", "b", "x", '{"j":2,"k":1}'), ("a", "gone", "x", "{}"), ("a", "b", "e", " {} ")],
        "source string, target string, label string, attributes string",
    )
    edges = mutate.add_edges(nodes, edges_of(spark, ("a", "b")), more)
    assert sorted(r.attributes for r in edges.collect()) == ['{"j":2,"k":1}', '{"k":1,"j":2}', "{}"]
    replaced = mutate.insert_edges(edges_of(spark, ("a", "b")), more)
    assert {(r.target, r.attributes) for r in replaced.collect()} == {("b", "{}"), ("b", '{"j":2,"k":1}'), ("b", '{"k":1,"j":2}'), ("gone", "{}")}
    assert mutate.next_id(empty(spark, "nodes")) == 1


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(97)).alias("k"), "id")
    got = [(r.k, r.id, r.n) for r in mutate.number_rows(df, "n", 5, "k", "id").collect()]
    assert [n for *_, n in sorted(got)] == list(range(5, 1005))


def test_upsert_and_remove(spark):
    nodes = spark.createDataFrame([("a", "N", '{"x":1,"y":2}', 1), ("b", "N", "{}", 2)], "id string, label string, attributes string, embed_id long")
    new = spark.createDataFrame([("a", "M", '{"y":3}'), ("c", "N", '{"z":1}')], "id string, label string, attributes string")
    rows = {r.id: (r.label, r.attributes) for r in mutate.upsert_nodes(nodes, new).collect()}
    assert rows == {"a": ("M", '{"x":1,"y":3}'), "b": ("N", "{}"), "c": ("N", '{"z":1}')}
    left, edges = mutate.remove_nodes(nodes, edges_of(spark, ("a", "b"), ("b", "b"), ("c", "a")), spark.createDataFrame([("a",), ("q",)], "id string"))
    assert [r.id for r in left.collect()] == ["b"] and [(r.source, r.target) for r in edges.collect()] == [("b", "b")]


def test_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0]), (5, None), (6, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "embed_id long, vector array<float>")
    assert [(r.embed_id, r.distance) for r in vector.nearest(v, [0.0, 0.0], 3).collect()] == [(1, 0.0), (2, 1.0), (6, 1.0)]
    assert [r.embed_id for r in vector.nearest(v, [0.0, 0.0], 3, 1.0).collect()] == [1]
    assert vector.is_unique(v, [9.0, 9.0]) and not vector.is_unique(v, [0.0, 2.1])
    q = spark.createDataFrame([(2, [1.0, 0.0]), (9, [0.0, 1.9]), (10, [1.0])], "query_id long, vector array<float>")
    got = {(r.query_id, r.embed_id) for r in vector.nearest_batch(v, q, 1, exclude_self=True).collect()}
    assert got == {(2, 6), (9, 3), (10, 4)}
    assert {r.query_id for r in vector.unique_batch(v, q, 0.001, True).collect()} == {9}
    assert wrong_dimension(v, 2).count() == 2
    with pytest.raises(ValueError):
        vector.add_vectors(v, v, 2)
    assert vector.hashed_embedding("", 8) == [0.0] * 8 and vector.ClientEmbedder().embed("x") == []


def test_merge_by_similarity(spark):
    nodes = nodes_of(spark, "a", "b", "c", "d")
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [9.0, 9.0])], "embed_id long, vector array<float>")
    edges = spark.createDataFrame(
        [("b", "d", "x", '{"n":1,"t":"p"}', 0), ("d", "c", "y", '{"n":2.5,"t":"q","id":"z"}', 1), ("a", "b", "loop", "{}", 2)],
        "source string, target string, label string, attributes string, embed_id long",
    )
    left, rewired, merged = merging.merge_by_similarity(nodes, edges, v, 0.5, None)
    assert {(r.id, r.survivor) for r in merged.collect()} == {("b", "a"), ("c", "a")}
    rows = {r.id: r for r in left.collect()}
    assert set(rows) == {"a", "d"} and rows["a"].label == "N,x,y,loop,"
    assert json.loads(rows["a"].attributes) == {"id": "z", "n": 3.5, "t": "pq"}
    assert {(r.source, r.target) for r in rewired.collect()} == {("a", "d"), ("d", "a")}
    assert merging.merge_by_similarity(nodes, edges, v, 0.0, None)[0].count() == 4


def test_resource_statuses(spark):
    ops = spark.createDataFrame(
        [("P", "x", op, body, i, dt.datetime(2020, 1, 1)) for i, (op, body) in enumerate([("add", "{1}"), ("add", "{2}"), ("update", "{3}"), ("remove", None), ("remove", None), ("add", "{4}"), ("what", "{}"), ("add", None)])],
        "resource_type string, id string, op string, body string, seq long, ts timestamp",
    )
    current, history = resources.apply_operations(empty(spark, "resources"), empty(spark, "resource_history"), ops)
    assert [(r.txid, r.status, r.resource) for r in history.orderBy("txid").collect()] == [(2, "created", "{1}"), (3, "updated", "{3}"), (4, "deleted", "{3}")]
    assert [(r.txid, r.status, r.resource, r.embed_id) for r in current.collect()] == [(6, "created", "{4}", 1)]
    again = ops.where("seq < 1").withColumn("body", F.lit("{5}"))
    current, history = resources.apply_operations(current, history, again)
    assert [(r.status, r.embed_id, r.txid) for r in current.collect()] == [("recreated", 1, 5)]
    assert history.where("txid = 5").collect()[0].resource == "{4}"


def test_relations(spark):
    new = spark.createDataFrame([("a", "P", "b", "Q", "r", "{}"), ("a", "P", "b", "Q", "s", "{}"), ("c", "P", "b", "Q", "r", "{}")], "source_id string, source_type string, target_id string, target_type string, relation string, resource string")
    made = resources.add_relations(empty(spark, "relations"), new)
    assert made.count() == 2 and resources.add_relations(empty(spark, "relations"), new, True).count() == 1
    with pytest.raises(ValueError):
        resources.add_relations(made, new.withColumn("source_type", F.lit(None).cast("string")))
    assert {r.id for r in traverse.component(traverse.as_edges(made), "a").collect()} == {"a", "b", "c"}
    assert lookup.relation(made, ("c", "P"), ("b", "Q"), " { }").count() == 1
    with pytest.raises(ValueError):
        lookup.resource(empty(spark, "resources"), "x", None)


TYPES = {"Person": {"name": "string"}, "Thing": {}, "Bundle": {"entry": "List[Entry]", "total": "Thing"}, "Patient": {"contact": "List[Person]", "owner": "Thing"}}


def test_ontology(spark):
    onto = ontology.from_types(spark, TYPES)
    new = spark.createDataFrame([("p", "Person", '{"name":"x","id":"p"}'), ("t", "Thing", '{"any":1}')], "id string, label string, attributes string")
    bad = spark.createDataFrame([("q", "Person", '{"nom":"x"}')], "id string, label string, attributes string")
    nodes, edges = ontology.insert_with_ontologies(empty(spark, "nodes"), empty(spark, "edges"), new, [onto])
    assert {(r.source, r.target) for r in edges.collect()} == {("p", "type:Person"), ("t", "type:Thing")}
    with pytest.raises(ValueError, match="does not match"):
        ontology.insert_with_ontologies(nodes, edges, bad, [onto])
    kept, _ = ontology.insert_with_ontologies(nodes, edges, bad.withColumn("id", F.lit("p")), [onto], True)
    assert {r.id for r in kept.collect()} >= {"t"} and "p" not in {r.id for r in kept.collect()}
    with pytest.raises(ValueError):
        ontology.insert_with_ontologies(nodes, edges, new, [])
    assert ontology.type_name("Optional[List[fhir.Coding]]") == "Coding" and ontology.type_name("str") == "str"


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="http://x#Person"/><owl:ObjectProperty rdf:about="http://x#knows"><rdfs:domain rdf:resource="http://x#Person"/><rdfs:range rdf:resource="http://x#Person"/></owl:ObjectProperty></rdf:RDF>"""


def test_sources(spark, tmp_path):
    (tmp_path / "o.rdf").write_text(RDF)
    (tmp_path / "b.json").write_text(json.dumps({"resourceType": "Bundle", "total": 1, "entry": [{"resource": {"resourceType": "Patient", "contact": [{"resourceType": "Person"}], "owner": {}}}]}))
    (tmp_path / "n.json").write_text('{"resourceType": "Patient"}')
    assert ontology.read_rdf(str(tmp_path / "o.rdf")) == {"Person": {"knows": "Person"}}
    with pytest.raises(FileNotFoundError):
        files.read_ontology(spark, str(tmp_path / "none.rdf"))
    with pytest.raises(ValueError, match="not a FHIR Bundle"):
        files.read_bundles(spark, str(tmp_path / "n.json"))
    edges = bundle.type_edges(files.read_bundles(spark, str(tmp_path / "b.json")), ontology.from_types(spark, TYPES))
    assert {tuple(r) for r in edges.collect()} == {("Bundle", "Thing", "total"), ("Bundle", "Patient", "instance_of"), ("Patient", "Person", "contact"), ("Patient", "Thing", "owner")}
    files.write_class_graph(ontology.from_types(spark, TYPES), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 3
    nodes, links = extract.text_to_graph(spark.createDataFrame([(1, "Alice works at Google. Bob is the brother of Alice."), (2, None)], "doc_id long, text string"))
    assert {(r.source, r.label, r.target) for r in links.collect()} == {("Alice", "works_at", "Google"), ("Bob", "is_the_brother_of", "Alice")}


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.initialize()
    assert all(store.read(t).count() == 0 for t in TABLES)
    store.commit(nodes=nodes_of(spark, "a"), edges=edges_of(spark, ("a", "a")))
    store.commit(nodes=nodes_of(spark, "a", "b"))
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again == store and again.read("nodes").count() == 2 and again.read("edges").count() == 1
    assert again.vacuum() == 1 and again.read("nodes").count() == 2
    (tmp_path / "s" / "_LOCK").touch()
    with pytest.raises(RuntimeError):
        store.commit(nodes=nodes_of(spark, "c"))
    with pytest.raises(ValueError):
        store.read("no_such")


def test_facade(spark, tmp_path):
    with GraphDB(spark, SnapshotStore(spark, str(tmp_path / "g"))) as g:
        g.add_nodes([Node(1, "Person", {"name": "Alice"}), Node(2, "Person", {"name": "Bob"}), Node(3, "City", {"name": "Rome"})])
        g.add_node(Node(1, "Other", {"name": "ignored"}))
        g.add_edges([EdgeInput(Node(1, "Person"), Node(2, "Person"), "KNOWS", {"since": 2015}), Edge(2, 3, "LIVES", {}), Edge(1, 99, "NO", {})])
        assert g.search_node(1) == {"name": "Alice", "id": "1"} and g.search_node(9) is None
        assert g.search_node_label(3) == "City" and g.search_node_type("No") is None and g.find_node_type_id("Person") == "1"
        assert g.fetch_ids_from_db() == ["1", "2", "3"]
        assert g.traverse(1) == ["1", "2", "3"] and g.search_outdegree_edges(1)[0][:2] == ("2", "KNOWS")
        assert {n.id for n in g.all_connected_nodes(Node(2, "Person"), None)} == {"1", "2", "3"}
        g.update_node(Node(2, "Person", {"age": 5}))
        assert g.search_node(2) == {"name": "Bob", "id": "2", "age": 5}
        hit = g.search("Alice", threshold=9.0, limit=3, sort_by="name", descending=True)
        assert [json.loads(h["attributes"])["name"] for h in hit] == ["Rome", "Bob", "Alice"]
        assert g.is_unique_prompt("quite different", 0.01)
        near = g.search_from_graph("Alice", threshold=9.0, limit=1)
        assert near.nodes and isinstance(near, KnowledgeGraph)
        assert retrieve.Retriever(g, 1).forward("Rome", 1) is not None
        g.insert("a memory", {"depth": 3})
        kg = g.insert_graph(KnowledgeGraph([Node("x", "L", "t"), Node("y", "L", "u")], [Edge("x", "y", "R", "b")]))
        assert len(kg.nodes) == 2 and g.nodes.count() == 6 and g.edges.count() == 3
        assert g.insert_graph(KnowledgeGraph([Node("x", "L", "t")], [Edge("x", "gone", "R", "b")])).nodes == []
        g.remove_node(2)
        assert g.search_node(2) is None and g.edges.count() == 1
        assert g.store.read("node_vectors").count() == g.nodes.count() and g.store.read("edge_vectors").count() == 1
    with pytest.raises(ValueError):
        Node(1, "")
    with pytest.raises(ValueError):
        g.set_ontologies([])


def test_export(spark, tmp_path):
    edges = edges_of(spark, ("a", "b"), ("b", "a"), ("a", 'q"x'))
    rows = {(r.a, r.b, r.label) for r in export.undirected_edges(edges).collect()}
    assert rows == {("a", "b", "e"), ("a", 'q"x', "e")}
    nodes = spark.createDataFrame([("a", "A", '{"k":1,"hide":2}', 0), ('q"x', None, "{}", 1)], "id string, label string, attributes string, embed_id long")
    lines = [r.line for r in export.dot_lines(nodes, edges).orderBy("ord", "line").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and '  "a" -> "q\\"x" [label="e"];' in lines
    assert nodes.select(export.label_of(exclude=["hide"]).alias("l")).first().l == "k 1"
    index, pairs = export.index_arrays(nodes, edges)
    assert {(r["head"], r["tail"]) for r in pairs.collect()} == {(0, 1)} and index.count() == 2
    dot = export.dot_of_bodies([("a", "()", "x"), ("b", "->", "y"), ("c", "<-", "z")])
    assert '"a" -> "b"' in dot and '"c" -> "a"' in dot
    assert visualize_graph(spark, KnowledgeGraph([Node(1, "L")], [])).count() == 3
    files.write_lines(export.dot_around(nodes, edges, ["a"]), str(tmp_path / "d"))

    class Small:
        def nodes(self, data):
            return [(1, {"label": "L", "k": 2})]

        def edges(self, data):
            return [(1, 1, {"label": "E", "attributes": "{}"})]

    n, e = export.from_networkx(spark, Small())
    assert n.first().attributes == '{"k": 2}' and e.first().label == "E"


def test_streaming(spark, tmp_path):
    from knotwork.streaming import ingest

    schema = "id string, txid long, ts timestamp, status string, resource_type string, resource string"
    feed = str(tmp_path / "feed")
    store = SnapshotStore(spark, str(tmp_path / "s"))

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        source = spark.readStream.schema(schema).parquet(feed)
        ingest.stream_changes(source, store, str(tmp_path / "c")).awaitTermination()

    batch([("a", 2, None, "deleted", "R", None), ("b", 1, None, "created", "R", "{}")])
    batch([("a", 1, None, "created", "R", "{}"), ("b", 2, None, "updated", "R", '{"x":1}'), ("b", 1, None, "created", "R", "{}")])
    assert [(r.id, r.txid, r.resource) for r in ingest.live(store.read("resources")).collect()] == [("b", 2, '{"x":1}')]


def test_resource_facade(spark, tmp_path):
    db = ResourceDB(spark, SnapshotStore(spark, str(tmp_path / "r")), validate=lambda x: "bad" not in x)
    db.add_node("Patient", {"name": "Ann"}, 1)
    db.add_node("Patient", {"bad": 1}, 2)
    db.update_node("Patient", {"name": "Anna"}, 1)
    db.add_node("Device", {"kind": "pump"}, "d")
    with pytest.raises(ValueError):
        db.update_node("Patient", {"bad": 1}, 1)
    with pytest.raises(ValueError):
        db.search_node(1, None)
    assert db.search_node(1, "Patient") == {"name": "Anna"} and db.search_node(2, "Patient") is None
    assert db.search_node_type("device") and not db.search_node_type("Other") and db.fetch_ids_from_db("Patient") == ["1"]
    assert db.history("Patient", 1) == [(1, "updated", {"name": "Anna"})]
    db.add_edge(Node("d", "Device"), Node(1, "Patient"), "used_by")
    assert db.traverse("d", 1) == ["d", "1"] and db.traverse("d") == [] and db.all_connected_nodes(1) == ["1", "d"]
    assert db.search_indegree_edges(1) == [("d", "device", "{}")] and len(db.get_connections("d")) == 1
    assert [h["id"] for h in db.search("pump", "Device", 9.0)] == ["d"]
    db.remove_node("Patient", 1)
    assert db.search_node(1, "Patient") is None and db.get_connections("d") == []
    assert db.history("Patient", 1)[-1][1] == "deleted"
    assert db.store.read("resource_vectors").count() == 1


def test_upsert_merge_keeps_long_documents(spark, tmp_path):
    from knotwork.plans import graph_queries

    props = json.dumps({"pad": "x" * 1200, "k": 5})
    rows = [(1, 7, "view", "{}"), (2, 7, "buy", props), (4, 8, "buy", props)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.a, r.b, r.k) for r in graph_queries.upsert_merge(spark, str(tmp_path)).collect()}
    assert got == {"u7": ("buy", "view", "5"), "u8": ("buy", None, "5")}


def test_edges_with_other_text_are_kept(spark):
    more = spark.createDataFrame([("a", "b", "x", "no json"), ("a", "b", "x", "nor this")], "source string, target string, label string, attributes string")
    got = mutate.insert_edges(edges_of(spark, ("a", "b")).where("false"), more).collect()
    assert {r.attributes for r in got} == {"no json", "nor this"}


def test_vectors_repeated_and_tied(spark):
    shape = "embed_id long, vector array<float>"
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<float>")
    rows = [(7, [0.0, 1.0])] * 12 + [(8, [0.0, 2.0]), (9, [0.0, 3.0]), (10, [0.0, 4.0])]
    twice = spark.createDataFrame(rows, shape).coalesce(1)
    assert [(r.embed_id, r.distance) for r in vector.nearest_batch(twice, q, 3).orderBy("distance").collect()] == [(7, 1.0), (8, 4.0), (9, 9.0)]
    mirrored = spark.createDataFrame([(7, [0.0, 1.0]), (7, [0.0, -1.0]), (7, [1.0, 0.0]), *rows[12:]], shape).coalesce(1)
    assert {r.embed_id for r in vector.nearest_batch(mirrored, q, 3).collect()} == {7, 8, 9}
    tied = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(600, 0, -1)] + [(0, [5.0, 5.0])], shape).coalesce(1)
    assert {r.embed_id for r in vector.nearest_batch(tied, q, 3).collect()} == {1, 2, 3}


def test_component_of_a_long_path_takes_few_rounds(spark, monkeypatch):
    n, writes = 500, []
    rng = random.Random(5)
    names = [f"v{rng.randrange(10**9):09d}" for _ in range(n)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])] + [("x", "y"), ("z", "z"), (None, "x")], "source string, target string")
    whole = traverse.spool_counted
    monkeypatch.setattr(traverse, "spool_counted", lambda df, **marks: writes.append(1) or whole(df, **marks))
    assert {r.id for r in traverse.component(edges, names[200]).collect()} == set(names)
    assert len(writes) <= 16
    assert {r.id for r in traverse.component(edges, "y").collect()} == {"x", "y"}
    assert [r.id for r in traverse.component(edges, "z").collect()] == ["z"]
    assert [r.id for r in traverse.component(edges, "nowhere").collect()] == ["nowhere"]


@pytest.mark.parametrize("small", [200_000, 0])
def test_hops_against_breadth_first_search(spark, monkeypatch, small):
    monkeypatch.setattr(traverse, "SMALL", small)
    monkeypatch.setattr(traverse, "PIECES", 2)
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)] + [("n0", "n0"), ("n0", None)]
    edges, seeds = spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([("n0",), ("n1",), (None,)], "id string")
    want, frontier, hop = {"n0": 0, "n1": 0}, {"n0", "n1"}, 0
    while frontier:
        hop += 1
        frontier = {b for a, b in pairs if a in frontier and b is not None and b not in want}
        want |= {x: hop for x in frontier}
    got = traverse.hops(edges, seeds).collect()
    assert {r.id: r.hop for r in got} == want and len(got) == len(want)
    assert all(r.via is None if r.hop == 0 else (r.via, r.id) in set(pairs) and want[r.via] == r.hop - 1 for r in got)
    assert {r.id: r.hop for r in traverse.hops(edges, seeds, max_hops=2).collect()} == {k: h for k, h in want.items() if h <= 2}


def test_fold_keeps_kinds(spark):
    """Lists become one list, single values stay, objects and mixed kinds stand in a list, in edge order."""
    rows = [
        ("s", 1, 0, "l", '{"tags": ["a"], "one": true, "n": 1, "t": "x", "o": {"p": 1}, "m": [1], "none": null, "yes": true, "e": [], "solo": {"q": [2]}}'),
        ("s", 2, 0, "l", '{"tags": ["b", {"c": 1}], "n": 2.5, "t": 3, "o": {"p": 2}, "m": "z", "none": null, "yes": true, "e": []}'),
        ("s", 5, 1, "l", "not json"), ("s", 3, 0, "l", None), ("s", 4, 0, "l", "[1]"),
    ]
    folded = merging.fold_attributes(spark.createDataFrame(rows, "survivor string, embed_id long, end int, label string, attributes string"))
    got = {r.key: json.loads(r.json) for r in folded.collect()}
    assert got == {
        "tags": ["a", "b", {"c": 1}], "one": True, "n": 3.5, "t": "x3", "o": [{"p": 1}, {"p": 2}], "m": [[1], "z"], "yes": 2, "e": [], "solo": {"q": [2]},
    }


def test_hub_labels_are_joined_in_order(spark):
    rows = [("hub" if i % 3 else f"s{i}", i, 0, f"l{i}", None) for i in range(3000)]
    random.Random(1).shuffle(rows)
    touching = spark.createDataFrame(rows, "survivor string, embed_id long, end int, label string, attributes string").repartition(7)
    nodes = spark.createDataFrame([("hub", "H")], "id string, label string")
    assert merging.fold_labels(nodes, touching).first().label == "H," + "".join(f"l{i}," for i in range(3000) if i % 3)
