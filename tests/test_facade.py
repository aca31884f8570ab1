"""Contracts, schemas, collections, foreign graphs, bundles in many files."""

import json

import pytest
from pyspark.sql import functions as F

from knotwork import contracts
from knotwork.api import Edge, GraphDB, Node, ResourceDB
from knotwork.functions import jsonschema
from knotwork.operators import collection, export, ontology, retrieve, vector
from knotwork.session import shared_dir
from knotwork.sources import files
from knotwork.sources.store import SnapshotStore

PATIENT = {
    "type": "object", "required": ["name"], "additionalProperties": False,
    "properties": {"name": {"type": "string", "minLength": 1}, "age": {"type": "integer", "minimum": 0}, "kin": {"type": "array", "items": {"$ref": "#"}}},
}


@pytest.mark.parametrize(
    ("value", "ok"),
    [
        ({"name": "a"}, True), ({"name": ""}, False), ({}, False), ({"name": "a", "x": 1}, False), ({"name": "a", "age": 3.0}, True),
        ({"name": "a", "age": True}, False), ({"name": "a", "age": -1}, False), ({"name": "a", "kin": [{"name": "b"}]}, True),
        ({"name": "a", "kin": [{"nam": "b"}]}, False), ([], False), (None, False),
    ],
)
def test_schema(value, ok):
    assert jsonschema.is_valid(value, PATIENT) is ok


def test_schema_keywords():
    ok = jsonschema.is_valid
    assert ok("ab", {"pattern": "^a", "enum": ["ab", 1]}) and not ok(True, {"enum": [1]}) and not ok(1, {"const": True})
    assert ok(3, {"oneOf": [{"minimum": 2}, {"maximum": 1}]}) and not ok(3, {"oneOf": [{"minimum": 2}, {"minimum": 1}]})
    assert ok(3, {"not": {"type": "string"}}) and not ok(3, {"allOf": [{"exclusiveMinimum": 3}]}) and ok({"x1": 2}, {"patternProperties": {"^x": {"type": "number"}}})
    assert not ok({"x1": "2"}, {"patternProperties": {"^x": {"type": "number"}}}) and not ok([1], {"minItems": 2}) and ok(None, {"type": ["null", "string"]})
    assert ok(1, True) and not ok(1, False)


def test_schema_column(spark):
    rows = [("p", '{"name": "a"}'), ("p", "{}"), ("q", "{}"), ("q", "[]"), ("p", None), ("p", "{")]
    df = spark.createDataFrame(rows, "kind string, doc string")
    assert [r.v for r in df.select(jsonschema.meets_by_type("doc", "kind", {"p": PATIENT}).alias("v")).collect()] == [True, False, True, False, False, False]
    nodes = spark.createDataFrame([("1", "P", '{"name": "a"}'), ("2", "P", "{}"), ("3", "other", "{}"), ("4", None, "{}")], "id string, label string, attributes string")
    assert [r.id for r in ontology.match_schemas(nodes, {"P": PATIENT}).where("valid").collect()] == ["1"]


def test_resources_are_validated_by_type(spark, tmp_path):
    db = ResourceDB(spark, SnapshotStore(spark, str(tmp_path / "r")), schemas={"patient": PATIENT})
    db.add_node("Patient", {"nam": "x"}, 1)
    assert db.search_node(1, "Patient") is None
    db.add_node("Patient", {"name": "x"}, 1)
    with pytest.raises(ValueError):
        db.update_node("Patient", {"name": ""}, 1)
    assert db.search_node(1, "Patient") == {"name": "x"}


def test_contracts():
    assert isinstance(vector.HashingEmbedder(), contracts.Embedder) and issubclass(SnapshotStore, contracts.TableStore)

    class Fake:
        def embed(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

        def chat(self, messages, **options):
            return messages[-1]["content"].upper()

        def extract(self, text):
            return {"nodes": [{"id": 1, "label": text}], "edges": []}

    assert isinstance(Fake(), contracts.EmbeddingClient) and isinstance(Fake(), contracts.ChatClient) and isinstance(Fake(), contracts.ExtractionClient)
    assert vector.ClientEmbedder(Fake(), 2).embed("abc") == [3.0, 0.0]


class Foreign:
    """A graph of another program, as far as it is looked at."""

    def __init__(self, nodes, edges):
        self._nodes, self._edges = nodes, edges

    def nodes(self, data):
        return self._nodes

    def edges(self, data):
        return self._edges


def test_foreign_graph(spark, tmp_path):
    with GraphDB(spark, SnapshotStore(spark, str(tmp_path / "g"))) as g:
        g.add_nodes([Node("a", "Old", {"x": 1}), Node("b", "Old", {}), Node("c", "Old", {})])
        g.add_edge(Edge("a", "c", "WAS", {}))
        g.from_networkx(Foreign([("a", {"label": "New", "y": 2}), ("b", {"label": "New"})], [("a", "b", {"label": "IS", "w": 3})]), override=False)
        assert g.search_node("a") == {"x": 1, "y": 2, "id": "a"} and g.edges.count() == 2
        g.from_networkx(Foreign([("a", {"label": "Newer", "z": 3})], []))
        assert g.search_node("a") == {"z": 3, "id": "a"} and g.edges.count() == 0 and g.nodes.count() == 3
        assert g.store.read("node_vectors").count() == 3 and g.store.read("edge_vectors").count() == 0
    assert export.edge_data("L", '{"since": 1, "label": "x"}') == {"since": 1, "label": "L"}
    assert export.edge_data("L", "text") == {"label": "L", "attributes": "text"} and export.edge_data(None, None) == {"label": None, "attributes": None}


def test_node_text_is_one_object(spark):
    rows = spark.createDataFrame([("1", "L", '{"a": {"b": 1}}'), ("2", "L", "text"), ("3", None, None)], "id string, label string, attributes string")
    got = [json.loads(r.t) for r in rows.select(vector.node_text().alias("t")).collect()]
    assert got == [{"a": {"b": 1}, "id": "1", "label": "L"}, {"attributes": "text", "id": "2", "label": "L"}, {"id": "3"}]


def test_every_bundle_is_checked(spark, tmp_path):
    good = json.dumps({"resourceType": "Bundle", "entry": []})
    for name, text in (("a", good), ("b", json.dumps(good)), ("c", good)):
        (tmp_path / f"{name}.json").write_text(text)
    assert files.read_bundles(spark, str(tmp_path)).count() == 3
    (tmp_path / "bb.json").write_text('{"resourceType": "Patient"}')
    with pytest.raises(ValueError, match="bb.json"):
        files.read_bundles(spark, str(tmp_path))
    assert files.read_bundles(spark, str(tmp_path), check=False).count() == 4


def test_collection(spark):
    rows = spark.createDataFrame(
        [("1_0", "node", '{"embed_id": 1}', [0.0, 1.0]), ("2", "node", '{"embed_id": 2}', [0.0, 2.0]), ("2", "edge", "{}", [0.0, 3.0]), ("x_y_12", "edge", None, [0.0, 1.0, 2.0])],
        collection.COLLECTION,
    )
    found = [(r.kind, r.id) for r in collection.search(rows, [0.0, 0.0], 9).collect()]
    assert found == [("node", "1"), ("node", "2"), ("edge", "2")]
    assert [r.id for r in collection.search(rows, [0.0, 0.0], 2, 2.0).collect()] == ["1"]
    assert [(r.kind, r.id) for r in collection.search(rows, [0.0, 0.0], 9, sort_by="embed_id", descending=True).collect()] == [("node", "2"), ("node", "1"), ("edge", "2")]
    assert collection.search(rows.where("false"), [0.0], 3).count() == 0
    again = collection.add(rows, rows.where("kind = 'edge'").withColumn("metadata", F.lit("new")))
    assert again.count() == 4 and again.where("metadata = 'new'").count() == 2
    assert collection.delete(rows, spark.createDataFrame([("node", "1"), ("edge", "x_y")], "kind string, id string")).count() == 2
    assert spark.range(1).select(collection.whole_id(F.lit("a_b_3"))).first()[0] == "a_b"
    queries = spark.createDataFrame([(7, [0.0, 2.0])], "query_id long, vector array<float>")
    assert [r.embed_id for r in collection.search_batch(rows, queries, 1, kind="node").collect()] == [2]


def test_retrieve_batch(spark):
    nodes = spark.createDataFrame([("a", '{"n":1}', 1), ("b", '{"n":2}', 2), ("c", '{"n":3}', 3)], "id string, attributes string, embed_id long")
    edges = spark.createDataFrame([("a", "b"), ("c", "gone"), (None, "a")], "source string, target string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [9.0, 0.0])], "embed_id long, vector array<float>")
    queries = spark.createDataFrame([(10, [0.0, 1.1]), (20, [9.0, 0.1]), (30, [50.0, 50.0])], "query_id long, vector array<float>")
    got = {(r.query_id, r.id) for r in retrieve.retrieve_batch(nodes, edges, vectors, queries).collect()}
    assert got == {(10, "a"), (10, "b"), (20, "c")}


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return type("None_", (), {"isDefined": staticmethod(lambda: False)})

    fake = type("Session", (), {"conf": type("Conf", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": Context})
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_rows_are_appended(spark, tmp_path, monkeypatch):
    from knotwork.sources import store as module

    monkeypatch.setattr(module, "PARTS", 2)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(f"n{i}", i)], "id string, embed_id long")
    for i in range(5):
        store.append(nodes=row(i), node_vectors=spark.createDataFrame([(i, [1.0])], "embed_id long, vector array<float>"))
        assert sorted(r.embed_id for r in store.read("nodes").collect()) == list(range(i + 1)) and store.read("node_vectors").count() == i + 1
        assert len(store._pointer()["nodes"]) <= 2
    store.commit(nodes=row(9))
    assert [r.id for r in store.read("nodes").collect()] == ["n9"] and store.vacuum() > 0 and store.read("node_vectors").count() == 5
    memory = SnapshotStore(spark)
    memory.append(nodes=row(1))
    memory.append(nodes=row(2))
    assert memory.read("nodes").count() == 2


def test_single_inserts_write_only_what_is_new(spark, tmp_path):
    with GraphDB(spark, SnapshotStore(spark, str(tmp_path / "g"))) as g:
        g.add_nodes([Node("a", "L", {}), Node("b", "L", {})])
        first = g.store._pointer()["nodes"]
        g.add_nodes([Node("b", "other", {}), Node("c", "L", {})])
        assert g.store._pointer()["nodes"][: len(first)] == first
        g.add_edge(Edge("a", "b", "R", {}))
        g.add_edge(Edge("a", "gone", "R", {}))
        assert g.nodes.count() == 3 and g.edges.count() == 1 and g.search_node_label("b") == "L"
        assert g.store.read("node_vectors").count() == 3 and g.store.read("edge_vectors").count() == 1


def test_a_hot_resource_spans_partitions(spark):
    """One resource has most operations; every step follows from the one before it, wherever partitions end."""
    import random

    from knotwork.operators import resources
    from knotwork.schema import empty

    rng = random.Random(2)
    ops = [("T", "hot" if rng.random() < 0.8 else f"r{rng.randrange(9)}", rng.choice(["add", "update", "remove"]), f'{{"n":{i}}}', i, None) for i in range(900)]
    df = spark.createDataFrame(ops, "resource_type string, id string, op string, body string, seq long, ts timestamp")
    _, history = resources.apply_operations(empty(spark, "resources"), empty(spark, "resource_history"), df)
    want, state = [], {}
    for i, (_, own, op, body, _, _) in enumerate(ops):
        held = state.get(own)
        if op == "add" and held is not None:
            want.append((own, i + 1, "created", held))
        elif op == "update":
            want.append((own, i + 1, "updated", body))
        elif op == "remove" and held is not None:
            want.append((own, i + 1, "deleted", held))
        state[own] = None if op == "remove" else body
    assert sorted((r.id, r.txid, r.status, r.resource) for r in history.collect()) == sorted(want)
