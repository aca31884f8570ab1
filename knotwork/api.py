"""The graph database facade: single calls over the batch operators, collecting only at the edge."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import jsonschema
from knotwork.operators import bundle, export, extract, lookup, merge, mutate, ontology, resources, retrieve, traverse, vector
from knotwork.sources import files
from knotwork.session import ship, spool
from knotwork.sources.store import SnapshotStore


def _document(attributes: str | dict) -> str:
    return attributes if isinstance(attributes, str) else json.dumps(attributes)


@dataclass(frozen=True)
class Node:
    id: int | str
    label: str
    attributes: str | dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if not self.label:
            raise ValueError("label must not be empty")


@dataclass(frozen=True)
class Edge:
    source: int | str
    target: int | str
    label: str
    attributes: str | dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if not self.label:
            raise ValueError("label must not be empty")


@dataclass(frozen=True)
class EdgeInput:
    source: Node
    target: Node
    label: str
    attributes: str | dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class KnowledgeGraph:
    nodes: list[Node]
    edges: list[Edge]


class GraphDB:
    """A property graph with one vector per node and edge, over a `SnapshotStore`."""

    def __init__(
        self, spark: SparkSession, store: SnapshotStore | None = None, embedder=None, extractor=extract.rule_extractor,
        ontologies: list[DataFrame] | None = None,
    ) -> None:
        self.spark = ship(spark)
        self.store = store or SnapshotStore(spark)
        self.embedder = embedder or vector.HashingEmbedder()
        self.extractor, self.ontologies = extractor, ontologies or []
        self.store.initialize()

    def __enter__(self) -> GraphDB:
        self.store.initialize()
        return self

    def __exit__(self, *_: object) -> None:
        self.save()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, GraphDB) and self.store == other.store

    __hash__ = None  # type: ignore[assignment]

    def save(self) -> None:
        """Every change is committed when it is made; old versions are cleared."""
        self.store.vacuum()

    def set_ontologies(self, ontologies: list[DataFrame] | None) -> None:
        if not ontologies:
            raise ValueError("no ontology given")
        self.ontologies = ontologies

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def _node_rows(self, nodes: list[Node]) -> DataFrame:
        rows = [(i, str(n.id), n.label, _document(n.attributes)) for i, n in enumerate(nodes)]
        df = self.spark.createDataFrame(rows, "_at int, id string, label string, attributes string")
        return df.withColumn("attributes", mutate.with_own_id())

    def _commit(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        """Commit tables and vectors together: vectors of gone embed_ids leave, new rows are embedded."""
        tables = {"nodes": spool(nodes)} | ({} if edges is None else {"edges": spool(edges)})  # made once for both
        for name, text in (("nodes", vector.node_text()), ("edges", vector.edge_text())):
            if name in tables:
                vectors = f"{name[:-1]}_vectors"
                rows = tables[name]
                have = self.store.read(vectors).join(rows.select("embed_id"), "embed_id", "left_semi")
                new = rows.join(have.select("embed_id"), "embed_id", "left_anti")
                tables[vectors] = have.unionByName(new.select("embed_id", self.embedder.column(text).alias("vector")))
        self.store.commit(**tables)

    def _grow(self, nodes: DataFrame | None, edges: DataFrame | None = None) -> None:
        """Append what the grown tables hold beyond the stored ones, with its vectors; only new rows are written."""
        tables: dict[str, DataFrame] = {}
        for name, grown, text in (("nodes", nodes, vector.node_text()), ("edges", edges, vector.edge_text())):
            if grown is not None:
                tables[name] = spool(grown.join(self.store.read(name).select("embed_id"), "embed_id", "left_anti"))
                tables[f"{name[:-1]}_vectors"] = tables[name].select("embed_id", self.embedder.column(text).alias("vector"))
        self.store.append(**tables)

    # changes

    def add_node(self, node: Node, delete_if_properties_not_match: bool = False) -> None:
        self.add_nodes([node], delete_if_properties_not_match)

    def add_nodes(self, nodes: list[Node], delete_if_properties_not_match: bool = False) -> None:
        rows = self._node_rows(nodes)
        if self.ontologies:
            self._commit(*ontology.insert_with_ontologies(self.nodes, self.edges, rows.drop("_at"), self.ontologies, delete_if_properties_not_match))
        else:
            self._grow(mutate.add_nodes(self.nodes, rows, "_at").drop("_at"))

    def add_edge(self, edge: EdgeInput | Edge) -> None:
        self.add_edges([edge])

    def add_edges(self, edges: list[EdgeInput | Edge]) -> None:
        end = lambda x: str(x.id) if isinstance(x, Node) else str(x)
        rows = [(i, end(e.source), end(e.target), e.label, _document(e.attributes)) for i, e in enumerate(edges)]
        new = self.spark.createDataFrame(rows, "_at int, source string, target string, label string, attributes string")
        self._grow(None, mutate.add_edges(self.nodes, self.edges, new, "_at").drop("_at"))

    insert_edge = add_edge

    def update_node(self, node: Node) -> None:
        self.update_nodes([node])

    def update_nodes(self, nodes: list[Node]) -> None:
        self._commit(mutate.upsert_nodes(self.nodes, self._node_rows(nodes).drop("_at")))

    def remove_node(self, node_id: int | str) -> None:
        self.remove_nodes([node_id])

    def remove_nodes(self, ids: list[int | str]) -> None:
        gone = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        self._commit(*mutate.remove_nodes(self.nodes, self.edges, gone))

    def add_node_type(self, node_id: int | str, node_type: str, attributes: dict | None = None) -> None:
        self._commit(mutate.add_node_type(self.nodes, self._node_rows([Node(node_id, node_type, attributes or {})]).drop("_at")))

    def insert(self, text: str, attributes: dict | str, node_id: str | None = None) -> None:
        self.add_node(Node(node_id or str(uuid.uuid4()), text, attributes))

    def insert_graph(self, graph: KnowledgeGraph) -> KnowledgeGraph:
        """Adds the graph under fresh ids. An edge with an unknown end gives an empty graph back; nodes stay."""
        new_nodes = self._plain_nodes(graph.nodes)
        new_edges = self.spark.createDataFrame(
            [(str(e.source), str(e.target), e.label, _document(e.attributes)) for e in graph.edges],
            "source string, target string, label string, attributes string",
        )
        nodes, edges, unknown = mutate.remap_graph(new_nodes, new_edges)
        nodes = nodes.withColumn("attributes", mutate.with_own_id())
        grown = mutate.add_nodes(self.nodes, nodes)
        self._grow(grown, mutate.add_edges(grown, self.edges, edges))
        return graph if unknown.isEmpty() else KnowledgeGraph([], [])

    def _plain_nodes(self, nodes: list[Node]) -> DataFrame:
        rows = [(str(n.id), n.label, _document(n.attributes)) for n in nodes]
        return self.spark.createDataFrame(rows, "id string, label string, attributes string")

    def insert_from_fhir_json_bundle(self, path: str, types: dict[str, dict[str, str]]) -> GraphDB:
        bundles = files.read_bundles(self.spark, str(path))
        edges = bundle.type_edges(bundles, ontology.from_types(self.spark, types)).withColumn("attributes", F.lit("{}"))
        nodes = mutate.add_node_type(self.nodes, bundle.type_nodes(edges))
        self._commit(nodes, mutate.add_edges(nodes, self.edges, edges))
        return self

    def merge_by_similarity(self, threshold: float = 0.9, limit: int | None = 10) -> None:
        nodes, edges, _ = merge.merge_by_similarity(self.nodes, self.edges, self.store.read("node_vectors"), threshold, limit)
        self._commit(nodes, edges)

    def from_networkx(self, graph, override: bool = True) -> GraphDB:
        """Take in another program's graph. ``override``: its nodes, and their edges, are removed first and made anew;
        else nodes are updated and edges added beside what is there."""
        new, links = export.from_networkx(self.spark, graph)
        nodes, edges = self.nodes, self.edges
        if override:
            nodes, edges = mutate.remove_nodes(nodes, edges, new.select("id"))
        nodes = mutate.upsert_nodes(nodes, new.withColumn("attributes", mutate.with_own_id()))
        self._commit(nodes, mutate.add_edges(nodes, edges, links))
        return self

    def to_networkx(self, limit: int | None = 10):
        return export.to_networkx(self.nodes, self.edges, limit)

    # lookups

    def _first(self, rows: DataFrame) -> Any:
        found = rows.first()
        return None if found is None else found[0]

    def search_node(self, node_id: int | str) -> dict | None:
        found = self._first(lookup.node_by_id(self.nodes, node_id))
        return None if found is None else json.loads(found)

    def search_node_label(self, node_id: int | str, limit: int = 1) -> str | None:
        return self._first(lookup.node_label(self.nodes, node_id, limit))

    def search_node_type(self, label: str) -> str | None:
        return self._first(lookup.node_type(self.nodes, label))

    def find_node_type_id(self, label: str) -> str | None:
        return self._first(lookup.id_by_type(self.nodes, label))

    def fetch_ids_from_db(self, limit: int | None = 10) -> list[str]:
        return [r.id for r in lookup.ids(self.nodes, limit).collect()]

    def search_indegree_edges(self, target: int | str, limit: int | None = 10) -> list[tuple]:
        return [tuple(r) for r in traverse.in_edges(self.edges, target, limit).collect()]

    def search_outdegree_edges(self, source: int | str, limit: int | None = 10) -> list[tuple]:
        return [tuple(r) for r in traverse.out_edges(self.edges, source, limit).collect()]

    def get_connections(self, node_id: int | str) -> list[tuple]:
        return [tuple(r) for r in traverse.incident_edges(self.edges, node_id).collect()]

    def all_connected_nodes(self, of: Node | Edge, limit: int | None = 1) -> list[Node]:
        ids = [str(of.id)] if isinstance(of, Node) else [str(of.source), str(of.target)]
        near = traverse.neighbours_of(self.nodes, self.edges, self.spark.createDataFrame([(i,) for i in ids], "id string"), limit)
        return [Node(r.id, r.label, json.loads(r.attributes)) for r in near.collect()]

    def traverse(self, source: int | str, target: int | str | None = None, with_bodies: bool = False) -> list:
        if with_bodies:
            return [tuple(r) for r in traverse.traverse_bodies(self.nodes, self.edges, source).collect()]
        found = traverse.reachable(self.nodes, self.edges, source, stop_at=None if target is None else str(target))
        return [r.id for r in found.orderBy("hop", "id").collect()]

    # similarity

    def _query(self, text: str) -> list[float]:
        return self.embedder.embed(vector.query_text(text))

    def search(self, text: str, threshold: float = 0.9, descending: bool = False, limit: int = 1, sort_by: str = "") -> list[dict]:
        hits = vector.search_nodes(self.nodes, self.store.read("node_vectors"), self._query(text), limit, threshold, sort_by, descending)
        return [r.asDict() for r in hits.collect()]

    def is_unique_prompt(self, text: str, threshold: float = 0.9) -> bool:
        return vector.is_unique(self.store.read("node_vectors"), self._query(text), threshold)

    def find_nodes_like(self, label: str, threshold: float = 0.9) -> list[Node]:
        near = retrieve.nodes_like(self.nodes, self.store.read("node_vectors"), label, self.embedder, threshold)
        return [Node(r.id, r.label, json.loads(r.attributes)) for r in near.collect()]

    def search_from_graph(self, text: str, threshold: float = 0.9, limit: int = 1, neighbour_limit: int | None = None, as_frames: bool = False):
        nodes, edges = retrieve.search_subgraph(
            self.nodes, self.edges, self.store.read("node_vectors"), self.store.read("edge_vectors"), self._query(text), limit, threshold, neighbour_limit
        )
        if as_frames:
            return nodes, edges
        return KnowledgeGraph(
            [Node(r.id, r.label, json.loads(r.attributes)) for r in nodes.collect()],
            [Edge(r.source, r.target, r.label, json.loads(r.attributes)) for r in edges.collect()],
        )

    # text and drawings

    def text_to_graph(self, text: str) -> KnowledgeGraph:
        nodes, edges = self.extractor(text)
        return KnowledgeGraph([Node(*n) for n in nodes], [Edge(*e) for e in edges])

    def visualize(self, path: str, node_ids: list[str]) -> None:
        files.write_lines(export.dot_around(self.nodes, self.edges, [str(i) for i in node_ids]), path)


class ResourceDB:
    """Versioned resources with relations and vectors, over a `SnapshotStore`.

    ``schemas`` are JSON Schemas by type (lower case): a document must meet that of its type, one of another type be
    an object. ``validate`` says besides whether a document may be stored. A new one that may not is passed over, an
    update is an error.
    """

    def __init__(
        self, spark: SparkSession, store: SnapshotStore | None = None, embedder=None, validate=None, schemas: dict[str, Any] | None = None
    ) -> None:
        self.spark = ship(spark)
        self.store = store or SnapshotStore(spark)
        self.embedder = embedder or vector.HashingEmbedder()
        self.validate, self.schemas = validate or (lambda document: True), schemas or {}
        self.store.initialize()

    def _may(self, label: str, document: Any) -> bool:
        return jsonschema.is_valid(document, self.schemas.get(label.lower(), {"type": "object"})) and self.validate(document)

    def _apply(self, op: str, kind: str, resource_id: int | str, document: dict | None) -> None:
        row = [(kind.lower(), str(resource_id), op, None if document is None else json.dumps(document), 0)]
        ops = self.spark.createDataFrame(row, "resource_type string, id string, op string, body string, seq long")
        ops = ops.withColumn("ts", F.current_timestamp())
        current, history = resources.apply_operations(self.store.read("resources"), self.store.read("resource_history"), ops)
        tables = {"resources": current, "resource_history": history}
        if op == "remove":
            tables["relations"] = resources.drop_relations(self.store.read("relations"), ops.select("id"))
        self.store.commit(**tables)
        self._embed()

    def _embed(self) -> None:
        """Vectors of gone resources leave, resources without one get theirs; a recreated one keeps its vector."""
        own, have = self.store.read("resources"), self.store.read("resource_vectors")
        keys = ["resource_type", "embed_id"]
        kept = have.join(own.select(*keys), keys, "left_semi")
        new = own.join(kept.select(*keys), keys, "left_anti")
        self.store.commit(resource_vectors=kept.unionByName(new.select(*keys, self.embedder.column(F.col("resource")).alias("vector"))))

    def add_node(self, label: str, document: dict, node_id: int | str) -> None:
        if self._may(label, document):
            self._apply("add", label, node_id, document)

    def update_node(self, label: str, document: dict, node_id: int | str) -> None:
        if not self._may(label, document):
            raise ValueError("the document is not valid")
        self._apply("update", label, node_id, document)

    def remove_node(self, label: str, node_id: int | str) -> None:
        self._apply("remove", label, node_id, None)

    def add_edge(self, source: Node, target: Node, relation: str, document: dict | None = None) -> None:
        row = [(str(source.id), source.label.lower(), str(target.id), target.label.lower(), relation, json.dumps(document or {}))]
        schema = "source_id string, source_type string, target_id string, target_type string, relation string, resource string"
        self.store.commit(relations=resources.add_relations(self.store.read("relations"), self.spark.createDataFrame(row, schema)))

    def search_node(self, node_id: int | str, node_type: str | None) -> dict | None:
        found = lookup.resource(self.store.read("resources"), str(node_id), node_type and node_type.lower()).first()
        return None if found is None else json.loads(found[0])

    def search_node_type(self, label: str) -> bool:
        return lookup.resource_type_exists(self.store.read("resources"), label.lower())

    def fetch_ids_from_db(self, node_type: str, limit: int | None = 10) -> list[str]:
        return [r.id for r in lookup.resource_ids(self.store.read("resources"), node_type.lower(), limit).collect()]

    def history(self, node_type: str, node_id: int | str) -> list[tuple]:
        rows = self.store.read("resource_history").where((F.col("resource_type") == node_type.lower()) & (F.col("id") == str(node_id)))
        return [(r.txid, r.status, json.loads(r.resource)) for r in rows.orderBy("txid").collect()]

    def search_indegree_edges(self, target: int | str) -> list[tuple]:
        return [tuple(r) for r in traverse.relation_in(self.store.read("relations"), str(target)).collect()]

    def search_outdegree_edges(self, source: int | str) -> list[tuple]:
        return [tuple(r) for r in traverse.relation_out(self.store.read("relations"), str(source)).collect()]

    def get_connections(self, node_id: int | str) -> list[tuple]:
        return [tuple(r) for r in traverse.relation_touching(self.store.read("relations"), str(node_id)).collect()]

    def all_connected_nodes(self, node_id: int | str) -> list[str]:
        return sorted(r.id for r in traverse.component(traverse.as_edges(self.store.read("relations")), node_id).collect())

    def traverse(self, source: int | str, target: int | str | None = None) -> list[str]:
        if target is None:
            return []
        path = traverse.shortest_path(traverse.as_edges(self.store.read("relations")), source, target)
        return [r.id for r in path.orderBy("step").collect()]

    def search(self, text: str, node_type: str, threshold: float = 0.9, limit: int = 1) -> list[dict]:
        query = self.embedder.embed(vector.query_text(text))
        hits = vector.search_resources(self.store.read("resources"), self.store.read("resource_vectors"), query, node_type.lower(), limit, threshold)
        return [r.asDict() for r in hits.collect()]


def visualize_graph(spark: SparkSession, graph: KnowledgeGraph) -> DataFrame:
    """DOT lines of a knowledge graph."""
    nodes = spark.createDataFrame([(str(n.id), n.label) for n in graph.nodes], "id string, label string")
    edges = spark.createDataFrame([(str(e.source), str(e.target), e.label) for e in graph.edges], "source string, target string, label string")
    return export.dot_lines(nodes, edges)
