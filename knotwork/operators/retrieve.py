"""Retrieval of a subgraph around what is similar to a text: similarity, then one hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import lookup, traverse, vector


def search_subgraph(
    nodes: DataFrame, edges: DataFrame, node_vectors: DataFrame, edge_vectors: DataFrame, query: list[float],
    k: int = 1, threshold: float | None = 0.9, neighbour_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the k nearest nodes and edges, the neighbours of the nodes, both ends of the edges and their
    neighbours. Nothing similar gives empty tables. ``neighbour_limit`` counts edges (reference: 1 per hit)."""
    node_hits = vector.search_nodes(nodes, node_vectors, query, k, threshold)
    edge_hits = vector.search_edges(edges, edge_vectors, query, k, threshold)
    ends = edge_hits.select(F.explode(F.array("source", "target")).alias("id"))
    seeds = node_hits.select("id").unionByName(ends).distinct()
    around = traverse.neighbours_of(nodes, edges, seeds, neighbour_limit)
    own = nodes.join(seeds, "id", "left_semi").select("id", "label", "attributes")
    return own.unionByName(around).distinct(), edge_hits.select("source", "target", "label", "attributes").distinct()


def nodes_like(nodes: DataFrame, vectors: DataFrame, label: str, embedder, threshold: float = 0.9) -> DataFrame:
    """Nodes similar to the label of the first node whose label contains ``label``."""
    first = lookup.nodes_like_label(nodes, label, 1).select("embed_id", "label")
    queries = first.select(F.col("embed_id").alias("query_id"), embedder.column(F.col("label")).alias("vector"))
    hits = vector.nearest_batch(vectors, queries, 1, threshold)
    return nodes.join(F.broadcast(hits.select("embed_id").distinct()), "embed_id").select("id", "label", "attributes").distinct()


def retrieve_batch(
    nodes: DataFrame, edges: DataFrame, node_vectors: DataFrame, queries: DataFrame, k: int = 1, threshold: float | None = 0.9
) -> DataFrame:
    """query_id, id, attributes: for many queries (query_id, vector) at once the k nearest nodes and their neighbours.

    One plan for all queries: one scan of the vectors, then two joins along the edges.
    """
    hits = vector.nearest_batch(node_vectors, queries, k, threshold).select("query_id", "embed_id")
    seeds = nodes.join(hits, "embed_id").select("query_id", "id").distinct()
    ends = edges.select("source", "target")
    out = seeds.join(ends, F.col("id") == F.col("source")).select("query_id", F.col("target").alias("id"))
    back = seeds.join(ends, F.col("id") == F.col("target")).select("query_id", F.col("source").alias("id"))
    around = seeds.unionByName(out).unionByName(back).distinct()
    return around.join(nodes, "id").select("query_id", "id", "attributes").distinct()


class Retriever:
    """Passages for questions: the documents of the nodes around each question's nearest nodes and edges."""

    def __init__(self, graph, k: int = 5) -> None:
        self.graph, self.k = graph, k

    def forward(self, questions: str | list[str], k: int | None = None) -> list[str]:
        found: dict[str, None] = {}
        for text in [questions] if isinstance(questions, str) else questions:
            near, _ = self.graph.search_from_graph(text, limit=k or self.k, as_frames=True)
            for r in near.select("attributes").collect():
                found[r.attributes] = None
        return list(found)
