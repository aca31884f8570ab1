"""Graphs for other programs: edge lists, arrays, DOT text. Lines are made in the cluster, not on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.strictjson import decode
from knotwork.operators import traverse
from knotwork.operators.merge import last_of_parallel


def undirected_edges(edges: DataFrame) -> DataFrame:
    """a, b, label, attributes: one row per pair of nodes, the last of parallel edges either way."""
    return last_of_parallel(edges.where("source is not null and target is not null")).select("a", "b", "label", "attributes")


def to_networkx(nodes: DataFrame, edges: DataFrame, limit: int | None = 10):
    """A networkx.Graph of the first ``limit`` nodes (None: all; a graph in memory, so for graphs that fit one)."""
    try:
        import networkx as nx
    except ImportError as error:
        raise ImportError("networkx is not installed") from error
    own = nodes if limit is None else nodes.orderBy("embed_id").limit(limit)
    graph = nx.Graph()
    for r in own.select("id", "label", "attributes").toLocalIterator():
        graph.add_node(r.id, label=r.label, attributes=r.attributes)
    ids = own.select("id")
    near = edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    for r in undirected_edges(near).toLocalIterator():
        graph.add_edge(r.a, r.b, **edge_data(r.label, r.attributes))
    return graph


def edge_data(label: str | None, attributes: str | None) -> dict:
    """What a networkx edge carries: the fields of its document beside the label; a text that is no object as it is."""
    found = decode(attributes)
    return {**found, "label": label} if isinstance(found, dict) else {"label": label, "attributes": attributes}


def from_networkx(spark: SparkSession, graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of any object with ``nodes(data=True)`` and ``edges(data=True)``."""
    import json

    def split(data: dict) -> tuple[str | None, str]:
        data = dict(data)
        label, own = data.pop("label", None), data.pop("attributes", None)
        return label, own if isinstance(own, str) else json.dumps(own if own is not None else data)

    nodes = [(str(n), *split(d)) for n, d in graph.nodes(data=True)]
    edges = [(str(a), str(b), *split(d)) for a, b, d in graph.edges(data=True)]
    return (
        spark.createDataFrame(nodes, "id string, label string, attributes string"),
        spark.createDataFrame(edges, "source string, target string, label string, attributes string"),
    )


def index_arrays(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, edge_index): nodes numbered from 0 by id, edges as pairs of numbers, for tensor libraries."""
    from knotwork.operators.mutate import number_rows
    from knotwork.session import cut

    index = cut(number_rows(nodes.select("id").where("id is not null").distinct(), "index", 0, "id"))
    heads = index.select(F.col("id").alias("source"), F.col("index").alias("head"))
    tails = index.select(F.col("id").alias("target"), F.col("index").alias("tail"))
    return index, edges.join(heads, "source").join(tails, "target").select("head", "tail", "label")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def label_of(document: str = "attributes", exclude: list[str] | None = None, hide_key: bool = False, separator: str = " ") -> Column:
    r"""DOT label of a document: key and value lines in field order, joined by \n; keys may be left out or hidden."""
    fields = F.from_json(F.col(document), "map<string,string>")
    entries = F.map_entries(fields)
    if exclude:
        entries = F.filter(entries, lambda e: ~e["key"].isin(*exclude))
    line = lambda e: e["value"] if hide_key else F.concat(e["key"], F.lit(separator), e["value"])
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.coalesce(line(e), F.lit(""))), "\\n"), F.col(document), F.lit(""))


def dot_lines(nodes: DataFrame, edges: DataFrame, node_label: Column | None = None, edge_label: Column | None = None) -> DataFrame:
    """ord, line: the DOT text of a graph. Sorted by ``ord`` the lines are a file."""
    node_label = F.coalesce(node_label if node_label is not None else F.col("label"), F.lit(""))
    edge_label = F.coalesce(edge_label if edge_label is not None else F.col("label"), F.lit(""))
    own = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(node_label), F.lit("];")).alias("line"))
    links = edges.select(
        F.lit(2).alias("ord"),
        F.concat(F.lit("  "), _quoted(F.col("source")), F.lit(" -> "), _quoted(F.col("target")), F.lit(" [label="), _quoted(edge_label), F.lit("];")).alias("line"),
    )
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "digraph {"), (3, "}")], "ord int, line string")
    return frame.unionByName(own).unionByName(links)


def dot_around(nodes: DataFrame, edges: DataFrame, ids: list[str], **labels) -> DataFrame:
    """DOT of the edges that touch any of ``ids`` and of the nodes at their ends."""
    touched = reduce(DataFrame.unionByName, [traverse.incident_edges(edges, i) for i in ids]).distinct()
    ends = touched.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return dot_lines(nodes.join(ends, "id", "left_semi"), touched, **labels)


def dot_of_bodies(triples: list[tuple[str, str, str]]) -> str:
    """DOT of traversal rows in order: an arrow row belongs to the last node row before it."""
    lines, at = ["digraph {"], None
    q = lambda x: '"' + str(x).replace('"', '\\"') + '"'
    for own, mark, body in triples:
        if mark == "()":
            at = own
            lines.append(f"  {q(own)} [label={q(body)}];")
        elif at is not None:
            a, b = (at, own) if mark == "->" else (own, at)
            lines.append(f"  {q(a)} -> {q(b)} [label={q(body)}];")
    return "\n".join([*lines, "}"])
