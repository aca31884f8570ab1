"""Point lookups, label and attribute searches on nodes and edges.

Where the order of a limited result would be arbitrary it is by ``embed_id``, then ``id``. Filters are on plain
columns and reach the Parquet scan; attribute conditions run as VARIANT expressions behind them. Limits are
features of the calls (``None``: all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import typed
from knotwork.functions.jsontext import json_tree, minify


def limited(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def text_id(value: int | str) -> str:
    return str(value)


def node_by_id(nodes: DataFrame, node_id: int | str) -> DataFrame:
    return nodes.where(F.col("id") == text_id(node_id)).select("attributes")


def node_label(nodes: DataFrame, node_id: int | str, limit: int | None = 1) -> DataFrame:
    return limited(nodes.where(F.col("id") == text_id(node_id)).select("label", "embed_id"), limit, "embed_id").select("label")


def node_type(nodes: DataFrame, label: str) -> DataFrame:
    """The label if any node has exactly it."""
    return nodes.where(F.col("label") == label).select("label").limit(1)


def id_by_type(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label).orderBy("embed_id", "id").limit(1).select("id")


def nodes_like_label(nodes: DataFrame, text: str, limit: int | None = 1) -> DataFrame:
    """Nodes whose label contains ``text`` regardless of case; % and _ in it are wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return limited(nodes.where(F.col("label").ilike(pattern)), limit, "embed_id", "id")


def ids(nodes: DataFrame, limit: int | None = 10) -> DataFrame:
    return limited(nodes.select("id", "embed_id"), limit, "embed_id", "id").select("id")


def embed_id_of(nodes: DataFrame, node_id: int | str, limit: int | None = 1) -> DataFrame:
    return limited(nodes.where(F.col("id") == text_id(node_id)).select("embed_id"), limit, "embed_id")


def edge_embed_ids(edges: DataFrame, node_id: int | str, limit: int | None = 10) -> DataFrame:
    own = (F.col("source") == text_id(node_id)) | (F.col("target") == text_id(node_id))
    return limited(edges.where(own).select("embed_id"), limit, "embed_id")


def id_of(nodes: DataFrame, embed_id: int, limit: int | None = 1) -> DataFrame:
    return limited(nodes.where(F.col("embed_id") == embed_id).select("id"), limit, "id")


def edge_by_identity(edges: DataFrame, source: str, target: str, attributes: str, limit: int | None = 1) -> DataFrame:
    """embed_id of the edge with these endpoints and this document; layout does not count, field order does."""
    own = edges.where((F.col("source") == text_id(source)) & (F.col("target") == text_id(target)))
    wanted = own.withColumn("_doc", minify("attributes")).where(F.col("_doc") == minify(F.lit(attributes)))
    return limited(wanted.select("embed_id"), limit, "embed_id")


def find(nodes: DataFrame, condition: Column, column: str = "attributes") -> DataFrame:
    """Generic search: nodes that meet a condition made of `typed.clause` and `typed.join_clauses`."""
    return nodes.where(condition).select(column)


def find_in_tree(
    nodes: DataFrame, value: object, predicate: str = "=", key: str | None = None, row: str = "embed_id"
) -> DataFrame:
    """Nodes that hold a value anywhere in their document, or under ``key`` at any depth. Each node once."""
    tree = json_tree(nodes, row, "attributes")
    if key is not None:
        tree = tree.where(F.col("key") == key)
    cls = F.when(F.col("type") == "null", 0).when(F.col("num").isNotNull(), 1).otherwise(2)
    hits = tree.where(typed.compare((cls, F.col("num"), F.col("text")), predicate, value)).select(F.col("_row").alias(row)).distinct()
    return nodes.join(hits, row, "left_semi")


# Versioned resources: the type is the partition column, so these read one partition.


def resource(resources: DataFrame, resource_id: str, resource_type: str | None) -> DataFrame:
    if not resource_type:
        raise ValueError("resource_type is required")
    return resources.where((F.col("resource_type") == resource_type) & (F.col("id") == resource_id)).select("resource")


def relation(relations: DataFrame, source: tuple[str, str], target: tuple[str, str], body: str, limit: int | None = 1) -> DataFrame:
    """embed_id of the relation between (id, type) and (id, type) with this document."""
    own = relations.where(
        (F.col("source_id") == source[0]) & (F.col("source_type") == source[1])
        & (F.col("target_id") == target[0]) & (F.col("target_type") == target[1])
    )
    wanted = own.withColumn("_doc", minify("resource")).where(F.col("_doc") == minify(F.lit(body)))
    return limited(wanted.select("embed_id"), limit, "embed_id")


def resource_ids(resources: DataFrame, resource_type: str, limit: int | None = 10) -> DataFrame:
    return limited(resources.where(F.col("resource_type") == resource_type).select("id"), limit, "id")


def resource_type_exists(resources: DataFrame, resource_type: str) -> bool:
    return not resources.where(F.col("resource_type") == resource_type).isEmpty()


def relation_embed_ids(relations: DataFrame, resource_id: str, limit: int | None = 10) -> DataFrame:
    own = (F.col("source_id") == resource_id) | (F.col("target_id") == resource_id)
    return limited(relations.where(own).select("embed_id"), limit, "embed_id")
