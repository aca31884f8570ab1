"""Batch changes of the graph: every function takes tables and gives the tables after the change.

Nothing is collected but per-partition row counts; uniqueness is checked with anti and semi joins; ids are given
out without a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import jsontext
from knotwork.session import cut, shuffle_partitions


def number_rows(rows: DataFrame, name: str, start: int, *order: str) -> DataFrame:
    """Consecutive numbers from ``start`` in the given order: range-partitioned sort, then one offset per partition."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = cut(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, at = [], start
    for r in counts:
        offsets.append((r["_part"], at))
        at += r["n"]
    table = spark.createDataFrame(offsets, "_part long, _start long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_place") % F.lit(1 << 33)).drop("_place", "_part", "_start")


def next_id(rows: DataFrame, name: str = "embed_id") -> int:
    """One more than the greatest; 1 for an empty table."""
    return (rows.agg(F.max(name)).first()[0] or 0) + 1


def keep_one(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; limited before the shuffle, so repeated keys do not pile up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__kw_rank", F.row_number().over(w)).where("__kw_rank = 1").drop("__kw_rank")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes delivered more than once, once: the latest ``updated_at`` counts, then the greatest embed_id."""
    return keep_one(nodes, ["id"], F.col("updated_at").desc_nulls_last(), F.col("embed_id").desc(), "label", "attributes")


def with_own_id(document: str = "attributes", key: str = "id"):
    """The document with the node's id in it, as stored documents have it."""
    return jsontext.with_field(document, "id", F.col(key))


def _stamp(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def add_nodes(nodes: DataFrame, new: DataFrame, *order: str, stamp: bool = True) -> DataFrame:
    """``nodes`` and those of ``new`` (id, label, attributes) whose id is not taken; the first of equal ids wins."""
    order = order or ("id", "label", "attributes")
    fresh = keep_one(new.where("id is not null"), ["id"], *order).join(nodes.select("id"), "id", "left_anti")
    numbered = number_rows(fresh, "embed_id", next_id(nodes), *order)
    return nodes.unionByName(_stamp(numbered) if stamp else numbered, allowMissingColumns=True)


def insert_edges(edges: DataFrame, new: DataFrame, *order: str, stamp: bool = True) -> DataFrame:
    """All of ``new``; an edge with the endpoints and document of an earlier one replaces it. The label is no part
    of that identity."""
    order = order or ("source", "target", "attributes", "label")
    doc = F.coalesce(jsontext.minify("attributes"), F.col("attributes"))
    numbered = number_rows(new.withColumn("attributes", doc), "embed_id", next_id(edges), *order)
    both = edges.unionByName(_stamp(numbered) if stamp else numbered, allowMissingColumns=True)
    return replace_duplicates(both)


def replace_duplicates(edges: DataFrame) -> DataFrame:
    """Of edges with equal (source, target, document) the one with the greatest embed_id."""
    return keep_one(
        edges.withColumn("_doc", F.coalesce(jsontext.minify("attributes"), "attributes")),
        ["source", "target", "_doc"],
        F.col("embed_id").desc(),
    ).drop("_doc")


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame, *order: str, stamp: bool = True) -> DataFrame:
    """``edges`` and those of ``new`` that are not there yet and whose both ends are nodes; others are passed over."""
    order = order or ("source", "target", "attributes", "label")
    ids = nodes.select("id").distinct()
    doc = F.coalesce(jsontext.minify("attributes"), F.col("attributes"))
    wanted = keep_one(new.withColumn("_doc", doc), ["source", "target", "_doc"], *order)
    wanted = wanted.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    wanted = wanted.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    known = edges.select("source", "target", doc.alias("_doc"))
    wanted = wanted.join(known, ["source", "target", "_doc"], "left_anti")
    wanted = wanted.withColumn("attributes", F.col("_doc")).drop("_doc")
    numbered = number_rows(wanted, "embed_id", next_id(edges), *order)
    return edges.unionByName(_stamp(numbered) if stamp else numbered, allowMissingColumns=True)


def upsert_nodes(nodes: DataFrame, new: DataFrame, stamp: bool = True) -> DataFrame:
    """Known ids get the new label, the merged document and a new embed_id; unknown ones are added."""
    new = keep_one(new.where("id is not null"), ["id"], "label", "attributes")
    known = new.join(nodes.select("id"), "id", "left_semi")
    numbered = number_rows(known, "embed_id", next_id(nodes), "id").select(
        "id", F.col("label").alias("_label"), F.col("attributes").alias("_new"), F.col("embed_id").alias("_embed")
    )
    changed = nodes.join(numbered, "id", "left")
    hit = F.col("_embed").isNotNull()
    changed = changed.select(
        *(
            {
                "label": F.when(hit, F.col("_label")).otherwise(F.col("label")).alias("label"),
                "attributes": F.when(hit, jsontext.merge("attributes", "_new")).otherwise(F.col("attributes")).alias("attributes"),
                "embed_id": F.coalesce("_embed", "embed_id").alias("embed_id"),
            }.get(c, F.col(c))
            for c in nodes.columns
        )
    )
    changed = cut(changed)
    return add_nodes(changed, new, "id", stamp=stamp)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given ids (column id) and all edges that touch them. Unknown ids do nothing."""
    gone = ids.select("id").distinct()
    left = edges.join(gone, F.col("source") == F.col("id"), "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.join(gone, F.col("target") == F.col("id"), "left_anti")


def remove_vectors(vectors: DataFrame, embed_ids: DataFrame) -> DataFrame:
    return vectors.join(embed_ids.select("embed_id"), "embed_id", "left_anti")


def add_node_type(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """A node for each label (columns id, label, attributes) that no node has yet."""
    first = keep_one(types, ["label"], "id")
    return add_nodes(nodes, first.join(nodes.select("label").distinct(), "label", "left_anti"), "label")


def remap_graph(new_nodes: DataFrame, new_edges: DataFrame, fresh: str = "uuid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unknown) of a generated graph under fresh ids, documents wrapped as {"body": ...}.

    ``fresh`` 'uuid' draws ids, written down before they are used twice; 'md5' derives them from the old ones.
    Edges with an end that is no node of the graph are in ``unknown`` and not in ``edges``.
    """
    new_id = F.expr("uuid()") if fresh == "uuid" else F.md5(F.col("id"))
    named = keep_one(new_nodes.where("id is not null"), ["id"], "label", "attributes").withColumn("new_id", new_id)
    named = cut(named) if fresh == "uuid" else named
    body = F.to_json(F.struct(F.col("attributes").alias("body")))
    names = named.select("id", "new_id")
    moved = new_edges.join(names.toDF("source", "new_source"), "source", "left").join(names.toDF("target", "new_target"), "target", "left")
    known = F.col("new_source").isNotNull() & F.col("new_target").isNotNull()
    nodes = named.select(F.col("new_id").alias("id"), "label", body.alias("attributes"))
    edges = moved.where(known).select(
        F.col("new_source").alias("source"), F.col("new_target").alias("target"), "label", body.alias("attributes")
    )
    return nodes, edges, moved.where(~known).select(*new_edges.columns)
