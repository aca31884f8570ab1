"""One mixed collection of vectors: nodes and edges side by side, each row with its kind and a metadata document.

A row may be a piece of a longer text; then its id is that of the whole with the number of the piece behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import typed
from knotwork.operators.vector import nearest_batch, squared_l2

COLLECTION = "id string, kind string, metadata string, vector array<float>"


def whole_id(column: Column | str = "id") -> Column:
    """An id without the number of the piece: ``a_b_3`` is piece 3 of ``a_b``; an id without number is itself."""
    return F.regexp_replace(column, r"_\d+$", "")


def rows_of(table: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Rows of nodes or edges with a vector, by embed_id; the metadata are the embed_id and the label."""
    own = table.join(vectors, "embed_id")
    return own.select(
        F.col("embed_id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.to_json(F.struct("embed_id", "label")).alias("metadata"), "vector"
    )


def size(collection: DataFrame) -> int:
    return collection.count()


def add(collection: DataFrame, rows: DataFrame) -> DataFrame:
    """The collection with new rows; of rows with the same kind and id the new one counts, once."""
    fresh = rows.select("id", "kind", "metadata", "vector").dropDuplicates(["kind", "id"])
    return collection.join(fresh.select("kind", "id"), ["kind", "id"], "left_anti").select("id", "kind", "metadata", "vector").unionByName(fresh)


def delete(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """The collection without the rows, and pieces, of ``ids`` (kind, id)."""
    gone = ids.select("kind", F.col("id").alias("_whole")).distinct()
    return collection.withColumn("_whole", whole_id()).join(gone, ["kind", "_whole"], "left_anti").select("id", "kind", "metadata", "vector")


def search(
    collection: DataFrame, query: list[float], k: int = 1, threshold: float | None = None, kind: str | None = None,
    sort_by: str = "", descending: bool = False,
) -> DataFrame:
    """id, kind, metadata, distance of the k nearest of a kind (None: of both), below the threshold.

    With ``sort_by`` the k are ordered by that field of the metadata, rows without it as 0; else by distance.
    """
    own = collection if kind is None else collection.where(F.col("kind") == kind)
    found = own.select(whole_id().alias("id"), "kind", "metadata", squared_l2("vector", query).alias("distance")).where("distance is not null")
    top = found.orderBy("distance", "kind", "id").limit(k)
    top = top if threshold is None else top.where(F.col("distance") < threshold)
    if not sort_by:
        return top.orderBy("distance", "kind", "id")
    cls, num, text = typed.extract("metadata", sort_by)
    value = [F.when(cls == 0, F.lit(1)).otherwise(cls), F.when(cls == 0, F.lit(0.0)).otherwise(num), text]
    return top.orderBy(*((c.desc_nulls_last() if descending else c.asc_nulls_first()) for c in value), "distance", "kind", "id")


def search_batch(collection: DataFrame, queries: DataFrame, k: int = 1, threshold: float | None = None, kind: str | None = None) -> DataFrame:
    """query_id, embed_id, distance for many queries; for collections whose ids are whole numbers."""
    own = collection if kind is None else collection.where(F.col("kind") == kind)
    return nearest_batch(own.select(whole_id().cast("long").alias("embed_id"), "vector").where("embed_id is not null"), queries, k, threshold)
