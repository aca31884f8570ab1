"""Exact vector search: squared L2 distance, top k before threshold, as the reference orders these steps.

One query: the distance is a JVM expression and the top k a TakeOrderedAndProject, so each task sends k rows.
Many queries: they meet all vectors in blocks of bounded size; a task keeps each query's local top k from one matrix
product per block, and only those rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from knotwork.functions import jsontext, typed
from knotwork.functions.strictjson import is_json_object

#: Queries of a batch that meet the vectors together, and that a task holds.
QUERY_BLOCK = 4096


def squared_l2(column: Column | str, query: list[float]) -> Column:
    """Squared L2 distance to a fixed vector in double precision, summed in order; null unless lengths agree."""
    column = F.col(column) if isinstance(column, str) else column
    against = F.array(*(F.lit(float(x)) for x in query)) if query else F.expr("cast(array() as array<double>)")
    parts = F.zip_with(column, against, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(column) == len(query), total)


def nearest(vectors: DataFrame, query: list[float], k: int = 1, threshold: float | None = None) -> DataFrame:
    """embed_id, distance of the k nearest, then of these those strictly below the threshold."""
    found = vectors.select("embed_id", squared_l2("vector", query).alias("distance")).where("distance is not null")
    top = found.orderBy("distance", "embed_id").limit(k)
    return top if threshold is None else top.where(F.col("distance") < threshold)


def search_nodes(
    nodes: DataFrame, vectors: DataFrame, query: list[float], k: int = 1, threshold: float | None = 0.9,
    sort_by: str = "", descending: bool = False,
) -> DataFrame:
    """embed_id, id, label, attributes, distance: top k, joined with nodes, ordered by an attribute, then cut."""
    hits = F.broadcast(nearest(vectors, query, k))  # k rows
    joined = nodes.join(hits, "embed_id").select("embed_id", "id", "label", "attributes", "distance")
    joined = joined if threshold is None else joined.where(F.col("distance") < threshold)
    return joined.orderBy(*(typed.order_by(sort_by, descending) or ["distance"]), "embed_id")


def search_edges(
    edges: DataFrame, vectors: DataFrame, query: list[float], k: int = 1, threshold: float | None = 0.9,
    descending: bool = False,
) -> DataFrame:
    """embed_id, source, target, label, attributes, distance; ``descending`` orders by distance, farthest first."""
    hits = F.broadcast(nearest(vectors, query, k))
    joined = edges.join(hits, "embed_id").select("embed_id", "source", "target", "label", "attributes", "distance")
    joined = joined if threshold is None else joined.where(F.col("distance") < threshold)
    return joined.orderBy(F.col("distance").desc() if descending else F.col("distance"), "embed_id")


def search_resources(
    resources: DataFrame, vectors: DataFrame, query: list[float], resource_type: str, k: int = 1, threshold: float | None = 0.9
) -> DataFrame:
    """embed_id, id, resource, distance of the nearest resources of a type; both tables are read in that partition."""
    if not resource_type:
        raise ValueError("resource_type is required")
    hits = F.broadcast(nearest(vectors.where(F.col("resource_type") == resource_type), query, k, threshold))  # k rows
    own = resources.where(F.col("resource_type") == resource_type)
    return own.join(hits, "embed_id").select("embed_id", "id", "resource", "distance").orderBy("distance", "embed_id")


def fetch_by_embed_ids(rows: DataFrame, embed_ids: list[int], sort_by: str = "", descending: bool = False) -> DataFrame:
    """Nodes or edges of the given embed_ids, without distance, in attribute order."""
    wanted = rows.sparkSession.createDataFrame([(int(e),) for e in embed_ids], "embed_id long")
    own = rows.join(F.broadcast(wanted), "embed_id") if len(embed_ids) <= QUERY_BLOCK else rows.join(wanted, "embed_id")
    return own.orderBy(*typed.order_by(sort_by, descending), "embed_id")


BATCH = "query_id long, embed_id long, distance double"


def _once(ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows delivered more than once, once."""
    first: dict[tuple[int, bytes], int] = {}
    for i, key in enumerate(zip(ids.tolist(), map(bytes, np.ascontiguousarray(y + 0.0)))):  # + 0.0: one zero
        first.setdefault(key, i)
    at = np.fromiter(first.values(), np.int64, len(first))
    return ids[at], y[at]


def _block_scanner(shared, k: int, exclude_self: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        dims = queries.shape[1]
        squares = (queries**2).sum(axis=1)
        for batch in batches:
            column = batch.column(1)
            sized = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1)) == dims
            ids = np.asarray(batch.column(0))[sized]
            if not len(ids):
                continue
            y = np.asarray(column.filter(pa.array(sized)).flatten(), dtype=np.float64).reshape(-1, dims)
            ids, y = _once(ids, y)
            surplus = len(ids) - len(np.unique(ids))  # other vectors under the same id, maybe at the same distance
            out_q, out_e, out_d = [], [], []
            step = max(1, (1 << 21) // len(ids))
            norms = (y**2).sum(axis=1)
            for s in range(0, len(names), step):
                q = queries[s : s + step]
                near = squares[s : s + step, None] + norms[None, :] - 2 * (q @ y.T)
                if exclude_self:
                    near[names[s : s + step, None] == ids[None, :]] = np.inf
                near[~np.isfinite(near)] = np.inf
                # the product's last digits are not those of the exact sum: all that may be among the k are kept
                slack = 8 * (dims + 4) * np.finfo(np.float64).eps * (squares[s : s + step, None] + norms[None, :])
                keep = min(max(k, 1) + surplus, len(ids))
                bound = np.partition(near + slack, keep - 1, axis=1)[:, keep - 1]
                row, col = np.nonzero(near - slack <= bound[:, None])
                fine = np.isfinite(near[row, col])
                row, col = row[fine], col[fine]
                total = np.zeros(len(row))
                for d in range(dims):  # in order, as the expression above sums
                    total += (y[col, d] - q[row, d]) ** 2
                order = np.lexsort((ids[col], total, row))
                row, col, total = row[order], col[order], total[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]]) | (total[1:] != total[:-1])
                row, col, total = row[fresh], col[fresh], total[fresh]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                own = rank < k
                out_q.append(names[s + row[own]])
                out_e.append(ids[col[own]])
                out_d.append(total[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_e)), pa.array(np.concatenate(out_d))],
                names=["query_id", "embed_id", "distance"],
            )

    return scan


def nearest_batch(
    vectors: DataFrame, queries: DataFrame, k: int = 1, threshold: float | None = None, exclude_self: bool = False
) -> DataFrame:
    """query_id, embed_id, distance: each query's k nearest, then those strictly below the threshold.

    ``queries`` has columns query_id and vector and is a stated set, read to the driver block by block; vectors of
    another length match nothing. ``exclude_self`` leaves out the vector whose embed_id is the query's id.
    """
    spark = vectors.sparkSession
    parts, block, dims = [], [], None

    def work() -> None:
        names = np.array([r[0] for r in block], np.int64)
        shared = spark.sparkContext.broadcast((names, np.array([r[1] for r in block], np.float64)))
        parts.append(vectors.select("embed_id", "vector").where("embed_id is not null").mapInArrow(_block_scanner(shared, k, exclude_self), BATCH))

    for r in queries.where("vector is not null and size(vector) > 0").select("query_id", "vector").toLocalIterator():
        if dims not in (None, len(r.vector)) or len(block) == QUERY_BLOCK:
            work()
            block = []
        dims = len(r.vector)
        block.append((r.query_id, r.vector))
    if block:
        work()
    if not parts:
        return spark.createDataFrame([], BATCH)
    w = Window.partitionBy("query_id").orderBy("distance", "embed_id")
    found = reduce(DataFrame.unionByName, parts).distinct().withColumn("__kw_rank", F.row_number().over(w)).where(F.col("__kw_rank") <= k).drop("__kw_rank")
    return found if threshold is None else found.where(F.col("distance") < threshold)


def is_unique(vectors: DataFrame, query: list[float], threshold: float = 0.9) -> bool:
    return nearest(vectors, query, 1, threshold).isEmpty()


def unique_batch(vectors: DataFrame, queries: DataFrame, threshold: float = 0.9, exclude_self: bool = False) -> DataFrame:
    """query_id of the queries that no vector comes close to."""
    hits = nearest_batch(vectors, queries, 1, threshold, exclude_self).select("query_id")
    return queries.select("query_id").distinct().join(hits, "query_id", "left_anti")


def add_vectors(vectors: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """``vectors`` and those of ``rows`` (embed_id, vector); one of another dimension is an error."""
    wrong = rows.where(F.col("vector").isNull() | (F.size("vector") != dims)).limit(1).collect()
    if wrong:
        raise ValueError(f"vector of embed_id {wrong[0]['embed_id']} has not {dims} values")
    return vectors.unionByName(rows.select("embed_id", "vector"))


# Text to vectors: the default needs no service.


def hashed_embedding(text: str, dims: int) -> list[float]:
    """Feature hashing of words and their neighbours, to unit length; all zero for a text without words."""
    import zlib

    total = np.zeros(dims)
    words = text.replace("\n", " ").lower().split()
    for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
        h = zlib.crc32(gram.encode("utf-8", "replace"))
        total[h % dims] += 1.0 if h & 0x80000000 else -1.0
    norm = np.sqrt((total**2).sum())
    return [float(x) for x in (total / norm if norm else total)]


class HashingEmbedder:
    """The offline embedder. Any object with ``dims``, ``embed`` and ``column`` can stand in for it."""

    def __init__(self, dims: int = 384) -> None:
        self.dims = dims

    def embed(self, text: str) -> list[float]:
        return hashed_embedding(text, self.dims)

    def column(self, text: Column | str) -> Column:
        dims = self.dims

        def embed_all(texts: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else hashed_embedding(x, dims) for x in texts])

        embed_all.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(embed_all, ArrayType(FloatType()))(text)


class ClientEmbedder:
    """An embedder over a client with ``embed(list of texts) -> list of vectors``; without client every text is []."""

    def __init__(self, client=None, dims: int = 384) -> None:
        self.client, self.dims = client, dims

    def embed(self, text: str) -> list[float]:
        return [] if self.client is None else list(self.client.embed([text.replace("\n", " ")])[0])

    def column(self, text: Column | str) -> Column:
        client = self.client

        def embed_all(texts: pd.Series) -> pd.Series:
            if client is None:
                return pd.Series([[] for _ in texts])
            return pd.Series(client.embed([(x or "").replace("\n", " ") for x in texts]))

        embed_all.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(embed_all, ArrayType(FloatType()))(text)


def node_text() -> Column:
    """The text a node is embedded by: its document with id and label in it; one that is no object as a field beside."""
    own = F.to_json(F.struct("id", "label"))
    beside = F.to_json(F.struct(F.col("attributes"), F.col("id"), F.col("label")))
    return F.when(is_json_object("attributes"), jsontext.merge("attributes", own)).otherwise(beside)


def edge_text() -> Column:
    return F.to_json(
        F.struct(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("label"), F.col("attributes"))
    )


def query_text(text: str) -> str:
    import json

    return json.dumps({"body": text})
