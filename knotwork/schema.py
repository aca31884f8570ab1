"""The store's tables: schemas, empty tables and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, label string, attributes string, embed_id long, created_at timestamp, updated_at timestamp"
EDGES = (
    "source string, target string, label string, attributes string, embed_id long, created_at timestamp, "
    "updated_at timestamp"
)
NODE_VECTORS = "embed_id long, vector array<float>"
EDGE_VECTORS = NODE_VECTORS
RESOURCES = (
    "resource_type string, id string, embed_id long, txid long, ts timestamp, status string, resource string"
)
RESOURCE_VECTORS = "resource_type string, embed_id long, vector array<float>"
HISTORY = "resource_type string, id string, txid long, ts timestamp, status string, resource string"
RELATIONS = (
    "embed_id long, source_id string, source_type string, target_id string, target_type string, relation string, "
    "resource string"
)
ORPHAN_INDEX = "ref string, first_at timestamp, untimed boolean"
ORPHAN_REFS = "ref_id long, side string, ref string, at timestamp"
ORPHAN_LEDGER = f"{ORPHAN_REFS}, status string, resolved_at timestamp"
BATCHES = "stream string, batch_id long"
ONTOLOGY = "class string, property string, range string"

TABLES = {
    "nodes": NODES,
    "edges": EDGES,
    "node_vectors": NODE_VECTORS,
    "edge_vectors": EDGE_VECTORS,
    "resources": RESOURCES,
    "resource_vectors": RESOURCE_VECTORS,
    "resource_history": HISTORY,
    "relations": RELATIONS,
    "ontology": ONTOLOGY,
    "orphan_index": ORPHAN_INDEX,
    "orphan_refs": ORPHAN_REFS,
    "orphan_ledger": ORPHAN_LEDGER,
    "batches": BATCHES,
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; missing ones null, others dropped."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(TABLES[name])
    have = set(df.columns)
    return df.select(
        *((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)
    )


def wrong_dimension(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors that are null or not of the index's dimension."""
    return vectors.where(F.col("vector").isNull() | (F.size("vector") != dims))
