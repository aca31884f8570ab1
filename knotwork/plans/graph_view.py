"""A property graph over the star-schema tables, in Spark and in SQL.

Ids carry a letter for their table (r0, n3, c17, o5, s2, p9); embed_ids are the keys with the table's number in the
last digit, so both engines give the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.plans.tables import table

# Table, letter, key, column that gives the label's name.
KINDS = [
    ("region", "r", "r_regionkey", "r_name"),
    ("nation", "n", "n_nationkey", "n_name"),
    ("customer", "c", "c_custkey", "c_mktsegment"),
    ("orders", "o", "o_orderkey", "o_orderpriority"),
    ("supplier", "s", "s_suppkey", "s_name"),
    ("part", "p", "p_partkey", "p_name"),
]
# Table, source, target, label, number of the kind of edge.
LINKS = [
    ("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "HAS_NATION", 0),
    ("customer", ("n", "c_nationkey"), ("c", "c_custkey"), "HAS_CUSTOMER", 1),
    ("supplier", ("n", "s_nationkey"), ("s", "s_suppkey"), "HAS_SUPPLIER", 2),
    ("orders", ("c", "o_custkey"), ("o", "o_orderkey"), "PLACED", 3),
    ("lineitem", ("o", "l_orderkey"), ("p", "l_partkey"), "CONTAINS", 4),
    ("lineitem", ("s", "l_suppkey"), ("p", "l_partkey"), "SUPPLIES", 5),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"),
            F.col(label).alias("label"),
            F.concat(F.lit('{"name":"'), F.col(label), F.lit('","kind":"'), F.lit(name), F.lit('"}')).alias("attributes"),
            (F.col(key).cast("long") * 10 + i).alias("embed_id"),
        )
        for i, (name, letter, key, label) in enumerate(KINDS)
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, (a, source), (b, target), label, number in LINKS:
        pairs = table(spark, sf_dir, name).select(source, target)
        pairs = pairs.distinct() if name == "lineitem" else pairs
        code = F.col(source).cast("long") * 100_000_000 + F.col(target).cast("long")
        parts.append(
            pairs.select(
                F.concat(F.lit(a), F.col(source).cast("string")).alias("source"),
                F.concat(F.lit(b), F.col(target).cast("string")).alias("target"),
                F.lit(label).alias("label"),
                F.lit("{}").alias("attributes"),
                (code * 10 + number).alias("embed_id"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


_NODES_SQL = " UNION ALL ".join(
    f"SELECT '{letter}' || {key} AS id, {label} AS label, '{{\"name\":\"' || {label} || '\",\"kind\":\"{name}\"}}' AS attributes, "
    f"{key}::BIGINT * 10 + {i} AS embed_id FROM {name}"
    for i, (name, letter, key, label) in enumerate(KINDS)
)
_EDGES_SQL = " UNION ALL ".join(
    f"SELECT '{a}' || {source} AS source, '{b}' || {target} AS target, '{label}' AS label, '{{}}' AS attributes, "
    f"({source}::BIGINT * 100000000 + {target}) * 10 + {number} AS embed_id FROM "
    + (f"(SELECT DISTINCT {source}, {target} FROM {name}) x" if name == "lineitem" else name)
    for name, (a, source), (b, target), label, number in LINKS
)


def sql(body: str, *more: str) -> str:
    """A query over ``gn`` (nodes) and ``ge`` (edges), with further common tables."""
    parts = [f"gn AS ({_NODES_SQL})", f"ge AS ({_EDGES_SQL})", *more]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
