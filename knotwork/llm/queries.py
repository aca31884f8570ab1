"""Queries of the llm problems: p6 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import copies, leak, mix, neighbours, spam
from knotwork.plans.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for collection, name, vec in (
        ("nodes", "nodes_embedding", "vector_node"),
        ("relations", "relations_embedding", "vector_relations"),
    ):
        found = neighbours.neighbours(table(spark, sf_dir, name), "embed_id", vec, neighbours.Search(min_cos=0.8))
        parts.append(
            neighbours.similar_pairs(found).select(
                F.lit(collection).alias("collection"), F.col("a").alias("embed_id_a"), F.col("b").alias("embed_id_b")
            )
        )
    return parts[0].unionByName(parts[1])


def _p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_runs(
        copies.canonical_nodes(table(spark, sf_dir, "nodes")).unionByName(
            copies.canonical_edges(table(spark, sf_dir, "edges"))
        )
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_members(_p7_runs(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(_p7_runs(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.where("run > 0").select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), paraphrases=True)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_report(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_report(spark, sf_dir).where("is_spam").select("doc_id")


QUERIES = {
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_found": p8_found,
    "p8_paraphrases": p8_paraphrases,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_report": p10_report,
}



def _similar_sql(collection: str, name: str, vec: str) -> str:
    return f"""SELECT '{collection}' AS collection, least(a, b) AS embed_id_a, greatest(a, b) AS embed_id_b FROM (
  SELECT x.embed_id AS a, y.embed_id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS cos FROM v_{name} x, v_{name} y
  WHERE x.embed_id <> y.embed_id AND list_cosine_similarity(x.v, y.v) >= 0.7
  QUALIFY row_number() OVER (PARTITION BY x.embed_id ORDER BY cos DESC, y.embed_id) <= 10) p WHERE cos >= 0.8"""


def _valid_sql(name: str, vec: str) -> str:
    return f"""v_{name} AS (SELECT DISTINCT embed_id, {vec}::DOUBLE[] AS v FROM {name} WHERE len({vec}) = 64
  AND NOT list_contains(list_transform({vec}, lambda x: x IS NULL OR isnan(x)), true) AND list_contains(list_transform({vec}, lambda x: x <> 0), true))"""


_FOLD = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_KEYED = f"""
raw AS (
  SELECT DISTINCT 'nodes' AS tbl, embed_id, {_FOLD.format("label")} AS head, attributes FROM nodes
  WHERE embed_id IS NOT NULL AND label IS NOT NULL AND attributes IS NOT NULL
  UNION SELECT DISTINCT 'edges', embed_id, length(source) || ':' || source || target, attributes FROM edges
  WHERE embed_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL AND attributes IS NOT NULL
), docs AS (SELECT *, CASE WHEN json_valid(attributes) AND json_type(CASE WHEN json_valid(attributes) THEN attributes END) = 'OBJECT' THEN attributes END AS doc FROM raw),
trees AS (
  SELECT tbl, embed_id, head, attributes, list_sort(list({_FOLD.format("t.fullkey")} || '=' || t.type ||
    CASE WHEN t.type = 'VARCHAR' THEN {_FOLD.format("t.atom ->> '$'")} ELSE coalesce(t.atom::VARCHAR, '') END)) AS body
  FROM (SELECT * FROM docs WHERE doc IS NOT NULL) d, json_tree(d.doc) t GROUP BY ALL
), keyed AS (
  SELECT tbl, embed_id, head, body FROM trees
  UNION ALL SELECT tbl, embed_id, head, ['text ' || {_FOLD.format("attributes")}] FROM docs WHERE doc IS NULL
), grouped AS (SELECT DISTINCT tbl, embed_id, min(embed_id) OVER w AS first, head, body FROM keyed WINDOW w AS (PARTITION BY tbl, head, body))"""

SQL: dict[str, str] = {
    "p6_found": "WITH "
    + ", ".join([_valid_sql("nodes_embedding", "vector_node"), _valid_sql("relations_embedding", "vector_relations")])
    + " SELECT DISTINCT * FROM ("
    + _similar_sql("nodes", "nodes_embedding", "vector_node")
    + " UNION ALL "
    + _similar_sql("relations", "relations_embedding", "vector_relations")
    + ") z",
    "p7_found": f"WITH {_KEYED} SELECT tbl, first AS embed_id_a, embed_id AS embed_id_b FROM grouped WHERE embed_id <> first",
    "p7_groups": f"WITH {_KEYED} SELECT tbl, first AS embed_id, count(*) AS n_copies FROM grouped GROUP BY tbl, first",
}
