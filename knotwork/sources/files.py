"""Reading and writing the other formats: JSON bundles, ontologies, class graphs, DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import ontology as onto
from knotwork.operators.bundle import NO_BUNDLE


def read_bundles(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """id, resource: one row per file. With ``check`` a file that is no Bundle, whichever, is an error that names it."""
    files = spark.read.option("wholetext", True).text(path)
    rows = files.select(F.xxhash64(F.col("_metadata.file_path")).alias("id"), F.col("value").alias("resource"))
    if check:
        kind = lambda text: F.try_variant_get(F.try_parse_json(text), "$.resourceType", "string")
        inner = F.try_variant_get(F.try_parse_json("resource"), "$", "string")  # a text in a text is read once more
        is_bundle = F.coalesce(kind(F.col("resource")), kind(inner)) == "Bundle"
        paths = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("resource"))
        wrong = paths.where(~F.coalesce(is_bundle, F.lit(False))).select("path").orderBy("path").first()  # of all files
        if wrong is not None:
            raise ValueError(f"{NO_BUNDLE}: {wrong.path}")
    return rows


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """The ontology table of an RDF/XML file."""
    return onto.from_types(spark, onto.read_rdf(path))


def write_class_graph(ontology: DataFrame, path: str) -> None:
    """Nodes and edges of the class graph as JSON under ``path``."""
    nodes, edges = onto.class_graph(ontology)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_ontology(ontology: DataFrame, path: str) -> None:
    ontology.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines with ``ord`` as sorted text files."""
    lines.orderBy("ord", "line").select("line").write.mode("overwrite").text(path)
