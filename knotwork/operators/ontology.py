"""Ontologies: classes with their properties, checks of nodes against them, the graph of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.jsonschema import meets_by_type
from knotwork.operators.mutate import add_edges, add_node_type, add_nodes

# Fixed value: the text that callers look for.
NO_MATCH = "Node type or attributes does not match any of the provided ontologies."


def type_name(declared: str) -> str:
    """The element type of a declared type: List[T], list<T>, Optional[T] and T[] give T."""
    text = declared.strip()
    while True:
        low = text.lower()
        for head in ("list", "optional", "sequence", "array", "typing.list", "typing.optional"):
            if low.startswith(head) and len(text) > len(head) and text[len(head)] in "[<" and text[-1] in "]>":
                text = text[len(head) + 1 : -1].strip()
                break
        else:
            if text.endswith("[]"):
                text = text[:-2].strip()
                continue
            return text.rpartition(".")[2]


def from_types(spark: SparkSession, classes: dict[str, dict[str, str]]) -> DataFrame:
    """The ontology table of {class: {property: declared type}}."""
    rows = [(c, p, None if t is None else type_name(str(t))) for c, ps in classes.items() for p, t in (ps.items() or [(None, None)])]
    return spark.createDataFrame(rows, "class string, property string, range string")


def class_properties(ontology: DataFrame) -> DataFrame:
    """class, properties: the sorted property names; an empty list for a class without any."""
    return ontology.groupBy("class").agg(F.array_sort(F.collect_set("property")).alias("properties"))


def match(nodes: DataFrame, ontology: DataFrame, ignore: tuple[str, ...] = ("id",)) -> DataFrame:
    """Nodes with ``valid``: the label is a class and the fields of the document are exactly its properties.

    A class without properties takes any fields; ``ignore`` are fields that never count. Ontologies are small
    (classes of a schema); the table is broadcast only if adaptive execution finds it so.
    """
    fields = F.array_sort(F.array_except(F.coalesce(F.json_object_keys("attributes"), F.array()), F.array(*(F.lit(x) for x in ignore))))
    classes = class_properties(ontology).select(
        F.col("class").alias("_class"), F.array_sort(F.array_except("properties", F.array(*(F.lit(x) for x in ignore)))).alias("_properties")
    )
    joined = nodes.join(classes, F.col("label") == F.col("_class"), "left")
    fits = F.col("_class").isNotNull() & ((F.size("_properties") == 0) | (F.col("_properties") == fields))
    return joined.withColumn("valid", fits).drop("_class", "_properties")


def match_schemas(nodes: DataFrame, schemas: dict) -> DataFrame:
    """Nodes with ``valid``: the label is a type that has a JSON Schema and the document meets it."""
    return nodes.withColumn("valid", F.coalesce(F.col("label").isin(*schemas), F.lit(False)) & meets_by_type("attributes", "label", schemas))


def insert_with_ontologies(
    nodes: DataFrame, edges: DataFrame, new: DataFrame, ontologies: list[DataFrame], delete_if_not_matching: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the new nodes that fit any ontology, a type node for each class and instance_of edges.

    A node that fits none is an error, or with ``delete_if_not_matching`` removed from the graph if it is there.
    """
    if not ontologies:
        raise ValueError("no ontology given")
    checked = new
    for i, ontology in enumerate(ontologies):
        checked = match(checked, ontology).withColumnRenamed("valid", f"_valid{i}")
    fits = F.lit(False)
    for i in range(len(ontologies)):
        fits = fits | F.col(f"_valid{i}")
    checked = checked.withColumn("valid", fits).drop(*(f"_valid{i}" for i in range(len(ontologies))))
    bad = checked.where("not valid")
    if not delete_if_not_matching and not bad.isEmpty():
        raise ValueError(NO_MATCH)
    good = checked.where("valid").drop("valid")
    nodes = nodes.join(bad.select("id"), "id", "left_anti")
    types = good.select("label").distinct().select(F.concat(F.lit("type:"), "label").alias("id"), "label", F.lit("{}").alias("attributes"))
    nodes = add_node_type(add_nodes(nodes, good), types.withColumn("label", F.concat(F.lit("type:"), F.col("label"))))
    links = good.select(
        F.col("id").alias("source"), F.concat(F.lit("type:"), "label").alias("target"), F.lit("instance_of").alias("label"), F.lit("{}").alias("attributes")
    )
    return nodes, add_edges(nodes, edges, links)


def class_graph(ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): classes, and an edge for each property whose type is another class."""
    classes = ontology.select("class").distinct()
    edges = ontology.where("property is not null").join(classes.select(F.col("class").alias("range")), "range", "left_semi")
    return classes.select(F.col("class").alias("id")), edges.where("class <> range").select(
        F.col("class").alias("source"), F.col("range").alias("target"), F.col("property").alias("label")
    ).distinct()


def resource_nodes(resources: DataFrame, body: str = "resource", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of resources: id, type as label, document, and columns to keep. Dates in JSON are ISO text already."""
    return resources.select(
        *keep,
        F.get_json_object(body, "$.id").alias("id"), F.get_json_object(body, "$.resourceType").alias("label"), F.col(body).alias("attributes")
    ).where("id is not null and label is not null")


def read_rdf(path: str) -> dict[str, dict[str, str]]:
    """Classes and properties of an RDF/XML ontology file: {class: {property: range}}.

    Reads owl:Class / rdfs:Class and properties with rdfs:domain and rdfs:range. A missing file or text that is no
    XML raises what reading it raises.
    """
    import xml.etree.ElementTree as ET

    # The names RDF/XML uses.
    rdf, rdfs, owl = (
        "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}",
        "{http://www.w3.org/2000/01/rdf-schema#}",
        "{http://www.w3.org/2002/07/owl#}",
    )

    def name(uri: str | None) -> str:
        return (uri or "").replace("#", "/").rstrip("/").rpartition("/")[2]

    root = ET.parse(path).getroot()
    classes: dict[str, dict[str, str]] = {}
    for e in root.iter():
        if e.tag in (owl + "Class", rdfs + "Class"):
            if own := name(e.get(rdf + "about") or e.get(rdf + "ID")):
                classes.setdefault(own, {})
    for e in root.iter():
        if e.tag in (owl + "ObjectProperty", owl + "DatatypeProperty", rdf + "Property"):
            own = name(e.get(rdf + "about") or e.get(rdf + "ID"))
            ranges = [name(x.get(rdf + "resource")) for x in e.findall(rdfs + "range")]
            for domain in e.findall(rdfs + "domain"):
                if target := name(domain.get(rdf + "resource")):
                    classes.setdefault(target, {})[own] = ranges[0] if ranges else ""
    return classes
