"""Bundles of nested resources as a graph of resource types."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.functions.strictjson import printable
from knotwork.operators.mutate import keep_one
from knotwork.operators.shred import read_object

# Fixed value: the text that callers look for.
NO_BUNDLE = "The provided JSON file is not a FHIR Bundle"

FOUND = "parent string, label string, child string, nested boolean, bundle long, at long"


def _walk(bundle: dict) -> Iterator[tuple[str, str, str | None, bool]]:
    """(parent type, property, child type or None, child is a resource), in document order."""
    for name in bundle:
        if name != "entry":
            yield "Bundle", name, None, False
    entries = bundle.get("entry")
    todo = []
    for entry in reversed(entries if isinstance(entries, list) else [entries]):
        if isinstance(entry, dict) and isinstance(entry.get("resource"), dict):
            todo.append((entry["resource"], "Bundle", "instance_of"))
    while todo:
        resource, parent, label = todo.pop()
        kind = resource.get("resourceType")
        if not isinstance(kind, str) or not kind:
            continue
        yield parent, label, kind, True
        nested = []
        for name, value in resource.items():
            items = value if isinstance(value, list) else [value]
            for item in items:
                if isinstance(item, dict) and "resourceType" in item:
                    nested.append((item, kind, name))
                else:
                    yield kind, name, None, False
        todo.extend(reversed(nested))


def _scan(schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, tuple[int, int]] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top = read_object(text)
                if top is None or top.get("resourceType") != "Bundle":
                    continue
                for i, (parent, label, child, nested) in enumerate(_walk(top)):
                    edge = (parent, printable(label), child, nested)
                    place = (key or 0, i)
                    out[edge] = min(out.get(edge, place), place)
            if out:
                rows = [(*e, *p) for e, p in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return scan


def require_bundle(text: str) -> None:
    """ValueError unless a file's text is a Bundle."""
    top = read_object(text)
    if top is None or top.get("resourceType") != "Bundle":
        raise ValueError(NO_BUNDLE)


def type_edges(bundles: DataFrame, ontology: DataFrame, key: str = "id", body: str = "resource") -> DataFrame:
    """source, target, label: the graph of types in the bundles. Each batch reports every edge once.

    A bundle leads to its entries' resource types by instance_of, a resource to nested resources by the property,
    and to the type a property is declared with in ``ontology`` if that is a class. Edges are identified by their
    ends, so of several properties between two types the first in (bundle, document) order stays.
    """
    found = bundles.select(F.col(key).cast("long"), F.col(body)).mapInArrow(_scan(arrow_schema(FOUND)), FOUND)
    found = found.groupBy("parent", "label", "child", "nested").agg(F.min(F.struct("bundle", "at")).alias("place"))
    classes = ontology.select("class").distinct()
    declared = ontology.select(F.col("class").alias("parent"), F.col("property").alias("label"), F.col("range").alias("target")).join(
        classes.select(F.col("class").alias("target")), "target", "left_semi"
    )
    by_type = found.where("not nested").join(declared, ["parent", "label"]).select("parent", "target", "label", "place")
    direct = found.where("nested").select("parent", F.col("child").alias("target"), "label", "place")
    each = keep_one(direct.unionByName(by_type), ["parent", "target"], "place", "label")
    return each.select(F.col("parent").alias("source"), "target", "label")


def type_nodes(edges: DataFrame) -> DataFrame:
    """A node per type: id and label are the type."""
    names = edges.select(F.explode(F.array(F.lit("Bundle"), "source", "target")).alias("id")).distinct()
    return names.select("id", F.col("id").alias("label"), F.lit("{}").alias("attributes"))
