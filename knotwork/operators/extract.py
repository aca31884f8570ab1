"""Text to graph. An extractor is any callable text -> (nodes, edges); the default works by rules, offline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema

Extracted = tuple[list[tuple[str, str, str]], list[tuple[str, str, str, str]]]

NODES = "doc_id long, id string, label string, attributes string"
EDGES = "doc_id long, source string, target string, label string, attributes string"

_SENTENCE = re.compile(r"[^.!?\n]+")
_NAME = r"[A-Z][\w'-]*(?: [A-Z][\w'-]*)*"
_TRIPLE = re.compile(rf"\b({_NAME})(?:'s)? ((?:[a-z]+ ){{1,4}}?)(?:an? |the )?({_NAME})\b")


def rule_extractor(text: str) -> Extracted:
    """Subject, verb phrase, object of sentences whose subject and object are capitalised names."""
    nodes: dict[str, tuple[str, str, str]] = {}
    edges: dict[tuple, None] = {}
    for sentence in _SENTENCE.findall(text or ""):
        for a, verb, b in _TRIPLE.findall(sentence):
            for name in (a, b):
                nodes.setdefault(name, (name, "Entity", "{}"))
            if a != b:
                edges[a, b, "_".join(verb.split()), "{}"] = None
    return list(nodes.values()), list(edges)


def client_extractor(client) -> Callable[[str], Extracted]:
    """An extractor over a model client with ``extract(text) -> {"nodes": [...], "edges": [...]}``."""

    def run(text: str) -> Extracted:
        import json

        found = client.extract(text)
        as_text = lambda x: x if isinstance(x, str) else json.dumps(x)
        return (
            [(str(n["id"]), n["label"], as_text(n.get("attributes", {}))) for n in found["nodes"]],
            [(str(e["source"]), str(e["target"]), e["label"], as_text(e.get("attributes", {}))) for e in found["edges"]],
        )

    return run


def _runner(extractor: Callable[[str], Extracted], schema: pa.Schema, which: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, *found)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for found in extractor(text or "")[which]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def text_to_graph(
    documents: DataFrame, extractor: Callable[[str], Extracted] = rule_extractor, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every document; null texts give nothing."""
    rows = documents.select(F.col(doc_id).cast("long"), F.col(text))
    nodes = rows.mapInArrow(_runner(extractor, arrow_schema(NODES), 0), NODES)
    return nodes, rows.mapInArrow(_runner(extractor, arrow_schema(EDGES), 1), EDGES)
