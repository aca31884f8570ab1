"""JSON documents as text: minify in field order, shallow merge, and the tree of all their values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knotwork.functions.arrow import arrow_schema
from knotwork.functions.strictjson import INVALID, decode, printable

_minified = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def _text(value: object) -> str:
    return printable(_minified.encode(value))


@F.pandas_udf(StringType())
def _minify(texts: pd.Series) -> pd.Series:
    return pd.Series([None if (v := decode(x)) is INVALID else _text(v) for x in texts], dtype="object")


def minify(column: Column | str) -> Column:
    """The document without layout, fields in their order; null where it is not valid JSON.

    This text is what edges are identified by, so field order counts.
    """
    return _minify(column)


@F.pandas_udf(StringType())
def _merge(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> str | None:
        x, y = decode(a), decode(b)
        if not isinstance(y, dict):
            return a if y is INVALID else _text(y)
        return _text({**x, **y} if isinstance(x, dict) else y)

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype="object")


def merge(old: Column | str, new: Column | str) -> Column:
    """Shallow merge: the new document's fields over the old one's; one that is no object gives way to the other."""
    return _merge(old, new)


@F.pandas_udf(StringType())
def _set_field(documents: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    def one(document: str | None, n: str, v: str | None) -> str | None:
        found = decode(document)
        found = dict(found) if isinstance(found, dict) else {}
        found[n] = v
        return _text(found)

    return pd.Series([one(*x) for x in zip(documents, name, value)], dtype="object")


def with_field(document: Column | str, name: str, value: Column) -> Column:
    """The object with a text field set; anything else counts as an empty object."""
    return _set_field(document, F.lit(name), value)


TREE = "_row long, key string, type string, num double, text string, fullkey string, depth int"


def _tree(batches: Iterator[pa.RecordBatch], schema: pa.Schema, depth: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = decode(document)
            if value is INVALID:
                continue
            stack = [(None, value, "$", 0)]
            while stack:
                key, value, full, level = stack.pop()
                kind = type(value)
                if kind is dict:
                    out.append((row, key, "object", None, _text(value), full, level))
                    if depth is None or level < depth:
                        stack.extend((printable(k), v, f"{full}.{printable(k)}", level + 1) for k, v in reversed(value.items()))
                elif kind is list:
                    out.append((row, key, "array", None, _text(value), full, level))
                    if depth is None or level < depth:
                        stack.extend((str(i), v, f"{full}[{i}]", level + 1) for i, v in reversed(list(enumerate(value))))
                elif value is None:
                    out.append((row, key, "null", None, None, full, level))
                elif kind is str:
                    out.append((row, key, "text", None, printable(value), full, level))
                else:
                    out.append((row, key, "boolean" if kind is bool else "number", float(value), None, full, level))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def json_tree(rows: DataFrame, row: str, document: str, depth: int | None = None) -> DataFrame:
    """Every value of every document: _row, key, type, num, text, fullkey, depth; one Arrow pass, no row-wise UDF.

    ``row`` is a whole-number key of the row. List elements have their place as key. Null and invalid documents
    give nothing. Numbers and booleans come as ``num``, all else as ``text`` (lists and objects as JSON).
    """
    schema = arrow_schema(TREE)
    return rows.select(F.col(row).cast("long").alias("_row"), F.col(document)).mapInArrow(
        lambda batches: _tree(batches, schema, depth), TREE
    )
