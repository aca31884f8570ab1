"""Nested records into related flat tables by shared inlining.

Pass 1 reads the schema graph off the data: an edge (parent element, child element, repeated?) for every object
found in an object; element names are field names, the root is the record's table. Tables are made for the root,
for repeated elements and for elements with several parents. A recursive element has a parent outside its cycle
and one in it, so it is among these. All other elements are singletons and inlined into the nearest table around.

Pass 2 shreds each record: one row per table element, with the path of its place, the path of the row it belongs
to (the foreign key, together with the record's key) and its inlined values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.functions.strictjson import INVALID, decode, encode, printable
from knotwork.session import spool

ROWS = (
    "tbl string, record_key string, element string, path string, parent_element string, parent_row string, "
    "parent_path string, pos long, columns map<string,string>, inlined array<struct<path: string, parent_path: string>>"
)
GRAPH = "parent string, child string, repeated boolean"
_MARKS = re.compile(r"[.\[\\]")
#: Rows that leave Python together.
FLUSH = 8192
#: Schema edges that a task remembers, to send each only once or a few times.
REMEMBERED = 50_000
#: Names of table elements that are broadcast. Where field names are data there may be more; every record then gets
#: the table elements among its own names by a join. The layout is the same.
BROADCAST_NAMES = 100_000
#: A name is hot, and joined by broadcast, from this share of all (record, name) pairs on.
HOT = 0.001


def read_object(text: str | None) -> dict | None:
    """The top-level object; a JSON string is read once more. None where there is no object."""
    value = decode(text)
    if isinstance(value, str):
        value = decode(value)
    return value if value is not INVALID and isinstance(value, dict) else None


def _objects(value: object, path: str) -> Iterator[tuple[dict, str, bool]]:
    """The objects of a field's value (through lists of lists), their paths and whether they stand in a list."""
    if isinstance(value, dict):
        yield value, path, False
    elif isinstance(value, list):
        stack = [(value, path)]
        while stack:
            items, base = stack.pop()
            for i, item in enumerate(items):
                if isinstance(item, dict):
                    yield item, f"{base}[{i}]", True
                elif isinstance(item, list):
                    stack.append((item, f"{base}[{i}]"))


def _scalars(value: list) -> Iterator[tuple[str, object]]:
    """What stands beside the objects of a list (through lists of lists) and its place; nulls and empty lists only count."""
    stack = [(value, "")]
    while stack:
        items, base = stack.pop()
        for i, item in enumerate(items):
            if isinstance(item, list):
                stack.append((item, f"{base}[{i}]"))
            elif item is not None and not isinstance(item, dict):
                yield f"{base}[{i}]", item


def column_name(name: str) -> str:
    """A field's name in a column's, where bare dots and brackets are of the path."""
    return _MARKS.sub(r"\\\g<0>", name)


def _graph(root: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, bool]] = set()
        for batch in batches:
            fresh: set[tuple[str, str, bool]] = set()
            for text in batch.column(0).to_pylist():
                top = read_object(text)
                if top is None:
                    continue
                stack = [(top, root)]
                while stack:
                    node, element = stack.pop()
                    for name, value in node.items():
                        if type(value) is dict or type(value) is list:
                            for child, _, repeated in _objects(value, ""):
                                edge = (element, name, repeated)
                                if edge not in seen:
                                    seen.add(edge)
                                    fresh.add(edge)
                                stack.append((child, name))
                if len(seen) > REMEMBERED:  # forget, so that memory stays bounded; the graph is made distinct later
                    seen = set()
            if fresh:
                a, b, c = zip(*fresh)
                yield pa.record_batch(
                    [pa.array([printable(x) for x in a]), pa.array([printable(x) for x in b]), pa.array(c)],
                    names=["parent", "child", "repeated"],
                )

    return scan


@dataclass(frozen=True)
class Layout:
    """The elements that are tables; None: all are. ``names`` (column name) holds them where they are too many to send."""

    root: str
    tables: frozenset[str] | None
    names: DataFrame | None = None


def analyse(records: DataFrame, body: str, root: str, most: int = BROADCAST_NAMES) -> Layout:
    """The layout of a table's records, from the schema graph of all of them; its parents are counted in the cluster."""
    edges = records.select(body).mapInArrow(_graph(root), GRAPH).distinct()
    tables = edges.groupBy("child").agg(F.bool_or("repeated").alias("repeated"), F.count_distinct("parent").alias("n"))
    names = spool(tables.where("repeated or n > 1").select(F.col("child").alias("name")))
    if names.count() > most:
        return Layout(root, frozenset({root}), names)
    return Layout(root, frozenset({root} | {r.name for r in names.collect()}))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record's distinct names of fields that hold objects."""
    for batch in batches:
        rows, held = [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: set[str] = set()
            stack = [top] if (top := read_object(text)) is not None else []
            while stack:
                for name, value in stack.pop().items():
                    inside = [x for x, _, _ in _objects(value, "")]
                    if inside:
                        own.add(printable(name))
                        stack += inside
            rows += [row] * len(own)
            held += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(held, pa.string())], names=["row", "name"])


def _with_own_tables(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (record_key, body) with the table elements among each record's names, hot names by broadcast."""
    rows = spool(rows.withColumn("row", F.monotonically_increasing_id()))
    pairs = spool(rows.select("row", "body").mapInArrow(_names, "row long, name string"))
    counts = spool(pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > F.lit(total * HOT)).select("name"))
    near = pairs.join(F.broadcast(hot.join(names, "name", "left_semi")), "name", "left_semi")
    far = pairs.join(hot, "name", "left_anti").join(names, "name", "left_semi")
    own = near.unionByName(far).groupBy("row").agg(F.collect_set("name").alias("own"))  # a record's own names
    return rows.join(own, "row", "left").select("record_key", "body", "own")


def _shredder(tbl: str, layout: Layout, values: bool):
    root, everywhere = layout.root, layout.tables
    schema = arrow_schema(ROWS)

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema
            )

        for batch in batches:
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(batch)
            for key, text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own):
                top = read_object(text)
                if top is None:
                    continue
                tables = everywhere if not names else everywhere.union(names)
                # a row still to be walked: object, element, path, its parent's element, row and path, place in its list
                rows = [(top, root, "", None, None, None, 0)]
                while rows:
                    node, element, path, above, above_row, above_path, pos = rows.pop()
                    columns: list[tuple[str, str]] = []
                    inlined: list[dict] = []
                    walk = [(node, path, "")]
                    while walk:
                        part, at, prefix = walk.pop()
                        for name, value in part.items():
                            kind = type(value)
                            name = name if name.isascii() else printable(name)
                            here = f"{at}.{name}" if at else name
                            column = prefix + column_name(name)
                            if kind is dict or kind is list:
                                found = False
                                for i, (child, where, repeated) in enumerate(_objects(value, here)):
                                    found = True
                                    if repeated or tables is None or name in tables:
                                        rows.append((child, name, where, element, path, at, i))
                                    else:
                                        inlined.append({"path": where, "parent_path": at})
                                        walk.append((child, where, f"{column}."))
                                if values and not found:
                                    columns.append((column, encode(value)))
                                elif values and kind is list:
                                    columns.extend((column + place, encode(x)) for place, x in _scalars(value))
                            elif values:
                                columns.append((column, encode(value)))
                    out.append((tbl, key, element, path, above, above_row, above_path, pos, list(dict(columns).items()), inlined))
                    if len(out) >= FLUSH:
                        yield flush()
        if out:
            yield flush()

    return shred


def shred(records: DataFrame, tbl: str, key: str, body: str, values: bool = True, layout: Layout | None = None) -> DataFrame:
    """The rows of all flat tables of ``records`` (columns of ROWS), one DataFrame.

    ``element`` names the flat table, (record_key, path) its row, (record_key, parent_row) in ``parent_element``
    the row it belongs to; ``parent_path`` is the nearest object around, which may be one inlined in that row.
    ``columns`` holds its scalars and lists of scalars as canonical JSON, inlined ones under their relative path;
    ``inlined`` the inlined objects. A list that holds objects gives rows; scalars beside them in the same list
    have a column each, named with their place as in ``a[2]``. A dot, bracket or backslash of a field's own name
    stands after a backslash. ``values=False`` leaves ``columns`` empty. A body that is null, not valid or no object (after one
    unwrapping) gives no rows; empty objects do; null elements only count in the numbering.
    """
    layout = layout or analyse(records, body, tbl)
    rows = records.select(F.col(key).cast("string").alias("record_key"), F.col(body).alias("body"))
    if layout.names is not None:
        rows = _with_own_tables(rows, layout.names)
    return rows.mapInArrow(_shredder(tbl, Layout(layout.root, layout.tables), values), ROWS)


def objects(rows: DataFrame) -> DataFrame:
    """Every object below the top level: tbl, record_key, parent_path, path. Repeated records give theirs once."""
    own = F.when(F.col("parent_path").isNotNull(), F.array(F.struct("path", "parent_path"))).otherwise(F.array())
    return rows.select("tbl", "record_key", F.inline(F.concat(own, F.col("inlined")))).select(
        "tbl", "record_key", "parent_path", "path"
    ).distinct()


def flat_table(rows: DataFrame, element: str, columns: list[str]) -> DataFrame:
    """One flat table with the named value columns as strings; a column a row lacks is null."""
    own = rows.where(F.col("element") == element)
    return own.select(
        "record_key", "path", "parent_element", "parent_row", "pos", *(F.col("columns")[c].alias(c) for c in columns)
    )


def table_columns(rows: DataFrame, element: str) -> list[str]:
    """The value columns that occur in a flat table, by name."""
    names = rows.where(F.col("element") == element).select(F.explode(F.map_keys("columns")).alias("name")).distinct()
    return sorted(r.name for r in names.collect())
