"""Records that are the same but for the way they are written.

Each record gets its canonical key: strings folded in case and punctuation, fields sorted. Keys are sorted
externally, range-partitioned by (hash, key, id), so that a group with a third of all rows fills as many partitions
as it needs. A single scan of each partition compares adjacent full keys and closes runs; runs cut by a partition
border are put together from at most two short rows per partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knotwork.functions.arrow import arrow_schema
from knotwork.functions.strictjson import INVALID, decode, encode
from knotwork.session import range_partitions, spool

_WORD = re.compile(r"[^\W_]+")
#: Parts of a key stand apart by this character, which no folded text holds.
_SEP = "\x1f"


def fold(text: str) -> str:
    """Case folded, every run of characters other than letters and digits one blank, none at the ends."""
    return " ".join(_WORD.findall(text.casefold()))


def _folded(value: object) -> object:
    """The value with strings and field names folded; fields as sorted pairs, so that their order is none."""
    kind = type(value)
    if kind is str:
        return fold(value)
    if kind is dict:
        return {"": sorted(([fold(k), _folded(v)] for k, v in value.items()), key=encode)}
    if kind is list:
        return [_folded(v) for v in value]
    return value


def fold_attributes(text: str) -> str:
    """Canonical text of attributes: by value if they are a JSON object, else folded as a whole."""
    value = decode(text)
    if value is INVALID or not isinstance(value, dict):
        return "t" + fold(text)
    try:
        return "o" + encode(_folded(value))
    except RecursionError:
        return "t" + fold(text)


@F.pandas_udf(StringType())
def _fold_all(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else fold(x) for x in texts], dtype="object")


@F.pandas_udf(StringType())
def _fold_attributes_all(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else fold_attributes(x) for x in texts], dtype="object")


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """tbl, key, id of nodes: label and attributes. Records with a null among these or the id are left out."""
    rows = nodes.select("embed_id", "label", "attributes").dropna()
    key = F.concat_ws(_SEP, _fold_all("label"), _fold_attributes_all("attributes"))
    return rows.select(F.lit("nodes").alias("tbl"), key.alias("key"), F.col("embed_id").alias("id"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """tbl, key, id of edges: exact endpoints and attributes; the label is no part of an edge's identity."""
    rows = edges.select("embed_id", "source", "target", "attributes").dropna()
    ends = [F.concat(F.length(c).cast("string"), F.lit(_SEP), F.col(c)) for c in ("source", "target")]
    key = F.concat_ws(_SEP, *ends, _fold_attributes_all("attributes"))
    return rows.select(F.lit("edges").alias("tbl"), key.alias("key"), F.col("embed_id").alias("id"))


RUNS = (
    "part int, tbl string, head long, id long, n long, is_first boolean, is_last boolean, digest binary"
)
FLUSH = 16384


def _scanner():
    schema = arrow_schema(RUNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        run: tuple[str, str] | None = None  # (tbl, key) of the open run
        head = last = None
        n, first = 0, True

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def close(is_last: bool) -> None:
            nonlocal first
            digest = hashlib.sha256(f"{run[0]}\0{run[1]}".encode()).digest() if first or is_last else None
            out.append((part, run[0], head, None, n, first, is_last, digest))
            first = False

        for batch in batches:
            for tbl, key, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if run is not None and key == run[1] and tbl == run[0]:
                    if own != last:
                        out.append((part, tbl, head, own, None, first, None, None))
                        n, last = n + 1, own
                else:
                    if run is not None:
                        close(False)
                    run, head, last, n = (tbl, key), own, own, 1
                if len(out) >= FLUSH:
                    yield flush()
        if run is not None:
            close(True)
            yield flush()

    return scan


def _resolve(borders: list) -> list[tuple[int, str, int, int, int]]:
    """(part, tbl, head of its first run, head of the group that run belongs to, copies the group gains from it)."""
    parts: dict[int, dict] = {}
    for r in borders:
        p = parts.setdefault(r.part, {})
        if r.is_first:
            p["first"] = r
        if r.is_last:
            p["last"] = r
    found = []
    open_digest, open_head = None, None
    for n in sorted(parts):
        first, last = parts[n]["first"], parts[n]["last"]
        if open_digest is not None and open_digest == first.digest:
            found.append((n, first.tbl, first.head, open_head, first.n))
            if first.is_last:
                continue  # the whole partition is of that group
        open_digest, open_head = last.digest, last.head
    return found


def copy_runs(canonical: DataFrame) -> DataFrame:
    """Groups of equal (tbl, key): tbl, head (smallest id), id, n.

    One row per group with ``id`` null and its number of copies ``n``, one row per further member with ``n`` null.
    Rows with the same key and id are one record. Null keys or ids must have been left out. Empty in, empty out.
    """
    spark = canonical.sparkSession
    rows = spool(canonical.withColumn("h", F.xxhash64("tbl", "key")))
    ordered = rows.repartitionByRange(range_partitions(rows), "h", "tbl", "key", "id").sortWithinPartitions(
        "h", "tbl", "key", "id"
    )
    runs = spool(ordered.select("tbl", "key", "id").mapInArrow(_scanner(), RUNS))
    borders = runs.where("id is null and (is_first or is_last)").collect()  # at most two rows per partition
    joins = _resolve(borders)
    gains: dict[tuple[str, int], int] = {}
    for _, tbl, _, group, n in joins:
        gains[tbl, group] = gains.get((tbl, group), 0) + n
    moved = spark.createDataFrame([(p, g) for p, _, _, g, _ in joins], "part int, group_head long")
    gained = spark.createDataFrame([(t, h, n) for (t, h), n in gains.items()], "tbl string, head long, gain long")
    runs = runs.join(F.broadcast(moved), "part", "left").withColumn("moved", F.col("is_first") & F.col("group_head").isNotNull())
    whole = runs.select(
        "tbl",
        F.when(F.col("moved"), F.col("group_head")).otherwise(F.col("head")).alias("head"),
        F.when(F.col("moved") & F.col("id").isNull(), F.col("head")).otherwise(F.col("id")).alias("id"),
        F.when(~F.col("moved"), F.col("n")).alias("n"),
    )
    return whole.join(F.broadcast(gained), ["tbl", "head"], "left").select(
        "tbl", "head", "id", (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n")
    )


def copy_groups(runs: DataFrame) -> DataFrame:
    """One representative per group with its exact number of copies, itself included."""
    return runs.where("id is null").select("tbl", F.col("head").alias("embed_id"), F.col("n").alias("n_copies"))


def copy_members(runs: DataFrame) -> DataFrame:
    """A row for each member but the representative."""
    return runs.where("id is not null").select(
        "tbl", F.col("head").alias("embed_id_a"), F.col("id").alias("embed_id_b")
    )
