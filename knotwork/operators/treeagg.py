"""Per-key aggregation that no hot key can hold up: multi-level tree aggregation.

Level 0 works on chunks of a fixed number of rows, counted within each input split, so they do not depend on how
large files are: a chunk's rows of a key become one state, map-side. States then meet in rounds of logarithmic
fan-in: in each round the states of ``fan_in`` neighbouring chunks merge, until at most ``fan_in`` are left for the
root. A key that stands in all chunks so sends at most ``fan_in`` states to any one reducer in any round; a single
groupBy would send it one from every split at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (state from rows, merge of states)
_KINDS = {
    "count": (lambda c: F.count(c), F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}

#: Rows of a chunk.
CHUNK_ROWS = 4096
_CHUNK = "__kw_chunk"
#: Bits of the row's place within its split in a generated id.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Chunks:
    """Rows with the number of their chunk, how many chunks there can be, and how many rows there are."""

    rows: DataFrame
    n_chunks: int
    n_rows: int


def chunked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Chunks:
    """Number the chunks of ``rows``: neighbouring chunks have neighbouring numbers.

    One job sizes the splits; it needs no column, so a scan costs it next to nothing. ``rows`` should be a scan with
    narrow steps, since its steps run once for that.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    at = F.monotonically_increasing_id()
    split = F.shiftright(at, _PLACE_BITS)
    piece = F.floor(at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) / F.lit(chunk_rows))
    placed = rows.select(split.alias("split"), piece.alias("piece"))
    splits, pieces, n = placed.agg(F.max("split") + 1, F.max("piece") + 1, F.count(F.lit(1))).first()
    numbered = rows.withColumn(_CHUNK, split * F.lit(pieces or 1) + piece)
    return Chunks(numbered, (splits or 0) * (pieces or 0), n)


def tree_aggregate(
    rows: DataFrame | Chunks,
    keys: list[str],
    aggs: dict[str, tuple[str, Column]],
    fan_in: int = 16,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per distinct ``keys`` with the named aggregates; ``aggs`` maps a name to (kind, column).

    Kinds are count, sum, min and max (nulls as in SQL). Null keys form groups of their own, as in GROUP BY. Rows
    may come chunked already. An empty input gives no rows. The number of rounds is the logarithm of the number of
    chunks; should the splits be others by the time the rounds run, the result stays the same.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    chunks = rows if isinstance(rows, Chunks) else chunked(rows, chunk_rows)
    state = [_KINDS[kind][0](column).alias(name) for name, (kind, column) in aggs.items()]
    merge = [_KINDS[aggs[name][0]][1](F.col(name)).alias(name) for name in aggs]
    level, left = chunks.rows.groupBy(*keys, _CHUNK).agg(*state), chunks.n_chunks
    while left > fan_in:
        level = level.withColumn(_CHUNK, F.floor(F.col(_CHUNK) / F.lit(fan_in))).groupBy(*keys, _CHUNK).agg(*merge)
        left = -(-left // fan_in)
    return level.groupBy(*keys).agg(*merge)


def by_side(edges: DataFrame, *extra: str, source: str = "source", target: str = "target") -> DataFrame:
    """Each edge once per side: side, node_id and the ``extra`` columns."""
    ends = F.array(
        F.struct(F.lit("source").alias("side"), F.col(source).alias("node_id")),
        F.struct(F.lit("target").alias("side"), F.col(target).alias("node_id")),
    )
    return edges.select(*extra, F.inline(ends))


def _ends(edges: DataFrame, chunk_rows: int, *extra: str) -> Chunks:
    """Both ends of each edge with an id, in chunks of edges."""
    chunks = chunked(edges.select("source", "target", *extra), chunk_rows)
    return Chunks(by_side(chunks.rows, _CHUNK, *extra).where("node_id is not null"), chunks.n_chunks, chunks.n_rows)


def edge_profile(edges: DataFrame, fan_in: int = 16, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges of every node by side, label and month of ``created_at``, with first and last time.

    Every id comes out, null label and null month as groups of their own; null endpoints are no ids.
    """
    ends = _ends(edges, chunk_rows, "label", "created_at")
    rows = ends.rows.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return tree_aggregate(
        Chunks(rows, ends.n_chunks, ends.n_rows),
        ["side", "node_id", "label", "month"],
        {"n_edges": ("count", F.lit(1)), "first_at": ("min", F.col("created_at")), "last_at": ("max", F.col("created_at"))},
        fan_in,
    )


def heavy_ids(edges: DataFrame, percent: int = 2, fan_in: int = 16, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(side, node_id, n_edges) of ids in at least ``percent`` per cent of all rows of that side's column.

    Repeated rows and rows with a null endpoint count as rows; null is no id. No rows, no ids.
    """
    ends = _ends(edges, chunk_rows)
    counts = tree_aggregate(ends, ["side", "node_id"], {"n_edges": ("count", F.lit(1))}, fan_in)
    return counts.where(F.col("n_edges") * 100 >= F.lit(ends.n_rows * percent))
