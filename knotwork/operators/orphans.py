"""References to records that do not exist: an incrementally kept state of pending orphans.

State. ``index`` has one row per parent id: the earliest time it exists from and whether a parent without a time
makes that unknown. ``ledger`` has one row per reference that had no parent when it came: 'waiting' until a parent
arrives, then 'resolved' with that time, 'waiting' again if the parent is deleted. ``refs`` are all references seen,
so that a deletion can reopen those that had their parent from the start.

A batch probes, resolves and reopens by joins on the parent id, whose other side is unique per id. Ids with more than a
thousandth of the references, at most a thousand by arithmetic, are found first and joined by broadcast, in every
one of these joins, so a hot id is never shuffled to one task. A batch that comes again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.treeagg import by_side
from knotwork.schema import ORPHAN_INDEX, ORPHAN_LEDGER, ORPHAN_REFS
from knotwork.session import spool

#: An id is hot from this share of the references on; at most 1 / HOT ids can be.
HOT = 0.001



@dataclass(frozen=True)
class OrphanState:
    """``fresh``: nothing has happened yet, so that a first batch need not be compared with empty tables."""

    index: DataFrame
    ledger: DataFrame
    refs: DataFrame | None = None
    fresh: bool = False


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark.createDataFrame([], ORPHAN_INDEX), spark.createDataFrame([], ORPHAN_LEDGER), spark.createDataFrame([], ORPHAN_REFS), True)


def references(edges: DataFrame, ref_id: str = "embed_id", at: str = "created_at") -> DataFrame:
    """ref_id, side, ref, at: the non-null endpoints of edges. An empty string is a reference."""
    rows = edges.select(F.col(ref_id).alias("ref_id"), F.col(at).alias("at"), "source", "target")
    return by_side(rows, "ref_id", "at").withColumnRenamed("node_id", "ref").where("ref is not null")


def parents(nodes: DataFrame, key: str = "id", at: str = "created_at") -> DataFrame:
    """Index rows of parent records: one per id, repeated records merged. Null ids are no parents."""
    return (
        nodes.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("ref"))
        .agg(F.min(at).alias("first_at"), F.bool_or(F.col(at).isNull()).alias("untimed"))
    )


def _merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("ref").agg(F.min("first_at").alias("first_at"), F.bool_or("untimed").alias("untimed"))


def _hot(rows: DataFrame) -> DataFrame:
    """The ids with more than a thousandth of the rows: a table of at most a thousand."""
    counts = spool(rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > F.lit(total * HOT)).select("ref")


def _attach(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``rows`` left joined with ``keyed`` (unique per ref): hot ids by broadcast, the others by shuffle."""
    hot = F.broadcast(_hot(rows))
    by_broadcast = rows.join(hot, "ref", "left_semi").join(F.broadcast(keyed.join(hot, "ref", "left_semi")), "ref", "left")
    return by_broadcast.unionByName(rows.join(hot, "ref", "left_anti").join(keyed, "ref", "left"))


def _unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` that are not in ``known``: the same reference at the same time. Spread by reference, so none is hot."""
    r, k = rows.alias("r"), known.select("ref_id", "side", "ref", "at").alias("k")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("ref_id", "side", "ref", "at")]
    return r.join(k, same[0] & same[1] & same[2] & same[3], "left_anti").select("r.*")


def _probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References without a parent at their time, with the index row of a parent that came later."""
    late = (F.col("first_at") > F.col("at")) & ~F.col("untimed")
    missing = F.col("untimed").isNull()
    keys = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least_at"))
    probed = spool(
        keys.join(index, "ref", "left").select(
            "ref", "n", "first_at", "untimed", (missing | ((F.col("first_at") > F.col("least_at")) & ~F.col("untimed"))).alias("suspect")
        )
    )
    total = probed.agg(F.sum("n")).first()[0] or 0
    hot = probed.where(F.col("n") > F.lit(total * HOT)).select("ref", "first_at", "untimed", "suspect")
    cold = probed.where((F.col("n") <= F.lit(total * HOT)) & F.col("suspect")).select("ref", "first_at", "untimed")
    hot_rows = refs.join(F.broadcast(hot.where("suspect").drop("suspect")), "ref")
    cold_rows = refs.join(F.broadcast(hot.select("ref")), "ref", "left_anti").join(cold, "ref")
    return hot_rows.unionByName(cold_rows).where(missing | late)


def advance(
    state: OrphanState,
    new_refs: DataFrame | None = None,
    new_parents: DataFrame | None = None,
    deleted: DataFrame | None = None,
    all_refs: DataFrame | None = None,
) -> OrphanState:
    """The state after one batch: deletions reopen, arriving parents resolve waiting orphans, references probe.

    ``new_refs`` as `references` gives them, ``new_parents`` as `parents`, ``deleted`` with column ref; ``all_refs``
    stands for the state's own references, for a caller that keeps them elsewhere. A parent that arrives in the
    batch of a reference but later than it leaves the reference in the ledger, resolved at the parent's time; of
    several parents the earliest time counts, one without time makes it null. Where either time is null a parent is
    not later. Repeated references are one, within a batch and over batches.
    """
    index, ledger, fresh = state.index, state.ledger, state.fresh
    never = F.lit(None).cast("timestamp")
    if deleted is not None and not fresh:
        gone = deleted.select("ref").where("ref is not null").distinct().withColumn("_gone", F.lit(True))
        index = index.join(gone, "ref", "left_anti")
        reopened = _attach(ledger, gone).select(
            "ref_id", "side", "ref", "at",
            F.when(F.col("_gone"), "waiting").otherwise(F.col("status")).alias("status"),
            F.when(F.col("_gone").isNull(), F.col("resolved_at")).alias("resolved_at"),
        )
        seen = all_refs if all_refs is not None else state.refs
        if seen is not None:
            orphaned = _attach(seen, gone).where("_gone").select("ref_id", "side", "ref", "at").distinct()
            opened = _unknown(orphaned, ledger).select("*", F.lit("waiting").alias("status"), never.alias("resolved_at"))
            reopened = reopened.unionByName(opened)
        ledger = reopened
    if new_parents is not None:
        index = new_parents if fresh else _merge_index(index, new_parents)
        if not fresh:
            arrived = new_parents.select("ref", F.col("first_at").alias("_at"), F.col("untimed").alias("_untimed"))
            waits, here = F.col("status") == "waiting", F.col("_untimed").isNotNull()
            earliest = F.when(waits, F.col("_at")).when(F.col("resolved_at").isNotNull(), F.least("resolved_at", "_at"))
            ledger = _attach(ledger, arrived).select(
                "ref_id", "side", "ref", "at",
                F.when(here, "resolved").otherwise(F.col("status")).alias("status"),
                F.when(here, F.when(~F.col("_untimed"), earliest)).otherwise(F.col("resolved_at")).alias("resolved_at"),
            )
    refs = state.refs
    if new_refs is not None:
        opened = _probe(new_refs, index).select(
            "ref_id", "side", "ref", "at",
            F.when(F.col("untimed").isNull(), "waiting").otherwise("resolved").alias("status"),
            F.col("first_at").alias("resolved_at"),
        ).distinct()
        ledger = opened if fresh else ledger.unionByName(_unknown(opened, ledger))
        if refs is not None:
            once = new_refs.select("ref_id", "side", "ref", "at").distinct()
            refs = once if fresh else refs.unionByName(_unknown(once, refs))
    return OrphanState(index, ledger, refs)


def orphan_ledger(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every reference of ``edges`` that had no parent in ``nodes`` at its time: one batch from an empty state."""
    return advance(empty_state(edges.sparkSession), references(edges), parents(nodes)).ledger


def still_orphans(ledger: DataFrame) -> DataFrame:
    """The references of the ledger without a parent at their time: waiting, or resolved by a later one."""
    return ledger.where((F.col("status") == "waiting") | (F.col("resolved_at") > F.col("at")))


def snapshot(ledger: DataFrame, table: str = "edges") -> DataFrame:
    """Counts per table, side and month of the reference (null month: reference without time)."""
    return ledger.groupBy(
        F.lit(table).alias("tbl"), "side", F.date_format("at", "yyyy-MM").alias("month")
    ).agg(
        F.count(F.lit(1)).alias("orphans"),
        F.count_if(F.col("status") == "waiting").alias("waiting"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if((F.col("status") == "resolved") & (F.date_format("resolved_at", "yyyy-MM") == F.date_format("at", "yyyy-MM"))).alias("resolved_in_month"),
    )
