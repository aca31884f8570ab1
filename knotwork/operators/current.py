"""Current state from a stream of inserts, updates and deletes.

Deduplicate by (key, sequence), rank what is left by the log sequence, keep the latest row per key, merge it into
the base and drop what ends in a deletion. Both rankings ask for one row, so Spark limits each group to one row
*before* the shuffle (WindowGroupLimit): a key with a third of all rows sends one row per map task, not all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.changefeed import usable


def latest_changes(
    feed: DataFrame, key: str = "id", seq: str = "txid", ts: str = "ts", status: str = "status", body: str = "resource"
) -> DataFrame:
    """The last usable row of each key, with ``__kw_deleted``.

    Of rows with equal (key, sequence) the one with the latest time counts, null being earliest; of rows equal in
    that too the one with the greatest body, so that the result does not depend on arrival. Rows without key or
    sequence are no changes. An empty feed gives no rows.
    """
    rows = usable(feed, key, seq, status, body)
    once = Window.partitionBy(key, seq).orderBy(F.col(ts).desc_nulls_last(), F.col(body).desc_nulls_last(), F.col("__kw_deleted"))
    last = Window.partitionBy(key).orderBy(F.col(seq).desc())
    rows = rows.withColumn("__kw_rank", F.row_number().over(once)).where("__kw_rank = 1")
    return rows.withColumn("__kw_rank", F.row_number().over(last)).where("__kw_rank = 1").drop("__kw_rank")


def apply_changes(
    base: DataFrame | None,
    feed: DataFrame,
    key: str = "id",
    seq: str = "txid",
    ts: str = "ts",
    status: str = "status",
    body: str = "resource",
) -> DataFrame:
    """``base`` with the feed applied: one row per key that exists at the end, in the feed's columns.

    ``base`` (or None) holds at most one row per key and the feed's columns; columns only one side has are null on
    the other. A base row gives way to a change of the same or a later sequence and stays when the change is older;
    a base row with a null sequence is the oldest. Base rows that no change touches stay as they are.
    """
    changes = latest_changes(feed, key, seq, ts, status, body)
    if base is None:
        return changes.where(~F.col("__kw_deleted")).drop("__kw_deleted")
    both = base.withColumn("__kw_deleted", F.lit(False)).withColumn("__kw_side", F.lit(0)).unionByName(
        changes.withColumn("__kw_side", F.lit(1)), allowMissingColumns=True
    )
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc_nulls_last(), F.col("__kw_side").desc())
    merged = both.withColumn("__kw_rank", F.row_number().over(newest)).where("(__kw_rank = 1) and not __kw_deleted")
    return merged.drop("__kw_rank", "__kw_side", "__kw_deleted")
