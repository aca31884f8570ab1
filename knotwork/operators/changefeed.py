"""What counts as a usable row of a change feed, shared by the history and the state operator.

A row is usable if it has a key and a sequence number, its status without outer white space and regardless of
case is created, updated, recreated or deleted and, unless deleted, its body is a valid JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.strictjson import is_json_object

# The status domain of the store.
LIVE = ("created", "updated", "recreated")
DELETED = "deleted"


def status_of(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def known_status(feed: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """Rows with key, sequence and a known status; adds ``__kw_deleted``. Needs no look at the body."""
    return (
        feed.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
        .withColumn("__kw_status", status_of(status))
        .where(F.col("__kw_status").isin(*LIVE, DELETED))
        .withColumn("__kw_deleted", F.col("__kw_status") == DELETED)
        .drop("__kw_status")
    )


def usable(feed: DataFrame, key: str, seq: str, status: str, body: str) -> DataFrame:
    """Usable rows. Bodies of deletions are not parsed."""
    rows = known_status(feed, key, seq, status)
    return rows.where(F.col("__kw_deleted") | is_json_object(F.when(~F.col("__kw_deleted"), F.col(body))))
