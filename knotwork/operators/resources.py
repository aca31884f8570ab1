"""Versioned resources: a current table and a history, kept by creations, updates and removals.

One table holds all resource types, partitioned by type. A batch of operations is ordered by (type, seq); every
operation gets the type's next transaction number. What an operation does follows from the one before it on the same
resource. Operations are range-partitioned by resource and number, so that a resource with a large share of them fills
as many partitions as it needs; what stands before a partition is the last row of the one before, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.mutate import keep_one, number_rows
from knotwork.session import cut, range_partitions

OPERATIONS = ("add", "update", "remove")


def _numbered(history: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations with their txid: the type's greatest so far, plus their place among the type's operations."""
    placed = number_rows(ops, "_n", 0, "resource_type", "seq", "id")
    first = placed.groupBy("resource_type").agg(F.min("_n").alias("_first"))
    known = history.groupBy("resource_type").agg(F.max("txid").alias("_known"))
    types = first.join(known, "resource_type", "left")  # one row per type
    return placed.join(types, "resource_type").select(
        *ops.columns, (F.col("_n") - F.col("_first") + F.coalesce("_known", F.lit(0)) + 1).alias("txid")
    )


def _with_previous(line: DataFrame) -> DataFrame:
    """Every row with ``exists``: the row before it on its resource leaves it in being, and ``held``: its body then.

    A row without operation is the resource as it was before the batch.
    """
    order = ["resource_type", "id", "txid"]
    ranged = cut(line.repartitionByRange(range_partitions(line), *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("resource_type", "id", "_part").orderBy("txid")
    row = F.struct("resource_type", "id", F.coalesce("op", F.lit("add")).alias("op"), "body")
    placed = ranged.withColumn("_lag", F.lag(row).over(w))
    tails = ranged.groupBy("_part").agg(F.max_by(row, F.struct(*order)).alias("_tail"))  # a row per partition
    before = tails.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_tail"))
    joined = placed.join(F.broadcast(before), "_part", "left")
    spans = (F.col("_tail.resource_type") == F.col("resource_type")) & (F.col("_tail.id") == F.col("id"))
    previous = F.coalesce("_lag", F.when(spans, F.col("_tail")))
    exists = F.coalesce(previous["op"] != "remove", F.lit(False))
    return joined.withColumn("exists", exists).withColumn("held", F.when(exists, previous["body"])).drop("_part", "_lag", "_tail")


def apply_operations(current: DataFrame, history: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history) after ``ops``: resource_type, id, op ('add', 'update', 'remove'), body, seq, ts.

    add: a resource that exists goes to the history as 'created' and becomes 'recreated', keeping its embed_id;
    else it is 'created'. update: the new body goes to the history as 'updated' and becomes current. remove: the
    current body goes to the history as 'deleted'; a resource that does not exist is not removed. Operations with
    unknown name, null id or type, or a body that is null (but for remove) do nothing.
    """
    valid = ops.where(
        F.col("op").isin(*OPERATIONS) & F.col("id").isNotNull() & F.col("resource_type").isNotNull()
        & (F.col("body").isNotNull() | (F.col("op") == "remove"))
    )
    numbered = cut(_numbered(history, valid))
    before = current.select(
        "resource_type", "id", F.lit(None).cast("string").alias("op"), F.col("resource").alias("body"),
        F.lit(None).cast(dict(ops.dtypes)["seq"]).alias("seq"), "ts", F.lit(0).cast("long").alias("txid"),
    )
    stepped = cut(_with_previous(numbered.unionByName(before.select(*numbered.columns))))
    acts = stepped.where("op is not null")
    logged = acts.select(
        "resource_type", "id", "txid", "ts",
        F.expr("case when op = 'add' and exists then 'created' when op = 'update' then 'updated' when op = 'remove' and exists then 'deleted' end").alias("status"),
        F.when(F.col("op") == "update", F.col("body")).otherwise(F.col("held")).alias("resource"),
    ).where("status is not null")
    last = keep_one(stepped, ["resource_type", "id"], F.col("txid").desc()).where("op is null or op <> 'remove'")
    # one row per resource on either side
    owned = current.select("resource_type", "id", F.col("embed_id").alias("old_embed_id"))
    changed = last.where("op is not null").join(owned, ["resource_type", "id"], "left").select(
        "resource_type", "id", "old_embed_id", "txid", "ts",
        F.expr("case when op = 'update' then 'updated' when exists then 'recreated' else 'created' end").alias("status"),
        F.col("body").alias("resource"),
    )
    top = current.groupBy("resource_type").agg(F.max("embed_id").alias("_top"))
    fresh = F.col("old_embed_id").isNull() | (F.col("status") == "updated")
    new = number_rows(changed.where(fresh), "_n", 0, "resource_type", "txid")
    firsts = new.groupBy("resource_type").agg(F.min("_n").alias("_first")).join(top, "resource_type", "left")
    new = new.join(firsts, "resource_type").withColumn("embed_id", F.col("_n") - F.col("_first") + F.coalesce("_top", F.lit(0)) + 1)
    kept = changed.where(~fresh).withColumn("embed_id", F.col("old_embed_id"))
    columns = ["resource_type", "id", "embed_id", "txid", "ts", "status", "resource"]
    untouched = current.join(numbered.select("resource_type", "id").distinct(), ["resource_type", "id"], "left_anti")
    now = untouched.select(*columns).unionByName(new.select(*columns)).unionByName(kept.select(*columns))
    return now, history.unionByName(logged.select(*history.columns))


def as_of(history_ops: DataFrame, txid: int) -> DataFrame:
    """The resources as they stood after the transaction: the last row of each up to it, unless a deletion."""
    upto = history_ops.where(F.col("txid") <= txid)
    return keep_one(upto, ["resource_type", "id"], F.col("txid").desc()).where("status <> 'deleted'")


def drop_relations(relations: DataFrame, removed: DataFrame) -> DataFrame:
    """Relations that touch none of the removed resources (column id)."""
    gone = removed.select("id").distinct()
    left = relations.join(gone, F.col("source_id") == F.col("id"), "left_anti")
    return left.join(gone, F.col("target_id") == F.col("id"), "left_anti")


def add_relations(relations: DataFrame, new: DataFrame, strict_target_unique: bool = False) -> DataFrame:
    """``relations`` and ``new``; equal (ends, types, document) keep the later one. Both ids and types are required.

    ``strict_target_unique`` allows one relation per target, the earliest.
    """
    required = ["source_id", "source_type", "target_id", "target_type"]
    if not new.where(" or ".join(f"{c} is null" for c in required)).isEmpty():
        raise ValueError("source and target need an id and a type")
    start = (relations.agg(F.max("embed_id")).first()[0] or 0) + 1
    both = relations.unionByName(number_rows(new, "embed_id", start, *required, "resource"), allowMissingColumns=True)
    once = keep_one(both, [*required, "resource"], F.col("embed_id").desc())
    return keep_one(once, ["target_id"], "embed_id") if strict_target_unique else once
