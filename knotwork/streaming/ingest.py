"""Streams into a store: each micro-batch goes through the same batch operators, committed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators import current, mutate, orphans
from knotwork.sources.store import SnapshotStore


def stream_nodes(source: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """New nodes (id, label, attributes) into the store; known ids are passed over, so a replayed batch is harmless."""

    def apply(batch: DataFrame, _: int) -> None:
        nodes = store.read("nodes")
        store.append(nodes=mutate.add_nodes(nodes, batch).join(nodes.select("embed_id"), "embed_id", "left_anti"))

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_changes(source: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """A change feed into the store's current resources; older or repeated changes lose to what is there.

    Deletions stay as rows of status 'deleted', so that a change older than the deletion cannot bring the row back;
    `live` leaves them out.
    """

    def apply(batch: DataFrame, _: int) -> None:
        base = store.read("resources")
        latest = current.latest_changes(batch).withColumn("embed_id", F.lit(None).cast("long"))
        latest = latest.withColumn("status", F.when(F.col("__kw_deleted"), "deleted").otherwise(F.lower(F.trim("status")))).drop("__kw_deleted")
        both = base.unionByName(latest.select(*base.columns))
        store.commit(resources=mutate.keep_one(both, ["id"], F.col("txid").desc(), F.col("ts").desc_nulls_last(), F.col("resource").desc_nulls_last()))

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(resources: DataFrame) -> DataFrame:
    return resources.where("status <> 'deleted'")


def orphan_state(store: SnapshotStore) -> orphans.OrphanState:
    """The state after the last committed batch."""
    return orphans.OrphanState(store.read("orphan_index"), store.read("orphan_ledger"), store.read("orphan_refs"))


def stream_orphans(source: DataFrame, store: SnapshotStore, checkpoint: str, name: str = "orphans") -> StreamingQuery:
    """References, parents and deletions against the state in the store.

    ``source`` has columns kind ('reference', 'parent' or 'deleted'), ref_id, side, ref and at. State and batch number
    are committed together under the stream's ``name``, so a batch that is replayed after a failure is passed over.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batches = store.read("batches")
        last = batches.where(F.col("stream") == name).agg(F.max("batch_id")).first()[0]
        if last is not None and number <= last:
            return
        kind = lambda k: batch.where(F.col("kind") == k)
        after = orphans.advance(
            orphan_state(store),
            kind("reference").where("ref is not null").select("ref_id", "side", "ref", "at"),
            orphans.parents(kind("parent"), "ref", "at"),
            kind("deleted").select("ref"),
        )
        done = batches.where(F.col("stream") != name).unionByName(
            batch.sparkSession.createDataFrame([(name, number)], "stream string, batch_id long")
        )
        store.commit(orphan_index=after.index, orphan_ledger=after.ledger, orphan_refs=after.refs, batches=done)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
