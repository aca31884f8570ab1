"""History of changing attributes, kept as checkpoints and deltas.

Storage. Rows are range-partitioned and sorted by (key, sequence), so one key with a third of all rows is spread
over as many partitions as it fills. Each partition is scanned once, as a stream. A store row is one *segment*: up
to ``every`` change points of one key, the first with all attributes (the checkpoint), the rest with only those
attributes that were set or removed (the deltas). A segment needs no other row to be read.

Borders. Whether a partition's first row changes anything, and when a partition's last version ends, depends on
its neighbours. Each partition says so in at most two short rows; these, bounded by twice the number of
partitions, are resolved in one pass on the driver and joined back.

Reading. Validity rows come from folding each segment's deltas onto its checkpoint, inside the JVM and without a
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.functions.strictjson import decode, encode, printable
from knotwork.operators.changefeed import known_status
from knotwork.session import range_partitions, spool

STORE = (
    "part int, seg long, key string, entries array<struct<seq: long, ts: timestamp, deleted: boolean, "
    "changed: map<string,string>, removed: array<string>>>, seg_end long, is_first boolean, is_last boolean, "
    "first_digest binary, last_digest binary"
)
#: Rows of the store that leave a scan together.
FLUSH = 512


def _digest(state: dict[str, str] | None) -> bytes:
    """b'' stands for "deleted"."""
    if state is None:
        return b""
    return hashlib.blake2b(encode(state).encode(), digest_size=16).digest()


def _scanner(every: int, ignore: tuple[str, ...]):
    schema = arrow_schema(STORE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        seg = 0
        key, at = None, None  # the key being read, the sequence already decided for it
        state: dict[str, str] | None = None  # attributes after the last row; None: deleted
        entries: list[dict] = []
        first, first_digest = True, None

        def close(end: int | None, last: bool) -> None:
            nonlocal seg, entries, first
            out.append(
                {
                    "part": part, "seg": seg, "key": key, "entries": entries, "seg_end": end, "is_first": first,
                    "is_last": last, "first_digest": first_digest if first else None,
                    "last_digest": _digest(state) if last else None,
                }
            )
            seg, entries, first = seg + 1, [], False

        for batch in batches:
            for k, seq, ts, deleted, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k == key and seq == at:
                    continue
                if deleted:
                    new = None
                else:
                    value = decode(body)
                    if not isinstance(value, dict):
                        continue
                    new = {a: encode(v) for a, v in value.items() if a not in ignore}
                if k != key:
                    if entries:
                        close(-1, False)
                    key, state, fresh = k, None, True
                else:
                    fresh = False
                at = seq
                if not fresh and new == state:
                    continue
                if len(entries) == every:
                    close(seq, False)
                whole = not entries or state is None
                changed = removed = None
                if new is not None:
                    changed = new if whole else {a: v for a, v in new.items() if state.get(a) != v}
                    removed = [] if whole else [printable(a) for a in state if a not in new]
                    changed = [(printable(a), v) for a, v in changed.items()]
                    changed = list(dict(changed).items())
                if first and not entries:
                    first_digest = _digest(new)
                entries.append({"seq": seq, "ts": ts, "deleted": new is None, "changed": changed, "removed": removed})
                state = new
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if entries:
            close(None, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch without rows given twice: a change that is sent again and again leaves few rows to be sorted."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from table.group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()


def _resolve(borders: list) -> list[tuple[int, bool, int]]:
    """(part, continues, end of its last segment), from at most two rows per partition."""
    parts: dict[int, dict] = {}
    for r in borders:
        p = parts.setdefault(r.part, {})
        if r.is_first:
            p |= {"first_key": r.key, "first_seq": r.first_seq, "first_digest": r.first_digest, "second": r.second_seq}
        if r.is_last:
            p |= {"last_key": r.key, "last_digest": r.last_digest}
    found = []
    order = sorted(parts)
    for i, n in enumerate(order):
        p, before = parts[n], parts[order[i - 1]] if i else None
        p["continues"] = before is not None and before["last_key"] == p["first_key"] and before["last_digest"] == p["first_digest"]
    later_key, later_end = None, -1  # the first change point of later_key in the partitions after this one
    for n in reversed(order):
        p = parts[n]
        found.append((n, p["continues"], later_end if later_key == p["last_key"] else -1))
        if not p["continues"]:
            later_key, later_end = p["first_key"], p["first_seq"]
        elif p["second"] is not None:
            later_key, later_end = p["first_key"], p["second"]
        elif later_key != p["first_key"]:  # nothing of this key changes here or later
            later_key, later_end = p["first_key"], -1
    return found


def build_history(
    feed: DataFrame,
    key: str = "id",
    seq: str = "txid",
    ts: str = "ts",
    status: str = "status",
    body: str = "resource",
    ignore: tuple[str, ...] = ("meta",),
    every: int = 16,
) -> DataFrame:
    """The checkpoint-delta store of a change feed: segments of up to ``every`` change points.

    Usable rows are those of `changefeed`; of rows with equal (key, sequence) the one with the latest time counts
    (null is earliest, then the greatest body). Content is the JSON value of the body without the top-level fields
    in ``ignore``; attributes are its top-level fields. Rows that repeat the content before them leave no trace.
    Rows with a null key or sequence, unknown status or a body that is no JSON object are passed over; an empty
    feed gives an empty store. Other columns of the feed are not read.
    """
    spark = feed.sparkSession
    rows = known_status(feed.select(key, seq, ts, status, body), key, seq, status).select(
        F.col(key).cast("string").alias("key"),
        F.col(seq).cast("long").alias("seq"),
        F.col(ts).alias("ts"),
        F.col("__kw_deleted").alias("deleted"),
        F.when(~F.col("__kw_deleted"), F.col(body)).alias("body"),
    )
    once = rows.mapInArrow(_distinct, rows.schema)
    ordered = once.repartitionByRange(range_partitions(rows), "key", "seq").sortWithinPartitions(
        "key", "seq", F.col("ts").desc_nulls_last(), F.col("body").desc_nulls_last()
    )
    segments = spool(ordered.mapInArrow(_scanner(every, ignore), STORE))
    borders = (
        segments.where("is_first or is_last")
        .select(
            "part", "key", "is_first", "is_last", "first_digest", "last_digest",
            F.col("entries")[0]["seq"].alias("first_seq"),
            F.coalesce(F.try_element_at(F.col("entries.seq"), F.lit(2)), F.col("seg_end")).alias("second_seq"),
        )
        .collect()
    )
    fixed = spark.createDataFrame(_resolve(borders), "part int, continues boolean, end long")
    return segments.join(F.broadcast(fixed), "part").select(
        "part",
        "seg",
        "key",
        "entries",
        F.coalesce("seg_end", "end").alias("seg_end"),
        (F.col("is_first") & F.col("continues")).alias("continues"),
    )


def versions(store: DataFrame) -> DataFrame:
    """Validity rows: key, seq_from, seq_to (-1: still valid), ts_from, attributes (field -> canonical JSON).

    Folds every segment's deltas forward from its checkpoint. One row per period of unchanged content.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    start = F.expr(
        "cast(array() as array<struct<seq: bigint, ts: timestamp, deleted: boolean, state: map<string,string>>>)"
    )

    def fold(done, entry):
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["state"]).otherwise(empty)
        kept = F.map_filter(
            before,
            lambda name, _: ~F.array_contains(entry["removed"], name) & ~F.map_contains_key(entry["changed"], name),
        )
        state = F.when(entry["deleted"], empty).otherwise(F.map_concat(kept, entry["changed"]))
        return F.concat(
            done,
            F.array(
                F.struct(
                    entry["seq"].alias("seq"), entry["ts"].alias("ts"), entry["deleted"].alias("deleted"), state.alias("state")
                )
            ),
        )

    folded = store.select("key", "seg_end", "continues", F.aggregate("entries", start, fold).alias("steps"))
    rows = folded.select(
        "key",
        "seg_end",
        "continues",
        F.posexplode("steps").alias("pos", "step"),
        F.col("steps.seq").alias("seqs"),
    )
    return rows.where(~F.col("step.deleted") & ~(F.col("continues") & (F.col("pos") == 0))).select(
        "key",
        F.col("step.seq").alias("seq_from"),
        F.coalesce(F.try_element_at("seqs", F.col("pos") + 2), F.col("seg_end")).alias("seq_to"),
        F.col("step.ts").alias("ts_from"),
        F.col("step.state").alias("attributes"),
    )
