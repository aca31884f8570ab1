"""Problems 2 to 5 on small tables: nulls, ties, repeats, empty input, hot keys."""

import datetime as dt
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from knotwork.operators import current, orphans, shred, treeagg

T = dt.datetime
EDGES = "source string, target string, label string, created_at timestamp, embed_id long, node_id string, side string"


def edge_rows(n, seed=1):
    rng = random.Random(seed)
    ids = ["hot"] * 30 + [f"n{i}" for i in range(60)] + [None, ""]
    at = lambda: rng.choice([None, T(2020, rng.randint(1, 12), 3)])
    return [(rng.choice(ids), rng.choice(ids), rng.choice(["a", None]), at(), i, "x", "y") for i in range(n)]


@pytest.mark.parametrize("fan_in", [2, 3, 100])
def test_tree_aggregate(spark, fan_in):
    rows = edge_rows(700)
    df = spark.createDataFrame(rows, EDGES).repartition(11)
    got = treeagg.tree_aggregate(
        df, ["source"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("embed_id")), "lo": ("min", F.col("embed_id")), "hi": ("max", F.col("embed_id"))}, fan_in, 11
    )
    want = {}
    for s, *_, e, _, _ in rows:
        want.setdefault(s, []).append(e)
    assert {r.source: (r.n, r.s, r.lo, r.hi) for r in got.collect()} == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}


def test_tree_aggregate_rejects_fan_in(spark):
    with pytest.raises(ValueError):
        treeagg.tree_aggregate(spark.range(3), ["id"], {}, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tree_does_not_hang_on_files(spark, tmp_path):
    """One file of 700 rows is many chunks: 64, 22, 8 and 3 states of a key meet in turn."""
    spark.createDataFrame(edge_rows(700), EDGES).coalesce(1).write.parquet(f"{tmp_path}/edges")
    df = spark.read.parquet(f"{tmp_path}/edges")
    chunks = treeagg.chunked(df, 11)
    assert (chunks.n_chunks, chunks.n_rows) == (64, 700)
    assert max(r["count"] for r in chunks.rows.groupBy("__kw_chunk").count().collect()) == 11
    assert plan_of(treeagg.tree_aggregate(df, ["source"], {"n": ("count", F.lit(1))}, 3, 11)).count("Exchange") == 5


def test_p2_found_builds_the_tree(spark):
    from knotwork.plans import data_queries

    small = "/root/testdata/sf0.01"
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    plan = plan_of(data_queries.p2_found(spark, small))
    assert "__kw_chunk" in plan and plan.count("Exchange") >= 2


def test_heavy_ids_counts_all_rows(spark):
    rows = edge_rows(600) + [(None, None, None, None, 1, "x", "y")] * 30
    df = spark.createDataFrame(rows + rows[:5], EDGES)
    got = {(r.side, r.node_id) for r in treeagg.heavy_ids(df).collect()}
    want = set()
    for i, side in enumerate(("source", "target")):
        counts = Counter(r[i] for r in rows + rows[:5])
        want |= {(side, k) for k, n in counts.items() if k is not None and n * 50 >= len(rows) + 5}
    assert got == want
    assert treeagg.heavy_ids(spark.createDataFrame([], EDGES)).count() == 0


def test_profile_keeps_every_id(spark):
    df = spark.createDataFrame(edge_rows(300), EDGES)
    got = treeagg.edge_profile(df).groupBy("side").agg(F.sum("n_edges").alias("n")).collect()
    assert {r.side: r.n for r in got} == {"source": df.where("source is not null").count(), "target": df.where("target is not null").count()}


NODES = "id string, created_at timestamp, n long, ref string"


def brute_orphans(nodes, edges):
    out = set()
    for s, t, _, at, e, *_ in edges:
        for side, ref in (("source", s), ("target", t)):
            if ref is not None and not any(i == ref and (c is None or at is None or c <= at) for i, c, *_ in nodes):
                out.add((e, side))
    return out


def test_orphans_against_brute_force(spark):
    rng = random.Random(4)
    edges = edge_rows(500, 7)
    nodes = [(rng.choice([f"n{i}" for i in range(50)] + ["hot", None]), rng.choice([None] + [T(2020, m, 3) for m in range(1, 13)]), 1, "r") for _ in range(70)]
    ledger = orphans.orphan_ledger(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges + edges[:50], EDGES))
    assert {(r.ref_id, r.side) for r in ledger.collect()} == brute_orphans(nodes, edges)
    assert sum(r.orphans for r in orphans.snapshot(ledger).collect()) == ledger.count()


def test_orphans_all_hot_missing(spark):
    edges = [("gone", "gone", "l", T(2020, 1, 1), i, "", "") for i in range(50)]
    ledger = orphans.orphan_ledger(spark.createDataFrame([], NODES), spark.createDataFrame(edges, EDGES))
    assert ledger.count() == 100
    assert orphans.orphan_ledger(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


def test_orphan_state_over_batches(spark):
    """References wait, an arriving parent resolves them, its deletion reopens them and those that had it before."""
    refs = lambda rows: orphans.references(spark.createDataFrame(rows, "embed_id long, source string, target string, created_at timestamp"))
    nodes = lambda rows: orphans.parents(spark.createDataFrame(rows, "id string, created_at timestamp"))
    first = refs([(1, "a", "b", T(2020, 1, 1))])
    s = orphans.advance(orphans.empty_state(spark), first, nodes([("a", T(2019, 1, 1))]))
    assert [(r.ref, r.status) for r in s.ledger.collect()] == [("b", "waiting")]
    s = orphans.advance(s, new_parents=nodes([("b", T(2020, 2, 1))]))
    assert [(r.ref, r.status, r.resolved_at) for r in s.ledger.collect()] == [("b", "resolved", T(2020, 2, 1))]
    s = orphans.advance(s, deleted=spark.createDataFrame([("a",), ("b",)], "ref string"), all_refs=first)
    assert {(r.ref, r.status) for r in s.ledger.collect()} == {("a", "waiting"), ("b", "waiting")}
    s = orphans.advance(s, refs([(2, "a", "c", None)]), nodes([("c", T(2030, 1, 1))]))
    assert {(r.ref_id, r.ref, r.status) for r in s.ledger.collect()} == {(1, "a", "waiting"), (1, "b", "waiting"), (2, "a", "waiting")}


def test_repeated_batches_change_nothing(spark):
    refs = orphans.references(spark.createDataFrame([(1, "a", "b", T(2020, 1, 1)), (1, "a", "b", T(2020, 1, 1))], "embed_id long, source string, target string, created_at timestamp"))
    once = orphans.advance(orphans.empty_state(spark), refs)
    twice = orphans.advance(once, refs)
    assert once.ledger.count() == twice.ledger.count() == 2 and twice.refs.count() == 2
    nodes = orphans.parents(spark.createDataFrame([("a", None), ("b", T(2020, 3, 1))], "id string, created_at timestamp"))
    late = orphans.advance(orphans.advance(twice, new_parents=nodes), refs, nodes)
    assert {(r.ref, r.status, r.resolved_at) for r in late.ledger.collect()} == {("a", "resolved", None), ("b", "resolved", T(2020, 3, 1))}
    earlier = orphans.advance(late, new_parents=orphans.parents(spark.createDataFrame([("b", T(2019, 3, 1))], "id string, created_at timestamp")))
    assert orphans.still_orphans(late.ledger).count() == 1 and orphans.still_orphans(earlier.ledger).count() == 0


def test_batches_find_what_one_batch_finds(spark):
    """Parents in three parts, references in two, one of them sent twice, with ids hot and not."""
    rng = random.Random(14)
    edges = edge_rows(400, 15)
    nodes = [(rng.choice([f"n{i}" for i in range(50)] + ["hot"]), rng.choice([None] + [T(2020, m, 3) for m in range(1, 13)])) for _ in range(60)]
    refs = lambda rows: orphans.references(spark.createDataFrame(rows, EDGES))
    own = lambda rows: orphans.parents(spark.createDataFrame(rows, "id string, created_at timestamp"))
    s = orphans.advance(orphans.empty_state(spark), refs(edges[:250]), own(nodes[:20]))
    s = orphans.advance(s, refs(edges[200:]), own(nodes[20:40]))
    s = orphans.advance(s, refs(edges[:100]), own(nodes[40:]))
    assert {(r.ref_id, r.side) for r in orphans.still_orphans(s.ledger).collect()} == brute_orphans([(*n, 1, "") for n in nodes], edges)
    assert s.ledger.count() == s.ledger.select("ref_id", "side", "ref", "at").distinct().count()


def test_orphan_stream_survives_a_replay(spark, tmp_path):
    from knotwork.sources.store import SnapshotStore
    from knotwork.streaming import ingest

    schema = "kind string, ref_id long, side string, ref string, at timestamp"
    feed, store = str(tmp_path / "feed"), SnapshotStore(spark, str(tmp_path / "s"))

    def batch(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        ingest.stream_orphans(spark.readStream.schema(schema).parquet(feed), store, str(tmp_path / checkpoint)).awaitTermination()

    batch([("reference", 1, "source", "a", T(2020, 1, 1)), ("reference", 1, "target", "b", T(2020, 1, 1)), ("parent", None, None, "a", T(2019, 1, 1))], "c")
    rows = lambda: {(r.ref, r.status) for r in ingest.orphan_state(store).ledger.collect()}
    assert rows() == {("b", "waiting")}
    batch([("parent", None, None, "b", T(2020, 2, 1)), ("deleted", None, None, "a", None)], "c")
    assert rows() == {("b", "resolved"), ("a", "waiting")}
    batch([], "lost")  # the source's own checkpoint is gone and batch 0 is everything again
    assert rows() == {("b", "resolved"), ("a", "waiting")} and ingest.orphan_state(store).ledger.count() == 2


RECORDS = "id string, resource string, tbl string, path string"


def brute_objects(rows):
    out = set()

    def walk(value, path, parent, key):
        if isinstance(value, dict):
            out.add((key, parent, path))
            for k, v in value.items():
                walk(v, f"{path}.{k}", path, key)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", parent, key)

    for key, text, *_ in rows:
        try:
            top = json.loads(text)
            top = json.loads(top) if isinstance(top, str) else top
        except (TypeError, ValueError):
            continue
        if isinstance(top, dict):
            for k, v in top.items():
                walk(v, k, "", key)
    return out


DOCS = [
    {"a": {"b": {"c": 1}, "e": {}}, "l": [{"x": 1}, None, {"x": [{"y": {}}]}], "s": "t"},
    {"person": {"name": "n", "friend": {"name": "m", "friend": {"name": "o"}}}},
    {"p": {"period": {"start": 1}}, "q": {"period": {"end": 2}}},
    {"l": {"x": 5}},
    {"m": [[{"z": 1}, [{"z": 2}]], []], "empty": []},
    {},
]


def test_objects_against_walk(spark):
    rows = [(str(i), json.dumps(d), "t", "p") for i, d in enumerate(DOCS)]
    rows += [("w", json.dumps(json.dumps(DOCS[0])), "t", "p"), ("n", None, "", ""), ("c", '{"a": {"b"', "", ""), ("l", "[{}]", "", ""), ("ww", json.dumps(json.dumps(json.dumps({"a": {}}))), "", "")]
    rows += rows[:2]
    df = spark.createDataFrame(rows, RECORDS)
    got = [(r.record_key, r.parent_path, r.path) for r in shred.objects(shred.shred(df, "t", "id", "resource")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_objects(rows)
    none = shred.Layout("t", None)
    assert {(r.record_key, r.parent_path, r.path) for r in shred.objects(shred.shred(df, "t", "id", "resource", layout=none)).collect()} == set(got)


def test_layout_and_links(spark):
    """Singletons are inlined; repeated, shared and recursive elements are tables whose rows find their parents."""
    df = spark.createDataFrame([(str(i), json.dumps(d), "", "") for i, d in enumerate(DOCS)], RECORDS)
    layout = shred.analyse(df, "resource", "t")
    assert {"l", "x", "period", "friend", "m"} <= layout.tables and not {"a", "b", "person", "e"} & layout.tables
    rows = shred.shred(df, "t", "id", "resource", layout=layout)
    keys = {(r.record_key, r.element, r.path) for r in rows.collect()}
    for r in rows.where("parent_row is not null").collect():
        assert (r.record_key, r.parent_element, r.parent_row) in keys
    assert shred.table_columns(rows, "t") == ["a.b.c", "empty", "person.name", "s"]
    top = {r.record_key: r["a.b.c"] for r in shred.flat_table(rows, "t", ["a.b.c"]).collect()}
    assert top["0"] == "1" and top["1"] is None
    assert shred.shred(df.where("false"), "t", "id", "resource").count() == 0


FEED = "id string, txid long, ts timestamp, status string, resource string, _rank int, _deleted int"


def test_current_state(spark):
    rows = [
        ("a", 1, T(2020, 1, 1), "created", "{}", 1, 1), ("a", 3, None, "Deleted ", None, 1, 1), ("a", 2, None, "updated", "{}", 1, 1),
        ("b", 5, None, "created", "{}", 1, 1), ("b", 5, T(2020, 1, 1), "deleted", None, 1, 1),
        ("c", 7, T(2020, 1, 2), "updated", '{"x":1}', 1, 1), ("c", 7, T(2020, 1, 1), "deleted", None, 1, 1), ("c", 9, None, "updated", "{", 1, 1),
        ("d", 1, None, "deleted", "{}", 1, 1), ("d", 2, None, " RECREATED", "{}", 1, 1), ("d", 2, None, " RECREATED", "{}", 1, 1),
        ("e", 1, None, None, "{}", 1, 1), (None, 1, None, "created", "{}", 1, 1), ("f", None, None, "created", "{}", 1, 1), ("g", 1, None, "created", "[]", 1, 1),
    ]
    got = current.apply_changes(None, spark.createDataFrame(rows, FEED))
    assert got.columns == ["id", "txid", "ts", "status", "resource", "_rank", "_deleted"]
    assert {(r.id, r.txid) for r in got.collect()} == {("c", 7), ("d", 2)}
    assert current.apply_changes(None, spark.createDataFrame([], FEED)).count() == 0


def test_current_state_over_base(spark):
    base = spark.createDataFrame([("a", 4, "old"), ("b", 1, "old"), ("z", None, "old"), ("k", 2, "old")], "id string, txid long, resource string")
    rows = [("a", 3, None, "deleted", None, 0, 0), ("b", 2, None, "deleted", None, 0, 0), ("z", 1, None, "updated", "{}", 0, 0), ("n", 1, None, "created", "{}", 0, 0)]
    got = current.apply_changes(base, spark.createDataFrame(rows, FEED))
    assert {(r.id, r.txid, r.resource) for r in got.collect()} == {("a", 4, "old"), ("z", 1, "{}"), ("k", 2, "old"), ("n", 1, "{}")}


def test_batches_equal_one_feed(spark):
    """Applying a feed in parts, in order, gives what applying it whole gives."""
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), t, None, rng.choice(["created", "updated", "deleted"]), json.dumps({"t": t}), 0, 0) for t in range(120)]
    whole = {(r.id, r.txid) for r in current.apply_changes(None, spark.createDataFrame(rows, FEED)).collect()}
    state = None
    for i in range(0, 120, 40):
        part = rows[i : i + 40]
        rng.shuffle(part)
        state = current.apply_changes(state, spark.createDataFrame(part, FEED))
    assert {(r.id, r.txid) for r in state.collect()} == whole


def test_mixed_lists_and_dotted_names_lose_nothing(spark):
    text = '{"m": [{"x": 1}, 7, [8, {"x": 2}], "t", null], "a": {"b": 1}, "a.b": 2, "m[1]": 3}'
    rows = shred.shred(spark.createDataFrame([(1, text)], "id long, resource string"), "t", "id", "resource").collect()
    top = next(r for r in rows if r.element == "t")
    assert top.columns == {"m[1]": "7", "m[2][0]": "8", "m[3]": '"t"', "a.b": "1", "a\\.b": "2", "m\\[1]": "3"}
    assert sorted(r.columns["x"] for r in rows if r.element == "m") == ["1", "2"]


def test_layout_by_join_is_the_layout_by_broadcast(spark):
    """Where the names of table elements are too many to send, each record gets its own by a join."""
    rows = [(str(i), json.dumps(d), "", "") for i, d in enumerate(DOCS * 3)] + [("n", None, "", ""), ("c", "{", "", "")]
    df = spark.createDataFrame(rows, RECORDS)
    joined = shred.analyse(df, "resource", "t", most=0)
    assert joined.names is not None
    shape = lambda layout: sorted(
        (r.record_key, r.element, r.path, str(r.parent_row), sorted(r.columns.items()), sorted((x.path, x.parent_path) for x in r.inlined))
        for r in shred.shred(df, "t", "id", "resource", layout=layout).collect()
    )
    assert shape(joined) == shape(shred.analyse(df, "resource", "t"))
