"""Problem 1: checkpoint-delta history against a plain replay."""

import datetime as dt
import json
import random

import pytest

from knotwork.operators import history
from knotwork.operators.history import _resolve

SCHEMA = "id string, txid long, ts timestamp, status string, resource string, key string, part int, extra string"


def replay(rows):
    """Versions by id: (id, from, to) -> content, one row after another."""
    best = {}
    for i, t, ts, status, body, *_ in rows:
        status = (status or "").strip().lower()
        if i is None or t is None or status not in ("created", "updated", "recreated", "deleted"):
            continue
        value = None
        if status != "deleted":
            try:
                value = json.loads(body)
            except (TypeError, ValueError):
                continue
            if not isinstance(value, dict):
                continue
            value = {k: v for k, v in value.items() if k != "meta"}
        rank = (ts is not None, ts or dt.datetime.min, (body or "") if status != "deleted" else "")
        if (i, t) not in best or rank > best[i, t][0]:
            best[i, t] = (rank, value)
    out, by = {}, {}
    for (i, t), (_, value) in best.items():
        by.setdefault(i, []).append((t, value))
    for i, line in by.items():
        start, held = None, None
        for t, value in sorted(line, key=lambda x: x[0]):
            if value == held and start is not None:
                continue
            if start is not None:
                out[i, start, t] = held
            start, held = (None, None) if value is None else (t, value)
        if start is not None:
            out[i, start, -1] = held
    return out


def run(spark, rows, **options):
    feed = spark.createDataFrame(rows, SCHEMA)
    found = history.versions(history.build_history(feed, **options)).collect()
    got = {(r.key, r.seq_from, r.seq_to): {k: json.loads(v) for k, v in r.attributes.items()} for r in found}
    assert len(got) == len(found)
    return got


def random_feed(seed, n, ids, states):
    rng, rows = random.Random(seed), []
    for t in range(n):
        i = rng.choice(ids)
        status = rng.choice(["created", " Updated", "UPDATED ", "recreated", "deleted", "unknown", None])
        body = {"a": rng.randrange(states), "b": {"y": 1, "x": [rng.randrange(2), None]}, "meta": {"v": t}}
        if rng.random() < 0.3:
            body.pop("b")
        text = json.dumps(body, indent=rng.choice([None, 1]), sort_keys=rng.random() < 0.5)
        text = rng.choice([text] * 8 + [None, text[:-3], "[1]", '"x"'])
        ts = rng.choice([None, dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(1000))])
        rows.append((i, rng.randrange(n), ts, status, text, "k", 1, "e"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replay(spark, seed):
    """One hot id, many changes, small segments: the hot id spans all partitions and many segments."""
    rows = random_feed(seed, 900, ["hot"] * 8 + ["a", "b", "c", None], 3)
    rows += rows[::7]
    rows.append(("a", None, None, "created", "{}", "k", 1, "e"))
    assert run(spark, rows, every=4) == replay(rows)


def test_unchanged_over_partitions(spark):
    """A version that runs through whole partitions has one row, with its true end."""
    rows = [("x", t, None, "updated", '{"a": 1}', "", 0, "") for t in range(400)] + [("x", 400, None, "updated", '{"a": 2.0}', "", 0, "")]
    assert run(spark, rows) == {("x", 0, 400): {"a": 1}, ("x", 400, -1): {"a": 2}}


def test_empty_feed_and_all_unusable(spark):
    assert run(spark, []) == {}
    assert run(spark, [("x", 1, None, "created", "{", "", 0, ""), ("x", 2, None, "entered-in-error", "{}", "", 0, "")]) == {}


def test_number_spelling_and_long_text(spark):
    long = json.dumps({"t": "ä" * 200_000})
    rows = [
        ("x", 1, None, "created", '{"n": 1, "m": 2}', "", 0, ""), ("x", 2, None, "updated", '{"m":2.0,"n":1e0}', "", 0, ""),
        ("x", 3, None, "updated", '{"m": true, "n": 1}', "", 0, ""), ("y", 1, None, "created", long, "", 0, ""),
    ]
    got = run(spark, rows)
    assert set(got) == {("x", 1, 3), ("x", 3, -1), ("y", 1, -1)}
    assert got["y", 1, -1] == json.loads(long)


def test_borders():
    """Neighbouring partitions: same content goes on, a change ends it, another key ends nothing."""
    from types import SimpleNamespace as R

    def part(n, key, first, second, last_key, a, b):
        return [
            R(part=n, is_first=True, is_last=False, key=key, first_seq=first, second_seq=second, first_digest=a, last_digest=None),
            R(part=n, is_first=False, is_last=True, key=last_key, first_seq=None, second_seq=None, first_digest=None, last_digest=b),
        ]

    rows = part(0, "a", 1, 2, "b", b"1", b"2") + part(1, "b", 5, 9, "b", b"2", b"3") + part(2, "c", 1, None, "c", b"3", b"3")
    assert sorted(_resolve(rows)) == [(0, False, 9), (1, True, -1), (2, False, -1)]


def test_a_change_sent_again_and_again(spark):
    """Repeats are dropped batch by batch before the sort; nothing else is."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": ["a", "a", None, "a", None, "b"], "body": ["x", "x", "y", None, "y", "x"]})
    left = [r for b in history._distinct(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(map(str, left)) == sorted(map(str, [{"key": "a", "body": "x"}, {"key": None, "body": "y"}, {"key": "a", "body": None}, {"key": "b", "body": "x"}]))
    rows = [("hot", 5, None, "updated", '{"v":1}')] * 5000 + [("hot", 5, None, "updated", '{"v":2}')] * 3000 + [("hot", 7, None, "deleted", None)] * 2000
    feed = spark.createDataFrame(rows, "id string, txid long, ts timestamp, status string, resource string")
    got = history.versions(history.build_history(feed)).collect()
    assert [(r.key, r.seq_from, r.seq_to, r.attributes) for r in got] == [("hot", 5, 7, {"v": "2"})]
