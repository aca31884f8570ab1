"""Problem 6 against brute force."""

from dataclasses import replace

import numpy as np
import pytest

from knotwork.llm import neighbours
from knotwork.llm.neighbours import Search

SCHEMA = "embed_id long, v array<float>, cell int, id string"


def brute(rows, k, least):
    own = {}
    for e, v, *_ in rows:
        if e is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[e] = v
    ids = np.array(sorted(own))
    if not len(ids):
        return {}
    x = np.array([own[i] for i in ids], dtype=np.float32).astype(float)
    n = np.sqrt((x**2).sum(axis=1))
    cos = np.round((x @ x.T) / (n[:, None] * n[None, :]), 9)
    out = {}
    for i in range(len(ids)):
        near = [(-cos[i, j], ids[j]) for j in range(len(ids)) if j != i and cos[i, j] >= least]
        out[int(ids[i])] = [(int(e), -c) for c, e in sorted(near)[:k]]
    return out


def run(spark, rows, search):
    found = neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), "embed_id", "v", search)
    got = {}
    for r in found.collect():
        got.setdefault(r.owner, []).append((-r.cos, r.other))
    return {o: [(e, -c) for c, e in sorted(v)] for o, v in got.items()}, found


def cloud(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), 8))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 8))
    return [(i, [float(v) for v in x[i] * rng.uniform(0.5, 2)], 1, "x") for i in range(n)]


SMALL = Search(k=5, min_cos=0.8, dims=8, list_rows=16, cell_rows=40, epsilon=6.0)


def test_exact_where_all_lists_are_probed(spark):
    rows = cloud(400)
    got, found = run(spark, rows + rows[:30], replace(SMALL, probes=64))
    want = {o: v for o, v in brute(rows, 5, 0.8).items() if v}
    assert got == want
    assert found.groupBy("owner").count().where("count > 5").count() == 0


def test_recall_with_few_probes(spark):
    rows = cloud(1500, 3)
    got, _ = run(spark, rows, replace(SMALL, probes=6, epsilon=2.1))
    want = {(o, e) for o, v in brute(rows, 5, 0.8).items() for e, _ in v}
    have = {(o, e) for o, v in got.items() for e, _ in v}
    assert len(want & have) >= 0.9 * len(want)


def test_dirty_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0] * 8, 0, ""), (2, [2.0] * 8, 0, ""), (3, [nan] + [1.0] * 7, 0, ""), (4, None, 0, ""), (5, [], 0, ""), (6, [1.0] * 7, 0, ""),
        (7, [0.0] * 8, 0, ""), (8, [inf] + [0.0] * 7, 0, ""), (9, [None] + [1.0] * 7, 0, ""), (None, [1.0] * 8, 0, ""), (1, [1.0] * 8, 0, ""),
        (10, [1e-30] * 8, 0, ""), (11, [1e30] * 8, 0, ""),
    ]
    got, _ = run(spark, rows, SMALL)
    assert set(got) == {1, 2, 10, 11}
    assert [e for e, _ in got[1]] == [2, 10, 11]


@pytest.mark.parametrize("copies", [3, 7, 40])
def test_equal_vectors(spark, copies):
    """A third and more of the rows equal: everyone gets the smallest ids, as brute force says."""
    rows = cloud(60, 5) + [(1000 - i, [1.0, 2.0] + [0.0] * 6, 0, "") for i in range(copies)]
    rows.append((2000, [1.0, 2.01] + [0.0] * 6, 0, ""))
    got, _ = run(spark, rows, replace(SMALL, probes=64))
    assert got == {o: v for o, v in brute(rows, 5, 0.8).items() if v}


def test_empty_and_single(spark):
    assert run(spark, [], SMALL)[0] == {}
    assert run(spark, [(1, [1.0] * 8, 0, "")], SMALL)[0] == {}


def test_salted_list(spark):
    """A list larger than a cell is spread over several and still searched whole."""
    rows = cloud(300, 9)
    got, _ = run(spark, rows, replace(SMALL, probes=64, list_rows=400, cell_rows=50))
    assert got == {o: v for o, v in brute(rows, 5, 0.8).items() if v}


@pytest.mark.parametrize("kind", ["unstructured", "clustered"])
def test_recall_of_default_parameters(spark, kind):
    """The k nearest however far they are, with the number of probes that the calibration finds."""
    rng = np.random.default_rng(11)
    n = 3000
    x = rng.standard_normal((n, 64))
    if kind == "clustered":  # the tenth neighbour's cosine is about 0.7
        x = rng.standard_normal((n // 40, 64))[rng.integers(0, n // 40, n)] + 0.6 * x
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1, "x") for i in range(n)]
    found = neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), "embed_id", "v").toArrow()
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    want = np.argsort(-cos, axis=1)[:, :10]
    have = set(zip(found["owner"].to_pylist(), found["other"].to_pylist()))
    assert len(found) == 10 * n
    assert sum((i, int(j)) in have for i in range(n) for j in want[i]) >= 0.95 * 10 * n


def test_pairs_are_abandoned_by_the_kth_best():
    """Of a query's pairs only those survive the blocks that can be nearer than what it has."""
    rng = np.random.default_rng(2)
    y = rng.standard_normal((400, 64)).astype(np.float32)
    y /= np.linalg.norm(y, axis=1)[:, None]
    q = y[:50] + 0.05 * rng.standard_normal((50, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1)[:, None]
    dist = ((q[:, None, :] - y[None]) ** 2).sum(axis=2)
    kth = np.sort(dist, axis=1)[:, 4]
    none = np.full(50, -1)
    i, j = neighbours._survivors(q, y, none, kth, 5, [(0, 16), (16, 32), (32, 64)], 2.1)
    kept = set(zip(i.tolist(), j.tolist()))
    want = [(a, b) for a in range(50) for b in np.argsort(dist[a])[:5]]
    assert sum(p in kept for p in want) >= 0.97 * len(want) and len(kept) < 2 * len(want)
    i, j = neighbours._survivors(q, y, none, np.full(50, np.inf), 5, [(0, 16), (16, 32), (32, 64)], 2.1)
    kept = set(zip(i.tolist(), j.tolist()))
    assert sum(p in kept for p in want) >= 0.97 * len(want) and len(kept) < 0.5 * 50 * 400


def test_equal_hashes_are_no_equal_vectors(spark, monkeypatch):
    rows = [(i, [1.0, float(i)] + [0.0] * 6, 0, "") for i in range(20)]
    vectors = neighbours.valid_vectors(spark.createDataFrame(rows, SCHEMA), "embed_id", "v", 8)
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert neighbours._crowds(vectors, 5).count() == 0
