"""The k most similar vectors of every vector: inverted lists scanned by adaptive dimensions.

Index. Vectors are brought to unit length. A first level of centroids is trained on a bounded sample on the driver; a
second level, the lists, is trained in the cluster, each first-level group on a bounded sample of its own. Lists next
to each other are packed into cells of bounded size, so that a vector looking into several lists travels to few
cells. Every vector is indexed in its nearest list and looks into its ``probes`` nearest lists. How many those are is
calibrated: the exact neighbours of a bounded set of queries among all rows say how far down the ranking of lists
neighbours live, whether the vectors are clustered or not.

Scan. A cell's own rows come first and once, both to be searched and to search. Vectors are rotated at random and cut
into blocks of dimensions. A query goes through its lists from the nearest on and keeps its k best so far. In a list
the squared distances of the first block come from one matrix product; a pair stays only while its distance so far
passes the hypothesis test "it could still end nearer than the k-th best". The few pairs left are computed in double
precision from the vectors as stored. Whatever pair one side finds also serves the other.

Groups of equal vectors. Of more than k + 1 equal vectors only the k + 1 with the smallest ids can be anyone's
neighbours; the others take over the neighbours of the first, exactly, and need not be searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.session import cut, spool

FOUND = "owner long, other long, cos double"
ROUTED = "cell int, query boolean, id long, lists array<int>, vec array<float>"
SAMPLE = "top int, vec array<float>"
LISTS = "top int, centroids binary, held binary"
TRUTH = "owner int, other long, cos double, list int, vec binary"
#: Pairs whose first block is computed in one matrix product.
TILE = 1 << 22
#: Partitions of the scan at most; beyond, a task takes several cells, one after the other.
MAX_TASKS = 1 << 16
#: Groups of equal vectors that are broadcast at most, 256 bytes each at 64 dimensions.
SMALL_GROUPS = 100_000


@dataclass(frozen=True)
class Search:
    """Parameters. ``min_cos`` None: the k nearest, however far. ``probes`` None: calibrated to the ``recall`` wanted.

    Every task holds the lists' centroids, ``max_lists`` at most (of 256 bytes at 64 dimensions); the driver trains
    on ``sample_per_list`` rows for each of the first level's centroids, the square root of the lists' number.
    """

    k: int = 10
    min_cos: float | None = None
    dims: int = 64
    probes: int | None = None
    recall: float = 0.99
    #: Further lists, by rank, that a vector looks into where a cell it travels to holds them: they cost no travel.
    beside: int = 8
    calibrate: int = 256
    list_rows: int = 128
    max_lists: int = 1 << 20
    #: Lists of one first-level group at most, whatever share of the rows it has.
    max_fan: int = 4096
    sample_per_list: int = 32
    cell_rows: int = 16384
    #: Error of the hypothesis test: a larger value abandons fewer pairs, and fewer wrongly.
    epsilon: float = 2.1
    seed: int = 7


@dataclass(frozen=True)
class Index:
    """Two levels of centroids, the lists of each first-level one, the cell of each list and over how many salted
    cells its rows are spread, the rotation, and into how many groups and lists a vector looks."""

    tops: np.ndarray
    fans: np.ndarray  # lists of top t are fans[t] .. fans[t + 1]
    centroids: np.ndarray
    cell: np.ndarray
    spread: np.ndarray
    n_cells: int
    rotation: np.ndarray
    probes: int
    groups: int


def valid_vectors(rows: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """id and vec of rows with a key and ``dims`` values, none null, NaN or infinite and not all zero."""
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return named.where(
        F.col("id").isNotNull() & (F.size("vec") == dims) & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda v: v != 0)
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1)[:, None]
    return (wide / np.sqrt((wide**2).sum(axis=1))[:, None]).astype(np.float32)


def _kmeans(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        held, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
        norms = np.sqrt((sums**2).sum(axis=1))
        fine = norms > 0
        c[held[fine]] = (sums[fine] / norms[fine][:, None]).astype(np.float32)
    return c


def _pack(c: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Lists halved along their widest direction until a cell holds at most ``most`` rows or one list."""
    done, todo = [], [np.arange(len(c))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or rows[own].sum() <= most:
            done.append(own)
            continue
        around = c[own] - c[own].mean(axis=0)
        along = around @ np.linalg.svd(around, full_matrices=False)[2][0]
        order = own[np.argsort(along, kind="stable")]
        half = int(np.searchsorted(np.cumsum(rows[order]), rows[order].sum() / 2))
        half = min(max(half, 1), len(order) - 1)
        todo += [order[:half], order[half:]]
    return done


def _nearest_lists(index: Index, x: np.ndarray, probes: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` nearest lists of each row (of unit length), nearest first, and the cosines; -1 fills up."""
    n, groups = len(x), min(groups, len(index.tops))
    scores = x @ index.tops.T
    chosen = np.argpartition(-scores, groups - 1, axis=1)[:, :groups]
    lists, best = np.full((n, probes), -1, np.int64), np.full((n, probes), -np.inf, np.float32)
    row, top = np.repeat(np.arange(n), groups), chosen.ravel()
    order = np.argsort(top, kind="stable")
    names, begins = np.unique(top[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(row[order], begins[1:])):
        a, b = int(index.fans[name]), int(index.fans[name + 1])
        if a == b:
            continue
        near = x[rows] @ index.centroids[a:b].T
        at = np.broadcast_to(np.arange(a, b), near.shape)
        if b - a > probes:
            keep = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            near, at = np.take_along_axis(near, keep, 1), np.take_along_axis(at, keep, 1)
        both, where = np.concatenate([best[rows], near], axis=1), np.concatenate([lists[rows], at], axis=1)
        keep = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
        best[rows], lists[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(where, keep, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(lists, order, 1), np.take_along_axis(best, order, 1)


def _thinned(vectors: DataFrame, share: float, seed: int) -> DataFrame:
    return vectors if share >= 1 else vectors.where(F.abs(F.xxhash64("id", F.lit(seed))) < F.lit(int(share * (2**63 - 1))))


def _sampler(tops: np.ndarray, shares: np.ndarray, most: float, search: Search):
    """Rows with their first-level group, thinned to the group's share."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(search.seed)
        for batch in batches:
            if len(batch) == 0:
                continue
            x = _unit(_matrix(batch.column(0), search.dims))
            top = (x @ tops.T).argmax(axis=1)
            kept = np.flatnonzero(rng.random(len(x)) * most < shares[top])
            vecs = pa.ListArray.from_arrays(np.arange(0, (len(kept) + 1) * search.dims, search.dims, dtype=np.int32), x[kept].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(top[kept].astype(np.int32)), vecs], names=["top", "vec"])

    return sample


def _list_trainer(wanted: np.ndarray, search: Search):
    """The lists of every group, with how many sampled rows each holds."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            top = np.asarray(batch.column(0))
            x = _matrix(batch.column(1), search.dims)
            for name in np.unique(top).tolist():
                gathered.setdefault(name, []).append(x[top == name])
        for name, pieces in gathered.items():
            x = np.concatenate(pieces)
            c = _kmeans(x, min(int(wanted[name]), len(x)), np.random.default_rng((search.seed, name)))
            held = np.bincount(np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)]), minlength=len(c))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int32()), pa.array([c.tobytes()], pa.binary()), pa.array([held.astype(np.int64).tobytes()], pa.binary())],
                names=["top", "centroids", "held"],
            )

    return fit


def _truth(shared, search: Search):
    """The nearest rows of every query within the partition, and the list each is in: brute force over all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q_ids, q = shared.value
        k = search.k
        cos, ids, lists = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64), np.full((len(q), k), -1, np.int64)
        vecs = np.zeros((len(q), k, search.dims), np.float32)
        for batch in batches:
            for piece in (batch.slice(s, 4096) for s in range(0, len(batch), 4096)):
                own = np.asarray(piece.column(0))
                own, first = np.unique(own, return_index=True)  # repeated rows take no places
                x = _unit(_matrix(piece.column(1), search.dims)[first])
                near = (q @ x.T).astype(np.float64)
                near[own[None, :] == q_ids[:, None]] = -np.inf
                if len(own) > k:
                    keep = np.argpartition(-near, k - 1, axis=1)[:, :k]
                else:
                    keep = np.broadcast_to(np.arange(len(own)), near.shape)
                near = np.take_along_axis(near, keep, 1)
                better = near > cos.min(axis=1)[:, None]
                if not better.any():
                    continue
                home = np.full(len(own), -1, np.int64)
                used = np.unique(keep[better])
                home[used] = _nearest_lists(index, x[used], 1, index.groups)[0][:, 0]
                both = np.concatenate([cos, near], axis=1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                cos = np.take_along_axis(both, best, 1)
                ids = np.take_along_axis(np.concatenate([ids, own[keep]], axis=1), best, 1)
                lists = np.take_along_axis(np.concatenate([lists, home[keep]], axis=1), best, 1)
                vecs = np.take_along_axis(np.concatenate([vecs, x[keep]], axis=1), best[:, :, None], 1)
        row, place = np.nonzero((ids >= 0) & (lists >= 0) & (cos >= (-2 if search.min_cos is None else search.min_cos)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row.astype(np.int32)), pa.array(ids[row, place]), pa.array(cos[row, place]), pa.array(lists[row, place].astype(np.int32)),
                pa.array([v.tobytes() for v in vecs[row, place]], pa.binary()),
            ],
            names=["owner", "other", "cos", "list", "vec"],
        )

    return scan


def _calibrated(vectors: DataFrame, index: Index, q_ids: np.ndarray, q: np.ndarray, search: Search) -> Index:
    """The index with as many probes as the neighbours of the queries need.

    A query and a neighbour meet if either looks into the list that the other is in, so the lower of both ranks counts.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((index, q_ids, q))
    found = vectors.select("id", "vec").mapInArrow(_truth(shared, search), TRUTH)
    once = found.groupBy("owner", "other").agg(F.max_by(F.struct("cos", "list", "vec"), "cos").alias("r")).select("owner", "other", "r.*")
    w = Window.partitionBy("owner").orderBy(F.col("cos").desc(), "other")
    truth = once.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= search.k).select("owner", "list", "vec").toArrow()
    owner, home = np.asarray(truth.column(0)), np.asarray(truth.column(1))
    if len(owner) == 0:
        return replace(index, probes=1, groups=1)
    near = np.frombuffer(b"".join(truth.column(2).to_pylist()), np.float32).reshape(len(owner), -1)
    group_of = np.searchsorted(index.fans, np.arange(len(index.centroids)), "right") - 1

    def ranks(x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many lists, and how many groups, are nearer to each row than the list named."""
        out = []
        for centroids, named in ((index.centroids, lists), (index.tops, group_of[lists])):
            step = max(1, TILE // len(centroids))
            pieces = [(x[i : i + step] @ centroids.T, named[i : i + step]) for i in range(0, len(x), step)]
            out.append(np.concatenate([(c > c[np.arange(len(c)), n][:, None]).sum(axis=1) for c, n in pieces]))
        return out[0], out[1]

    own = _nearest_lists(index, q, 1, index.groups)[0][:, 0]
    there, back = ranks(q[owner], home), ranks(near, own[owner])
    rank = np.minimum(there[0], back[0])
    group = np.where(there[0] <= back[0], there[1], back[1])
    probes = 1 + int(np.quantile(rank, search.recall, method="higher"))
    groups = 1 + int(np.quantile(group, (1 + search.recall) / 2, method="higher"))
    return replace(index, probes=probes, groups=groups)


def train(vectors: DataFrame, search: Search) -> Index | None:
    """Fit the index on bounded samples of ``vectors``; None if there are none."""
    n = vectors.count()
    if n == 0:
        return None
    rng = np.random.default_rng(search.seed)
    lists = int(min(search.max_lists, max(1, 2 ** round(np.log2(max(n / search.list_rows, 1))))))
    n_tops = 2 ** (lists.bit_length() // 2)
    want = max(search.sample_per_list * 2 * n_tops, 4 * search.calibrate)
    table = _thinned(vectors, min(1.0, 1.5 * want / n), search.seed).select("id", "vec").limit(2 * want).toArrow()
    if len(table) == 0:  # the sample of a tiny table may be empty
        table = vectors.select("id", "vec").limit(want).toArrow()
    ids = np.asarray(table.column(0))
    x = _unit(np.concatenate([_matrix(chunk, search.dims) for chunk in table.column(1).chunks if len(chunk)]))
    tops = _kmeans(x, min(n_tops, len(x)), rng)
    rows = np.bincount((x @ tops.T).argmax(axis=1), minlength=len(tops)) * (n / len(x))
    wanted = np.clip(np.rint(rows / n * lists), 1, search.max_fan).astype(np.int64)
    shares = np.minimum(1.0, search.sample_per_list * wanted / np.maximum(rows, 1))
    most = float(shares.max())
    sampled = _thinned(vectors, most, search.seed + 1).select("vec").mapInArrow(_sampler(tops, shares, most, search), SAMPLE)
    fitted = sampled.repartitionById(len(tops), "top").mapInArrow(_list_trainer(wanted, search), LISTS).toArrow().to_pylist()
    own: list[np.ndarray] = [tops[t : t + 1] for t in range(len(tops))]  # a group none of whose rows was sampled is one list
    held = [np.array([max(rows[t], 1.0)]) for t in range(len(tops))]
    for r in fitted:
        t = r["top"]
        counts = np.frombuffer(r["held"], np.int64)
        own[t] = np.frombuffer(r["centroids"], np.float32).reshape(-1, search.dims)
        held[t] = counts * (max(rows[t], counts.sum()) / max(1, counts.sum()))
    centroids, rows = np.concatenate(own), np.concatenate(held)
    fans = np.concatenate([[0], np.cumsum([len(c) for c in own])])
    cell, spread, cells = np.zeros(len(centroids), np.int32), np.ones(len(centroids), np.int32), 0
    for packed in _pack(centroids, rows, search.cell_rows):
        cell[packed] = cells
        if len(packed) == 1:
            spread[packed] = max(1, -(-int(rows[packed[0]]) // search.cell_rows))
        cells += int(spread[packed].max())
    rotation = np.linalg.qr(rng.standard_normal((search.dims, search.dims)))[0].astype(np.float32)
    if search.probes is not None:
        probes = min(search.probes, len(centroids))
        groups = len(tops) if probes == len(centroids) else min(len(tops), probes)
        return Index(tops, fans, centroids, cell, spread, cells, rotation, probes, groups)
    index = Index(tops, fans, centroids, cell, spread, cells, rotation, 1, min(len(tops), 16))
    asked = rng.choice(len(x), min(search.calibrate, len(x)), replace=False)
    return _calibrated(vectors, index, ids[asked], x[asked], search)


def _router(shared, search: Search):
    schema = arrow_schema(ROUTED)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        step = max(256, TILE // max(len(index.tops), index.probes * 16))
        ranks = min(index.probes + search.beside, len(index.centroids))
        for batch in batches:
            for start in range(0, len(batch), step):
                piece = batch.slice(start, step)
                ids = np.asarray(piece.column(0))
                x = _matrix(piece.column(1), search.dims)
                top = _nearest_lists(index, _unit(x), ranks, index.groups)[0]
                cells_of = index.cell[top]
                for r in range(index.probes, ranks):
                    top[~(cells_of[:, r, None] == cells_of[:, : index.probes]).any(axis=1), r] = -1
                home = top[:, 0].astype(np.int32)
                # indexed once, in the cell of its nearest list, salted if that list is spread over several cells
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.spread[home]
                home_cell = index.cell[home] + salt
                # looks once into every cell that holds one of its lists
                flat_row, flat_rank = np.nonzero(top >= 0)
                flat_list = top[flat_row, flat_rank]
                flat_cell = index.cell[flat_list]
                many = np.flatnonzero(index.spread[flat_list] > 1)
                if len(many):
                    extra = np.concatenate([np.arange(1, index.spread[flat_list[i]]) for i in many])
                    again = np.repeat(many, index.spread[flat_list[many]] - 1)
                    flat_row, flat_rank = np.concatenate([flat_row, flat_row[again]]), np.concatenate([flat_rank, flat_rank[again]])
                    flat_cell = np.concatenate([flat_cell, flat_cell[again] + extra])
                    flat_list = np.concatenate([flat_list, flat_list[again]])
                # a row's lists in a cell stand nearest first; only in its own cell the row is not just a query
                order = np.lexsort((flat_rank, flat_cell, flat_row))
                flat_row, flat_cell, flat_list = flat_row[order], flat_cell[order], flat_list[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(flat_row) != 0) | (np.diff(flat_cell) != 0)]))
                row, cells = flat_row[new], flat_cell[new]
                offsets = np.append(new, len(flat_row)).astype(np.int32)
                is_query = cells != home_cell[row]
                vecs = pa.ListArray.from_arrays(np.arange(0, (len(row) + 1) * search.dims, search.dims, dtype=np.int32), x[row].ravel())
                arrays = [
                    pa.array(cells.astype(np.int32)), pa.array(is_query), pa.array(ids[row]),
                    pa.ListArray.from_arrays(offsets, flat_list.astype(np.int32)), vecs,
                ]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return route


def _best(owner: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best, ties by smaller id; a pair found twice counts once."""
    order = np.lexsort((other, -cos, owner))
    o, t = owner[order], other[order]
    once = np.concatenate([[True], (np.diff(o) != 0) | (np.diff(t) != 0)])
    order, o = order[once], o[once]
    start = np.flatnonzero(np.concatenate([[True], np.diff(o) != 0]))
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[rank < k]


def _survivors(
    q: np.ndarray, y: np.ndarray, own: np.ndarray, wanted: np.ndarray, k: int, blocks: list[tuple[int, int]], epsilon: float,
    other: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated rows that no test abandons.

    ``wanted`` is each query's k-th best squared distance so far, ``own`` its place among ``y`` (or -1). A query that
    has none yet gets one here: the k rows nearest in the first block are computed in full, and the farthest of them
    bounds the k-th best. ``other`` is the same of the rows of ``y``, for which a pair stays as well.
    """
    dims = y.shape[1]
    a, b = blocks[0]
    qa, ya = q[:, a:b], y[:, a:b]
    partial = (qa**2).sum(axis=1)[:, None] + (ya**2).sum(axis=1)[None, :] - 2 * (qa @ ya.T)
    at = np.flatnonzero(own >= 0)
    partial[at, own[at]] = np.inf
    fresh = np.flatnonzero(np.isinf(wanted))
    if len(fresh) and len(y) > k:
        near = np.argpartition(partial[fresh], k - 1, axis=1)[:, :k]
        whole = ((q[fresh][:, None, :] - y[near]) ** 2).sum(axis=2)
        whole[np.isinf(np.take_along_axis(partial[fresh], near, 1))] = np.inf
        wanted = wanted.copy()
        wanted[fresh] = whole.max(axis=1)
    grow = lambda end: (1 + epsilon / np.sqrt(end)) ** 2 * end / dims if end < dims else 1.0
    limit = wanted[:, None] if other is None else np.maximum(wanted[:, None], other[None, :])
    i, j = np.nonzero((partial <= limit * grow(b) + 1e-4) & (partial < np.inf))
    limit = wanted[i] if other is None else np.maximum(wanted[i], other[j])
    so_far = partial[i, j]
    for a, b in blocks[1:]:
        if len(i) == 0:
            break
        so_far = so_far + ((q[i, a:b] - y[j, a:b]) ** 2).sum(axis=1)
        keep = so_far <= limit * grow(b) + 1e-4
        i, j, so_far, limit = i[keep], j[keep], so_far[keep], limit[keep]
    return i, j


def _ranks(widest: int) -> list[tuple[int, int]]:
    """Stretches of a query's lists looked into together: the nearest, the next, then twice as many each time."""
    out, a = [], 0
    while a < widest:
        b = 1 if a == 0 else min(widest, 2 * a)
        out.append((a, b))
        a = b
    return out


def _scanner(shared, search: Search):
    dims, k = search.dims, search.k
    farthest = np.inf if search.min_cos is None else 2 - 2 * search.min_cos
    least = -2.0 if search.min_cos is None else search.min_cos
    ends = sorted({min(dims, max(1, dims * p // 4)) for p in (1, 2, 4)})
    blocks = list(zip([0, *ends], ends))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value.rotation
        cell = None
        pending: list[tuple] = []
        ids = vecs = norms = rotated = None
        where: dict[int, np.ndarray] = {}
        several = 1  # vectors of one id in the cell, at most
        bounds: np.ndarray | None = None  # k-th best of the cell's own rows, once they have looked

        def settle() -> Iterator[pa.RecordBatch]:
            """Make what was gathered of the cell searchable, by list; then it looks into the cell itself."""
            nonlocal ids, vecs, norms, rotated, where, pending, several, bounds
            gathered, pending, where, bounds = pending, [], {}, None
            if not gathered:
                ids = np.zeros(0, np.int64)
                return
            ids = np.concatenate([p[0] for p in gathered])
            lists = np.concatenate([p[1][np.cumsum(p[2]) - p[2]] for p in gathered])
            vecs = np.concatenate([p[3] for p in gathered])
            # a row given twice stands here once
            order = np.argsort(ids, kind="stable")
            again = np.zeros(len(ids), bool)
            again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (vecs[order[1:]] == vecs[order[:-1]]).all(axis=1)
            once = np.flatnonzero(~again)
            ids, lists, vecs = ids[once], lists[once], vecs[once]
            several = int(np.unique(ids, return_counts=True)[1].max())
            norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
            rotated = _unit(vecs) @ rotation
            order = np.argsort(lists, kind="stable")
            names, starts = np.unique(lists[order], return_index=True)
            where = {name: at[np.argsort(ids[at], kind="stable")] for name, at in zip(names.tolist(), np.split(order, starts[1:]))}
            mine = [np.concatenate(x) for x in zip(*gathered)]
            yield from look(*mine, once)

        def look(q_ids, q_lists, q_sizes, q_vecs, once=None) -> Iterator[pa.RecordBatch]:
            """``once``: these are the cell's own rows, and where among them its searchable ones stand."""
            nonlocal bounds
            q_rot = _unit(q_vecs) @ rotation
            q_norm = np.sqrt((q_vecs.astype(np.float64) ** 2).sum(axis=1))
            row = np.repeat(np.arange(len(q_ids)), q_sizes)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(q_sizes) - q_sizes, q_sizes)
            kept = np.full((len(q_ids), k), -np.inf)  # each query's best cosines so far
            wanted = np.full(len(q_ids), farthest)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for first, last in _ranks(int(q_sizes.max())):
                now = np.flatnonzero((rank >= first) & (rank < last))
                order = now[np.argsort(q_lists[now], kind="stable")]
                names, starts = np.unique(q_lists[order], return_index=True)
                hits_q, hits_y = [], []
                theirs = bounds if once is None or first == 0 else wanted[once]
                for name, mine in zip(names.tolist(), np.split(row[order], starts[1:])):
                    at = where.get(name)
                    if at is None:
                        continue
                    y, y_ids = rotated[at], ids[at]
                    step = max(1, TILE // len(at))
                    for s in range(0, len(mine), step):
                        part = mine[s : s + step]
                        place = np.minimum(np.searchsorted(y_ids, q_ids[part]), len(at) - 1)
                        own = np.where(y_ids[place] == q_ids[part], place, -1)
                        # several vectors of one id: their first places say nothing of the k-th best id
                        bound = wanted[part] if several == 1 else np.full(len(part), np.nextafter(4.0, 5) if farthest == np.inf else farthest)
                        i, j = _survivors(q_rot[part], y, own, bound, k, blocks, search.epsilon, None if theirs is None or several > 1 else theirs[at])
                        if len(i):
                            hits_q.append(part[i])
                            hits_y.append(at[j])
                if not hits_q:
                    continue
                i, j = np.concatenate(hits_q), np.concatenate(hits_y)
                keep = q_ids[i] != ids[j]
                i, j = i[keep], j[keep]
                cos = np.empty(len(i))
                for s in range(0, len(i), 1 << 16):
                    p, r = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    dot = np.einsum("nd,nd->n", q_vecs[p].astype(np.float64), vecs[r].astype(np.float64))
                    cos[s : s + (1 << 16)] = dot / (q_norm[p] * norms[r])
                cos = np.round(cos, 9)
                keep = cos >= least
                i, j, cos = i[keep], j[keep], cos[keep]
                if len(i) == 0:
                    continue
                found.append((i, j, cos))
                order = np.lexsort((-cos, i))
                begin = np.flatnonzero(np.diff(i[order], prepend=-1))
                place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
                top = order[place < k]
                touched, line = np.unique(i[top], return_inverse=True)
                better = np.full((len(touched), k), -np.inf)
                better[line, place[place < k]] = cos[top]
                kept[touched] = -np.sort(-np.concatenate([kept[touched], better], axis=1), axis=1)[:, :k]
                wanted[touched] = np.minimum(farthest, 2 - 2 * kept[touched, k - 1])
            if once is not None:
                bounds = wanted[once]
            if not found:
                return
            i, j, cos = (np.concatenate(x) for x in zip(*found))
            a, b = q_ids[i], ids[j]
            forth, back = _best(a, b, cos, k), _best(b, a, cos, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a[forth], b[back]])), pa.array(np.concatenate([b[forth], a[back]])),
                    pa.array(np.concatenate([cos[forth], cos[back]])),
                ],
                names=["owner", "other", "cos"],
            )

        for batch in batches:
            cells = np.asarray(batch.column(0))
            is_query = batch.column(1).to_numpy(zero_copy_only=False)
            cutpoints = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for start, end in zip(np.append(0, cutpoints), np.append(cutpoints, len(cells))):
                if start == end:
                    continue
                if cells[start] != cell:
                    if pending:
                        yield from settle()
                    cell, pending, ids = cells[start], [], None
                piece = batch.slice(start, end - start)
                rows = (
                    np.asarray(piece.column(2)),
                    np.asarray(piece.column(3).flatten()),
                    np.asarray(pc.list_value_length(piece.column(3))),
                    _matrix(piece.column(4), dims),
                )
                if not is_query[start]:
                    pending.append(rows)
                    continue
                if ids is None:
                    yield from settle()
                if len(ids):
                    yield from look(*rows)
        if pending:
            yield from settle()

    return scan


def _search(vectors: DataFrame, index: Index, search: Search) -> DataFrame:
    """owner, other, cos of the k best found per owner."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    routed = vectors.select("id", "vec").mapInArrow(_router(shared, search), ROUTED)
    tasks = min(MAX_TASKS, index.n_cells)
    by_cell = routed.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "query")
    pairs = by_cell.mapInArrow(_scanner(shared, search), FOUND)
    return best_k(pairs, search.k)


def best_k(pairs: DataFrame, k: int) -> DataFrame:
    """Each owner's k best distinct others: highest cosine, then smaller id."""
    w = Window.partitionBy("owner").orderBy(F.col("cos").desc(), "other")
    once = pairs.groupBy("owner", "other").agg(F.max("cos").alias("cos"))
    return once.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _crowds(vectors: DataFrame, k: int) -> DataFrame | None:
    """vec, head, last of every group of more than k + 1 equal vectors: its first id and its (k + 1)-th.

    Hashes only say which vectors may be equal to that many others; those are then compared whole.
    """
    w = Window.partitionBy("h").orderBy("id")
    hashed = vectors.select("id", F.xxhash64("vec").alias("h")).distinct()
    full = hashed.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == k + 2).select("h")
    likely = cut(full)
    if likely.isEmpty():
        return None
    same = vectors.withColumn("h", F.xxhash64("vec")).join(likely, "h", "left_semi").select("id", "vec")
    w = Window.partitionBy("vec").orderBy("id")
    firsts = same.distinct().withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k + 2)
    groups = firsts.groupBy("vec").agg(F.min("id").alias("head"), F.max(F.when(F.col("_rank") == k + 1, F.col("id"))).alias("last"), F.count(F.lit(1)).alias("n"))
    return cut(groups.where(F.col("n") == k + 2).select("vec", "head", "last"))


def neighbours(rows: DataFrame, key: str, vec: str, search: Search | None = None) -> DataFrame:
    """owner, other, cos: for every vector the k most similar others, those with at least ``min_cos`` if it is given.

    Vectors that are null, of another length, with a null, NaN or infinite value or all zero do not count, nor do
    rows without key; repeated rows count once. A key with several vectors counts with each of them. Cosines are
    exact (double precision, 9 decimals), ties go to the smaller key; which pairs are found is approximate.
    """
    search = search or Search()
    vectors = valid_vectors(rows, key, vec, search.dims)
    spark = rows.sparkSession
    groups = _crowds(vectors, search.k)
    searched = vectors
    if groups is not None:
        few = groups.count() <= SMALL_GROUPS
        tagged = vectors.join(F.broadcast(groups) if few else groups, "vec", "left")
        searched = tagged.where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "vec")
        if not few:  # so that it is shuffled once
            searched = spool(searched)
    index = train(searched, search)
    if index is None:
        return spark.createDataFrame([], FOUND)
    found = _search(searched, index, search)
    if groups is not None:
        found = cut(found)
        rest = tagged.where(F.col("id") > F.col("last")).select(F.col("id").alias("owner"), "head").distinct()
        heads = groups.select("head").distinct()
        theirs = found.join(heads, F.col("owner") == F.col("head")).select("head", "other", "cos")
        itself = heads.select("head", F.col("head").alias("other"), F.lit(1.0).alias("cos"))
        w = Window.partitionBy("head").orderBy(F.col("cos").desc(), "other")
        lists = theirs.unionByName(itself).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= search.k)
        salts = 16
        spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(salts)).cast("int"))
        found = found.unionByName(salted.join(spread, ["head", "salt"]).select("owner", "other", "cos"))
    return found


def similar_pairs(found: DataFrame) -> DataFrame:
    """Pairs of which either one keeps the other, smaller key first."""
    return found.select(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")).distinct()
