"""Traversal: reachability, bodies, paths, neighbourhoods.

The steps, two columns of the edges, are written once in ``spark.checkpoint.dir``'s folder. A loop goes on from there,
one write per hop, or per few hops of a small frontier, whose row counts come with it; a hop so never recomputes
earlier writes and survives lost executors. A frontier of at most ``SMALL`` ids, by its count, is broadcast, so that the edges are not shuffled for it;
a larger one is joined by sort-merge, where adaptive execution splits skewed ids. What has been seen is compacted
whenever it lies in ``PIECES`` parts, so that a hop reads few files however deep the graph is. Connected components do
not walk at all: stars are contracted, in rounds that grow with the logarithm of a component's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.lookup import limited, text_id
from knotwork.session import cut, spool, spool_counted

#: Ids that are broadcast at most.
SMALL = 200_000
#: Frontiers that are read one by one at most.
PIECES = 16
#: Hops of a small frontier in one write.
SPAN = 3


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return spool(steps.where("at is not null and to is not null and at <> to"))


def _sized(ids: DataFrame, n: int) -> DataFrame:
    """Ids whose number is known, to be broadcast if that is small."""
    return F.broadcast(ids) if n <= SMALL else ids


def hops(
    edges: DataFrame, seeds: DataFrame, direction: str = "out", max_hops: int | None = None, stop_at: str | None = None
) -> DataFrame:
    """id, hop, via: everything reachable from the seeds' ids, at the least number of hops; the seeds are hop 0.

    ``via`` is the smallest id one hop before, null for seeds. Ends when nothing new turns up, after ``max_hops``, or
    with the hop that reaches ``stop_at``. Cycles are safe.
    """
    steps = _steps(edges, direction)
    reached = F.count_if(F.col("id") == F.lit(stop_at))
    first = seeds.select("id").where("id is not null").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    frontier, counted = spool_counted(first, reached=reached, last=F.count(F.lit(1)))
    found, hop, total = [frontier], 0, counted["rows"]
    while counted["last"] and not counted["reached"] and (max_hops is None or hop < max_hops):
        if len(found) > PIECES:
            found = [spool(reduce(DataFrame.unionByName, found))]
        seen = _sized(reduce(DataFrame.unionByName, found).select("id"), total)
        # a small frontier goes on for several hops in one write; one that stops at an id must look after each
        span = SPAN if counted["last"] <= SMALL and stop_at is None else 1
        span = span if max_hops is None else min(span, max_hops - hop)
        levels: list[DataFrame] = []
        before = _sized(frontier.where(F.col("hop") == hop).select(F.col("id").alias("at")), counted["last"])
        for _ in range(span):
            hop += 1
            fresh = steps.join(before, "at").groupBy(F.col("to").alias("id")).agg(F.min("at").alias("via")).join(seen, "id", "left_anti")
            for level in levels:
                fresh = fresh.join(level.select("id"), "id", "left_anti")
            levels.append(fresh.select("id", F.lit(hop).alias("hop"), "via"))
            before = levels[-1].select(F.col("id").alias("at"))
        frontier, counted = spool_counted(
            reduce(DataFrame.unionByName, levels), reached=reached, last=F.count_if(F.col("hop") == F.lit(hop))
        )
        total += counted["rows"]
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def _start(nodes: DataFrame, source: int | str) -> DataFrame:
    return nodes.where(F.col("id") == text_id(source)).select("id").distinct()


def reachable(
    nodes: DataFrame, edges: DataFrame, source: int | str, direction: str = "out", stop_at: str | None = None,
    max_hops: int | None = None,
) -> DataFrame:
    """Ids reachable from ``source``, itself included; nothing if it is no node. Dangling targets are reached."""
    return hops(edges, _start(nodes, source), direction, max_hops, stop_at).select("id", "hop")


def traverse_bodies(nodes: DataFrame, edges: DataFrame, source: int | str) -> DataFrame:
    """id, mark, body of everything connected with ``source`` in either direction: each node with its document,
    its out-edges as (target, '->') and its in-edges as (source, '<-'); equal rows once."""
    near = hops(edges, _start(nodes, source), "both").select("id")
    own = near.join(nodes, "id").select("id", F.lit("()").alias("mark"), F.col("attributes").alias("body"))
    out = near.join(edges, F.col("id") == F.col("source")).select(
        F.col("target").alias("id"), F.lit("->").alias("mark"), F.col("attributes").alias("body")
    )
    back = near.join(edges, F.col("id") == F.col("target")).select(
        F.col("source").alias("id"), F.lit("<-").alias("mark"), F.col("attributes").alias("body")
    )
    return own.unionByName(out).unionByName(back).distinct()


def incident_edges(edges: DataFrame, node_id: int | str) -> DataFrame:
    own = text_id(node_id)
    return edges.where((F.col("source") == own) | (F.col("target") == own)).distinct()


def one_way(edges: DataFrame, node_id: int | str, direction: str) -> DataFrame:
    """All columns of the edges that come in ('in') or go out ('out')."""
    return edges.where(F.col("target" if direction == "in" else "source") == text_id(node_id))


def in_edges(edges: DataFrame, target: int | str, limit: int | None = 10) -> DataFrame:
    own = one_way(edges, target, "in").select("source", "label", "attributes", "embed_id")
    return limited(own, limit, "embed_id").drop("embed_id")


def out_edges(edges: DataFrame, source: int | str, limit: int | None = 10) -> DataFrame:
    own = one_way(edges, source, "out").select("target", "label", "attributes", "embed_id")
    return limited(own, limit, "embed_id").drop("embed_id")


def neighbours_of(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int | None = 1) -> DataFrame:
    """Nodes at both ends of the edges that touch any of ``ids`` (column id). ``limit`` counts edges; 1 as in the
    reference's default. Ends without a node drop out."""
    wanted = ids.select("id").distinct()
    flag = lambda end: wanted.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    rows = edges.select("embed_id", "source", "target").join(flag("source"), "source", "left").join(flag("target"), "target", "left")
    touched = rows.where("_source or _target").select("embed_id", "source", "target").distinct()
    ends = limited(touched, limit, "embed_id").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi").select("id", "label", "attributes").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: number of edge ends at each node; map-side combined, so hot nodes cost no more."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """id, label of every id at an edge: the smallest id of its connected component, regardless of direction.

    Two contractions in turn until nothing moves: every id links its larger neighbours to the smallest (large star),
    then its smaller neighbours and itself to the smallest of these (small star). Each is one grouped minimum and one
    join on its result, and leaves at most as many links as before; a hub's links are joined with one row, where
    adaptive execution splits them.
    """
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null")
    alone = ends.where("a = b").select("a")
    links, counted = spool_counted(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while counted["rows"]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = spool(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        contracted = small.select("l.*").where("a <> b").distinct()
        links, now = spool_counted(contracted, mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if (now["rows"], now["mark"]) == (counted["rows"], counted.get("mark")):
            break
        counted = now
    roots = links.select(F.col("b").alias("a")).unionByName(alone).distinct().select(F.col("a").alias("id"), F.col("a").alias("label"))
    leaves = links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return leaves.unionByName(roots).groupBy("id").agg(F.min("label").alias("label"))


def component(edges: DataFrame, source: int | str) -> DataFrame:
    """Ids of the connected component of ``source``; itself alone if no edge touches it."""
    own = text_id(source)
    labels = spool(components(edges))
    label = labels.where(F.col("id") == own).select("label").first()
    if label is None:
        return edges.sparkSession.createDataFrame([(own,)], "id string")
    return labels.where(F.col("label") == label[0]).select("id")


def shortest_path(edges: DataFrame, source: int | str, target: int | str, max_hops: int | None = None) -> DataFrame:
    """step, id of one shortest path along out-edges; no rows if there is none.

    The walk keeps the smallest predecessor of every id; going back reads one id per step from what it reached.
    """
    spark = edges.sparkSession
    goal = text_id(target)
    reached = spool(hops(edges, spark.createDataFrame([(text_id(source),)], "id string"), "out", max_hops, goal))
    end = reached.where(F.col("id") == goal).first()
    if end is None:
        return spark.createDataFrame([], "step int, id string")
    path = [goal]
    while end.via is not None:
        path.append(end.via)
        end = reached.where(F.col("id") == end.via).first()
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, id string")


# Relations between versioned resources.


def as_edges(relations: DataFrame) -> DataFrame:
    """Relations in the shape of edges: the same traversals serve both."""
    return relations.select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation").alias("label"),
        F.col("resource").alias("attributes"), "embed_id",
    )


def relation_in(relations: DataFrame, target: str) -> DataFrame:
    return relations.where(F.col("target_id") == target).select("source_id", "source_type", "resource")


def relation_out(relations: DataFrame, source: str) -> DataFrame:
    return relations.where(F.col("source_id") == source).select("target_id", "target_type", "resource")


def relation_touching(relations: DataFrame, resource_id: str) -> DataFrame:
    return relations.where((F.col("source_id") == resource_id) | (F.col("target_id") == resource_id))
