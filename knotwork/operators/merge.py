"""Merging similar nodes, in one batch.

Nearest-neighbour pairs are taken on the graph as it stands; those below the threshold are oriented to the smaller
id and chains run to their smallest id; edges are rewired once, their documents and labels folded into the
survivor, duplicates removed. (The reference works one node at a time and its outcome depends on that order.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import jsontext
from knotwork.operators import vector
from knotwork.session import cut


#: Merged ids that are broadcast at most.
SMALL = 200_000


def similar_pairs(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.9, limit: int | None = 10) -> DataFrame:
    """id, survivor: for the first ``limit`` nodes (None: all) the nearest other node below the threshold."""
    own = nodes.select("embed_id", "id")
    asked = own if limit is None else own.orderBy("embed_id").limit(limit)
    queries = vectors.join(asked, "embed_id").select(F.col("embed_id").alias("query_id"), "vector")
    hits = vector.nearest_batch(vectors.join(own.select("embed_id"), "embed_id", "left_semi"), queries, 1, threshold, True)
    named = hits.join(own.select(F.col("embed_id").alias("query_id"), F.col("id").alias("a")), "query_id").join(
        own.select("embed_id", F.col("id").alias("b")), "embed_id"
    )
    return named.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("survivor")).where("id <> survivor").distinct()


def resolve_chains(pairs: DataFrame) -> DataFrame:
    """id, survivor with every id led to the smallest id it is connected with: labels spread until none changes."""
    links = pairs.select(F.col("id").alias("a"), F.col("survivor").alias("b"))
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        offered = links.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        grown = cut(
            labels.join(offered, "a").select("a", F.least("label", "theirs").alias("label"), (F.col("theirs") < F.col("label")).alias("moved"))
        )
        if grown.where("moved").isEmpty():
            return grown.where("a <> label").select(F.col("a").alias("id"), F.col("label").alias("survivor"))
        # pointer jumping: a label's own label
        jump = grown.select(F.col("a").alias("label"), F.col("label").alias("further"))
        labels = cut(grown.join(jump, "label", "left").select("a", F.least("label", F.coalesce("further", "label")).alias("label")))


def rewire(edges: DataFrame, merged: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Edges with duplicates' ends led to their survivors; loops that arise are dropped unless kept."""
    few = merged.count() <= SMALL  # edges need no shuffle for so few; beyond, adaptive execution splits skewed ends
    sized = F.broadcast(merged) if few else merged
    heads = sized.select(F.col("id").alias("source"), F.col("survivor").alias("_s"))
    tails = sized.select(F.col("id").alias("target"), F.col("survivor").alias("_t"))
    moved = edges.join(heads, "source", "left").join(tails, "target", "left")
    arose = (F.col("_s").isNotNull() | F.col("_t").isNotNull()) & (F.coalesce("_s", "source") == F.coalesce("_t", "target"))
    if not keep_loops:
        moved = moved.where(~F.coalesce(arose, F.lit(False)))
    return moved.select(
        *(
            {"source": F.coalesce("_s", "source").alias("source"), "target": F.coalesce("_t", "target").alias("target")}.get(c, F.col(c))
            for c in edges.columns
        )
    )


def incident(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """survivor and the edge for every end that stands on a duplicate; a loop counts at both ends."""
    cols = ["embed_id", "label", "attributes"]
    out = edges.join(merged.withColumnRenamed("id", "source"), "source").select("survivor", F.lit(0).alias("end"), *cols)
    back = edges.join(merged.withColumnRenamed("id", "target"), "target").select("survivor", F.lit(1).alias("end"), *cols)
    return back.unionByName(out)


def _joined(rows: DataFrame, keys: list[str], order: list[str], value: str, by: str = "") -> DataFrame:
    """keys, joined: the texts of ``value`` in order, with ``by`` between them.

    Rows are ranged by key and order first, so that a hub's lie in many partitions; each joins its own stretch, and
    then one text per stretch meets the others. A task so holds a stretch, and of a key the text that is its result.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("__kw_part", F.spark_partition_id())
    own = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__kw_v"))))
    stretch = ranged.groupBy(*keys, "__kw_part").agg(F.concat_ws(by, F.transform(own, lambda x: x["__kw_v"])).alias("__kw_v"))
    parts = F.array_sort(F.collect_list(F.struct("__kw_part", "__kw_v")))
    return stretch.groupBy(*keys).agg(F.concat_ws(by, F.transform(parts, lambda x: x["__kw_v"])).alias("joined"))


def _json_text(column: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(column.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def fold_attributes(touching: DataFrame) -> DataFrame:
    """survivor, key, num, text, json: top-level fields of all edge documents folded per survivor and field.

    One value stays what it is. Numbers add up, true and false being 1 and 0; lists are joined to one list; if any
    value is a text and none a list or object, all are joined as texts. What cannot be added (objects, lists beside
    other kinds) stands in one list. All in edge order; nulls count as nothing. Documents that are no objects have no
    fields. ``num`` and ``text`` hold results of these kinds, ``json`` any.
    """
    edge = touching.select("survivor", "embed_id", "end", "attributes").distinct()
    each = jsontext.json_tree(edge.select("embed_id", "attributes").distinct(), "embed_id", "attributes", depth=1)
    fields = each.where("depth = 1 and type <> 'null' and fullkey like '$.%'").withColumnRenamed("_row", "embed_id")
    rows = edge.select("survivor", "embed_id", "end").join(fields, "embed_id")
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    rows = rows.withColumn("shown", F.coalesce("text", number(F.col("num")))).withColumn(
        "value",
        F.when(F.col("type") == "boolean", (F.col("num") == 1).cast("string"))
        .when(F.col("type") == "number", F.col("shown"))
        .when(F.col("type") == "text", _json_text(F.col("text")))
        .otherwise(F.col("text")),
    )
    kinds = rows.groupBy("survivor", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "text").alias("texts"), F.count_if(F.col("type") == "array").alias("lists"),
        F.count_if(F.col("type") == "object").alias("objects"), F.sum(F.when(F.col("type").isin("number", "boolean"), F.col("num"))).alias("total"),
        F.any_value("value").alias("only"),
    )
    nested = F.col("lists") + F.col("objects") > 0
    kinds = kinds.withColumn(
        "fold",
        F.when((F.col("lists") == F.col("n")) & (F.col("n") > 1), "join").when(nested & (F.col("n") > 1), "list")
        .when((F.col("texts") > 0), "text").when((F.col("n") == 1), "only").otherwise("sum"),
    )
    # sums and single values need no order; only the others are joined
    ordered = rows.join(kinds.where(F.col("fold").isin("join", "list", "text")).select("survivor", "key", "fold"), ["survivor", "key"])
    inner = F.when(F.col("fold") == "text", F.col("shown")).when(F.col("fold") == "list", F.col("value")).otherwise(
        F.nullif(F.regexp_replace("value", r"(?s)^\[(.*)\]$", "$1"), F.lit(""))
    )
    ordered = ordered.withColumn("piece", inner).where("piece is not null")
    order = ["embed_id", "end"]
    texts = _joined(ordered.where("fold = 'text'"), ["survivor", "key"], order, "piece")
    lists = _joined(ordered.where("fold <> 'text'"), ["survivor", "key"], order, "piece", ",")
    folded = kinds.join(texts.unionByName(lists), ["survivor", "key"], "left")
    is_text = F.col("fold") == "text"
    json = (
        F.when(is_text, _json_text(F.coalesce("joined", F.lit(""))))
        .when(F.col("fold").isin("join", "list"), F.concat(F.lit("["), F.coalesce("joined", F.lit("")), F.lit("]")))
        .when(F.col("fold") == "only", F.col("only"))
        .otherwise(number(F.col("total")))
    )
    return folded.select(
        "survivor", "key", F.when(F.col("fold").isin("only", "sum"), F.col("total")).alias("num"),
        F.when(is_text, F.coalesce("joined", F.lit(""))).alias("text"), json.alias("json"),
    )


def fold_labels(nodes: DataFrame, touching: DataFrame) -> DataFrame:
    """survivor, label: the node's label, then the labels of the edges, each followed by a comma."""
    rows = touching.select("survivor", "embed_id", "end", F.concat(F.coalesce("label", F.lit("")), F.lit(",")).alias("label"))
    joined = _joined(rows, ["survivor"], ["embed_id", "end"], "label")
    own = nodes.select(F.col("id").alias("survivor"), F.col("label").alias("_label"))
    return joined.join(own, "survivor").select("survivor", F.concat(F.coalesce("_label", F.lit("")), F.lit(","), F.col("joined")).alias("label"))


def _folded_document(folded: DataFrame) -> DataFrame:
    """survivor, _new: the folded fields as one JSON object."""
    pair = F.concat(_json_text(F.col("key")), F.lit(":"), F.col("json"))
    return folded.groupBy("survivor").agg(F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(F.collect_list(pair))), F.lit("}")).alias("_new"))


def merge_by_similarity(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, threshold: float = 0.9, limit: int | None = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merged) after merging: folded fields overwrite the survivor's own, duplicates are gone."""
    merged = cut(resolve_chains(similar_pairs(nodes, vectors, threshold, limit)))
    touching = cut(incident(edges, merged))
    documents = _folded_document(fold_attributes(touching)).withColumnRenamed("survivor", "id")
    labels = fold_labels(nodes, touching).select(F.col("survivor").alias("id"), F.col("label").alias("_label"))
    left = nodes.join(merged.select("id"), "id", "left_anti").join(documents, "id", "left").join(labels, "id", "left")
    folded = left.select(
        *(
            {
                "label": F.coalesce("_label", "label").alias("label"),
                "attributes": F.when(F.col("_new").isNotNull(), jsontext.merge("attributes", "_new")).otherwise(F.col("attributes")).alias("attributes"),
            }.get(c, F.col(c))
            for c in nodes.columns
        )
    )
    return folded, rewire(edges, merged), merged


def last_of_parallel(edges: DataFrame) -> DataFrame:
    """a, b and the last edge between them regardless of direction (greatest embed_id)."""
    ends = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    w = Window.partitionBy("a", "b").orderBy(F.col("embed_id").desc())
    return ends.withColumn("__kw_rank", F.row_number().over(w)).where("__kw_rank = 1").drop("__kw_rank")
