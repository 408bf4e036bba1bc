"""Graph operators over edges (id, from_id, to_id, label, weight, source, ...).

Traversal is breadth first, a join of the frontier with the edges for each
level; only nodes not seen before go on. Lineage is cut at a checkpoint each
level, in the shared folder of the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators.rank import DIGITS
from tarn.sources.shared import cut


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    """Edge refs (edge_id, target_id, label, weight, source) from a node."""
    return _refs(edges.where(F.col("from_id") == node), "to_id")


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return _refs(edges.where(F.col("to_id") == node), "from_id")


def _refs(edges: DataFrame, target: str) -> DataFrame:
    return edges.select(F.col("id").alias("edge_id"), F.col(target).alias("target_id"), "label", "weight", "source")


def edges_of(edges: DataFrame, from_id: str = "", to_id: str = "") -> DataFrame:
    """Whole edges from (which wins) or to a node, oldest first."""
    if not from_id and not to_id:
        raise ValueError("one of from_id and to_id is needed")
    return edges.where(F.col("from_id") == from_id if from_id else F.col("to_id") == to_id).orderBy("created_at", "id")


def all_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("id")


def neighbour_ids(edges: DataFrame, node: str) -> DataFrame:
    """(id): both directions, distinct; a self-loop gives the node itself."""
    ends = edges.where((F.col("from_id") == node) | (F.col("to_id") == node))
    return ends.select(F.explode(F.array(F.when(F.col("from_id") == node, F.col("to_id")), F.when(F.col("to_id") == node, F.col("from_id")))).alias("id")).where("id IS NOT NULL").distinct()


def _walk(links: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(id, depth) of the nodes reached over links (a, b), the start at depth 0."""
    spark = links.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    depth = 0
    while max_depth <= 0 or depth < max_depth:
        depth += 1
        new = cut(
            links.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        )
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = new
    return seen


def _links(edges: DataFrame, both: bool) -> DataFrame:
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return out.union(out.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else out


def neighbourhood(edges: DataFrame, start: str, max_depth: int = 0) -> DataFrame:
    """(id, score): nodes within ``max_depth`` steps (unlimited if <= 0) in either direction, scored 1 / (1 + depth)."""
    seen = _walk(_links(edges, True), start, max_depth).where(F.col("depth") > 0)
    return seen.select("id", F.round(1 / (1 + F.col("depth")), DIGITS).alias("score")).orderBy(F.desc("score"), "id")


def subtree(edges: DataFrame, root: str, max_depth: int = 0) -> DataFrame:
    """Edge refs out of every node that directed steps reach above ``max_depth``; each edge once."""
    reached = _walk(_links(edges, False), root, max_depth)
    if max_depth > 0:
        reached = reached.where(F.col("depth") < max_depth)
    return _refs(edges.join(reached.select(F.col("id").alias("from_id")), "from_id", "left_semi"), "to_id")


def overview(edges: DataFrame, entries: DataFrame, collection: str = "", limit: int = 500) -> DataFrame:
    """(id, collection, label, truncated): nodes in order of id, at most ``limit`` (500 if <= 0, 2,000 at most).

    Nodes are the ends of all edges and the entries of the collection; entries
    of other collections stay only if an edge touches them. An end without an
    entry has an empty collection and label.
    """
    limit = 500 if limit <= 0 else min(limit, 2000)
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("end_", F.lit(True))
    docs = entries.select("id", "collection", X.overview_label(F.col("summary"), F.col("content")).alias("label"))
    nodes = docs.join(ends, "id", "full")
    if collection:
        nodes = nodes.where((F.col("collection") == collection) | F.col("end_"))
    first = nodes.orderBy("id").limit(limit + 1)
    n = F.count("*").over(_everything())
    nth = F.row_number().over(_everything().orderBy("id"))
    return first.withColumn("truncated", n > limit).withColumn("nth_", nth).where(F.col("nth_") <= limit).select(
        "id", F.coalesce("collection", F.lit("")).alias("collection"), F.coalesce("label", F.lit("")).alias("label"), "truncated"
    )


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def tree_edges(spark: SparkSession, docs: DataFrame, fan_out: int = 3) -> DataFrame:
    """Edges that make a heap-shaped tree of the documents: (id div fan_out) -> id."""
    d = docs.where("doc_id > 0").select("doc_id")
    return d.select(
        F.concat(F.lit("t"), F.col("doc_id")).alias("id"),
        F.expr(f"cast(doc_id div {fan_out} as string)").alias("from_id"),
        F.col("doc_id").cast("string").alias("to_id"),
        F.lit("child").alias("label"), F.lit(1.0).alias("weight"), F.lit("user").alias("source"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"),
    )
