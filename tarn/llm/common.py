"""Shared plumbing: inputs, checkpoints, bounded broadcasts and components."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.shared import shared_dir


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master gets one of its own."""
    shared_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``df``, materialised, and marked for broadcast only if its values take at most about ``most`` bytes."""
    df = cut(df)
    width = sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 32 if f.dataType.simpleString() == "string" else F.lit(16) for f in df.schema.fields), F.lit(32))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def any_of(words) -> str:
    """A pattern of plain words that shares their beginnings, so that few branches are tried at each place."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[0], []).append(w[1:])
    branches = []
    for first, rest in by_first.items():
        more = any_of(r for r in rest if r)
        plain = first if first.isalnum() or first == " " else "\\" + first
        branches.append(plain + (f"(?:{more})" if "|" in more else more) if all(rest) else plain + (f"(?:{more})?" if more else ""))
    return "|".join(branches)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def list_array(flat: pa.Array, counts) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the
    edge list never grows, each round is two shuffles of it, and long chains
    halve. ``root`` is the least node of the component. Self-loops and null
    ends are ignored. Lineage is cut at a checkpoint each round. A hub's least
    neighbour is found by an aggregation, combined before the shuffle, and
    joined back, so that a hub's edges need not pass through one task.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
