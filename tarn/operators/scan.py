"""Reads over key-value, entry and edge tables: all of them are filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.sources.shared import cut


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def prefix(df: DataFrame, key: str, start: str) -> DataFrame:
    return df.where(F.col(key).startswith(start))


def key_range(df: DataFrame, key: str, start, end=None, limit: int | None = None) -> DataFrame:
    """Rows with start <= key < end in order; no upper bound if ``end`` is empty."""
    out = df.where(F.col(key) >= F.lit(start))
    if end not in (None, ""):
        out = out.where(F.col(key) < F.lit(end))
    out = out.orderBy(key)
    return out if limit is None else out.limit(limit)


def latest(log: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", tombstones: bool = False) -> DataFrame:
    """The newest mutation of each key, by sequence; deleted keys are left out unless asked for.

    An aggregation with map-side combine, not a sort: one row for each key and
    task is shuffled, however long its history.
    """
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("m_")).select(key, *(F.col(f"m_.{c}").alias(c) for c in rest))
    return newest if tombstones else newest.where(F.col(op) != "delete")


def newest_first(entries: DataFrame, limit: int = 100, collection: str = "") -> DataFrame:
    """List rows, newest first, ties by id; the limit is 100 if not positive and at most 10,000."""
    limit = 100 if limit <= 0 else min(limit, 10_000)
    rows = entries.where(F.col("collection") == collection) if collection else entries
    return (
        rows.select("id", "collection", "content_type", "metadata", "token_count", "compact_token_count", "created_at", "updated_at")
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def collections(entries: DataFrame) -> DataFrame:
    return entries.where("collection <> ''").select("collection").distinct().orderBy("collection")


def stats(entries: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entries, collections, vector_nodes, edges."""
    e = entries.agg(F.count("*").alias("entries"), F.countDistinct(F.when(F.col("collection") != "", F.col("collection"))).alias("collections"))
    return e.crossJoin(vectors.agg(F.count("*").alias("vector_nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))


def last_calls(calls: DataFrame, limit: int = 100, seq: str = "seq") -> DataFrame:
    """Newest first; the limit is 100 if not positive or above 500."""
    return calls.orderBy(F.desc(seq)).limit(limit if 0 < limit <= 500 else 100)


def first_by_hash(rows: DataFrame, content: str = "content", order: str = "seq") -> DataFrame:
    """The first row of each distinct content, over all collections."""
    keyed = rows.withColumn("hash_", F.sha2(F.col(content), 256))
    return keyed.groupBy("hash_").agg(F.min_by(F.struct(*rows.columns), order).alias("r_")).select("r_.*")


def last_of_each(calls: DataFrame, most: int, key: str = "channel", seq: str = "seq") -> DataFrame:
    """(key, seq): the newest ``most`` of each key, as a bounded ring of calls holds them."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return calls.select(key, seq).withColumn("nth_", nth).where(F.col("nth_") <= most).drop("nth_")


def file_range(spark: SparkSession, path: str, name: str, key: str, start, end=None) -> DataFrame:
    """The rows start <= key < end, in order, of those of a table's files whose name holds ``name``."""
    return key_range(spark.read.option("pathGlobFilter", f"*{name}*").parquet(path), key, start, end)


def latency_report(calls: DataFrame, ms: str = "ms", ok: str = "ok", wall_seconds: float | None = None) -> DataFrame:
    """requested, ok, errors, p50, p95, p99 and operations per second of one phase.

    A percentile is the value at round((n - 1) * p) of the sorted values, halves
    rounded up, and 0 if there is none. The ranks are looked up in a range sort
    of the values, so no task holds them all.
    """
    good = calls.where(F.col(ok))
    n = good.count()
    wanted = {name: int((n - 1) * p + 0.5) for name, p in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))}
    report = calls.agg(F.count("*").alias("requested"), F.count_if(F.col(ok)).alias("ok"), F.count_if(~F.col(ok)).alias("errors"))
    # the values, counted, in one order over all partitions; a rank is of the value whose run of places holds it
    runs = running(good.groupBy(F.col(ms).cast("double").alias("v")).agg(F.count("*").alias("c_")), [F.asc("v")], F.col("c_"))
    runs = runs.select("v", "before_", (F.col("before_") + F.col("c_")).alias("after_")).where(" OR ".join(f"(before_ <= {r} AND {r} < after_)" for r in sorted(set(wanted.values()))))
    holds = lambda r: (F.col("before_") <= r) & (F.lit(r) < F.col("after_"))
    picks = runs.agg(*(F.coalesce(F.max(F.when(holds(r), F.col("v"))), F.lit(0.0)).alias(name) for name, r in wanted.items()))
    out = report.crossJoin(picks)
    if wall_seconds is None:
        total = calls.agg((F.sum(ms) / 1000).alias("wall_s"))
        return out.crossJoin(total).withColumn("ops_per_sec", F.when(F.col("wall_s") > 0, F.col("ok") / F.col("wall_s")).otherwise(0.0))
    return out.withColumn("wall_s", F.lit(wall_seconds)).withColumn("ops_per_sec", F.col("ok") / F.col("wall_s"))


def running(rows: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """Rows with ``before_``, the sum of the weights of all rows before them in an order without ties.

    The order is a range sort. Sums by partition, as many rows as there are
    partitions, are added up first; then each partition is summed by itself.
    """
    parts = cut(rows.repartitionByRange(*order).withColumns({"p_": F.spark_partition_id(), "w_": weight.cast("long")}))
    upto = F.sum("w_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy("p_").agg(F.sum("w_").alias("w_")).select("p_", F.coalesce(upto, F.lit(0)).alias("start_"))
    within = F.sum("w_").over(Window.partitionBy("p_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(F.broadcast(starts), "p_").withColumn("before_", F.col("start_") + F.coalesce(within, F.lit(0))).drop("p_", "w_", "start_")
