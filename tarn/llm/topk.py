"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are grouped into shards around pivots. A shard keeps, for each
dimension, the list of its rows sorted by value. A query reads the lists in
parallel, from the top where its weight is positive and from the bottom where
it is negative, scores each row it meets, and stops when the threshold, the
score of an imagined row made of the last values read, cannot reach its k-th
best score. Lists are read on in steps that double; as the k-th best score
can only rise, the depth at which the present one would stop the search is
found beforehand by binary search of the thresholds, and no step goes beyond it.

Each query first searches the shard of its own pivot. The k-th score it finds there
is its bound from the start in all other shards, and it is sent to those only
whose threshold at depth 0 reaches that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut

DIGITS = 6
EPS = 10.0**-DIGITS
#: Rows of each list that the first step reads, and the most pivots, which bounds what goes to the driver and with tasks.
FIRST_STEP, MOST_PIVOTS = 32, 256


class Shard:
    """Rows with their sorted per-dimension lists; ``depths`` and ``met`` tell what the last search read."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.lists, axis=0)
        self.depths: list[int] = []
        self.met: list[int] = []

    def threshold(self, q: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The bound on the scores of rows not met after ``depth`` rows of each list, ``depth`` being less than all."""
        depth = np.broadcast_to(np.asarray(depth), len(q))
        return (np.maximum(q, 0) * self.values[len(self.ids) - 1 - depth]).sum(1) + (np.minimum(q, 0) * self.values[depth]).sum(1)

    def enough(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The least depth at which no row not met can reach ``score``, by binary search; all rows if there is none."""
        low, high = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(self.ids), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            stops = score[open_] > self.threshold(q[open_], mid) + EPS
            high[open_] = np.where(stops, mid, high[open_])
            low[open_] = np.where(stops, low[open_], mid + 1)
        return low

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of rows among each query's best ``k`` that reach its floor; a row is no result of its own."""
        out: list[tuple] = []
        n = len(self.ids)
        limit = self.enough(q, floor)
        self.depths, self.met = [], []
        for i in np.flatnonzero(limit > 0):
            up, down = np.flatnonzero(q[i] > 0), np.flatnonzero(q[i] < 0)
            seen = np.zeros(n, dtype=bool)
            seen[self.ids == own[i]] = True
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            done, depth = 0, min(FIRST_STEP, int(limit[i]))
            while True:
                fresh = np.zeros(n, dtype=bool)
                fresh[self.lists[n - depth : n - done, up].ravel()] = True
                fresh[self.lists[done:depth, down].ravel()] = True
                fresh &= ~seen
                seen |= fresh
                new = np.flatnonzero(fresh)
                rows, scores = np.r_[rows, new], np.r_[scores, np.round(self.x[new] @ q[i], DIGITS)]
                if len(rows) > k:
                    best = np.lexsort((rows, -scores))[:k]  # rows are in order of id
                    rows, scores = rows[best], scores[best]
                kth = max(scores.min() if len(rows) == k else -np.inf, floor[i])
                done = depth
                stop = min(int(limit[i]), int(self.enough(q[i : i + 1], np.array([kth]))[0]))
                if done >= stop:
                    break
                depth = min(2 * done, stop)
            self.depths.append(done)
            self.met.append(int(seen.sum()))
            keep = scores >= floor[i]
            out.append((np.full(int(keep.sum()), i), self.ids[rows[keep]], scores[keep]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _assigning(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = np.argmax(_matrix(batch.column(1), pivots.shape[1]) @ pivots.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["id", "v", "asks", "pivot"])

    return run


HITS = "q long, id long, score double"


def _searching(width: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, own = _matrix(queries["v"], width), queries["q"].to_numpy()
        r, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(rows) and len(queries):
            r, ids, score = Shard(_matrix(rows["v"], width), rows["id"].to_numpy()).search(q, own, queries["floor"].to_numpy(), k)
        return pa.table({"q": pa.array(own[r], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _sending(names: np.ndarray, high: np.ndarray, low: np.ndarray, shards: np.ndarray, own: bool):
    """Queries to the shards of their own pivot, or of every other pivot whose threshold at depth 0 reaches their floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column(1), high.shape[1])
            floor = batch.column(3).to_numpy(zero_copy_only=False)
            mine = names[None, :] == batch.column(2).to_numpy()[:, None]
            go = mine if own else (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T >= floor[:, None] - EPS) & ~mine
            r, c = np.nonzero(go)
            n = shards[c]
            r, c, part = np.repeat(r, n), np.repeat(c, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[c]), pa.array(part.astype(np.int32)), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(floor[r])],
                ["pivot", "part", "q", "v", "floor"],
            )

    return run


def top_k(
    vectors: DataFrame, k: int = 10, asking: str = "vec_id % 100 = 0", shard_rows: int = 8192, block_queries: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): the ``k`` rows of greatest cosine for every row that asks, exactly.

    ``asking`` is a condition on the row's columns that says which are queries;
    all rows are searched. Scores are rounded to six digits and ties go to the
    lesser id; a row is not its own neighbour. Rows whose id or vector is null,
    whose vector has a null or a value that is not finite, no direction, or not
    the commonest width (the greater of two as common) are neither queries nor
    results. Of rows that share an id the vector that sorts first counts, and
    it asks if any of them does. With fewer than ``k`` others, a row has all of
    them; an empty table gives no rows.

    A shard has about ``shard_rows`` rows, however many share a pivot, and
    meets about ``block_queries`` queries at a time.
    """
    asks = F.coalesce(F.expr(asking), F.lit(False)) if asking else F.lit(True)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks.alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150)")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"), "asks")
    rows = cut(rows)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if widths is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("score")).limit(0)
    width, n = int(widths["w"]), int(widths["count"])
    rows = rows.where(F.size("v") == width)
    # pivots: a sample whose size is bounded
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-n // shard_rows) * 2)).select("v").collect()
    near = cut(rows.mapInArrow(_assigning(np.array([r["v"] for r in some])), "id long, v array<double>, asks boolean, pivot int"))
    # a row for each pivot, with the greatest and least value of each dimension: at most MOST_PIVOTS * width
    ends = near.select("pivot", F.posexplode("v").alias("i", "x")).groupBy("pivot", "i").agg(F.max("x").alias("high"), F.min("x").alias("low"), F.count("*").alias("n")).orderBy("pivot", "i").toPandas()
    names = ends["pivot"].to_numpy(np.int32)[::width]
    high, low = (ends[c].to_numpy(float).reshape(-1, width) for c in ("high", "low"))
    shards = -(-ends["n"].to_numpy(np.int64)[::width] // shard_rows)
    split = F.create_map(*(F.lit(int(x)) for p in zip(names, shards) for x in p))
    blocks = max(1, -(-near.where("asks").count() // block_queries))
    of_query = F.pmod(F.xxhash64(F.lit(1), "q"), F.lit(blocks)).cast("int")
    copies = near.select("pivot", F.pmod(F.xxhash64("id"), split[F.col("pivot")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")

    def found(queries: DataFrame, own: bool) -> DataFrame:
        sent = queries.mapInArrow(_sending(names, high, low, shards, own), "pivot int, part int, q long, v array<double>, floor double").withColumn("block", of_query)
        return sent.groupBy("pivot", "part", "block").cogroup(copies.groupBy("pivot", "part", "block")).applyInArrow(_searching(width, k), HITS)

    def best(hits: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        return hits.withColumn("rank", nth).where(F.col("rank") <= k)

    asked = near.where("asks").select("id", "v", "pivot")
    first = cut(best(found(asked.withColumn("floor", F.lit(float("-inf"))), True)))
    floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    again = asked.join(floor, asked["id"] == floor["q"], "left").select("id", "v", "pivot", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return best(first.drop("rank").unionByName(found(again, False))).select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "score")


ORACLE_SQL = """
WITH s AS (
  SELECT q.vec_id, x.vec_id AS neighbour_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, neighbour_id, score FROM r WHERE rank <= 10
"""
