"""Stored full-text postings: a Parquet table by term, from which a query reads its own terms alone."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import rank

BUCKETS = 64
SCHEMA = "term string, unit_id string, tf bigint, dl int, bucket int"


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def write_postings(units: DataFrame, path: str, repeats: bool | None = None) -> None:
    """Postings of (unit_id, text), in a folder for each bucket of terms and in order of term and unit.

    One shuffle: by bucket and, so that no task has a frequent term alone, by shares of
    the units within it. Sorted files let the scan skip all row groups that don't hold a query's terms.
    ``repeats`` tells whether unit ids stand on several rows, if that is known.
    """
    rows = rank.postings(units, repeats).select("term", "unit_id", "tf", "dl", "starts", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int").alias("bucket"))
    shares = -(-2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(shares)))
    rows.sortWithinPartitions("bucket", "term", "unit_id").write.partitionBy("bucket").parquet(path)


def measure(units: DataFrame) -> tuple[int, int]:
    """(units that have terms, terms in all of them)."""
    got = units.select(F.size(X.terms(F.col("text"))).alias("dl")).where("dl > 0").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return int(got[0]), int(got[1])


def measured(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """What ``measure`` gives of the units whose postings are stored under ``paths``; no text is read."""
    n = terms = 0
    for path in paths:
        got = spark.read.schema("tf bigint, starts int").parquet(path).agg(F.coalesce(F.sum("starts"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
        n, terms = n + int(got[0]), terms + int(got[1])
    return n, terms


class Postings:
    """The postings under some folders, less those of documents that are ``dead`` (id), with the size of the collection."""

    def __init__(self, spark: SparkSession, paths: list[str], units: int, terms: int, dead: DataFrame | None = None):
        self.spark, self.paths, self.units, self.terms, self.dead = spark, paths, units, terms, dead

    def stats(self) -> tuple[int, float]:
        return self.units, self.terms / self.units if self.units else 1.0

    def lengths(self) -> DataFrame:
        """(unit_id, dl, starts): a row for each unit that has terms; ``starts`` is 1."""
        return self._live("unit_id string, dl int, starts int", lambda rows: rows.where("starts > 0"))

    def all(self) -> DataFrame:
        return self._live(SCHEMA)

    def _live(self, schema: str, some=lambda rows: rows) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], schema)
        # each batch has bucket folders of its own, so it is a scan of its own
        rows = some(reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(path) for path in self.paths]))
        if self.dead is not None:
            rows = rows.withColumn("doc_", X.document_of(F.col("unit_id"))).join(self.dead.select(F.col("id").alias("doc_")), "doc_", "left_anti").drop("doc_")
        return rows

    def postings(self, terms: list[str]) -> DataFrame:
        if not terms:
            return self.all().where("false").drop("bucket")
        return self.all().where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms)).drop("bucket")
