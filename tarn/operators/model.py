"""Schemas and the derivation of entries from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import text as X

CHUNK = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("compact_content", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("chunks", T.ArrayType(CHUNK)),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("compact_token_count", T.IntegerType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def derive_entries(requests: DataFrame, target_tokens: int = 512, summary: Column | None = None, embed=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole entries from (id, collection, content, content_type, metadata, created_at).

    ``embed`` maps a text column to an ``array<float>`` column (an Arrow UDF);
    without it vectors are null. ``summary`` is a column, empty by default.
    Columns named in ``keep`` stay as they are.
    """
    vector = (lambda c: embed(c)) if embed else (lambda c: F.lit(None).cast("array<float>"))
    pieces = F.transform(
        X.chunks(F.col("content"), target_tokens),
        lambda t, i: F.struct(i.cast("int").alias("index"), F.col("id").alias("parent_id"), t.alias("text"), F.lit(None).cast("array<float>").alias("embedding")),
    )
    small = X.compact(F.col("content"))
    return requests.withColumn("compact_content", small).select(
        "id",
        F.coalesce("collection", F.lit("")).alias("collection"),
        "content",
        "compact_content",
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        (summary if summary is not None else F.lit("")).alias("summary"),
        pieces.alias("chunks"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        vector(F.col("content")).alias("embedding"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        X.token_estimate(F.col("content")).alias("token_count"),
        X.token_estimate(F.col("compact_content")).alias("compact_token_count"),
        *keep,
    )


def units(entries: DataFrame) -> DataFrame:
    """(unit_id, text): documents and their chunks, each a unit of full-text search."""
    piece = F.explode(F.concat(F.array(F.struct(F.col("id").alias("unit_id"), F.col("content").alias("text"))), F.transform("chunks", lambda c: F.struct(F.concat(F.col("id"), F.lit("#"), c["index"].cast("string")).alias("unit_id"), c["text"].alias("text")))))
    return entries.select(piece.alias("u")).select("u.unit_id", "u.text")


def project(entries: DataFrame, detail: str = "summary") -> DataFrame:
    """The columns of a detail level; an unknown level is ``metadata``."""
    has = F.col("compact_token_count") > 0
    cols: list = [
        "id", "collection", "content_type", "metadata", "token_count", "created_at", "updated_at",
        F.when(has, F.col("compact_token_count")).alias("compact_token_count"),
        F.when(has, F.col("token_count") - F.col("compact_token_count")).alias("tokens_saved"),
    ]
    cols += {"summary": ["summary", "compact_content"], "full": ["content", "compact_content", "summary", "chunks"]}.get(detail, [])
    return entries.select(*cols)


def project_json(entries: DataFrame, detail: str = "summary") -> DataFrame:
    """(id, json) of each entry at a detail level."""
    rows = project(entries, detail)
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json"))
