"""Readers of files: project trees as requests, and small JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def classify_path(rel, name: str):
    """(content_type, collection, dir, ext, is_test) columns of a relative path."""
    ext = F.regexp_extract(rel, "([^.]*)$", 1)
    base = F.regexp_extract(rel, "([^/]*)$", 1)
    dir_ = F.when(rel.contains("/"), F.regexp_extract(rel, "^(.*)/[^/]*$", 1)).otherwise(".")
    doc = rel.rlike("[.](?:md|ya?ml|toml|mod)$") | rel.rlike("^Dockerfile|^Makefile$|^[.]gitignore$")
    inner = F.regexp_extract(dir_, "^internal/([^/]+)", 1)
    collection = (
        F.when(inner != "", F.concat(F.lit(f"{name}/"), inner))
        .when(dir_.startswith("cmd/"), f"{name}/cmd")
        .when(dir_.startswith("ui/"), f"{name}/ui")
        .when(dir_.startswith("scripts/"), f"{name}/scripts")
        .otherwise(name)
    )
    return F.when(doc, "doc").otherwise("code"), collection, dir_, ext, base.endswith("_test.go")


def project_tree(spark: SparkSession, root: str, name: str = "project") -> DataFrame:
    """Requests (content, collection, content_type, metadata) for the files of a source tree, without dependency folders."""
    root = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("file"))
    rel = F.regexp_replace(F.regexp_extract("file", "^[a-z]+:/*(/.*)$", 1), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root) + "/", "")
    rows = files.withColumn("rel", rel).where(
        F.col("rel").rlike("[.](?:go|md|yml|yaml|toml|mod)$|(?:^|/)Dockerfile[^/]*$|(?:^|/)(?:Makefile|[.]gitignore)$")
        & ~F.col("rel").rlike("(?:^|/)(?:[.]git|vendor|node_modules|[.]cursor)/|(?:^|/)scripts/ingest")
    )
    kind, collection, dir_, ext, test = classify_path(F.col("rel"), name)
    package = F.when(ext == "go", F.regexp_extract("content", "^package (\\w+)", 1)).otherwise("")
    meta = F.create_map(
        F.lit("path"), F.col("rel"), F.lit("dir"), dir_, F.lit("ext"), ext, F.lit("package"), package, F.lit("is_test"), test.cast("string")
    )
    return rows.select("content", collection.alias("collection"), kind.alias("content_type"), meta.alias("metadata")).where("content <> ''")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON array as a table; a missing or empty file is an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).getLen() == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)
