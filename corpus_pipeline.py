"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage takes rows with nulls in any column, empty and very long texts and
repeated rows, keeps all columns, clashing names included, and gives an empty
table for an empty one. Null and blank texts end at the first stage. What a
stage has written is deleted once the next has been.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import encode_documents
from tarn.llm.common import ensure_checkpoint_dir, table
from tarn.llm.mixing import mix
from tarn.llm.minhash import drop_near_duplicates
from tarn.llm.nbsvm import fit, keep_good
from tarn.llm.pii import sanitise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null and blank texts among them; every row is judged by its text alone."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id; rows without an id and wordless texts stay too."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mentions are masked and disclosing terms generalised or removed; every row stays, and ``n_chars`` follows the text."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document of a later epoch is a row of its own. Rows without a source, id or token go."""
    return mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row; a null text has nulls."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing to weights", mixing),
    ("BPE encoding", tokens),
]

#: SQL can express neither the classifier nor the sketches; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage returns is written to the shared folder and reread.

    An empty table, or one of which nothing is kept, gives no rows.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
