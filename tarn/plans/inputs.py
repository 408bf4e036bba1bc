"""The driver tables as entries, units, edges and vectors, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import graph, model

BASE_S = 1_700_000_000
NO_MAP = "map<string,string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark, sf_dir, content=None) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.coalesce("source", F.lit("")).alias("collection"),
        (content(F.col("text")) if content else F.col("text")).alias("content"),
        F.lit("doc").alias("content_type"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
        F.timestamp_seconds(F.lit(BASE_S) + F.col("doc_id")).alias("created_at"),
    )


def entries(spark, sf_dir, target: int = 512, content=None) -> DataFrame:
    return model.derive_entries(requests(spark, sf_dir, content), target)


def light_entries(spark, sf_dir) -> DataFrame:
    """Entries without what only derivation gives: nothing but scanned columns and token counts."""
    return requests(spark, sf_dir).select("*", F.lit("").alias("summary"), X.token_estimate(F.col("content")).alias("token_count"))


def paragraphs(c):
    return F.replace(c, F.lit("\n"), F.lit("\n\n"))


NOISE_HEAD = "Please note that the  information\tflow function database  message request.\n---\n\n\n\n"
NOISE_TAIL = "\n***\nactually, in order to... which is fine " + "in Order " * 6 + "to " * 6 + "please noin order to te that end"


def noisy(c):
    body = F.replace(F.replace(c, F.lit("\n"), F.lit("\n\n\n\n==== \n\n")), F.lit(" the "), F.lit(" the   context memory "))
    return F.concat(F.lit(NOISE_HEAD), body, F.lit(NOISE_TAIL))


def doc_units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "text")


def paragraph_units(spark, sf_dir) -> DataFrame:
    """Documents and their chunks of 64 tokens, paragraphs being lines."""
    r = requests(spark, sf_dir, paragraphs)
    return model.units(r.withColumn("chunks", F.transform(X.chunks(F.col("content"), 64), lambda t, i: F.struct(i.cast("int").alias("index"), t.alias("text")))))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), "embedding")


def edges(spark, sf_dir) -> DataFrame:
    """The document tree, conversation turns, and a small cyclic graph."""
    tree = graph.tree_edges(spark, table(spark, sf_dir, "documents"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    node = lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), t)
    follows = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).distinct()
    turns = follows.select(
        F.concat(F.lit("n"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("id"), node(F.col("turn")).alias("from_id"), node(F.col("turn") + 1).alias("to_id"),
        F.lit("next").alias("label"), F.lit(0.5).alias("weight"), F.lit("user").alias("source"),
        F.create_map().cast(NO_MAP).alias("metadata"), F.timestamp_seconds(F.lit(BASE_S)).alias("created_at"),
    )
    toy = spark.createDataFrame([(f"y{i}", a, b) for i, (a, b) in enumerate(["ab", "bc", "ca", "aa", "ac"])], "id string, from_id string, to_id string").select(
        "*", F.lit("depends_on").alias("label"), F.lit(0.5).alias("weight"), F.lit("auto").alias("source"),
        F.create_map().cast(NO_MAP).alias("metadata"), F.timestamp_seconds(F.lit(BASE_S)).alias("created_at"),
    )
    return tree.unionByName(turns).unionByName(toy)


def mutation_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


# DuckDB

S_DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS collection, text AS content, lang, source, to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC' AS created_at FROM documents)"
S_DOC_UNITS = "units AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text FROM documents)"
S_EDGES = """edges AS (
  SELECT 't' || doc_id AS id, CAST(doc_id // 3 AS VARCHAR) AS from_id, CAST(doc_id AS VARCHAR) AS to_id, 'child' AS label, 1.0::DOUBLE AS weight, 'user' AS source,
         to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC' AS created_at FROM documents WHERE doc_id > 0
  UNION ALL SELECT DISTINCT 'n' || a.conv_id || '.' || a.turn, 'c' || a.conv_id || '.' || a.turn, 'c' || a.conv_id || '.' || (a.turn + 1), 'next', 0.5, 'user',
         to_timestamp(1700000000) AT TIME ZONE 'UTC' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL SELECT 'y' || i, f, t, 'depends_on', 0.5, 'auto', to_timestamp(1700000000) AT TIME ZONE 'UTC'
         FROM (VALUES (0, 'a', 'b'), (1, 'b', 'c'), (2, 'c', 'a'), (3, 'a', 'a'), (4, 'a', 'c')) v(i, f, t))"""


def s_tokens(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE greatest(1, CAST(strlen({c}) // 4 AS INTEGER)) END"


def _q(s: str) -> str:
    return s.replace("'", "''")


def s_fillers(c: str) -> str:
    """Each phrase in turn, seven times over, which is as deep as the inputs nest it."""
    phrases = ", ".join(f"'{_q(p)} '" for p in X.FILLERS for _ in range(7))
    return f"list_reduce([{phrases}], lambda a, p: CASE WHEN contains(lower(a), p) THEN regexp_replace(a, regexp_escape(p), '', 'gi') ELSE a END, {c})"


def s_abbreviate(c: str) -> str:
    pattern = " (" + "|".join(sorted(X.SHORT_FORMS, key=len, reverse=True)) + ") "
    out = f"regexp_replace(' ' || {c} || ' ', '{pattern}', chr(1) || '\\1' || chr(2), 'g')"
    for long, short in X.SHORT_FORMS.items():
        out = f"replace({out}, chr(1) || '{long}' || chr(2), ' {short} ')"
    return f"regexp_replace({out}, '^ | $', '', 'g')"


def s_blanks(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def s_decoration(c: str) -> str:
    return f"replace(regexp_replace({c}, '(?m)^[-=*]{{3,}}\\s*$', '', 'g'), '...', chr(8230))"


def s_trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def s_compact(source: str, text: str) -> str:
    """CTE ``compacted`` (all columns of ``source`` and compact_content)."""
    return (
        f"k1 AS (SELECT *, {s_fillers(text)} AS k FROM {source}), k2 AS (SELECT * REPLACE ({s_abbreviate('k')} AS k) FROM k1), "
        f"k3 AS (SELECT * REPLACE ({s_trim(s_decoration(s_blanks('k')))} AS k) FROM k2), "
        f"compacted AS (SELECT * EXCLUDE (k), CASE WHEN k = '' THEN {text} ELSE k END AS compact_content FROM k3)"
    )


def s_noisy(c: str) -> str:
    head = _q(NOISE_HEAD).replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '")
    tail = _q(NOISE_TAIL).replace("\n", "' || chr(10) || '")
    nl = "chr(10)"
    rule = " || ".join([nl] * 4 + ["'==== '", nl, nl])
    return f"'{head}' || replace(replace({c}, {nl}, {rule}), ' the ', ' the   context memory ') || '{tail}'"


def s_chunks(c: str, target: int, overlap: int = 200) -> str:
    """A list of chunk texts."""
    limit = 4 * target
    trim = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
    emit_buf = lambda b: f"CASE WHEN {trim(b)} = '' THEN {b} ELSE '' END"
    emit_out = lambda b, o: f"CASE WHEN {trim(b)} = '' THEN {o} ELSE list_append({o}, {trim(b)}) END"
    full = f"(a.buf <> '' AND strlen(a.buf) + strlen(x.buf) > {limit})"
    buf = f"(CASE WHEN {full} THEN {emit_buf('a.buf')} ELSE a.buf END)"
    out = f"(CASE WHEN {full} THEN {emit_out('a.buf', 'a.out')} ELSE a.out END)"
    joined = f"({buf} || chr(10) || chr(10) || x.buf)"
    chars = f"list_max(list_filter(range(0, {overlap + 1}), lambda n: strlen(right(x.buf, n)) <= {overlap}))"
    tail = f"(CASE WHEN strlen(x.buf) > {overlap} THEN repeat(chr(65533), {overlap} - strlen(right(x.buf, {chars}))) || right(x.buf, {chars}) ELSE '' END)"
    step = (
        f"CASE WHEN {buf} = '' THEN {{buf: x.buf, out: {out}}} "
        f"WHEN strlen({joined}) >= {limit} THEN {{buf: {emit_buf(joined)} || {tail}, out: {emit_out(joined, out)}}} "
        f"ELSE {{buf: {joined}, out: {out}}} END"
    )
    parts = f"list_transform(string_split({c}, chr(10) || chr(10)), lambda p: {{buf: p, out: CAST([] AS VARCHAR[])}})"
    fold = f"list_reduce({parts}, lambda a, x: {step})"
    last = emit_out("f.buf", "f.out")
    return f"list_transform([{fold}], lambda f: {last})[1]"
