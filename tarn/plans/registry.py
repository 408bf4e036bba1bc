"""Every registered query of the library and its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import access
from tarn.functions import text as X
from tarn.functions import vector as V
from tarn.operators import graph, model, rank, scan, search
from tarn.plans import inputs as I
from tarn.plans import streams
from tarn.sources import files
from tarn.sources.index import Postings, measured, write_postings
from tarn.sources.shared import shared_dir
from tarn.sources.store import ContextStore

QUERIES: dict = {}
ORACLES: dict = {}
WORDS = "the of and"
TERMS = "[\\p{L}\\p{N}]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return I.table(spark, d, "documents")


def _id(name="doc_id"):
    return F.col(name).cast("string").alias("id")


# scans

@query(f"WITH {I.S_DOCS} SELECT id, collection, content FROM d WHERE id = '42'")
def scan_point(spark, d):
    return scan.point(_docs(spark, d), "doc_id", 42).select(_id(), F.coalesce("source", F.lit("")).alias("collection"), F.col("text").alias("content"))


@query(f"WITH {I.S_DOCS} SELECT id, collection FROM d WHERE starts_with(id, '12')")
def scan_prefix(spark, d):
    return scan.prefix(I.requests(spark, d), "id", "12").select("id", "collection")


@query("SELECT event_id, user_id, value FROM events WHERE event_id >= 100 AND event_id < 200 ORDER BY event_id")
def scan_range(spark, d):
    return scan.key_range(I.table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 100, 200)


@query(f"WITH {I.S_DOCS} SELECT id, collection, {I.s_tokens('content')} AS token_count FROM d")
def scan_full(spark, d):
    return I.light_entries(spark, d).select("id", "collection", "token_count")


@query("SELECT event_id, user_id, value FROM events WHERE event_id >= 9000 ORDER BY event_id LIMIT 25")
def scan_range_open(spark, d):
    return scan.key_range(I.table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 9000, "", 25)


@query("SELECT event_id, user_id FROM events WHERE event_id >= 300 AND event_id < 320 ORDER BY event_id")
def scan_file(spark, d):
    return scan.file_range(spark, f"{d}/events.parquet", ".parquet", "event_id", 300, 320).select("event_id", "user_id")


@query(f"WITH {I.S_DOCS}, w AS (SELECT * FROM d WHERE id = '42'), {I.s_compact('w', 'content')} SELECT id, collection, '' AS summary, compact_content, {I.s_tokens('content')} AS token_count FROM compacted")
def scan_entry(spark, d):
    e = model.derive_entries(scan.point(I.requests(spark, d), "id", "42"))
    return model.project(e, "summary").select("id", "collection", "summary", "compact_content", "token_count")


@query(f"WITH {I.S_EDGES} SELECT id, from_id, to_id, label, weight FROM edges WHERE id = 't17'")
def scan_edge(spark, d):
    return scan.point(I.edges(spark, d), "id", "t17").select("id", "from_id", "to_id", "label", "weight")


# text scalars

@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(regexp_extract_all(lower(text), '{TERMS}'), ' ') AS terms FROM documents")
def tok_terms(spark, d):
    return _docs(spark, d).select(_id(), F.array_join(X.terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), '{TERMS}')) AS term FROM documents) GROUP BY ALL")
def tok_counts(spark, d):
    return rank.postings(I.doc_units(spark, d)).select(F.col("unit_id").alias("id"), "term", "tf")


@query(f"SELECT term, count(DISTINCT id) AS df FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{TERMS}')) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    return rank.postings(I.doc_units(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {I.s_tokens('text')} AS token_count FROM documents")
def text_token_estimate(spark, d):
    return _docs(spark, d).select(_id(), X.token_estimate(F.col("text")).alias("token_count"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS hash FROM documents")
def text_sha256(spark, d):
    return _docs(spark, d).select(_id(), X.content_hash(F.col("text")).alias("hash"))


_NOISY = f"n AS (SELECT CAST(doc_id AS VARCHAR) AS id, {I.s_noisy('text')} AS t FROM documents)"


def _noisy(spark, d, f):
    return _docs(spark, d).select(_id(), f(I.noisy(F.col("text"))).alias("out"))


@query(f"WITH {_NOISY} SELECT id, {I.s_blanks('t')} AS out FROM n")
def text_collapse_ws(spark, d):
    return _noisy(spark, d, X.collapse_blanks)


@query(f"WITH {_NOISY} SELECT id, {I.s_decoration('t')} AS out FROM n")
def text_decorative(spark, d):
    return _noisy(spark, d, X.strip_decoration)


@query(f"WITH {_NOISY} SELECT id, {I.s_fillers('t')} AS out FROM n")
def text_filler(spark, d):
    return _noisy(spark, d, X.strip_fillers)


@query(f"WITH {_NOISY} SELECT id, {I.s_abbreviate('t')} AS out FROM n")
def text_abbrev(spark, d):
    return _noisy(spark, d, X.abbreviate)


@query(f"WITH {_NOISY}, {I.s_compact('n', 't')} SELECT id, compact_content AS out, {I.s_tokens('compact_content')} AS compact_token_count FROM compacted")
def text_compact(spark, d):
    return _noisy(spark, d, X.compact).withColumn("compact_token_count", X.token_estimate(F.col("out")))


_PARAS = f"pc AS (SELECT CAST(doc_id AS VARCHAR) AS id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents), cl AS (SELECT id, content, {I.s_chunks('content', 64)} AS cs FROM pc)"


def _chunked(spark, d):
    return I.requests(spark, d, I.paragraphs).select("id", "content", X.chunks(F.col("content"), 64).alias("cs"))


@query(f"WITH {_PARAS} SELECT id, CAST(unnest(range(len(cs))) AS INTEGER) AS idx, unnest(cs) AS text FROM cl")
def chunk_docs(spark, d):
    return _chunked(spark, d).select("id", F.posexplode("cs").alias("idx", "text"))


@query(f"WITH {_PARAS} SELECT id, CAST(len(cs) AS INTEGER) AS n_chunks FROM cl")
def chunk_counts(spark, d):
    return _chunked(spark, d).select("id", F.size("cs").alias("n_chunks"))


_UNITS = f"{_PARAS}, units AS (SELECT id AS unit_id, content AS text FROM cl UNION ALL SELECT id || '#' || unnest(range(len(cs))), unnest(cs) FROM cl)"


@query(f"WITH {_UNITS} SELECT unit_id, sha256(text) AS hash FROM units")
def units(spark, d):
    return I.paragraph_units(spark, d).select("unit_id", F.sha2("text", 256).alias("hash"))


# full text


def s_bm25(words: str, unit_cte: str = I.S_DOC_UNITS, name: str = "bm", where: str = "") -> str:
    terms = words.lower().split()
    times = {t: terms.count(t) for t in terms}
    rows = ", ".join(f"('{t}', {n})" for t, n in times.items())
    head = f"{unit_cte}, " if unit_cte else ""
    return f"""{head}{name}_q(term, times) AS (VALUES {rows}),
{name}_t AS (SELECT unit_id, regexp_extract_all(lower(text), '{TERMS}') AS ts FROM units {where}),
{name}_l AS (SELECT unit_id, ts, len(ts) AS dl FROM {name}_t WHERE len(ts) > 0),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_p AS (SELECT unit_id, dl, term, count(*) AS tf FROM (SELECT unit_id, dl, unnest(ts) AS term FROM {name}_l) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_d AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {name}_p, {name}_s GROUP BY term, n),
{name} AS (SELECT unit_id AS id, round(sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_p JOIN {name}_d USING (term) JOIN {name}_q USING (term), {name}_s GROUP BY unit_id)"""


@query(f"WITH {s_bm25(WORDS)} SELECT term, round(idf, 6) AS idf FROM bm_d")
def bm25_idf(spark, d):
    u = I.doc_units(spark, d)
    df = rank.postings(u).where(F.col("term").isin(*WORDS.split())).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(rank.corpus_stats(rank.lengths(u))).select("term", F.round(rank.idf(F.col("n_units"), F.col("df")), 6).alias("idf"))


@query(f"WITH {s_bm25(WORDS)} SELECT n AS n_units, round(avgdl, 6) AS avgdl FROM bm_s")
def bm25_avgdl(spark, d):
    return rank.corpus_stats(rank.lengths(I.doc_units(spark, d))).select("n_units", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {s_bm25('the')} SELECT id, score FROM bm")
def bm25_term(spark, d):
    return rank.bm25(I.doc_units(spark, d), "the", 0)


@query(f"WITH {I.S_DOCS}, {s_bm25(WORDS)}, h AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 10) "
       f"SELECT h.id, score, collection, 'doc' AS content_type, lang, {I.s_tokens('content')} AS token_count FROM h JOIN d USING (id)")
def bm25_top10(spark, d):
    hits = rank.bm25(I.doc_units(spark, d), WORDS, 10)
    rows = I.light_entries(spark, d)
    return F.broadcast(hits).join(rows, "id").select("id", "score", "collection", "content_type", F.col("metadata")["lang"].alias("lang"), "token_count").orderBy(F.desc("score"), "id")


@query(f"WITH {s_bm25(WORDS)} SELECT id, score FROM bm")
def bm25_all(spark, d):
    return rank.bm25(I.doc_units(spark, d), WORDS, 0)


@query(f"WITH {s_bm25(WORDS, _UNITS)} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_units(spark, d):
    return rank.bm25(I.paragraph_units(spark, d), WORDS, 20)


@query(f"WITH {s_bm25('the the of')} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_dup_terms(spark, d):
    return rank.bm25(I.doc_units(spark, d), "the, The OF", 10)


_indexes: dict = {}


def _index(spark, d) -> Postings:
    """Postings of the documents, stored when first asked for in a session and read from then on, as after a put."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    f = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = spark.sparkContext.applicationId, f.getPath().toString(), f.getModificationTime(), f.getLen()
    if key not in _indexes or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(_indexes[key][0])):
        path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        write_postings(I.doc_units(spark, d), path)
        _indexes[key] = path, measured(spark, [path])
    path, size = _indexes[key]
    return Postings(spark, [path], *size)


@query(f"WITH {s_bm25(WORDS)} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_stored_postings(spark, d):
    return rank.bm25(None, WORDS, 10, _index(spark, d))


# filters

@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'fr'")
def meta_match_one(spark, d):
    return rank.matching(I.requests(spark, d), {" LANG ": "fr "})


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en' AND source = 'src3'")
def meta_match_and(spark, d):
    return rank.matching(I.requests(spark, d), {"lang": "en", "source": "src3"})


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'rust'")
def meta_none(spark, d):
    return rank.matching(I.requests(spark, d), {"lang": "rust"})


@query("SELECT CAST(d.doc_id AS VARCHAR) AS id FROM documents d JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1 AND toxic = 0")
def meta_labels(spark, d):
    r = I.requests(spark, d).join(I.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic"), "id")
    more = F.map_concat("metadata", F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")))
    return rank.matching(r.withColumn("metadata", more), {"lang": "en", "quality": "1", "toxic": "0"})


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src5'")
def collection_filter(spark, d):
    return I.requests(spark, d).where("collection = 'src5'").select("id")


@query(f"WITH {s_bm25(WORDS)} SELECT id, score FROM bm WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'es')")
def allow_exact(spark, d):
    return rank.allowed(rank.bm25(I.doc_units(spark, d), WORDS, 0), rank.matching(I.requests(spark, d), {"lang": "es"}), exact=True)


# vectors

S_KNN = """knn AS (SELECT CAST(x.vec_id AS VARCHAR) AS id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS raw
  FROM embeddings x, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY raw DESC, id LIMIT {k})"""


def _q7(spark, d):
    return I.table(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("q"))


@query(f"WITH {S_KNN.format(k=10)} SELECT id, greatest(raw, 0) AS score FROM knn")
def knn_top10(spark, d):
    return rank.knn(I.vectors(spark, d), _q7(spark, d), 10)


S_PAIRS = """SELECT CAST(a.vec_id AS VARCHAR) AS a, CAST(b.vec_id AS VARCHAR) AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score
FROM embeddings a JOIN embeddings b ON CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR)"""


@query(S_PAIRS)
def cosine_pairs(spark, d):
    """Every pair of the table; ``tests/test_rank.py`` holds it against brute force too."""
    return rank.near_duplicate_pairs(I.vectors(spark, d), -2.0)


@query(f"SELECT * FROM ({S_PAIRS}) WHERE score >= 0.9")
def near_dup_pairs(spark, d):
    return rank.near_duplicate_pairs(I.vectors(spark, d), 0.9)


@query(f"SELECT * FROM ({S_PAIRS}) WHERE score >= 0.35")
def near_dup_pairs_loose(spark, d):
    return rank.near_duplicate_pairs(I.vectors(spark, d), 0.35)


@query(f"WITH {S_KNN.format(k=100)} SELECT id, raw AS score FROM knn WHERE raw >= 0.2 AND id <> '7'")
def link_threshold(spark, d):
    return rank.knn(I.vectors(spark, d), _q7(spark, d), 100).where("score >= 0.2 AND id <> '7'")


# fusion and hybrid search


def s_ranked(name: str, rows: str, score: str = "score") -> str:
    return f"{name} AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY {score} DESC, id)) AS part FROM {rows})"


def s_fused(*names: str, k: int = 0) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"fused AS (SELECT id, round(sum(part), 9) AS score FROM ({rows}) GROUP BY id ORDER BY score DESC, id{f' LIMIT {k}' if k else ''})"


_BM20 = f"{s_bm25(WORDS)}, b20 AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 20)"


@query(f"WITH {_BM20}, {S_KNN.format(k=20)}, {s_ranked('r1', 'b20')}, {s_ranked('r2', 'knn', 'raw')}, {s_fused('r1', 'r2')} SELECT * FROM fused")
def rrf_two(spark, d):
    return rank.fuse([rank.bm25(I.doc_units(spark, d), WORDS, 20), rank.knn(I.vectors(spark, d), _q7(spark, d), 20, clamp=False)])


def s_near(start: str, depth: int) -> str:
    return f"""links AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges),
walk AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN links ON a = id WHERE depth < {depth}),
near AS (SELECT id, round(1.0::DOUBLE / (1 + min(depth)), 6) AS score FROM walk GROUP BY id HAVING min(depth) > 0)"""


@query(f"WITH RECURSIVE {_BM20}, {S_KNN.format(k=20)}, {I.S_EDGES}, {s_near('7', 3)}, {s_ranked('r1', 'b20')}, {s_ranked('r2', 'knn', 'raw')}, {s_ranked('r3', 'near')}, "
       f"{s_fused('r1', 'r2', 'r3', k=20)} SELECT * FROM fused")
def rrf_three(spark, d):
    return rank.fuse([rank.bm25(I.doc_units(spark, d), WORDS, 20), rank.knn(I.vectors(spark, d), _q7(spark, d), 20, clamp=False), graph.neighbourhood(I.edges(spark, d), "7", 3)], 20)


def _hybrid(spark, d, **more):
    """Searches by stored postings, except among units filtered first; only the hits' contents are compacted."""
    index = None if more.get("prefilter") else _index(spark, d)
    return search.hybrid(
        I.requests(spark, d), I.doc_units(spark, d), WORDS, vectors=I.vectors(spark, d), query_vector=_q7(spark, d), index=index, hydrate=model.derive_entries, **more
    )


def s_hybrid(allow: str = "", collection: str = "", graph_sql: str = "", prefilter: bool = False, k: int = 10) -> str:
    """``hits`` of a hybrid search of document units."""
    sieve = f"WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE {allow})" if allow else ""
    conditions = " AND ".join(x for x in (allow, collection and f"source = '{collection}'") if x)
    if prefilter:
        units_cte = f"units AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text FROM documents WHERE {conditions})"
        knn = S_KNN.format(k=2 * k).replace("FROM embeddings x,", f"FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE {conditions})) x,")
        sieve = ""
    else:
        units_cte, knn = I.S_DOC_UNITS, S_KNN.format(k=2 * k)
    inside = f"WHERE collection = '{collection}'" if collection else ""
    lists = ["r1", "r2"] + (["r3"] if graph_sql else [])
    extra = f", {graph_sql}, {s_ranked('r3', f'(SELECT * FROM near {sieve})')}" if graph_sql else ""
    return (
        f"{s_bm25(WORDS, units_cte)}, b20 AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT {2 * k}), {knn}, "
        f"{s_ranked('r1', f'(SELECT * FROM b20 {sieve})')}, {s_ranked('r2', f'(SELECT * FROM knn {sieve})', 'raw')}{extra}, {s_fused(*lists, k=2 * k)}, {I.S_DOCS}, "
        f"w AS (SELECT * FROM d WHERE id IN (SELECT id FROM fused)), {I.s_compact('w', 'content')}, "
        f"hits AS (SELECT f.id, score, -1 AS best_chunk_index, {I.s_tokens('content')} AS token_count, {I.s_tokens('compact_content')} AS compact_token_count, "
        f"{I.s_tokens('content')} - {I.s_tokens('compact_content')} AS tokens_saved FROM fused f JOIN compacted c ON f.id = c.id {inside} ORDER BY score DESC, f.id LIMIT {k})"
    )


@query(f"WITH {s_hybrid()} SELECT * FROM hits")
def hybrid_search(spark, d):
    return _hybrid(spark, d)


_LANG_EN = "lang = 'en'"


@query(f"WITH {s_hybrid(_LANG_EN)} SELECT * FROM hits")
def hybrid_filtered(spark, d):
    return _hybrid(spark, d, filters={"lang": "en"})


@query(f"WITH {s_hybrid(collection='src7')} SELECT * FROM hits")
def hybrid_collection(spark, d):
    return _hybrid(spark, d, collection="src7")


@query(f"WITH {s_hybrid(_LANG_EN, 'src7', prefilter=True)} SELECT * FROM hits")
def hybrid_prefilter(spark, d):
    return _hybrid(spark, d, filters={"lang": "en"}, collection="src7", prefilter=True)


@query(f"WITH {s_hybrid()} SELECT CAST(sum(token_count) AS BIGINT) AS total_tokens, CAST(sum(compact_token_count) AS BIGINT) AS total_compact_tokens, CAST(sum(tokens_saved) AS BIGINT) AS total_tokens_saved FROM hits")
def search_totals(spark, d):
    return search.totals(_hybrid(spark, d))


@query(f"WITH RECURSIVE {I.S_EDGES}, {s_hybrid(graph_sql=s_near('7', 2))} SELECT * FROM hits")
def hybrid_graph(spark, d):
    return _hybrid(spark, d, edges=I.edges(spark, d), focus="7", max_depth=2)


@query(f"WITH RECURSIVE {I.S_EDGES}, {s_near('4', 2)}, {s_ranked('r3', 'near')}, {s_fused('r3', k=20)} SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 10")
def graph_search(spark, d):
    e = I.light_entries(spark, d).withColumn("compact_token_count", F.col("token_count"))
    return search.hybrid(e, I.doc_units(spark, d), "", edges=I.edges(spark, d), focus="4", max_depth=2).select("id", "score")


@query(f"WITH {I.S_EDGES}, linked AS (SELECT to_id AS id FROM edges WHERE from_id = '7' UNION SELECT from_id FROM edges WHERE to_id = '7'), {S_KNN.format(k=30)} "
       "SELECT id, raw AS score FROM knn WHERE id <> '7' AND raw >= 0.2 AND id NOT IN (SELECT id FROM linked) ORDER BY raw DESC, id LIMIT 10")
def suggest_links(spark, d):
    return search.suggest_links(I.vectors(spark, d), I.edges(spark, d), "7", 0.2, 10)


# graph

_REFS = "id AS edge_id, {t} AS target_id, label, weight, source"


@query(f"WITH {I.S_EDGES} SELECT {_REFS.format(t='to_id')} FROM edges WHERE from_id = '4'")
def graph_out(spark, d):
    return graph.outgoing(I.edges(spark, d), "4")


@query(f"WITH {I.S_EDGES} SELECT {_REFS.format(t='from_id')} FROM edges WHERE to_id = '4'")
def graph_in(spark, d):
    return graph.incoming(I.edges(spark, d), "4")


@query(f"WITH {I.S_EDGES} SELECT id, from_id, to_id, label, weight, source FROM edges WHERE from_id = 'a' ORDER BY created_at, id")
def graph_edges_from(spark, d):
    return graph.edges_of(I.edges(spark, d), "a").select("id", "from_id", "to_id", "label", "weight", "source")


@query(f"WITH {I.S_EDGES} SELECT to_id AS id FROM edges WHERE from_id = 'a' UNION SELECT from_id FROM edges WHERE to_id = 'a'")
def graph_neighbor_ids(spark, d):
    return graph.neighbour_ids(I.edges(spark, d), "a")


def _near(start, depth):
    def run(spark, d):
        return graph.neighbourhood(I.edges(spark, d), start, depth)

    return run


for _name, _start, _depth, _bound in (("d1", "4", 1, 1), ("d2", "4", 2, 2), ("cycle", "a", 0, 8), ("unl", "c3.0", 0, 40)):
    QUERIES[f"graph_neighbors_{_name}"] = _near(_start, _depth)
    ORACLES[f"graph_neighbors_{_name}"] = f"WITH RECURSIVE {I.S_EDGES}, {s_near(_start, _bound)} SELECT id, score FROM near"


@query(f"WITH RECURSIVE {I.S_EDGES}, {s_near('40', 24)} SELECT id, score FROM near")
def graph_proximity(spark, d):
    return graph.neighbourhood(I.edges(spark, d), "40", 0)


def s_subtree(root: str, depth: int) -> str:
    return f"""WITH RECURSIVE {I.S_EDGES}, walk AS (SELECT '{root}' AS id, 0 AS depth UNION SELECT to_id, depth + 1 FROM walk JOIN edges ON from_id = walk.id WHERE depth < {depth} - 1)
SELECT {_REFS.format(t='to_id')} FROM edges WHERE from_id IN (SELECT walk.id FROM walk)"""


@query(s_subtree("1", 2))
def graph_subtree_d2(spark, d):
    return graph.subtree(I.edges(spark, d), "1", 2)


@query(s_subtree("1", 24))
def graph_subtree_unl(spark, d):
    return graph.subtree(I.edges(spark, d), "1", 0)


@query(s_subtree("a", 8))
def graph_subtree_cycle(spark, d):
    return graph.subtree(I.edges(spark, d), "a", 0)


@query(f"WITH {I.S_EDGES} SELECT id, from_id, to_id, label, weight, source FROM edges ORDER BY id")
def graph_all_edges(spark, d):
    return graph.all_edges(I.edges(spark, d)).select("id", "from_id", "to_id", "label", "weight", "source")


@query(f"""WITH {I.S_EDGES}, {I.S_DOCS}, ends AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges),
n AS (SELECT coalesce(d.id, e.id) AS id, coalesce(collection, '') AS collection, coalesce(content, '') AS content FROM d FULL JOIN ends e ON d.id = e.id WHERE collection = 'src3' OR e.id IS NOT NULL)
SELECT id, collection, CASE WHEN strlen(content) <= 80 THEN content ELSE
  left(content, list_max(list_filter(range(0, 81), lambda k: strlen(left(content, k)) <= 80))) ||
  CASE WHEN strlen(left(content, list_max(list_filter(range(0, 81), lambda k: strlen(left(content, k)) <= 80)))) < 80 THEN chr(65533) ELSE '' END END AS label,
  (SELECT count(*) > 2000 FROM n) AS truncated FROM n ORDER BY id LIMIT 2000""")
def graph_overview(spark, d):
    return graph.overview(I.edges(spark, d), I.light_entries(spark, d), "src3", 2500)


@query(f"WITH {I.S_EDGES} SELECT id, from_id, to_id, label, weight, source FROM edges WHERE to_id = 'c' ORDER BY created_at, id")
def graph_edges_to(spark, d):
    return graph.edges_of(I.edges(spark, d), "", "c").select("id", "from_id", "to_id", "label", "weight", "source")


# lists, counts, deduplication

@query(f"WITH {I.S_DOCS} SELECT id, collection, lang, {I.s_tokens('content')} AS token_count, created_at FROM d ORDER BY created_at DESC, id LIMIT 100")
def list_newest(spark, d):
    e = I.light_entries(spark, d).withColumns({"compact_token_count": F.col("token_count"), "updated_at": F.col("created_at")})
    return scan.newest_first(e, 0).select("id", "collection", F.col("metadata")["lang"].alias("lang"), "token_count", "created_at")


@query(f"WITH {I.S_DOCS} SELECT id FROM d WHERE collection = 'src2' ORDER BY created_at DESC, id LIMIT 7")
def list_collection(spark, d):
    e = I.light_entries(spark, d).withColumns({"compact_token_count": F.col("token_count"), "updated_at": F.col("created_at")})
    return scan.newest_first(e, 7, "src2").select("id")


@query("SELECT DISTINCT source AS collection FROM documents WHERE source <> '' ORDER BY 1")
def collections_distinct(spark, d):
    return scan.collections(I.requests(spark, d))


@query(f"WITH {I.S_EDGES} SELECT (SELECT count(*) FROM documents) AS entries, (SELECT count(DISTINCT source) FROM documents WHERE source <> '') AS collections, "
       "(SELECT count(*) FROM embeddings) AS vector_nodes, (SELECT count(*) FROM edges) AS edges")
def stats(spark, d):
    return scan.stats(I.requests(spark, d), I.vectors(spark, d), I.edges(spark, d))


@query("SELECT count(*) AS deleted FROM documents WHERE source = 'src4'")
def delete_count(spark, d):
    return I.requests(spark, d).where("collection = 'src4'").agg(F.count("*").alias("deleted"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def last_n_calls(spark, d):
    return scan.last_calls(I.table(spark, d, "events").select("event_id", "user_id", "event_type"), 0, "event_id")


@query("SELECT CAST(min(doc_id) AS VARCHAR) AS id FROM documents GROUP BY text")
def dedup_exact(spark, d):
    return scan.first_by_hash(_docs(spark, d).select("doc_id", "text"), "text", "doc_id").select(_id())


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(min(doc_id) OVER (PARTITION BY text) AS VARCHAR) AS existing_id FROM documents")
def dedup_lookup(spark, d):
    rows = _docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("hash"))
    return rows.join(rows.groupBy("hash").agg(F.min("doc_id").alias("first")), "hash").select(_id(), F.col("first").cast("string").alias("existing_id"))


S_LOG = "l AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events), z AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"WITH {S_LOG} SELECT key, seq, value FROM z WHERE op = 'put'")
def log_latest_wins(spark, d):
    return scan.latest(I.mutation_log(spark, d)).select("key", "seq", "value")


@query(f"WITH {S_LOG} SELECT key, seq FROM z WHERE op = 'delete'")
def log_tombstone(spark, d):
    return scan.latest(I.mutation_log(spark, d), tombstones=True).where("op = 'delete'").select("key", "seq")


@query(f"WITH {S_LOG} SELECT key, seq, op, value FROM z")
def log_compact(spark, d):
    """Two layers compacted one after the other give what one pass over the whole log gives."""
    log = I.mutation_log(spark, d)
    old = scan.latest(log.where("seq % 2 = 0"), tombstones=True)
    return scan.latest(old.unionByName(log.where("seq % 2 = 1")), tombstones=True).select("key", "seq", "op", "value")


# projections

_C = f"{I.S_DOCS}, {I.s_compact('d', 'content')}, e AS (SELECT *, {I.s_tokens('content')} AS token_count, {I.s_tokens('compact_content')} AS ct FROM compacted)"
_META = "id, collection, 'doc' AS content_type, lang, source, created_at, created_at AS updated_at, token_count, CASE WHEN ct > 0 THEN ct END AS compact_token_count, CASE WHEN ct > 0 THEN token_count - ct END AS tokens_saved"


def _projected(spark, d, detail):
    p = model.project(I.entries(spark, d), detail)
    p = p.withColumns({k: F.col("metadata")[k] for k in ("lang", "source")}).drop("metadata")
    return p.withColumn("chunks", F.array_join(F.transform("chunks", lambda c: F.concat(c["index"].cast("string"), F.lit(" "), c["parent_id"], F.lit(" "), F.sha2(c["text"], 256))), ";")) if detail == "full" else p


@query(f"WITH {_C} SELECT {_META} FROM e")
def project_metadata(spark, d):
    return _projected(spark, d, "unknown")


@query(f"WITH {_C} SELECT {_META}, '' AS summary, compact_content FROM e")
def project_summary(spark, d):
    return _projected(spark, d, "summary")


@query(f"WITH {_C}, ch AS (SELECT *, {I.s_chunks('content', 512)} AS cs FROM e) SELECT {_META}, content, compact_content, '' AS summary, "
       "array_to_string(list_transform(range(0, len(cs)), lambda i: i || ' ' || id || ' ' || sha256(cs[i + 1])), ';') AS chunks FROM ch")
def project_full(spark, d):
    return _projected(spark, d, "full")


@query("""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, list_max(list_filter(range(0, 81), lambda k: strlen(left(text, k)) <= 80)) AS n FROM documents)
SELECT id, CASE WHEN strlen(text) <= 80 THEN text ELSE left(text, n) || CASE WHEN strlen(left(text, n)) < 80 THEN chr(65533) ELSE '' END END AS label FROM t""")
def overview_label(spark, d):
    return _docs(spark, d).select(_id(), X.overview_label(F.lit(""), F.col("text")).alias("label"))


@query(f"WITH {_UNITS} SELECT unit_id, split_part(unit_id, '#', 1) AS doc, CASE WHEN contains(unit_id, '#') THEN CAST(split_part(unit_id, '#', 2) AS INTEGER) ELSE -1 END AS chunk FROM units")
def chunk_suffix(spark, d):
    u = I.paragraph_units(spark, d)
    return u.select("unit_id", X.document_of(F.col("unit_id")).alias("doc"), X.chunk_of(F.col("unit_id")).alias("chunk"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) > 32768 THEN left(text, 32768) || chr(8230) || '(truncated)' ELSE text END AS body FROM documents")
def body_truncation(spark, d):
    return _docs(spark, d).select(_id(), X.truncated(F.col("text")).alias("body"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(8230) || '(truncated)' ELSE text END AS body FROM documents")
def body_truncation_short(spark, d):
    return _docs(spark, d).select(_id(), X.truncated(F.col("text"), 500).alias("body"))


# load report

@query("""WITH c AS (SELECT value AS ms, event_type <> 'error' AS ok FROM events), s AS (SELECT list_sort(list(ms)) AS v, count(*) AS n FROM c WHERE ok)
SELECT count(*) AS requested, count_if(ok) AS ok, count_if(NOT ok) AS errors, any_value(v[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1]) AS p50,
 any_value(v[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1]) AS p95, any_value(v[CAST(floor((n - 1) * 0.99 + 0.5) AS BIGINT) + 1]) AS p99,
 round(count_if(ok) / (sum(ms) / 1000), 6) AS ops_per_sec FROM c, s""")
def stress_report(spark, d):
    calls = I.table(spark, d, "events").select(F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))
    return scan.latency_report(calls).select("requested", "ok", "errors", "p50", "p95", "p99", F.round("ops_per_sec", 6).alias("ops_per_sec"))


@query("SELECT i AS counter, 'Note ' || i || ' on retrieval: counters make each body its own.' AS body FROM range(1000) t(i)")
def stress_bodies(spark, d):
    return spark.range(1000).select(F.col("id").alias("counter"), F.format_string("Note %d on retrieval: counters make each body its own.", F.col("id")).alias("body"))


# files and access

@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'internal/store/' || page_id || '.go' WHEN 1 THEN 'cmd/app/' || page_id || '_test.go' WHEN 2 THEN 'ui/src/' || page_id || '.md'
  WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'scripts/x/' || page_id || '.toml' ELSE 'docs/a/b/' || page_id || '.yml' END AS rel FROM pages)
SELECT page_id, CASE WHEN page_id % 6 IN (0, 1) THEN 'code' ELSE 'doc' END AS content_type,
 CASE page_id % 6 WHEN 0 THEN 'project/store' WHEN 1 THEN 'project/cmd' WHEN 2 THEN 'project/ui' WHEN 4 THEN 'project/scripts' ELSE 'project' END AS collection,
 page_id % 6 = 1 AS is_test, CASE WHEN page_id % 6 = 3 THEN 'Dockerfile' ELSE split_part(rel, '.', 2) END AS ext FROM p""")
def ingest_paths(spark, d):
    i = F.col("page_id").cast("string")
    rel = F.element_at(
        F.array(
            F.concat(F.lit("internal/store/"), i, F.lit(".go")), F.concat(F.lit("cmd/app/"), i, F.lit("_test.go")), F.concat(F.lit("ui/src/"), i, F.lit(".md")),
            F.lit("Dockerfile"), F.concat(F.lit("scripts/x/"), i, F.lit(".toml")), F.concat(F.lit("docs/a/b/"), i, F.lit(".yml")),
        ), (F.col("page_id") % 6 + 1).cast("int"),
    )
    p = I.table(spark, d, "pages").select("page_id", rel.alias("rel"))
    kind, collection, _, ext, test = files.classify_path(F.col("rel"), "project")
    return p.select("page_id", kind.alias("content_type"), collection.alias("collection"), test.alias("is_test"), ext.alias("ext"))


@query("SELECT role, method, path, role = 'admin' OR method = 'GET' OR (method = 'POST' AND path IN ('/v1/search', '/v1/auth/login', '/v1/auth/logout')) AS permitted "
       "FROM (VALUES ('admin'), ('readonly')) r(role), (VALUES ('GET'), ('POST'), ('DELETE')) m(method), (VALUES ('/v1/search'), ('/v1/graph/search'), ('/v1/contexts'), ('/v1/auth/login')) p(path)")
def access_permitted(spark, d):
    r, m, p = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("role", ("admin", "readonly")), ("method", ("GET", "POST", "DELETE")), ("path", ("/v1/search", "/v1/graph/search", "/v1/contexts", "/v1/auth/login"))))
    return r.crossJoin(m).crossJoin(p).withColumn("permitted", access.permitted(F.col("role"), F.col("method"), F.col("path")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user:' || user_id ELSE 'ip:10.0.0.' || (event_id % 200) END AS key FROM events")
def access_rate_key(spark, d):
    e = I.table(spark, d, "events")
    remote = F.concat(F.lit("10.0.0."), F.col("event_id") % 200, F.when(F.col("event_id") % 2 == 0, ":80").otherwise(""))
    return e.select("event_id", access.rate_limit_key(F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")), remote).alias("key"))


@query("SELECT path, path IN ('/v1/health', '/v1/auth/login') AS open FROM (VALUES ('/v1/health'), ('/v1/search'), ('/v1/auth/login'), ('/v1/users')) p(path) WHERE EXISTS (SELECT 1 FROM events)")
def access_open_routes(spark, d):
    paths = spark.createDataFrame([(x,) for x in ("/v1/health", "/v1/search", "/v1/auth/login", "/v1/users")], "path string")
    return access.open_routes(paths, _users(spark, d))


def _users(spark, d):
    return I.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id")).distinct().select("id", F.concat(F.lit("u"), "id").alias("username"), F.sha2("id", 256).alias("password_hash"))


def _tokens(spark, d):
    e = I.table(spark, d, "events")
    secret = F.concat(F.lit("secret"), F.col("event_id"))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.sha2(secret, 256).alias("token_hash"), (F.col("event_type") == "error").alias("revoked"))


def _sessions(spark, d):
    return I.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), (F.lit(1000) + F.col("event_id")).alias("expires_at"))


@query("SELECT count(DISTINCT user_id) AS n_users FROM events")
def access_user_count(spark, d):
    return access.user_count(_users(spark, d))


@query("SELECT CAST(user_id AS VARCHAR) AS id, 'u' || user_id AS username FROM events WHERE event_id = 17 AND event_type <> 'error'")
def access_token_user(spark, d):
    return access.public_users(access.authenticate(_tokens(spark, d), _users(spark, d), "secret17"))


@query("WITH g AS (SELECT CAST(user_id AS VARCHAR) AS u FROM events WHERE event_id = 17) SELECT 'user' AS kind, count(DISTINCT user_id) AS n FROM events WHERE CAST(user_id AS VARCHAR) <> (SELECT u FROM g) "
       "UNION ALL SELECT k, count(*) FROM events, (VALUES ('token'), ('session')) x(k) WHERE CAST(user_id AS VARCHAR) <> (SELECT u FROM g) GROUP BY k")
def access_delete_cascade(spark, d):
    gone = I.table(spark, d, "events").where("event_id = 17").first()["user_id"]
    left = access.delete_user(_users(spark, d), _tokens(spark, d), _sessions(spark, d), str(gone), "someone")
    out = None
    for kind, rows in zip(("user", "token", "session"), left):
        n = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type <> 'error' AS active FROM events")
def access_public_tokens(spark, d):
    return access.public_tokens(_tokens(spark, d))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, 1000 + event_id AS expires_at FROM events WHERE 1000 + event_id > 1500")
def access_live_sessions(spark, d):
    return access.live_sessions(_sessions(spark, d), F.lit(1500))


@query("SELECT event_id AS seq, 'mcp' AS channel, event_type AS tool, CAST(floor(value) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_type <> 'error' AS ok, "
       "CAST(user_id AS VARCHAR) AS request, repeat('x', 32768) || chr(8230) || '(truncated)' AS response FROM events ORDER BY event_id DESC LIMIT 50")
def access_audit_calls(spark, d):
    e = I.table(spark, d, "events")
    calls = e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("request"), F.repeat(F.lit("x"), 40_000).alias("response"),
        (F.col("event_type") == "error").alias("failed"), F.floor("value").cast("long").alias("duration_ms"),
    )
    return access.audit_list(access.call_rows(calls), "admin", 50)


@query(f"WITH {s_bm25(WORDS)}, h AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM bm ORDER BY score DESC, id LIMIT 5) "
       "SELECT n || '. id=' || id || ' collection=' || coalesce(source, '') || ' score=' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR) || ' ' || chr(8212) || ' ' || CASE WHEN length(text) > 240 THEN left(text, 240) || '...' ELSE text END AS line "
       "FROM h JOIN documents ON CAST(doc_id AS VARCHAR) = id")
def search_snippets(spark, d):
    hits = rank.bm25(None, WORDS, 5, _index(spark, d))
    nth = scan.running(hits, [F.desc("score"), F.asc("id")], F.lit(1)).select("id", "score", (F.col("before_") + 1).alias("n"))
    rows = F.broadcast(nth).join(I.requests(spark, d), "id")
    return rows.select(access.snippet(F.col("n"), F.col("id"), F.col("collection"), F.round(F.col("score") * 1000).cast("long"), F.col("content")).alias("line"))


# the store

_FILLED = "documents WHERE text IS NOT NULL AND text <> ''"


def _store(spark, d) -> ContextStore:
    return ContextStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _puts(spark, d):
    return I.requests(spark, d).where("content <> ''").withColumn("order_", F.col("id").cast("long"))


@query(f"SELECT sha256(text) AS content_hash, CAST(coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS VARCHAR) AS id FROM {_FILLED} GROUP BY text")
def store_put_dedup(spark, d):
    """Every other document, then all: what is known keeps its id."""
    store, rows = _store(spark, d), _puts(spark, d)
    store.put(rows.where("order_ % 2 = 0"))
    return store.put(rows)


_FIRSTS = f"f AS (SELECT CAST(min(doc_id) AS VARCHAR) AS id, arg_min(coalesce(source, ''), doc_id) AS collection, arg_min(coalesce(lang, ''), doc_id) AS lang, text AS content FROM {_FILLED} GROUP BY text)"


@query(f"WITH {_FIRSTS} SELECT id, collection FROM f WHERE lang <> 'de' AND collection <> 'src4'")
def store_delete(spark, d):
    store = _store(spark, d)
    store.put(_puts(spark, d))
    store.delete(store.matching({"lang": "de"}))
    store.delete_collection("src4")
    return store.entries().select("id", "collection")


@query(f"WITH g AS (SELECT text, min(doc_id) FILTER (doc_id % 2 = 0) AS e, arg_min(coalesce(lang, ''), doc_id) FILTER (doc_id % 2 = 0) AS l, min(doc_id) AS m FROM {_FILLED} GROUP BY text) "
       f"SELECT CAST(CASE WHEN l <> 'de' THEN e ELSE m END AS VARCHAR) AS id, sha256(text) AS hash, {I.s_tokens('text')} AS token_count FROM g")
def store_compact(spark, d):
    """Half of the documents, some deleted, all put again, compacted, and what is no longer needed removed."""
    store, rows = _store(spark, d), _puts(spark, d)
    store.put(rows.where("order_ % 2 = 0"))
    store.delete(store.matching({"lang": "de"}))
    store.put(rows)
    store.compact()
    store.vacuum()
    return store.entries().select("id", X.content_hash(F.col("content")).alias("hash"), "token_count")


_STORE_UNITS = f"{_FIRSTS}, fc AS (SELECT *, {I.s_chunks('content', 512)} AS cs FROM f), units AS (SELECT id AS unit_id, content AS text FROM fc UNION ALL SELECT id || '#' || unnest(range(len(cs))), unnest(cs) FROM fc)"


@query(f"WITH {s_bm25(WORDS, _STORE_UNITS)}, b20 AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 20), {s_ranked('r1', 'b20')}, {s_fused('r1', k=20)}, "
       "w AS (SELECT split_part(id, '#', 1) AS doc, CASE WHEN contains(id, '#') THEN CAST(split_part(id, '#', 2) AS INTEGER) ELSE -1 END AS chunk, id AS u, score FROM fused), "
       "n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, u) AS nth FROM w) "
       f"SELECT doc AS id, n.score, chunk AS best_chunk_index, {I.s_tokens('content')} AS token_count FROM n JOIN f ON f.id = doc WHERE nth = 1 ORDER BY n.score DESC, doc LIMIT 10")
def store_search(spark, d):
    """Documents and chunks, ranked by the postings that put has stored."""
    store = _store(spark, d)
    store.put(_puts(spark, d))
    return store.search(WORDS, 10).select("id", "score", "best_chunk_index", "token_count")


@query(f"WITH {I.S_EDGES} SELECT id, from_id, to_id, label, weight, source FROM edges WHERE id <> 't17'")
def store_edges(spark, d):
    store = _store(spark, d)
    store.put_edges(I.edges(spark, d).where("id <> 'y3'"))
    store.delete_edge("t17")
    store.put_edges(I.edges(spark, d).where("id = 'y3'"))
    store.compact()
    return store.edges().select("id", "from_id", "to_id", "label", "weight", "source")


@query("SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '" + TERMS + "')) AS term FROM documents) GROUP BY ALL) WHERE term IN ('the', 'of', 'and') GROUP BY term")
def index_terms(spark, d):
    return _index(spark, d).postings(WORDS.split()).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# streams

@query("SELECT DISTINCT sha256(text) AS hash FROM documents")
def stream_ingest_dedup(spark, d):
    return streams.ingest_dedup(spark, d)


@query("SELECT event_type AS channel, unnest(list(event_id ORDER BY event_id)[-20:]) AS seq FROM events GROUP BY event_type")
def stream_last_calls(spark, d):
    return streams.last_calls(spark, d, 20)


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch(ts) AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT key, w, n, 5.0::DOUBLE AS tokens FROM e WHERE n = 1
      UNION ALL SELECT e.key, e.w, e.n, least(5.0::DOUBLE, r.tokens - (r.tokens >= 1)::INT + (e.w - r.w) * 0.001::DOUBLE) FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, w AS "at", tokens >= 1 AS allowed FROM r""")
def stream_token_bucket(spark, d):
    return streams.token_buckets(spark, d)


def flagship(spark, sf_dir) -> DataFrame:
    """BM25 over the documents, the top ten, joined to their entries and projected."""
    return bm25_top10(spark, sf_dir)
