"""Full-text and vector ranking, metadata filters and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.functions import vector as V
from tarn.operators.scan import running
from tarn.sources.shared import cut

K1, B = 1.2, 0.75
RRF_K = 60
DIGITS = 6


def repeat(units: DataFrame) -> bool:
    """Whether a unit id stands on several rows: a look at the ids alone."""
    return not units.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _with_terms(units: DataFrame) -> DataFrame:
    """(unit_id, text, ts) for ``_terms_of``: plain texts are split in Arrow, any other in the JVM, with the same terms."""
    plain = ~X.unusual(F.col("text"))
    return units.select(F.col("unit_id").cast("string").alias("unit_id"), "text").where("text <> ''").select("unit_id", F.when(plain, F.col("text")).alias("text"), F.when(~plain, X.terms(F.col("text"))).alias("ts"))


def _terms_of(batches):
    """(rows of ids, row number of each term, terms), a thousand rows at a time; a row's terms stand together."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            split = pc.split_pattern_regex(pc.utf8_lower(b.column(1)), "[^\\p{L}\\p{N}]+")
            lists = [x for x in (split, b.column(2)) if x.null_count < len(x)]
            row = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]) if lists else np.zeros(0, dtype=np.int64)
            term = pa.concat_arrays([pc.list_flatten(x).cast(pa.string()) for x in lists]) if lists else pa.array([], pa.string())
            some = pc.not_equal(term, "")
            yield b.column(0), row[some.to_numpy(zero_copy_only=False)], term.filter(some)


def postings(units: DataFrame, repeats: bool | None = None) -> DataFrame:
    """(unit_id, dl, term, tf, starts). Units without terms have no postings and do not count in N.

    A row's terms are counted where the row is, in an Arrow batch function, so nothing is
    shuffled; only where ids repeat (looked up unless told by ``repeats``) are equal
    (unit_id, dl, term) added up. ``starts`` is 1 in a row's first posting, so its sum is N.
    """
    import numpy as np
    import pyarrow as pa

    def count(batches):
        for ids, row, term in _terms_of(batches):
            if not len(row):
                continue
            g = pa.table({"row": row, "term": term}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            at = g["row"].to_numpy()
            starts = np.zeros(len(at), dtype=np.int32)
            starts[np.unique(at, return_index=True)[1]] = 1
            columns = [ids.take(pa.array(at)), pa.array(np.bincount(row)[at].astype(np.int32)), *g["term"].chunks, *g["count_all"].chunks, pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, ["unit_id", "dl", "term", "tf", "starts"])

    rows = _with_terms(units).mapInArrow(count, "unit_id string, dl int, term string, tf bigint, starts int")
    if repeat(units) if repeats is None else repeats:
        rows = rows.groupBy("unit_id", "dl", "term").agg(F.sum("tf").alias("tf"), F.sum("starts").cast("int").alias("starts"))
    return rows


def lengths(units: DataFrame) -> DataFrame:
    """(unit_id, dl) of units that have terms."""
    return units.select("unit_id", F.size(X.terms(F.col("text"))).alias("dl")).where("dl > 0")


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row: n_units, avgdl (1 if there are none)."""
    return lens.agg(F.count("*").alias("n_units"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def query_terms(query: str) -> list[str]:
    """A query's terms, repeats included, as ``terms`` would give them."""
    out, word = [], []
    for c in query.lower() + " ":
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def idf(n_units, df):
    return F.log1p((n_units - df + 0.5) / (df + 0.5))


def bm25(units: DataFrame | None, query: str, top_k: int = 10, index=None, keep: DataFrame | None = None) -> DataFrame:
    """(id, score): units ranked by BM25, score descending, then id; all of them if ``top_k`` <= 0.

    A repeated query term counts as often as it stands. With ``index`` (stored
    postings, see ``tarn.sources.index``), only the query's terms are read from
    it. Without one, texts are scanned once, and what is counted in them serves the statistics, one row, and
    the scores; no text is shuffled. The collection is that of the documents in ``keep`` (id), if given. A unit id stands once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    wanted: dict[str, int] = {}
    for t in query_terms(query):
        wanted[t] = wanted.get(t, 0) + 1
    if index is not None:
        return top(_scored(index.postings(list(wanted)), index.stats(), wanted), top_k)
    if not wanted:
        return top(units.select(F.col("unit_id").alias("id"), F.lit(0.0).alias("score")).limit(0), top_k)
    words, tfs = list(wanted), [f"tf{i}" for i in range(len(wanted))]

    def measure(batches):
        for ids, row, term in _terms_of(batches):
            has = np.flatnonzero(dl := np.bincount(row, minlength=len(ids)))
            tf = [np.bincount(row[pc.equal(term, w).to_numpy(zero_copy_only=False)], minlength=len(ids))[has].astype(np.int32) for w in words]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), *(pa.array(x) for x in (dl[has].astype(np.int32), *tf))], ["unit_id", "dl", *tfs])

    lens = _with_terms(units).mapInArrow(measure, ", ".join(["unit_id string", "dl int", *(f"{t} int" for t in tfs)]))
    # few bytes a unit, so that units are derived and split once for both uses
    lens = cut(allowed(lens.withColumnRenamed("unit_id", "id"), keep).withColumnRenamed("id", "unit_id"))
    # one row: the collection's size, and how many units have each term
    stats = lens.agg(F.count("*").alias("n_units"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *(F.count_if(F.col(t) > 0).alias(f"d{t}") for t in tfs))
    hits = lens.where(" OR ".join(f"{t} > 0" for t in tfs)).crossJoin(F.broadcast(stats))
    score = sum(times * idf(F.col("n_units"), F.col(f"d{t}")) * _saturation(F.col(t)) for t, times in zip(tfs, wanted.values()))
    return top(hits.select(F.col("unit_id").alias("id"), F.round(score, DIGITS).alias("score")), top_k)


def _saturation(tf):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _scored(hits: DataFrame, stats: tuple[int, float], wanted: dict[str, int]) -> DataFrame:
    """(id, score) of postings (unit_id, term, tf, dl) of the terms ``wanted`` in a collection of (units, average length)."""
    hits = hits.withColumn("avgdl", F.lit(float(stats[1])))
    times = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)) if wanted else F.lit(None).cast("map<string,int>")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    df = df.select("term", (times[F.col("term")] * idf(F.lit(stats[0]), F.col("df"))).alias("weight"))
    part = F.col("weight") * _saturation(F.col("tf"))
    return hits.join(F.broadcast(df), "term").groupBy(F.col("unit_id").alias("id")).agg(F.round(F.sum(part), DIGITS).alias("score"))


def top(ranked: DataFrame, k: int) -> DataFrame:
    """Score descending, then id; the first ``k``, or all if ``k`` <= 0."""
    out = ranked.orderBy(F.desc("score"), "id")
    return out.limit(k) if k > 0 else out


def knn(
    vectors: DataFrame, query: list[float] | DataFrame, top_k: int = 10, id_col: str = "unit_id", vector_col: str = "embedding", clamp: bool = True
) -> DataFrame:
    """(id, score): the ``top_k`` (10 if <= 0) nearest by cosine; negative similarities are reported as 0.

    Order is by the raw similarity, rounded, then id; without ``clamp`` the raw similarity
    is the score too, so that ``fuse`` ranks by it. ``query`` is a vector, or a frame of one
    row and one column ``q``.
    """
    k = top_k if top_k > 0 else 10
    if isinstance(query, DataFrame):
        rows, q = vectors.crossJoin(F.broadcast(query.limit(1).select(F.col("q").alias("q_")))), F.col("q_")
    else:
        rows, q = vectors, F.array(*(F.lit(float(x)) for x in query))
    raw = F.round(V.cosine(F.col(vector_col), q), 5)
    out = rows.select(F.col(id_col).alias("id"), raw.alias("raw")).orderBy(F.desc("raw"), "id").limit(k)
    return out.select("id", (F.greatest("raw", F.lit(0.0)) if clamp else F.col("raw")).alias("score"))


def lsh_knn(vectors: DataFrame, query: list[float], top_k: int = 10, tables: int = 12, bucket: float = 0.4, seed: int = 3) -> DataFrame:
    """Approximate ``knn`` over (unit_id, embedding) by random projections of unit vectors, with exact scores for candidates."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    norm = F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    unit = vectors.withColumn("n_", norm).where("n_ > 0").select("unit_id", "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("n_"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), top_k * 4)
    return knn(near.select("unit_id", "embedding"), query, top_k)


def normalised_pairs(metadata):
    """Metadata as an array of normalised (k, v); keys that normalise alike both stay, empty ones go."""
    pairs = F.transform(F.map_entries(metadata), lambda e: F.struct(F.lower(X.trim_blank(e["key"])).alias("k"), X.trim_blank(e["value"]).alias("v")))
    return F.filter(pairs, lambda p: p["k"] != "")


def matching(entries: DataFrame, filters: dict[str, str] | None) -> DataFrame | None:
    """(id) of the entries that have all of the pairs; None, no restriction, without filters."""
    if not filters:
        return None
    pairs, keep = normalised_pairs(F.col("metadata")), F.lit(True)
    for k, v in filters.items():
        want = F.struct(F.lit(k.strip().lower()).alias("k"), F.lit(v.strip()).alias("v"))
        keep = keep & F.coalesce(F.array_contains(pairs, want), F.lit(False))
    return entries.where(keep).select("id")


def allowed(hits: DataFrame, allow: DataFrame | None, exact: bool = False) -> DataFrame:
    """Hits whose document (or, with ``exact``, id) is in ``allow``; all of them if it is None."""
    if allow is None:
        return hits
    key = F.col("id") if exact else X.document_of(F.col("id"))
    return hits.withColumn("doc_", key).join(allow.select(F.col("id").alias("doc_")), "doc_", "left_semi").drop("doc_")


def fuse(lists: list[DataFrame], top_k: int = 0, short: list[bool] | None = None) -> DataFrame:
    """(id, score): reciprocal-rank fusion of ranked lists (id, score).

    ``short`` tells which lists were cut to a few rows before and can be ranked
    by one task; places in any other are found over all partitions of a range sort.
    """
    parts = None
    for i, hits in enumerate(lists):
        order = [F.desc("score"), F.asc("id")]
        if short and short[i]:
            hits = hits.withColumn("before_", F.row_number().over(Window.orderBy(*order)) - 1)
        else:
            hits = running(hits, order, F.lit(1))
        part = hits.select("id", (1.0 / (RRF_K + 1 + F.col("before_"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return top(parts.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score")), top_k)


def near_duplicate_pairs(
    vectors: DataFrame, threshold: float, id_col: str = "unit_id", vector_col: str = "embedding", block_rows: int | None = None, most_pivots: int = 256
) -> DataFrame:
    """(a, b, score) of the pairs a < b with cosine of at least ``threshold``: all pairs, compared exactly.

    Vectors are grouped around pivots and cut into blocks; each pair of blocks is one matrix product in
    an Arrow batch function. With a positive threshold, groups too far apart
    for any pair, by the triangle inequality of angles, are not compared.
    Vectors of different widths have a cosine of 0. Each vector goes to as many
    tasks as there are blocks; with a positive threshold a block is wide and a product is first looked
    through in single precision, and what may reach the threshold is computed in double. Without one, every pair
    is a row, and blocks are narrow. Rows leave a task a strip at a time, so its memory is bounded in both cases.
    """
    block_rows = block_rows or (16384 if threshold > 0 else 4096)
    import numpy as np
    import pyarrow as pa

    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = -(-max(1, rows.count()) // block_rows)
    # groups around pivots, cut into blocks; two groups can hold a pair only if their angles allow it
    some = rows.where("size(v) > 0 AND forall(v, x -> x IS NOT NULL)").orderBy(F.xxhash64("id"), "id").limit(min(most_pivots, 2 * n) if threshold > 0 else 1).select("v").collect()
    wide = max((len(r["v"]) for r in some), default=0)
    pivots = np.array([r["v"] for r in some if len(r["v"]) == wide], dtype=float).reshape(-1, wide)
    sizes = np.linalg.norm(pivots, axis=1)
    pivots = pivots[sizes > 0] / sizes[sizes > 0, None]

    def assign(batches):
        for b in batches:
            group, angle = np.zeros(len(b), dtype=np.int32), np.full(len(b), np.pi)
            vs = b.column(1).to_pylist()
            at = [i for i, v in enumerate(vs) if len(v) == wide and None not in v]
            if at and len(pivots):
                m = np.array([vs[i] for i in at], dtype=float)
                norm = np.linalg.norm(m, axis=1)
                near = np.arccos(np.clip(m @ pivots.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))
                group[at], angle[at] = near.argmin(1), np.where(norm > 0, near.min(1), np.pi)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group), pa.array(angle)], ["id", "v", "g", "angle"])

    rows = cut(rows.mapInArrow(assign, f"id string, v {kind}, g int, angle double"))
    known = {r["g"]: (r["c"], r["a"]) for r in rows.groupBy("g").agg(F.count("*").alias("c"), F.max("angle").alias("a")).collect()}  # at most most_pivots rows
    first, blocks = {}, []
    for g, (c, _) in sorted(known.items()):
        first[g] = len(blocks)
        blocks += [g] * -(-c // block_rows)
    widest = np.arccos(np.clip(threshold - 1e-4, -1, 1)) + 1e-9

    def meet(g: int, h: int) -> bool:
        if threshold <= 0 or g == h or not len(pivots):
            return True
        return np.arccos(np.clip(pivots[g] @ pivots[h], -1, 1)) <= known[g][1] + known[h][1] + widest

    together = {g: sorted(h for h in known if meet(g, h)) for g in known}
    of = {b: [c for h in together[g] for c in range(first[h], len(blocks)) if blocks[c] == h] for b, g in enumerate(blocks)}
    size = F.create_map(*(F.lit(x) for g, (c, _) in known.items() for x in (g, -(-c // block_rows)))) if known else F.lit(None).cast("map<int,int>")
    start = F.create_map(*(F.lit(x) for pair in first.items() for x in pair)) if known else F.lit(None).cast("map<int,int>")
    rows = rows.withColumn("block", (start[F.col("g")] + F.pmod(F.xxhash64("id"), size[F.col("g")])).cast("int")).drop("g", "angle")
    pairs = vectors.sparkSession.createDataFrame([(i, j) for i, js in of.items() for j in js if i <= j], "i int, j int")
    left = rows.join(pairs, rows["block"] == pairs["i"]).select("i", "j", "id", "v", F.lit(True).alias("left"))
    right = rows.join(pairs, rows["block"] == pairs["j"]).select("i", "j", "id", "v", F.lit(False).alias("left"))

    def compare(batches):
        t = pa.Table.from_batches(list(batches))
        if not len(t):
            return
        # a block paired with itself has each pair twice; different blocks once
        own = t["i"][0].as_py() == t["j"][0].as_py()
        left = t["left"].to_numpy().astype(bool)
        lists = t["v"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ids, width, flat = pa.concat_arrays(t["id"].chunks), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(width) - width
        place = np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1]  # of an id among all, in order
        for w in np.unique(width[left]) if threshold > 0 else [int(width.max())]:
            x, y = np.flatnonzero(left & (width == w)), np.flatnonzero(~left & (width == w))
            if not len(x) or not len(y):
                continue
            mats = [flat[start[at][:, None] + np.arange(w)].astype(float).reshape(len(at), w) for at in (x, y)]
            mats = [m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) > 0, s, 1.0) for m in mats]
            rough, slack = [m.astype(np.float32) for m in mats] if threshold > 0 else None, 1e-4 + 4e-7 * w
            strip = max(1, min(512, (1 << 22) // len(y))) if threshold > 0 else max(1, (1 << 18) // len(y))
            for at in range(0, len(x), strip):
                if threshold > 0:
                    r, c = np.nonzero(rough[0][at : at + strip] @ rough[1].T >= np.float32(threshold - slack))
                    score = np.round(np.einsum("ij,ij->i", mats[0][at + r], mats[1][c]), 5)
                    r, c, score = (v[score >= threshold] for v in (r, c, score))
                else:
                    score = np.round(mats[0][at : at + strip] @ mats[1].T, 5).ravel()
                    r, c = np.divmod(np.arange(len(score)), len(y))
                a, b = x[at + r], y[c]
                less = place[a] < place[b]
                keep = less if own else place[a] != place[b]
                low, high = np.where(less, a, b)[keep], np.where(less, b, a)[keep]
                for n in range(0, len(low), 1 << 18):
                    part = slice(n, n + (1 << 18))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(low[part])), ids.take(pa.array(high[part])), pa.array(score[keep][part])], ["a", "b", "score"])

    compare.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark tells the form by these
    return left.union(right).groupBy("i", "j").applyInArrow(compare, "a string, b string, score double")


def query_frame(spark: SparkSession, vector: list[float]) -> DataFrame:
    return spark.createDataFrame([([float(x) for x in vector],)], "q array<double>")
