from tarn.operators import rank


def test_fused_lists_rank_negative_similarities_by_their_value(spark):
    vectors = spark.createDataFrame([("a", [-1.0, 0.1]), ("b", [-0.2, 1.0])], "unit_id string, embedding array<float>")
    near = rank.knn(vectors, [1.0, 0.0], 2, clamp=False)
    assert [r["id"] for r in rank.fuse([near]).collect()] == ["b", "a"]
    assert [r["score"] for r in rank.knn(vectors, [1.0, 0.0], 2).collect()] == [0.0, 0.0]


def test_fusion_of_two_lists(spark):
    lists = [spark.createDataFrame(x, "id string, score double") for x in ([("x", 2.0), ("y", 1.0)], [("y", 2.0), ("z", 1.0)])]
    found = {r["id"]: r["score"] for r in rank.fuse(lists).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6), "z": round(1 / 62, 6)}


def test_all_pairs_of_the_table(spark, sf):
    import numpy as np

    from tarn.plans import registry

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, score = [str(r["vec_id"]) for r in rows], x @ x.T
    want = {(min(a, b), max(a, b)): score[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids[:i])}
    got = {(r["a"], r["b"]): r["score"] for r in registry.QUERIES["cosine_pairs"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-5 for k in want)


def test_near_duplicates_by_blocks_and_pivots(spark):
    import numpy as np

    from tarn.operators import rank

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    x = (centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * 0.15).astype(np.float32)
    x[7] = 0
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "unit_id string, embedding array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    score = np.round(u @ u.T, 5)
    for t in (0.9, 0.985, -2.0):
        got = {(r["a"], r["b"]) for r in rank.near_duplicate_pairs(vectors.where("unit_id <> 'short'") if t < 0 else vectors, t, block_rows=30).collect()}
        want = {tuple(sorted((f"v{i}", f"v{j}"))) for i in range(400) for j in range(i) if score[i, j] >= t}
        assert got == want


def test_fusion_of_a_long_list_over_many_partitions(spark):
    from pyspark.sql import functions as F

    long = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("score")).repartition(9)
    order = [r["id"] for r in long.orderBy(F.desc("score"), "id").collect()]
    got = {r["id"]: r["score"] for r in rank.fuse([long, long.limit(0)], 0, [False, True]).collect()}
    assert got.keys() == set(order) and all(abs(got[x] - 1 / (61 + i)) < 1.1e-9 for i, x in enumerate(order))


def test_percentiles(spark):
    import numpy as np

    from tarn.operators import scan

    values = np.round(np.random.default_rng(1).gamma(2, 40, 3000), 1)
    calls = spark.createDataFrame([(float(v), i % 9 != 0) for i, v in enumerate(values)], "ms double, ok boolean")
    good = sorted(v for i, v in enumerate(values) if i % 9)
    r = scan.latency_report(calls).first()
    assert [r["p50"], r["p95"], r["p99"]] == [good[int((len(good) - 1) * p + 0.5)] for p in (0.5, 0.95, 0.99)] and r["errors"] == 334
    none = scan.latency_report(calls.where("ms < 0")).first()
    assert (none["requested"], none["p50"], none["ops_per_sec"]) == (0, 0.0, 0.0)


def test_approximate_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("CAST(vec_id AS STRING) AS unit_id", "embedding")
    q = [float(x) for x in rows.where("unit_id = '7'").first()["embedding"]]
    near = {r["id"] for r in rank.lsh_knn(rows, q, 10, tables=20, bucket=0.8).collect()}
    assert len(near & {r["id"] for r in rank.knn(rows, q, 10).collect()}) >= 9


def test_a_bucket_of_tokens_in_any_order(spark, tmp_path):
    import random

    from tarn.streaming.ingest import token_buckets

    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), round(rnd.random() * 600, 3)) for _ in range(500)]
    want = []
    for key in "abc":
        tokens, last = 3.0, None
        for at in sorted(t for k, t in rows if k == key):
            tokens = min(3.0, tokens + ((at - last) * 0.05 if last is not None else 0))
            last = at
            want.append((key, at, tokens >= 1))
            tokens -= tokens >= 1
    spark.createDataFrame(rows, "key string, at double").repartition(6).write.parquet(str(tmp_path / "in"))
    stream = token_buckets(spark.readStream.schema("key string, at double").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), 0.05, 3.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream.writeStream.format("memory").queryName("poured").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in spark.table("poured").collect()) == sorted(want)


def test_terms_split_in_arrow_are_those_of_the_jvm(spark):
    """Every character of Unicode, between letters and alone, and rows without terms."""
    from pyspark.sql import functions as F

    from tarn.functions import text as X

    plain = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070))]
    texts = [f"Ab{c}Cd {c}{c} x{c}" for c in plain] + [f"É{chr(c)}z" for c in range(0x250, 0x11000, 7) if not 0xD800 <= c < 0xE000] + ["", None, " .. ", "a A á Á a"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, text string")
    want = rows.select("unit_id", F.size(X.terms(F.col("text"))).alias("dl"), F.explode(X.terms(F.col("text"))).alias("term")).groupBy("unit_id", "dl", "term").agg(F.count("*").alias("tf"))
    got = rank.postings(rows)
    assert sorted(map(tuple, got.select("unit_id", "dl", "term", "tf").collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("starts")).first()[0] == want.select("unit_id").distinct().count()


def test_postings_are_counted_without_a_shuffle_and_ids_may_repeat(spark):
    rows = spark.createDataFrame([("a", "x y x"), ("b", "x"), ("a", "x y x"), ("a", "z")], "unit_id string, text string")
    assert sorted((r["unit_id"], r["dl"], r["term"], r["tf"], r["starts"]) for r in rank.postings(rows).collect() if r["term"] != "y") == [("a", 1, "z", 1, 1), ("a", 3, "x", 4, 2), ("b", 1, "x", 1, 1)]
    once = rows.where("text <> 'z'").limit(2)
    assert "Exchange" not in rank.postings(once.checkpoint())._jdf.queryExecution().executedPlan().toString()


def test_stored_postings_give_the_size_of_the_collection(spark, tmp_path):
    from tarn.sources import index

    units = spark.createDataFrame([("a", "x y x"), ("b", " "), ("c", "Z"), ("d", None)], "unit_id string, text string")
    index.write_postings(units, str(tmp_path / "p"))
    assert index.measured(spark, [str(tmp_path / "p")]) == index.measure(units) == (2, 4)


def test_a_prefiltered_search_builds_no_index(spark, sf, monkeypatch):
    from tarn.plans import registry

    monkeypatch.setattr(registry, "_index", lambda *_: 1 / 0)
    assert registry.QUERIES["hybrid_prefilter"](spark, sf).columns


def test_pairs_leave_a_task_in_strips(spark, monkeypatch):
    """All pairs of one block, a few at a time: the task never holds them all."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.group import GroupedData

    seen = {}
    whole = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: seen.update(f=f) or whole(self, f, schema))
    rank.near_duplicate_pairs(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "unit_id string, embedding array<float>"), -2.0)
    n = 1500
    v = pa.array(np.random.default_rng(1).normal(size=(n, 8)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    sides = [pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([f"v{i}" for i in range(n)]), v, pa.array([left] * n)], ["i", "j", "id", "v", "left"]) for left in (True, False)]
    sizes = [len(b) for b in seen["f"](iter(sides))]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= 1 << 18
