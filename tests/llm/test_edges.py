"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from tarn.llm import bpe, hostrules, licenses, minhash, mixing, nbsvm, pii, suffix, topk, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc_ string, terms_ int, gone_ int, n_mentions int, src_ string, key_ string, epoch int, grp int, id_ int"
LONG = "word " * 60_000
PROSE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, PROSE), (1, PROSE), (2, PROSE), (3, None), (None, PROSE), (None, None), (4, ""), (5, " \n "), (6, LONG), (7, LONG), (8, "call x@y.example.com. Released under the MIT License.")]
    rows = [(d, t, None if d == 4 else "en", None if d == 3 else "s", None, "x", 1, 2, 3, "k", "v", 9, None, 5) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (6, 0, None), (6, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int")


def test_near_duplicates(docs):
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 1, 2), (7, 6, 2)]
    assert minhash.drop_near_duplicates(docs).count() == docs.count() - 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_passages(docs):
    got = {(r["doc_id"], r["start_word"], r["end_word"]): r["other_ids"] for r in suffix.repeated_passages(docs).collect()}
    assert set(got) == {(1, 0, 120), (2, 0, 120), (6, 0, 60_000), (7, 0, 60_000)}
    assert got[1, 0, 120] == [2] and 7 in got[6, 0, 60_000]
    assert suffix.repeated_passages(docs.limit(0)).count() == 0


def test_bpe(docs):
    got = [(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in bpe.encode_documents(docs).collect()]
    assert len(got) == docs.count() and (3, None, None) in got and (4, 0, True) in got
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_licences(docs):
    assert [(r["doc_id"], r["licence"]) for r in licenses.scan_licences(docs).collect()] == [(8, "MIT")]
    assert licenses.scan_licences(docs.limit(0)).count() == 0


def test_pii(docs):
    out = pii.sanitise(docs)
    assert out.columns == [*docs.columns, "n_mentions_", "n_terms"]
    got = [(r["doc_id"], r["text"], r["n_mentions"], r["n_mentions_"]) for r in out.collect()]
    assert len(got) == docs.count() and (3, None, 3, 0) in got
    assert [t for d, t, _, n in got if n] == ["call [EMAIL]. Released under the MIT License."]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs, weights={"s": 1.0}, total=130)
    assert out.columns == [*docs.columns, "epoch_", "n_tokens"]
    assert all(r["doc_id"] is not None and r["epoch"] == 9 for r in out.collect())
    two = docs.sparkSession.createDataFrame([(1, "a b c", "x"), (2, "d  e", "x"), (3, "f", "y")], "doc_id long, text string, source string")
    got = mixing.mix(two, weights={"x": 12.0, "y": 2.0}, total=14).collect()
    assert sum(r["n_tokens"] for r in got if r["source"] == "x") == 12 and sum(r["n_tokens"] for r in got if r["source"] == "y") == 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, weights={}).count() == 0


@pytest.mark.parametrize("budget", range(1, 36, 3))
def test_budgets_are_exact_where_ids_repeat(spark, budget):
    rows = [(1, "a b c d e", "x", i % 2) for i in range(3)] + [(1, "f g h", "x", 7), (2, "i j", "x", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, nth_ int"), weights={"x": 1.0}, total=budget).collect()
    assert sum(r["n_tokens"] for r in got) == budget == sum(len(r["text"].split()) for r in got)
    assert sum(r["n_tokens"] < len(dict.fromkeys(r["text"].split())) for r in got) == 0 and len(got) >= budget / 5


def test_classifier(docs, labels):
    model = nbsvm.fit(docs, labels, min_df=1, min_gain=0.0)
    got = nbsvm.classify(docs, model).collect()
    assert len(got) == docs.count() and not any(r["keep"] for r in got if r["doc_id"] in (3, 4, 5))
    assert nbsvm.keep_good(docs, model).columns == docs.columns
    none = nbsvm.fit(docs.limit(0), labels)
    assert nbsvm.classify(docs.limit(0), none).count() == 0 and nbsvm.keep_good(docs, none).count() == sum(r["doc_id"] not in (3, 4, 5) and r["doc_id"] is not None for r in got) + 1


def test_hosts(docs):
    got = hostrules.judge(docs).collect()
    assert len(got) == docs.count() and {r["host"] for r in got} == {"", "s"}
    assert not any(r["keep"] for r in got if r["doc_id"] in (3, 4, 5, 6, 7))
    assert hostrules.judge(docs.limit(0)).count() == 0


def test_domains(spark):
    cases = {
        "https://user@Blog.Example.co.uk:80/x?y": "example.co.uk", "http://a.b.example.com": "example.com", "//cdn.example.org/x": "example.org", "www.example.de": "example.de",
        "http://10.1.2.3/x": "10.1.2.3", "src7": "src7", "localhost": "localhost", None: "", "": "", "https://": "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, want string")
    assert [r["h"] for r in rows.where(hostrules.domain(rows["h"]) != rows["want"]).collect()] == []


def test_repetition_is_judged_alike_at_any_length(spark):
    prose, junk = [f"alpha{i % 997} beta{i % 31}" for i in range(6000)], ["buy now cheap here"] * 3000
    rows = [(n, kind, " ".join(x[:n])) for n in (10, 900, 1010, 1100, 6000) for kind, x in (("prose", prose), ("junk", junk))]
    d = spark.createDataFrame(rows, "n int, kind string, text string")
    got = d.select("kind", hostrules.rules(d["text"])["repetition"].alias("fails")).collect()
    assert all(r["fails"] == (r["kind"] == "junk") for r in got)


def test_rates_shrink_by_an_unbiased_prior(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    weights = []
    for _ in range(3):
        n = rng.integers(2, 9, 3000)
        failed = rng.binomial(n, rng.beta(2.0, 6.0, 3000))
        rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(n, failed))], "host int, docs int, failed int")
        flat = rows.selectExpr("host", "explode(sequence(1, docs)) AS i", "failed").selectExpr("host", "CAST(i <= failed AS INT) AS fails")
        r = hostrules.host_rates(flat).where("docs = 4 AND failed = 0").first()
        m = failed.sum() / n.sum()
        weights.append(4 * r["rate"] / (m - r["rate"]))  # rate = m w / (w + 4)
    assert abs(np.mean(weights) - 8) < 1.2


def test_ties_at_the_limit(spark):
    bad = "buy buy " * 20
    rows = [(i, bad if i < 2 else PROSE, "x") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["rate"] for r in hostrules.judge(d).collect()} == {0.5} and not any(r["keep"] for r in hostrules.judge(d).collect())
    assert sum(r["keep"] for r in hostrules.judge(d, most=0.500001).collect()) == 2


def test_urls(spark):
    head = '<link rel="canonical" href="{}">'
    rules = {"block": ("[?&]ref=",), "allow": ("/en/[0-9]+$",)}
    rows = [
        (1, "https://a.example.com/x?ref=1", head.format("/y"), "n"), (2, "http://www.a.example.com/y/", None, "n"), (3, "https://b.example.com/", head.format("https://a.example.com/y"), "n"),
        (4, "https://b.example.com/en/7", head.format("https://b.example.com"), "n"), (5, None, head.format("/q"), "n"), (None, "nonsense", "", "n"), (6, "https://c.example.com/", "", "n"), (6, "https://c.example.com/", "", "n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node string")
    got = sorted(((r["page_id"] or 0, r["decision"]) for r in urlfilter.decide(pages, **rules).collect()))
    assert got == [(0, "none"), (1, "block"), (2, "block alias"), (3, "block alias"), (4, "allow"), (5, "none"), (6, "none"), (6, "none")]
    hops = spark.createDataFrame([("https://c.example.com", "https://b.example.com"), (None, "x")], "source string, target string")
    assert {r["decision"] for r in urlfilter.decide(pages, redirects=hops, **rules).where("page_id = 6").collect()} == {"block alias"}
    assert urlfilter.decide(pages.limit(0)).count() == 0


def test_links_in_any_spelling(spark):
    heads = [
        "<meta content='0; URL=https://b.example.com/1' http-equiv=refresh>", "<LINK HREF=https://b.example.com/2 REL=canonical>", "<link rel=canonical href=https://b.example.com/3>",
        '<link rel="canonical" href="https://b.example.com/4"><link rel="canonical" href="https://b.example.com/5">', "<meta http-equiv=\"refresh\" content=\"0;url='/6'\">", '<link rel="next" href="https://b.example.com/7"><p>canonical',
    ]
    pages = spark.createDataFrame([(i, f"https://a.example.com/p{i}", h) for i, h in enumerate(heads)], "page_id long, url string, html string")
    got = {tuple(r) for r in urlfilter.link_edges(pages).collect()}
    want = [(0, "b.example.com/1"), (1, "b.example.com/2"), (2, "b.example.com/3"), (3, "b.example.com/4"), (3, "b.example.com/5"), (4, "a.example.com/6")]
    assert got == {(f"a.example.com/p{i}", b) for i, b in want}


def test_relative_links(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example.com/x/y.html?q=1#f", "http://a.example.com", "https://a.example.com/x/y/"]
    targets = ["page2.html", "../z", "./w", "../../../up/./v", "/root/../r2", "?q=2", "//b.example.com/k", "https://c.example.com/d/../e", "a/b/../c", "mailto:x@y.example.com", "#f", ""]
    d = spark.createDataFrame([(b, t, urljoin(b, t) if t and t[0] != "#" else None) for b in bases for t in targets], "b string, t string, want string")
    got = d.select("b", "t", urlfilter.address(urlfilter._absolute(d["t"], d["b"])).alias("got"), urlfilter.address(d["want"]).alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == [] and sum(r["got"] is not None for r in got) == 27


def test_chains_circles_hubs_and_an_allowed_alias(spark):
    n = 400
    url = lambda i: f"https://{'spam-x' if i in (40, 240) else 'h%d' % (i % 7)}.example.com/{i}"
    pages = spark.createDataFrame([(i, url(i), "") for i in range(n)], "page_id long, url string, html string")
    hops = [(i, i + 1) for i in range(99)] + [(i, 200 + (i - 199) % 50) for i in range(200, 250)] + [(i, 399) for i in range(260, 399)]
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in hops], "source string, target string")
    got = {r["page_id"]: r["decision"] for r in urlfilter.decide(pages, allow=("/7$",), redirects=redirects).collect()}
    want = {i: "allow" if i == 7 else "block" if i in (40, 240) else "block alias" if i < 100 or 200 <= i < 250 else "none" for i in range(n)}
    assert got == want


def test_top_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    got = sorted(tuple(r) for r in topk.top_k(vectors, asking="").collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
