"""Text functions against plain Python, and the size of their plans."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from tarn.functions import access
from tarn.functions import text as X
from tarn.plans import registry

TEXTS = [
    "please noin order to te that x", "in order " * 6 + "to " * 6 + "end", "In Order To go, basically, Actually, essentially, x", "function database message request which is  number", "", "information",
    "a\u0001b function \u0001x", "in terms of in in terms of terms of y", "PLEASE NOTE THAT please note that", "no filler at all", "in order " * 400 + "to " * 400 + "deep", "   padded  ", "---\n\n\n\nx  \t y...",
]


def no_fillers(t):
    for p in X.FILLERS:
        while (i := t.lower().find(p + " ")) >= 0:
            t = t[:i] + t[i + len(p) + 1 :]
    return t


def short(t):
    return re.sub(" (" + "|".join(X.SHORT_FORMS) + ") ", lambda m: f" {X.SHORT_FORMS[m.group(1)]} ", f" {t} ")[1:-1]


def test_text_functions(spark):
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.strip_fillers(c).alias("f"), X.abbreviate(c).alias("a"), X.trim_blank(c).alias("b"), X.compact(c).alias("c")).collect()
    for r in rows:
        assert r["f"] == no_fillers(r["t"]) and r["a"] == short(r["t"]) and r["b"] == r["t"].strip()
        out = re.sub(r"(?m)^[-=*]{3,}\s*$", "", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", short(no_fillers(r["t"]))))).replace("...", "…").strip()
        assert r["c"] == (out or r["t"])


def test_fillers_have_one_normal_form():
    """No phrase begins as it ends, so the order in which one phrase's occurrences go makes no difference."""
    for p in (p + " " for p in X.FILLERS):
        assert not any(p[:n] == p[-n:] for n in range(1, len(p)))


@pytest.mark.parametrize("name", ["text_compact", "hybrid_search"])
def test_plans_stay_small(spark, sf, name):
    plan = str(registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan())
    assert plan.count("regexp_replace") <= 35


def test_compact_content_is_derived_for_hits_only(spark, sf):
    plan = str(registry.QUERIES["hybrid_search"](spark, sf)._jdf.queryExecution().optimizedPlan())
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("regexp_replace")


def test_chunks_of_many_shapes(spark):
    def chunks(t, limit, overlap=200):
        out, buf = [], ""

        def emit():
            nonlocal buf
            if (said := buf.strip()) != "":
                out.append(said)
                buf = ""

        if t == "":
            return []
        for p in t.split("\n\n"):
            if buf and len(buf.encode()) + len(p.encode()) > limit:
                emit()
            if not buf:
                buf = p
                continue
            buf += "\n\n" + p
            if len(buf.encode()) >= limit:
                emit()
                if len(p.encode()) > overlap:
                    buf += p.encode()[-overlap:].decode("utf-8", "replace")
        emit()
        return out or [t.strip()]

    rows = ["", " ", "a", "a\n\nb", "\n\n".join(f"paragraph {i} " + "é" * (i * 37 % 400) for i in range(60)), "\n\n\n\n  \n\n", "x" * 5000 + "\n\n" + "y" * 10, " \n\n" * 30 + "z" * 300]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.chunks(F.col("t"), 64).alias("c")).collect()
    assert all(r["c"] == chunks(r["t"], 256) for r in got)


def test_access(spark):
    keys = {("u", "1.2.3.4:5"): "user:u", (None, "1.2.3.4:5"): "ip:1.2.3.4", ("", "1.2.3.4"): "ip:1.2.3.4", (None, "[::1]:80"): "ip:::1", (None, "::1"): "ip:::1"}
    rows = spark.createDataFrame([(*k, v) for k, v in keys.items()], "u string, r string, want string")
    assert rows.where(access.rate_limit_key(F.col("u"), F.col("r")) != F.col("want")).count() == 0
    assert access.new_user_role(0, "readonly", None) == "admin" and access.new_user_role(3, "odd", "admin") == "readonly"
    users = spark.createDataFrame([], "id string, username string, password_hash string, role string, created_at long")
    tokens = spark.createDataFrame([], "id string, user_id string, name string, token_hash string, revoked boolean")
    sessions = spark.createDataFrame([], "token_hash string, user_id string, expires_at long")
    assert access.open_routes(spark.createDataFrame([("/v1/users",)], "path string"), users).first()["open"]
    users = access.create_user(users, "ann", "pw", "readonly", None)
    users = access.create_user(users, "bob", "pw2", "readonly", "admin")
    ann, bob = (r.asDict() for r in users.orderBy("username").collect())
    assert ann["role"] == "admin" and bob["role"] == "readonly" and access.check_password(bob["password_hash"], "pw2") and not access.check_password(bob["password_hash"], "pw")
    for bad in (lambda: access.create_user(users, "cat", "x", "admin", "readonly"), lambda: access.delete_user(users, tokens, sessions, ann["id"], ann["id"]), lambda: access.audit_list(users, "readonly")):
        with pytest.raises(access.Forbidden):
            bad()
    with pytest.raises(ValueError):
        access.create_user(users, "bob", "x", "admin", "admin")
    tokens, secret = access.create_token(tokens, bob["id"], "t")
    sessions, _ = access.create_session(sessions, bob["id"], 100, 50)
    assert access.authenticate(tokens, users, secret).first()["username"] == "bob" and access.live_sessions(sessions, F.lit(149)).count() == 1 and access.live_sessions(sessions, F.lit(150)).count() == 0
    token = tokens.first()["id"]
    with pytest.raises(access.Forbidden):
        access.revoke_token(tokens, token, "someone", "readonly")
    assert access.authenticate(access.revoke_token(tokens, token, bob["id"], "readonly"), users, secret).count() == 0
    left = access.delete_user(users, tokens, sessions, bob["id"], ann["id"])
    assert [x.count() for x in left] == [1, 0, 0]
    assert access.safe_path("/data", " a/b ") == "/data/a/b" and access.safe_path("/data", "") == "/data"
    for rel in ("/etc", "../x", "a/../b"):
        with pytest.raises(ValueError):
            access.safe_path("/data", rel)
    assert spark.range(1).select(F.crc32(F.encode(F.lit("term"), "UTF-8")).alias("c")).first()["c"] == zlib.crc32(b"term")


def test_files(spark, tmp_path):
    from tarn.sources import files

    for name, text in {"internal/store/a.go": "package store\n", "internal/store/a_test.go": "package store\n", "README.md": "# x", "vendor/y.go": "package y", "empty.md": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["metadata"]["path"]: (r["collection"], r["content_type"], r["metadata"]["package"], r["metadata"]["is_test"]) for r in files.project_tree(spark, str(tmp_path), "p").collect()}
    assert got == {"internal/store/a.go": ("p/store", "code", "store", "false"), "internal/store/a_test.go": ("p/store", "code", "store", "true"), "README.md": ("p", "doc", "", "false")}
    (tmp_path / "users.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert files.json_table(spark, str(tmp_path / "users.json"), "id string").count() == 2
    assert files.json_table(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_fillers_are_looked_for_between_stops(spark):
    """What holds no phrase is left alone: a long text with a few deep ones is settled in pieces, stops and line breaks staying where they are."""
    assert not any(c in p for p in X.FILLERS for c in ".\n")
    texts = ["in\n order to x", "in order. to. in order to\n\nin In Order To order to y. please note thatİ z", ".\n..\n", "in order to ", "a.\nbasically, .\n", None]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip_fillers(F.col("t")).alias("f")).collect()]
    assert got == [t if t is None else no_fillers(t) for t in texts]
    plan = str(spark.createDataFrame([("x",)], "t string").select(X.strip_fillers(F.col("t")))._jdf.queryExecution().optimizedPlan())
    assert "split(" in plan and plan.index("split(") < plan.index("regexp_replace")
