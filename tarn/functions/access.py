"""Access predicates, user tables and the audit of calls: the service shell, as columns and joins."""

from __future__ import annotations

import hashlib
import json
import posixpath
import secrets
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import truncated

PUBLIC = ("/v1/health", "/v1/auth/status", "/v1/auth/login", "/v1/auth/logout")
READER_POSTS = ("/v1/search", "/v1/auth/login", "/v1/auth/logout")
ROLES = ("admin", "readonly")


class Forbidden(PermissionError):
    """The caller may not do this."""


# predicates


def permitted(role: Column, method: Column, path: Column) -> Column:
    """Admins may do everything, readers only read, search, log in and out."""
    return (role == "admin") | (method == "GET") | ((method == "POST") & path.isin(*READER_POSTS))


def user_count(users: DataFrame) -> DataFrame:
    """One row: n_users."""
    return users.agg(F.count("*").alias("n_users"))


def open_routes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (path, ...) with ``open``: whether the route needs no user, as public ones do not, and none does while there are no users."""
    rows = requests.crossJoin(F.broadcast(user_count(users)))
    return rows.withColumn("open", (F.col("n_users") == 0) | F.col("path").isin(*PUBLIC)).drop("n_users")


def rate_limit_key(user_id: Column, remote: Column) -> Column:
    """``user:`` and the id of a known user, else ``ip:`` and the host of the remote address, without its port if it has one."""
    host = F.coalesce(F.nullif(F.regexp_extract(remote, "^\\[([^\\]]*)\\]:[^:]*$", 1), F.lit("")), F.nullif(F.regexp_extract(remote, "^([^:\\[\\]]*):[^:]*$", 1), F.lit("")), remote)
    return F.when(F.coalesce(user_id, F.lit("")) != "", F.concat(F.lit("user:"), user_id)).otherwise(F.concat(F.lit("ip:"), host))


def new_user_role(n_users: int, wanted: str, caller_role: str | None) -> str:
    """The role that a user is made with: the first is an admin, later ones only an admin can make; an unknown role is ``readonly``."""
    if n_users == 0:
        return "admin"
    if caller_role != "admin":
        raise Forbidden("admin required")
    return wanted if wanted in ROLES else "readonly"


# tables of users, tokens and sessions


def hash_secret(secret: str) -> str:
    return hashlib.sha256(secret.encode()).hexdigest()


def new_secret(prefix: str = "tarn_") -> str:
    """A token of 20 random bytes, in hexadecimal digits."""
    return prefix + secrets.token_hex(20)


def _row(like: DataFrame, **values) -> DataFrame:
    fields = {f.name: F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema.fields}
    return like.sparkSession.range(1).select(*fields.values())


def create_user(users: DataFrame, username: str, password: str, role: str, caller_role: str | None, now: int | None = None) -> DataFrame:
    """``users`` (id, username, password_hash, role, created_at) and a new one; a name is taken only once."""
    if not username or not password:
        raise ValueError("username and password required")
    role = new_user_role(users.count(), role, caller_role)
    if not users.where(F.col("username") == username).isEmpty():
        raise ValueError("username already exists")
    salt = secrets.token_hex(8)
    digest = salt + ":" + hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), 100_000).hex()
    return users.unionByName(_row(users, id=str(uuid.uuid4()), username=username, password_hash=digest, role=role, created_at=int(now if now is not None else time.time())))


def check_password(stored: str, password: str) -> bool:
    salt, _, digest = stored.partition(":")
    return secrets.compare_digest(digest, hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), 100_000).hex())


def create_token(tokens: DataFrame, user_id: str, name: str) -> tuple[DataFrame, str]:
    """``tokens`` (id, user_id, name, token_hash, revoked) and a new one, with its secret, which is not kept."""
    secret = new_secret()
    return tokens.unionByName(_row(tokens, id=str(uuid.uuid4()), user_id=user_id, name=name, token_hash=hash_secret(secret), revoked=False)), secret


def revoke_token(tokens: DataFrame, token_id: str, caller_id: str, caller_role: str) -> DataFrame:
    """``tokens`` with one revoked; only its owner or an admin may."""
    owner = tokens.where(F.col("id") == token_id).select("user_id").first()
    if owner is None:
        raise KeyError(token_id)
    if caller_role != "admin" and owner[0] != caller_id:
        raise Forbidden("forbidden")
    return tokens.withColumn("revoked", F.col("revoked") | (F.col("id") == token_id))


def create_session(sessions: DataFrame, user_id: str, now: int, seconds: int) -> tuple[DataFrame, str]:
    secret = new_secret()
    return sessions.unionByName(_row(sessions, token_hash=hash_secret(secret), user_id=user_id, expires_at=now + seconds)), secret


def authenticate(tokens: DataFrame, users: DataFrame, secret: str) -> DataFrame:
    """The user of an active token."""
    hit = tokens.where((F.col("token_hash") == F.lit(hash_secret(secret))) & ~F.coalesce(F.col("revoked"), F.lit(False)))
    return hit.select("user_id").join(users, hit["user_id"] == users["id"]).select(users["*"])


def delete_user(users: DataFrame, tokens: DataFrame, sessions: DataFrame, user_id: str, caller_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a user, its tokens and its sessions; nobody deletes themselves."""
    if caller_id is not None and caller_id == user_id:
        raise Forbidden("cannot delete yourself")
    return users.where(F.col("id") != user_id), tokens.where(F.col("user_id") != user_id), sessions.where(F.col("user_id") != user_id)


def public_users(users: DataFrame) -> DataFrame:
    return users.drop("password_hash")


def public_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens without their hashes; ``active`` unless revoked."""
    return tokens.withColumn("active", ~F.coalesce(F.col("revoked"), F.lit(False))).drop("token_hash", "revoked")


def live_sessions(sessions: DataFrame, now: Column | None = None) -> DataFrame:
    return sessions.where(F.col("expires_at") > (F.current_timestamp() if now is None else now))


# audit


def call_rows(calls: DataFrame) -> DataFrame:
    """Rows of the audit log from (seq, tool, request, response, failed, duration_ms): status, outcome, and bodies cut to their limit."""
    return calls.select(
        "seq", F.lit("mcp").alias("channel"), "tool", "duration_ms", F.when(F.col("failed"), 500).otherwise(200).alias("status"), (~F.col("failed")).alias("ok"),
        truncated(F.col("request")).alias("request"), truncated(F.col("response")).alias("response"),
    )


def audit_list(calls: DataFrame, caller_role: str, limit: int = 100, seq: str = "seq") -> DataFrame:
    """Newest calls first, for admins only; the limit is 100 if not positive or above 500."""
    if caller_role != "admin":
        raise Forbidden("admin required")
    return calls.orderBy(F.desc(seq)).limit(limit if 0 < limit <= 500 else 100)


class CallLog:
    """Calls made through it, as plain rows; the newest ``most`` are kept."""

    def __init__(self, most: int = 500, most_characters: int = 32_768):
        self.rows: list[dict] = []
        self.most, self.most_characters = most, most_characters

    def _cut(self, text: str) -> str:
        return text if len(text) <= self.most_characters else text[: self.most_characters] + "…(truncated)"

    def record(self, tool: str, f, **arguments):
        """``f(**arguments)``, written down with its time, arguments and outcome, an error too."""
        began, failed, said = time.time(), False, ""
        try:
            out = f(**arguments)
            said = json.dumps(out, default=str)
            return out
        except Exception as e:
            failed, said = True, f"transport: {e}"
            raise
        finally:
            row = {"id": str(uuid.uuid4()), "ts": began, "duration_ms": int((time.time() - began) * 1000), "channel": "mcp", "tool": tool, "status": 500 if failed else 200, "ok": not failed}
            self.rows = [*self.rows, row | {"request": self._cut(json.dumps(arguments, default=str)), "response": self._cut(said)}][-self.most :]

    def newest(self, limit: int = 100) -> list[dict]:
        return self.rows[::-1][: limit if limit > 0 else 100]


# paths and snippets


def safe_path(root: str, rel: str) -> str:
    """A path below ``root``: neither absolute nor with parent segments; the root itself if it is empty."""
    root, rel = posixpath.normpath(root), rel.strip()
    if not root or root == ".":
        raise ValueError("invalid data root")
    if rel in ("", "."):
        return root
    if rel.startswith("/") or ".." in rel:
        raise ValueError("path must be relative and without parent segments")
    return posixpath.normpath(posixpath.join(root, rel))


def snippet(place: Column, id_: Column, collection: Column, score: Column, summary: Column, most: int = 240) -> Column:
    """A line on a hit for a prompt, its summary cut to ``most`` characters."""
    s = F.coalesce(summary, F.lit(""))
    cut = F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)
    return F.concat(place.cast("string"), F.lit(". id="), id_, F.lit(" collection="), F.coalesce(collection, F.lit("")), F.lit(" score="), score.cast("string"), F.lit(" — "), cut)
