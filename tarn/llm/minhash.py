"""Near-duplicate groups by fast similarity sketching.

The sketch is that of Dahlgaard, Knudsen and Thorup (2017): in round ``i`` each
shingle is placed by a fresh hash into one of ``t`` bins with a value that
starts with ``i``; after ``t`` rounds, round ``t + j`` places every shingle in
bin ``j``. Each bin keeps its least value. Thus all ``t`` coordinates fill
after at most ``2 t`` rounds, most texts need few, and estimates concentrate
as if the coordinates were independent.

Candidates share a band of ``rows`` coordinates. Within a band's bucket each
document is compared with the least one; then, where a bucket still holds
documents of several groups, all pairs across those groups are compared. That
gives the same groups as comparing all pairs of every bucket, and copies by
the thousand cost one comparison each. Comparison is the exact Jaccard
similarity of the sets of ``k``-word shingles. What a bucket or group has in
common is found by an aggregation, combined before the shuffle, and joined
back: a hot one is never a single task's to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import connected_components, cut, list_array
from tarn.llm.textvec import Words, chunks, mix, shingles

GOLDEN = 0x9E3779B97F4A7C15


def sketch(ids: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """Sketches (texts x t) of texts given their shingle ids; rows of texts without shingles are all ones.

    The number of the round takes as many of a value's high bits as ``2 t`` has.
    """
    docs, low = len(counts), 64 - (2 * t).bit_length()
    bins = np.full(docs * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(docs), counts)
    empty = np.iinfo(np.uint64).max
    for i in range(2 * t):
        h = mix(ids + np.uint64((i + 1) * GOLDEN % (1 << 64)))
        where = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        value = np.uint64(i << low) | (mix(h) >> np.uint64(64 - low))
        np.minimum.at(bins, doc * t + where, value)
        open_ = (bins.reshape(docs, t) == empty).any(axis=1)
        open_ &= counts > 0
        if not open_.any():
            break
        keep = open_[doc]
        ids, doc = ids[keep], doc[keep]
    return bins.reshape(docs, t)


def _bands(texts: list, k: int, bands: int, rows: int) -> np.ndarray:
    w = Words(texts)
    ids, counts = shingles(w, k)
    s = sketch(ids, counts, bands * rows).reshape(len(texts), bands, rows)
    out = np.zeros((len(texts), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out ^ s[:, :, r])
    out ^= mix(np.arange(1, bands + 1, dtype=np.uint64))
    out[counts == 0] = 0
    return out


def _banding(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                keys = _bands(texts[a:b], k, bands, rows)
                some = np.flatnonzero(keys.any(axis=1))
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[a:b][some], bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some].reshape(-1).view(np.int64)), pa.array(ids, type=pa.int64())], ["key", "doc"]
                )

    return run


def _verifying(k: int, threshold: float):
    """Streams rows sorted by (grp, salt, member): the leader, then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, None
        for batch in batches:
            texts = batch.column(4).to_pylist()
            grp, salt, member, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for a, b in chunks(texts):
                ids, counts = shingles(Words(texts[a:b]), k)
                at = np.concatenate([[0], np.cumsum(counts)])
                found: list[tuple[int, int, float]] = []
                for i in range(b - a):
                    mine = np.unique(ids[at[i] : at[i + 1]])
                    j = a + i
                    if not member[j]:
                        leader, held = (grp[j], salt[j]), mine
                    elif leader == (grp[j], salt[j]):
                        both = len(np.intersect1d(held, mine, assume_unique=True))
                        either = len(held) + len(mine) - both
                        if either and both >= threshold * either:
                            found.append((int(grp[j]), int(doc[j]), both / either))
                x = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.float64())],
                    ["a", "b", "jaccard"],
                )

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, most: int = 256) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) whose exact similarity is at least ``threshold``.

    Partners of ``a`` are spread by a salt over groups of about ``most``, each
    with its own copy of the text of ``a``, and stream past it.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("salts"))
    member = pairs.join(n, "a").select(
        F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("doc")
    )
    lead = n.select(
        F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("doc")
    )
    rows = member.union(lead).join(texts, "doc").select("grp", "salt", "member", "doc", "text")
    return (
        rows.repartition("grp", "salt")
        .sortWithinPartitions("grp", "salt", "member", "doc")
        .mapInArrow(_verifying(k, threshold), "a long, b long, jaccard double")
    )


def near_duplicates(
    docs: DataFrame, k: int = 3, bands: int = 32, rows: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, keep_id, n_group): every document of a near-duplicate group but the least, the one to keep.

    Rows that share an id are one document; the text compared is the one that
    sorts first. Rows without an id, and null or wordless texts, are in no group. A text of fewer than ``k`` words
    has one shingle, of all its words. Ties go to the least id. An empty table
    gives an empty result; columns other than the two named are not looked at.
    Texts are taken whole, about a million characters at a time; a longer one
    is a batch of its own, at some 60 bytes a character.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where(
        "doc IS NOT NULL AND text IS NOT NULL"
    )
    keys = cut(texts.mapInArrow(_banding(k, bands, rows), "key long, doc long"))
    several = keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("key", "a")
    shared = cut(keys.join(several, "key").select("key", "doc", "a"))
    wanted = shared.select("doc").distinct()
    held = cut(texts.join(wanted, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")))
    first = shared.where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    edges = cut(verify(first, held, k, threshold))
    comps = connected_components(edges.select("a", "b"))
    rest = shared.join(comps.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    rest = cut(rest)
    open_ = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = cut(rest.join(open_, "key", "left_semi"))
    left, right = rest.select("key", F.col("doc").alias("a"), F.col("root").alias("ra")), rest.select("key", F.col("doc").alias("b"), F.col("root").alias("rb"))
    across = (
        left.join(right, "key").where("a < b AND ra <> rb").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    )
    more = verify(across, held, k, threshold)
    comps = connected_components(edges.unionByName(more).select("a", "b"))
    sizes = comps.groupBy("root").agg(F.count("*").alias("n_group"))
    return comps.where("node <> root").join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"), "n_group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` gives.

    Rows without an id, null and wordless texts stay, and so do all rows that
    share the id of a document kept; an empty table stays empty, and other
    columns, clashing names included, are as they were.
    """
    gone = near_duplicates(docs, id_col=id_col, **options).select(F.col("doc_id").alias("gone_"))
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_"], "left_anti")
