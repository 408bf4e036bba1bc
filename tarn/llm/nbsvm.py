"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of word and two-word n-grams, where runs of symbols
are words too and a word that stands three times in a row also counts as the
feature "repeat". An indicator is scaled by its class log-count ratio, and a
linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent (Hsieh et al., 2008). Two heads are fitted on one sample,
``quality`` and ``toxic``.

Fitting uses a bounded sample of labelled rows, at most ``per_class`` of each
pair of labels; scoring covers every document and needs no shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, list_array
from tarn.llm.textvec import Words, chunks, mix

REPEAT = np.uint64(0x5EED0FACADE)
HEADS = ("quality", "toxic")


@dataclass
class Model:
    """Sorted feature ids, their weights (features x heads) and the biases; no features if nothing could be fitted."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    gaps: tuple[float, float] = (0.0, 0.0)  # duality gap of each head's fit, as a share of its primal value

    def table(self, bits: int = 22) -> np.ndarray:
        """Feature positions by the low bits of the id, in as many columns as the fullest slot needs; -1 if none."""
        slot = (self.keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        nth = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        out = np.full((int(nth.max(initial=0)) + 1, 1 << bits), -1, dtype=np.int32)
        out[nth, slot[order]] = order
        return out


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids, text of each), not yet unique within a text."""
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    pair = mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    same = doc[:-1] == doc[1:]
    equal = same & (w.hash[:-1] == w.hash[1:])
    again = np.append(equal[:-1] & equal[1:], False)[: len(equal)]
    return (
        np.concatenate([w.hash, pair[same], np.full(int(again.sum()), REPEAT)]),
        np.concatenate([doc, doc[:-1][same], doc[:-1][again]]),
    )


def score(texts: list, model: Model, table: np.ndarray) -> np.ndarray:
    """Scores (texts x heads)."""
    out = np.tile(model.bias, (len(texts), 1))
    low = np.uint64(table.shape[1] - 1)
    for a, b in chunks(texts):
        ids, doc = features(Words(texts[a:b], symbols=True))
        slot = (ids & low).astype(np.int64)
        for row in table:
            at = row[slot]
            hit = np.flatnonzero(at >= 0)
            hit = hit[model.keys[at[hit]] == ids[hit]]
            seen = np.unique(doc[hit] * len(model.keys) + at[hit])
            where, which = np.divmod(seen, max(1, len(model.keys)))
            for h in range(out.shape[1]):
                out[a:b, h] += np.bincount(where, model.weights[which, h], minlength=b - a)
    return out


def dual_descent(rows: list, values: list, y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 500, tol: float = 1e-2):
    """(weights, bias, relative duality gap) of the L1-loss linear SVM; the bias is the weight of a constant feature.

    Epochs go on until the duality gap is at most ``tol`` of the primal value;
    if ``epochs`` do not get there, a warning says so.
    """
    w = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    rows = [np.append(r, width) for r in rows]
    values = [np.append(v, 1.0) for v in values]
    norm = np.array([v @ v for v in values])
    rng = np.random.default_rng(7)
    gap = 0.0
    for epoch in range(epochs if len(rows) else 0):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v) - 1.0
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            w[r] += (new - alpha[i]) * y[i] * v
            alpha[i] = new
        if epoch < 8 or epoch % 4 == 0 or epoch == epochs - 1:
            size = w @ w / 2
            loss = sum(c * max(0.0, 1.0 - t * (w[r] @ v)) for r, v, t, c in zip(rows, values, y, cost))
            gap = float((2 * size + loss - alpha.sum()) / (size + loss))
            if gap <= tol:
                break
    if gap > tol:
        warnings.warn(f"dual coordinate descent stopped after {epochs} epochs at a duality gap of {gap:.3f}", stacklevel=2)
    return w[:-1], w[-1], gap


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts):
            ids, doc = features(Words(texts[a:b], symbols=True))
            order = np.lexsort((ids, doc))
            ids, doc = ids[order], doc[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
            counts = np.bincount(doc[new], minlength=b - a)
            cols = [list_array(pa.array(ids[new].view(np.int64)), counts), *(batch.column(i).slice(a, b - a) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(cols, ["ids", *HEADS])


def _selecting(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ids = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
            hit = keys[at] == ids
            counts = np.bincount(doc[hit], minlength=len(lists))
            yield pa.RecordBatch.from_arrays([list_array(pa.array(at[hit].astype(np.int32)), counts), batch.column(1), batch.column(2)], ["at", *HEADS])

    return run


def _gain(pos, neg, n_pos, n_neg):
    """The G statistic of a feature's presence against a class."""
    def part(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))

    df, n = pos + neg, n_pos + n_neg
    return 2 * (
        part(pos, df * n_pos / n) + part(neg, df * n_neg / n) + part(n_pos - pos, (n - df) * n_pos / n) + part(n_neg - neg, (n - df) * n_neg / n)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    min_df: int = 5,
    min_gain: float = 20.0,
    alpha: float = 1.0,
    cost: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on at most ``per_class`` labelled documents of each (quality, toxic) pair, those of least hashed id.

    Labels with a null are not used; of several rows for a document the least
    is. Features in fewer than ``min_df`` sampled documents, or with a G
    statistic under ``min_gain`` for a head, are not used for that head; all
    others are, and their number is bounded by the words of the sample. A head
    without both classes scores 0. Null texts are not fitted on; an empty table
    or no usable label gives a model that scores 0.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id_")).agg(
        F.min(F.struct("quality", "toxic")).alias("l")
    ).select("id_", (F.col("l.quality") > 0).cast("int").alias("quality"), (F.col("l.toxic") > 0).cast("int").alias("toxic"))
    nth = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.xxhash64(F.lit(7), "id_"), "id_"))
    picked = known.withColumn("nth", nth).where(F.col("nth") <= per_class).drop("nth")  # at most 4 * per_class rows
    texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text"))
    # texts of the sample only; one row for each id
    sample = texts.where("text IS NOT NULL").join(F.broadcast(picked), "id_").groupBy("id_").agg(
        F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")
    )
    rows = cut(sample.select("text", *HEADS).mapInArrow(_featurise, "ids array<bigint>, quality int, toxic int"))
    n, *ones = rows.agg(F.count("*"), *(F.coalesce(F.sum(h), F.lit(0)) for h in HEADS)).first()
    counts = rows.select(F.explode("ids").alias("id"), *HEADS).groupBy("id").agg(F.count("*").alias("df"), *(F.sum(h).alias(h) for h in HEADS)).where(F.col("df") >= min_df)
    usable = [(h, p) for h, p in zip(HEADS, ones) if 0 < p < n]
    none = Model(np.zeros(0, dtype=np.uint64), np.zeros((0, 2)), np.zeros(2))
    if not usable:
        return none
    gains = [_gain(F.col(h).cast("double"), (F.col("df") - F.col(h)).cast("double"), F.lit(float(p)), F.lit(float(n - p))).alias(f"g_{h}") for h, p in usable]
    best = counts.select("id", "df", *HEADS, *gains)
    top = F.greatest(*(F.col(f"g_{h}") for h, _ in usable)) if len(usable) > 1 else F.col(f"g_{usable[0][0]}")
    chosen = best.where(top >= min_gain).toPandas()
    if chosen.empty:
        return none
    keys = chosen["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    chosen, keys = chosen.iloc[order], keys[order]
    data = rows.mapInArrow(_selecting(keys), "at array<int>, quality int, toxic int").toPandas()
    weights, bias, gaps = np.zeros((len(keys), 2)), np.zeros(2), [0.0, 0.0]
    for h, p in usable:
        hits = chosen[h].to_numpy(float)
        pos, neg = alpha + hits, alpha + chosen["df"].to_numpy(float) - hits
        ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
        ratio[chosen[f"g_{h}"].to_numpy() < min_gain] = 0.0
        y = np.where(data[h].to_numpy() > 0, 1.0, -1.0)
        each = np.where(y > 0, cost * n / (2 * p), cost * n / (2 * (n - p)))
        at = [np.asarray(r, dtype=np.int64) for r in data["at"]]
        at = [r[ratio[r] != 0] for r in at]
        w, b, gaps[HEADS.index(h)] = dual_descent(at, [ratio[r] for r in at], y, each, len(keys))
        weights[:, HEADS.index(h)], bias[HEADS.index(h)] = w * ratio, b
    return Model(keys, weights, bias, tuple(gaps))


def _judge(texts: list, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = score(texts, model, table)
    keep = (s[:, 0] >= 0) & (s[:, 1] <= 0)
    keep &= np.fromiter((bool(t and t.strip()) for t in texts), dtype=bool, count=len(texts))
    return s, keep


def _scoring(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            s, keep = _judge(batch.column(1).to_pylist(), model, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"]
            )

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) for every row, repeated rows and null ids included.

    ``keep`` holds if the quality score is at least 0 and the toxic score at
    most 0; null and blank texts are not kept. An empty table gives no rows.
    Texts are scored whole, about a million characters at a time, a longer one
    by itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scoring(model), "doc_id long, quality_score double, toxic_score double, keep boolean")


def _filtering(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            yield batch.filter(pa.array(_judge(batch.column(at).to_pylist(), model, table)[1]))

    return run


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns, whatever their names.

    Repeated rows and null ids are judged by their text as any other; null and
    blank texts go; an empty table stays empty.
    """
    return docs.mapInArrow(_filtering(model, docs.columns.index(text_col)), docs.schema)
