"""Repeated passages by a distributed, hash-compared suffix sort.

A word of a document is repeated if it lies in a run of ``length`` words that
stands elsewhere in the corpus too. Sorting the suffixes at every word would
shuffle many times the corpus, so suffixes are sorted at anchors: winnowing
(Schleimer et al., 2003) picks, in each run of ``length`` words, a run of
``k`` words of least hash, the same one wherever the run stands. Anchors whose
``k`` words occur once are dropped. Each of the others, with as much of its
document as a run through it can reach, goes to the partition of its hash.

There the suffixes that start at the anchors are sorted by merge sort.
Comparison is logarithmic: prefix polynomial hashes and binary search find the
longest common extension of two suffixes, then the next words decide.
Anchors whose surroundings are the same letter by letter mark each other
before, and one stands for them. Neighbours in suffix order that agree, with
what precedes them, on ``length`` words or more mark each other, once their words have been compared letter by
letter, for hashes may collide. Where neighbours do not settle a group, since
partners to the left differ from those to the right, every run of ``length``
words through its anchors is looked up in the group in the same way. Marks are
joined to passages at the end.

A partition holds what surrounds an anchor, so an anchor of more than ``hot``
occurrences is settled without one: every run of ``length`` words through it
goes out as two independent 64-bit hashes, equal ones are counted by an
aggregation that is combined before the shuffle, and joined back. That finds
the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut
from tarn.llm.textvec import Words, chunks, mix, powers


class Hashes:
    """Prefix polynomial hashes of a sequence of word ids: the hash of any run in constant time."""

    def __init__(self, ids: np.ndarray):
        self.prefix = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(ids * powers(len(ids)), out=self.prefix[1:])
        self.inverse = powers(len(ids) + 1, True)

    def run(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of the sequences from (or, with ``back``, up to) ``i`` and ``j``, by binary search."""
        low, high = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            a, b = (i - mid, j - mid) if back else (i, j)
            same = self.run(a, mid) == self.run(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of ``w`` values, by doubling; for len(x) - w + 1 starts."""
    done = 1
    while done * 2 <= w:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if done < w else x


def anchors(w: Words, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word position) of the anchors of a run of texts."""
    n, span = len(w.hash), length - k + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - k + 1)
    h = mix(Hashes(w.hash).run(at, k)) | np.uint64(1)
    least = _slide(h, span, np.minimum)
    last = np.repeat(w.first[1:], w.counts)
    least[np.arange(len(least)) + length > last[: len(least)]] = 0  # runs that cross into the next text
    padded = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    padded[span - 1 : span - 1 + len(least)] = least
    picked = np.flatnonzero(_slide(padded, span, np.maximum) == h)
    doc = np.searchsorted(w.first, picked, "right") - 1
    return h[picked], doc, picked - w.first[doc]


def _anchoring(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                h, doc, at = anchors(Words(texts[a:b]), k, length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:b][doc]), pa.array(at.astype(np.int32))], ["h", "doc", "at"])

    return run


def _surroundings(k: int, length: int):
    """Of each (doc, text, hashes): the anchors with such a hash and the words that a run through them can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                h, doc, at = anchors(w, k, length)
                part = lists.slice(a, b - a)
                wanted = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                hit = np.isin(mix(h + doc.astype(np.uint64)), mix(wanted + of.astype(np.uint64)))
                h, doc, at = h[hit], doc[hit], at[hit]
                word = w.first[doc] + at
                lo, hi = np.maximum(word - (length - k), w.first[doc]), np.minimum(word + length, w.first[doc + 1])
                slices = [w.joined[s:e] for s, e in zip(w.start[lo].tolist(), w.end[hi - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[a:b][doc]), pa.array(at.astype(np.int32)), pa.array((word - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(slices, pa.string())],
                    ["h", "doc", "at", "before", "size", "words"],
                )

    return run


def suffix_order(hashes: Hashes, ids: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows in suffix order within each group (groups are runs of equal values); equal suffixes keep their order.

    Bottom-up merge sort of all groups at once: in each pass every row finds its
    place in the neighbouring run by binary search.
    """
    n = len(start)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    base, room = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(n)
    place = np.arange(n) - base  # within the group, by sorted position

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix of row x comes before that of row y; equal ones as ``ties`` says."""
        i, j = start[x], start[y]
        most = np.minimum(end[x] - i, end[y] - j)
        l = hashes.extension(i, j, most)
        inside = l < most
        a, b = ids[np.where(inside, i + l, 0)], ids[np.where(inside, j + l, 0)]
        m, p = end[x] - i, end[y] - j
        return np.where(inside, a < b, np.where(m != p, m < p, ties))

    width = 1
    while width < (room.max() if n else 0):
        live = np.flatnonzero(room > width)
        p = place[live]
        run = p // width
        left = run % 2 == 0
        other = np.where(left, (run + 1) * width, (run - 1) * width)
        low = np.minimum(other, room[live])
        floor_ = low.copy()
        high = np.minimum(other + width, room[live])
        rows = order[live]
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) >> 1
            y = order[base[live[at]] + mid]
            # a row of the right run comes after equal ones of the left run
            before = less(y, rows[at], ~left[at])
            low[at] = np.where(before, mid + 1, low[at])
            high[at] = np.where(before, high[at], mid)
        to = base[live] + np.where(left, p, other + (p - run * width)) + (low - floor_)
        new = order.copy()
        new[to] = rows
        order = new
        width *= 2
    return order


def _equal_words(w: Words, cp: np.ndarray, compact: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, at_once: int = 100_000) -> np.ndarray:
    """Whether the runs of ``n`` words at x and y are the same, letter by letter; about ``at_once`` words at a time."""
    part = np.cumsum(n) // at_once
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(n)]
    if len(edges) > 2:
        return np.concatenate([_equal_words(w, cp, compact, x[a:b], y[a:b], n[a:b], int(n[a:b].sum()) + 1) for a, b in zip(edges[:-1], edges[1:])])

    def spread(a, b, count):
        total = int(count.sum())
        off = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(a, count) + off, np.repeat(b, count) + off, np.repeat(np.arange(len(count)), count)

    size = w.end - w.start
    same = np.ones(len(x), dtype=bool)
    a, b, of = spread(x, y, n)
    same[of[size[a] != size[b]]] = False
    good = np.flatnonzero(same)
    a, b, of = spread(compact[x[good]], compact[y[good]], compact[x[good] + n[good]] - compact[x[good]])
    same[good[of[cp[a] != cp[b]]]] = False
    return same


def match(
    texts: list, before: np.ndarray, group: np.ndarray, whole: np.ndarray, k: int, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner row, words back from the anchor, words on from it) of the repeated runs among rows sorted by group.

    ``whole`` rows are known to be repeated from end to end.
    """
    w = Words(texts)
    ids, hashes = w.hash, Hashes(w.hash)
    all_cp = np.frombuffer(w.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = w.end - w.start
    compact = np.r_[0, np.cumsum(size)]
    cp = all_cp[np.repeat(w.start - compact[:-1], size) + np.arange(compact[-1])]
    lo, hi = w.first[:-1], w.first[1:]
    start = lo + before
    order = suffix_order(hashes, ids, start, hi, group)
    x, y = order[:-1], order[1:]
    near = group[x] == group[y]
    x, y = x[near], y[near]
    right = hashes.extension(start[x], start[y], np.minimum(hi[x] - start[x], hi[y] - start[y]))
    left = hashes.extension(start[x], start[y], np.minimum(before[x], before[y]), back=True)
    good = left + right >= length
    x, y, left, right = x[good], y[good], left[good], right[good]
    good = _equal_words(w, cp, compact, start[x] - left, start[y] - left, left + right)
    x, y, left, right = x[good], y[good], left[good], right[good]
    out = [np.r_[x, y], np.r_[y, x], np.r_[left, left], np.r_[right, right]]
    # what the neighbours cover of each row; where that is not all, the group is looked up run by run
    far_left, far_right = np.where(whole, before, 0), np.where(whole, hi - start, 0)
    np.maximum.at(far_left, out[0], out[2])
    np.maximum.at(far_right, out[0], out[3])
    done = (far_left == before) & (far_right == hi - start)
    counts = np.bincount(group)
    rows = np.flatnonzero(np.isin(group, group[~done & (counts[group] > 1)]))
    back = np.arange(length - k + 1)
    r, back = np.repeat(rows, len(back)), np.tile(back, len(rows))
    at = start[r] - back
    inside = (back <= before[r]) & (at + length <= hi[r])
    r, back, at = r[inside], back[inside], at[inside]
    # each run is compared with the run before it in a sort by (group, place, hash): equal ones stand together
    value = mix(mix(hashes.run(at, length)) + group[r].astype(np.uint64) * np.uint64(64) + back.astype(np.uint64))
    s = np.argsort(value, kind="stable")
    r, back, at, value = r[s], back[s], at[s], value[s]
    pair = np.flatnonzero(value[1:] == value[:-1])
    if len(pair):
        good = (group[r[pair]] == group[r[pair + 1]]) & (back[pair] == back[pair + 1])
        covered = (back <= far_left[r]) & (length - back <= far_right[r])
        good &= ~(covered[pair] & covered[pair + 1])
        pair = pair[good]
        pair = pair[_equal_words(w, cp, compact, at[pair], at[pair + 1], np.full(len(pair), length))]
        a, b, n = r[pair], r[pair + 1], back[pair]
        for i, more in enumerate((np.r_[a, b], np.r_[b, a], np.r_[n, n], np.r_[length - n, length - n])):
            out[i] = np.r_[out[i], more]
    return tuple(out)


def _runs(k: int, length: int):
    """Of each (doc, text, hashes): two hashes and the start of every run of ``length`` words through an anchor with such a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                h, doc, at = anchors(w, k, length)
                part = lists.slice(a, b - a)
                wanted = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                hit = np.isin(mix(h + doc.astype(np.uint64)), mix(wanted + of.astype(np.uint64)))
                doc, word = doc[hit], (w.first[doc] + at)[hit]
                back = np.arange(length - k + 1)
                start, doc = (word[:, None] - back).reshape(-1), np.repeat(doc, len(back))
                inside = (start >= w.first[doc]) & (start + length <= w.first[doc + 1])
                start, which = np.unique(start[inside], return_index=True)
                doc = doc[inside][which]
                keys = [mix(Hashes(x).run(start, length)) for x in (w.hash, mix(w.hash ^ np.uint64(0x5EC0)))]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in keys), pa.array(ids[a:b][doc]), pa.array((start - w.first[doc]).astype(np.int64))], ["k1", "k2", "doc", "lo"]
                )

    return run


def _matching(k: int, length: int, rows_at_once: int = 4000):
    """Streams rows sorted by hash. Rows of a group with the very same words mark each other
    as they pass, and one of them is held; groups that hold several are matched, small ones together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: tuple[list, list, list, list] = ([], [], [], [])
        held: list[tuple] = []  # (group, words, doc, at, before, several)
        here: dict[str, list] = {}  # words -> [doc, at, before, size, several, in several documents] in the group that passes
        last, groups = None, 0

        def mark(doc: int, lo: int, hi: int, other: int) -> None:
            for column, value in zip(marks, (doc, lo, hi, other)):
                column.append(value)

        def close() -> None:
            nonlocal groups
            if len(here) > 1:
                held.extend((groups, words, x[0], x[1], x[2], x[4]) for words, x in here.items())
                groups += 1
            here.clear()

        def settle() -> pa.RecordBatch:
            cols = [np.array(m, dtype=np.int64) for m in marks]
            if held:
                group, texts, doc, at, before, several = zip(*held)
                doc, at, before = np.array(doc), np.array(at), np.array(before)
                row, partner, left, right = match(list(texts), before, np.array(group), np.array(several), k, length)
                more = (doc[row], at[row] - left, at[row] + right, doc[partner])
                cols = [np.r_[a, b] for a, b in zip(cols, more)]
            for m in marks:
                m.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["doc", "lo", "hi", "other"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for h, doc, at, before, size, words in zip(*columns):
                if h != last:
                    close()
                    last = h
                    if len(held) >= rows_at_once or len(marks[0]) >= 100_000:
                        groups = 0
                        yield settle()
                first = here.get(words)
                if first is None:
                    here[words] = [doc, at, before, size, False, False]
                    continue
                mark(doc, at - before, at - before + size, first[0])
                if not first[4] or not first[5] and doc != first[0]:
                    first[4], first[5] = True, doc != first[0]
                    mark(first[0], first[1] - first[2], first[1] - first[2] + first[3], doc)
        close()
        yield settle()

    return run


def repeated_passages(docs: DataFrame, length: int = 50, k: int = 20, hot: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_ids): the maximal runs of repeated words of each document.

    Positions count words (runs of letters and digits, without case) from 0,
    and ``end_word`` is exclusive. ``other_ids`` lists documents, sorted, that
    share part of the passage: for each anchor in it, the neighbours in suffix
    order, where one stands for those whose surroundings are the same; the
    document itself is among them if it repeats itself. Of an anchor that
    occurs more than ``hot`` times, one document stands for all that share a run.

    Rows that share an id are one document, whose text is the one that sorts
    first. Rows without an id or text, and texts of fewer than ``length``
    words, have no passage. An empty table gives an empty result; other columns
    are not looked at. Texts are taken whole, about a million characters at a
    time; a longer one is a batch of its own, at some 80 bytes a character.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    # anchors are made twice, which costs less than keeping them
    found = rows.mapInArrow(_anchoring(k, length), "h long, doc long, at int")
    several = cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))

    def texts_with(kind: DataFrame) -> DataFrame:
        wanted = found.join(kind.select("h"), "h").groupBy("doc").agg(F.collect_set("h").alias("hs"))
        return rows.join(wanted, "doc").groupBy("doc").agg(F.min("text").alias("text"), F.first("hs").alias("hs")).select("doc", "text", "hs")

    around = texts_with(several.where(F.col("n") <= hot)).mapInArrow(_surroundings(k, length), "h long, doc long, at int, before int, size int, words string")
    marks = around.repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(_matching(k, length), "doc long, lo long, hi long, other long")
    if not several.where(F.col("n") > hot).isEmpty():
        runs = cut(texts_with(several.where(F.col("n") > hot)).mapInArrow(_runs(k, length), "k1 long, k2 long, doc long, lo long"))
        shared = runs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z")).where("n > 1")
        other = F.when(F.col("a") != F.col("doc"), F.col("a")).otherwise(F.col("z"))
        marks = marks.union(runs.join(shared, ["k1", "k2"]).select("doc", "lo", (F.col("lo") + length).alias("hi"), other))
    marks = marks.groupBy("doc", "lo", "hi").agg(F.collect_set("other").alias("others"))
    order = Window.partitionBy("doc").orderBy("lo", "hi")
    new = F.when(F.col("lo") <= F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    passage = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = marks.withColumn("new", new).withColumn("passage", passage).groupBy("doc", "passage").agg(
        F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("other_ids")
    )
    return joined.select(F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_ids")
