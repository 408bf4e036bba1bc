"""Vectorised words and shingles: whole batches of texts as numpy arrays.

A word is a maximal run of letters and digits of the lower-cased text. Word
ids are 64-bit: differences of prefix polynomial hashes, then mixed, so that
no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def _alnum() -> np.ndarray:
    if "alnum" not in _cache:
        _cache["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _cache["alnum"]


def _classes() -> np.ndarray:
    """0 for white space and NUL, 1 for letters and digits, 2 for all else."""
    if "classes" not in _cache:
        blank = np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)
        x = np.where(_alnum(), 1, np.where(blank, 0, 2)).astype(np.int8)
        x[0] = 0
        _cache["classes"] = x
    return _cache["classes"]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = "inverse" if inverse else "powers"
    if len(_cache.get(key, ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        x = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        x[0] = 1
        _cache[key] = np.multiply.accumulate(x)
    return _cache[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list, limit: int = 1 << 20):
    """(first, last + 1) of runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of a run of texts: ``hash``, ``start``, ``end`` of each, ``counts`` by text.

    Offsets are into ``joined``, the lower-cased texts separated by NUL. With
    ``symbols``, runs of characters that are neither alphanumeric nor white
    space are words too.
    """

    __slots__ = ("joined", "hash", "start", "end", "counts", "first", "prefix")

    def __init__(self, texts: list, symbols: bool = False):
        parts = [t.lower() if t else "" for t in texts]
        self.joined = "\x00".join(parts)
        cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(cp)
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = (_classes() if symbols else _alnum())[cp]
        edge = np.diff(inside) != 0
        self.start = np.flatnonzero(edge & (inside[1:] != 0))
        self.end = np.flatnonzero(edge & (inside[:-1] != 0))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(cp * powers(n), out=prefix[1:])
        self.prefix = prefix
        self.hash = self._ids(self.start, self.end)
        bounds = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)


    def _ids(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * powers(len(self.prefix), True)[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def heads(self, at: np.ndarray, n: int) -> np.ndarray:
        """Ids of the first ``n`` characters of the words ``at``, as of a word of its own."""
        return self._ids(self.start[at], self.start[at] + n)


def word_ids(words: list[str]) -> np.ndarray:
    """Ids of single words, as ``Words`` would give them."""
    return Words([" ".join(words)]).hash if words else np.zeros(0, dtype=np.uint64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts by text) of the runs of ``k`` words; a text of fewer words has one, of all its words."""
    n = len(w.hash)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    last = np.repeat(w.first[1:], w.counts)
    total = np.zeros(n, dtype=np.uint64)
    at = np.arange(n)
    for j in range(k):
        if j == 0:
            total += w.hash * mult[0]
        else:
            part = np.zeros(n, dtype=np.uint64)
            part[: n - j] = w.hash[j:] * mult[j]
            part[at + j >= last] = 0
            total += part
    whole = (at + k <= last) | ((at == np.repeat(w.first[:-1], w.counts)) & (np.repeat(w.counts, w.counts) < k))
    return mix(total[whole]), np.bincount(doc[whole], minlength=len(w.counts))
