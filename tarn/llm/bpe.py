"""Byte-pair encoding by a streaming transducer of bounded lookahead, and incremental decoding.

Merges can let the right context of a token change it, but only so far: a
change of context moves left through overlapping merges of ever later rank.
``sufficient_lookahead`` bounds the length of any such chain for a merge list,
after Berglund and van der Merwe (2023). A token whose end lies at least that
far before the end of what has been read is stable: the transducer emits it
and forgets its bytes, so memory is constant however long the input.

Texts are first split into pieces by the tokenizer's pattern, across which
nothing merges; the end of a piece makes all of its tokens stable. Encoded
pieces are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import list_array

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id, which is also the merge's rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes beyond a token's end after which nothing can change it.

    ``reach[r]`` bounds how far to the right of the left end of merge ``r`` the
    cause of its being made or not can lie: a chain goes on with an earlier
    merge that overlaps ``r`` on the right or lies within it.
    """
    reach: dict[bytes, int] = {}
    best: dict[bytes, int] = {}  # by prefix of earlier merges
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        far = n = len(token)
        for o in range(1, n):
            far = max(far, o + best.get(token[o:], 0))
            for e in range(o + 2, n):
                far = max(far, o + reach.get(token[o:e], 0))
        reach[token] = far
        for e in range(1, n + 1):
            if best.get(token[:e], 0) < far:
                best[token[:e]] = far
    return max(reach.values(), default=1)


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece, by repeated search for the least rank; for short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    none = 1 << 60
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same tokens with a heap of pairs over a linked list: n log n."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i] = end[j]
        alive[j] = False
        if end[i] < n:
            before[end[i]] = i
            k = end[end[i]]
            if (r := ranks.get(piece[i:k])) is not None:
                heapq.heappush(heap, (r, i, k))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


class Transducer:
    """Encodes one piece fed in parts; holds at most ``lookahead`` and ``step`` bytes, and a token."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, step: int = 4096):
        self.ranks, self.lookahead, self.step, self.held = ranks, lookahead, step, b""

    def feed(self, data: bytes) -> Iterator[int]:
        """Ids that have become stable."""
        for at in range(0, len(data), self.step):
            self.held += data[at : at + self.step]
            if len(self.held) >= self.lookahead + self.step:
                stable = len(self.held) - self.lookahead
                done = 0
                for token in merge_long(self.held, self.ranks):
                    if done + len(token) > stable:
                        break
                    done += len(token)
                    yield self.ranks[token]
                self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        """Ids of what is held, now that the piece ends."""
        held, self.held = self.held, b""
        if held:
            yield from (self.ranks[t] for t in (merge_short if len(held) <= 64 else merge_long)(held, self.ranks))


class Decoder:
    """Token ids to text, fed in parts; holds the bytes of at most one unfinished character."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.held = tokens, b""

    def feed(self, ids: list[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte >= 0xC0:  # a leading byte: is its character finished?
                if (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) > back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}" + (f"-\\U{chars[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


def splitter() -> re.Pattern:
    """The byte-level tokenizers' pattern, in terms that ``re`` has: letters, numbers, others and blanks, each with a space before."""
    import unicodedata

    odd = _ranges([i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")])
    letter, number = f"[^\\W\\d_{odd}]", f"[\\d{odd}]"
    return re.compile(rf"'(?:[sdmt]|re|ve|ll)| ?{letter}+| ?{number}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Pieces(dict):
    """Piece -> its ids as bytes of 32-bit integers; emptied when it holds ``most`` pieces."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, most: int = 400_000):
        self.ranks, self.lookahead, self.most = ranks, lookahead, most

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            t = Transducer(self.ranks, self.lookahead)
            ids = [*t.feed(raw), *t.finish()] if len(raw) > 64 else [self.ranks[x] for x in merge_short(raw, self.ranks)]
        out = np.array(ids, dtype=np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


_kept: dict = {}


def _encoder(ranks: dict[bytes, int], lookahead: int) -> tuple[re.Pattern, Pieces]:
    key = (len(ranks), hash(frozenset(ranks.items())))
    if key not in _kept:
        _kept.clear()
        _kept[key] = splitter(), Pieces(ranks, lookahead)
    return _kept[key]


def encode(text: str, split: re.Pattern, pieces: Pieces) -> np.ndarray:
    return np.frombuffer(b"".join(map(pieces.__getitem__, (m.group() for m in split.finditer(text)))), dtype=np.int32)


def decode(ids: np.ndarray, tokens: list[bytes], step: int = 8192) -> str:
    d = Decoder(tokens)
    return "".join([*(d.feed(ids[at : at + step].tolist()) for at in range(0, len(ids), step)), d.finish()])


def _encoding(ranks: dict[bytes, int], lookahead: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = _encoder(ranks, lookahead)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                ids = [encode(t or "", split, pieces) for t in part]
                null = np.array([t is None for t in part])
                counts = np.array([len(x) for x in ids], dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=pa.array(null))
                columns = [batch.column(0).slice(a, len(part)), pa.array(counts, mask=null), lists]
                if check:
                    columns.append(pa.array([None if t is None else decode(x, tokens) == t for t, x in zip(part, ids)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "tokens", "round_trip"][: len(columns)])

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row, repeated rows and null ids included.

    ``round_trip`` tells whether decoding gives back the text; without
    ``check`` nothing is decoded and there is no such column. A null text has
    nulls, an empty one no tokens, an empty table no rows; a text of any length
    is read once from start to end, and memory is that of its tokens. Only the
    two columns named are read, and nothing is shuffled; the vocabulary, of
    fixed size, goes with the task.
    """
    ranks = load_ranks(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens int, tokens array<int>" + (", round_trip boolean" if check else "")
    return rows.mapInArrow(_encoding(ranks, sufficient_lookahead(ranks), check), schema)


def _decoding(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            texts = [None if not ids[i].is_valid else decode(ids[i].values.to_numpy(), tokens) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of every row of ids, by the incremental decoder; null ids give a null text, none an empty one.

    Bytes that are no character, as where a list ends in the middle of one, become U+FFFD.
    """
    ranks = load_ranks(vocabulary)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    return rows.mapInArrow(_decoding(tokens), "doc_id long, text string")
