"""Information-theoretic sanitisation of personal data.

Mentions of protected entities (e-mail, IP and street addresses, telephone, card,
social security and account numbers, keys and other secrets, persons by their
title) are found by pattern and masked.
What else could give an entity away is estimated from the corpus, after Sanchez
and Batet's C-sanitisation: a term of a document that mentions the entity
discloses it to the degree PMI(entity; term) / IC(entity), with document
frequencies over the whole corpus. Terms at or above ``threshold``
are generalised in every document that mentions the entity, and those at or
above ``remove_at`` are removed.

A term is generalised to the most specific class above it that is safe. The
classes are those of a supplied taxonomy (term to broader term), then, as for
any value without one, those of all words that begin with its first three, two
and one characters. A class is safe if the documents that hold a word of it are
so many that even meeting the entity in each of its documents it would
disclose at most ``general_at``: log(N / df_class) / log(N / df_entity). Where
no class is safe, a mark for words or numbers stands instead.

Mention detection and masking touch only texts that may hold a mention, by a
pattern wider than all others; other texts never leave the JVM. Document frequencies are counted only of
terms that a bitmap of fixed size lets through, and joined exactly.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import any_of, cut, fresh, list_array
from tarn.llm.textvec import Words, chunks, mix, word_ids

#: What a text must hold for any pattern below to match: a digit of any script or an at sign, or one of the rarer signs.
DIGIT_OR_AT = r"[\p{Nd}@]"
SIGNS = ("::", "-----BEGIN")
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Sr", "Doña", "Don ", "Don.")
KEYWORDS = ("pass", "pwd", "secret", "kennwort", "contrase", "mot de", "key", "token")
_GAP = r"[\W_]{1,6}"
_HEX = r"[0-9A-Fa-f]{1,4}"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = {
    "EMAIL": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
    r"|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*)(?![A-Za-z0-9])",
    "SECRET": r"(?i:(?:token|api[_-]?key|secret|password)[\W_]{1,6})(?=[A-Za-z_\-/+]*\d)[A-Za-z0-9_\-/+]{16,}"
    r"|(?i:\b(?:password|passwd|passphrase|pwd|passwort|kennwort|contraseña|mot de passe)[\"']?[ \t]*[:=][ \t]*)[^\s,;]+"
    r"|(?i:\b(?:[a-z]+[_-])*(?:token|api[_-]?key|secret)[\"']?[ \t]*[:=][ \t]*)[^\s,;]{8,}"
    r"|(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
    "IP": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
    rf"|(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])(?<=[\w:]{{4}})",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "PHONE": rf"(?<![\d.])(?:\+\d{{1,3}}{_GAP})?(?:\(\d{{3}}\)|\d{{3}}){_GAP}\d{{3}}[\W_]{{1,3}}\d{{4}}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .()/-]{0,3}\d){6,13}(?!\d)|(?<![\d.-])\d{3}-\d{4}(?![\d-])|(?<![\d.])0\d{2,4}[ /-]\d{5,8}(?![\d.])",
    "STREET": rf"(?<![\w.])\d{{1,5}} (?:[A-ZÀ-Þ][^\W\d_]+ ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Square|Terrace)\b"
    rf"|\b[A-ZÀ-Þ][^\W\d_]*(?:straße|strasse|gasse|platz|allee) \d{{1,4}}[a-z]?\b|\b\d{{1,4}}(?: bis)?,? (?:rue|avenue|boulevard|place|quai) (?:d[eu]s? |de la |de l'|d')?{_NAME}\b|\b(?:Calle|Avenida|Plaza|Paseo) (?:de (?:la |los |las )?|del )?{_NAME},? \d{{1,4}}\b",
    "PERSON": rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Doña|Don)\b\.? (?=[A-ZÀ-Þ]){_NAME}(?: (?=[A-ZÀ-Þ]){_NAME})?",
}


def _split(kind: str, n: int) -> tuple[str, str]:
    """The first ``n`` alternatives of a pattern and the rest."""
    parts, depth, at = [], 0, 0
    p = PATTERNS[kind]
    for i, c in enumerate(p):
        if p[i - 1] != "\\" or p[i - 2] == "\\":
            depth += (c in "([" and not (depth < 0)) - (c in ")]")
            if c == "|" and depth == 0:
                parts.append(p[at:i])
                at = i + 1
    parts.append(p[at:])
    return "|".join(parts[:n]), "|".join(parts[n:])


def _has(pattern: str):
    return re.compile(pattern).search


#: (kind, pattern, what a text must hold for it, whether it begins at a run of digits, a plus sign or a bracket), by precedence.
FINDERS = [
    (kind, re.compile(pattern), needs, at_digits)
    for kind, pattern, needs, at_digits in (
        ("EMAIL", PATTERNS["EMAIL"], _has("@"), False),
        ("KEY", PATTERNS["KEY"], _has("-----BEGIN|A[KSI]IA|AIDA|AROA|gh[pousr]_|xox|sk-|AIza|eyJ"), False),
        ("SECRET", _split("SECRET", 3)[0], lambda text: any(k in low for low in (text.lower(),) for k in KEYWORDS), False),
        ("SECRET", _split("SECRET", 3)[1], _has("[0-9A-Fa-f]{32}"), False),
        ("IP", _split("IP", 1)[0], None, True),
        ("IP", _split("IP", 1)[1], _has("::|(?::[0-9A-Fa-f]{1,4}){7}"), False),
        ("SSN", PATTERNS["SSN"], None, True),
        ("CARD", PATTERNS["CARD"], None, True),
        ("IBAN", PATTERNS["IBAN"], _has(r"[A-Z]{2}\d\d"), False),
        ("PHONE", PATTERNS["PHONE"], None, True),
        ("STREET", PATTERNS["STREET"], _has("straße|strasse|gasse|platz|allee|rue|avenue|boulevard|place|quai|Calle|Avenida|Plaza|Paseo|St|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Dr|Court|Ct|Square|Terrace"), False),
        ("PERSON", PATTERNS["PERSON"], _has("|".join(x.replace(".", "[.]") for x in TITLES)), False),
    )
]
_starts = re.compile(r"[+(]|\d+").finditer
WORD = re.compile(r"[^\W_]+")


def may_hold(text: Column) -> Column:
    """Whether a text may hold a mention; false for null."""
    plain, loose = any_of((*SIGNS, *TITLES)), any_of(KEYWORDS)
    firsts = {x[0] for x in (*SIGNS, *TITLES, *KEYWORDS)} | {k[0].upper() for k in KEYWORDS}
    rarer = f"(?=[{''.join(sorted(firsts - {'-'}))}-])(?:{plain}|(?i:{loose}))"
    return F.coalesce(text.rlike(DIGIT_OR_AT) | text.rlike(rarer), F.lit(False))


def _is_one(kind: str, value: str) -> bool:
    """Runs of colons and hex digits are an address only if they read as one, and hold a digit."""
    if kind != "IP" or ":" not in value:
        return True
    try:
        return len(value) > 4 and bool(ipaddress.IPv6Address(value)) and any(c.isdigit() for c in value)
    except ValueError:
        return False


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of each mention, in order; mentions don't overlap.

    The leftmost is taken, of several at one place the first by precedence.
    Patterns that begin at digits are tried where digits begin, others only in
    texts that hold what they need.
    """
    starts = [m.start() for m in _starts(text)]
    anchored = [(i, f) for i, f in enumerate(FINDERS) if f[3]] if starts else []
    free = [(i, f) for i, f in enumerate(FINDERS) if not f[3] and f[2](text)]
    if not anchored and not free:
        return []

    def later(i: int, f: tuple, pos: int):
        for m in f[1].finditer(text, pos):
            if _is_one(f[0], m.group()):
                return m.start(), i, m
        return None

    out, pos, at = [], 0, 0
    ahead = {i: later(i, f, 0) for i, f in free}
    while True:
        best = min((x for x in ahead.values() if x), key=lambda x: x[:2], default=None)
        while at < len(starts) and (starts[at] < pos or best is None or starts[at] <= best[0]):
            if starts[at] >= pos:
                hit = next(((starts[at], i, m) for i, f in anchored if (m := f[1].match(text, starts[at]))), None)
                if hit and (best is None or hit[:2] < best[:2]):
                    best = hit
                    break
            at += 1
        if best is None:
            return out
        start, i, m = best
        kind, pos = FINDERS[i][0], m.end()
        out.append((start, pos, kind, kind + ":" + re.sub(r"[\W_]+", ".", m.group().lower()).strip(".")))
        for i, f in free:
            if ahead[i] and ahead[i][0] < pos:
                ahead[i] = later(i, f, pos)


def entity_ids(values: list[str]) -> np.ndarray:
    """64-bit ids of normalised values."""
    return word_ids([v.encode().hex() for v in values]).view(np.int64)


def _near(text: str, window: int | None) -> list[tuple[str, list[str]]]:
    """(value, lower-cased words within ``window`` of the mention) of each mention; words of other mentions
    are passed over. Without a window, all words of the text are near."""
    found = mentions(text)
    words, before, at = [], [], 0
    for a, b, _, _ in found:
        words += WORD.findall(text[at:a])
        before.append(len(words))
        at = b
    words = [w.lower() for w in [*words, *WORD.findall(text[at:])]]
    if window is None:
        return [(value, words) for *_, value in found]
    return [(value, words[max(0, n - window) : n + window]) for (*_, value), n in zip(found, before)]


CLASSES = 3
_NUMBERED = mix(np.arange(1, CLASSES + 1, dtype=np.uint64))
_BROADER = np.uint64(0xB0AD)


class Taxonomy:
    """Broader terms of a term, nearest first: those supplied, then the heads of three, two and one characters.

    ``depth`` is the longest supplied chain; a circle in it ends where it closes.
    """

    def __init__(self, broader: dict[str, str] | None = None):
        self.broader = {k.lower(): v.lower() for k, v in (broader or {}).items()}
        self.depth = max((len(self.above(w)) for w in self.broader), default=0)
        # every word with a class above it, and each broader term, which is of its own class
        pairs = {(w, g) for w in self.broader for g in self.above(w)} | {(g, g) for g in self.broader.values()}
        words, of = ([x[i] for x in sorted(pairs)] for i in (0, 1))
        ids = word_ids([w.replace(" ", "") for w in words])
        order = np.argsort(ids, kind="stable")
        self.words, self.classes = ids[order], self._broad(of)[order]

    def above(self, word: str) -> list[str]:
        out: list[str] = []
        while (word := self.broader.get(word)) is not None and word not in out:
            out.append(word)
        return out

    @staticmethod
    def _broad(terms: list[str]) -> np.ndarray:
        return mix(word_ids([t.encode().hex() for t in terms]) ^ _BROADER)

    def ids(self, words: list[str]) -> np.ndarray:
        """(words x (depth + CLASSES)) ids of the classes of each word, most specific first; 0 where there is none."""
        out = np.zeros((len(words), self.depth + CLASSES), dtype=np.uint64)
        for i in (i for i, w in enumerate(words) if w in self.broader):
            up = self.above(words[i])
            out[i, : len(up)] = self._broad(up)
        if words:
            w = Words([" ".join(words)])
            size = w.end - w.start
            for n in range(1, CLASSES + 1):
                longer = np.flatnonzero(size > n)
                out[longer, self.depth + CLASSES - n] = mix(w.heads(longer, n) ^ _NUMBERED[n - 1])
        return out.view(np.int64)

    def name(self, word: str, level: int) -> str | None:
        """The broader term of a word at a level, as it is written in a text; None beyond the last."""
        if level >= self.depth + CLASSES:
            return None
        return self.above(word.lower())[level] if level < self.depth else word[: self.depth + CLASSES - level] + "*"


def _mentioning(window: int | None, taxonomy: Taxonomy):
    """(doc, entities, terms, classes of each term) of each mention, or of each text if there is no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, values, n_values, terms, n_terms = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                near = _near(text, window)
                groups = [([v], w) for v, w in near] if window is not None else [(list(dict.fromkeys(v for v, _ in near)), near[0][1])] if near else []
                for entities, words in groups:
                    # a lower-cased word may hold combining marks; its parts are the words that Words would give
                    parts = list(dict.fromkeys(x for w in words for x in WORD.findall(w)))
                    doc.append(d)
                    values += entities
                    n_values.append(len(entities))
                    terms += parts
                    n_terms.append(len(parts))
            classes = taxonomy.ids(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()), list_array(pa.array(entity_ids(values)), n_values), list_array(pa.array(word_ids(terms).view(np.int64)), n_terms),
                    list_array(pa.array(classes.reshape(-1)), np.array(n_terms, dtype=np.int64) * classes.shape[1]),
                ],
                ["doc", "entities", "terms", "classes"],
            )

    return run


def _frequencies(bits: np.ndarray, taxonomy: Taxonomy):
    """Counts of documents by term, of the terms and classes whose bit is set; partial sums, one row for each term and chunk."""
    size = np.uint64(len(bits) * 8 - 1)

    def among(ids: np.ndarray) -> np.ndarray:
        slot = ids & size
        return np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                of = np.repeat(np.arange(len(w.counts)), w.counts)
                # the words of each kind, once for each text first
                found = [(w.hash, of)]
                _, first = np.unique(mix(w.hash) + of.astype(np.uint64), return_index=True)
                for n in range(1, CLASSES + 1):
                    at = first[w.end[first] - w.start[first] > n]
                    found.append((mix(w.heads(at, n) ^ _NUMBERED[n - 1]), of[at]))
                if len(taxonomy.words):
                    lo, hi = (np.searchsorted(taxonomy.words, w.hash[first], side) for side in ("left", "right"))
                    n = hi - lo
                    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append((taxonomy.classes[at], np.repeat(of[first], n)))
                for hashes, doc in found:
                    hit = among(hashes)
                    ids, which = np.unique(hashes[hit], return_inverse=True)
                    once = np.unique(which.astype(np.int64) * (b - a) + doc[hit])
                    n_docs = np.bincount(once // (b - a), minlength=len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n_docs, pa.int64())], ["term", "n"])

    return run


def bitmap(ids: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of ``bits`` bits (one MB by default, whatever the size of ``ids``), set at the low bits of each id."""
    slot = ids.select(F.col("term").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    rows = slot.selectExpr("CAST(shiftright(slot, 3) AS INT) AS byte", "shiftleft(1, CAST(slot & 7L AS INT)) AS bit")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for byte, bit in rows.groupBy("byte").agg(F.bit_or("bit")).toPandas().itertuples(index=False):
        out[byte] = bit
    return out


def _tell(docs: DataFrame, window: int | None, min_docs: int, threshold: float, chance: float, id_col: str, text_col: str, taxonomy: Taxonomy):
    """Mentions (doc, entity), what tells of them (entity, term, disclosure, docs, df_entity), the texts with mentions, and frequencies of terms and classes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    found = cut(rows.where(may_hold(F.col("text"))).mapInArrow(_mentioning(window, taxonomy), "doc long, entities array<bigint>, terms array<bigint>, classes array<bigint>"))
    mentioned = found.select("doc", F.explode("entities").alias("entity")).distinct()
    of_entity = cut(mentioned.groupBy("entity").agg(F.count("*").alias("df_entity")))
    bits = bitmap(found.select(F.explode(F.concat("terms", "classes")).alias("term")))
    total = rows.agg(F.count("*").alias("docs")).crossJoin(of_entity.agg(F.max("df_entity").alias("most")))
    counted = cut(rows.select("text").mapInArrow(_frequencies(bits, taxonomy), "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term")))
    # co <= df_entity, so no commoner term reaches the threshold with any entity
    rare = counted.crossJoin(F.broadcast(total)).where(F.col("df_term") <= 1.000001 * F.pow(F.col("docs"), F.lit(1 - threshold)) * F.pow(F.col("most"), F.lit(threshold)))
    pairs = found.select("doc", "entities", F.explode("terms").alias("term")).join(rare.select("term", "df_term", "docs"), "term")
    pairs = pairs.select("doc", F.explode("entities").alias("entity"), "term", "df_term", "docs").distinct()
    together = pairs.groupBy("entity", "term", "df_term", "docs").agg(F.count("*").alias("co")).join(of_entity, "entity")
    by_chance = F.greatest("df_term", "co") * F.col("df_entity") / F.col("docs")
    # an entity that stands in every text carries no information: nothing discloses it
    ic = F.nullif(F.log2(F.col("docs") / F.col("df_entity")), F.lit(0.0))
    pmi = F.log2(F.col("co") * F.col("docs") / (F.col("df_entity") * F.greatest("df_term", "co")))
    told = (
        together.where((F.col("co") >= min_docs) | (by_chance <= chance))
        .select("entity", "term", (pmi / ic).alias("disclosure"), "docs", "df_entity")
        .where((F.col("disclosure") >= threshold))
    )
    return mentioned, told, found, counted


def disclosures(
    docs: DataFrame, window: int | None = None, min_docs: int = 2, threshold: float = 0.9, chance: float = 0.05, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, entity, term, disclosure) of the terms that disclose an entity that ``doc`` mentions.

    Frequencies are of rows with an id and a text; rows that share an id count
    once for an entity and a term. Pairs are those of a document, or within
    ``window`` words if given. Pairs seen together in fewer than ``min_docs``
    documents are evidence where they would seldom meet by accident: in at most
    ``chance`` documents by their frequencies. So a term and an entity of one
    document each count in any corpus of ``1 / chance`` documents or more. An
    entity of all documents is disclosed by nothing. An empty table gives no rows.
    """
    mentioned, told, *_ = _tell(docs, window, min_docs, threshold, chance, id_col, text_col, Taxonomy())
    return mentioned.join(told.select("entity", "term", "disclosure"), "entity")


def _levels(told: DataFrame, found: DataFrame, counted: DataFrame, width: int, general_at: float) -> DataFrame:
    """(entity, term, disclosure, level): the most specific class of the term that is safe for the entity; ``width`` if none is."""
    wanted = told.select(F.col("term").alias("t_")).distinct()
    classes = found.select(F.posexplode("terms").alias("at", "term"), "classes").select("term", F.slice("classes", F.col("at") * width + 1, F.lit(width)).alias("classes"))
    classes = classes.join(wanted, classes["term"] == wanted["t_"], "left_semi").groupBy("term").agg(F.first("classes").alias("classes"))
    known = classes.select(F.col("term").alias("t_"), F.posexplode("classes").alias("level", "class")).where("class <> 0")
    known = known.join(counted.select(F.col("term").alias("class"), F.col("df_term").alias("df_class")), "class").select("t_", "level", "df_class")
    enough = F.pow(F.col("docs").cast("double"), F.lit(1 - general_at)) * F.pow(F.col("df_entity").cast("double"), F.lit(general_at))
    safe = F.when(F.col("df_class") >= 0.999999 * enough, F.col("level")).otherwise(width)
    return told.join(known, told["term"] == known["t_"], "left").groupBy("entity", "term").agg(F.first("disclosure").alias("disclosure"), F.min(F.coalesce(safe, F.lit(width))).alias("level"))


def mask(text: str, terms: dict[str, tuple[bool, int]], taxonomy: Taxonomy | None = None) -> tuple[str, int, int]:
    """(text, mentions masked, terms replaced); ``terms`` maps lower-cased words to whether they are removed, and the level of what stands instead."""
    found = mentions(text)
    hidden = 0

    def swap(m: re.Match) -> str:
        nonlocal hidden
        known = terms.get(m.group().lower())
        if known is None:
            return m.group()
        hidden += 1
        gone, level = known
        return "" if gone else taxonomy.name(m.group(), level) or ("[number]" if m.group().isdigit() else "[term]")

    out, at = [], 0
    for a, b, kind, _ in [*found, (len(text), len(text), "", "")]:
        part = text[at:a]
        out.append(WORD.sub(swap, part) if terms else part)
        if kind:
            out.append(f"[{kind}]")
        at = b
    return "".join(out), len(found), hidden


def _masking(names: list[str], text_at: int, counts: tuple[str, str], taxonomy: Taxonomy):
    """The columns of the input, its text masked, then the counts; the last input column has the document's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            new, n, m = [], [], []
            for text, told in zip(texts, batch.column(len(names)).to_pylist()):
                terms: dict[str, tuple[bool, int]] = {}
                if told:
                    words = list({w.lower() for w in WORD.findall(text)})
                    words = [w for w in words if WORD.fullmatch(w)]
                    known = {x["term"]: (x["gone"], x["level"]) for x in told}
                    terms = {w: known[i] for w, i in zip(words, word_ids(words).view(np.int64).tolist()) if i in known}
                x = mask(text, terms, taxonomy)
                new.append(x[0])
                n.append(x[1])
                m.append(x[2])
            cols = [pa.array(new, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(m, pa.int32())], [*names, *counts])

    return run


def sanitise(
    docs: DataFrame, remove_at: float = 0.999, general_at: float = 0.5, broader: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int | None = None, min_docs: int = 2, threshold: float = 0.9, chance: float = 0.05,
) -> DataFrame:
    """``docs`` with mentions masked and disclosing terms generalised or removed, and two counts of these.

    ``broader`` is a taxonomy, a table of bounded size that goes with the
    tasks; its terms are single words. A term that several entities of a
    document call for goes by the strictest: removed if any is disclosed to
    ``remove_at``, else generalised to a class safe for all.

    Every row stays, null and empty texts and rows without an id too (the latter have
    only their mentions masked); rows that repeat an id are treated alike. Columns keep their names; the counts are
    called ``n_mentions`` and ``n_terms``, with underscores added if taken. Texts are
    read whole, in time linear in their length. An empty table stays empty.
    """
    taxonomy = Taxonomy(broader)
    doc, terms = (fresh(docs, x) for x in ("doc_", "terms_"))
    counts = fresh(docs, "n_mentions"), fresh(docs, "n_terms")
    mentioned, told, found, counted = _tell(docs, window, min_docs, threshold, chance, id_col, text_col, taxonomy)
    told = _levels(cut(told), found, counted, taxonomy.depth + CLASSES, general_at)
    told = mentioned.join(told, "entity").groupBy("doc", "term").agg((F.max("disclosure") >= remove_at).alias("gone"), F.max("level").alias("level"))
    told = told.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("term", "gone", "level")).alias(terms))
    text = F.col(text_col).cast("string")
    may = may_hold(text)
    names = docs.columns
    # only texts that may hold a mention are joined and masked; all others pass as they are
    rows = docs.where(may).withColumn(text_col, text)
    rows = rows.join(told, rows[id_col].cast("long") == told[doc], "left").select(*(rows[c] for c in names), terms)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    masked = rows.mapInArrow(_masking(names, names.index(text_col), counts, taxonomy), f"{schema}, {counts[0]} int, {counts[1]} int")
    plain = docs.where(~may).withColumn(text_col, text).withColumns({c: F.lit(0) for c in counts})
    return plain.union(masked)
