"""Text scalars as Catalyst expressions: nothing here leaves the JVM.

Lengths are in bytes, as the model's token estimates and chunk limits are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILLERS = (
    "please note that|it is important to note that|it should be noted that|it is worth mentioning that|as you can see,|"
    "as we can see,|in order to|for the purpose of|at the end of the day|at this point in time|due to the fact that|"
    "in the event that|on the other hand,|as a matter of fact,|in other words,|for what it's worth,|needless to say,|"
    "it goes without saying that|the fact of the matter is|basically,|essentially,|actually,|in terms of"
).split("|")

SHORT_FORMS = dict(
    pair.split("=", 1)
    for pair in (
        "because=bc;between=btwn;example=eg;without=w/o;through=thru;approximately=~;however=but;therefore=so;although=tho;"
        "information=info;configuration=cfg;implementation=impl;documentation=docs;application=app;environment=env;"
        "development=dev;production=prod;performance=perf;description=desc;repository=repo;specification=spec;"
        "authentication=auth;authorization=authz;organization=org;notification=notif;parameters=params;parameter=param;"
        "function=fn;directory=dir;database=db;password=pwd;message=msg;request=req;response=resp;maximum=max;minimum=min;"
        "number=num;string=str;return=ret;integer=int;boolean=bool;package=pkg;library=lib;version=ver;command=cmd;"
        "execute=exec;address=addr;context=ctx;memory=mem;buffer=buf;object=obj;result=res;length=len;previous=prev;"
        "current=cur;temporary=tmp;original=orig;reference=ref;alternative=alt;continue=cont;received=recv;generate=gen;"
        "calculate=calc;initialize=init;synchronize=sync"
    ).split(";")
) | {"which is": "="}

#: White space as Unicode has it.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

def unusual(text: Column) -> Column:
    """Whether lower case and the classes L and N could depend on who knows which Unicode: a character is neither Latin nor general punctuation.

    Java looks for one range of characters far faster than for a class of several.
    """
    return text.contains("\u0130") | text.rlike("[\u0250-\u1fff]") | text.rlike("[\u2070-\\x{10ffff}]")


def bind(value: Column, f) -> Column:
    """``f(value)``, where ``value`` is computed once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def terms(text: Column) -> Column:
    """Lower-cased maximal runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else a quarter of its bytes, 1 at least."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4).cast("int")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def trim_blank(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(BLANKS))


def strip_fillers(text: Column) -> Column:
    """Filler phrases removed wherever they stand, without case: each until none is left, then the next.

    No phrase has a full stop or line break, so what stands between two of them is
    settled on its own, and only where it holds a phrase at all.
    """
    some = _any_filler()

    def pieces(t: Column) -> Column:
        parts = F.split(t, "(?<=[.\\n])", -1)
        return F.when(t.rlike(some), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(some), _without_fillers(p)).otherwise(p)), "")).otherwise(t)

    return bind(text, pieces)


def _any_filler() -> str:
    """A pattern of the phrases, told apart by their first letters; case counts for ASCII only, as in their removal."""
    by_first: dict[str, list[str]] = {}
    for p in FILLERS:
        by_first.setdefault(p[0], []).append(p[1:] + " ")
    return "(?i)(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


def _without_fillers(text: Column) -> Column:
    """A fold over the phrases. What a removal joins to the same phrase again
    goes in further rounds, as many as it takes; a round that is not needed
    costs a look at a flag.
    """
    kept = lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))

    def without(acc: Column, phrase: Column) -> Column:
        drop = lambda a: kept(F.regexp_replace(a["t"], F.concat(F.lit("(?i)\\Q"), phrase, F.lit("\\E")), F.lit("")))
        again = lambda a, b: F.struct(*(b[c].alias(c) for c in ("t", "low")), (b["low"].contains(phrase) & (b["t"] != a["t"])).alias("more"))

        def repeat(one: Column) -> Column:
            rounds = F.array_repeat(F.lit(0), F.when(one["more"], F.floor(F.length(one["t"]) / F.length(phrase)).cast("int")).otherwise(0))
            last = F.aggregate(rounds, one, lambda a, _: F.when(a["more"], bind(drop(a), lambda b: again(a, b))).otherwise(a))
            return bind(last, lambda a: F.struct(a["t"].alias("t"), a["low"].alias("low")))

        return F.when(acc["low"].contains(phrase), bind(bind(drop(acc), lambda b: again(acc, b)), repeat)).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(p + " ") for p in FILLERS)), kept(text), without, lambda acc: acc["t"])


def _literal(phrase: str) -> str:
    return "".join("\\" + c if c in ".,?*+()[]{}|^$" else c for c in phrase)


def _between_spaces() -> str:
    """A pattern of the long words between spaces, told apart by their first letters."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(SHORT_FORMS, key=len, reverse=True):
        by_first.setdefault(w[0], []).append(w[1:])
    return " (" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ") "


def abbreviate(text: Column) -> Column:
    """Long words, each between two spaces, shortened in one pass from the left.

    A match takes both of its spaces, so a word right after another match
    stays. The text is split at the matches, and the pieces are joined with the short forms.
    """
    pattern = _between_spaces()
    short = F.create_map(*(F.lit(f" {x} " if i else x) for pair in SHORT_FORMS.items() for i, x in enumerate(pair)))

    def swap(padded: Column) -> Column:
        said = F.transform(F.regexp_extract_all(padded, F.lit(pattern), F.lit(1)), lambda w: short[w])
        out = F.array_join(F.zip_with(F.split(padded, pattern, -1), F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return F.when(padded.rlike(pattern), out).otherwise(padded)

    return bind(bind(F.concat(F.lit(" "), text, F.lit(" ")), swap), lambda out: F.substring(out, F.lit(2), F.length(out) - 2))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")


def strip_decoration(text: Column) -> Column:
    """Lines of rules removed, three dots made one character."""
    return F.replace(F.regexp_replace(text, "(?md)^[-=*]{3,}\\s*$", ""), F.lit("..."), F.lit("…"))


def compact(text: Column) -> Column:
    """The whole shortening; a text of which nothing would be left stays as it is."""
    out = trim_blank(strip_decoration(collapse_blanks(abbreviate(strip_fillers(text)))))
    return bind(out, lambda x: F.when(x == "", text).otherwise(x))


def chunks(text: Column, target_tokens: int = 512, overlap_tokens: int = 50) -> Column:
    """Array of chunk texts: paragraphs are gathered up to ``4 * target_tokens`` bytes.

    One fold over the paragraphs. A paragraph is never split; when appending
    one fills the buffer, the next begins with the last bytes of that paragraph.
    A buffer of white space is neither emitted nor cleared, and a text that
    yields nothing is one chunk.
    """
    limit = 4 * (target_tokens if target_tokens > 0 else 512)
    overlap = 4 * overlap_tokens
    state = lambda buf, out: F.struct(buf.alias("buf"), out.alias("out"))
    start = state(F.lit(""), F.array().cast("array<string>"))

    def emit(s: Column) -> Column:
        return bind(trim_blank(s["buf"]), lambda said: F.when(said == "", s).otherwise(state(F.lit(""), F.array_append(s["out"], said))))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["buf"] != "") & (F.octet_length(acc["buf"]) + F.octet_length(p) > limit)

        def add(s: Column) -> Column:
            def close(joined: Column) -> Column:
                after = bind(emit(state(joined, s["out"])), lambda e: state(F.concat(e["buf"], _tail(p, overlap)), e["out"]))
                return F.when(F.octet_length(joined) >= limit, after).otherwise(state(joined, s["out"]))

            return F.when(s["buf"] == "", state(p, s["out"])).otherwise(bind(F.concat(s["buf"], F.lit("\n\n"), p), close))

        return bind(F.when(full, emit(acc)).otherwise(acc), add)

    folded = F.aggregate(F.split(text, "\n\n"), start, step, lambda acc: emit(acc)["out"])
    whole = bind(folded, lambda out: F.when(F.size(out) == 0, F.array(trim_blank(text))).otherwise(out))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def _tail(p: Column, n: int) -> Column:
    """The last ``n`` bytes of a longer paragraph, bytes of a cut character replaced."""
    return F.when(F.octet_length(p) > n, _as_text(F.substring(p.cast("binary"), F.octet_length(p) - n + 1, F.lit(n)))).otherwise("")


def _as_text(binary: Column) -> Column:
    """Bytes as text, what is not valid UTF-8 replaced."""
    return F.make_valid_utf8(binary.cast("string"))


def overview_label(summary: Column, content: Column) -> Column:
    """Summary, or else content, cut to 80 bytes."""
    label = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(content)
    return F.when(F.octet_length(label) > 80, _as_text(F.substring(label.cast("binary"), F.lit(1), F.lit(80)))).otherwise(label)


def document_of(unit: Column) -> Column:
    """The document of a unit id ``doc#n``."""
    return F.split_part(unit, F.lit("#"), F.lit(1))


def chunk_of(unit: Column) -> Column:
    """The chunk number of a unit id; -1 for a document or a suffix that is no number."""
    return F.coalesce(F.regexp_extract(unit, "^[^#]*#([0-9]+)$", 1).try_cast("int"), F.lit(-1))


def truncated(text: Column, most: int = 32768) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…(truncated)"))).otherwise(text)
