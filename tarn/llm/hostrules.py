"""Host-level quality rules.

Each document is held against rules on its wording and layout. Failures are
summed by domain, and a domain's failure rate is shrunk towards the corpus with a
beta prior whose two parameters are fitted to all domains by the method of
moments, so that a domain of few documents is not judged by them alone. Domain
verdicts go back to the documents: those of a blocked domain go, and so do those
that fail a rule themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import bind
from tarn.llm.common import any_of, cut, small

INSULTS = (
    "idiot|idiots|moron|morons|stupid|dumb|dumbass|imbecile|imbeciles|loser|losers|scum|trash|garbage|pathetic|worthless|disgusting|"
    "clown|clowns|retard|retards|bastard|bastards|vermin|filth|scumbag|pig|pigs|"
    "trottel|dummkopf|vollidiot|schwachkopf|arschloch|abschaum|wichser|missgeburt|hurensohn|"
    "connard|connards|connasse|salaud|salope|abruti|abrutis|encule|ordure|minable|"
    "idiota|idiotas|imbecil|estupido|estupida|gilipollas|pendejo|cabron|escoria|subnormal"
)
RULES = ("empty", "symbols", "table", "capitals", "repetition", "lines", "insults")
WORD = "[^ \\t\\n\\r\\f]+"
#: Words are counted apart in consecutive windows of this many, so that a text's length has no part in the measure.
WINDOW = 40
SUFFIX = "(?:co|com|org|net|ac|edu|gov|gob|gouv|or|ne)[.][a-z][a-z]"
HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
REGISTERED = f"([^.]+[.](?:{SUFFIX}|[^.]*[^.0-9][^.]*))$"


def domain(host: Column) -> Column:
    """The registered domain of a URL or host name; a name without a dot, and an IP address, as it is; "" if null.

    Two labels make a domain, or three where the last two are a country's usual second level.
    """
    h = F.coalesce(host, F.lit(""))
    h = F.when(h.contains("//"), F.regexp_extract(h, HOST, 1)).otherwise(h)
    found = F.regexp_extract(F.lower(h), REGISTERED, 1)
    return F.when(found != "", found).otherwise(h)


def word_counts(text: Column) -> Column:
    """struct(n, distinct): words, and distinct ones in each window, summed. The words are found once, not once for each window."""

    def count(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / WINDOW).cast("int")))
        distinct = F.aggregate(starts, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(words, i * WINDOW + 1, F.lit(WINDOW)))))
        return F.struct(F.size(words).alias("n"), distinct.alias("distinct"))

    return bind(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), count)


def _without(text: Column, signs: str) -> Column:
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def _insulting(text: Column) -> Column:
    """Whether an insult stands as a word."""
    words = INSULTS.split("|")
    return F.lower(text).rlike(f"(?:^|[^\\p{{L}}])(?=[{''.join(sorted({w[0] for w in words}))}])(?:{any_of(words)})(?:[^\\p{{L}}]|$)")


def rules(text: Column, counts: Column | None = None) -> dict[str, Column]:
    """Whether a text fails each rule; a null text fails ``empty`` only. No rule's limit depends on the text's length.

    ``counts`` is a column that holds ``word_counts`` of the text.
    """
    t = F.coalesce(text, F.lit(""))
    counts = word_counts(text) if counts is None else counts
    n, distinct = counts["n"], counts["distinct"]
    symbols = F.length(t) - F.length(_without(t, "#*%&$!"))
    bars = F.length(t) - F.length(_without(t, "|"))
    capitals = F.regexp_count(t, F.lit("\\p{Lu}"))
    lines = F.split(t, "\n")
    return {
        "empty": n == 0,
        "symbols": symbols > 0.2 * n,
        "table": bars > 0.1 * n,
        "capitals": (F.length(t) >= 20) & (capitals > 0.3 * F.length(t)),
        "repetition": (n >= 20) & (distinct < 0.5 * n),
        "lines": (F.size(lines) >= 4) & (F.size(F.array_distinct(lines)) < 0.5 * F.size(lines)),
        "insults": _insulting(t),
    }


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, docs, failed, rate) from (host, fails): rates shrunk with the fitted beta prior.

    With hosts weighted by their documents, the expected spread of raw rates
    around the pooled rate is ``A m (1 - m) + B t``, where ``t`` is the
    variance between hosts, ``A = (hosts - 1) / docs`` and ``B`` is 1 less the
    sum of squared weights less ``A`` (Kleinman, 1973). ``t`` from this is free
    of bias, and the prior counts for ``m (1 - m) / t - 1`` documents. Where
    hosts differ no more than chance would have it, the prior is strong
    and all rates are the corpus's.
    """
    hosts = cut(failures.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("fails") > 0, 1).otherwise(0)).alias("failed")))
    n = F.col("docs").cast("double")
    s = hosts.agg(
        F.sum(n).alias("n"), (F.sum("failed") / F.sum("docs")).alias("m"), F.count("*").alias("h"), F.sum(F.col("failed") * F.col("failed") / n).alias("p2"), F.sum(n * n).alias("n2")
    )
    s = s.select("m", (F.col("p2") / F.col("n") - F.col("m") * F.col("m")).alias("spread"), ((F.col("h") - 1) / F.col("n")).alias("a"), (1 - F.col("n2") / (F.col("n") * F.col("n"))).alias("w"))
    chance = F.col("m") * (1 - F.col("m"))
    between = F.when(F.col("w") - F.col("a") > 1e-12, (F.col("spread") - F.col("a") * chance) / (F.col("w") - F.col("a"))).otherwise(0.0)
    prior = s.withColumn("t", between).select("m", F.when(F.col("t") > 1e-9, F.greatest(chance / F.col("t") - 1, F.lit(0.0))).otherwise(F.lit(1e9)).alias("weight"))
    rate = (F.col("m") * F.col("weight") + F.col("failed")) / (F.col("weight") + F.col("docs"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "docs", "failed", F.round(rate, 6).alias("rate"))


def judge(docs: DataFrame, most: float = 0.5, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, fails, docs, failed, rate, keep) of every row.

    ``host_col`` holds a URL, a host or any other name of where a document is
    from; ``host`` is its ``domain``. ``fails`` counts the rules that the
    document fails; a host is blocked if its rate is at least ``most``, ties
    included. A null host is a host of its own, named "". Repeated rows and
    null ids count as any other; an empty table gives no rows. Texts are
    measured whole, in time linear in their length. Other columns are not looked at.
    """
    text = F.col(text_col).cast("string")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), domain(F.col(host_col).cast("string")).alias("host"), text.alias("text"), word_counts(text).alias("counts"))
    fails = sum((c.cast("int") for c in rules(F.col("text"), F.col("counts")).values()), F.lit(0))
    rows = cut(counted.select("doc_id", "host", fails.alias("fails")))
    hosts = host_rates(rows.select("host", "fails"))
    return rows.join(small(hosts), "host").select(
        "doc_id", "host", "fails", "docs", "failed", "rate", ((F.col("fails") == 0) & (F.col("rate") < most)).alias("keep")
    )


_HOST = f"CASE WHEN contains(coalesce(source, ''), '//') THEN regexp_extract(source, '{HOST}', 1) ELSE coalesce(source, '') END"
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, {_HOST} AS h, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, CASE WHEN regexp_extract(lower(h), '{REGISTERED}', 1) <> '' THEN regexp_extract(lower(h), '{REGISTERED}', 1) ELSE h END AS host FROM t),
p AS (SELECT *, regexp_extract_all(t, '{WORD}') AS p, string_split(t, chr(10)) AS l FROM g),
w AS (SELECT *, len(p) AS w FROM p),
f AS (SELECT doc_id, host,
    (w = 0)::int + (length(t) - length(translate(t, '#*%&$!', '')) > 0.2::double * w)::int
    + (length(t) - length(translate(t, '|', '')) > 0.1::double * w)::int
    + (length(t) >= 20 AND len(regexp_extract_all(t, '\\p{{Lu}}')) > 0.3::double * length(t))::int
    + (w >= 20 AND list_sum(list_transform(range(0, (w + {WINDOW - 1}) // {WINDOW}), lambda i: len(list_distinct(list_slice(p, i * {WINDOW} + 1, i * {WINDOW} + {WINDOW}))))) < 0.5::double * w)::int
    + (len(l) >= 4 AND len(list_distinct(l)) < 0.5::double * len(l))::int
    + regexp_matches(lower(t), '(^|[^\\p{{L}}])({INSULTS})([^\\p{{L}}]|$)')::int AS fails FROM w),
h AS (SELECT host, count(*) AS docs, CAST(sum((fails > 0)::int) AS BIGINT) AS failed FROM f GROUP BY host),
s AS (SELECT sum(docs)::double AS n, sum(failed)::double / sum(docs) AS m, count(*)::double AS h, sum(failed::double * failed / docs) AS p2, sum(docs::double * docs) AS n2 FROM h),
v AS (SELECT m, p2 / n - m * m AS spread, (h - 1) / n AS a, 1 - n2 / (n * n) AS w FROM s),
x AS (SELECT m, CASE WHEN w - a > 1e-12 THEN (spread - a * m * (1 - m)) / (w - a) ELSE 0 END AS t FROM v),
b AS (SELECT m, CASE WHEN t > 1e-9 THEN greatest(m * (1 - m) / t - 1, 0) ELSE 1e9 END AS weight FROM x),
r AS (SELECT host, docs, failed, round((m * weight + failed) / (weight + docs), 6) AS rate FROM h, b)
SELECT doc_id, host, docs, failed, rate FROM f JOIN r USING (host) WHERE fails = 0 AND rate < 0.5
"""
