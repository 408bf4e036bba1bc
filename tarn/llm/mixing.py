"""Mixing sources to target weights, with exact token budgets.

Each document gets a hash-random key, unique within its source by its id and,
among rows that repeat an id, its text. Keys
cut each source into equal ranges; token counts are summed by range, the range
sums are prefixed within the source, and only in the ranges where a budget
ends are documents sorted and prefixed one by one. That gives each source one
exact cut: a number of whole epochs, the key at which the last epoch ends, and
what is still to be taken there: how many of the rows that share the key, one as
a rule, and how many tokens of the next. Keys and counts are made once and kept
without the texts. The cuts, a row for each
source, then select from the documents in a single scan in which no text is
shuffled. It is the same selection as that of a full sort by (source, key)
with a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import cut, fresh, small

TOKEN = "[^ \\t\\n\\r\\f]+"
#: Ranges of keys for each source; documents are sorted one by one only in the range where a budget ends.
RANGE_DIGITS = 3


def token_count(text: Column) -> Column:
    """Tokens of a text: maximal runs of non-blank characters; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("long"), F.lit(0).cast("long"))


def mixing_key(id_: Column, text: Column, seed: int) -> Column:
    """The hash of the id decides; that of the text puts rows that repeat an id in order."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), F.lit("-"), F.md5(text))


def budgets(avail: DataFrame, weights: dict[str, float] | None, temperature: float, total: int | None) -> DataFrame:
    """(src, tokens, budget): each source's share of ``total`` tokens, rounded down.

    Shares follow ``weights`` (sources not named get 0) or, without them,
    tokens ** ``temperature``. ``total`` is by default the tokens available.
    """
    if weights is None:
        w = F.pow(F.col("tokens").cast("double"), temperature)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.create_map(*pairs)[F.col("src")], F.lit(0.0)) if pairs else F.lit(0.0)
    w = F.when(F.col("tokens") > 0, w).otherwise(0.0)
    known = avail.withColumn("w", w)
    sums = known.agg(F.sum("w").alias("all_w"), F.sum("tokens").alias("all_t"))
    whole = F.col("all_t") if total is None else F.lit(total)
    share = F.when(F.col("all_w") > 0, F.floor(F.round(F.col("w") / F.col("all_w") * whole, 6))).otherwise(0)
    return known.crossJoin(sums).select("src", "tokens", share.cast("long").alias("budget"))


def source_cuts(
    rows: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: int | None = None
) -> DataFrame:
    """(src, epochs, last_key, last_rows, last_take, last_of) from rows (src, key, n).

    ``epochs`` whole passes, then the documents below ``last_key``, then
    ``last_rows`` of the ``last_of`` rows at it and ``last_take`` tokens of one more.
    """
    ranged = cut(rows.withColumn("part", F.substring("key", 1, RANGE_DIGITS)))
    sums = cut(ranged.groupBy("src", "part").agg(F.sum("n").alias("n")))
    plan = budgets(sums.groupBy("src").agg(F.sum("n").alias("tokens")), weights, temperature, total).where("budget > 0").select(
        "src", F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    plan = cut(plan)
    before = F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")
    edge = sums.withColumn("before", before).join(plan, "src").where("before < rest AND rest <= before + n").select(
        "src", "part", (F.col("rest") - F.col("before")).alias("want")
    )
    inner = ranged.join(edge, ["src", "part"]).groupBy("src", "key").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.first("want").alias("want"))
    order = Window.partitionBy("src").orderBy("key")
    inner = inner.withColumn("before", F.sum("n").over(order) - F.col("n")).where("before < want AND want <= before + n")
    # rows of one key have the same text, so as many tokens each
    ends = inner.select("src", F.col("key").alias("last_key"), F.expr("(want - before) div (n div c)").alias("last_rows"), F.expr("(want - before) % (n div c)").alias("last_take"), F.col("c").alias("last_of"))
    return plan.select("src", "epochs").join(ends, "src", "left")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    total: int | None = None,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` repeated and cut so that each source has its exact budget of tokens.

    Adds ``epoch`` (0 for the first pass) and ``n_tokens`` (underscores are
    added to a taken name). In a source's last epoch, the document at which the
    budget ends keeps just the tokens still due, and the white space before
    them; all other texts are whole. Rows with a null source, id or text, and
    texts without tokens, have no tokens to give and are left out. Rows that
    repeat an id within a source go in the order of their texts' hashes, and
    where a budget ends among rows that repeat both, in that of a hash of all
    columns. An empty table gives no rows. Texts are counted whole; other
    columns, clashing names included, are as they were.
    """
    src, key, n, of, whole, last, full, take, same, nth = (fresh(docs, x) for x in ("src_", "key_", "n_", "of_", "whole_", "last_", "full_", "take_", "same_", "nth_"))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({src: F.col(source_col).cast("string"), key: mixing_key(F.col(id_col), text, seed), n: token_count(text)}).where(
        F.col(src).isNotNull() & F.col(key).isNotNull() & (F.col(n) > 0)
    )
    cuts = source_cuts(keyed.select(F.col(src).alias("src"), F.col(key).alias("key"), F.col(n).alias("n")), weights, temperature, total)
    cuts = cuts.select(F.col("src").alias(of), F.col("epochs").alias(whole), F.col("last_key").alias(last), F.col("last_rows").alias(full), F.col("last_take").alias(take), F.col("last_of").alias(same))
    joined = keyed.join(small(cuts), F.col(src) == F.col(of))
    # only rows that repeat the id and text at which a budget ends are numbered, one key for each source at most
    repeats = F.coalesce((F.col(key) == F.col(last)) & (F.col(same) > 1), F.lit(False))
    every = [F.to_json(F.struct(F.col(f.name))) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f.name) for f in docs.schema.fields]
    number = F.row_number().over(Window.partitionBy(src).orderBy(F.xxhash64(*every)))
    joined = joined.where(~repeats).withColumn(nth, F.lit(1)).union(joined.where(repeats).withColumn(nth, number))
    at_end = F.col(key) == F.col(last)
    ends_here = at_end & (F.col(nth) == F.col(full) + 1) & (F.col(take) > 0)
    more = (F.col(key) < F.col(last)) | (at_end & (F.col(nth) <= F.col(full))) | ends_here
    passes = F.col(whole).cast("int") + F.coalesce(more, F.lit(False)).cast("int")
    epoch, taken = fresh(docs, "epoch"), fresh(docs, "n_tokens")
    rows = joined.where(passes > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), passes - 1)))
    partial = (F.col(epoch) == F.col(whole)) & F.coalesce(ends_here, F.lit(False))
    pieces = F.regexp_extract_all(text, F.lit(f"[ \\t\\n\\r\\f]*{TOKEN}"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col(take).cast("int")), "")
    out = {text_col: F.when(partial, head).otherwise(text), taken: F.when(partial, F.col(take)).otherwise(F.col(n))}
    return rows.withColumns(out).select(*docs.columns, epoch, taken)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, text, md5('1:' || doc_id) AS k,
         CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY k) AS BIGINT) AS upto,
             CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS tokens FROM d WHERE n > 0),
w AS (SELECT source, any_value(tokens) AS tokens, pow(CAST(any_value(tokens) AS DOUBLE), 0.7) AS w FROM r GROUP BY source),
b AS (SELECT source, tokens,
             CAST(floor(round(w / (SELECT sum(w) FROM w) * (SELECT sum(tokens) FROM w), 6)) AS BIGINT) AS budget FROM w),
p AS (SELECT r.*, b.budget // b.tokens AS epochs, b.budget % b.tokens AS rest FROM r JOIN b USING (source)),
e AS (SELECT *, unnest(range(epochs + CASE WHEN upto - n < rest THEN 1 ELSE 0 END)) AS epoch FROM p)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch,
       CASE WHEN epoch = epochs THEN least(n, rest - (upto - n)) ELSE n END AS n_tokens,
       CASE WHEN epoch = epochs AND rest < upto
            THEN array_to_string(list_slice(regexp_extract_all(text, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+'), 1, rest - (upto - n)), '')
            ELSE text END AS text
FROM e
"""
