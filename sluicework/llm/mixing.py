"""Mixing sources by temperature (DataFrame functions only).

Source token shares are raised to an exponent, which is bisected until the weights meet a target
entropy or the largest repetition reaches its limit. The weights become token budgets, and each
source serves its budget as whole permutations of its documents followed by part of one more.

The permutation of a source's epoch is the order of a seeded digest of id and text. Its top bits are a
block, the top half of those a group of blocks. Running token counts are kept for groups, for the
blocks of a group, and for the rows of a block, so that no task sorts a whole source: a source of n
rows has about ``sqrt(n)`` groups of as many blocks.

Edge cases: a null source is a source of its own; a null or empty text has no token and is served in
every whole epoch and wherever its place in the last one is within the budget; rows that share an id
(also a null one) are ordered by their texts, and repeated rows by their other columns; an empty table
gives an empty result; other columns are carried along unchanged by ``mix_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, numbered, read_table, whole

STEPS, SEED, MAX_REPEATS = 40, 7, 2.0
TOKEN = r"[^ \t\n\x0B\f\r]+"
#: Hexadecimal digits of a place in the order of an epoch.
DIGITS = 15


def tokens(text: Column) -> Column:
    """White-space tokens, counted without building them."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def temperature(shares: DataFrame, *, entropy: float | None = None, max_repeats: float | None = None, total: int | None = None) -> float:
    """The largest exponent in [0, 1] at which the weights reach ``entropy`` (a share of the log of
    the number of sources), or the smallest at which no source is repeated over ``max_repeats`` (of a
    budget of ``total`` tokens, or of the one that serves every source at least once).

    ``shares`` has a row for each source with a positive ``tokens``. Every bisection step is an
    aggregation that returns one row, however many sources there are.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    top, least, n = shares.agg(F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0

    def enough(a: float) -> bool:
        if max_repeats is not None and total is None:
            # Budget: the source that is served least is served once; see budgets().
            return (top / least) ** (1 - a) <= max_repeats
        if max_repeats is not None:
            z = shares.agg(F.sum(F.pow(F.col("tokens") / top, F.lit(a)))).first()[0]
            return total * (least / top) ** a / z <= max_repeats * least
        p = F.pow(F.col("tokens") / top, F.lit(a))
        z, s = shares.agg(F.sum(p), F.sum(p * F.log(p))).first()
        return (math.log(z) - s / z) / math.log(n) <= entropy

    low, high = 0.0, 1.0
    if enough(low):
        return low
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def budgets(shares: DataFrame, exponent: float, total: int | None = None) -> DataFrame:
    """Add ``weight`` (sums to 1) and ``budget`` in tokens. Without ``total``, the budget is the
    least at which every source is served at least once, so that no row is left out."""
    top = shares.agg(F.max("tokens")).first()[0]
    raised = shares.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(top or 1)), F.lit(exponent)))
    z, need = raised.agg(F.sum("raised"), F.max(F.col("tokens") / F.col("raised"))).first()
    size = F.lit(float(total)) if total is not None else F.lit(float((need or 0) * (z or 0)))
    weight = F.col("raised") / F.lit(float(z or 1))
    return raised.select("source_key", "tokens", weight.alias("weight"), F.greatest(F.round(weight * size), F.col("tokens") if total is None else F.lit(0)).cast("long").alias("budget"))


def mix_rows(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, total: int | None = None, seed: int = SEED, block_tokens: int = 200_000, staging: Staging | None = None, key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every served copy of every row: the input columns plus ``mix_epoch``, ``mix_tokens`` and
    ``mix_at`` (place of the copy in its source's budget, 0 to 1: sorting by it mixes the sources)."""
    spark = docs.sparkSession
    docs, names = numbered(docs)
    source_col, text_col, key_cols = names[source_col], names[text_col], tuple(names[k] for k in key_cols)
    staging = staging or Staging(spark, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    ident = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key_cols], whole(text_col)))
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    named = docs.select(*docs.columns, key.alias("_source"), tokens(whole(text_col)).alias("_tokens"), ident.alias("_id"), F.xxhash64(*plain).alias("_row"))
    shares = staging.put(named.groupBy(F.col("_source").alias("source_key")).agg(F.sum("_tokens").alias("tokens")).filter("tokens > 0"), "shares")
    exponent = temperature(shares, entropy=entropy, max_repeats=max_repeats, total=total)
    plan = budgets(shares, exponent, total).withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("bits", F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("tokens") / F.lit(block_tokens))))).cast("int"))
    plan = staging.put(plan, "plan")
    sized = plan.select(F.col("source_key").alias("_source"), "budget", "whole", "rest", "bits", F.col("tokens").alias("source_tokens"))
    # A row of the plan for each source meets many rows of one source: the plan is joined on a small
    # unique key, so a broadcast (where Spark measures it as small) or a skew-split join both do.
    copies = named.join(sized, "_source", "left").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("whole"), F.lit(0)).cast("int"))))
    copies = copies.filter((F.col("epoch") < F.col("whole")) | (F.col("rest") > 0) | F.col("whole").isNull())
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("_id"))), 1, DIGITS), 16, 10).cast("long")
    bits, half = F.coalesce(F.col("bits"), F.lit(0)), F.floor(F.coalesce(F.col("bits"), F.lit(0)) / 2).cast("int")
    copies = copies.withColumn("_order", order).withColumn("_block", F.expr(f"shiftright(_order, {4 * DIGITS} - coalesce(bits, 0))"))
    copies = copies.withColumn("_group", F.call_function("shiftright", F.col("_block"), half)).withColumn("bits", bits)
    by = ["_source", "epoch", "_group"]
    before = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    per_block = copies.groupBy(*by, "_block").agg(F.sum("_tokens").alias("n"))
    in_group = per_block.select(*by, "_block", F.coalesce(F.sum("n").over(before(*by).orderBy("_block")), F.lit(0)).alias("_inner"))
    per_group = per_block.groupBy(*by).agg(F.sum("n").alias("n"))
    ahead = per_group.select(*by, F.coalesce(F.sum("n").over(before("_source", "epoch").orderBy("_group")), F.lit(0)).alias("_outer"))
    blocks = in_group.join(ahead, by).select("_source", "epoch", "_block", (F.col("_inner") + F.col("_outer")).alias("_ahead"))
    inside = before("_source", "epoch", "_block").orderBy("_order", "_row")
    placed = copies.join(blocks, ["_source", "epoch", "_block"]).withColumn("_start", F.col("_ahead") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    kept = placed.filter((F.col("epoch") < F.coalesce(F.col("whole"), F.lit(1))) | (F.col("_start") + F.col("_tokens") <= F.col("rest")))
    at = F.when(F.col("budget") > 0, (F.col("epoch") * F.col("source_tokens") + F.col("_start")) / F.col("budget")).otherwise(F.lit(0.0))
    extras = {"mix_epoch": F.col("epoch").cast("long"), "mix_tokens": F.col("_tokens"), "mix_at": at}
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()], *[c.alias(n) for n, c in extras.items() if n not in names])


#: The same in DuckDB, with one running sum for each source and epoch.
OP7_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS ident FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
t AS (SELECT max(tokens)::DOUBLE AS top, min(tokens)::DOUBLE AS least, count(*) AS k FROM s),
r AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
FROM (SELECT *, pow(top / least, 1 - mid) <= {MAX_REPEATS}::DOUBLE AS ok FROM (SELECT *, (low + high) / 2 AS mid FROM r, t)) WHERE step < {STEPS}),
x AS (SELECT CASE WHEN k < 2 THEN 1.0 WHEN top / least <= {MAX_REPEATS}::DOUBLE THEN 0.0 ELSE (SELECT high FROM r WHERE step = {STEPS}) END AS a, top FROM t),
w AS (SELECT source, tokens, pow(tokens / top, a) AS raised FROM s, x),
z AS (SELECT sum(raised) AS z, max(tokens / raised) AS need FROM w),
p AS (SELECT source, tokens, greatest(round(raised / z * (need * z)), tokens)::BIGINT AS budget FROM w, z),
q AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM p),
c AS (SELECT d.*, q.tokens, budget, whole, rest, unnest(range(coalesce(whole, 0) + 1)) AS epoch FROM d LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epoch || ':' || ident), 1, {DIGITS}))::BIGINT AS place FROM c WHERE whole IS NULL OR epoch < whole OR rest > 0),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o)
SELECT doc_id, source, epoch, n AS n_tokens, CASE WHEN budget > 0 THEN (epoch * tokens + start) / budget::DOUBLE ELSE 0.0 END AS mix_at FROM b WHERE epoch < coalesce(whole, 1) OR start + n <= rest"""


def op7(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_rows(docs).drop("text").withColumnsRenamed({"mix_epoch": "epoch", "mix_tokens": "n_tokens"})
