"""Mixing sources to target weights (native).

Source token shares s_i become weights w_i = s_i^a / sum_j s_j^a.  The exponent a in [0, 1] is
bisected until the weights meet a target entropy, or until no source is read more often than a
repetition limit.  The weights are then realised over a token budget: a source with budget b_i is read
in passes, every pass a new pseudo-random permutation of its documents, cut where b_i ends, and
the passes of all sources are dealt over blocks so that each block holds the sources in their
weights; inside a block the order is a permutation again.

Only DataFrame functions run here.  Hot sources: no window ever spans a source; documents of a
pass are cut into key ranges of about bucket_tokens tokens, whose totals alone are prefix-summed.

Defined cases: a document counts its words (runs of other than space, tab, newline, return), one at least, so
null and empty texts count 1.  A null source is a source of its own.  Rows of equal id and source
are one unit whose tokens add up; a null id is a unit too.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.llm.common import materialise

LEVELS = 6  # levels of bisection that one job decides, by evaluating all their midpoints
ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)), F.lit(1)).cast("long")


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_tokens")).groupBy("_id", "_source").agg(F.sum("_tokens").alias("_tokens"))


def bisect_exponent(shares: DataFrame, *, n_sources: int, entropy_share: float | None, max_repetition: float | None, budget_ratio: float | None) -> float:
    """The exponent; shares has one row a source with _l, the logarithm of its share.

    entropy_share: target entropy as a part of log(n_sources); the largest exponent that reaches it.
    max_repetition: else, the smallest exponent at which no source is read more than so many times.
    budget_ratio: budget / tokens; None: the budget at which each source is read once at least.
    A bisection: each job evaluates the midpoints of the next six levels at once (63 rows come back).
    """
    lo, hi, n = 0.0, 1.0, 1 << LEVELS
    for _ in range(ROUNDS):
        step = (hi - lo) / n
        a = F.col("_a")
        found = (
            shares.select("_l", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("_k"))
            .withColumn("_a", F.lit(lo) + F.col("_k") * F.lit(step))
            .groupBy("_k", "_a")
            .agg(
                F.sum(F.exp(a * F.col("_l"))).alias("z"),
                F.sum(F.exp(a * F.col("_l")) * F.col("_l")).alias("d"),
                F.max((a - 1) * F.col("_l")).alias("most"),
                F.max((1 - a) * F.col("_l")).alias("least"),
            )
            .collect()
        )
        k = 0  # midpoints below the answer
        for r in found:
            if entropy_share is not None:
                below = math.log(r["z"]) - r["_a"] * r["d"] / r["z"] >= entropy_share * math.log(n_sources)
            else:
                ratio = math.exp(r["least"] + math.log(r["z"])) if budget_ratio is None else budget_ratio
                below = math.exp(r["most"]) / r["z"] * ratio > max_repetition
            k += below
        lo, hi = lo + k * step, lo + (k + 1) * step
    return lo if entropy_share is not None else hi


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy_share: float | None = None,
    max_repetition: float | None = None,
    budget_tokens: int | None = None,
    cover: bool = False,
    block_tokens: int = 1 << 16,
    bucket_tokens: int = 1 << 20,
    seed: str = "mix",
) -> DataFrame:
    """(id, source, epoch, n_tokens, weight, block_id, position): the training order.

    budget_tokens defaults to the tokens of docs; with cover it is the least at which every document is used.
    """
    if (entropy_share is None) == (max_repetition is None):
        raise ValueError("give entropy_share or max_repetition")
    units = materialise(spark, _units(docs, id_col, source_col, text_col), "mix-units")
    per_source = materialise(spark, units.groupBy("_source").agg(F.sum("_tokens").alias("_t")), "mix-sources")
    n_sources, total = per_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("_t"), F.lit(0))).first()
    total_f = float(max(total, 1))
    shares = per_source.select("_source", "_t", F.log(F.col("_t") / F.lit(total_f)).alias("_l"))
    a = 1.0
    if n_sources > 1:
        a = bisect_exponent(shares, n_sources=n_sources, entropy_share=entropy_share, max_repetition=max_repetition, budget_ratio=None if cover else (budget_tokens or total) / total_f)
    z, least = shares.agg(F.sum(F.exp(F.lit(a) * F.col("_l"))), F.max(F.lit(1 - a) * F.col("_l"))).first()
    z, least = z or 1.0, least or 0.0
    budget = math.ceil(math.exp(least) * z * total_f) if cover else (budget_tokens or total)
    own = F.col("_w") * F.lit(float(budget))
    weights = (
        shares.withColumn("_w", F.exp(F.lit(a) * F.col("_l")) / F.lit(z))
        .withColumn("_budget", (F.greatest(F.ceil(own - F.lit(1e-6)).cast("long"), F.col("_t")) if cover else F.round(own).cast("long")))
        # rounding must not begin another pass
        .withColumn("_budget", F.least("_budget", F.floor(F.col("_t") * F.lit(float(max_repetition or 1)))) if max_repetition else F.col("_budget"))
        .where("_budget > 0")
        .select("_source", "_w", "_budget", F.ceil(F.col("_budget") / F.col("_t")).cast("long").alias("_passes"), F.ceil(F.col("_t") / F.lit(float(bucket_tokens))).cast("double").alias("_buckets"))
        .withColumnRenamed("_source", "_source2")
    )
    rows = (
        units.join(weights, F.col("_source").eqNullSafe(F.col("_source2")))
        .drop("_source2")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("_source"), F.col("_epoch"), F.col("_id")).cast("binary")))
        .withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * F.col("_buckets") / F.lit(float(1 << 32))))
    )
    at = ["_source", "_epoch", "_bucket"]
    before = rows.groupBy(*at).agg(F.sum("_tokens").alias("_sum")).select(
        *(F.col(c).alias(f"{c}2") for c in at), (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_epoch", "_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before")
    )
    inside = Window.partitionBy(*at).orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    n_blocks = max(1, math.ceil(budget / block_tokens))
    placed = (
        rows.join(before, F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_epoch") == F.col("_epoch2")) & (F.col("_bucket") == F.col("_bucket2")))
        .withColumn("_start", F.col("_before") + F.sum("_tokens").over(inside) - F.col("_tokens"))
        .where("_start < _budget")
        .withColumn("block_id", F.floor(F.col("_start").cast("double") * F.lit(float(n_blocks)) / F.col("_budget")).cast("long"))
        .withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("block_id"), F.col("_key")).cast("binary")))
    )
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_epoch").alias("epoch"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_w", 6).alias("weight"),
        "block_id",
        F.row_number().over(Window.partitionBy("block_id").orderBy("_order", "_id")).cast("long").alias("position"),
    )


ENTROPY_SHARE = 0.95


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kilnlog.llm.common import table

    return mix_sources(spark, table(spark, sf_dir, "documents"), entropy_share=ENTROPY_SHARE)


ORACLE = f"""
with recursive units as (
  select doc_id, source, sum(greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')), 1))::bigint as t from documents group by 1, 2),
src as (select source, sum(t)::bigint as st from units group by 1),
tot as (select sum(st)::bigint as total, count(*) as n, list(ln(st::double / (select sum(st)::double from src))) as ls from src),
bis(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when up then (lo + hi) / 2 else lo end, case when up then hi else (lo + hi) / 2 end
  from (select i, lo, hi, ln(list_sum(list_transform(ls, lambda l: exp((lo + hi) / 2 * l))))
      - (lo + hi) / 2 * list_sum(list_transform(ls, lambda l: exp((lo + hi) / 2 * l) * l)) / list_sum(list_transform(ls, lambda l: exp((lo + hi) / 2 * l)))
      >= {ENTROPY_SHARE} * ln(n) as up from bis, tot where i < {LEVELS * ROUNDS})),
a as (select case when (select n from tot) > 1 then lo else 1.0 end as a from bis where i = {LEVELS * ROUNDS}),
w as (select source, st, exp(a * ln(st::double / total::double)) / list_sum(list_transform(ls, lambda l: exp(a * l))) as w, total from src, tot, a),
b as (select source, w, st, round(w * total)::bigint as budget, greatest(1, ceil(total / 65536.0))::double as nb from w),
r as (select doc_id, u.source, t, w, budget, nb, unnest(range(0, ceil(budget::double / st)::bigint)) as epoch from units u join b on u.source is not distinct from b.source where budget > 0),
k as (select *, md5(concat_ws(':', 'mix', source, epoch::varchar, doc_id::varchar)) as key from r),
s as (select *, (sum(t) over (partition by source order by epoch, key, doc_id rows unbounded preceding) - t)::bigint as start from k),
p as (select *, floor(start::double * nb / budget)::bigint as block_id from s where start < budget)
select doc_id, source, epoch, t as n_tokens, round(w, 6) as weight, block_id,
  row_number() over (partition by block_id order by md5(concat_ws(':', 'mix', block_id::varchar, key)), doc_id) as position
from p
"""
