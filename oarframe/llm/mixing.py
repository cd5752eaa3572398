"""Mixing sources to target weights by temperature, in DataFrame functions alone.

Each source's share of all tokens is raised to an exponent and normalised.  The exponent (0: even
weights, 1: the sources as they are) is bisected until the weights meet an entropy (`entropy`, a
share of the even weights' entropy) or until no source repeats more often than `max_repeats`
within the budget.  A source's budget is then realised block by block: every block is a permutation
of the source's documents (by a checksum of block and id); full blocks come whole, the last one up
to the document that would exceed the budget.

The running sums that cut the last block work in two steps, sums by bucket (a prefix of the
checksum) and rows within a bucket, so that no source, however large, meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialize

ARMS = 16  # exponents tried in one pass; each pass narrows the interval 16-fold
PASSES = 12
BUCKET_DIGITS = 3  # 4096 buckets of a source


def word_count(text: Column) -> Column:
    """Words between white space, as an approximation of tokens; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_totals(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """(source, docs, tokens) of each source, a null source being one of its own."""
    return docs.groupBy(source.alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of powers, the entropy, and the largest weight-to-share ratio."""
    p = F.col("share")
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow(p, F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"l{i}"), F.max(power / p).alias(f"r{i}")]
    row = shares.agg(*columns).first()
    out = []
    for i, a in enumerate(exponents):
        z, powers, ratio = row[f"z{i}"], row[f"l{i}"], row[f"r{i}"]
        out.append((z, math.log(z) - a * powers / z, ratio / z))
    return out


def solve_exponent(shares: DataFrame, entropy: float | None, max_repeats: float | None, budget_ratio: float | None, arms: int = ARMS, passes: int = PASSES) -> float:
    """The smallest exponent in [0, 1] that meets the repetition limit and whose entropy is at most the target.

    Entropy falls, and so does the highest repetition, as the exponent grows; the interval that
    holds the change is cut into `arms` parts again and again.  budget_ratio is the budget over all
    tokens; None lets the budget follow the weights, so that the least repeated source is used once.
    If even exponent 1 misses the target, it is 1.
    """

    def met(moment: tuple[float, float, float], floor: float) -> bool:
        _, h, ratio = moment
        if entropy is not None and h > entropy * even:
            return False
        times = ratio * budget_ratio if budget_ratio is not None else ratio / floor
        return max_repeats is None or times <= max_repeats

    n = shares.count()
    even = math.log(n) if n > 1 else 0.0
    if n < 2:
        return 1.0
    low, high = 0.0, 1.0
    largest = shares.agg(F.max("share")).first()[0]
    for _ in range(passes):
        tried = [low + (high - low) * i / arms for i in range(arms + 1)]
        good = [met(m, math.pow(largest, a - 1) / m[0]) for a, m in zip(tried, _moments(shares, tried))]
        if good[0]:
            return tried[0]
        if not any(good):
            return high
        at = good.index(True)
        low, high = tried[at - 1], tried[at]
    return high


def source_weights(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, docs, tokens, weight, quota) of the sources that have tokens; `budget` None as in solve_exponent."""
    full = totals.filter(F.col("tokens") > 0)
    total = full.agg(F.sum("tokens")).first()[0] or 0
    shares = full.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    exponent = solve_exponent(shares, entropy, max_repeats, budget / total if budget is not None and total else None)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
    if budget is None:
        least = weighted.agg(F.min(F.col("weight") / F.col("share"))).first()[0] or 1.0
        budget = total / least
    quota = F.least(F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(0.5)), F.lit(2**62)).cast("long")
    return weighted.drop("share").withColumn("quota", quota)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokens_col: str | None = None,
    entropy: float | None = None,
    max_repeats: float | None = None,
    budget_share: float | None = 1.0,
    seed: int = 1,
) -> DataFrame:
    """docs repeated or thinned to the weights, with `block` and `place` (of the row in its source's block).

    A document's tokens are the words of its text, or what tokens_col says (null: 0).
    budget_share is the budget as a share of all tokens; None takes the smallest budget that uses
    every document at least once.  A null source is a source; sources without tokens, and an empty
    frame, give no rows with a finite budget, and rows without tokens go with the block they stand in.
    Repeated rows are rows; those equal in id and text tie, in which case either may come first.
    Existing columns named block or place are replaced.

    Without max_repeats a source repeats as often as its weight asks for: half of a budget of 10**12
    tokens asks a source of 1,000 tokens for 5 * 10**8 blocks, and each of its rows makes an array of
    that length.  Give max_repeats where sources may be that small.
    """
    names = [c for c in docs.columns if c.lower() not in ("block", "place")]
    tokens, digest, bucket, source = (fresh_name(docs.columns, n) for n in ("mix_tokens", "mix_digest", "mix_bucket", "mix_source"))
    count = F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)) if tokens_col else word_count(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], count.alias(tokens)).withColumn(
        source, F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))
    )
    totals = materialize(source_totals(rows, F.col(source), F.col(tokens)))
    budget = None
    if budget_share is not None:
        budget = budget_share * (totals.agg(F.sum("tokens")).first()[0] or 0)
    plan = source_weights(totals, entropy, max_repeats, budget).select(
        F.col("source").alias("plan_source"),
        F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"),
        (F.col("quota") % F.col("tokens")).alias("rest"),
    )
    blocks = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))
    planned = rows.join(plan, F.col(source) == F.col("plan_source")).filter((F.col("whole") > 0) | (F.col("rest") > 0))
    copies = planned.withColumn("block", F.explode(blocks)).withColumn(digest, _digest(seed, F.col("block"), F.col(f"`{id_col}`"))).withColumn(bucket, F.substring(digest, 1, BUCKET_DIGITS))
    within = Window.partitionBy(source, "block", bucket).orderBy(digest, F.col(f"`{id_col}`"), tokens)
    before = (
        copies.groupBy(source, "block", bucket)
        .agg(F.sum(tokens).alias("bucket_tokens"), F.count("*").alias("bucket_rows"))
        .withColumn("sum_before", F.sum("bucket_tokens").over(Window.partitionBy(source, "block").orderBy(bucket)) - F.col("bucket_tokens"))
        .withColumn("rows_before", F.sum("bucket_rows").over(Window.partitionBy(source, "block").orderBy(bucket)) - F.col("bucket_rows"))
        .select(F.col(source).alias("b_source"), F.col("block").alias("b_block"), F.col(bucket).alias("b_bucket"), "sum_before", "rows_before")
    )
    ranked = copies.withColumn("place", F.row_number().over(within)).withColumn("sum_here", F.sum(tokens).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranked.join(before, (F.col(source) == F.col("b_source")) & (F.col("block") == F.col("b_block")) & (F.col(bucket) == F.col("b_bucket")))
    kept = joined.filter((F.col("block") < F.col("whole")) | (F.col("sum_before") + F.col("sum_here") <= F.col("rest")))
    return kept.select(*[F.col(f"`{c}`") for c in names], "block", (F.col("place") + F.col("rows_before") - 1).alias("place"))


def _digest(seed: int, block: Column, key: Column) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), block.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))), "UTF-8"))


def op9_temperature_mix(spark, sf_dir: str) -> DataFrame:
    """All documents' sources mixed to 97 % of even weights' entropy within as many tokens as there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))  # the texts are read once
    return mix_sources(counted, tokens_col="words", entropy=OP9_ENTROPY, max_repeats=4.0).select("doc_id", "source", "block", F.col("place").cast("long").alias("place"))


OP9_ENTROPY = 0.97
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
totals AS (SELECT s, sum(tokens)::BIGINT AS tokens FROM d GROUP BY s HAVING sum(tokens) > 0),
shares AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (
    SELECT i, any_value(lo) AS lo, any_value(hi) AS hi,
      ln(sum(pow(p, (lo + hi) / 2))) - any_value((lo + hi) / 2) * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2))
        <= 0.97 * ln(count(*))
      AND max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) <= 4.0 AS ok
    FROM bisect, shares WHERE i < 48 GROUP BY i)),
a AS (SELECT hi AS x FROM bisect WHERE i = 48),
plan AS (
  SELECT s, tokens, CAST(floor(pow(p, x) / (SELECT sum(pow(p, x)) FROM shares, a) * (SELECT sum(tokens) FROM totals)::DOUBLE + 0.5) AS BIGINT) AS quota
  FROM shares, a),
copies AS (
  SELECT doc_id, source, d.s, d.tokens, block, quota // plan.tokens AS whole, quota % plan.tokens AS rest,
    md5('1:' || block || ':' || coalesce(doc_id::VARCHAR, 'null')) AS digest
  FROM d JOIN plan USING (s), LATERAL (SELECT unnest(range(0, quota // plan.tokens + CASE WHEN quota % plan.tokens > 0 THEN 1 ELSE 0 END)) AS block)),
placed AS (
  SELECT *, sum(tokens) OVER w AS upto, row_number() OVER w - 1 AS place
  FROM copies WINDOW w AS (PARTITION BY s, block ORDER BY digest, doc_id, tokens ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, CAST(block AS INTEGER) AS block, CAST(place AS BIGINT) AS place
FROM placed WHERE block < whole OR upto <= rest
"""
