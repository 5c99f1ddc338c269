"""Baselines that are kept by day and merged to any span: counts, and sketches of what a count doesn't say.

A day's row of a type holds its signals, a HyperLogLog sketch of its sources and a KLL sketch of a measured value. Sketches of
days merge to the sketch of the span, whatever the days' order and grouping, so a week costs seven small rows a type and no
look at signals. Their errors don't add up over merges:

- sources: a relative standard error of 1.04 / sqrt(2 ** MEMBER_BITS); members_error is three of them
- quantiles: the rank of what is given is within RANK_ERROR of the rank asked for, with a probability of 0.99
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER_BITS = 12
QUANTILE_SIZE = 400
#: Normalised rank error of KLL sketches of that size, for single quantiles.
RANK_ERROR = 0.0088
QUANTILES = (0.5, 0.9, 0.99)


def members_error(n: Column) -> Column:
    """What an estimate of n different members may be off by."""
    return F.greatest(F.lit(1.0), 3 * 1.04 / (1 << MEMBER_BITS) ** 0.5 * n)


def daily(signals: DataFrame, kind: str, time: str, member: str, value: str) -> DataFrame:
    """A row for each day (UTC, from 1970 on) and kind: signals, members, low, high, spread. Members and values that are null
    aren't counted; a kind without values has no spread. Signals without a time have no day and go."""
    rows = signals.where(F.col(time).isNotNull()).withColumn("day", F.floor(F.col(time) / 86_400_000_000).cast("int"))
    v = F.col(value).cast("double")
    made = rows.groupBy("day", F.col(kind).alias("kind")).agg(
        F.count("*").alias("signals"),
        F.hll_sketch_agg(F.col(member).cast("string"), F.lit(MEMBER_BITS)).alias("members"),
        F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(QUANTILE_SIZE)).alias("spread"),
    )
    return made.withColumn("spread", F.when(F.col("low").isNotNull(), F.col("spread")))


def merged(days: DataFrame, *by: Column | str) -> DataFrame:
    """Days' rows as one for each kind and each value of `by`, columns of the days (their week, say)."""
    return days.groupBy(*by, "kind").agg(
        F.sum("signals").alias("signals"), F.hll_union_agg("members").alias("members"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("spread").alias("spread"),
    )


def estimates(baseline: DataFrame) -> DataFrame:
    """Rows of daily or merged with numbers in place of sketches: members, and q50, q90, q99 (null without values)."""
    found = {f"q{round(q * 100)}": F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("spread", F.lit(q))) for q in QUANTILES}
    return baseline.withColumns({"members": F.hll_sketch_estimate("members"), **found}).drop("spread")


def compare(then: DataFrame, now: DataFrame, least: int = 10, factor: float = 2.0) -> DataFrame:
    """What differs between two baselines (as estimates gives them) by kind: unexpected (new), missing (expected more than
    `least` times, gone), slower or faster (its median moved by `factor`), wider (so many times the members)."""
    a = then.select("kind", F.col("signals").alias("n"), F.col("members").alias("m"), F.col("q50").alias("q"))
    b = now.select("kind", "signals", "members", "q50")
    both = a.join(b, "kind", "full")
    reason = (
        F.when(F.col("n").isNull(), "unexpected").when(F.col("signals").isNull() & (F.col("n") > least), "missing")
        .when(F.col("q50") > factor * F.col("q"), "slower").when(F.col("q50") * factor < F.col("q"), "faster")
        .when(F.col("members") > factor * F.col("m"), "wider")
    )
    return both.withColumn("reason", reason).where("reason is not null").select("kind", "reason", F.col("n").alias("signals_then"), F.col("signals").alias("signals_now"))
