"""Rows by their place in an order, without sorting a whole table into one task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamis.operators.tables import written


def _levels(rows: DataFrame, order: tuple[str, ...]) -> Iterator[Column]:
    """Numbers that order rows as the columns `order` do, one after the other: a text is its bytes, seven at a time."""
    for name in order:
        if isinstance(rows.schema[name].dataType, StringType):
            longest = rows.agg(F.max(F.octet_length(name))).first()[0] or 0
            for at in range(1, longest + 1, 7):
                bytes_ = F.hex(F.substring(F.encode(F.col(name), "UTF-8"), at, 7))
                yield F.conv(F.rpad(bytes_, 14, "0"), 16, 10).cast("long")
            yield F.octet_length(name)
        else:
            yield F.col(name)


def _cut(rows: DataFrame, n: int, level: Column, bins: int = 4_096) -> tuple[float, int, int]:
    """The n-th lowest value of a number, how many rows are below it, and how many have it. Each round counts the rows of the
    interval that is left in `bins` parts; the part that holds the n-th, from its least to its greatest value, is next."""
    low, high, count = rows.agg(F.min(level), F.max(level), F.count("*")).first()
    below = 0
    while low < high:
        if isinstance(low, int):  # differences of longs may be none
            off, span = (level.cast("decimal(38,0)") - F.lit(low)).cast("double"), float(high - low)
        else:
            off, span = level * 0.5 - F.lit(low * 0.5), high * 0.5 - low * 0.5
        part = F.least(F.floor(off / span * bins), F.lit(bins - 1))
        inside = rows.where(level.between(F.lit(low), F.lit(high)))
        counts = inside.groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.min(level).alias("low"), F.max(level).alias("high")).orderBy("p").collect()  # at most `bins` rows
        for r in counts:
            if below + r["c"] >= n:
                low, high, count = r["low"], r["high"], r["c"]
                break
            below += r["c"]
    return low, below, count


def lowest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n first rows by the columns `order` (numbers or texts, none null); of rows that are equal in all of them, any.
    The value that the n-th row has is found by counting, round by round and column by column; nothing is sorted, so n may
    be any share of the table."""
    if n <= 0:
        return rows.limit(0)
    rows = written(rows, "rows")
    if rows.count() <= n:
        return rows
    less, same = F.lit(False), F.lit(True)
    for level in _levels(rows, order):
        value, below, equal = _cut(rows.where(same), n, level)
        less, same, n = less | (same & (level < F.lit(value))), same & (level == F.lit(value)), n - below
        if equal == n:
            return rows.where(less | same)
    return rows.where(less).unionByName(rows.where(same).limit(n))


def values_at(samples: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """For each group the values that stand at some places of its order, counted from 0.

    places: a name for each place, as a column of n, the group's size. Values are dealt to buckets of equal width within
    their group; buckets are counted, and only buckets that hold a place are put in order. Nulls aren't counted.
    """
    known = samples.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = known.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / F.least(F.lit(4096), F.greatest(F.lit(1), F.col("n"))), F.lit(1e-300))
    ends = ends.withColumn("_width", width)
    dealt = known.join(ends.drop("n", "_hi"), by).withColumn("_b", F.floor((F.col("_v") - F.col("_lo")) / F.col("_width")))
    counts = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 4097 rows a group
    spans = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).join(ends.select(*by, "n"), by)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.floor(place).cast("long").alias("at")) for name, place in places.items()))
    inside = (F.col("_p.at") >= F.col("_before")) & (F.col("_p.at") < F.col("_before") + F.col("_c"))
    targets = spans.withColumn("_p", F.explode(wanted)).where(inside)
    held = dealt.select(*by, "_b", "_v").join(targets.select(*by, "_b").distinct(), [*by, "_b"])
    order = Window.partitionBy(*by, "_b").orderBy("_v")
    ranked = held.withColumn("_r", F.row_number().over(order) - 1)
    at = targets.select(*by, "_b", "n", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_before")).alias("_r"))
    found = ranked.join(at, [*by, "_b", "_r"])
    pick = [F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places]
    return found.groupBy(*by).agg(F.max("n").alias("n"), *pick)
