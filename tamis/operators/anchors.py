"""Windows that open with the first row that no earlier window holds, by pointer doubling.

Every time of a key points to the first time of that key that lies a window's width later: found over slices of the sorted
times, so a key may have any share of all rows. The anchors are the times that pointers reach from a key's first one. They
are told without walking: pointers are joined with themselves, so that each level's pointers go twice as far, and from the
farthest level down the anchors known so far are sent along each level's pointers. A level keeps the times that its pointers
end in alone, which are fewer and fewer, as pointers from different times run together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.tables import discard, written


def pointers(times: DataFrame, width: int) -> DataFrame:
    """times (k, t), each once, with `to`: the first t of the same k that is at least `width` later. Times without one go."""
    marks = times.select("k", F.col("t").alias("at"), F.lit(1).alias("real"), "t")
    marks = marks.unionByName(times.select("k", (F.col("t") + width).alias("at"), F.lit(0).alias("real"), "t"))
    slices = written(marks.repartitionByRange("k", "at", "real").withColumn("slice", F.spark_partition_id()), "slices")
    # what lies later within a slice: seen from its end, a time comes before what asks for it
    back = Window.partitionBy("k", "slice").orderBy(F.desc("at"), F.desc("real")).rowsBetween(Window.unboundedPreceding, 0)
    inside = slices.withColumn("to", F.min(F.when(F.col("real") == 1, F.col("at"))).over(back)).where("real = 0")
    # the first time in later slices: a row for each slice that a key has
    firsts = slices.groupBy("k", "slice").agg(F.min(F.when(F.col("real") == 1, F.col("at"))).alias("first"))
    later = Window.partitionBy("k").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("k", "slice", F.min("first").over(later).alias("after")).where("after is not null")
    found = inside.join(after, ["k", "slice"], "left").select("k", "t", F.coalesce("to", "after").alias("to"))
    return found.where("to is not null")


def chain(times: DataFrame, width: int) -> DataFrame:
    """The anchors among times (k, t), each once: each k's first, and from there on the first that lies `width` later."""
    heads = written(times.groupBy("k").agg(F.min("t").alias("t")), "heads")
    levels = [written(pointers(times, width), "level0")]
    while not levels[-1].isEmpty():
        last = levels[-1]
        far = last.join(last.select("k", F.col("t").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "t", F.col("far").alias("to"))
        met = far.select("k", F.col("to").alias("t")).unionByName(heads).distinct()
        levels.append(written(far.join(met, ["k", "t"], "left_semi"), f"level{len(levels)}"))
    known = heads
    for level in reversed(levels[:-1]):
        more = written(known.unionByName(known.join(level, ["k", "t"]).select("k", F.col("to").alias("t"))), "anchors")
        discard(known)
        known = more
    for level in levels:
        discard(level)
    return known


def anchored(rows: DataFrame, key: Column, seconds: float, mine: Column) -> DataFrame:
    """signal_id and anchored of the rows (signal_id, us, seq) where `mine` holds: whether a row is the first of its key's
    window, which opens with a row that no earlier window holds and isn't moved by those inside. Rows of one time are in
    the order of seq. A null key is a key of its own; rows without a time are in no window and open none; an empty table
    gives no rows."""
    k = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))
    held = written(rows.where(mine).select("signal_id", F.col("us").alias("t"), "seq", k.alias("k")), "rows")
    firsts = held.where("t is not null").groupBy("k", "t").agg(F.min(F.struct("seq", "signal_id")).alias("first"))
    firsts = written(firsts, "times")
    opens = chain(firsts.select("k", "t"), int(seconds * 1_000_000)).join(firsts, ["k", "t"]).select(F.col("first.seq").alias("seq"), F.col("first.signal_id").alias("signal_id"), F.lit(True).alias("_opens"))
    return held.join(opens, ["signal_id", "seq"], "left").select("signal_id", F.coalesce("_opens", F.lit(False)).alias("anchored"))
