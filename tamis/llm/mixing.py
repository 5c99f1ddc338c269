"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every shuffled document queues once for each pass. It is served from the virtual time at which its source's tokens before
it, divided by the source's weight, are done, to its finish time, those tokens and its own divided by the weight. The queue
is sorted by that time over all sources and cut off where what it has served reaches the total budget; what a document has
been served by then is taken. A source that has queued all its passes is served no more, so others reach further.

Cumulative sums never put a source, or the queue, into one task: documents are dealt to slices of about `slice_rows` by
their shuffled key, the queue is range-sorted into partitions, slices are summed, and a running sum is taken over the
slices' sums and then within a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import WORD, column_or_null, materialize


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, passes: int = 2
) -> DataFrame:
    """A row for each source of (source, source_size): weight and target.

    Weights repeat over the sources in order of code points, null last. Targets share `share` of all sizes by weight;
    one that exceeds `passes` times its source's size stops there and the excess goes to the others by weight: with sources
    in the order in which they run dry, those that don't share (budget - what the dry ones gave) by weight.
    """
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    dry = Window.orderBy("dry_at", F.col("source").isNull(), "source")
    place = ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")
    own = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    own = own.withColumn("most", F.col("source_size") * passes).withColumn("dry_at", F.col("most") / F.col("weight"))
    own = own.withColumn("budget", F.sum("source_size").over(dry.rowsBetween(*everything)) * F.lit(share))
    before = F.coalesce(F.sum("most").over(dry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(dry.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level_here", (F.col("budget") - before) / left)
    # the first source that doesn't run dry before its level sets the level of all
    first = F.struct("dry_at", F.col("source").isNull().alias("n"), "source", "level_here")
    holds = F.min(F.when(F.col("level_here") <= F.col("dry_at"), first)).over(dry.rowsBetween(*everything))
    last = F.max("dry_at").over(dry.rowsBetween(*everything))
    own = own.withColumn("level", F.coalesce(holds["level_here"], last))
    target = F.least(F.col("weight") * F.col("level"), F.col("most").cast("double"))
    return own.select("source", "source_size", "weight", target.alias("target"))


def cut_off(queued: DataFrame, budget: float, passes: int, slice_rows: int) -> float:
    """The virtual time by which the queue of queued (size, _before, source_size, weight) has served `budget` tokens, or has
    served all.

    A document that begins at one event of the queue and finishes at a later one has been served, in between, its source's
    weight a unit of time. So over the events in order of time run three sums: the tokens of finished documents, the
    weights of those being served, and these weights times their beginnings.
    """
    weight, before = F.col("weight"), F.col("_before") + F.col("_pass") * F.col("source_size")
    events = F.array(
        F.struct((before / weight).alias("t"), F.lit(0).cast("long").alias("done"), weight.alias("rate"), before.alias("begun")),
        F.struct(
            ((before + F.col("size")) / weight).alias("t"), F.col("size").alias("done"),
            (-weight).alias("rate"), (-before).alias("begun"),
        ),
    )
    rows = queued.where("size > 0").select("size", "_before", "source_size", "weight")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(F.explode(events).alias("e"))
    number = queued.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(int(number), -(-queued.count() * 2 * passes // (100 * slice_rows)))
    slices = rows.select("e.*").repartitionByRange(n, "t").withColumn("slice", F.spark_partition_id())
    slices = materialize(slices, "queue")
    sums = [F.sum(c).alias(c) for c in ("done", "rate", "begun")]
    through = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slices.groupBy("slice").agg(F.max("t").alias("t"), *sums)  # a row for each slice
    upto = [F.sum(c).over(through).alias(c) for c in ("done", "rate", "begun")]
    ends = ends.select("slice", "t", *upto).withColumn("served", _served()).orderBy("slice")
    crossed = ends.where(F.col("served") >= budget).first()
    if crossed is None:
        last = ends.agg(F.max("t")).first()[0]
        return float(last or 0.0)
    start = ends.where(F.col("slice") < crossed.slice).orderBy(F.desc("slice")).first()
    base = {c: start[c] if start else 0 for c in ("done", "rate", "begun")}
    # events of one slice; those at one time count together
    within = Window.orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = slices.where(F.col("slice") == crossed.slice)
    inside = inside.select("t", *((F.sum(c).over(within) + F.lit(base[c])).alias(c) for c in base))
    past = inside.withColumn("served", _served()).where(F.col("served") < budget).agg(F.max(F.struct("t", "served", "rate"))).first()[0]
    if past is None:  # reached since the slice before ended
        past = {"t": start.t, "served": start.served, "rate": start.rate} if start else {"t": 0.0, "served": 0.0, "rate": 1}
    return past["t"] + (budget - past["served"]) / max(past["rate"], 1)


def _served():
    return F.col("done") + F.col("rate") * F.col("t") - F.col("begun")


def word_count(docs: DataFrame):
    return F.coalesce(F.regexp_count(column_or_null(docs, "text", "string"), F.lit(WORD)), F.lit(0)).cast("long")


def fair_queue(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    seed: str = "mix",
    slice_rows: int = 2_000,
    size: str | None = None,
) -> DataFrame:
    """Columns of docs (doc_id, text, source and others), and for each document what the mix takes of it.

    size: words of the text (null: 0), or the column that `size` names. source_size, target: of its source. taken: words
    served before the queue is cut off, repeats counted; at most `passes` times size. finish: virtual time at which its
    first pass would be done. Documents are shuffled by md5 of seed and doc_id, ties by doc_id, size and text (where docs
    has one), so that reruns agree. Null sources count as one source, null ids as the text "null", an empty table gives no
    rows; other columns are kept as they are, and those with this operator's names are replaced.
    """
    made = ("size", "source_size", "target", "taken", "finish")
    words = word_count(docs) if size is None else F.coalesce(F.col(size), F.lit(0)).cast("long")
    docs = docs.withColumn("_size", words).drop(*made)
    mine = [c for c in docs.columns if c != "source"]
    source = column_or_null(docs, "source", "string").alias("source")
    sized = docs.select(*(F.col(f"`{c}`") for c in mine), source).withColumnRenamed("_size", "size")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = sized.withColumn("_key", key)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sums = materialize(sums, "sources")
    slices = F.greatest(F.lit(1), F.ceil(F.col("_rows") / slice_rows)).cast("long")
    sources = source_targets(sums.select("source", "source_size"), weights, share, passes)
    counts = sums.select(F.col("source").alias("_s"), slices.alias("_slices"))
    sources = sources.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sources = sources.withColumnRenamed("source", "_source")
    # one row a source; Spark chooses the join by its size, and splits a hot source's partitions
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    first = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    share_of_key = (first * F.col("_slices")).cast("decimal(38,0)") / F.lit(1 << 32)
    placed = placed.withColumn("_slice", F.floor(share_of_key).cast("long"))
    by_slice = placed.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    over = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start")
    starts = by_slice.select(F.col("source").alias("_source"), F.col("_slice").alias("_at"), begun)
    ties = ["text"] if "text" in mine else []
    within = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", *ties)
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    queued = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_at"))
    queued = queued.join(starts, same).withColumn("_before", F.col("_before") + F.col("_start"))
    kept = [*(c for c in mine if c != "_size"), "source", "size", "source_size", "target", "weight", "_before"]
    queued = materialize(queued.select(*(F.col(f"`{c}`") for c in kept)), "queued")

    whole = sums.agg(F.sum("source_size")).first()[0] or 0
    end = cut_off(queued, whole * share, passes, slice_rows)
    served = F.lit(0).cast("long")
    reached = F.floor(F.lit(end) * F.col("weight") + 1e-6)  # of the source's tokens; sums of doubles fall a little short
    for k in range(passes):
        before = F.col("_before") + k * F.col("source_size")
        served = served + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), reached - before))
    out = queued.withColumn("taken", served).withColumn("finish", (F.col("_before") + F.col("size")) / F.col("weight"))
    named = ["source"] if "source" in docs.columns else []
    return out.select(*(F.col(f"`{c}`") for c in mine if c != "_size"), *named, *made)


def documents_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: whole repeats, and the words served of the pass that the budget cuts off. A repeat is
    a row of its own with the same doc_id; n_chars is that of its text. Documents without words aren't served."""
    columns = docs.columns
    # texts stay out of the queue, digests break its ties; they come back by a key of the row
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    source = column_or_null(keyed, "source", "string").alias("source")
    light = keyed.select("_row", "doc_id", source, F.md5("text").alias("text"), word_count(keyed).alias("_words"))
    served = fair_queue(light, size="_words", **how).where("taken > 0").select("_row", F.col("size").alias("_size"), "taken")
    mixed = keyed.join(served, "_row")
    upto = F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("_size")).cast("long"))
    rows = mixed.withColumn("_pass", F.explode(upto))
    rows = rows.withColumn("_words", F.least(F.col("_size"), F.col("taken") - F.col("_pass") * F.col("_size")))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(F.concat_ws("", F.slice(words, F.lit(1), F.col("_words").cast("int"))))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
