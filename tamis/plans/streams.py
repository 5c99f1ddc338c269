"""Queries over streams. Their oracle is the batch form where a stream's result doesn't depend on when it stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.plans.recollection import MEMORIES
from tamis.plans.registry import query
from tamis.plans.sieve import _MOVES, _SWINGS, _TRENDS, DAY, _anchored_sql, _over
from tamis.sources.adapters import SIGNALS_SQL
from tamis.streaming import jobs, stateful


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.signals(spark, f"{sf_dir}/events.parquet")


@query("stream_dedup")
def stream_dedup(spark, sf_dir):
    """Approximate by nature: a key is held until the watermark has passed it, and the watermark follows the batches."""
    return jobs.available(jobs.deduplicated(_stream(spark, sf_dir), ["source", "signal_type"], "1 day"), "dedup").select("signal_id", "source", "signal_type")


@query("stream_flood", f"WITH {SIGNALS_SQL}, w AS (SELECT us // 86400000000 AS day, signal_type, source, namespace, count(*) AS n FROM signals GROUP BY ALL) SELECT day, signal_type, source, namespace, n FROM w WHERE n > 3 AND (day + 1) * 86400000000 <= (SELECT max(us) FROM signals) - 3600000000")
def stream_flood(spark, sf_dir):
    """Windows of a day that the watermark has passed."""
    found = jobs.available(jobs.flood_counts(_stream(spark, sf_dir), "1 day", "1 day", "1 hour", 3), "flood")
    return found.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "signal_type", "source", "namespace", "n")


@query(
    "stream_sessions",
    f"""WITH {SIGNALS_SQL}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY source ORDER BY us) >= 6 * 3600000000, true)::INT AS opens FROM signals),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT source, count(*) AS members, CAST(count(DISTINCT signal_type) AS INT) AS types FROM s GROUP BY source, k HAVING max(us) + 6 * 3600000000 <= (SELECT max(us) FROM signals) - 3600000000""",
)
def stream_sessions(spark, sf_dir):
    return jobs.available(jobs.sessions(_stream(spark, sf_dir), "6 hours", "1 hour", "source"), "sessions").select("source", "members", "types")


@query("stream_anchored", _anchored_sql("concat_ws(':', source, signal_type)", "true") + " WHERE first")
def stream_anchored(spark, sf_dir):
    """The anchored windows, by keyed state that looks at rows in order of time."""
    found = stateful.anchored(_stream(spark, sf_dir), ["source", "signal_type"], DAY, end="2100-01-01")
    return found.select("signal_id", F.lit(True).alias("anchored"))


@query("stream_memory", MEMORIES + "SELECT memory_id, signal_type, occurrences, round(strength, 6) AS strength FROM memories")
def stream_memory(spark, sf_dir):
    """Memories merged batch by batch; as many and as strong as those formed at once."""
    return jobs.remember(_stream(spark, sf_dir), ["message"], ["source"]).select("memory_id", "signal_type", "occurrences", F.round("strength", 6).alias("strength"))


_FRESH = ", ".join(f"CASE WHEN us - lag(us, {n}) OVER w < 7 * {DAY}000000 THEN lag({f}, {n}) OVER w END AS {f}{n}" for f in _TRENDS for n in (1, 2, 3))


@query("stream_trends", f"WITH {SIGNALS_SQL}, lagged AS (SELECT signal_id, us, {', '.join(_TRENDS)}, {_FRESH} FROM signals WINDOW w AS (PARTITION BY source ORDER BY us, seq)) SELECT signal_id, us FROM lagged WHERE ({_over(_TRENDS, _MOVES)}) OR ({_over(_TRENDS, _SWINGS)})")
def stream_trends(spark, sf_dir):
    """Trends of each source within a week, from its readings in state; all of them, as the stream is closed."""
    return stateful.trends(_stream(spark, sf_dir), "source", list(_TRENDS), 3, 7 * DAY, "1 hour", end="2100-01-01")


@query(
    "stream_floods",
    f"WITH {SIGNALS_SQL} SELECT signal_id, us FROM (SELECT signal_id, us, count(*) OVER (PARTITION BY signal_type, source, namespace ORDER BY us RANGE BETWEEN {DAY}000000 - 1 PRECEDING AND CURRENT ROW) AS n FROM signals WHERE signal_type IN ('heartbeat', 'probe_failure') AND severity IN ('info', 'low')) WHERE n > 2",
)
def stream_floods(spark, sf_dir):
    """What floods within a day that slides with each signal, from counts in state."""
    mine = _stream(spark, sf_dir).where("signal_type IN ('heartbeat', 'probe_failure') AND severity IN ('info', 'low')")
    return stateful.floods(mine, ["signal_type", "source", "namespace"], 2, DAY, "1 hour", end="2100-01-01")
