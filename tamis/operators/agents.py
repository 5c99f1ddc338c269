"""Agents: each says what it decides about a signal that is still active, as a column.

An agent is a function of (signals, active) that returns a column: a struct of outcome, classification and confidence, or
null for no decision. Windows are taken over active signals only. Custom agents have the same form.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tamis import schema
from tamis.operators.anchors import anchored

DECISION = "struct<outcome:string,classification:string,confidence:double>"


@dataclass(frozen=True)
class Agent:
    name: str
    stage: int
    decide: Callable[[DataFrame, Column], Column]
    #: Whether it decides on each signal by itself; then it is worked out once, below the windows of others.
    stateless: bool = False
    #: Adds columns that it needs, from all signals, before any agent decides. Columns that begin with _ go at the end.
    prepare: Callable[[DataFrame], DataFrame] | None = None


def decision(outcome: str, classification: Column | str | None = None, confidence: float = 1.0) -> Column:
    kind = classification if isinstance(classification, Column) else F.lit(classification)
    return F.struct(F.lit(outcome).alias("outcome"), kind.cast("string").alias("classification"), F.lit(float(confidence)).alias("confidence"))


def nothing() -> Column:
    return F.lit(None).cast(DECISION)


def _bypass() -> Column:
    return F.coalesce(F.col("label"), F.lit("")).isin(*schema.BYPASS_LABELS)


def dedup_key(columns: list[str]) -> Column:
    """sha256 of type, source, namespace, severity, message and the places that the signal names."""
    named = [c for c in schema.LOCATION_FIELDS if c in columns]
    place = F.concat_ws("|", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in named)) if named else F.lit("")
    return F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c), F.lit("")) for c in ("signal_type", "source", "namespace", "severity", "message")), place), 256)


def entity_key(columns: list[str]) -> Column:
    """What a reading is about: name=value of the first of ENTITY_KEYS that its labels name, else that its content does.
    Labels are a map, content is columns."""
    found = []
    if "labels" in columns:
        found += [(k, F.try_element_at("labels", F.lit(k))) for k in schema.ENTITY_KEYS]
    found += [(k, F.col(k).cast("string")) for k in schema.ENTITY_KEYS if k in columns]
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}="), c)) for k, c in found]
    return F.coalesce(*named, F.lit(None).cast("string"))


def trend_fields(signals: DataFrame) -> list[str]:
    """Numeric columns whose names say that they are measured, but for those that only number or describe."""
    measured = re.compile(schema.TREND_FIELDS)
    numeric = [f.name for f in signals.schema.fields if isinstance(f.dataType, NumericType)]
    return [n for n in numeric if n not in schema.TREND_IGNORED and measured.search(n)]


def trend(
    fields: tuple[str, ...] | None = None, entity: str | None = None, readings: int = 3, seconds: float | None = None
) -> Agent:
    """Escalates the last of `readings` readings of a thing of which a field rises or falls throughout, by 5 % in all; else
    the last of four, or of one more than `readings`, of which a field turns back each time.

    fields: None for trend_fields. entity: a column that names the thing, None for entity_key. Signals that name none, or
    without any of the fields, are no readings. seconds: readings older than that don't count (None: all do).
    """
    turns = max(readings + 1, 4)

    def decide(signals: DataFrame, active: Column) -> Column:
        names = list(fields) if fields is not None else trend_fields(signals)
        key = F.col(entity) if entity else entity_key(signals.columns)
        if not names:
            return nothing()
        some = key.isNotNull() & F.coalesce(*(F.col(n).cast("double") for n in names)).isNotNull()
        w = Window.partitionBy(F.when(some, key).otherwise(F.concat(F.lit("-"), F.col("seq").cast("string")))).orderBy("seq")

        def last(name: str, n: int) -> list[Column]:
            """The last n values, oldest first; null where there is no such reading, or where it is too old."""
            ages = [F.lag(name, k).over(w) if k else F.col(name) for k in range(n - 1, -1, -1)]
            if seconds is not None:
                fresh = lambda k: F.col("us") - F.lag("us", k).over(w) < int(seconds * 1_000_000)
                ages = [F.when(fresh(n - 1 - k), x) if k < n - 1 else x for k, x in enumerate(ages)]
            return ages

        moves, swings = F.lit(False), F.lit(False)
        for name in names:
            v = last(name, readings)
            pairs = list(zip(v, v[1:], strict=False))
            rises = functools.reduce(lambda a, b: a & b, [x < y for x, y in pairs])
            falls = functools.reduce(lambda a, b: a & b, [x > y for x, y in pairs])
            far = F.when(v[0] != 0, F.abs((v[-1] - v[0]) / v[0]) * 100 >= 5).otherwise(True)
            moves = moves | F.coalesce((rises | falls) & far, F.lit(False))
            v = last(name, turns)
            steps = [y - x for x, y in zip(v, v[1:], strict=False)]
            turned = functools.reduce(lambda a, b: a & b, [x * y < 0 for x, y in zip(steps, steps[1:], strict=False)])
            swings = swings | F.coalesce(turned, F.lit(False))
        return F.when(active & some & (moves | swings), decision("escalate", confidence=0.85))

    return Agent("trend_detector", 0, decide)


def priming(types: tuple[str, ...]) -> Agent:
    """Escalates signals of types for which a window of attention is open."""
    return Agent("priming_escalator", 0, lambda s, active: F.when(active & F.col("signal_type").isin(*types), decision("escalate")), True)


def deduplicate(seconds: float | None = None) -> Agent:
    """All but the first signal of a key; labelled signals are never duplicates. seconds: within a window that opens with
    the first one and isn't moved by those inside (None: the whole batch is one window)."""

    def decide(signals: DataFrame, active: Column) -> Column:
        mine = active & ~_bypass()
        if seconds is not None:
            return F.when(mine & ~F.coalesce("_opens", F.lit(True)), decision("dedupe"))
        w = Window.partitionBy(F.when(mine, dedup_key(signals.columns)).otherwise(F.concat(F.lit("-"), F.col("seq")))).orderBy("seq")
        return F.when(mine & (F.row_number().over(w) > 1), decision("dedupe"))

    def prepare(signals: DataFrame) -> DataFrame:
        opens = anchored(signals, dedup_key(signals.columns), seconds, ~_bypass())
        return signals.join(opens.withColumnRenamed("anchored", "_opens"), "signal_id", "left")

    return Agent("deduplicate", 1, decide, prepare=prepare if seconds is not None else None)


def transient() -> Agent:
    def decide(signals: DataFrame, active: Column) -> Column:
        mine = F.col("signal_type").isin(*schema.TRANSIENT_TYPES) & F.col("severity").isin(*schema.SUPPRESSIBLE)
        return F.when(active & mine & ~F.col("content_text").rlike(schema.NEVER_SUPPRESS), decision("suppress"))

    return Agent("transient_suppressor", 1, decide, True)


def severity_gate() -> Agent:
    def decide(signals: DataFrame, active: Column) -> Column:
        mine = active & (F.col("severity") == "info") & ~_bypass()
        return F.when(mine & F.col("content_text").rlike(schema.ESCALATE), decision("escalate")).when(mine, decision("drop"))

    return Agent("severity_gate", 1, decide, True)


def pattern_class() -> Column:
    """Class of the first pattern that matches; null if none does."""
    found = F
    for _, pattern, kind in schema.PATTERNS:
        found = found.when(F.col("content_text").rlike(pattern), F.lit(kind))
    return found


def pattern_classifier() -> Agent:
    return Agent("pattern_classifier", 2, lambda s, active: F.when(active & pattern_class().isNotNull(), decision("classify", pattern_class(), 0.85)), True)


def threshold_class(columns: list[str]) -> Column:
    """kind_critical over 95, kind_warning over 80, of the first of cpu, memory and disk that is over; zero is no reading."""
    found = F
    for kind, *names in schema.THRESHOLDS:
        reading = F.coalesce(*(F.nullif(F.col(n).cast("double"), F.lit(0.0)) for n in names if n in columns), F.lit(None).cast("double"))
        found = found.when(reading > 95, F.lit(f"{kind}_critical")).when(reading > 80, F.lit(f"{kind}_warning"))
    return found


def threshold_classifier() -> Agent:
    def decide(signals: DataFrame, active: Column) -> Column:
        kind = threshold_class(signals.columns)
        return F.when(active & kind.endswith("_critical"), decision("escalate", kind, 0.95)).when(active & kind.endswith("_warning"), decision("classify", kind, 0.90))

    return Agent("threshold_classifier", 2, decide, True)


def _instance(*columns: str) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def repeat_flood(types: tuple[str, ...], most: int = 3, seconds: int = 300) -> Agent:
    """Suppresses what exceeds `most` of a type, source and namespace in a sliding window; suppressed ones count too."""

    def decide(signals: DataFrame, active: Column) -> Column:
        mine = active & F.col("signal_type").isin(*types) & F.col("severity").isin(*schema.SUPPRESSIBLE)
        key = F.when(mine, _instance("signal_type", "source", "namespace")).otherwise(F.concat(F.lit("-"), F.col("seq")))
        w = Window.partitionBy(key).orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
        return F.when(mine & (F.count("*").over(w) > most), decision("suppress", confidence=0.90))

    return Agent("repeat_flood_suppressor", 3, decide)


def built_in() -> list[Agent]:
    """In the order in which they decide."""
    return [trend(("cpu_percent", "latency_ms"), "source"), deduplicate(), transient(), severity_gate(), pattern_classifier(), threshold_classifier()]
