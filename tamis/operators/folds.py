"""Folds over a key's rows in order, for state that windows and aggregations can't say.

Rows of a key are sorted within their partition and streamed: a task holds one state and one Arrow batch, however many rows
a key has. Only the columns that a fold needs should come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def fold(
    rows: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, dict], tuple[Any, tuple]],
    made: str,
) -> DataFrame:
    """rows with the columns `made` (DDL): step takes a key's state and a row and gives the new state and the row's values.
    Keys may be null, which is a key of its own. An empty table gives no rows."""
    spark = rows.sparkSession
    added = spark.createDataFrame([], made).schema
    kinds = to_arrow_schema(added)
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    now, state, begun = row[key], start(), True
                state, values = step(state, row)
                out.append(values)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            new = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *kinds.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, whole)
