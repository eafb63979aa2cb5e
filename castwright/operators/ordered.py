"""Scans over a global order with state carried from partition to partition.

A window over one hot entity runs in one task. Here the rows are range-sorted instead, so that an entity of any
size spreads over many partitions; each partition is summarised, the summaries (one row for each partition, so
never more than there are tasks) are combined from left to right, and each partition is scanned again with the
state that the partitions before it leave behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.session import cut

PART = "__part"


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the global order of ``keys``, with their partition's number in ``__part``.

    The result is checkpointed: both scans must see the same partitions even if an executor is lost between them.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(placed.withColumn(PART, F.spark_partition_id()))


def carried_scan(
    ordered: DataFrame,
    summary_schema: str,
    summarise: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    combine: Callable[[Any, dict], Any],
    start: Any,
    schema: str,
    scan: Callable[[Iterator[pd.DataFrame], Any], Iterator[pd.DataFrame]],
) -> DataFrame:
    """Summarise each partition, combine the summaries in order, rescan each partition with its carried state.

    ``summarise`` yields one row for each non-empty partition, ``combine(state, summary)`` gives the state after that
    partition, and ``scan(batches, state)`` reads a partition's batches in order.
    """
    rows = ordered.mapInPandas(summarise, f"{PART} int, {summary_schema}").collect()  # one row for each partition
    states, state = {}, start
    for row in sorted(rows, key=lambda r: r[PART]):
        states[row[PART]] = state
        state = combine(state, row.asDict())

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return

        def again() -> Iterator[pd.DataFrame]:
            yield first
            yield from (b for b in batches if len(b))

        yield from scan(again(), states[int(first[PART].iloc[0])])

    return ordered.mapInPandas(rescan, schema)
