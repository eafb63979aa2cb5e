"""Continuous periods and gaps of overlapping, nested and gapped intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.operators.ordered import PART, carried_scan, range_sorted

LOW = np.iinfo(np.int64).min
PAUSE_MS = 1_800_000


def prefix_max(entity: np.ndarray, end: np.ndarray, last: object, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the latest end of its entity before it and up to it; (last, high) is the state before the first row."""
    n = len(end)
    new = np.ones(n, dtype=bool)
    new[1:] = entity[1:] != entity[:-1]
    new[0] = entity[0] != last
    upto = np.empty(n, dtype=np.int64)
    edges = np.flatnonzero(new)
    if not new[0]:
        edges = np.concatenate(([0], edges))
    for a, b in zip(edges, np.append(edges[1:], n)):
        upto[a:b] = np.maximum.accumulate(end[a:b])
        if a == 0 and not new[0]:
            upto[a:b] = np.maximum(upto[a:b], high)
    before = np.empty(n, dtype=np.int64)
    before[1:] = upto[:-1]
    before[0] = high
    before[new] = LOW
    return before, upto


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, high, tail, first, part = None, LOW, LOW, None, None
    for batch in batches:
        if not len(batch):
            continue
        entity, start = batch["entity"].to_numpy(), batch["from_ms"].to_numpy()
        before, upto = prefix_max(entity, batch["to_ms"].to_numpy(), last, high)
        if first is None:
            first, part = entity[0], int(batch[PART].iloc[0])
        opens = np.flatnonzero(start > before)
        if len(opens):
            tail = int(start[opens[-1]])
        last, high = entity[-1], int(upto[-1])
    if part is not None:
        yield pd.DataFrame({PART: [part], "first": [first], "last": [last], "high": [high], "tail": [tail]})


def _combine(state: tuple, row: dict) -> tuple:
    """State: last entity, its latest end, the start of its open period."""
    last, high, tail = state
    if row["first"] == row["last"] == last:
        # The partition lies within one entity: its open period is the carried one unless it starts beyond it.
        return last, max(high, row["high"]), row["tail"] if row["tail"] > high else tail
    return row["last"], row["high"], row["tail"]


def _scan(batches: Iterator[pd.DataFrame], state: tuple) -> Iterator[pd.DataFrame]:
    last, high, opened = state
    for batch in batches:
        entity, start = batch["entity"].to_numpy(), batch["from_ms"].to_numpy()
        before, upto = prefix_max(entity, batch["to_ms"].to_numpy(), last, high)
        opens = start > before
        label = np.maximum.accumulate(np.where(opens, np.arange(len(start)), -1))
        island = np.where(label >= 0, start[np.maximum(label, 0)], opened)
        ends = np.append(np.flatnonzero(opens[1:]), len(start) - 1)  # the last row of each island in this batch
        gaps = np.flatnonzero(opens & (before > LOW))
        yield pd.DataFrame(
            {
                "entity": np.concatenate((entity[ends], entity[gaps])),
                "kind": ["period"] * len(ends) + ["gap"] * len(gaps),
                "from_ms": np.concatenate((island[ends], before[gaps])),
                "to_ms": np.concatenate((upto[ends], start[gaps])),
            }
        )
        last, high, opened = entity[-1], int(upto[-1]), int(island[-1])


def merge_intervals(df: DataFrame, entity: str = "episode_id", start: str = "start_ms", end: str = "end_ms", pause_ms: int | None = PAUSE_MS) -> DataFrame:
    """Periods and gaps of each entity: ``entity, kind, from_ms, to_ms``.

    Rows are range-sorted by entity and start, so that a hot entity spreads over many tasks. Each partition is
    summarised by the latest end of its last entity, the summaries are prefix-combined, and the rescan with the
    carried latest end labels the islands. Touching intervals are joined.

    Nulls in start or end, reversed and empty intervals don't count. A null entity is an entity of its own (null).
    Repeated rows and ties change nothing. An empty table gives no rows. ``pause_ms``: gaps of this length or more
    are left out; None keeps all. Other columns are not read, whatever their names.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("v"), F.col(entity).cast("string")), F.lit("n")).alias("entity"),
        F.col(start).cast("bigint").alias("from_ms"),
        F.col(end).cast("bigint").alias("to_ms"),
    ).where("from_ms is not null and to_ms is not null and to_ms > from_ms")
    ordered = range_sorted(rows, ["entity", "from_ms", "to_ms"])
    pieces = carried_scan(
        ordered, "first string, last string, high bigint, tail bigint", _summaries, _combine, (None, LOW, LOW),
        "entity string, kind string, from_ms bigint, to_ms bigint", _scan,
    )
    # A period that crosses batches or partitions has a piece in each; the pieces agree in from_ms.
    whole = pieces.groupBy("entity", "kind", "from_ms").agg(F.max("to_ms").alias("to_ms"))
    if pause_ms is not None:
        whole = whole.where(F.expr(f"kind = 'period' or to_ms - from_ms < {int(pause_ms)}"))
    return whole.select(F.when(F.col("entity") != "n", F.expr("substring(entity, 2)")).cast(df.schema[entity].dataType).alias(entity), "kind", "from_ms", "to_ms")
