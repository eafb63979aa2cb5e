"""Merging of neighbouring rows of one key, over the global order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.operators.ordered import PART, carried_scan, range_sorted


def _group(batch: pd.DataFrame) -> np.ndarray:
    return (batch["episode_id"] + "\x00" + batch["key"]).to_numpy()


def _opens(batch: pd.DataFrame, last: object, end: int | None, gap_ms: int | None) -> np.ndarray:
    group = _group(batch)
    new = np.append(group[:1] != last, group[1:] != group[:-1])
    if gap_ms is not None:
        start, ends = batch["start_ms"].to_numpy(), batch["end_ms"].to_numpy()
        before = np.append([end if end is not None else 0], ends[:-1])
        new |= start - before > gap_ms
    return new


def _summaries(gap_ms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, end, tail, first, first_start = None, None, None, None, None, None
        for batch in batches:
            if not len(batch):
                continue
            if part is None:
                part, first, first_start = int(batch[PART].iloc[0]), _group(batch)[0], int(batch["start_ms"].iloc[0])
                last, end, tail = first, first_start, int(batch["no"].iloc[0])
                opened = False
            new = np.flatnonzero(_opens(batch, last, end, gap_ms))
            if len(new):
                tail, opened = int(batch["no"].iloc[new[-1]]), True
            last, end = _group(batch)[-1], int(batch["end_ms"].iloc[-1])
        if part is not None:
            yield pd.DataFrame({PART: [part], "first": [first], "first_start": [first_start], "last": [last], "end": [end], "tail": [tail], "opened": [opened]})

    return run


def _combine(gap_ms):
    def combine(state: tuple, row: dict) -> tuple:
        last, end, tail = state
        joins = row["first"] == last and (gap_ms is None or row["first_start"] - end <= gap_ms)
        return row["last"], row["end"], row["tail"] if row["opened"] or not joins else tail

    return combine


def _scan(gap_ms):
    def run(batches: Iterator[pd.DataFrame], state: tuple) -> Iterator[pd.DataFrame]:
        last, end, tail = state
        for batch in batches:
            new, no = _opens(batch, last, end, gap_ms), batch["no"].to_numpy()
            at = np.maximum.accumulate(np.where(new, np.arange(len(no)), -1))
            island = np.where(at >= 0, no[np.maximum(at, 0)], -1 if tail is None else tail)
            yield batch[["episode_id", "key", "no", "start_ms", "end_ms", "text"]].assign(island=island)
            last, end, tail = _group(batch)[-1], int(batch["end_ms"].iloc[-1]), int(island[-1])

    return run


def merge_neighbours(df: DataFrame, gap_ms: int | None = 200, separator: str = " ") -> DataFrame:
    """``episode_id, key, first_no, last_no, n, start_ms, end_ms, text`` of maximal sequences of one key.

    ``df`` has ``episode_id, no, key, start_ms, end_ms, text``; the order is that of ``no``. A row joins the row
    before it if the key is the same and it starts at most ``gap_ms`` after that row's end (None: whatever lies
    between). The end is that of the last row. Null keys are one key ''; null times count as 0, null texts as ''; rows
    without episode_id or no are left out.
    """
    rows = df.where("episode_id is not null and no is not null").select(
        F.col("episode_id").cast("string").alias("episode_id"), F.col("no").cast("bigint").alias("no"), F.coalesce("key", F.lit("")).alias("key"),
        F.coalesce(F.col("start_ms").cast("bigint"), F.lit(0)).alias("start_ms"), F.coalesce(F.col("end_ms").cast("bigint"), F.lit(0)).alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"),
    )
    marked = carried_scan(
        range_sorted(rows, ["episode_id", "no"]), "first string, first_start bigint, last string, end bigint, tail bigint, opened boolean", _summaries(gap_ms), _combine(gap_ms), (None, None, None),
        "episode_id string, key string, no bigint, start_ms bigint, end_ms bigint, text string, island bigint", _scan(gap_ms),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    return marked.groupBy("episode_id", "island", "key").agg(
        F.max("no").alias("last_no"), F.count(F.lit(1)).alias("n"), F.min_by("start_ms", "no").alias("start_ms"), F.max_by("end_ms", "no").alias("end_ms"), F.array_join(F.filter(parts, lambda t: t != ""), separator).alias("text")
    ).select("episode_id", "key", F.col("island").alias("first_no"), "last_no", "n", "start_ms", "end_ms", "text")
