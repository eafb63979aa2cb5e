"""Runs of consecutive events of one speaker, found by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.functions.labels import speaker_key
from castwright.operators.intervals import LOW, prefix_max
from castwright.operators.ordered import PART, carried_scan, range_sorted
from castwright.session import cut

GAP_MS = 200


def _stretch(batch: pd.DataFrame) -> np.ndarray:
    return (batch["entity"] + "\x00" + batch["speaker"]).to_numpy()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, n, last, high, whole = None, 0, None, LOW, True
    for batch in batches:
        if not len(batch):
            continue
        stretch = _stretch(batch)
        if part is None:
            part, last = int(batch[PART].iloc[0]), stretch[0]
        whole = whole and bool((stretch == last).all())
        _, upto = prefix_max(stretch, batch["end_ms"].to_numpy(), last, high)
        n, last, high = n + len(batch), stretch[-1], int(upto[-1])
    if part is not None:
        yield pd.DataFrame({PART: [part], "n": [n], "last": [last], "high": [high], "whole": [whole]})


def _combine(state: tuple, row: dict) -> tuple:
    """State: events so far, last stretch (entity and speaker), its latest end."""
    n, last, high = state
    goes_on = row["whole"] and row["last"] == last
    return n + row["n"], row["last"], max(high, row["high"]) if goes_on else row["high"]


def _links(gap_ms: int):
    def scan(batches: Iterator[pd.DataFrame], state: tuple) -> Iterator[pd.DataFrame]:
        n, last, high = state
        for batch in batches:
            stretch, start = _stretch(batch), batch["start_ms"].to_numpy()
            before, upto = prefix_max(stretch, batch["end_ms"].to_numpy(), last, high)
            # LOW marks the first event of a stretch; comparing the difference would overflow there.
            follows = (before > LOW) & (start <= np.where(before > LOW, before, 0) + gap_ms)
            at = np.arange(len(batch))
            ptr = np.where(follows, at - 1, at)
            ptr[0] = 0
            while (ptr[ptr] != ptr).any():  # pointer doubling within the batch, before anything is shuffled
                ptr = ptr[ptr]
            open_ = (ptr == 0) & follows[0]
            ptr += n
            if follows[0]:
                ptr[0] -= 1
            edge = open_.copy()
            edge[-1] = True
            yield pd.DataFrame({"pos": n + at, "ptr": ptr, "done": ~open_, "edge": edge, "event_no": batch["event_no"], "start_ms": start, "end_ms": batch["end_ms"], "entity": batch["entity"], "speaker": batch["speaker"]})
            n, last, high = n + len(batch), stretch[-1], int(upto[-1])

    return scan


def run_heads(links: DataFrame) -> DataFrame:
    """``pos, head``: the first event of the run of each event, by pointer doubling.

    ``links`` has ``pos, ptr, done`` of all events that aren't ``done`` and of all that these point at. In each
    self-join an event takes over its target's pointer, so the distance doubles, until the target has arrived. No more
    events point at one target than a batch has rows, so no join key is hot.
    """
    at = cut(links.select("pos", "ptr", "done"))
    while at.where("not done").limit(1).count():
        target = at.select(F.col("pos").alias("t_pos"), F.col("ptr").alias("t_ptr"), F.col("done").alias("t_done"))
        moved = at.where("not done").join(target, F.col("ptr") == F.col("t_pos")).select("pos", F.col("t_ptr").alias("ptr"), F.col("t_done").alias("done"))
        at = cut(moved.unionByName(at.where("done")))
    return at.select("pos", F.col("ptr").alias("head"))


def collapse_runs(df: DataFrame, entity: str = "episode_id", event_no: str = "dseg_no", speaker: str = "speaker", start: str = "start_ms", end: str = "end_ms", gap_ms: int = GAP_MS) -> DataFrame:
    """One row for each run: ``entity, speaker, first_no, last_no, n_events, start_ms, end_ms, duration_ms``.

    An event continues the run if it is of the same speaker as the event before it (by start, end, number) and starts
    at most ``gap_ms`` after the latest end in the run so far. An end of an earlier run can't reach past the break
    behind it, so the latest end of the whole stretch of the speaker decides, which a carried scan knows.

    Each (entity, event_no) counts once; of different rows under one number the least (start, end, speaker) counts.
    Events without start, end or number are left out. Null, blank and 'unknown' speakers are one speaker. A null
    entity is an entity of its own. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("v"), F.col(entity).cast("string")), F.lit("n")).alias("entity"),
        F.col(event_no).cast("bigint").alias("event_no"),
        F.col(start).cast("bigint").alias("start_ms"),
        F.col(end).cast("bigint").alias("end_ms"),
        speaker_key(F.col(speaker)).alias("speaker"),
    ).where("event_no is not null and start_ms is not null and end_ms is not null")
    once = rows.groupBy("entity", "event_no").agg(F.min(F.struct("start_ms", "end_ms", "speaker")).alias("x")).select("entity", "event_no", "x.*")
    ordered = range_sorted(once, ["entity", "start_ms", "end_ms", "event_no"])
    events = cut(
        carried_scan(
            ordered, "n bigint, last string, high bigint, whole boolean", _summaries, _combine, (0, None, LOW),
            "pos bigint, ptr bigint, done boolean, edge boolean, event_no bigint, start_ms bigint, end_ms bigint, entity string, speaker string", _links(gap_ms),
        )
    )
    # Events whose run starts in their own batch have arrived; only the others and their targets are joined.
    heads = run_heads(events.where("edge or not done"))
    fields = ["head", "pos", "event_no", "entity", "speaker", "start_ms", "end_ms"]
    arrived = events.where("done").withColumn("head", F.col("ptr")).select(*fields)
    joined = events.where("not done").join(heads, "pos").select(*fields)
    runs = (
        arrived.unionByName(joined)
        .groupBy("head")
        .agg(
            F.min(F.struct("pos", "event_no", "entity", "speaker")).alias("a"),
            F.max(F.struct("pos", "event_no")).alias("z"),
            F.count(F.lit(1)).alias("n_events"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
        )
    )
    return runs.select(
        F.when(F.col("a.entity") != "n", F.expr("substring(a.entity, 2)")).cast(df.schema[entity].dataType).alias(entity),
        F.col("a.speaker").alias("speaker"),
        F.col("a.event_no").alias("first_no"),
        F.col("z.event_no").alias("last_no"),
        "n_events", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
    )
