"""Runs of one speaker over a stream of segments. The reference semantics has no streams; this is an extension.

session_window can't express it: another speaker in between must end a run. The state of an episode is its open run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SEGMENTS = "episode_id string, seg_no int, text string, start_ms bigint, end_ms bigint, speaker string, loaded_at timestamp"
RUNS = "episode_id string, speaker string, first_no int, last_no int, start_ms bigint, end_ms bigint"


def read_segments(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of segment files."""
    return spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_runs(stream: DataFrame, gap_ms: int = 200) -> DataFrame:
    """Runs as they close; rows of a batch are taken in the order of seg_no, a row behind the open run is late and dropped.

    The last run of an episode stays open until a segment of another run comes. (A processing-time timeout would keep
    a query over the files at hand from ending.)
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        open_run = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).drop_duplicates("seg_no").sort_values("seg_no")
        for speaker, no, start, end in zip(rows["speaker"].fillna("UNKNOWN"), rows["seg_no"], rows["start_ms"], rows["end_ms"]):
            if pd.isna(start) or pd.isna(end) or open_run is not None and no <= open_run[2]:
                continue
            if open_run is not None and speaker == open_run[0] and start - open_run[4] <= gap_ms:
                open_run[2], open_run[4] = int(no), int(end)
            else:
                if open_run is not None:
                    out.append((key[0], *open_run))
                open_run = [speaker, int(no), int(no), int(start), int(end)]
        if open_run is not None:
            state.update(tuple(open_run))
        yield pd.DataFrame(out, columns=["episode_id", "speaker", "first_no", "last_no", "start_ms", "end_ms"])

    return stream.groupBy("episode_id").applyInPandasWithState(step, RUNS, "speaker string, first_no int, last_no int, start_ms bigint, end_ms bigint", "append", "NoTimeout")
