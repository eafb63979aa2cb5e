"""Landed WAV files: duration and slices from the header, without decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wav_seconds(data: bytes | None) -> float:
    """Frames by rate of a PCM header; 0.0 if it isn't one."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return 0.0
    at, rate, width = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(data):
            rate, width = struct.unpack("<I", data[at + 12 : at + 16])[0], struct.unpack("<H", data[at + 20 : at + 22])[0]
        if name == b"data":
            return size / (rate * width) if rate and width else 0.0
        at += 8 + size + size % 2
    return 0.0


def read_durations(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """``path, seconds`` of WAV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "seconds": b["content"].map(wav_seconds).astype("float64")})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, "path string, seconds double")


def slices(durations: DataFrame, step: int = 600) -> DataFrame:
    """``path, chunk_idx, offset_sec, seconds``: chunks of ``step`` seconds, the last one shorter."""
    n = F.greatest(F.ceil(F.col("seconds") / step).cast("int"), F.lit(1))
    return durations.where("seconds > 0").select("path", "seconds", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx")).select("path", "chunk_idx", (F.col("chunk_idx") * step).alias("offset_sec"), F.least(F.lit(float(step)), F.col("seconds") - F.col("chunk_idx") * step).alias("seconds"))
