"""Joins of intervals and points in time, by time buckets, so that neither a long table nor a hot episode meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.labels import UNKNOWN


SPREAD = 32


def _coarsest(lengths: list[Column], sides: list[DataFrame], width: int) -> int:
    """The level that the longest interval needs: a bucket of the next level is ``SPREAD`` times as wide, and no interval lies in many more buckets than that."""
    longest = max((df.agg(F.max(n)).first()[0] or 0) for df, n in zip(sides, lengths))
    level = 0
    while longest > width * SPREAD ** (level + 1):
        level += 1
    return level


def _width(level: Column, width: int) -> Column:
    return (F.lit(width) * F.pow(F.lit(SPREAD), level)).cast("bigint")


def _own_level(length: Column, width: int, coarsest: int) -> Column:
    """The least level at which an interval lies in few buckets."""
    level = F.lit(0)
    for n in range(1, coarsest + 1):
        level = F.when(length > width * SPREAD**n, n).otherwise(level)
    return level


def _places(start: Column, end: Column, own: Column, coarsest: Column | int, width: int) -> Column:
    """array<struct<level, bucket>> of an interval, from its own level up."""
    top = F.lit(coarsest) if isinstance(coarsest, int) else coarsest
    at = lambda n: F.transform(F.sequence(F.floor(start / _width(n, width)), F.floor((end - 1) / _width(n, width))), lambda b: F.struct(n.cast("int").alias("level"), b.alias("bucket")))
    return F.flatten(F.transform(F.sequence(own, top), at))


def overlap_speaker(segments: DataFrame, diarization: DataFrame, width_ms: int = 10_000) -> DataFrame:
    """``episode_id, seg_no, speaker, overlap_ms``: the diarized speaker with the largest overlap with each segment.

    Of equal overlaps the earliest start counts, then the earliest end and the least label; a segment without
    overlap, or without times, gets UNKNOWN and 0. A segment meets only the events of its own buckets.
    """
    seg = segments.where("episode_id is not null and seg_no is not null").groupBy("episode_id", "seg_no").agg(F.min(F.struct("start_ms", "end_ms")).alias("t")).select("episode_id", "seg_no", "t.*")
    timed = seg.where("start_ms is not null and end_ms > start_ms").select("episode_id", "seg_no", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    dia = diarization.where("episode_id is not null and start_ms is not null and end_ms > start_ms").select("episode_id", F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"), "start_ms", "end_ms").distinct()
    coarsest = _coarsest([F.col("e") - F.col("s"), F.col("end_ms") - F.col("start_ms")], [timed, dia], width_ms)
    timed = timed.withColumn("own", _own_level(F.col("e") - F.col("s"), width_ms, coarsest))
    timed = timed.withColumn("p", F.explode(_places(F.col("s"), F.col("e"), F.col("own"), coarsest, width_ms))).select("episode_id", "seg_no", "s", "e", "own", "p.*")
    dia = dia.withColumn("their", _own_level(F.col("end_ms") - F.col("start_ms"), width_ms, coarsest))
    dia = dia.withColumn("p", F.explode(_places(F.col("start_ms"), F.col("end_ms"), F.col("their"), coarsest, width_ms))).select("episode_id", "speaker", "start_ms", "end_ms", "their", "p.*")
    shared = F.least("e", "end_ms") - F.greatest("s", "start_ms")
    # A pair meets at the level of the longer one, and counts in the first bucket that both lie in.
    first = F.col("bucket") == F.floor(F.greatest("s", "start_ms") / _width(F.col("level"), width_ms))
    met = timed.join(dia, ["episode_id", "level", "bucket"]).where((F.col("level") == F.greatest("own", "their")) & (F.col("s") < F.col("end_ms")) & (F.col("start_ms") < F.col("e")) & first)
    best = met.groupBy("episode_id", "seg_no").agg(F.min(F.struct((-shared).alias("o"), "start_ms", "end_ms", "speaker")).alias("b"))
    return seg.select("episode_id", "seg_no").join(best, ["episode_id", "seg_no"], "left").select("episode_id", "seg_no", F.coalesce("b.speaker", F.lit(UNKNOWN)).alias("speaker"), F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap_ms"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str = "at_ms", width_ms: int = 10_000) -> DataFrame:
    """Each point with the intervals of its episode that hold it: start <= point < end. Other columns of both are kept."""
    i = intervals.where("start_ms is not null and end_ms > start_ms")
    length = F.col("end_ms") - F.col("start_ms")
    coarsest = _coarsest([length], [i], width_ms)
    own = _own_level(length, width_ms, coarsest)
    i = i.withColumn("__p", F.explode(_places(F.col("start_ms"), F.col("end_ms"), own, own, width_ms))).withColumns({"__level": F.col("__p.level"), "__bucket": F.col("__p.bucket")}).drop("__p")
    p = points.where(f"episode_id is not null and {at} is not null").withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(coarsest)))).withColumn("__bucket", F.floor(F.col(at) / _width(F.col("__level"), width_ms)))
    return p.join(i, ["episode_id", "__level", "__bucket"]).where(f"start_ms <= {at} and {at} < end_ms").drop("__level", "__bucket")


def split_cached(work: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(already done, still to do), by the fingerprint."""
    keys = cache.select(key).where(f"{key} is not null").distinct()
    return work.join(keys, key, "left_semi"), work.join(keys, key, "left_anti")
