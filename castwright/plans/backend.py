"""Choice of the diarization backend and the number of speakers from a sweep over K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least silhouette and least share of the smallest cluster, what a small cluster is, further tries.
SILHOUETTE, SHARE, MINOR, TRIES = 0.12, 0.05, 0.15, 3


def best_k(sweep: DataFrame, by: str = "episode_id") -> DataFrame:
    """``by, k, silhouette, min_share``: the K of the best silhouette among those whose clusters are no fragments, the least of equal ones.

    ``sweep``: by, k, silhouette, min_share. Groups without such a K have none.
    """
    usable = sweep.where((F.col("silhouette") >= SILHOUETTE) & (F.col("min_share") >= SHARE))
    top = usable.groupBy(by).agg(F.max(F.struct("silhouette", (-F.col("k")).alias("m"), "min_share")).alias("t"))
    return top.select(by, (-F.col("t.m")).alias("k"), F.col("t.silhouette").alias("silhouette"), F.col("t.min_share").alias("min_share"))


def suggest(sweep: DataFrame, by: str = "episode_id") -> DataFrame:
    """``by, backend, k, silhouette, min_share, minor``: the voice backend with K, or the automatic labels without; ``minor``: the smallest cluster may be no speaker."""
    found = sweep.select(by).distinct().join(best_k(sweep, by), by, "left")
    return found.select(by, F.when(F.col("k").isNotNull(), "wespeaker").otherwise("campplus").alias("backend"), "k", "silhouette", "min_share", F.coalesce(F.col("min_share") < MINOR, F.lit(False)).alias("minor"))


def retried_k(tries: DataFrame, by: str = "episode_id") -> DataFrame:
    """``by, k``: the least K of at most ``TRIES`` above the first without a contradiction, else the last. ``tries``: by, k, ok."""
    first = tries.groupBy(by).agg(F.min("k").alias("base"))
    near = tries.join(first, by).where(F.col("k") <= F.col("base") + TRIES)
    return near.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("k"))), F.max("k")).alias("k"))


def chosen_backend(refresh: Column, auto: Column, suggestion: Column, failed: Column, base_k: Column) -> Column:
    """The backend: a refresh takes the voice backend; 'auto' takes the suggestion of a probe, the automatic labels if it failed, and without a probe the voice backend from three people on."""
    few = F.coalesce(base_k, F.lit(0)) >= 3
    return F.when(refresh, "wespeaker").when(auto & failed, "campplus").when(auto & suggestion.isNotNull(), suggestion).when(few, "wespeaker").otherwise("campplus")


def effective_k(flag: Column, probed: Column, chosen: Column, base_k: Column) -> Column:
    """The number of speakers: the flag, the probe, the choice, else the known number, two at least."""
    return F.coalesce(flag, probed, chosen, F.greatest(F.lit(2), F.coalesce(base_k, F.lit(2))))


def collapse_fallback(segments: DataFrame, collapsed: DataFrame, again: DataFrame) -> DataFrame:
    """``segments`` with the speakers of a second run in episodes that collapsed, where that run has the segment. ``again``: episode_id, seg_no, speaker."""
    bad = collapsed.where("size(reasons) > 0").select("episode_id").distinct()
    second = again.join(bad, "episode_id", "left_semi").groupBy("episode_id", "seg_no").agg(F.min("speaker").alias("__again"))
    return segments.join(second, ["episode_id", "seg_no"], "left").withColumn("speaker", F.coalesce("__again", "speaker")).drop("__again")


def real_time_factor(seconds: Column, duration: Column) -> Column:
    """struct<rtf, two_hours>: elapsed time by duration, and what two hours would take, cut to seconds; null without a duration."""
    rtf = F.try_divide(seconds, F.nullif(duration, F.lit(0.0)))
    return F.struct(rtf.alias("rtf"), F.floor(rtf * 7200).cast("bigint").alias("two_hours"))


def collapse_warning(reasons: Column, command: str) -> Column:
    """The warning of a collapsed clustering: its reasons and how to run again; null without reasons."""
    return F.when(F.size(reasons) > 0, F.concat(F.array_join(reasons, "；"), F.lit(f"。{command}")))
