"""Aggregates over speakers and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.labels import UNKNOWN
from castwright.functions.vectors import dot, unit

# Thresholds of collapsed clusterings and of representative clips.
MIN_TOTAL, MIN_SINGLE, MIN_TOP, TOP_SHARE = 50, 200, 300, 0.95
CLIP_MS = (3_000, 30_000)


def speaker_counts(df: DataFrame, by: str = "episode_id") -> DataFrame:
    """``by, speaker, n``; null and '' speakers are UNKNOWN."""
    return df.groupBy(by, F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN)).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


def collapsed_clusters(df: DataFrame, expected: Column | None = None, by: str = "episode_id") -> DataFrame:
    """``by, total, n_clusters, top, top_n, reasons``: whether one cluster took (nearly) all segments."""
    per = speaker_counts(df, by).groupBy(by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_clusters"), F.min(F.struct((-F.col("n")).alias("m"), "speaker")).alias("t"))
    per = per.select(by, "total", "n_clusters", F.col("t.speaker").alias("top"), (-F.col("t.m")).alias("top_n"))
    single = (F.col("n_clusters") == 1) & (F.col("total") >= MIN_SINGLE)
    taken = (F.col("n_clusters") > 1) & (F.col("top_n") >= MIN_TOP) & (F.col("top_n") >= TOP_SHARE * F.col("total"))
    reasons = [F.when(single, "single"), F.when(taken, "taken")] + ([F.when(F.col("n_clusters") + 1 < expected, "fewer")] if expected is not None else [])
    return per.withColumn("reasons", F.when(F.col("total") >= MIN_TOTAL, F.array_compact(F.array(*reasons))).otherwise(F.array().cast("array<string>")))


def speaker_preview(df: DataFrame) -> DataFrame:
    """``episode_id, speaker, n, n_chars, first_text``: segments, stripped characters and the first text that isn't blank."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return df.groupBy("episode_id", F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("n_chars"), F.min_by(text, F.when(text != "", F.col("seg_no"))).alias("first_text"))


def representative_clips(df: DataFrame) -> DataFrame:
    """``episode_id, speaker, seg_no, ms``: of each speaker the longest clip of 3-30 s.

    Where there is none, the class of the speaker's first clip decides: of short clips the longest, of long ones the
    shortest. The first counts of equal ones.
    """
    ms = F.col("end_ms") - F.col("start_ms")
    timed = df.where("speaker is not null and end_ms > start_ms and seg_no is not null").select("episode_id", "speaker", "seg_no", ms.alias("ms")).distinct()
    low, high = CLIP_MS
    pick = lambda value, cond: F.min(F.when(cond, F.struct(value.alias("v"), F.col("seg_no").alias("no"), F.col("ms").alias("ms"))))
    per = timed.groupBy("episode_id", "speaker").agg(
        pick(-F.col("ms"), F.col("ms").between(low, high)).alias("fit"), pick(-F.col("ms"), F.col("ms") < low).alias("short"), pick(F.col("ms"), F.col("ms") > high).alias("long"), F.min_by("ms", "seg_no").alias("first_ms")
    )
    best = F.coalesce("fit", F.when(F.col("first_ms") < low, F.col("short")).otherwise(F.col("long")))
    return per.select("episode_id", "speaker", best["no"].alias("seg_no"), best["ms"].alias("ms"))


def _centroids(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit vectors, and for each label the sum of its unit vectors; its size grows with the labels, not with the rows."""
    units = df.where("embedding is not null and label is not null").select("vec_id", "label", unit(F.col("embedding")).alias("u"))
    sums = units.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return units, sums.join(units.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")


def mean_similarity(df: DataFrame) -> DataFrame:
    """``vec_id, label, centrality``: mean cosine to the other vectors of the label; 0 for a label of one.

    The mean over pairs is the product with the sum of the unit vectors, so no pairs are made.
    """
    units, sums = _centroids(df)
    inner = dot(F.col("u"), F.col("c")) - dot(F.col("u"), F.col("u"))
    return units.join(sums, "label").select("vec_id", "label", F.when(F.col("size") > 1, inner / (F.col("size") - 1)).otherwise(0.0).alias("centrality"))


def silhouette(df: DataFrame, blocks: int = 8, broadcast_labels: int = 10_000) -> DataFrame:
    """``n, silhouette``: mean silhouette by cosine distance; vectors alone in their label are left out, fewer than two labels give 0.

    Mean distances come from the labels' sums, so each vector meets each label once and no other vector. The sums
    travel to the vectors while there are at most ``broadcast_labels`` (counted first); beyond that the labels lie in
    blocks, and a vector goes to each block in a salted part of it.
    """
    units, sums = _centroids(df)
    if df.select("label").distinct().limit(broadcast_labels + 1).count() <= broadcast_labels:
        apart = units.withColumnRenamed("label", "own").withColumn("one", F.lit(1)).join(F.broadcast(sums.withColumn("one", F.lit(1))), "one").drop("one")
    else:
        salt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = units.select("vec_id", F.col("label").alias("own"), "u", salt(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
        apart = left.join(sums.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")))), ["block", "salt"])
    same = F.col("own") == F.col("label")
    near = dot(F.col("u"), F.col("c"))
    mean = F.when(same, (F.col("size") - 1 - (near - dot(F.col("u"), F.col("u")))) / (F.col("size") - 1)).otherwise(1 - near / F.col("size"))
    per = apart.withColumn("d", F.when(~same | (F.col("size") > 1), mean)).groupBy("vec_id").agg(F.max(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b")).where("a is not null and b is not null")
    value = F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def pairwise_percentile(df: DataFrame, q: float = 0.1, group: str = "label") -> DataFrame:
    """``group, n, p``: exact linear percentile of the cosines of all pairs of a group; for groups of clips, which are small."""
    v = df.where("embedding is not null").select(group, "vec_id", unit(F.col("embedding")).alias("u"))
    pairs = v.join(v.select(group, F.col("vec_id").alias("other"), F.col("u").alias("w")), group).where("vec_id < other")
    sim = F.greatest(dot(F.col("u"), F.col("w")), F.lit(0.0))
    return pairs.select(group, sim.alias("sim")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile("sim", F.lit(q)).alias("p"))
