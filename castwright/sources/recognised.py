"""Raw payloads of a recogniser as segments: text by words, one unit of time for each payload, tags stripped, neighbours merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.text import strip_tags
from castwright.operators.islands import merge_neighbours

RAW = "episode_id string, chunk_idx int, sentences array<struct<start:double,end:double,text:string,spk:int>>, words array<string>, ts array<struct<s:double,e:double>>"


def in_milliseconds(raw: DataFrame) -> Column:
    """1 or 1000: what the times of a payload are multiplied by; some time of 1000 or more means milliseconds."""
    times = F.concat(F.transform(F.coalesce("sentences", F.array()), lambda s: F.greatest(s["start"], s["end"])), F.transform(F.coalesce("ts", F.array()), lambda t: F.greatest(t["s"], t["e"])))
    return F.when(F.coalesce(F.array_max(times), F.lit(0.0)) >= 1000, 1).otherwise(1000)


def words_between(words: Column, ts: Column, start: Column, end: Column) -> Column:
    """The words that begin in [start, end), in order, joined as they are."""
    pairs = F.arrays_zip(words.alias("w"), ts.alias("t"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: (p["t"]["s"] >= start) & (p["t"]["s"] < end)), lambda p: p["w"]), "")


def read_segments(raw: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """``episode_id, seg_no, text, start_ms, end_ms, speaker`` of raw payloads, before merging.

    A sentence without text takes its words; times of a chunk get its offset; a null time is 0; blank sentences go.
    """
    scaled = raw.withColumn("__u", in_milliseconds(raw)).withColumns({"words": F.coalesce("words", F.array().cast("array<string>")), "ts": F.coalesce("ts", F.array().cast("array<struct<s:double,e:double>>"))})
    s = scaled.select("episode_id", F.coalesce("chunk_idx", F.lit(0)).alias("chunk_idx"), "__u", "words", "ts", F.posexplode("sentences").alias("at", "x"))
    text = strip_tags(F.coalesce(F.nullif(F.trim("x.text"), F.lit("")), words_between(F.col("words"), F.col("ts"), F.col("x.start"), F.col("x.end"))))
    ms = lambda c: (F.round(F.coalesce(c, F.lit(0.0)) * F.col("__u")).cast("bigint") + F.col("chunk_idx").cast("bigint") * chunk_ms)
    speaker = F.when(F.col("x.spk").isNotNull(), F.format_string("SPEAKER_%02d", "x.spk"))
    rows = s.select("episode_id", (F.col("chunk_idx").cast("bigint") * 1_000_000 + F.col("at")).alias("seg_no"), text.alias("text"), ms(F.col("x.start")).alias("start_ms"), ms(F.col("x.end")).alias("end_ms"), speaker.alias("speaker"))
    return rows.where("text <> ''")


def recognised_segments(raw: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Segments with neighbours of one speaker within 200 ms joined; an episode whose first segment has no speaker isn't merged."""
    rows = read_segments(raw, chunk_ms)
    first = rows.groupBy("episode_id").agg(F.min_by(F.struct("speaker"), "seg_no").alias("f")).select("episode_id", F.col("f.speaker").isNotNull().alias("merges"))
    flagged = rows.join(first, "episode_id")
    merged = merge_neighbours(flagged.where("merges").select("episode_id", F.col("seg_no").alias("no"), F.col("speaker").alias("key"), "start_ms", "end_ms", "text"))
    alone = flagged.where("not merges").select("episode_id", F.col("seg_no").alias("first_no"), "text", "start_ms", "end_ms", "speaker")
    return merged.select("episode_id", "first_no", "text", "start_ms", "end_ms", F.nullif("key", F.lit("")).alias("speaker")).unionByName(alone)


def first_row(nested: Column) -> Column:
    """The first vector of what an embedding model returned, an array of arrays."""
    return F.get(nested, F.lit(0))
