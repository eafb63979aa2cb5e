"""Snapshots of documents and handoffs. A snapshot is written whole by the committer, and no snapshot is written over its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.functions.text import change_counts, clean_markdown


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents (``episode_id, md, warnings``) as Parquet, those with warnings apart as 'degraded'."""
    quality = F.when(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0, "degraded").otherwise("final")
    docs.withColumn("quality", quality).write.mode(mode).partitionBy("quality").parquet(path)


def read_documents(spark: SparkSession, path: str, quality: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if quality is None else df.where(F.col("quality") == quality)


def write_handoffs(handoffs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Handoffs (``episode_id, handoff``), one JSON object in a line."""
    handoffs.select(F.col("handoff").alias("value")).write.mode(mode).text(path)


def rewrite(spark: SparkSession, source: str, target: str, apply: bool = False) -> DataFrame:
    """What rewriting a snapshot would change, for each document; with ``apply`` the rewritten snapshot is written to ``target``."""
    if apply and source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a snapshot can't be written over its source")
    docs = read_documents(spark, source)
    if apply:
        docs.withColumn("md", clean_markdown(F.col("md"))).write.partitionBy("quality").parquet(target)
    return docs.select("episode_id", change_counts(F.col("md")).alias("n")).select("episode_id", "n.*")
