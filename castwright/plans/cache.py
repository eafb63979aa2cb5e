"""Keyed caches: fingerprints, lookups and idempotent continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def episode_key(url: Column, date: Column, stage: Column) -> Column:
    """16 hex digits of sha256 of url|date|stage, outer bars stripped; nulls are ''."""
    parts = F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.coalesce(date, F.lit("")), F.lit("|"), F.coalesce(stage, F.lit("")))
    return F.left(F.sha2(F.trim(parts, F.lit("|")), 256), F.lit(16))


def fingerprint(*fields: Column) -> Column:
    """One digest of fields, each with its length so that none runs into the next; null differs from ''."""
    tagged = [F.coalesce(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("~")) for f in fields]
    return F.sha2(F.concat_ws("|", *tagged), 256)


def put(cache: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """The cache with entries added or replaced by key."""
    return cache.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries)


def pending(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """What the cache doesn't hold."""
    return work.join(cache.select(key).distinct(), key, "left_anti")


def retention(body: Column, source: Column) -> Column:
    """Share of a source's characters that a document's body keeps, both without labels and blanks."""
    from castwright.functions.text import strip_labels

    return F.length(strip_labels(body)) / F.greatest(F.length(strip_labels(source)), F.lit(1))
