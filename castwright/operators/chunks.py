"""Chunking and context of ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_lines(text: Column, limit: int = 8000) -> Column:
    """Whole lines, with their line breaks, packed to chunks of at most ``limit`` characters; ends are stripped.

    A line above the limit gives pieces of its own, and its rest goes on as a line. An empty text is one empty chunk.
    """
    kept = F.split(text, r"(?<=\n)")
    lines = F.filter(kept, lambda s: s != "")
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
    cut = F.flatten(F.transform(lines, pieces))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) <= limit
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["open"], s)).otherwise(s).alias("open"))

    whole = F.aggregate(cut, start, step, lambda acc: F.when((acc["open"] != "") | (F.size(acc["done"]) == 0), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.transform(whole, lambda s: F.regexp_replace(s, r"(?U)\s+\z", ""))


def tagged_lines(speaker: Column, text: Column, limit: int = 1500) -> Column:
    """Lines '[speaker] …' of a turn: its sentences folded to lines of at most ``limit`` characters, each with the label."""
    sentences = F.filter(F.split(text, "(?<=[。！？；])"), lambda s: s != "")
    return F.transform(F.filter(F.transform(fold_sentences(sentences, limit), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.concat(F.lit("["), speaker, F.lit("] "), s))


def fold_sentences(sentences: Column, limit: int = 1500) -> Column:
    """Sentences packed to lines of at most ``limit`` characters, a longer sentence alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(s) <= limit)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, F.concat(acc["open"], s)).otherwise(s).alias("open"))

    return F.filter(F.aggregate(sentences, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))), lambda s: s != "")


def chunk_context(chunks: DataFrame, width: int = 500) -> DataFrame:
    """``doc, chunk_no, text, before, after``: the end of the chunk before and the start of the one after; （无） at the edges.

    The chunks of one text make up a row of it, so a window over them is bounded by the text.
    """
    w = Window.partitionBy("doc").orderBy("chunk_no")
    return chunks.select("doc", "chunk_no", "text", F.coalesce(F.right(F.lag("text").over(w), F.lit(width)), F.lit("（无）")).alias("before"), F.coalesce(F.left(F.lead("text").over(w), F.lit(width)), F.lit("（无）")).alias("after"))


def uniform_sample(df: DataFrame, by: str, order: str, ratio: float) -> DataFrame:
    """Every row i of n with i = floor(j * n / k) for a j < k = max(1, floor(n * ratio))."""
    w = Window.partitionBy(by)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * ratio))
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(order)) - 1
    numbered = df.withColumn("__i", i).withColumn("__n", n).withColumn("__k", k)
    return numbered.where("floor(floor((__i * __k + __n - 1) / __n) * __n / __k) = __i and floor((__i * __k + __n - 1) / __n) < __k").drop("__i", "__n", "__k")
