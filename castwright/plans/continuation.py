"""Keyed caches and idempotent continuation: what is done, what is missing, and a report on each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.plans.cache import fingerprint
from castwright.plans.checks import body_of, check_documents, retention, section_list
from castwright.plans.render import text_of

#: Version of the times in a transcript's cache.
TIMES_VERSION = 2


def valid_entries(cache: DataFrame, paths: DataFrame, stage: str = "final") -> DataFrame:
    """Entries of a result cache that count: of a stage, with a path that exists; a final one is Markdown. ``paths``: path."""
    own = cache.where((F.col("stage") == stage) & F.col("path").isNotNull())
    if stage == "final":
        own = own.where(F.col("path").endswith(".md") & ~F.col("path").endswith(".degraded.md"))
    return own.join(paths.select("path").distinct(), "path", "left_semi")


def relative_path(path: Column, folder: Column) -> Column:
    """The path below a folder if it is in it, else the path."""
    base = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def transcript_key(size: Column, modified: Column, model: Column, options: Column, k: Column) -> Column:
    """Fingerprint of a whole recording: its size and time, the model and its options, the number of speakers, the version of times."""
    return fingerprint(size, modified, model, options, k, F.lit(TIMES_VERSION))


def chunk_key(size: Column, chunk: Column, model: Column, options: Column, unlabelled: Column) -> Column:
    """Fingerprint of a chunk: like the whole's, with its number, without the time."""
    return fingerprint(size, chunk, model, options, unlabelled, F.lit(TIMES_VERSION))


def text_key(source: Column, provider: Column, model: Column, version: Column, notes: Column) -> Column:
    """Fingerprint of a cleaned chunk of text: digest of the source, provider, model, version of the prompt, 16 digits of the notes' digest."""
    return fingerprint(F.sha2(text_of(source), 256), provider, model, version, F.left(F.sha2(text_of(notes), 256), F.lit(16)))


def payload_key(whole: DataFrame, *fields: str) -> Column:
    """Fingerprint of a structured result: the digest of its whole input as ordered JSON."""
    return F.sha2(F.to_json(F.struct(*[text_of(whole[f]).alias(f) for f in fields])), 256)


def accepted_chunk(asked: Column, returned: Column, source: Column, cleaned: Column) -> Column:
    """The cleaned chunk if it is of the same number, not blank and of 0.55 to 1.35 times the length; else its source."""
    share = F.length(cleaned) / F.greatest(F.length(source), F.lit(1))
    good = (asked == returned) & (F.trim(text_of(cleaned)) != "") & share.between(0.55, 1.35)
    return F.when(good, cleaned).otherwise(source)


def repair_source(line: Column, title: Column) -> Column:
    """A source line of two parts with the title between; any other stays."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(line, "^> 来源：", ""), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    mended = F.concat(F.lit("> 来源："), F.get(parts, F.lit(0)), F.lit(" | "), title, F.lit(" | "), F.get(parts, F.lit(1)))
    return F.when(line.startswith("> 来源：") & (F.size(parts) == 2), mended).otherwise(line)


def draft(title: Column, source: Column, notes: Column, transcript: Column) -> Column:
    """A document to be edited: its transcript, and placeholders for what is written by hand."""
    head = F.concat(F.lit("# "), text_of(title), F.lit("\n\n> 来源："), text_of(source), F.lit("\n\n## Show Notes\n\n"), F.coalesce(F.nullif(F.trim(text_of(notes)), F.lit("")), F.lit("（无）")))
    parts = [F.lit(f"\n\n## {h}\n\n- **待校订。** 待提炼") for h in ("摘要", "核心观点", "问题与思考", "人物简介")]
    return F.concat(head, *parts, F.lit("\n\n## 原文转录\n\n"), transcript)


def report(documents: DataFrame, packages: DataFrame) -> DataFrame:
    """``episode_id, exists, n_problems, n_placeholders, kept, n_labels, status`` for each package, from its document if there is one.

    ``documents``: episode_id, md; ``packages``: episode_id, text. Status: 'missing', 'pending' (placeholders or
    problems are left) or 'done'.
    """
    d = packages.select("episode_id", F.col("text").alias("package")).join(documents.select("episode_id", "md"), "episode_id", "left")
    problems = check_documents(d.where("md is not null"), source="package").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_problems"))
    transcript = text_of(body_of(section_list(F.col("md")), "原文转录", "全文转录"))
    row = d.join(problems, "episode_id", "left").select(
        "episode_id", F.col("md").isNotNull().alias("exists"), F.coalesce("n_problems", F.lit(0)).alias("n_problems"), F.coalesce(F.regexp_count("md", F.lit(r"\*\*待校订")), F.lit(0)).alias("n_placeholders"),
        F.round(F.when(F.col("md").isNotNull(), retention(transcript, text_of(F.col("package")))), 6).alias("kept"), F.coalesce(F.regexp_count(transcript, F.lit(r"\[SPEAKER_\d+\]")), F.lit(0)).alias("n_labels"),
    )
    status = F.when(~F.col("exists"), "missing").when((F.col("n_problems") > 0) | (F.col("n_placeholders") > 0), "pending").otherwise("done")
    return row.withColumn("status", status)


def continued(documents: DataFrame, packages: DataFrame, parsed: DataFrame) -> DataFrame:
    """``episode_id, md``: the documents with mended source lines, and a draft for each package without one. Doing it again changes nothing.

    ``parsed``: episode_id, title, source, notes, transcript of the packages.
    """
    line = F.regexp_extract("md", r"(?m)^(> 来源：[^\n]*)$", 1)
    titled = documents.join(parsed.select("episode_id", "title"), "episode_id", "left")
    mended = titled.select("episode_id", F.when(line == "", F.col("md")).otherwise(F.replace("md", line, repair_source(line, text_of(F.col("title"))))).alias("md"))
    new = parsed.join(documents.select("episode_id").distinct(), "episode_id", "left_anti").join(packages.select("episode_id").distinct(), "episode_id", "left_semi")
    return mended.unionByName(new.select("episode_id", draft(F.col("title"), F.col("source"), F.col("notes"), text_of(F.col("transcript"))).alias("md")))


def latest_status(events: DataFrame, by: str = "episode_id") -> DataFrame:
    """``by, stage, progress, msg, ts``: the last status of each."""
    return events.groupBy(by).agg(F.max_by(F.struct("stage", "progress", "msg"), "ts").alias("x"), F.max("ts").alias("ts")).select(by, "x.*", "ts")


def backup_once(backups: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The backups, and a copy of each file that has none yet; what was kept first stays."""
    return backups.unionByName(files.join(backups.select(key).distinct(), key, "left_anti").select(backups.columns))
