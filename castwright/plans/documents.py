"""Documents: sections, bullets, the gate of a finished document, tidy payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.text import display_label
from castwright.plans.handoff import MAX_KEYWORDS, MAX_QUESTIONS

def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sections(docs: DataFrame, key: str = "episode_id", md: str = "md") -> DataFrame:
    """``key, sec_no, heading, body``: the blocks of a document; number 0 is what stands before the first heading.

    The split loses nothing: heading line and body make up the text again.
    """
    blocks = F.split(F.col(md), r"(?m)^(?=##\s)")
    out = docs.where(F.col(md).isNotNull()).select(key, F.posexplode(blocks).alias("at", "block"))
    has = F.col("block").rlike(r"^##\s")
    return out.select(key, F.col("at").alias("sec_no"), F.when(has, F.trim(F.expr("substring(substring_index(block, '\\n', 1), 3)"))).otherwise("").alias("heading"), F.when(has, F.expr("substring(block, length(substring_index(block, '\\n', 1)) + 2)")).otherwise(F.col("block")).alias("body")).where("heading <> '' or body <> ''")


def section_map(parts: DataFrame, key: str = "episode_id") -> DataFrame:
    """``key, heading, body``: of equal headings the last counts."""
    return parts.where("heading <> ''").groupBy(key, "heading").agg(F.max_by("body", "sec_no").alias("body"))


def bullets(parts: DataFrame, key: str = "episode_id") -> DataFrame:
    """``key, sec_no, heading, line_no, level, bold, rest`` of the bullet lines of sections."""
    lines = parts.select(key, "sec_no", "heading", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^\s*-\s+"))
    return lines.select(
        key, "sec_no", "heading", "line_no", F.when(F.col("line").rlike(r"^-\s"), 1).otherwise(2).alias("level"),
        F.regexp_extract("line", r"^\s*-\s+\*\*([^*]+)\*\*", 1).alias("bold"), F.trim(F.regexp_replace("line", r"^\s*-\s+(?:\*\*[^*]+\*\*)?", "")).alias("rest"),
    )


def gate(docs: DataFrame, questions: str = "questions") -> DataFrame:
    """``episode_id, blocking``: what keeps a document from being finished, in order; an empty array passes."""
    blank = lambda c: F.trim(_or_empty(F.col(c))) == ""
    points = F.coalesce("key_points", F.array())
    asked = F.coalesce(questions, F.array())
    problems = [
        (blank("title"), "title"), (blank("podcast_name"), "podcast"), (blank("pub_date"), "date"), (blank("full_text"), "full_text"), (blank("summary"), "summary"), (F.size(points) == 0, "key_points"),
        (F.exists(points, lambda p: F.trim(_or_empty(p["point"])) == ""), "blank_point"), (F.size(asked) == 0, "questions"), (F.exists(asked, lambda q: F.trim(_or_empty(q["question"])) == ""), "blank_question"),
        (_or_empty(F.col("full_text")).rlike(r"\[SPEAKER_\d+\]"), "labels"),
    ]
    return docs.select("episode_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in problems])).alias("blocking"))


def tidy_payload(struct_out: DataFrame) -> DataFrame:
    """Payloads with stripped, valid and capped lists: ``episode_id, run_no, keywords, questions, summary, speaker_mapping``."""
    text = lambda c: F.trim(_or_empty(c))
    keywords = F.filter(F.transform(F.coalesce("keywords", F.array()), lambda k: F.struct(text(k["keyword"]).alias("keyword"), text(k["descr"]).alias("descr"))), lambda k: k["keyword"] != "")
    questions = F.filter(F.transform(F.coalesce("questions", F.array()), lambda q: F.struct(text(q["question"]).alias("question"), text(q["answer"]).alias("answer"), text(q["anchor"]).alias("anchor"))), lambda q: q["question"] != "")
    return struct_out.select("episode_id", "run_no", F.slice(keywords, 1, MAX_KEYWORDS).alias("keywords"), F.slice(questions, 1, MAX_QUESTIONS).alias("questions"), text(F.col("summary")).alias("summary"), "speaker_mapping")


def substitute_labels(text: Column, mapping: Column) -> Column:
    """Each [SPEAKER_n] of the mapping becomes its display label, in the order of the labels."""
    pairs = F.array_sort(F.map_entries(F.coalesce(mapping, F.create_map().cast("map<string,string>"))))
    return F.aggregate(pairs, text, lambda t, e: F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), display_label(e["value"])))


def turn_checks(turns: DataFrame) -> DataFrame:
    """``episode_id, check, n_hits`` on speaker turns (``key``, ``n``): V23 one speaker has more than 85 % of four turns or more, V24 three turns in a row."""
    per = turns.groupBy("episode_id", "key").agg(F.count(F.lit(1)).alias("k")).groupBy("episode_id").agg(F.sum("k").alias("total"), F.max("k").alias("top"))
    share = per.where("total >= 4 and top > 0.85 * total").select("episode_id", F.lit("V23").alias("check"), F.col("top").alias("n_hits"))
    runs = turns.where("n >= 3").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_hits")).select("episode_id", F.lit("V24").alias("check"), "n_hits")
    return share.unionByName(runs)
