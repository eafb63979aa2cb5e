"""Structured payloads of models and handoffs: tolerant reading, assembling, and keeping them in step with a rewritten document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.numbers import convert_numbers
from castwright.functions.text import _clean_marks, arabic_numbers, clean_marks, merge_repeats
from castwright.plans.render import text_of

# Caps of a payload's lists; points are cut before blank ones go, the others after.
MAX_POINTS, MAX_KEYWORDS, MAX_QUESTIONS = 20, 10, 5
_VARIANTS = "array<variant>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", "")


def parse_payload(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, summary, points, keywords, questions, speaker_mapping, speaker_intro`` of model JSON, item by item.

    Malformed JSON gives empty fields; an item that is no object goes alone; what isn't a list is an empty one; an
    introduction that is no string is ''. Other columns of the payload are not read.
    """
    v = F.try_parse_json(F.col(raw))
    items = lambda x, path: F.coalesce(F.try_variant_get(x, path, _VARIANTS), F.array().cast(_VARIANTS))
    objects = lambda x, path: F.filter(items(x, path), lambda y: F.schema_of_variant(y).startswith("OBJECT"))
    field = lambda x, p: _trim(F.try_variant_get(x, p, "string"))
    term = lambda t: F.struct(field(t, "$.term").alias("term"), F.coalesce(F.nullif(field(t, "$.desc"), F.lit("")), field(t, "$.descr")).alias("descr"))
    point = lambda x: F.struct(*[field(x, f"$.{c}").alias(c) for c in ("point", "evidence", "quote", "anchor")], F.filter(F.transform(objects(x, "$.terms"), term), lambda t: t["term"] != "").alias("terms"))
    points = F.filter(F.transform(F.slice(objects(v, "$.key_points"), 1, MAX_POINTS), point), lambda p: p["point"] != "")
    word = lambda x: F.struct(F.coalesce(F.nullif(field(x, "$.keyword"), F.lit("")), field(x, "$.key")).alias("keyword"), F.coalesce(F.nullif(field(x, "$.desc"), F.lit("")), field(x, "$.descr")).alias("descr"))
    words = F.slice(F.filter(F.transform(objects(v, "$.keywords"), word), lambda k: k["keyword"] != ""), 1, MAX_KEYWORDS)
    ask = lambda x: F.struct(*[field(x, f"$.{c}").alias(c) for c in ("question", "answer", "anchor")])
    asked = F.slice(F.filter(F.transform(objects(v, "$.questions"), ask), lambda q: q["question"] != ""), 1, MAX_QUESTIONS)
    mapping = F.coalesce(F.try_variant_get(v, "$.speaker_mapping", "map<string,string>"), F.create_map().cast("map<string,string>"))
    intro = F.when(F.schema_of_variant(F.try_variant_get(v, "$.speaker_intro", "variant")) == "STRING", field(v, "$.speaker_intro")).otherwise("")
    return df.select(key, field(v, "$.summary").alias("summary"), points.alias("points"), words.alias("keywords"), asked.alias("questions"), mapping.alias("speaker_mapping"), F.coalesce(intro, F.lit("")).alias("speaker_intro"))


def handoff(docs: DataFrame) -> DataFrame:
    """``episode_id, handoff``: the JSON of a document that a later stage renders again."""
    fields = ["title", "podcast_name", "pub_date", "show_notes", "summary", "key_points", "keywords", "questions", "speaker_intro", "speaker_mapping", "full_text"]
    return docs.select("episode_id", F.to_json(F.struct(*fields)).alias("handoff"))


def speaker_map(text: Column) -> Column:
    """map of 'SPEAKER_00:name,…'; of equal labels the last counts; null if a label is bad or a name is missing."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(SPEAKER_\d+)\s*:", 1).alias("k"), F.trim(F.regexp_extract(p, r"^SPEAKER_\d+\s*:(.*)$", 1)).alias("v")))
    bad = F.exists(pairs, lambda p: (p["k"] == "") | (p["v"] == ""))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["k"] == p["k"])) == 0)
    return F.when(~bad, F.map_from_entries(last))


def candidates(text: Column) -> Column:
    """The parts of a comma list, stripped, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text_of(text), ","), lambda p: F.trim(p)), lambda p: p != ""))


def first_offered(wanted: Column, offered: Column) -> Column:
    """The first wanted item that is offered; null if none."""
    return F.get(F.filter(wanted, lambda x: F.array_contains(offered, x)), F.lit(0))


# --- Keeping a handoff in step with its document -----------------------------------------------------------------

_POINT_FIELDS, _QUESTION_FIELDS = ("point", "evidence", "quote"), ("question", "answer")


def _texts(points: Column, questions: Column) -> Column:
    """Every text field of key points and questions, in order."""
    of = lambda a, fields: F.flatten(F.transform(F.coalesce(a, F.array()), lambda x: F.array(*[text_of(x[f]) for f in fields])))
    return F.concat(of(points, _POINT_FIELDS), of(questions, _QUESTION_FIELDS))


def sync_texts(docs: DataFrame, rule, name: str) -> DataFrame:
    """``docs`` with ``rule`` (a function of one text) applied to every text field of ``key_points`` and ``questions``,
    and ``name``: how many fields changed. Anchors stay; all fields of a row go to Python in one array.
    """

    @F.pandas_udf("array<string>")
    def apply(fields: pd.Series) -> pd.Series:
        return fields.map(lambda texts: [rule(t) if t else t for t in texts])

    d = docs.withColumn("__old", _texts(F.col("key_points"), F.col("questions"))).withColumn("__new", apply("__old"))
    at = lambda i: F.element_at("__new", (i + 1).cast("int"))
    n_points = F.size(F.coalesce("key_points", F.array())) * len(_POINT_FIELDS)
    put = lambda x, fields, base: x.withField(fields[0], at(base)) if len(fields) == 1 else put(x.withField(fields[0], at(base)), fields[1:], base + 1)
    points = F.transform("key_points", lambda p, i: put(p, _POINT_FIELDS, i * len(_POINT_FIELDS)))
    questions = F.transform("questions", lambda q, i: put(q, _QUESTION_FIELDS, n_points + i * len(_QUESTION_FIELDS)))
    changed = F.size(F.filter(F.zip_with("__old", "__new", lambda a, b: a != b), lambda x: x))
    return d.withColumn(name, changed).withColumn("__p", points).withColumn("questions", questions).drop("key_points").withColumnRenamed("__p", "key_points").drop("__old", "__new")


def sync_marks(docs: DataFrame) -> DataFrame:
    return sync_texts(docs, _clean_marks, "n_marks")


def sync_numbers(docs: DataFrame) -> DataFrame:
    return sync_texts(docs, convert_numbers, "n_numbers")


def sync_quotes(points: Column, fixable: Column) -> Column:
    """Key points whose quote is one of ``fixable`` with an end mark; each of these counts once, at its first quote."""
    quotes = F.transform(points, lambda p: p["quote"])
    mark = lambda q: F.when(q.rlike("[吗呢？?]$"), "？").otherwise("。")
    hit = lambda p, i: F.array_contains(fixable, p["quote"]) & (F.array_position(quotes, p["quote"]) == i + 1)
    return F.transform(points, lambda p, i: p.withField("quote", F.when(hit(p, i), F.concat(p["quote"], mark(p["quote"]))).otherwise(p["quote"])))


def stale_anchors(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """``episode_id, part, item_no, anchor, repaired``: anchors of key points and questions that the text doesn't hold, with the first cleaned form that it holds.

    Forms: marks cleaned; then numbers in digits; then repeats merged.
    """
    of = lambda c: docs.where(f"{text} is not null").select("episode_id", F.col(text).alias("t"), F.lit(c).alias("part"), F.posexplode(F.transform(F.coalesce(c, F.array()), lambda x: x["anchor"])).alias("at", "anchor"))
    a = of("key_points").unionByName(of("questions")).where("anchor <> ''").where(~F.contains("t", "anchor"))
    formed = a.withColumn("f1", clean_marks(F.col("anchor"))).withColumn("f2", arabic_numbers(F.col("f1"))).withColumn("f3", merge_repeats(F.col("f2")))
    repaired = F.coalesce(*[F.when((F.col(f) != "") & F.contains("t", f), F.col(f)) for f in ("f1", "f2", "f3")])
    return formed.select("episode_id", "part", (F.col("at") + 1).alias("item_no"), "anchor", repaired.alias("repaired"))

