"""The glossary of a finished document: which terms belong to a key point, and where the section stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.plans.render import stripped

PLACEHOLDER = r"(?m)^-\s+\*\*待校订[。.]?\*\*"


def term_variants(term: Column) -> Column:
    """What stands before and inside of brackets at the end, the term itself, its parts at slashes; two characters at least, once each."""
    bracket = r"(?s)^(.+?)[（(](.+?)[）)]\s*$"
    part = lambda i: F.when(term.rlike(bracket), F.trim(F.regexp_extract(term, bracket, i)))
    slashes = F.when(F.contains(term, F.lit("/")), F.transform(F.split(term, "/"), lambda p: F.trim(p))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(part(1), part(2), term), slashes), lambda v: F.length(v) >= 2))


def _lines(body: Column) -> Column:
    return F.split(F.coalesce(body, F.lit("")), "\n")


def top_items(points: Column, questions: Column) -> Column:
    """The bullets of key points and questions, those of key points first."""
    return F.filter(F.concat(_lines(points), _lines(questions)), lambda s: s.rlike(r"^-\s+"))


def term_states(points: Column, questions: Column, glossary: Column) -> Column:
    """array<struct<line, term, state, target>> of the glossary's items, from the bodies of three sections.

    'dup': a sub-item has the name of one of its variants; 'inline': a bullet mentions one, ``target`` is the first
    bullet of the first variant that any mentions; 'keep': neither, or no term. A document that nobody edited has none.
    """
    subs = F.filter(F.concat(_lines(points), _lines(questions)), lambda s: s.rlike(r"^\s+-\s+\*\*.+?\*\*"))
    names = F.transform(subs, lambda s: F.regexp_replace(F.trim(F.regexp_extract(s, r"^\s+-\s+\*\*(.+?)\*\*", 1)), r"[。.]\s*$", ""))
    bullets = top_items(points, questions)

    def state(line: Column) -> Column:
        term = F.trim(F.regexp_extract(line, r"\*\*(.+?)\*\*[:：]", 1))
        variants = term_variants(term)
        spots = F.filter(F.transform(variants, lambda v: F.array_position(F.transform(bullets, lambda b: F.contains(b, v)), True)), lambda i: i > 0)
        target = F.when(F.size(spots) > 0, F.get(spots, F.lit(0)) - 1).cast("int")
        kind = F.when(term == "", "keep").when(F.arrays_overlap(variants, names), "dup").when(target.isNotNull(), "inline").otherwise("keep")
        return F.struct(line.alias("line"), F.when(term != "", term).alias("term"), kind.alias("state"), F.when(kind == "inline", target).alias("target"))

    items = F.filter(_lines(glossary), lambda s: s.rlike(r"^\s*- "))
    unedited = F.coalesce(points.rlike(PLACEHOLDER), F.lit(False))
    return F.transform(F.when(unedited, F.array().cast("array<string>")).otherwise(items), state)


def glossary_terms(docs: DataFrame, key: str = "episode_id", md: str = "md") -> DataFrame:
    """``key, term_no, term, state, target, place``: the state of each glossary item; ``place`` says which bullet is meant."""
    from castwright.plans.checks import body_of, section_list

    s = docs.where(F.col(md).isNotNull()).select(key, section_list(F.col(md)).alias("s"))
    b = s.select(key, *[body_of(F.col("s"), h).alias(c) for h, c in (("核心观点", "k"), ("问题与思考", "q"), ("术语表", "g"))])
    n = F.size(F.filter(_lines(F.col("k")), lambda x: x.rlike(r"^-\s+")))
    out = b.select(key, n.alias("n"), F.posexplode(term_states(F.col("k"), F.col("q"), F.col("g"))).alias("term_no", "x"))
    place = F.when(F.col("x.target") < F.col("n"), F.concat(F.lit("核心观点第 "), F.col("x.target") + 1, F.lit(" 条"))).when(F.col("x.target").isNotNull(), F.concat(F.lit("问题与思考第 "), F.col("x.target") - F.col("n") + 1, F.lit(" 条")))
    return out.select(key, "term_no", "x.term", "x.state", "x.target", place.alias("place"))


def inline_glossary(docs: DataFrame, key: str = "episode_id", md: str = "md") -> DataFrame:
    """``key, md, n_dup, n_inline``: terms that a bullet mentions are put under it, behind its sub-items; doubled ones go.

    A glossary without items left goes as a whole. Applying it again changes nothing.
    """
    from castwright.plans.checks import body_of, section_list

    kind = "array<struct<line:string,term:string,state:string,target:int>>"
    s = docs.select(key, md, section_list(F.col(md)).alias("s"))
    b = s.select("*", body_of(F.col("s"), "核心观点").alias("k"), body_of(F.col("s"), "问题与思考").alias("q"), body_of(F.col("s"), "术语表").alias("g"))
    b = b.withColumn("states", F.coalesce(term_states(F.col("k"), F.col("q"), F.col("g")), F.array().cast(kind)))
    gone = F.transform(F.filter("states", lambda x: x["state"] != "keep"), lambda x: x["line"])
    n_points = F.size(F.filter(_lines(F.col("k")), lambda x: x.rlike(r"^-\s+")))
    # Bullets with what follows them: the item line begins a part, its sub-items and blank lines come before the new ones.
    sub = lambda x: F.concat(F.lit("  - **"), x["term"], F.lit("。** "), F.trim(F.regexp_replace(x["line"], r"^.*?\*\*.+?\*\*[:：]", "")))

    def grown(body: Column, offset: Column) -> Column:
        parts = F.split(body, r"(?m)^(?=-\s)")
        first = F.when(F.get(parts, F.lit(0)).rlike(r"\A-\s"), 0).otherwise(1)  # what stands before the first bullet
        return F.array_join(F.transform(parts, lambda p, i: F.aggregate(
            F.filter("states", lambda x: (x["state"] == "inline") & (x["target"] == i - first + offset)), p, lambda t, x: F.concat(F.regexp_replace(t, r"(?s)\A(-[^\n]*(?:\n[ \t]+-[^\n]*)*)(.*)\z", "$1"), F.lit("\n"), sub(x), F.regexp_replace(t, r"(?s)\A(-[^\n]*(?:\n[ \t]+-[^\n]*)*)(.*)\z", "$2")))), "")

    left = F.array_join(F.filter(F.split("g", "\n"), lambda x: ~F.array_contains(gone, x)), "\n")
    empty = ~left.rlike(r"(?m)^\s*- ")
    block = F.concat(F.lit("## "), F.lit(""))
    whole = F.array_join(F.transform(F.filter("s", lambda x: ~((x["heading"] == "术语表") & empty & (F.size(gone) > 0))), lambda x: F.when(x["heading"] == "", x["body"]).otherwise(
        F.concat(block, x["heading"], F.lit("\n"), F.when(x["heading"] == "核心观点", grown(x["body"], F.lit(0))).when(x["heading"] == "问题与思考", grown(x["body"], n_points)).when(x["heading"] == "术语表", left).otherwise(x["body"])))), "")
    n = lambda c: F.size(F.filter("states", lambda x: x["state"] == c))
    return b.select(key, F.when(F.size(gone) > 0, whole).otherwise(F.col(md)).alias("md"), n("dup").alias("n_dup"), n("inline").alias("n_inline"))


def place_glossary(md: Column) -> Column:
    """The glossary before the questions, if it stands behind them; blank lines in a row become one."""
    blocks = F.split(md, r"(?m)^(?=##\s)")
    is_ = lambda b, h: b.rlike(rf"\A##\s+{h}\s*(?:\n|\z)")
    at = lambda h: F.array_max(F.transform(blocks, lambda b, i: F.when(is_(b, h), i)))
    own = F.filter(blocks, lambda b: is_(b, "术语表"))
    moved = F.flatten(F.transform(F.filter(blocks, lambda b: ~is_(b, "术语表")), lambda b: F.when(is_(b, "问题与思考"), F.concat(own, F.array(b))).otherwise(F.array(b))))
    return F.when(at("术语表") > at("问题与思考"), F.regexp_replace(F.array_join(moved, ""), r"\n{3,}", "\n\n")).otherwise(md)


def drop_empty_glossary(md: Column) -> Column:
    """Without a glossary that has no term; a document that nobody edited stays."""
    blocks = F.split(md, r"(?m)^(?=##\s)")
    empty = lambda b: b.rlike(r"\A##\s+术语表\s*(?:\n|\z)") & ~b.rlike(r"(?m)^\s*- .*\*\*.+?\*\*[:：]")
    kept = F.filter(blocks, lambda b: ~empty(b))
    unedited = F.exists(blocks, lambda b: b.rlike(r"\A##\s+核心观点") & b.rlike(PLACEHOLDER))
    return F.when(unedited | (F.size(kept) == F.size(blocks)), md).otherwise(F.regexp_replace(F.array_join(kept, ""), r"\n{3,}", "\n\n"))
