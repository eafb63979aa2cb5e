"""Finished documents as Markdown: every section in its fixed order, on one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.anchors import bold, document_anchors
from castwright.functions.numbers import minutes_seconds
from castwright.functions.text import as_bold, as_sentence

# Headings of a finished document in their order, the words of the stages in the footer, an empty section,
# rule lines, and the marks after which two parts of a block are joined as they are.
HEADINGS = ("Show Notes", "摘要", "核心观点", "术语表", "问题与思考", "人物简介", "原文转录")
STAGES = (("scrape", "抓取"), ("download", "下载"), ("transcribe", "转写"), ("diarization", "说话人"), ("process", "校订"))
NONE = "（无）"
RULE_LINE = r"^(?:-{3,}|\*{3,}|_{3,})$"
JOINED_AFTER = r"[。！？…；，、.!?;, ]$"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def explained(term: Column, descr: Column) -> Column:
    """'**term**：explanation。'; the colon only with an explanation, the period unless it has one."""
    d = stripped(text_of(descr))
    end = F.when(d.rlike(r"[。.]$"), "").otherwise("。")
    return F.concat(F.lit("**"), text_of(term), F.lit("**"), F.when(d == "", "").otherwise(F.concat(F.lit("："), d, end)))


def key_point_lines(points: Column) -> Column:
    """Lines of key points: bold sentence, evidence and quote without blanks between, terms as sub-items."""

    def line(p: Column) -> Column:
        quote, evidence = text_of(p["quote"]), text_of(p["evidence"])
        head = F.concat(F.lit("- **"), as_sentence(text_of(p["point"])), F.lit("**"), F.when(evidence == "", "").otherwise(as_sentence(evidence)), F.when(quote == "", "").otherwise(F.concat(F.lit("「"), quote, F.lit("」"))))
        return F.concat(F.array(head), F.transform(F.coalesce(p["terms"], F.array()), lambda t: F.concat(F.lit("  - "), explained(t["term"], t["descr"]))))

    return F.flatten(F.transform(F.coalesce(points, F.array()), line))


def keyword_lines(keywords: Column) -> Column:
    return F.transform(F.coalesce(keywords, F.array()), lambda k: F.concat(F.lit("- "), explained(k["keyword"], k["descr"])))


def question_lines(questions: Column) -> Column:
    """Numbered bold questions, the answer indented below; a blank question keeps its number."""
    asked = F.coalesce(questions, F.array())

    def lines(q: Column, i: Column) -> Column:
        question, answer = as_bold(text_of(q["question"])), text_of(q["answer"])
        head = F.concat((i + 1).cast("string"), F.lit("."), F.when(question == "", "").otherwise(F.concat(F.lit(" "), question)))
        return F.concat(head, F.when(answer == "", "").otherwise(F.concat(F.lit("\n   "), answer)))

    return F.transform(asked, lines)


def footer(costs: Column, timings: Column | None = None) -> Column:
    """Times of the stages in their order and the model's cost; '' without either."""
    llm = F.element_at(costs, F.lit("llm"))
    cost = F.when(llm.isNotNull(), F.concat(F.lit("LLM 费用约 "), F.format_string("%.4f", llm), F.lit(" 元")))
    if timings is None:
        return F.coalesce(cost, F.lit(""))
    spent = F.array_compact(F.array(*[F.when(F.element_at(timings, F.lit(k)).isNotNull(), F.concat(F.lit(f"{label} "), minutes_seconds(F.element_at(timings, F.lit(k))))) for k, label in STAGES]))
    times = F.when(F.size(spent) > 0, F.concat(F.lit("耗时 "), F.array_join(spent, " / ")))
    return F.concat_ws("；", times, cost)


def merge_blocks(text: Column) -> Column:
    """Neighbouring blocks of one 【label】 as one block.

    Lines are the parts: a labelled line begins an item, a rule line is an item of its own, any other line belongs to
    the item before it. Neighbouring items of one label are one. Between two parts stands a period unless a mark does;
    a comma at the end of an item becomes a period. Blank text stays as it is.
    """
    lines = F.filter(F.transform(F.split(text, r"\n"), stripped), lambda s: s != "")
    label = lambda s: F.regexp_extract(s, r"^【([^】]+)】", 1)
    item = lambda name, body: F.struct(name.alias("name"), body.alias("body"))
    start = F.array().cast("array<struct<name:string,body:string>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        name, rule = label(s), s.rlike(RULE_LINE)
        body = F.when(name != "", F.regexp_replace(s, r"(?U)^【[^】]+】\s*", "")).otherwise(s)
        joins = (F.size(done) > 0) & ~rule & ((name == "") | (name == last["name"]))
        glue = F.when((last["body"] == "") | (body == "") | last["body"].rlike(JOINED_AFTER), "").otherwise("。")
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(item(last["name"], F.concat(last["body"], glue, body))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(item(name, body))))

    def shown(x: Column) -> Column:
        body = F.regexp_replace(x["body"], "[，,]$", "。")
        return F.when(x["name"] == "", body).otherwise(F.concat(F.lit("【"), x["name"], F.lit("】"), body))

    merged = F.array_join(F.transform(F.aggregate(lines, start, step), shown), "\n\n")
    return F.when(stripped(text) == "", text).otherwise(merged)


def render_markdown(docs: DataFrame, marked: bool = True, timings: str | None = None) -> DataFrame:
    """``episode_id, md`` of documents with the columns of a finished one and ``show_notes, questions``.

    ``marked``: the anchors of quotes, terms, keywords and questions are bold in the transcript. A missing glossary has
    no section; nulls are empty.
    """
    section = lambda name, *lines: F.concat(F.lit(f"\n\n## {name}\n\n"), *lines)
    col = lambda c: text_of(F.col(c))
    transcript = merge_blocks(col("full_text"))
    if marked:
        transcript = bold(transcript, document_anchors(F.col("key_points"), F.col("keywords"), F.col("questions")))
    foot = footer(F.col("costs"), None if timings is None else F.col(timings))
    md = F.concat(
        F.lit("# "), col("title"), F.lit("\n\n> 来源："), col("podcast_name"), F.lit(" | "), col("title"), F.lit(" | "), col("pub_date"),
        F.array_join(F.transform(F.coalesce("warnings", F.array()), lambda w: F.concat(F.lit("\n\n> [WARN] "), w)), ""),
        section("Show Notes", F.when(stripped(col("show_notes")) == "", NONE).otherwise(col("show_notes"))),
        section("摘要", col("summary")),
        section("核心观点", F.array_join(key_point_lines(F.col("key_points")), "\n")),
        F.when(F.size(F.coalesce("keywords", F.array())) > 0, section("术语表", F.array_join(keyword_lines(F.col("keywords")), "\n"))).otherwise(""),
        section("问题与思考", F.array_join(question_lines(F.col("questions")), "\n\n")),
        section("人物简介", F.when(col("speaker_intro") == "", NONE).otherwise(col("speaker_intro"))),
        section("原文转录", transcript),
        F.when(foot == "", "").otherwise(F.concat(F.lit("\n\n---\n\n"), foot)),
    )
    return docs.select("episode_id", md.alias("md"))


def replace_transcript(md: Column, transcript: Column) -> Column:
    """The document up to its transcript, new or old heading, and a new transcript; null if it has none."""
    head = F.regexp_extract(md, r"(?s)\A(.*?)(?:^|\n)##\s*(?:原文|全文)转录[ \t]*(?:\n|\z)", 1)
    has = md.rlike(r"(?m)^##\s*(?:原文|全文)转录\s*$")
    return F.when(has, F.concat(F.regexp_replace(head, r"(?U)\s+\z", ""), F.lit("\n\n## 原文转录\n\n"), transcript, F.lit("\n")))
