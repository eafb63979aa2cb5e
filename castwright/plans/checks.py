"""Checks of finished documents: every check is an expression on the row of its document, so that nothing is shuffled."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.text import mark_defects, spoken_defects, strip_labels
from castwright.operators.speakers import ALIASES
from castwright.plans.glossary import term_states
from castwright.plans.render import stripped

# Required headings, morphemes and words that are no names, personality types, role words before a label.
REQUIRED = ("Show Notes", "摘要", "核心观点", "问题与思考", "人物简介", "原文转录")
NO_NAME_PARTS = "人生产友者的是个一这那做在就否很太不啊呢吧吗嘛跟和与会与告诉你们他们她们我们之乎也者给被把让叫为及或都更最觉想说看听批拌紧绷了过着要还又没挺别"
PROFESSIONS = (
    "设计师 工程师 程序员 架构师 产品经理 项目经理 研究员 科学家 教授 博士 导师 老师 学生 医生 护士 律师 法官 记者 编辑 作者 作家 诗人 艺术家 画家 音乐家 歌手 演员 导演 主持人 主播 投资人 "
    "创始人 联创 合伙人 老板 经理 总裁 总监 行长 局长 校长 院长 公务员 军人 警察 消防员 厨师 司机 工人 农民 商人 企业家 分析师 顾问 教练 裁判 运动员 模特 网红 博主 运营 销售 会计 翻译 码农 白领"
).split()
TYPES = "intj intp entj entp infj infp enfj enfp istj isfj estj esfj istp isfp estp esfp".split()
LABEL_ROLES = "主播|嘉宾|主持人|老师|同学|教授|博士|先生|女士"
SELF = re.compile(r"我(?:是|叫|们是|就是)\s*([一-龥A-Za-z]{1,8})(?=[，。！？；、\s])")


def section_list(md: Column) -> Column:
    """array<struct<heading, body>> of a document; what stands before the first heading has the heading ''."""
    blocks = F.split(md, r"(?m)^(?=##\s)")
    first = lambda b: F.substring_index(b, "\n", 1)
    has = lambda b: b.rlike(r"\A##\s")
    return F.transform(blocks, lambda b: F.struct(F.when(has(b), stripped(F.substr(first(b), F.lit(3)))).otherwise("").alias("heading"), F.when(has(b), F.substr(b, F.length(first(b)) + 2)).otherwise(b).alias("body")))


def body_of(sections: Column, *headings: str) -> Column:
    """The body under the first of the headings that the document has; of equal headings the last counts; null if none."""
    one = lambda h: F.try_element_at(F.transform(F.filter(sections, lambda s: s["heading"] == h), lambda s: s["body"]), F.lit(-1))
    return F.coalesce(*[one(h) for h in headings])


def _lines(body: Column) -> Column:
    return F.split(F.coalesce(body, F.lit("")), "\n")


def _hits(lines: Column, pattern: str, but: str | None = None) -> Column:
    """How many lines match, and don't match ``but``."""
    return F.size(F.filter(lines, lambda s: s.rlike(pattern) & (~s.rlike(but) if but else F.lit(True))))


def plausible_name(name: str) -> bool:
    """Two or three Han without a part that no name has, or two to four Latin letters that are no type; no profession."""
    if name in PROFESSIONS or not re.fullmatch(r"[一-龥]{2,3}|[A-Za-z]{2,4}", name):
        return False
    return name.lower() not in TYPES and not set(name) & set(NO_NAME_PARTS)


def foreign_names(transcript: str | None) -> int:
    """Turns in which the speaker calls themselves by a name that isn't the turn's label, aliases allowed."""
    n = 0
    for turn in re.split(r"(?m)^(?=【[^】]+】)", transcript or ""):
        head = re.match(r"【([^】]+)】", turn)
        if not head:
            continue
        label = head[1]
        core = re.sub(f"^(?:{LABEL_ROLES})", "", label).strip()
        for name in SELF.findall(turn[head.end() :]):
            known = ALIASES.get(name, name)
            agrees = known in label or core and core in known
            if not agrees and plausible_name(name) and name != core:
                n += 1
                break
    return n


def open_quotes_of(points: str | None) -> int:
    """Quotes of key points without an end mark before a line's end or an end mark outside of the bracket."""
    return len(re.findall(r"「(?:[^」]*[^」。？！.?!])?」(?=[\r\n。？！]|\Z)", points or "")) if points else 0


def chopped_lines(transcript: str | None) -> int:
    """Turns with three sentences of at most twelve characters in a row that end in a period."""
    n = 0
    for body in re.findall(r"(?m)^【[^】]*】\s*(.*)$", transcript or ""):
        parts = re.split("([。？！])", body)
        marks = "".join("s" if mark == "。" and 0 < len(re.sub(r"\s", "", s)) <= 12 else "-" for s, mark in zip(parts[::2], parts[1::2]))
        n += "sss" in marks
    return n


def _read(transcript: str, points: str) -> Column:
    """struct<names, quotes, chopped, spoken, marks>: counts that need the text as a whole."""

    @F.pandas_udf("names int, quotes int, chopped int, spoken int, marks int")
    def run(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = [(foreign_names(x), open_quotes_of(y), chopped_lines(x), sum(spoken_defects((x or "").replace("**", ""))), mark_defects(x or "")) for x, y in zip(t, p)]
        return pd.DataFrame(rows, columns=["names", "quotes", "chopped", "spoken", "marks"])

    return run(F.col(transcript), F.col(points))


def check_documents(docs: DataFrame, key: str = "episode_id", md: str = "md", source: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """``key, check, n_hits`` for each document and each check that it fails.

    ``source``: a column with the package that the document was made from, for V29. A null document fails nothing.
    """
    with_sections = docs.where(F.col(md).isNotNull()).withColumn("__s", section_list(F.col(md)))
    body = lambda *h: body_of(F.col("__s"), *h)
    d = with_sections.withColumns({
        "__t": body("原文转录", "全文转录"), "__k": body("核心观点"), "__q": body("问题与思考"), "__g": body("术语表"), "__i": body("人物简介"),
        "__pre": F.when(F.get("__s", F.lit(0))["heading"] == "", F.get("__s", F.lit(0))["body"]).otherwise(""),
    })
    text = F.col(md)
    t, k, q, g, i = (F.coalesce(F.col(c), F.lit("")) for c in ("__t", "__k", "__q", "__g", "__i"))
    headings = F.transform("__s", lambda s: s["heading"])
    own = {h: (body(h, "全文转录") if h == "原文转录" else body(h)) for h in REQUIRED}
    blank = lambda c: stripped(c) == ""
    flag = lambda c: F.when(c, 1).otherwise(0)
    total = lambda cs: sum(cs, F.lit(0))
    source_line = F.try_element_at(F.filter(_lines(F.col("__pre")), lambda s: s.rlike(r"^\s*> 来源：")), F.lit(1))
    answers = F.filter(F.transform(F.split(q, r"(?m)^\s*\d+\."), lambda b: F.filter(F.transform(F.split(b, "\n"), lambda s: F.regexp_replace(s, r"(?U)\s+$", "")), lambda s: s != "")), lambda b: F.size(b) > 0)
    asks = lambda s: s.rlike("[？?]$")
    turned = F.size(F.filter(answers, lambda b: (F.size(F.filter(b, asks)) >= 2) & asks(F.element_at(b, -1))))
    order = F.filter(F.array_distinct(headings), lambda h: h.isin("核心观点", "术语表", "问题与思考"))
    items = F.filter(_lines(F.col("__g")), lambda s: s.rlike(r"^\s*- "))
    intro = F.filter(_lines(F.col("__i")), lambda s: ~blank(s))
    labels = F.regexp_extract_all(t, F.lit(r"(?m)^\s*【([^】]+)】"), F.lit(1))
    at_start = F.regexp_extract_all(t, F.lit(r"(?m)^【([^】]+)】"), F.lit(1))
    counts = F.transform(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x)))
    run = F.aggregate(
        at_start, F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["most"], F.when(x == a["last"], a["n"] + 1).otherwise(1)).alias("most")), lambda a: a["most"],
    )
    fences = F.regexp_count(text, F.lit("```"))
    upper = F.regexp_replace(text, r"(?s)(?:\A|\n)##\s*(?:原文|全文)转录\s*(?:\n.*|\z)", "")
    editorial = F.when(upper.rlike(r"(?m)^##\s*摘要\s*$"), F.regexp_replace(upper, r"(?s)\A.*?(?:\A|\n)##\s*摘要[^\S\n]*(?:\n|\z)", "")).otherwise(upper)
    rules: dict[str, Column] = {
        "V1": total([flag(c.isNull()) for c in own.values()]),
        "V2": total([flag(F.coalesce(blank(c), F.lit(False))) for c in own.values()]),
        "V3": flag(F.coalesce(F.length(source_line) - F.length(F.replace(source_line, F.lit("|"), F.lit(""))), F.lit(0)) < 2),
        "V4": flag(~F.contains(text, F.lit("## Show Notes"))),
        "V5": _hits(_lines(F.col("__k")), r"^\s*- ", r"\*\*.+\*\*"),
        "V6": _hits(_lines(F.col("__k")), r"^-\s+\*\*.+?\*\*\s*[:：]"),
        "V7": _hits(_lines(F.col("__k")), r"^\s*>\s*\S"),
        "V8": _hits(_lines(F.col("__k")), r"^\s*[「『].*[」』]\s*$"),
        "V9": F.regexp_count(q, F.lit("[①②③④⑤⑥⑦⑧⑨⑩]")),
        "V10": flag(~blank(q) & ~q.rlike(r"(?m)^\s*\d+\.")),
        "V11": _hits(_lines(F.col("__q")), r"^\s*-\s+\*\*.+?\?\*\*\s+\S"),
        "V12": _hits(_lines(F.col("__q")), r"^\s*\d+\.(?:\s*$|\s+[^*\s]|\s+\*(?:[^*]|$)|\s\s+\*\*)"),
        "V13": turned,
        "V14": flag(F.array_contains(headings, "术语表") & (F.array_join(order, "|") != "核心观点|术语表|问题与思考")),
        "V15": _hits(items, "", r"\*\*.+?\*\*[:：]"),
        "V16": _hits(items, "", r"[。.]\s*$"),
        "V18": F.when((i == "") | (stripped(i) == "（无）"), 0).when(F.size(intro) == 0, 1).when(_hits(intro, r"^\s*>") > 0, _hits(intro, r"^\s*>")).otherwise(_hits(intro, "", r"^\s*\*\*.+?\*\*[:：]")),
        "V19": _hits(_lines(F.col("__t")), r"^\s*\*\*.+?\*\*[:：]"),
        "V20": flag((t != "") & ~F.contains(t, F.lit("**"))),
        "V21": F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\[SPEAKER_\d+\])"), F.lit(1)))),
        "V23": F.when((F.size(labels) >= 4) & (F.array_max(counts) / F.size(labels) > 0.85), F.array_max(counts)).otherwise(0),
        "V24": F.when(run >= 3, run).otherwise(0),
        "V26": _hits(_lines(F.col("__t")), r"^\s*【[^】]*】.*[，,]\s*$"),
        "V30": F.regexp_count(text, F.lit(r"(?m)^##\s+大纲")),
        "V31": flag(F.contains(text, F.lit("```mermaid")) | text.rlike(r"(?m)^\s*mindmap\s*$")),
        "V32": fences,
        "V33": F.regexp_count(editorial, F.lit('[”」』》"]、[「『《“"]')),
    }
    if only is None:
        d = d.withColumn("__read", _read("__t", "__k"))
        states = term_states(F.col("__k"), F.col("__q"), F.col("__g"))
        rules |= {
            "V17": F.size(F.filter(states, lambda s: s["state"] != "keep")), "V22": F.col("__read.names"), "V25": F.col("__read.spoken"), "V27": F.col("__read.marks"), "V28": F.col("__read.quotes"), "V34": F.col("__read.chopped"),
        }
        if source is not None:
            rules["V29"] = flag((F.coalesce(F.col(source), F.lit("")) != "") & (t != "") & (retention(t, F.col(source)) < 0.5))
    chosen = rules if only is None else {c: rules[c] for c in only}
    failed = F.filter(F.array(*[F.struct(F.lit(c).alias("check"), n.cast("bigint").alias("n_hits")) for c, n in chosen.items()]), lambda x: x["n_hits"] > 0)
    # The outer form, since a filter inferred from the inner one would evaluate all checks a second time.
    return d.select(key, F.explode_outer(failed).alias("x")).where("x is not null").select(key, "x.*")


def package_body(package: Column) -> Column:
    """The speech of a package: from the first numbered label on, or all of it."""
    return F.when(package.rlike(r"\[SPEAKER_\d+\]"), F.regexp_extract(package, r"(?s)(\[SPEAKER_\d+\].*)\z", 1)).otherwise(package)


def retention(transcript: Column, package: Column) -> Column:
    """Share of a package's speech that a transcript keeps, both without labels and blanks."""
    return F.length(strip_labels(transcript)) / F.greatest(F.length(strip_labels(package_body(package))), F.lit(1))


def without_unwanted(md: Column) -> Column:
    """Without outline sections and mermaid blocks."""
    kept = F.array_join(F.filter(F.split(md, r"(?m)^(?=##\s)"), lambda b: ~b.rlike(r"\A##\s+大纲")), "")
    return F.regexp_replace(kept, r"(?s)```mermaid.*?(?:```[^\S\n]*\n?|\z)", "")
