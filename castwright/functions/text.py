"""Text rules as column expressions: built-in functions where they can express a rule, Arrow functions elsewhere.

Every rule keeps null as null and '' as ''.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from castwright.functions.numbers import convert_dates, convert_numbers, date_changes, number_changes, rewritten

HAN = "一-鿿"
# Fixed values of the rules.
FULL_MARKS = "，。！？、；："
PAUSES = "，、；："
ENDS = "。！？"
HALF_TO_FULL = {",": "，", ".": "。", "?": "？", "!": "！", ";": "；", ":": "："}
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "et al.", "Mr.", "Mrs.", "Ms.", "Dr.", "St.", "No.", "U.S.", "U.K.", "Ph.D.", "a.m.", "p.m.", "Inc.", "Ltd.", "Co.", "Jr.", "Sr.")
REPEATS_KEPT = "哈呵嘻嘿噗哼嘎咚隆哗吱嗡轰呼啦咕嘟喵汪叮铛嘀嗒噼啪淅沥潺汩呜哇唧啾嗷嚎咩哞嘭砰唰飕簌啵对是好行中嗯哦啊哎唉噢唔哟咧"
CONNECTORS = ("而", "但", "却", "以及", "还是", "或", "所以", "就是")
ROLE_PREFIX = r"^(?:主持人|主理人|主播|主持|主理|嘉宾|客座)[：:\s]*"


def _arrow(f):
    """An Arrow function over one text column."""

    def column(text: Column) -> Column:
        @F.pandas_udf("string")
        def apply(s: pd.Series) -> pd.Series:
            return s.map(lambda t: f(t) if t else t)

        return apply(text)

    return column


def quotes_to_corners(text: Column) -> Column:
    """Curly and straight double quotes to corner brackets, paired in order; one left over stays."""
    return F.regexp_replace(F.translate(text, "“”", '""'), '"([^"]*)"', "「$1」")


#: Spaces around full-width marks: after a mark before Han, after Han and mark before Latin, and before a mark after Han.
LOOSE = rf"([{FULL_MARKS}]) +(?=[{HAN}])|(?<=[{HAN}])([{FULL_MARKS}]) +(?=[A-Za-z0-9])|(?<=[{HAN}]) +(?=[{FULL_MARKS}])"


def tighten_marks(text: Column) -> Column:
    return F.regexp_replace(text, LOOSE, "$1$2")


def unstacked(run: str) -> str:
    """What stays of marks in a row: next to an end no pause does; of equal ends, and of commas in a row, the first does."""
    kept = [c for c in run if c in ENDS] or list(run)
    same = lambda c: "，" if c in "，、" else c if c in ENDS else object()
    return "".join(next(own) for _, own in itertools.groupby(kept, same))


def _unstack(text: str) -> str:
    return re.sub(rf"[{PAUSES}{ENDS}]{{2,}}", lambda m: unstacked(m[0]), text)


def merge_repeats(text: Column) -> Column:
    """A Han character three or more times in a row becomes one, but for sounds and interjections."""
    return F.regexp_replace(text, rf"([{HAN}&&[^{REPEATS_KEPT}]])\1{{2,}}", "$1")


def end_turns(text: Column) -> Column:
    """A labelled line that ends in a comma ends in a period."""
    return F.regexp_replace(text, r"(?m)(?U)^(【[^】\n]*】.*)[，,]([^\S\n]*)$", "$1。$2")


def strip_tags(text: Column) -> Column:
    """Without recogniser tags <...> and 〈...〉; white space collapsed; null becomes ''."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>|〈[^〉]*〉", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_labels(text: Column) -> Column:
    """Without 【...】 and [SPEAKER_n] labels and without white space."""
    return F.regexp_replace(text, r"(?U)【[^】]*】|\[SPEAKER_\d+\]|\s+", "")


def clean_spoken(text: Column) -> Column:
    """Fillers that stand alone and doubled marks removed, runs of blanks made one."""
    text = F.regexp_replace(text, "(^|[，。！？、 ])[呃嗯啊哎唉哦]+(?=[，。！？、 ]|$)", "$1")
    text = F.regexp_replace(text, "[，、]{2,}", "，")
    text = F.regexp_replace(text, "^[，、。]+", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other; a later one sees what the earlier ones made."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return F.aggregate(table, text, lambda t, p: F.replace(t, p["a"], p["b"]))


AFTER_MARK = r"(?U)([。！？；，、）」』])\s+"


def as_sentence(text: Column) -> Column:
    """Stripped, no blank after a full-width mark, no colon at the end, with an end mark; '' stays ''."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), AFTER_MARK, "$1")
    text = F.regexp_replace(text, "[：:]$", "")
    return F.when(text == "", text).when(text.rlike(r"[。.！!？?；;…]$"), text).otherwise(F.concat(text, F.lit("。")))


def as_bold(text: Column) -> Column:
    """Wrapped in ** once."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), AFTER_MARK, "$1")
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)^\*\*(.+)\*\*$", "$1"), r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", bare).otherwise(F.concat(F.lit("**"), bare, F.lit("**")))


def display_label(name: Column) -> Column:
    """【name】 without role word, brackets and what follows a middle dot; '' for none."""
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), ROLE_PREFIX, "")
    bare = F.trim(F.substring_index(F.regexp_replace(bare, "[（(][^（）()]*[）)]", ""), "·", 1))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("【"), bare, F.lit("】")))


def safe_filename(text: Column, limit: int = 80) -> Column:
    """Characters that a file name can't hold become '_'; trimmed, no period at the end, cut off."""
    return F.left(F.regexp_replace(F.trim(F.translate(text, '\\/:*?"<>|', "_" * 9)), r"\.+$", ""), F.lit(limit))


def episode_stem(podcast: Column, title: Column) -> Column:
    """podcast[:40]-title[:100], 160 in all; 'podcast' if nothing is left."""
    parts = F.concat_ws("-", F.nullif(F.left(safe_filename(podcast), F.lit(40)), F.lit("")), F.nullif(F.left(safe_filename(title, 100), F.lit(100)), F.lit("")))
    return F.when(parts == "", "podcast").otherwise(F.left(parts, F.lit(160)))


def split_sentences(text: Column) -> Column:
    """Pieces that end in a Chinese end mark or semicolon."""
    return F.filter(F.split(text, "(?<=[。！？；])"), lambda s: s != "")


def _han_lines(text: str) -> Callable[[int], tuple[str, bool]]:
    """For a place the line that it is in, and whether that holds Han."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lines = text.split("\n")
    return lambda at: (line := lines[bisect.bisect_right(starts, at) - 1], bool(re.search(f"[{HAN}]", line)))


_GOES_ON = re.compile(r"[A-Za-z0-9]|\s+[A-Za-z]")
_BEHIND = re.compile(rf"[ \t]*([{HAN}]|\n|\Z)?")


def latin_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """Half-width marks behind a Latin word in a line with Han, unless Latin goes on behind them or they end an abbreviation."""
    line_at = None
    for m in re.finditer(r"[A-Za-z]\*{0,2}([,.?!])", text):
        if _GOES_ON.match(text, m.end()) or text[max(0, m.end() - 8) : m.end()].endswith(ABBREVIATIONS):
            continue
        line_at = line_at or _han_lines(text)
        if line_at(m.start(1))[1]:
            yield m.start(1), m.end(1), HALF_TO_FULL[m[1]]


def han_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """Half-width marks behind Han (blanks between stay) before Han, or at the end of a line with more Han than Latin; three periods and more are an ellipsis."""
    line_at = None
    for m in re.finditer(rf"(?<=[{HAN}])(?:\.{{3,}}(?![A-Za-z0-9])| *([,.?!;:]))", text):
        if not m[1]:
            yield m.start(), m.end(), "……"
            continue
        behind = _BEHIND.match(text, m.end())[1]
        if behind in ("", "\n"):
            line_at = line_at or _han_lines(text)
            line = line_at(m.start(1))[0]
            behind = len(re.findall(f"[{HAN}]", line)) >= len(re.findall("[A-Za-z]", line))
        if behind:
            yield m.start(1), m.end(1), HALF_TO_FULL[m[1]]


_LEADING = re.compile(rf"(?m)^([ \t>]*)[{PAUSES}]+")
_ORPHAN = re.compile(rf"(?m)^(?!\s*(?:[-*>#|]|\d+[.)、]))(.*[^\s{ENDS}…”）」】])[ \t]*\n[ \t]*(?=[{ENDS}])")


def _rejoin(text: str) -> str:
    """Pauses at the start of a line go; an end there goes to the line before, if that is open running text."""
    text = _LEADING.sub(r"\1", text)
    while (joined := _ORPHAN.sub(r"\1", text)) != text:
        text = joined
    return text


def quote_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """End marks for quotes at the end of a line; fragments and what was given one before stay."""
    seen: set[str] = set()
    for m in open_quotes(text):
        if m[1] not in seen and not m[1].startswith(CONNECTORS):
            seen.add(m[1])
            yield m.end(1), m.end(1), end_mark(m[1])


def open_quotes(text: str) -> Iterator[re.Match]:
    """Quotes at the end of a line without an end mark."""
    return (m for m in re.finditer(r"「([^」]+)」(?=[\r\n]|\Z)", text) if m[1][-1] not in "。？！.?!")


def end_mark(quote: str) -> str:
    return "？" if quote.endswith(("吗", "呢", "？", "?")) else "。"


_REPEAT = re.compile(rf"([{HAN}])\1{{2,}}")
_TURN_COMMA = re.compile(r"(?m)^(【[^】\n]*】.*)[，,]([^\S\n]*)$")


def _clean_marks(text: str) -> str:
    """Orphan marks, half-width marks, stacks and spaces, in this order."""
    text = _rejoin(text)
    return re.sub(LOOSE, lambda m: m[1] or m[2] or "", _unstack(rewritten(text, han_changes(text))))


def clean_body(text: str, heading: str) -> str:
    """The whole rewrite of a section's body, in one pass over the row; the last step depends on the heading."""
    text = rewritten(text, latin_changes(text))
    text = _clean_marks(convert_dates(convert_numbers(text)))
    text = _REPEAT.sub(lambda m: m[0] if m[1] in REPEATS_KEPT else m[1], text)
    if heading == "## 核心观点":
        return rewritten(text, quote_changes(text))
    return _TURN_COMMA.sub(r"\1。\2", text) if heading in ("## 原文转录", "## 全文转录") else text


def pieces(md: str) -> list[tuple[str, str, str]]:
    """(heading line, heading, body) of each section; what stands before the first has no heading. Together they are the text."""
    marks = list(re.finditer(r"(?m)^(##\s+\S.*?)\s*$", md))
    ends = [m.start() for m in marks[1:]] + [len(md)]
    return [("", "", md[: marks[0].start()] if marks else md), *((m[0], m[1], md[m.end() : e]) for m, e in zip(marks, ends if marks else []))]


def clean_document(md: str) -> str:
    """A finished document with every section but the Show Notes rewritten."""
    return "".join(line + (body if heading.startswith("## Show Notes") else clean_body(body, heading)) for line, heading, body in pieces(md))


def changes_of(md: str | None) -> tuple[int, int, int, int, int, int]:
    """What a rewrite would touch: half-width marks behind Latin, repeats, dates, numbers, open quotes, mark defects."""
    out = [0] * 6
    for _, heading, body in pieces(md or ""):
        if heading.startswith("## Show Notes"):
            continue
        own = (*spoken_defects(body), sum(1 for _ in date_changes(body)), sum(1 for _ in number_changes(body)), sum(1 for _ in open_quotes(body)) if heading == "## 核心观点" else 0, mark_defects(body))
        out = [a + b for a, b in zip(out, own)]
    return tuple(out)


def spoken_defects(text: str) -> tuple[int, int]:
    """(half-width marks behind Latin, repeated characters) in a text."""
    return sum(1 for _ in latin_changes(text)), sum(m[1] not in REPEATS_KEPT for m in _REPEAT.finditer(text))


def mark_defects(text: str) -> int:
    """Hits of every mark rule on the text as it stands; orphan ends aren't counted."""
    rules = (*LOOSE.split("|"), rf"[{PAUSES}]+(?=[{ENDS}])", rf"(?<=[{ENDS}])[{PAUSES}]+", "[，、][，、]+", r"([。！？])\1+", _LEADING.pattern)
    halves = sum(1 for _ in han_changes(text))
    return halves + sum(1 for r in rules for _ in re.finditer(r, text))


widen_after_latin = _arrow(lambda t: rewritten(t, latin_changes(t)))
widen_after_han = _arrow(lambda t: rewritten(t, han_changes(t)))
rejoin_orphans = _arrow(_rejoin)
unstack_marks = _arrow(_unstack)
end_quotes = _arrow(lambda t: rewritten(t, quote_changes(t)))
arabic_dates = _arrow(convert_dates)
arabic_numbers = _arrow(convert_numbers)
clean_marks = _arrow(_clean_marks)
clean_markdown = _arrow(clean_document)


def clean_block(text: Column, heading: Column) -> Column:
    """``clean_body`` of a column of bodies and one of headings."""

    @F.pandas_udf("string")
    def apply(t: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([clean_body(x, y or "") if x else x for x, y in zip(t, h)], dtype=object)

    return apply(text, heading)


def change_counts(md: Column) -> Column:
    """struct<en_punct, repeat, cn_date, cn_number, quote_period, punct> of a document."""

    @F.pandas_udf("en_punct int, repeat int, cn_date int, cn_number int, quote_period int, punct int")
    def apply(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([changes_of(x) for x in t], columns=["en_punct", "repeat", "cn_date", "cn_number", "quote_period", "punct"])

    return apply(md)


def count_marks(text: Column) -> Column:
    """Hits of the native mark patterns in a text as it stands."""
    patterns = [
        rf"([{FULL_MARKS}]) +(?=[{HAN}])", rf"(?<=[{HAN}])([{FULL_MARKS}]) +(?=[A-Za-z0-9])", rf"(?<=[{HAN}]) +(?=[{FULL_MARKS}])",
        rf"[{PAUSES}]+(?=[{ENDS}])", rf"(?<=[{ENDS}])[{PAUSES}]+", "([，、])[，、]+", r"([。！？])\1+", rf"(?m)^[ \t>]*[{PAUSES}]+", rf"(?<=[{HAN}])\.{{3,}}(?![A-Za-z0-9])",
    ]
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return total
