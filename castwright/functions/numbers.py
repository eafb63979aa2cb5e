"""Numbers, dates and times."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals and scales.
DIGITS = dict(zip("零一二三四五六七八九两", (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2)))
SCALES = {"十": 10, "百": 100, "千": 1000}
LARGE = {"万": 10_000, "亿": 100_000_000}
FIXED_WORDS = ("万一", "千万", "二百五")
ABOUT = "数近约上成超余"


def small_number(s: str) -> int | None:
    """Digit by digit (二零二六) or with one 十 (二十八)."""
    if s and all(c in DIGITS for c in s):
        return int("".join(str(DIGITS[c]) for c in s))
    if m := re.fullmatch(r"([一二三四五六七八九两]?)十([一二三四五六七八九]?)", s or ""):
        return (DIGITS[m[1]] if m[1] else 1) * 10 + (DIGITS[m[2]] if m[2] else 0)
    return None


def quantity(s: str) -> int | None:
    """A number with 十百千万亿, read by its large units."""
    if not s or any(c not in DIGITS and c not in SCALES and c not in LARGE for c in s):
        return None
    total = 0
    for part, unit in re.findall(r"([^万亿]*)([万亿]?)", s):
        if not part and not unit:
            continue
        value = sum((DIGITS[d] if d else 1) * SCALES[u] for d, u in re.findall("([零一二三四五六七八九两]?)([十百千])", part) if (d or "一") != "零") + sum(SCALES[u] for u in re.findall("零([十百千])", part))
        if part and part[-1] in DIGITS:
            value += DIGITS[part[-1]]
        total += value * LARGE.get(unit, 1)
    return total


def _keeps(run: str) -> bool:
    """Whether a run of numerals is no exact quantity."""
    scales = re.findall("[十百千万亿]", run)
    return (
        len(run) < 2
        or run in FIXED_WORDS
        or not scales
        or len(set(scales)) < len(scales)
        or bool(re.search("[零一二三四五六七八九两]{2}", run))
        or bool(re.search("[万亿][零一二三四五六七八九两](?![千百十])", run))
        or "亿万" in run
    )


def number_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """(from, to, new) of each quantity that is written in digits; 万 and 亿 at the end stay as units; dates, rough numbers and words stay."""
    for m in re.finditer("[零一二三四五六七八九十百千万亿两]+", text):
        run, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if _keeps(run) or before and before in ABOUT or after and (after in "月日号年" or not "一" <= after <= "鿿"):
            continue
        unit = run[-1] if run[-1] in LARGE else ""
        value = quantity(run[: len(run) - len(unit)])
        if value is not None:
            yield m.start(), m.end(), f"{value}{unit}"


def date_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """(from, to, new) of each date or bare year that is written digit by digit; what is out of range stays."""
    day = "[一二三四五六七八九十]{1,3}"
    for m in re.finditer(f"([零一二三四五六七八九]{{4}})年(?:[，,]?\\s*({day})月[，,]?\\s*({day})日|(?![，,]?\\s*{day}月))", text):
        y, *rest = (small_number(g) for g in m.groups() if g is not None)
        if y is None or not 1000 <= y <= 2999:
            continue
        if not rest:
            yield m.start(), m.end(), f"{y}年"
        elif None not in rest and 1 <= rest[0] <= 12 and 1 <= rest[1] <= 31:
            yield m.start(), m.end(), f"{y}年{rest[0]}月{rest[1]}日"


def rewritten(text: str, changes: Iterable[tuple[int, int, str]]) -> str:
    """The text with parts replaced; the parts come in order and don't overlap."""
    out, at = [], 0
    for a, b, new in changes:
        out += (text[at:a], new)
        at = b
    return "".join((*out, text[at:]))


def convert_numbers(text: str) -> str:
    return rewritten(text, number_changes(text))


def convert_dates(text: str) -> str:
    """二零二六年九月二十八日 to 2026年9月28日, and bare years."""
    return rewritten(text, date_changes(text))


def clock(seconds: Column) -> Column:
    """MM:SS or H:MM:SS of seconds rounded half to even; '??:??' for null."""
    s = F.bround(seconds, 0).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s.isNull(), "??:??").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def minutes_seconds(seconds: Column) -> Column:
    """M分S秒, cut to whole seconds."""
    s = seconds.cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("分"), (s % 60).cast("string"), F.lit("秒"))


def start_seconds(text: Column) -> Column:
    """Seconds of 'H:MM:SS', 'MM:SS' or a number, at least 0; null if it is none of them."""
    parts = F.split(F.trim(text), ":")
    whole = F.transform(parts, lambda p: p.try_cast("double"))
    value = F.when(F.trim(text).rlike(r"^\d+(:\d+){1,2}$"), F.aggregate(whole, F.lit(0.0), lambda a, x: a * 60 + x)).otherwise(F.trim(text).try_cast("double"))
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def stated_count(text: Column) -> Column:
    """The largest number of people that a text states (三位, 5 位), but for ordinals; null if none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!第)(?<![0-9零一二三四五六七八九十两])([0-9]{1,2}|[一二三四五六七八九十两]{1,3})\s*(?:位|个人|人)"), F.lit(1))
    value = F.transform(found, lambda s: F.coalesce(s.try_cast("int"), _small(s)))
    return F.array_max(value)


def _small(s: Column) -> Column:
    digit = lambda c: F.translate(c, "一二三四五六七八九两", "1234567892").try_cast("int")
    left, right = F.substring_index(s, "十", 1), F.substring_index(s, "十", -1)
    tens = F.when(left == "", 1).otherwise(digit(left)) * 10 + F.when(right == "", 0).otherwise(digit(right))
    return F.when(s.contains("十"), tens).otherwise(digit(s))


def publication_day(text: Column) -> Column:
    """YYYY-MM-DD of a publication date in one of its formats; instants with an offset by the clock of UTC+8; else the first ten characters."""
    zoned = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})$"), text))
    parts = lambda i: F.lpad(F.regexp_extract(text, r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})", i), 2, "0")
    dated = text.rlike(r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})")
    return F.when(zoned.isNotNull(), F.date_format(F.from_utc_timestamp(zoned, "Asia/Shanghai"), "yyyy-MM-dd")).when(
        dated, F.concat_ws("-", F.regexp_extract(text, r"^(\d{4})", 1), parts(2), parts(3))
    ).otherwise(F.left(text, F.lit(10)))
