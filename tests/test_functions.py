"""Rules on texts, numbers and times."""

import pytest
from pyspark.sql import functions as F

from castwright.functions import anchors, numbers, text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "rule,value,want",
    [
        (text.quotes_to_corners, '他说"你好"，她说“再见”。', "他说「你好」，她说「再见」。"),
        (text.quotes_to_corners, None, None),
        (text.tighten_marks, "量化取样， 然后种种困惑 。", "量化取样，然后种种困惑。"),
        (text.tighten_marks, "R。 F。 Kuang", "R。 F。 Kuang"),
        (text.unstack_marks, "好，。真的？？，，是", "好。真的？是"),
        (text.merge_repeats, "你你你培训", "你培训"),
        (text.merge_repeats, "哈哈哈对对对刚刚", "哈哈哈对对对刚刚"),
        (text.end_turns, "【甲】讲到一半，", "【甲】讲到一半。"),
        (text.strip_tags, "<|zh|>第一句〈HAPPY〉", "第一句"),
        (text.strip_tags, None, ""),
        (text.widen_after_latin, "有一个 gap,那个", "有一个 gap，那个"),
        (text.widen_after_latin, "Talk is cheap, show me the code", "Talk is cheap, show me the code"),
        (text.widen_after_han, "你好,世界...", "你好，世界……"),
        (text.rejoin_orphans, "前一句\n。后一句\n，再来", "前一句。后一句\n再来"),
        (text.end_quotes, "「由 Agent 来完成」\n「能修吗」", "「由 Agent 来完成。」\n「能修吗？」"),
        (text.end_quotes, "「而后来」", "「而后来」"),
        (text.arabic_dates, "二零二六年，九月二十八日星期一发布", "2026年9月28日星期一发布"),
        (text.arabic_dates, "二零二四年五月", "二零二四年五月"),
        (text.arabic_numbers, "三万五千人", "35000人"),
        (text.arabic_numbers, "十二亿用户", "12亿用户"),
        (text.arabic_numbers, "十一万两千", "112000"),
        (text.arabic_numbers, "万一数十人三四十", "万一数十人三四十"),
        (text.display_label, "主持人Nina", "【Nina】"),
        (text.display_label, "伦尼·拉奇茨基（嘉宾）", "【伦尼】"),
        (text.display_label, "", ""),
        (text.safe_filename, '节目: "AI/未来"?', "节目_ _AI_未来__"),
        (text.as_sentence, "要点：", "要点。"),
        (text.as_bold, "**问题**", "**问题**"),
        (numbers.start_seconds, "1:05:49", 3949.0),
        (numbers.start_seconds, "abc", None),
        (numbers.stated_count, "三位嘉宾和第五位，共 12 人", 12),
        (numbers.stated_count, "第三位", None),
    ],
)
def test_rules(spark, rule, value, want):
    assert one(spark, rule, value) == want


def test_clock(spark):
    rows = spark.createDataFrame([(None,), (59.5,), (3661.0,)], "s double").select(numbers.clock(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == ["??:??", "01:00", "1:01:01"]


def test_replacements_in_order(spark):
    assert one(spark, lambda c: text.replace_in_order(c, [("ab", "b"), ("b", "c")]), "abb") == "cc"


def test_anchors():
    body = "【甲】今天我们聊聊知识管理，它其实很难坚持下去。\n【乙】对。"
    assert anchors.find_anchor("聊聊知识管理它其实很难坚持", body) == "聊聊知识管理，它其实很难坚持"
    assert anchors.find_anchor(None, body) is None
    assert anchors.mark_anchors("【长】长锚点里有锚点，锚点", ["锚点", "长锚点里有"]) == "【长】**长锚点里有****锚点**，锚点"
