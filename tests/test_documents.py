"""Rendering, checks, anchors, glossary, rewriting, handoffs, backends, continuation and model adapters on small texts."""

import pytest
from pyspark.sql import functions as F

from castwright import adapters
from castwright.functions import anchors, text
from castwright.operators import speakers
from castwright.plans import backend, checks, continuation, glossary, handoff, render
from castwright.sources import recognised

DOC = """# 题

> 来源：播客 | 题 | 2026-01-01

## Show Notes

（无）

## 摘要

摘。

## 核心观点

- **观点一。**展开提到超级个体。「引用原话在这里收尾。」
  - **脚手架**：解释。

## 术语表

- **超级个体（SI）**：一个人。
- **脚手架**：重复。
- **别的**：没有关联。

## 问题与思考

1. **为什么？**
   因为。

## 人物简介

**主播甲**：简介。

## 原文转录

【甲】**大家好**。

【乙】我们开始吧。
"""


def failed(spark, md, source=None):
    df = spark.createDataFrame([("d", md, source)], "episode_id string, md string, package string")
    return {r.check: r.n_hits for r in checks.check_documents(df, source="package" if source else None).collect()}


def test_good_document(spark):
    assert failed(spark, DOC) == {"V17": 2}
    assert failed(spark, None) == {}


@pytest.mark.parametrize("old,new,check", [
    ("## 摘要\n\n摘。\n", "", "V1"), ("摘。", "", "V2"), ("播客 | 题 |", "播客 |", "V3"), ("## Show Notes\n\n（无）\n", "", "V4"), ("- **观点一。**", "- 观点一。", "V5"), ("**观点一。**", "**观点一**：", "V6"), ("  - **脚手架**", "> 引用\n  - **脚手架**", "V7"),
    ("  - **脚手架**", "「整行」\n  - **脚手架**", "V8"), ("因为。", "因为①。", "V9"), ("1. **为什么？**", "**为什么？**", "V10"), ("因为。", "因为。\n- **q?** a", "V11"), ("1. **为什么？**", "1. 为什么？", "V12"), ("因为。", "真的吗？\n   对吗？", "V13"),
    ("- **别的**：没有", "- 别的没有", "V15"), ("没有关联。", "没有关联", "V16"), ("**主播甲**：简介。", "> 引用", "V18"), ("**主播甲**：简介。", "主播甲", "V18"), ("【乙】我们", "**乙**：我们", "V19"), ("**大家好**", "大家好", "V20"), ("【乙】我们", "[SPEAKER_01] 我们", "V21"),
    ("我们开始吧。", "我是丙丙，你好。", "V22"), ("【乙】我们开始吧。", "【甲】一\n【甲】二\n【甲】三", "V23"), ("【乙】我们开始吧。", "【甲】一\n【甲】二\n【乙】三", "V24"), ("我们开始吧。", "有 gap,那个你你你好。", "V25"), ("我们开始吧。", "我们开始吧，", "V26"), ("我们开始吧。", "我们， 开始吧。", "V27"),
    ("在这里收尾。」", "在这里收尾」", "V28"), ("## 人物简介", "## 大纲\n\nx\n\n## 人物简介", "V30"), ("因为。", "因为。\nmindmap", "V31"), ("因为。", "因为。\n```", "V32"), ("摘。", "「甲」、「乙」。", "V33"), ("我们开始吧。", "好。对。是的。", "V34"),
])
def test_each_check(spark, old, new, check):
    assert old in DOC
    assert check in failed(spark, DOC.replace(old, new)), check


def test_checks_of_order_and_length(spark):
    a, b = DOC.index("## 术语表"), DOC.index("## 问题与思考")
    moved = DOC[:a] + DOC[b : DOC.index("## 人物简介")] + DOC[a:b] + DOC[DOC.index("## 人物简介") :]
    assert "V14" in failed(spark, moved)
    assert "V29" in failed(spark, DOC, "头\n[SPEAKER_00] " + "很长的话" * 30) and "V29" not in failed(spark, DOC, "很长的头" * 50 + "[SPEAKER_00] 大家好。我们开始吧。")
    one = spark.createDataFrame([(moved,)], "md string")
    assert one.select(glossary.place_glossary(F.col("md")).alias("m")).first().m == DOC
    assert "V1" not in failed(spark, DOC.replace("## 原文转录", "## 全文转录"))


def test_plausible_names():
    assert [checks.plausible_name(n) for n in ("丙丙", "设计师", "真人", "INFP", "Nina", "四个汉字啊")] == [True, False, False, False, True, False]
    assert checks.foreign_names("【课代表立正】我是立正，好。\n【小朱】我是小猪，好。\n【主播】我是丙丙。") == 1


def test_glossary(spark):
    df = spark.createDataFrame([("d", DOC)], "episode_id string, md string")
    assert [(r.term, r.state, r.target, r.place) for r in glossary.glossary_terms(df).orderBy("term_no").collect()] == [("超级个体（SI）", "inline", 0, "核心观点第 1 条"), ("脚手架", "dup", None, None), ("别的", "keep", None, None)]
    once = glossary.inline_glossary(df)
    row = once.first()
    assert (row.n_dup, row.n_inline) == (1, 1) and "  - **脚手架**：解释。\n  - **超级个体（SI）。** 一个人。\n" in row.md and "- **脚手架**：重复。" not in row.md and "- **别的**" in row.md
    again = glossary.inline_glossary(once.select("episode_id", "md")).first()
    assert (again.n_dup, again.n_inline, again.md) == (0, 0, row.md)
    gone = glossary.inline_glossary(spark.createDataFrame([("d", DOC.replace("- **别的**：没有关联。\n", ""))], "episode_id string, md string")).first()
    assert "## 术语表" not in gone.md
    variants = spark.createDataFrame([("甲（乙）",), ("A/B test",), ("甲",)], "t string").select(glossary.term_variants(F.col("t")).alias("v"))
    assert [r.v for r in variants.collect()] == [["甲（乙）"], ["A/B test", "B test"], []]
    empty = spark.createDataFrame([("## 核心观点\n\n- a\n\n## 术语表\n\n- （无）\n\n## 问题与思考\n",), ("## 核心观点\n\n- **待校订。**\n\n## 术语表\n\n- （无）\n",)], "m string").select(glossary.drop_empty_glossary(F.col("m")).alias("r"))
    assert [("术语表" in r.r) for r in empty.collect()] == [False, True]


def test_anchors_of_documents():
    talk = anchors.Talk("【甲】今天我们聊聊知识管理，它其实很难坚持下去。\n【乙】对，超级 个体。")
    assert talk.quote("前面不同，今天我们聊聊知识管理它其实很难坚持下去") == "今天我们聊聊知识管理，它其实很难坚持下去"
    assert talk.quote("们聊聊知识管理它其实很难坚") == "们聊聊知识管理，它其实很难坚"  # the quote's own start needs no edge
    assert talk.quote("某某聊聊知识管理它其实很难坚") is None and talk.quote("太短") is None
    assert talk.term("超级个体") == "超级 个体" and talk.term("去对") is None and talk.term("长" * 13) is None
    md = "## 核心观点\n\n- **x。**「今天我们聊聊知识管理，它其实很难」\n  - **知识（SI）**：y。\n\n## 原文转录\n\n【甲】今天我们聊聊知识管理，它其实很难坚持。知识。"
    bold = anchors.bold_markdown(md)
    assert bold.endswith("【甲】**今天我们聊聊知识管理，它其实很难**坚持。**知识**。") and anchors.bold_markdown(bold) == bold
    assert anchors.forms("超级个体（SI）") == ["超级个体（SI）", "超级个体", "SI"]


def test_render(spark):
    schema = "episode_id string, title string, podcast_name string, pub_date string, show_notes string, warnings array<string>, summary string, key_points array<struct<point:string,evidence:string,quote:string,anchor:string,terms:array<struct<term:string,descr:string>>>>, keywords array<struct<keyword:string,descr:string>>, questions array<struct<question:string,answer:string,anchor:string>>, speaker_intro string, full_text string, costs map<string,double>, timings map<string,double>"
    row = ("e", "题", "播", "日", None, ["w"], "摘", [("点：", "证", "甲好", None, [("词", ""), ("词二", "义")])], [("K", "d.")], [("问？", "答", None), ("", "", None)], None, "【甲】甲好\n【甲】接着，\n---\n【乙】嗯", {"llm": 0.5}, {"process": 61.0, "transcribe": 5.0})
    md = render.render_markdown(spark.createDataFrame([row], schema), timings="timings").first().md
    assert md.startswith("# 题\n\n> 来源：播 | 题 | 日\n\n> [WARN] w\n\n## Show Notes\n\n（无）\n\n## 摘要\n\n摘\n\n## 核心观点\n\n- **点。**证。「甲好」\n  - **词**\n  - **词二**：义。\n\n## 术语表\n\n- **K**：d.\n\n## 问题与思考\n\n1. **问？**\n   答\n\n2.\n\n## 人物简介\n\n（无）")
    assert md.endswith("## 原文转录\n\n【甲】**甲好**。接着。\n\n---\n\n【乙】嗯\n\n---\n\n耗时 转写 0分5秒 / 校订 1分1秒；LLM 费用约 0.5000 元")
    cut = spark.createDataFrame([(md,), ("# x",)], "m string").select(render.replace_transcript(F.col("m"), F.lit("新")).alias("r")).collect()
    assert cut[0].r.endswith("（无）\n\n## 原文转录\n\n新\n") and cut[1].r is None


def test_rewriting():
    md = "# t,好\n\n## Show Notes\n\n好,不动\n\n## 核心观点\n\n- 「由 Agent 来完成」\n\n## 原文转录\n\n【甲】三万五千人,你你你好， 对。\n，然后，"
    new = text.clean_document(md)
    assert "好,不动" in new and "「由 Agent 来完成。」" in new and new.endswith("【甲】35000人，你好，对。\n然后，") and text.clean_document(new) == new
    assert text.changes_of(md)[1:] == (1, 0, 1, 1, text.changes_of(md)[5]) and text.changes_of(md)[5] >= 3
    assert "".join(a + c for a, _, c in text.pieces(md)) == md
    assert [text.unstacked(x) for x in ("，。", "。，，！", "、，", "；，、", "！！？")] == ["。", "。！", "、", "；，", "！？"]


def test_handoffs(spark):
    kind = "key_points array<struct<point:string,evidence:string,quote:string,anchor:string>>, questions array<struct<question:string,answer:string,anchor:string>>"
    df = spark.createDataFrame([("e", [("三万五千人", None, "好， 对", "三万五千人")], [("问,好", "答", "锚点你你你")], "35000人，锚点你。")], f"episode_id string, {kind}, full_text string")
    row = handoff.sync_numbers(handoff.sync_marks(df)).first()
    assert (row.n_marks, row.n_numbers) == (2, 1) and row.key_points[0][:4] == ("35000人", "", "好，对", "三万五千人") and row.questions[0].question == "问，好"
    assert {(r.part, r.item_no, r.repaired) for r in handoff.stale_anchors(df).collect()} == {("key_points", 1, "35000人"), ("questions", 1, "锚点你")}
    quotes = spark.createDataFrame([([("a", "", "能吗", ""), ("b", "", "能吗", ""), ("c", "", "好", "")],)], "key_points array<struct<point:string,evidence:string,quote:string,anchor:string>>")
    assert [p.quote for p in quotes.select(handoff.sync_quotes(F.col("key_points"), F.array(F.lit("能吗"), F.lit("好"))).alias("k")).first().k] == ["能吗？", "能吗", "好。"]
    maps = spark.createDataFrame([("SPEAKER_00:甲, SPEAKER_01:乙,SPEAKER_00:丙",), ("S0:甲",), ("SPEAKER_00:",)], "t string").select(handoff.speaker_map(F.col("t")).alias("m"))
    assert [r.m for r in maps.collect()] == [{"SPEAKER_00": "丙", "SPEAKER_01": "乙"}, None, None]


def test_speakers_with_aliases_and_overrides(spark):
    seg = spark.createDataFrame([("e", "S0", "我是小猪，"), ("e", "S1", "今天邀请了大家"), ("e", "S2", "嗯"), ("e", "S3", "我是小朱。我是湫湫。")], "episode_id string, speaker string, text string")
    roster = spark.createDataFrame([("e", 0, "主播", "小朱"), ("e", 1, "嘉宾", "湫湫")], "episode_id string, ord int, role string, name string")
    over = spark.createDataFrame([("e", "S2", "嘉宾湫湫")], "episode_id string, speaker string, label string")
    signals = speakers.cluster_signals(seg)
    got = {(r.speaker, r.name, r.issue) for r in speakers.resolve_speakers(signals, roster, over).collect()}
    assert got == {("S0", "主播小朱", None), ("S1", "主播小朱", None), ("S2", "嘉宾湫湫", None), ("S3", None, "several")}
    assert {(r.speaker, r.issue) for r in speakers.diarization_issues(signals, roster).collect()} == {("S3", "merged"), (None, "split")}
    assert speakers.read_roster("主播：斯怡Jins 嘉宾：小朱\n本期请到斯怡、机器坏人、404 三位") == [("主播", "斯怡Jins"), ("嘉宾", "小朱"), ("", "机器坏人"), ("", "404")]
    assert speakers.read_roster(None) == []


def test_backends(spark):
    sweep = spark.createDataFrame([("a", 2, 0.31, 0.32), ("a", 3, 0.14, 0.2), ("b", 2, 0.30, 0.4), ("b", 3, 0.31, 0.04), ("c", 2, 0.07, 0.4), ("d", 2, 0.3, 0.1)], "episode_id string, k int, silhouette double, min_share double")
    assert {(r.episode_id, r.backend, r.k, r.minor) for r in backend.suggest(sweep).collect()} == {("a", "wespeaker", 2, False), ("b", "wespeaker", 2, False), ("c", "campplus", None, False), ("d", "wespeaker", 2, True)}
    tries = spark.createDataFrame([("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 2, False), ("b", 5, False), ("b", 6, True)], "episode_id string, k int, ok boolean")
    assert {tuple(r) for r in backend.retried_k(tries).collect()} == {("a", 3), ("b", 5)}
    seg = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "episode_id string, seg_no int, speaker string")
    bad = spark.createDataFrame([("a", ["single"]), ("b", [])], "episode_id string, reasons array<string>")
    again = spark.createDataFrame([("a", 1, "y"), ("b", 1, "y")], "episode_id string, seg_no int, speaker string")
    assert {tuple(r) for r in backend.collapse_fallback(seg, bad, again).select("episode_id", "seg_no", "speaker").collect()} == {("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x")}


def test_continuation(spark):
    lines = spark.createDataFrame([("> 来源：播 | 日", "题"), ("> 来源：播 | 题 | 日", "题"), ("x", "题")], "l string, t string").select(continuation.repair_source(F.col("l"), F.col("t")).alias("r"))
    assert [r.r for r in lines.collect()] == ["> 来源：播 | 题 | 日", "> 来源：播 | 题 | 日", "x"]
    cache = spark.createDataFrame([("a", "/o/a.md", "final"), ("b", "/o/b.md", "final"), ("c", "/o/c.degraded.md", "final"), ("d", "/o/d.json", "handoff")], "key string, path string, stage string")
    files = spark.createDataFrame([("/o/a.md",), ("/o/c.degraded.md",), ("/o/d.json",)], "path string")
    assert [r.key for r in continuation.valid_entries(cache, files).collect()] == ["a"] and [r.key for r in continuation.valid_entries(cache, files, "handoff").collect()] == ["d"]
    kept = spark.createDataFrame([(1, 1, "一二三四", "一二三"), (1, 2, "一二三四", "一二三"), (1, 1, "一二三四", "一"), (1, 1, "一二三四", " "), (1, 1, "一二三四", None)], "a int, b int, s string, c string").select(continuation.accepted_chunk(*map(F.col, "absc")).alias("r"))
    assert [r.r for r in kept.collect()] == ["一二三", *["一二三四"] * 4]
    packages = spark.createDataFrame([("e", "[SPEAKER_00] 大家好。我们开始吧。"), ("f", "x")], "episode_id string, text string")
    rows = {r.episode_id: r for r in continuation.report(spark.createDataFrame([("e", DOC)], "episode_id string, md string"), packages).collect()}
    assert rows["e"].kept == 1.4 and rows["e"].status == "pending" and rows["f"].status == "missing" and not rows["f"].exists


def test_recogniser_payloads(spark):
    rows = [("e", 1, [(0.0, 900.0, "<|zh|>一", 0), (1000.0, 1500.0, "", 0), (2500.0, 2600.0, "三", 1)], ["二", "点"], [(1000.0, 1100.0), (1200.0, 1500.0)]), ("f", 0, [(0.0, 0.5, "x", None), (0.6, 1.0, "y", None)], [], [])]
    got = {(r.episode_id, r.text, r.start_ms, r.end_ms, r.speaker) for r in recognised.recognised_segments(spark.createDataFrame(rows, recognised.RAW)).collect()}
    assert got == {("e", "一 二点", 600000, 601500, "SPEAKER_00"), ("e", "三", 602500, 602600, "SPEAKER_01"), ("f", "x", 0, 500, None), ("f", "y", 600, 1000, None)}


def test_adapters(spark):
    t = spark.createDataFrame([("e", "嗯一二三四五\n嗯六七八九十"), ("f", "")], "episode_id string, raw_text string")
    got = {r.episode_id: (r.text, r.n_chunks, r.n_failed) for r in adapters.clean_transcripts(t, adapters.fake_cleaner({"嗯": ""}, (1,)), 8).collect()}
    assert got["e"] == ("一二三四五\n\n嗯六七八九十", 2, 1)
    assert adapters.first_model(["a", "b"], lambda: ["b"], lambda m: True) == "b" and adapters.first_model(["a"], None, lambda m: False) is None

    def down():
        raise ConnectionError

    assert adapters.first_model(["a", "b"], down, lambda m: False) == "a" and adapters.is_rate_limit("HTTP 429") and adapters.is_missing_model("Model not found")

    def load():
        def model(batch):
            if len(batch) > 1:
                raise adapters.ModelError("too much")
            return batch.assign(text=batch["text"] + "。")[["episode_id", "seg_no", "text"]]

        return model

    texts = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b")], "episode_id string, seg_no int, text string").coalesce(1)
    assert [r.text for r in adapters.punctuate(texts, load).orderBy("seg_no").collect()] == ["a。", "b。"]


def test_sinks(spark, tmp_path):
    from castwright.sources import sinks

    docs = spark.createDataFrame([("a", "x,好", []), ("b", "y", ["w"])], "episode_id string, md string, warnings array<string>")
    sinks.write_documents(docs, str(tmp_path / "out"))
    back = {(r.episode_id, r.quality, r.md) for r in sinks.read_documents(spark, str(tmp_path / "out")).collect()}
    assert back == {("a", "final", "x,好"), ("b", "degraded", "y")}
    counts = sinks.rewrite(spark, str(tmp_path / "out"), str(tmp_path / "next"), apply=False)
    assert counts.count() == 2 and not (tmp_path / "next").exists()
    sinks.rewrite(spark, str(tmp_path / "out"), str(tmp_path / "next"), apply=True)
    assert {r.md for r in sinks.read_documents(spark, str(tmp_path / "next")).collect()} == {"x，好", "y"}
    with pytest.raises(ValueError):
        sinks.rewrite(spark, str(tmp_path / "out"), str(tmp_path / "out"), apply=True)
