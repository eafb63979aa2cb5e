"""Operators of the llm subpackage: brute force, round trips and held-out accuracy on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from castwright.llm import abuse, leakage, lookalike, names, packing, sentences, turns

# --- names ---


def full(a, b, org=False):
    x, y = names.read_name(a, org), names.read_name(b, org)
    return x[0] == y[0] and x[1] == y[1] == 3 and names.same_full(x[0], x[2], y[2])


@pytest.mark.parametrize("a,b,org,same", [
    ("Michael Basstodt", "Basstodt, Michael", False, True), ("Michael Basstodt", "michael Basetodt", False, True), ("Mike Basstodt", "Michael Basstodt", False, True),
    ("Michael Basstodt", "William Basstodt", False, False), ("Michael Casren", "Michael Casrenen", False, False), ("漆 思铭", "漆思明", False, True), ("漆思铭", "漆思青", False, False),
    ("Nerlan Story Lab", "nerlan story laboratory", True, True), ("Sound Lab Oslora", "Oslura Sound Lab", True, True), ("Nerlan Story Lab", "Nerlan Audio Lab", True, False),
    ("浅滩 · 内容工作室", "浅滩内容Studio", True, True), ("浅滩内容工作室", "浅滩文化工作室", True, False),
])
def test_full_names(a, b, org, same):
    assert full(a, b, org) == same


@pytest.mark.parametrize("short,long,org,want", [
    ("M. Basstodt", "Michael Basstodt", False, True), ("W. Basstodt", "Michael Basstodt", False, False), ("Basstodt", "Michael Basstodt", False, True), ("Michael B.", "Michael Basstodt", False, True),
    ("昕姐", "祝映昕", False, True), ("老祝", "祝映昕", False, True), ("映昕", "祝映昕", False, True), ("映君", "祝映昕", False, False), ("N.S.L.", "Nerlan Story Lab", True, True), ("浅滩工作室", "浅滩文化工作室", True, True),
])
def test_short_names(short, long, org, want):
    x, y = names.read_name(short, org), names.read_name(long, org)
    assert x[1] == 1 and names.fits(x[0], x[2], y[2]) == want
    assert not want or set(x[3]) & set(y[3])


def test_ratio_by_brute_force():
    def lcs(a, b):
        return max((1 + lcs(a[1:], b[1:]) if a[:1] == b[:1] else max(lcs(a[1:], b), lcs(a, b[1:])) if a and b else 0,)) if a and b else 0

    for a, b in itertools.product(["", "a", "abc", "abab", "bacab", "ccba"], repeat=2):
        assert names.lcs_ratio(a, b) == (2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


@pytest.mark.parametrize("a,b,same", [("Katherine Kesstolles", "Kathrine Kesstoles", True), ("Katherine Kesstolles", "Kathrina Kessdelles", False), ("Amadeus Halresk", "Halrsk Amadeu", True)])
def test_typos_in_both_tokens(a, b, same):
    assert full(a, b) == same


ROSTER = "episode_id string, origin string, ord int, cast_role string, typed_name string, key string"


def test_link_names(spark):
    rows = [("e1", "show_notes", 0, "主播", "Michael Basstodt", "x"), ("e1", "speaker_mapping", 0, "主播", "M. Basstodt", "x"), ("e1", "show_notes", 1, "嘉宾", "William Basstodt", "x"), ("e2", "speaker_mapping", 1, "嘉宾", "Basstodt", "x"),
            ("e2", "show_notes", 1, "嘉宾", "William Basstodt", "x"), ("e3", "show_notes", 1, "嘉宾", "Michael Basstodt", "x"), ("e1", "show_notes", 0, None, None, "x"), (None, "show_notes", 0, "主播", "Q", "x"), ("e1", "show_notes", 0, "主播", "", "x")]
    eps = spark.createDataFrame([("e1", "P"), ("e2", "P"), ("e3", "Q"), ("e1", "P"), (None, "P"), ("e9", None)], "episode_id string, podcast_name string")
    got = {tuple(r) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows, ROSTER), eps)).collect()}
    assert got == {("P", "M. Basstodt", "Michael Basstodt"), ("P", "Basstodt", "William Basstodt")}
    assert names.link_names(spark.createDataFrame([], ROSTER), eps).count() == 0


def test_common_suffixes_lose_nothing(spark):
    rows = [(f"e{i}", "show_notes", 0, "嘉宾", f"{a} {b}", "x") for i, (a, b) in enumerate(itertools.product(["Anna", "Boris", "Clara", "Doreen", "Anja"], ["Halstodt", "Morstodt", "Belstodt", "halstodt", "Moorstodt"]))]
    eps = spark.createDataFrame([(r[0], "P") for r in rows], "episode_id string, podcast_name string")
    df = spark.createDataFrame(rows, ROSTER)
    assert {tuple(r) for r in names.name_pairs(names.link_names(df, eps, common=3)).collect()} == {tuple(r) for r in names.name_pairs(names.link_names(df, eps)).collect()}


def test_common_tokens_lose_no_pair(spark):
    typed = ["Rebecca Aldvesk", "Rebecca Oldvesk", "Ildvesk Tomas", "Ulrich Eldvesk", "Rebecca Martin", "Rebecca Castor", "Castro, Rebecca", "Erbecca Martin", "Tomas Ldvesk", "J. K. Roweling", "J. K. Rowelimg", "J. P. Aldvesk"]
    rows = [(f"e{i}", "show_notes", 0, "嘉宾", n, "x") for i, n in enumerate(typed)]
    eps = spark.createDataFrame([(r[0], "P") for r in rows], "episode_id string, podcast_name string")
    groups = {n: {n} for n in typed}
    for a, b in itertools.combinations(typed, 2):
        if full(a, b):
            both = groups[a] | groups[b]
            groups |= dict.fromkeys(both, both)
    want = {("P", *sorted((a, b))) for a in typed for b in groups[a] if a != b}
    assert ("P", "Rebecca Aldvesk", "Rebecca Oldvesk") in want and ("P", "J. K. Rowelimg", "J. K. Roweling") in want
    for common in (0, 2, 200):
        assert {tuple(r) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows, ROSTER), eps, common=common)).collect()} == want


# --- sentences ---


@pytest.fixture(scope="module")
def known(spark):
    return sentences.known_sentences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 100_000)


@pytest.fixture(scope="module")
def chain(known):
    return sentences.fit(known[::2])


def test_held_out_boundaries(known, chain):
    r, hit, extra, missed = random.Random(5), 0, 0, 0
    held = [s for s in known[1::2] if s[-1] in ".。！？!?」”ะคบ"][:600]
    for i in range(0, len(held), 10):
        text, ends = "", set()
        for s in held[i : i + 10]:
            text += s
            ends.add(len(text))
            text += "" if s[-1] in "。！？」”" and r.random() < 0.8 else " "
        got = {b for _, b in sentences.sentence_ends(text, chain)}
        hit, extra, missed = hit + len(got & ends), extra + len(got - ends), missed + len(ends - got)
    assert hit / (hit + extra) > 0.97 and hit / (hit + missed) > 0.97


def test_sentences_round_trip(chain, spark):
    text = "【甲】他反复讲一句话：“别急。慢慢来。”我们花了3.5元。\n\n  Dr. Mara said so. \"Is it ready?\" Wim asked.\n\n"
    spans = sentences.sentence_ends(text, chain)
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == "".join(text.split()).replace(" ", "")
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    assert any(text[a:b].endswith("慢慢来。”") for a, b in spans) and not any(text[a:b].endswith("别急。") for a, b in spans)
    assert sentences.sentence_ends(None, chain) == sentences.sentence_ends(" \n\n ", chain) == []
    assert sentences.sentence_ends("ohne Zeichen\n\nzweiter", chain) == [(0, 12), (14, 21)]
    df = spark.createDataFrame([("a", text, 1), ("b", None, 1), ("c", "", 1), ("d", "x" * 200_000 + ".", 1)], "k string, body string, end_pos int")
    rows = sentences.split_sentences(df, ["k"], "body", chain).collect()
    assert [(r.start_pos, r.end_pos) for r in rows if r.k == "a"] == spans and {r.k for r in rows} == {"a", "d"}
    assert sentences.split_sentences(df.limit(0), ["k"], "body", chain).count() == 0


# --- turns ---

SEG = "episode_id string, seg_no int, text string, start_ms bigint, end_ms bigint, speaker string, unit int, name string"
TRA = "episode_id string, raw_text string, layout string, duration_sec double, names string"
STR = "episode_id string, run_no int, speaker_mapping map<string,string>"


def test_turns(spark):
    seg = [("e", 1, "嗯，", 0, 1, "SPEAKER_00", 0, ""), ("e", 2, "你好。", 0, 1, "spk_0", 0, ""), ("e", 2, "你好。", 0, 1, "spk_0", 0, ""), ("e", 3, "[music]", 0, 1, "SPEAKER_01", 0, ""), ("e", 4, "Yes.", 0, 1, "ＳＰＥＡＫＥＲ＿00", 0, ""),
           ("e", 5, "SPEAKER_01: 好的。", 0, 1, None, 0, ""), ("e", 6, "00:00:11 没错。", 0, 1, "【小朱】", 0, ""), ("e", 7, "在吗", 0, 1, None, 0, ""), ("e", 8, None, 0, 1, "SPEAKER_00", 0, ""), ("e", None, "x", 0, 1, "SPEAKER_00", 0, ""), (None, 1, "x", 0, 1, "SPEAKER_00", 0, "")]
    lines = "1\n00:00:00,000 --> 00:00:09,000\nSPEAKER_00: 第一句\n\n接着说\n[00:10] 小朱：第二句\nSPEAKER_00: (laughs)\n第三句\n他说：好\n【没人】对"
    tra = [("l", lines, "lines", 1.0, ""), ("l", lines, "lines", 1.0, ""), ("p", "SPEAKER_00: no", "prose", 1.0, ""), ("n", None, "lines", None, ""), (None, "SPEAKER_00: x", "lines", 1.0, "")]
    mapping = [("e", 1, {"SPEAKER_02": "嘉宾小朱"}), ("l", 1, {"SPEAKER_03": "小朱（嘉宾）"}), ("l", 2, None)]
    seg, tra, mapping = spark.createDataFrame(seg, SEG), spark.createDataFrame(tra, TRA), spark.createDataFrame(mapping, STR)
    got = {(r.episode_id, r.first_unit, r.last_unit, r.speaker) for r in turns.speaker_turns(seg, tra, mapping).collect()}
    assert got == {("e", 2, 4, "SPEAKER_00"), ("e", 5, 5, "SPEAKER_01"), ("e", 6, 6, "SPEAKER_02"), ("e", 7, 7, "UNKNOWN"), ("l", 2, 4, "SPEAKER_00"), ("l", 5, 5, "SPEAKER_03"), ("l", 7, 8, "SPEAKER_00"), ("l", 9, 9, "UNKNOWN")}
    assert turns.speaker_turns(seg.limit(0), tra.limit(0), mapping.limit(0)).count() == 0


def test_turn_text(spark):
    seg = spark.createDataFrame([("e", 1, "<|zh|>SPEAKER_00: 你好 (laughs)", 0, 1, None, 0, ""), ("e", 2, "再见。", 0, 1, "SPEAKER_00", 0, "")], SEG)
    row = turns.speaker_turns(seg, spark.createDataFrame([], TRA), spark.createDataFrame([], STR)).first()
    assert (row.speaker, row.n_units, row.text) == ("SPEAKER_00", 2, "你好 再见。")


# --- look-alikes ---

DOC = "episode_id string, key_points array<struct<quote:string>>, full_text string, unit string, canonical string"


def test_lookalikes(spark):
    plain = "Café nœud résumé 12 abc 行长 x² Straße ไทย हिन्दी"
    odd = "Café nœud résumé １２ аbс​ ⾏⻓ x² Straße ไทย हिन्दी"
    same = [odd, plain, "CAFÉ", "Cafe", "x2", "行長", "", None, "​", "absent"]
    rows = [("e", [(q,) for q in same], f"vor {plain} nach", "u", "c"), ("f", None, "x", "u", "c"), ("g", [("q",)], None, "u", "c")]
    got = {(r.episode_id, r.kp_no) for r in lookalike.equal_looking_quotes(spark.createDataFrame(rows + rows[:1], DOC)).collect()}
    assert got == {("e", 1)}
    assert lookalike.equal_looking_quotes(spark.createDataFrame([], DOC)).count() == 0


def test_both_ways_back_agree(spark):
    df = spark.createDataFrame([("аbс​ é",), ("",), (None,), ("abc é",)], "t string")
    classes = lookalike.unit_classes(df, "t")
    a = [r.c for r in lookalike.canonical_column(df, "t", classes, "c").collect()]
    b = [r.c for r in lookalike.canonical_column(df, "t", classes, "c", broadcast_units=0).orderBy("t").collect()]
    assert sorted(a, key=str) == sorted(b, key=str) and a[0] == a[3] == "abc é" and a[2] is None


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_packing_is_valid_and_bounded(sizes):
    bins = packing.best_fit_decreasing(sizes, 30)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 30 and (fill > 0).all()
    assert packing.lower_bound(np.array(sizes), 30) <= len(fill)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_bound_holds_for_the_optimum(sizes):
    def best(rest, bins):
        if not rest:
            return len(bins)
        out = best(rest[1:], [*bins, rest[0]])
        for i, b in enumerate(bins):
            if b + rest[0] <= 10:
                out = min(out, best(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]))
        return out

    assert packing.lower_bound(np.array(sizes), 10) <= best(sizes, [])


def test_packed_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 90), "x") for i in range(120)] + [(500, "wort " * 700, "x"), (501, None, "x"), (502, "", "x"), (None, "a", "x"), (3, "word " * 21, "x")], "doc_id bigint, text string, part string")
    out = packing.pack_documents(docs, capacity=128, group_docs=30)
    rows = out.collect()
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).groupBy("doc_id").max("n_tokens").toDF("doc_id", "n_tokens").collect()}
    fill = {}
    for r in rows:
        fill[r.seq_id] = fill.get(r.seq_id, 0) + r.n_tokens
    assert max(fill.values()) <= 128 and len({(r.doc_id, r.piece_no) for r in rows}) == len(rows)
    assert {d: sum(r.n_tokens for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}} == {d: n for d, n in sizes.items() if n}
    assert all(r.piece_no == 0 for r in rows if sizes[r.doc_id] <= 128)
    assert len(fill) <= -(-sum(fill.values()) // 128) + 4
    assert packing.pack_documents(docs.limit(0), capacity=128).count() == 0


# --- leakage ---


def test_winnowing_guarantee():
    r, made = random.Random(2), leakage.Fingerprints()
    for _ in range(40):
        shared = [f"w{r.randrange(999)}" for _ in range(leakage.K + leakage.W - 1)]
        a, b = ([f"{c}{r.randrange(999)}" for _ in range(r.randrange(30))] for c in "xy")
        assert set(made.of(a + shared + a[:3])[0]) & set(made.of(b + shared + b[:3])[0])


def test_common_length_by_brute_force():
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage.common_length(a, b) == t[-1][-1]


def test_leaks(spark):
    item = "The keeper at Pikula lighthouse weighed 8822 quince saplings beneath the old mill yard. The second mayor inherited 4721 rope ladders from the copper choir of Doroudro. How many were left?"
    zh = "两名来自茴屿琮的船夫封桥那阵子抄录了五千件彩绘的盐道图，结果三千件铁钥匙是伪造的。荇棂箬靠陶哨得到了什么？"
    docs = [
        (1, "Intro. [SPEAKER_00] the KEEPER at pikula um, lighthouse weighed 8822 quince saplings (laughs) beneath the ancient mill yard! bye", 0), (2, "Somebody saw 8822 quince saplings at Pikula lighthouse.", 0), (3, "How many were left?", 0),
        (4, "两名来自茴屿琮的船夫嗯，封桥那阵子抄录了五千件彩绘的\n盐道图，结果三千件铁钥匙是伪造的。", 0), (5, None, 0), (6, "", 0), (7, "beneath the old mill yard. The second mayor inherited 4721 rope ladders from the copper choir of Doroudro", 0), (None, item, 0),
    ]
    items = spark.createDataFrame([(1, item, "x"), (2, zh, "x"), (3, None, "x"), (4, "", "x"), (1, item, "x")], "item_id bigint, text string, hash string")
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, hash int")
    want = {(1, 1), (4, 2), (7, 1)}
    assert {tuple(r) for r in leakage.leaked_items(df, items).collect()} == want
    assert {tuple(r) for r in leakage.leaked_items(df, items, block_chars=20).collect()} == want
    assert leakage.leaked_items(df.limit(0), items).count() == leakage.leaked_items(df, items.limit(0)).count() == 0


def test_spread_replacements_leak(spark):
    item = "两名来自茴屿琮的船夫封桥那阵子抄录了五千件彩绘的盐道图。荇棂箬靠陶哨得到了什么？"
    said = "".join("某" if i % 6 == 5 and i < 24 else c for i, c in enumerate(item[:27]))  # unbroken spans of five
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"开场白，{said}，再见"), (2, "彩绘的盐道图")], "doc_id bigint, text string")
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == {(1, 1)}
    parts = leakage.item_parts(item)
    assert leakage.contains_item(parts, leakage.read_tokens(said), [(0, 0)])


@pytest.mark.parametrize("n", [40, 97, 120])
def test_each_half_of_an_item_leaks(n):
    tokens = [chr(0x4E00 + i) for i in range(n)]
    half, around = (n + 1) // 2, [chr(0x7000 + i) for i in range(60)]
    for a in range(n - half + 1):
        doc = around[:30] + tokens[a : a + half] + around[30:]
        hits = [(a + i, 30 + i) for i in range(0, half - 3, 2)]
        assert leakage.contains_item(leakage.Item(tokens, []), doc, hits), a
    assert not leakage.contains_item(leakage.Item(tokens, []), around[:30] + tokens[: half * 3 // 4] + around[30:], [(i, 30 + i) for i in range(half * 3 // 4)])


# --- abuse ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-3, 3).map(float), max_size=14))
def test_segments_by_brute_force(scores):
    def within(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*within(a, i), (best[0], i, j), *within(j, b)]

    got = abuse.best_segments(scores)
    assert [round(s, 6) for s, _, _ in sorted(got, reverse=True)][:1] == [round(s, 6) for s, _, _ in sorted(within(0, len(scores)), reverse=True)][:1]
    assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in within(0, len(scores))))
    assert all(sum(scores[a:b]) == pytest.approx(s) and s > 0 for s, a, b in got)


def test_disguises():
    assert abuse.read_tokens("M0R0N i​diot D r e c k s a c k lossser v57 白*痴 垃 圾") == ["moron", "idiot", "drecksack", "loser", "v", "白", "痴", "垃", "圾"]


@pytest.mark.parametrize("text,want", [
    ("死死死ね", ["死", "ね"]), ("バカカカカ", ["バ", "カ"]), ("дуррррак", abuse.read_tokens("дурак")), ("कमीीीीने", ["कमीने"]), ("시시시발", ["시발"]), ("ควายยยย", ["ควาย"]),
    ("f*u*c*k", ["fuck"]), ("i*d*i*o*t", ["idiot"]), ("f*u c*k", ["fuck"]), ("i_d_i_o_t", ["idiot"]), ("f u u u u c k", ["fuck"]), ("f*ck f**k", ["f*ck", "f*k"]), ("死*ね", ["死", "ね"]),
    ("д*у*р*а*к", abuse.read_tokens("дурак")), ("д_у_р_а_к", abuse.read_tokens("дурак")), ("д у р а к", abuse.read_tokens("дурак")), ("시 발 새 끼", ["시발새끼"]), ("ค ว า ย", ["ควาย"]), ("ค*ว*า*ย", ["ควาย"]),
    ("ไอ้ควาย", ["ไอ้ค", "อ้คว", "้ควา", "ควาย"]),
])
def test_disguises_of_all_scripts(text, want):
    assert abuse.read_tokens(text) == want


def test_parted_letters_with_signs():
    assert abuse.read_tokens("ह*रा*मी*ने") == abuse.read_tokens("हरामीने")
    assert abuse.read_tokens("वो तो ये भी") == abuse.read_tokens("वो तो, ये भी")  # short words stay apart


def test_scores(spark):
    r = random.Random(4)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    say = lambda: " ".join(r.choice(words) for _ in range(40))
    docs = [(i, say() + (" you filthy moron go away" if i % 20 == 0 else ""), "en", "s" if i % 2 else None, 1) for i in range(300)] + [(900, None, None, "s", 1), (901, "", "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(0, 240)] + [(3, None), (900, 1), (None, 1)], "doc_id bigint, abusive int")
    scored = abuse.score_documents(df, labels, least=3.0)
    rows = {x.doc_id: x for x in scored.collect()}
    assert len(rows) == 302 and all(rows[i].abusive == (i % 20 == 0) for i in range(300)) and rows[900].score == 0 and not rows[901].abusive
    rates = {x.source: (x.n_docs, x.n_abusive) for x in abuse.source_rates(scored).collect()}
    assert rates == {"s": (152, 0), None: (150, 15)}
    empty = abuse.score_documents(df.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_extremes():
    rnd = np.random.default_rng(5)
    n = rnd.integers(20, 400, 20000).astype(float)
    best = np.maximum(0, (np.log(0.01 * n) - np.log(-np.log(rnd.random(20000)))) / 0.7)
    best[:600] = 30.0  # abusive documents
    lam, k = abuse.fit_extremes(best, n, np.ones(20000))
    assert lam == pytest.approx(0.7, abs=0.08) and k == pytest.approx(0.01, rel=0.25)
    assert abuse.fit_extremes(np.zeros(0), np.zeros(0), np.zeros(0)) == (1.0, 1.0)


def test_harmless_use_of_a_word():
    y1, y0 = np.array([20.0, 20.0]), np.array([0.0, 60.0])
    score = abuse.log_odds(y1, y0, np.array([400.0, 400.0]), np.array([2.0, 2.0]), 5000, 15000, 0.3, 1.9, -0.6)
    assert score[0] > 1 and score[1] < 0


def test_unmarked_ends():
    """Chinese and Thai sentences put together without marks or blanks, by a model that knows half of the lines."""
    import duckdb

    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where doc_kind = 'comments' and text is not null").fetchall()
    lines = sorted({s for (t,) in rows for s in t.split("\n") if 3 <= len(s) <= 300})
    random.Random(3).shuffle(lines)
    half = len(lines) // 2
    chain = sentences.fit(lines[:half])
    bare = [s.strip().rstrip(sentences.MARKS + sentences.CLOSERS) for s in lines[half:]]
    bare = [s for s in bare if s and all("一" <= c <= "鿿" for c in (s[0], s[-1])) and not any("ぁ" <= c <= "ー" for c in s)]
    both = found = true = 0
    for i in range(0, len(bare) - 6, 6):
        ends = set(np.cumsum([len(s) for s in bare[i : i + 6]]).tolist())
        got = {e for _, e in sentences.sentence_ends("".join(bare[i : i + 6]), chain)}
        both, found, true = both + len(ends & got), found + len(got), true + len(ends)
    assert both / found > 0.9 and both / true > 0.5


def test_long_quotation_stays_whole():
    chain = sentences.Chain({}, 1.0, {(a, b): 0.0 for a in (False, True) for b in (False, True)})
    text = "他说「" + "好的。" * 300 + "」然后走了。再见。"
    assert [e for _, e in sentences.sentence_ends(text, chain)] == [904, 909, 912]
