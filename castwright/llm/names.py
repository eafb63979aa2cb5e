"""Variant spellings of names typed by people.

Names are blocked on the suffixes of their tokens within a podcast, compared by the ratio of the longest common
subsequence, and linked: full forms to entities by connected components, short forms (initials, surnames, given names,
titles, acronyms) to the one entity that they fit, or, of several, to the one that stands in the same episodes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.session import cut

#: Least ratio of two tokens, and of two whole names (one typo in either token of six letters or more).
RATIO, WHOLE = 0.8, 0.88
# Given names and their short forms.
NICKNAMES = {
    n: full
    for full, ns in {
        "alexander": "alex al sandy xander", "benjamin": "ben benny benji", "robert": "bob rob bobby robbie bert", "william": "bill will billy willy liam", "richard": "dick rick ricky rich",
        "elizabeth": "liz lizzie beth betty eliza libby", "katherine": "kate kathy katie kat kay", "margaret": "peggy maggie meg marge", "rebecca": "becky becca", "victoria": "vicky tori vic",
        "susannah": "sue susie suzy sanna", "michael": "mike mick mickey", "nicholas": "nick nicky", "frederick": "fred freddie freddy", "samantha": "sam sammy", "theodore": "ted teddy theo",
        "gregory": "greg", "leonard": "leo len lenny", "jennifer": "jen jenny", "josephine": "josie jo", "dorothea": "dora dot dolly thea", "james": "jim jimmy", "john": "jack johnny",
        "charles": "charlie chuck", "edward": "ed eddie ned", "thomas": "tom tommy", "joseph": "joe joey", "anthony": "tony", "matthew": "matt", "andrew": "andy drew", "daniel": "dan danny",
        "patricia": "pat patty", "christopher": "chris", "catherine": "cathy", "deborah": "deb debbie", "barbara": "barb babs", "stephen": "steve", "timothy": "tim", "kenneth": "ken", "david": "dave",
    }.items()
    for n in ns.split()
}
# Characters of names with one sound.
SOUNDS = "南楠 松淞 书舒 亦易 一依 东冬 之知芝 涛滔 蓓贝 小晓 堂棠 路露璐鹭 厦夏 明铭鸣 也野 晨辰 丽莉 佳嘉 瑶遥 云芸 墨默 靖静 宇雨羽 亭婷庭 岚蓝兰 文雯 子梓 心昕欣 珂科 卿青清 君均军 炜玮伟 禾荷和 昊皓浩 丘秋邱 希西溪 洋阳扬 师诗 辉晖 洁杰 娜那 琳林 思斯 芳方 峰锋 英瑛 红虹 玲灵 燕艳 婧敬 雪学 凡帆 成诚程 刚钢 海孩 华桦 俊骏 梅枚 宁柠 彤桐 薇微 璇旋 怡宜 钰玉 泽则 哲喆"
_SOUND = str.maketrans({c: g[0] for g in SOUNDS.split() for c in g})
_ORG_TAIL = re.compile(r"(?:有限公司|责任公司|公司|工作室|studios?|传媒)+$", re.I)
_ORG_WORDS = {"lab", "laboratory", "studio", "studios", "inc", "ltd", "llc", "co", "company", "gmbh"}
_ORG_KINDS = {"story", "sound", "audio", "media", "film", "press", "radio", "podcast"}
_CJK = re.compile(r"[㐀-鿿]")
_TITLE = re.compile(r"(?:老师|同学|先生|女士|总监|老板|师傅|博士|教授|小姐)$")

SCHEMA = "sort string, level int, tokens array<string>, keys array<string>"


def suffixes(token: str, least: int) -> list[str]:
    return [token[i:] for i in range(0, max(1, len(token) - least + 1))]


def read_name(name: str, is_org: bool) -> tuple[str, int, list[str], list[str]]:
    """(sort, level, tokens, suffix keys). Level 3: full form, 1: short form.

    Tokens of a person: Latin [first, last]; CJK [surname, given], '' where missing. Of an organisation: [core, kind].
    """
    text = unicodedata.normalize("NFKC", name).strip()
    low = text.lower()
    if is_org:
        if _CJK.search(low):
            bare = re.sub(r"[\s·・.\-_]+", "", low)
            bare = _ORG_TAIL.sub("", bare) or bare
            core, kind = (bare[:2], bare[2:]) if len(bare) > 2 else (bare, "")
            return "oc", 3 if kind else 1, [core, kind], suffixes(core, 2)
        words = re.findall(r"[^\W_]+", low)
        if words and all(len(w) == 1 for w in words):
            return "ol", 1, ["", "".join(words)], ["~" + "".join(words)]
        kinds = [w for w in words if w in _ORG_KINDS]
        core = " ".join(w for w in words if w not in _ORG_WORDS and w not in _ORG_KINDS)
        tail = "l" if any(w in ("lab", "laboratory") for w in words) else "s" if any(w.startswith("studio") for w in words) else ""
        keys = suffixes(core, 3) if core else []
        keys += ["~" + "".join(w[0] for w in [*core.split(), *kinds]) + tail] if kinds else []
        return "ol", 3 if kinds else 1, [core, " ".join(kinds)], keys
    if _CJK.search(low):
        bare = re.sub(r"[\s·・]+", "", low).translate(_SOUND)
        raw = re.sub(r"[\s·・]+", "", low)
        if m := _TITLE.search(raw):
            rest = bare[: m.start()]
            return ("pc", 1, [rest, ""], [f"s:{rest}"]) if len(rest) == 1 else ("pc", 1, ["", rest], suffixes(rest, 1))
        if len(raw) == 2:
            if raw[0] == raw[1] or bare[0] == bare[1]:
                return "pc", 1, ["", "*" + bare[1]], [bare[1]]
            if raw[1] == "总":
                return "pc", 1, [bare[0], ""], [f"s:{bare[0]}"]
            if raw[1] in "姐哥叔爷妹弟":
                return "pc", 1, ["", "*" + bare[0]], [bare[0]]
            if raw[0] == "阿":
                return "pc", 1, ["", "*" + bare[1]], [bare[1]]
            if raw[0] == "老":
                return "pc", 1, [bare[1], ""], [f"s:{bare[1]}"]
            # A given name, or 小 before a part of the name.
            return "pc", 1, ["", bare], [bare] + ([bare[1], f"s:{bare[1]}"] if raw[0] == "小" else [])
        if len(raw) >= 3:
            given = bare[1:] if len(bare) < 4 else bare[2:]
            return "pc", 3, [bare[: len(bare) - len(given)], given], suffixes(given, 1) + [f"s:{bare[: len(bare) - len(given)]}"]
        return "pc", 1, [bare, ""], [f"s:{bare}"]
    words = re.findall(r"[^\W\d_](?:[^\W_]|['’-])*", low)
    if "," in text and len(words) == 2:
        words = words[::-1]
    words = [NICKNAMES.get(w, w) for w in words]
    long = [w for w in words if len(w) > 1]
    keys = [k for w in long for k in suffixes(w, 3)] or words
    if len(words) == 1:
        return "pl", 1, ["", words[0]], keys
    if len(words) == 2 and len(long) == 1:
        return "pl", 1, words, keys
    return ("pl", 3, [words[0], words[-1]], keys) if words else ("pl", 1, ["", low], [low])


def lcs_ratio(a: str, b: str) -> float:
    """2 * length of the longest common subsequence / sum of lengths."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def like(a: str, b: str) -> bool:
    """Whether two tokens are spellings of one: the ratio decides; a short token, where one letter is much, must be equal.

    Lengths differ by one at most, since whole syllables tell family names apart (Casren, Casrenen).
    """
    return a == b or min(len(a), len(b)) > 3 and abs(len(a) - len(b)) < 2 and lcs_ratio(a, b) >= RATIO


def same_full(sort: str, a: list[str], b: list[str]) -> bool:
    """Whether two full forms mean the same: by the ratio of the whole names, and of each token with its counterpart.

    Characters stand for their sound (persons), so that in a Chinese name of three a typo of one sound has the ratio 1,
    another character 0.67.
    """
    if sort in ("pc", "oc"):
        return lcs_ratio(a[0] + a[1], b[0] + b[1]) >= RATIO and a[0] == b[0]
    if sort == "ol":
        return a[1] == b[1] and like(a[0], b[0]) and lcs_ratio(a[0] + a[1], b[0] + b[1]) >= WHOLE
    return any(like(a[0], x) and like(a[1], y) and lcs_ratio(a[0] + a[1], x + y) >= WHOLE for x, y in (b, b[::-1]))


def fits(sort: str, short: list[str], full: list[str]) -> bool:
    """Whether a short form may mean a full one."""
    if sort == "pc":
        sur, given = short
        if sur:
            return sur == full[0]
        if given[0] == "*":
            return given[1] in full[1][-1:]
        return given == full[1] or given[0] == "小" and len(given) == 2 and given[1] in (full[1][-1:], full[0])
    if sort == "oc":
        return short[0] == full[0]
    if sort == "ol":
        if not short[0]:
            initials = "".join(w[0] for w in [*full[0].split(), *full[1].split()])
            return short[1][: len(initials)] == initials and len(short[1]) - len(initials) < 2
        return like(short[0], full[0])
    first, last = short
    if not first:
        return like(last, full[1]) or last == full[0]
    if len(first) == 1:
        return full[0][:1] == first and like(last, full[1]) or full[1][:1] == first and like(last, full[0])
    return full[1][:1] == last and like(first, full[0]) or full[0][:1] == last and like(first, full[1])


def _reader():
    @F.pandas_udf(SCHEMA)
    def read(names: pd.Series, orgs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_name(n, bool(o)) for n, o in zip(names, orgs)], columns=["sort", "level", "tokens", "keys"])

    return read


def _judge(check):
    @F.pandas_udf("boolean")
    def judge(sort: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([check(s, list(x), list(y)) for s, x, y in zip(sort, a, b)], dtype=bool)

    return judge


def _near(token: Column) -> Column:
    """The token and, if it may be misspelt, what is left of it without any one letter: two tokens of one edit share one of these."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1)))
    return F.when(F.length(token) > 3, F.array_union(F.array(token), shorter)).otherwise(F.array(token))


def _finer_keys() -> Column:
    """What refines a common block, from the other token of the name: its deletion neighbourhood, its first and its last three letters."""
    first, last = F.col("tokens")[0], F.col("tokens")[1]
    beside = lambda same, other: F.transform(F.array_union(_near(other), F.array(F.concat(F.lit("<"), F.left(other, F.lit(3))), F.concat(F.lit(">"), F.right(other, F.lit(3))))), lambda x: F.concat(same, F.lit("\t"), x))
    ends = lambda t: F.array(F.concat(F.lit("<"), F.left(t, F.lit(3))), F.concat(F.lit(">"), F.right(t, F.lit(3))))
    both = F.flatten(F.transform(ends(first), lambda x: F.transform(ends(last), lambda y: F.array_join(F.array_sort(F.array(x, y)), "\t"))))
    keys = F.when(F.col("sort").isin("pc", "oc"), F.array(F.concat(first, F.lit("\t"), last))).when(F.col("sort") == "ol", beside(last, first))
    return F.array_distinct(keys.otherwise(F.concat(beside(first, last), beside(last, first), both)))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``podcast_name, name, entity``: the least name of each connected component, by label passing with shortcuts."""
    both = cut(edges.unionByName(edges.select("podcast_name", F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"))).distinct())
    at = cut(nodes.select("podcast_name", "name", F.col("name").alias("entity")))
    while True:
        near = both.join(at.select("podcast_name", F.col("name").alias("name_b"), F.col("entity").alias("near")), ["podcast_name", "name_b"]).groupBy("podcast_name", F.col("name_a").alias("name")).agg(F.min("near").alias("near"))
        moved = at.join(near, ["podcast_name", "name"], "left").select("podcast_name", "name", F.least("entity", "near").alias("to"), F.col("entity").alias("was"))
        jump = moved.select("podcast_name", F.col("name").alias("to"), F.col("to").alias("far"))
        after = cut(moved.join(jump, ["podcast_name", "to"], "left").select("podcast_name", "name", F.least("to", "far").alias("entity"), "was"))
        changed = after.where("entity <> was").limit(1).count()
        at = after.drop("was")
        if not changed:
            return at


def link_names(roster: DataFrame, episodes: DataFrame, common: int = 200) -> DataFrame:
    """``podcast_name, name, entity, level``: each different spelling of a podcast with the entity that it means.

    Full forms are compared within blocks of a common token suffix (3 letters or 1 character at least) or token. A
    suffix with more than ``common`` names of a podcast is discarded after it has been refined with the rest of the
    name: its names meet in blocks of one token and the deletion neighbourhood of the other, and of the first or last
    three letters of both. These hold every accepted pair with one edit in one token, and every pair with typos in both
    that leave either end of each as it is. Rows without episode, name or podcast mean nobody; repeated rows change
    nothing.
    """
    where = episodes.select("episode_id", "podcast_name").where("episode_id is not null and podcast_name is not null").distinct()
    typed = roster.where("typed_name is not null and episode_id is not null").select("episode_id", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce(F.col("cast_role") == "机构", F.lit(False)).alias("org"), F.col("typed_name").alias("name"))
    seen = cut(typed.join(where, "episode_id").select("podcast_name", "name", "org", "episode_id", "origin").distinct())
    names = seen.groupBy("podcast_name", "name").agg(F.max("org").alias("org"))
    forms = cut(names.withColumn("f", _reader()("name", "org")).select("podcast_name", "name", "f.*"))

    full = forms.where("level = 3")
    keyed = full.select("podcast_name", "name", "sort", "tokens", F.explode(F.array_union("keys", "tokens")).alias("key")).where("key <> ''")
    sized = keyed.join(keyed.groupBy("podcast_name", "sort", "key").agg(F.count(F.lit(1)).alias("n")), ["podcast_name", "sort", "key"])
    plain = sized.where(F.col("n") <= common).select("podcast_name", "sort", "key", F.lit("").alias("by"), "name", "tokens")
    refined = sized.where(F.col("n") > common).dropDuplicates(["podcast_name", "name"]).select("podcast_name", "sort", F.lit("").alias("key"), F.explode(_finer_keys()).alias("by"), "name", "tokens")
    blocks = plain.unionByName(refined)
    other = blocks.select("podcast_name", "sort", "key", "by", F.col("name").alias("name_b"), F.col("tokens").alias("tokens_b"))
    pairs = blocks.join(other, ["podcast_name", "sort", "key", "by"]).where("name < name_b").select("podcast_name", "sort", F.col("name").alias("name_a"), "tokens", "name_b", "tokens_b").dropDuplicates(["podcast_name", "name_a", "name_b"])
    edges = pairs.where(_judge(same_full)("sort", "tokens", "tokens_b")).select("podcast_name", "name_a", "name_b")
    entities = _components(full.select("podcast_name", "name"), edges)

    # Short forms: each token suffix against those of the full forms.
    short = forms.where("level < 3").select("podcast_name", "sort", F.col("name").alias("short"), F.col("tokens").alias("short_tokens"), F.explode(F.array_distinct("keys")).alias("key"))
    known = full.select("podcast_name", "sort", "name", "tokens", F.explode(F.array_distinct("keys")).alias("key"))
    fit = (
        short.join(known, ["podcast_name", "sort", "key"])
        .dropDuplicates(["podcast_name", "short", "name"])
        .where(_judge(fits)("sort", "short_tokens", "tokens"))
        .select("podcast_name", "short", "name")
        .join(entities, ["podcast_name", "name"])
        .select("podcast_name", "short", "entity")
        .distinct()
    )
    fit = cut(fit.join(fit.groupBy("podcast_name", "short").agg(F.count(F.lit(1)).alias("n_fit")), ["podcast_name", "short"]))
    # Of several, the one in the same episodes under another origin, and never under the same.
    stands = seen.join(entities, ["podcast_name", "name"]).select("podcast_name", "entity", "episode_id", F.col("origin").alias("there")).distinct()
    met = (
        fit.where("n_fit > 1")
        .join(seen.select("podcast_name", F.col("name").alias("short"), "episode_id", "origin"), ["podcast_name", "short"])
        .join(stands, ["podcast_name", "entity", "episode_id"])
        .groupBy("podcast_name", "short", "entity")
        .agg(F.count_distinct(F.when(F.col("origin") != F.col("there"), F.col("episode_id"))).alias("apart"), F.count_distinct(F.when(F.col("origin") == F.col("there"), F.col("episode_id"))).alias("beside"))
        .withColumn("value", F.col("apart") - F.col("beside"))
        .where("value > 0")
    )
    best = met.groupBy("podcast_name", "short").agg(F.max(F.struct("value", "entity")).alias("m"), F.sort_array(F.collect_list("value"), asc=False).alias("v"))
    chosen = best.where("size(v) = 1 or v[0] > v[1]").select("podcast_name", F.col("short").alias("name"), F.col("m.entity").alias("entity"))
    linked = fit.where("n_fit = 1").select("podcast_name", F.col("short").alias("name"), "entity").unionByName(chosen)
    alone = forms.where("level < 3").select("podcast_name", "name").join(linked.select("podcast_name", "name"), ["podcast_name", "name"], "left_anti").withColumn("entity", F.col("name"))
    return entities.withColumn("level", F.lit(3)).unionByName(linked.withColumn("level", F.lit(1))).unionByName(alone.withColumn("level", F.lit(0)))


def name_pairs(links: DataFrame) -> DataFrame:
    """``podcast_name, name_a, name_b``: all pairs of an entity's spellings."""
    b = links.select("podcast_name", "entity", F.col("name").alias("name_b"))
    return links.select("podcast_name", "entity", F.col("name").alias("name_a")).join(b, ["podcast_name", "entity"]).where("name_a < name_b").select("podcast_name", "name_a", "name_b").distinct()
