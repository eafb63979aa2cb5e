"""Roster, signals and resolution of speaker clusters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.functions.text import display_label

# Roles, names behind them, what cuts a name off, words that are no names, self-introductions, host marks,
# people counts behind a list of names, aliases by sound.
ROLE = "(?:主[播持理]|嘉宾|客座)"
ROSTER = re.compile(rf"{ROLE}(?:简介|人)?(?:主[播持理]|嘉宾|客座|主持)?[：:\s]*([一-龥A-Za-z·]{{1,6}})")
CUT_OFF = re.compile("主[播持理]|嘉宾|客座|主持|与|和|及|等|携|邀请")
PROSE = re.compile(r"([一-龥A-Za-z·0-9]{1,8}(?:[、，,][一-龥A-Za-z·0-9]{1,8}){0,6})\s*[0-9一二三四五六七八九十百两]+\s*[位人]")
NO_NAMES = "是 与 和 等 的 为 叫 有 及 或 也 来 一个 这个 那个 他们 她们 我们 你们 因为 所以 本科 学历 文科 腾讯 微信 在做 当时 现在".split()
NOT_IN_NAMES = ("请到", "本期", "这期", "该期")
SELF_NAME = r"我(?:是|叫|们是|就是)\s*([一-龥A-Za-z·]{1,4})(?=[，。！？、；：\s])"
HOST_MARKS = "邀请了两位|邀请了|给大家介绍|今天邀请|咱们.?两位|两位嘉宾"
ALIASES = {"小猪": "小朱", "秋秋": "湫湫"}
HOSTS, GUESTS = ("主播", "主持", "主理"), ("嘉宾", "客座")

_ROSTER_TYPE = "array<struct<role:string,name:string>>"


def read_roster(notes: str | None) -> list[tuple[str, str]]:
    """(role, name) of show notes: names behind a role, then names of a list with a count, which get no role.

    A name of a list is left out if it holds a known one or is part of it, so that a person isn't counted twice.
    """
    bare = (notes or "").translate({ord("【"): None, ord("】"): None})
    cast = [(m[0][:2], CUT_OFF.split(m[1])[0].strip()) for m in ROSTER.finditer(bare)]
    out = list(dict.fromkeys((role, name) for role, name in cast if len(name) > 1 and name not in NO_NAMES))
    listed = (name.strip() for m in PROSE.finditer(bare) for name in re.split("[、，,]", m[1]))
    for name in listed:
        usable = len(name) > 1 and name not in NO_NAMES and not any(w in name for w in NOT_IN_NAMES)
        if usable and not any(name in known or known in name for _, known in out):
            out.append(("", name))
    return out


def roster_of(notes: Column) -> Column:
    """array<struct<role, name>> of show notes."""

    @F.pandas_udf(_ROSTER_TYPE)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"role": r, "name": n} for r, n in read_roster(t)])

    return run(notes)


def roster_names(roster: Column) -> Column:
    """The names of a roster if there are two at least, else null."""
    names = F.array_distinct(F.transform(roster, lambda p: p["name"]))
    return F.when(F.size(names) >= 2, names)


def cluster_signals(segments: DataFrame) -> DataFrame:
    """``episode_id, speaker, self_names, host_marks, n``: what a cluster says about itself; rows without speaker are left out."""
    said = F.filter(F.transform(F.regexp_extract_all("text", F.lit(f"(?U){SELF_NAME}"), F.lit(1)), lambda s: F.trim(s)), lambda s: ~s.isin(*NO_NAMES) & (F.length(s) >= 2))
    own = segments.where("speaker is not null and speaker <> ''").withColumn("text", F.coalesce("text", F.lit("")))
    s = own.select("episode_id", "speaker", said.alias("said"), F.regexp_count("text", F.lit(HOST_MARKS)).alias("marks"))
    # Names are made distinct in each task before they are sent; a cluster has few.
    names = s.select("episode_id", "speaker", F.explode("said").alias("name")).distinct().groupBy("episode_id", "speaker").agg(F.array_sort(F.collect_set("name")).alias("self_names"))
    sums = s.groupBy("episode_id", "speaker").agg(F.sum("marks").cast("bigint").alias("host_marks"), F.count(F.lit(1)).alias("n"))
    return sums.join(names, ["episode_id", "speaker"], "left").select("episode_id", "speaker", F.coalesce("self_names", F.array().cast("array<string>")).alias("self_names"), "host_marks", "n")


def with_aliases(signals: DataFrame, roster: DataFrame) -> DataFrame:
    """``episode_id, speaker, said, name``: each self-name, and the roster's spelling of it.

    An alias counts only if the roster lacks what was said and has the alias.
    """
    known = roster.select("episode_id", F.col("name").alias("known")).distinct()
    alias = F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), F.col("said"))
    own = signals.select("episode_id", "speaker", F.explode("self_names").alias("said"))
    exact = own.join(known.withColumnRenamed("known", "said"), ["episode_id", "said"], "left_semi").withColumn("name", F.col("said"))
    other = own.join(known.withColumnRenamed("known", "said"), ["episode_id", "said"], "left_anti").withColumn("name", alias)
    aliased = other.join(known.withColumnRenamed("known", "name"), ["episode_id", "name"], "left_semi")
    unknown = other.join(known.withColumnRenamed("known", "name"), ["episode_id", "name"], "left_anti").withColumn("name", F.col("said"))
    cols = ["episode_id", "speaker", "said", "name"]
    return exact.select(cols).unionByName(aliased.select(cols)).unionByName(unknown.select(cols))


def diarization_issues(signals: DataFrame, roster: DataFrame) -> DataFrame:
    """``episode_id, speaker, issue, names``: 'merged' clusters with several people of the roster; 'split' episodes with more clusters than people and one."""
    names = with_aliases(signals, roster).join(roster.select("episode_id", "name").distinct(), ["episode_id", "name"])
    merged = names.groupBy("episode_id", "speaker").agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) >= 2").select("episode_id", "speaker", F.lit("merged").alias("issue"), "names")
    people = roster.groupBy("episode_id").agg(F.count(F.lit(1)).alias("k"))
    clusters = signals.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    split = clusters.join(people, "episode_id").where("n > k + 1").select("episode_id", F.lit(None).cast("string").alias("speaker"), F.lit("split").alias("issue"), F.array().cast("array<string>").alias("names"))
    return merged.unionByName(split)


def resolve_speakers(signals: DataFrame, roster: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``episode_id, speaker, name, issue``: the label of each cluster (role and name), or why it has none.

    ``roster``: episode_id, ord, role, name. ``overrides`` (episode_id, speaker, label) go first. Then a cluster gets
    the one person of the roster that it calls itself; a guest has one cluster, the first, a host may have several.
    Then a cluster with host marks that doesn't call itself a guest gets the only host. Nothing is given by elimination.
    Issues: 'several' people in a cluster, 'taken' guests, 'unreliable' otherwise.
    """
    role_of = roster.groupBy("episode_id", "name").agg(F.min_by("role", "ord").alias("role"))
    own = with_aliases(signals, roster).join(role_of, ["episode_id", "name"])
    hit = own.groupBy("episode_id", "speaker").agg(F.count_distinct("name").alias("k"), F.min(F.struct("name", "role")).alias("m"))
    hosts = roster.where(F.col("role").isin(*HOSTS)).groupBy("episode_id").agg(F.count_distinct("name").alias("n_hosts"), F.min("name").alias("host"))
    guest_words = roster.where(F.col("role").isin(*GUESTS)).groupBy("episode_id").agg(F.collect_set("name").alias("guests"))
    base = signals.join(hit, ["episode_id", "speaker"], "left").join(hosts, "episode_id", "left").join(guest_words, "episode_id", "left")
    given = F.lit(None).cast("string")
    if overrides is not None:
        base = base.join(overrides.select("episode_id", "speaker", F.col("label").alias("given")), ["episode_id", "speaker"], "left")
        given = F.col("given")
        fixed = overrides.where(F.left("label", F.lit(2)).isin(*GUESTS)).select("episode_id", F.expr("substring(label, 3)").alias("gn"), F.lit("").alias("first"))
    claim = base.where((F.col("k") == 1) & F.col("m.role").isin(*GUESTS) & given.isNull()).select("episode_id", F.col("m.name").alias("gn"), F.col("speaker").alias("first"))
    firsts = (claim.unionByName(fixed) if overrides is not None else claim).groupBy("episode_id", "gn").agg(F.min("first").alias("first"))
    all_ = base.withColumn("gn", F.when(F.col("m.role").isin(*GUESTS), F.col("m.name"))).join(firsts, ["episode_id", "gn"], "left")
    taken = F.col("gn").isNotNull() & (F.col("first") != F.col("speaker")) & (F.col("k") == 1)
    named = F.when((F.col("k") == 1) & ~taken, F.concat("m.role", "m.name"))
    is_guest = F.size(F.array_intersect("self_names", F.coalesce("guests", F.array().cast("array<string>")))) > 0
    host = F.when((F.coalesce("k", F.lit(0)) < 2) & (F.col("host_marks") >= 1) & ~is_guest & (F.col("n_hosts") == 1), F.concat(F.lit("主播"), "host"))
    name = F.coalesce(given, named, host)
    return all_.select("episode_id", "speaker", name.alias("name"), F.when(given.isNotNull(), F.lit(None)).when(F.col("k") > 1, "several").when(name.isNull() & taken, "taken").when(name.isNull(), "unreliable").alias("issue"))


def apply_labels(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """``segments`` with ``speaker_label``: 【name】, [label] or ''."""
    m = mapping.where("name is not null").groupBy("episode_id", "speaker").agg(F.min(F.concat(F.lit("【"), "name", F.lit("】"))).alias("__l"))
    return segments.join(m, ["episode_id", "speaker"], "left").withColumn("speaker_label", F.coalesce("__l", F.when(F.col("speaker") != "", F.concat(F.lit("["), "speaker", F.lit("]"))), F.lit(""))).drop("__l")


def resolve_and_label(segments: DataFrame, notes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``episode_id, key, first_no, last_no, n, start_ms, end_ms, text``: segments with resolved labels, neighbours of one label within 200 ms joined.

    ``notes``: episode_id, show_notes.
    """
    from castwright.operators.islands import merge_neighbours

    roster = notes.select("episode_id", F.posexplode(roster_of(F.col("show_notes"))).alias("ord", "r")).select("episode_id", "ord", "r.role", "r.name")
    labelled = apply_labels(segments, resolve_speakers(cluster_signals(segments), roster, overrides))
    return merge_neighbours(labelled.select("episode_id", F.col("seg_no").alias("no"), F.col("speaker_label").alias("key"), "start_ms", "end_ms", "text"))


def label_text(names: Column) -> Column:
    return display_label(names)
