"""Queries on rosters, speakers, voices and recogniser output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright import adapters
from castwright.functions import numbers
from castwright.operators import aggregates, clusters, joins, speakers
from castwright.plans import backend
from castwright.registry import query
from castwright.session import table
from castwright.sources import recognised


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").groupBy("episode_id").agg(F.max_by(F.struct("show_notes"), "scraped_at").alias("n")).select("episode_id", "n.show_notes")


def _roster(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("episode_id", F.posexplode(speakers.roster_of(F.col("show_notes"))).alias("ord", "r")).select("episode_id", "ord", "r.role", "r.name")


@query("x7_roster_names")
def x7_roster_names(spark: SparkSession, d: str) -> DataFrame:
    return _roster(spark, d)


_NO = "', '".join(speakers.NO_NAMES)


@query(
    "x7_roles",
    f"""with n as (select arg_max(struct_pack(n := show_notes), scraped_at).n as t, episode_id from episodes group by episode_id), m as (select episode_id, unnest(regexp_extract_all(translate(coalesce(t, ''), '【】', ''), '{speakers.ROLE}(?:简介|人)?(?:主[播持理]|嘉宾|客座|主持)?[：:\\s\\x0b\\x{{85}}\\p{{Z}}]*[一-龥A-Za-z·]{{1,6}}')) as hit from n),
    p as (select episode_id, hit[1:2] as role, trim(regexp_replace(regexp_extract(hit, '{speakers.ROLE}(?:简介|人)?(?:主[播持理]|嘉宾|客座|主持)?[：:\\s\\x0b\\x{{85}}\\p{{Z}}]*([一-龥A-Za-z·]{{1,6}})$', 1), '(主[播持理]|嘉宾|客座|主持|与|和|及|等|携|邀请).*$', '')) as name from m)
    select distinct episode_id, role, name from p where length(name) > 1 and name not in ('{_NO}')""",
)
def x7_roles(spark: SparkSession, d: str) -> DataFrame:
    """The names that stand behind a role."""
    return _roster(spark, d).where("role <> ''").select("episode_id", "role", "name").distinct()


@query(
    "a3_signals",
    f"""with t as (select episode_id, speaker, coalesce(text, '') as text from segments where speaker is not null and speaker <> ''),
    n as (select episode_id, speaker, trim(regexp_extract(h, '([一-龥A-Za-z·]{{1,4}})[，。！？、；：\\s\\x0b\\x{{85}}\\p{{Z}}]$', 1)) as name from (select episode_id, speaker, unnest(regexp_extract_all(text, '我(?:是|叫|们是|就是)[\\s\\x0b\\x{{85}}\\p{{Z}}]*[一-龥A-Za-z·]{{1,4}}[，。！？、；：\\s\\x0b\\x{{85}}\\p{{Z}}]')) as h from t)),
    l as (select episode_id, speaker, list_sort(list(distinct name)) as names from n where length(name) >= 2 and name not in ('{_NO}') group by 1, 2),
    c as (select episode_id, speaker, cast(sum(len(regexp_extract_all(text, '{speakers.HOST_MARKS}'))) as bigint) as host_marks, count(*) as n from t group by 1, 2)
    select c.episode_id, c.speaker, coalesce(names, []) as self_names, host_marks, n from c left join l on c.episode_id = l.episode_id and c.speaker = l.speaker""",
)
def a3_signals(spark: SparkSession, d: str) -> DataFrame:
    return speakers.cluster_signals(table(spark, d, "segments"))


@query("j6_aliased_names")
def j6_aliased_names(spark: SparkSession, d: str) -> DataFrame:
    return speakers.with_aliases(speakers.cluster_signals(table(spark, d, "segments")), _roster(spark, d))


@query("a4_diarization_issues")
def a4_diarization_issues(spark: SparkSession, d: str) -> DataFrame:
    return speakers.diarization_issues(speakers.cluster_signals(table(spark, d, "segments")), _roster(spark, d))


@query("r12_resolved_speakers")
def r12_resolved_speakers(spark: SparkSession, d: str) -> DataFrame:
    return speakers.resolve_speakers(speakers.cluster_signals(table(spark, d, "segments")), _roster(spark, d))


@query("r13_labelled_turns")
def r13_labelled_turns(spark: SparkSession, d: str) -> DataFrame:
    return speakers.resolve_and_label(table(spark, d, "segments").dropDuplicates(["episode_id", "seg_no"]), _notes(spark, d))


@query(
    "j4_labels",
    "with m as (select episode_id, unnest(map_keys(speaker_mapping)) as speaker, unnest(map_values(speaker_mapping)) as name from struct_out), f as (select episode_id, speaker, min('【' || name || '】') as l from m where name is not null group by 1, 2) select s.episode_id, s.seg_no, coalesce(l, case when s.speaker <> '' then '[' || s.speaker || ']' end, '') as speaker_label from segments s left join f on s.episode_id = f.episode_id and s.speaker = f.speaker",
)
def j4_labels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "struct_out").select("episode_id", F.explode("speaker_mapping").alias("speaker", "name"))
    return speakers.apply_labels(table(spark, d, "segments").select("episode_id", "seg_no", "speaker"), m).select("episode_id", "seg_no", "speaker_label")


@query(
    "a23_effective_k",
    """with n as (select episode_id, arg_max(struct_pack(n := show_notes), scraped_at).n as t from episodes group by 1), h as (select episode_id, unnest(regexp_extract_all(coalesce(t, ''), '.?([0-9]{1,2}|[一二三四五六七八九十两]{1,3})\\s*(?:位|个人|人)')) as h from n),
    v as (select episode_id, regexp_extract(h, '([0-9]{1,2}|[一二三四五六七八九十两]{1,3})\\s*(?:位|个人|人)$', 1) as w, h from h),
    r as (select episode_id, count(distinct typed_name) as n from roster where origin = 'show_notes' and cast_role <> '机构' group by 1)
    select t.episode_id, case when r.n >= 2 then r.n end as k, coalesce(duration_sec > 720, false) as forced from (select distinct episode_id, duration_sec from transcripts) t left join r on t.episode_id = r.episode_id
    where not exists (select 1 from v where v.episode_id = t.episode_id)""",
)
def a23_effective_k(spark: SparkSession, d: str) -> DataFrame:
    """The number of people of episodes whose notes state none; x7_roster_names and a18_stated_counts have the others' parts."""
    r = table(spark, d, "roster").where("origin = 'show_notes' and cast_role <> '机构'").groupBy("episode_id").agg(F.count_distinct("typed_name").alias("n"))
    stated = _notes(spark, d).where(F.coalesce("show_notes", F.lit("")).rlike(r"(?:[0-9]{1,2}|[一二三四五六七八九十两]{1,3})\s*(?:位|个人|人)")).select("episode_id")
    t = table(spark, d, "transcripts").select("episode_id", "duration_sec").distinct().join(stated, "episode_id", "left_anti")
    return t.join(r, "episode_id", "left").select("episode_id", F.when(F.col("n") >= 2, F.col("n")).alias("k"), F.coalesce(F.col("duration_sec") > 720, F.lit(False)).alias("forced"))


@query("a23_stated_or_roster")
def a23_stated_or_roster(spark: SparkSession, d: str) -> DataFrame:
    """The larger of the roster's size and the stated number, from two on."""
    n = _notes(spark, d).select("episode_id", F.size(speakers.roster_of(F.col("show_notes"))).alias("n"), numbers.stated_count(F.col("show_notes")).alias("stated"))
    most = F.greatest("n", F.coalesce("stated", F.lit(0)))
    return n.select("episode_id", F.when(most >= 2, most).alias("k"))


@query(
    "j2_points_in_intervals",
    """with p as (select distinct episode_id, start_ms as at_ms, speaker from diar_segments where start_ms is not null),
    s as (select distinct episode_id, seg_no, start_ms, end_ms from segments where start_ms is not null and end_ms > start_ms)
    select p.episode_id, seg_no, count(*) as n_points, string_agg(coalesce(speaker, '') || '@' || at_ms, ' ' order by at_ms, coalesce(speaker, '')) as words from p join s on p.episode_id = s.episode_id and start_ms <= at_ms and at_ms < end_ms group by 1, 2, start_ms, end_ms""",
)
def j2_points_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The events that begin in each segment, put together in their order."""
    points = table(spark, d, "diar_segments").select("episode_id", F.col("start_ms").alias("at_ms"), "speaker").distinct()
    seg = table(spark, d, "segments").select("episode_id", "seg_no", "start_ms", "end_ms").distinct()
    met = joins.points_in_intervals(points, seg).select("episode_id", "seg_no", "start_ms", "end_ms", F.struct("at_ms", F.coalesce("speaker", F.lit("")).alias("w")).alias("p"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: F.concat(x["w"], F.lit("@"), x["at_ms"])), " ")
    return met.groupBy("episode_id", "seg_no", "start_ms", "end_ms").agg(F.count(F.lit(1)).alias("n_points"), words.alias("words")).drop("start_ms", "end_ms")


@query("w7_chunk_times", "select episode_id, seg_no, cast(seg_no % 7 as bigint) * 600000 + start_ms as start_ms from segments where start_ms is not null")
def w7_chunk_times(spark: SparkSession, d: str) -> DataFrame:
    """Times within a chunk as times of the recording."""
    s = table(spark, d, "segments").where("start_ms is not null")
    return s.select("episode_id", "seg_no", ((F.col("seg_no") % 7).cast("bigint") * 600_000 + F.col("start_ms")).alias("start_ms"))


@query("d8_seconds", "select episode_id, seg_no, round(end_ms / case when max(end_ms) over (partition by episode_id) >= 1000 then 1000.0 else 1.0 end, 3) as s from segments where end_ms is not null")
def d8_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, from milliseconds if an episode's times are that; the unit is joined, since an episode may be long."""
    s = table(spark, d, "segments").where("end_ms is not null")
    unit = s.groupBy("episode_id").agg(F.when(F.max("end_ms") >= 1000, 1000.0).otherwise(1.0).alias("unit"))
    return s.join(unit, "episode_id").select("episode_id", "seg_no", F.round(F.col("end_ms") / F.col("unit"), 3).alias("s"))


@query("u5_dropped", "select distinct episode_id, speaker from (select episode_id, speaker from segments where end_ms <= start_ms union select episode_id, speaker from segments where text is null or trim(text) = '')")
def u5_dropped(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments")
    return s.where("end_ms <= start_ms").select("episode_id", "speaker").union(s.where("text is null or trim(text) = ''").select("episode_id", "speaker")).distinct()


@query("a19_costs", "with t as (select distinct episode_id, cost_yuan, duration_sec, raw_text from transcripts) select count(*) as n, round(sum(coalesce(cost_yuan, 0)), 4) as yuan, bool_or(cost_yuan is null) as unknown, cast(sum(length(raw_text)) as bigint) as n_chars from t")
def a19_costs(spark: SparkSession, d: str) -> DataFrame:
    """Running totals: texts, cost, whether any cost is unknown, characters."""
    t = table(spark, d, "transcripts").select("episode_id", "cost_yuan", "duration_sec", "raw_text").distinct()
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("cost_yuan", F.lit(0.0))), 4).alias("yuan"), F.bool_or(F.col("cost_yuan").isNull()).alias("unknown"), F.sum(F.length("raw_text")).alias("n_chars"))


@query("r10_warnings", "with c as (select episode_id, coalesce(nullif(speaker, ''), 'UNKNOWN') as s, count(*) as n from segments group by 1, 2), p as (select episode_id, sum(n) as total, count(*) as k, max(n) as top from c group by 1) select episode_id, case when k = 1 and total >= 200 then 'single' else 'taken' end || '。run again' as warning from p where total >= 50 and (k = 1 and total >= 200 or k > 1 and top >= 300 and top >= 0.95 * total)")
def r10_warnings(spark: SparkSession, d: str) -> DataFrame:
    c = aggregates.collapsed_clusters(table(spark, d, "segments"))
    return c.select("episode_id", backend.collapse_warning(F.col("reasons"), "run again").alias("warning")).where("warning is not null")


# --- Voices: the clips of one episode are few, however many episodes there are ------------------------------------


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as the clips of made-up episodes of about twenty clips each."""
    return table(spark, d, "embeddings").select(F.expr("cast(vec_id div 20 as bigint)").alias("episode"), "vec_id", "label", "embedding")


_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.n * b.n)"
_VEC = "u as (select vec_id, vec_id // 20 as episode, list_transform(embedding, lambda x: cast(x as double)) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings)"


@query("a12_pairwise_percentile", f"with {_VEC} select a.episode, count(*) as n, round(quantile_cont(greatest({_COS}, 0), 0.1), 6) as p from u a join u b on a.episode = b.episode and a.vec_id < b.vec_id group by 1")
def a12_pairwise_percentile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.pairwise_percentile(_clips(spark, d), group="episode").select("episode", "n", F.round("p", 6).alias("p"))


@query("m2_cosines", f"with {_VEC} select a.episode, a.vec_id, b.vec_id as other, round({_COS}, 6) as cos from u a join u b on a.episode = b.episode and a.vec_id + 1 = b.vec_id")
def m2_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of neighbouring clips."""
    from castwright.functions.vectors import cosine

    c = _clips(spark, d)
    other = c.select("episode", F.col("vec_id").alias("other"), F.col("embedding").alias("w"), (F.col("vec_id") - 1).alias("vec_id"))
    return c.join(other, ["episode", "vec_id"]).select("episode", "vec_id", "other", F.round(cosine(F.col("embedding"), F.col("w")), 6).alias("cos"))


@query("a16_zero_shares", f"with {_VEC} select a.episode, round(avg(case when greatest({_COS}, 0) <= 1e-9 then 1.0 else 0.0 end), 6) as zeros from u a join u b on a.episode = b.episode and a.vec_id <> b.vec_id group by 1")
def a16_zero_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of similarities that are zero, which makes an alignment an error from a half on."""
    return clusters.zero_shares(_clips(spark, d), "episode").select("episode", F.round("zeros", 6).alias("zeros"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Clips of the episodes whose similarities tell something."""
    c = _clips(spark, d)
    return c.join(clusters.zero_shares(c, "episode").where("zeros <= 0.5").select("episode"), "episode", "left_semi")


@query("m3_greedy_voices")
def m3_greedy_voices(spark: SparkSession, d: str) -> DataFrame:
    return clusters.align_voices(_told(spark, d), "episode")


@query("m4_medoid_voices")
def m4_medoid_voices(spark: SparkSession, d: str) -> DataFrame:
    return clusters.align_voices(_told(spark, d), "episode", k=2)


@query("e3_recognised")
def e3_recognised(spark: SparkSession, d: str) -> DataFrame:
    """Raw payloads of chunks of about fifty sentences as segments."""
    s = table(spark, d, "segments").where("start_ms is not null and end_ms is not null and seg_no is not null").dropDuplicates(["episode_id", "seg_no"])
    sentence = F.struct(F.col("start_ms").cast("double").alias("start"), F.col("end_ms").cast("double").alias("end"), "text", F.regexp_extract(F.coalesce("speaker", F.lit("")), r"(\d+)$", 1).try_cast("int").alias("spk"))
    raw = s.groupBy("episode_id", F.expr("cast(seg_no div 50 as int)").alias("chunk_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", sentence.alias("x")))), lambda p: p["x"]).alias("sentences"))
    return recognised.recognised_segments(raw.select("episode_id", "chunk_idx", "sentences", F.array().cast("array<string>").alias("words"), F.array().cast("array<struct<s:double,e:double>>").alias("ts")), 0)


@query("e13_cleaned")
def e13_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts through a stand-in for a cleaning model that loses its third chunks."""
    t = table(spark, d, "transcripts").groupBy("episode_id").agg(F.min("raw_text").alias("raw_text"))
    return adapters.clean_transcripts(t, adapters.fake_cleaner({"嗯": "", "um ": ""}, (2,)), 2000)


@query("m7_sweeps")
def m7_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette and least share of each episode's clips for each K."""
    return clusters.sweep(_clips(spark, d), "episode").select("episode", "k", F.round("silhouette", 6).alias("silhouette"), F.round("min_share", 6).alias("min_share"))


@query(
    "a15_usable_clips",
    f"with {_VEC}, c as (select a.episode, a.vec_id, avg({_COS}) as m from u a join u b on a.episode = b.episode and a.vec_id <> b.vec_id group by 1, 2), t as (select episode, max(m) as top from c group by 1) select c.episode, vec_id, round(m, 6) as m from c join t on c.episode = t.episode where m >= 0.5 * top",
)
def a15_usable_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose mean similarity is at least half of the best of their episode."""
    c = aggregates.mean_similarity(_clips(spark, d).drop("label").withColumnRenamed("episode", "label")).withColumnRenamed("label", "episode")
    top = c.groupBy("episode").agg(F.max("centrality").alias("top"))
    return c.join(top, "episode").where("centrality >= 0.5 * top").select("episode", "vec_id", F.round("centrality", 6).alias("m"))


@query("t9_refreshed_speakers", "with s as (select distinct episode_id, seg_no from segments where episode_id is not null and seg_no is not null) select episode_id, count(*) as n from s group by 1")
def t9_refreshed_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Stored segments get the speakers of a new diarization; every segment keeps a place."""
    return joins.overlap_speaker(table(spark, d, "segments"), table(spark, d, "diar_segments")).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


@query("j14_package_maps", "with m as (select episode_id, min(run_no) as r from struct_out where speaker_mapping is not null group by 1), n as (select distinct s.episode_id, cardinality(speaker_mapping) as n from struct_out s join m on s.episode_id = m.episode_id and s.run_no = m.r) select t.episode_id, cast(coalesce(n, 0) as bigint) as n from (select distinct episode_id from transcripts) t left join n on t.episode_id = n.episode_id")
def j14_package_maps(spark: SparkSession, d: str) -> DataFrame:
    """Packages with the mapping of their name, an empty one if there is none."""
    m = table(spark, d, "struct_out").where("speaker_mapping is not null").groupBy("episode_id").agg(F.min_by("speaker_mapping", "run_no").alias("m"))
    t = table(spark, d, "transcripts").select("episode_id").distinct().join(m, "episode_id", "left")
    return t.select("episode_id", F.size(F.coalesce("m", F.create_map().cast("map<string,string>"))).cast("bigint").alias("n"))
