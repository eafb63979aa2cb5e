"""Queries of the core: callables over a folder of tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright import oracles
from castwright.functions import numbers, text
from castwright.operators import aggregates, chunks, islands, joins
from castwright.operators.intervals import merge_intervals
from castwright.plans import cache, documents
from castwright.registry import QUERIES, SQL, query  # noqa: F401
from castwright.session import table
from castwright.sources import pages

_PERIODS_SQL = """
with s as (select episode_id, start_ms, end_ms from segments where start_ms is not null and end_ms is not null and end_ms > start_ms),
m as (select *, max(end_ms) over (partition by episode_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as high from s),
i as (select *, sum(case when start_ms <= high then 0 else 1 end) over (partition by episode_id order by start_ms, end_ms rows unbounded preceding) as island from m),
p as (select episode_id, min(start_ms) as from_ms, max(end_ms) as to_ms from i group by episode_id, island),
g as (select episode_id, lag(to_ms) over (partition by episode_id order by from_ms) as from_ms, from_ms as to_ms from p)
select episode_id, 'period' as kind, from_ms, to_ms from p
union all select episode_id, 'gap', from_ms, to_ms from g where from_ms is not null and to_ms - from_ms < 1800000
"""


@query("p4_found", _PERIODS_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(table(spark, d, "segments"))


# --- Joins -------------------------------------------------------------------------------------------------------


@query(
    "j1_overlap_speaker",
    """
    with s as (select episode_id, seg_no, min(struct_pack(a := start_ms, b := end_ms)) as t from segments group by 1, 2),
    g as (select episode_id, seg_no, t.a as s, t.b as e from s),
    d as (select distinct episode_id, coalesce(speaker, 'UNKNOWN') as speaker, start_ms, end_ms from diar_segments where start_ms is not null and end_ms > start_ms),
    m as (select g.episode_id, seg_no, speaker, least(e, end_ms) - greatest(s, start_ms) as o, start_ms, end_ms
          from g join d on g.episode_id = d.episode_id and s < end_ms and start_ms < e where e > s),
    r as (select *, row_number() over (partition by episode_id, seg_no order by o desc, start_ms, end_ms, speaker) as rn from m)
    select g.episode_id, g.seg_no, coalesce(r.speaker, 'UNKNOWN') as speaker, coalesce(r.o, 0) as overlap_ms
    from g left join r on g.episode_id = r.episode_id and g.seg_no = r.seg_no and rn = 1
    """,
)
def j1_overlap_speaker(spark: SparkSession, d: str) -> DataFrame:
    return joins.overlap_speaker(table(spark, d, "segments"), table(spark, d, "diar_segments"))


@query(
    "j3_lookup_with_fallback",
    """
    with m as (select episode_id, map_keys(speaker_mapping) as k, map_values(speaker_mapping) as v, run_no from struct_out),
    e as (select episode_id, unnest(k) as speaker, unnest(v) as name, run_no from m),
    f as (select episode_id, speaker, arg_min(name, run_no) as name from (select distinct * from e) group by 1, 2)
    select s.episode_id, s.seg_no, coalesce(f.name, s.speaker, '') as shown from (select distinct episode_id, seg_no, speaker from segments) s left join f on s.episode_id = f.episode_id and s.speaker = f.speaker
    """,
)
def j3_lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "struct_out").select("episode_id", "run_no", F.explode("speaker_mapping").alias("speaker", "name")).distinct().groupBy("episode_id", "speaker").agg(F.min_by("name", "run_no").alias("name"))
    seg = table(spark, d, "segments").select("episode_id", "seg_no", "speaker").distinct()
    return seg.join(names, ["episode_id", "speaker"], "left").select("episode_id", "seg_no", F.coalesce("name", "speaker", F.lit("")).alias("shown"))


@query(
    "j15_pending_episodes",
    "select distinct e.episode_id, url from episodes e where not exists (select 1 from output_docs o where o.episode_id = e.episode_id)",
)
def j15_pending_episodes(spark: SparkSession, d: str) -> DataFrame:
    return cache.pending(table(spark, d, "episodes").select("episode_id", "url").distinct(), table(spark, d, "output_docs"), "episode_id")


@query(
    "j13_packages_and_documents",
    """
    select t.episode_id, o.episode_id is not null as has_document, s.episode_id is not null as has_run
    from (select distinct episode_id from transcripts) t left join (select distinct episode_id from output_docs) o on t.episode_id = o.episode_id
    left join (select distinct episode_id from struct_out) s on t.episode_id = s.episode_id
    """,
)
def j13_packages_and_documents(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: table(spark, d, t).select("episode_id").distinct().withColumn(c, F.lit(True))
    return ids("transcripts", "x").join(ids("output_docs", "o"), "episode_id", "left").join(ids("struct_out", "s"), "episode_id", "left").select("episode_id", F.coalesce("o", F.lit(False)).alias("has_document"), F.coalesce("s", F.lit(False)).alias("has_run"))


@query(
    "u4_unnamed_speakers",
    """
    select distinct episode_id, speaker from segments where speaker is not null
    except select episode_id, k as speaker from (select episode_id, unnest(map_keys(speaker_mapping)) as k from struct_out)
    """,
)
def u4_unnamed_speakers(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "struct_out").select("episode_id", F.explode(F.map_keys("speaker_mapping")).alias("speaker"))
    return table(spark, d, "segments").where("speaker is not null").select("episode_id", "speaker").distinct().subtract(named)


# --- Aggregates --------------------------------------------------------------------------------------------------


@query("a1_speaker_counts", "select episode_id, coalesce(nullif(speaker, ''), 'UNKNOWN') as speaker, count(*) as n from segments group by 1, 2")
def a1_speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.speaker_counts(table(spark, d, "segments"))


@query(
    "a2_collapsed_clusters",
    """
    with c as (select episode_id, coalesce(nullif(speaker, ''), 'UNKNOWN') as speaker, count(*) as n from segments group by 1, 2),
    p as (select episode_id, cast(sum(n) as bigint) as total, count(*) as n_clusters, min(struct_pack(m := -n, s := speaker)) as t from c group by 1)
    select episode_id, total, n_clusters, t.s as top, -t.m as top_n,
      case when total >= 50 then list_filter([case when n_clusters = 1 and total >= 200 then 'single' end, case when n_clusters > 1 and -t.m >= 300 and -t.m >= 0.95 * total then 'taken' end, case when n_clusters + 1 < 3 then 'fewer' end], lambda x: x is not null) else [] end as reasons
    from p
    """,
)
def a2_collapsed_clusters(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.collapsed_clusters(table(spark, d, "segments"), F.lit(3))


@query(
    "a5_speaker_preview",
    """
    select episode_id, coalesce(speaker, 'UNKNOWN') as speaker, count(*) as n, cast(sum(length(trim(coalesce(text, '')))) as bigint) as n_chars,
      arg_min(trim(text), seg_no) filter (where trim(coalesce(text, '')) <> '') as first_text
    from (select distinct episode_id, seg_no, speaker, text from segments) group by 1, 2
    """,
)
def a5_speaker_preview(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.speaker_preview(table(spark, d, "segments").select("episode_id", "seg_no", "speaker", "text").distinct())


@query(
    "a6_representative_clips",
    """
    with t as (select distinct episode_id, speaker, seg_no, end_ms - start_ms as ms from segments where speaker is not null and end_ms > start_ms),
    f as (select episode_id, speaker, arg_min(ms, seg_no) as first_ms, bool_or(ms between 3000 and 30000) as fit from t group by 1, 2),
    r as (select t.*, row_number() over (partition by t.episode_id, t.speaker order by case when ms between 3000 and 30000 then 0 when (ms < 3000) = (first_ms < 3000) then 1 else 2 end,
                 case when ms > 30000 then ms else -ms end, seg_no) as rn from t join f on t.episode_id = f.episode_id and t.speaker = f.speaker)
    select episode_id, speaker, seg_no, ms from r where rn = 1
    """,
)
def a6_representative_clips(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.representative_clips(table(spark, d, "segments"))


_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.n * b.n)"
_VEC_SQL = "u as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings)"


@query(
    "a13_silhouette",
    f"""with {_VEC_SQL}, m as (select a.vec_id, a.label as own, b.label as lab, avg(1 - {_COS}) as dist from u a join u b on a.vec_id <> b.vec_id group by 1, 2, 3),
    s as (select vec_id, max(case when own = lab then dist end) as a, min(case when own <> lab then dist end) as b from m group by 1)
    select count(*) as n, round(avg(case when greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s where a is not null and b is not null""",
)
def a13_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.silhouette(table(spark, d, "embeddings")).select("n", F.round("silhouette", 6).alias("silhouette"))


@query("a15_centrality", f"with {_VEC_SQL} select a.vec_id, any_value(a.label) as label, round(avg({_COS}), 6) as centrality from u a join u b on a.label = b.label and a.vec_id <> b.vec_id group by 1")
def a15_centrality(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.mean_similarity(table(spark, d, "embeddings")).select("vec_id", "label", F.round("centrality", 6).alias("centrality"))


# --- Ordered sequences -------------------------------------------------------------------------------------------

_ONCE = "o as (select distinct episode_id, seg_no, coalesce(speaker, '') as key, coalesce(start_ms, 0) as start_ms, coalesce(end_ms, 0) as end_ms, coalesce(text, '') as text from segments)"


def _islands_sql(gap: str) -> str:
    return f"""with {_ONCE}, l as (select *, lag(key) over w as k0, lag(end_ms) over w as e0 from o window w as (partition by episode_id order by seg_no)),
    i as (select *, sum(case when key = k0{gap} then 0 else 1 end) over (partition by episode_id order by seg_no) as island from l)
    select episode_id, min(key) as key, cast(min(seg_no) as bigint) as first_no, cast(max(seg_no) as bigint) as last_no, count(*) as n, arg_min(start_ms, seg_no) as start_ms, arg_max(end_ms, seg_no) as end_ms,
      coalesce(string_agg(text, '{{}}' order by seg_no) filter (where text <> ''), '') as text from i group by episode_id, island"""


def _for_islands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("episode_id", F.col("seg_no").alias("no"), F.col("speaker").alias("key"), "start_ms", "end_ms", "text").distinct()


@query("w1_merge_within_gap", _islands_sql(" and start_ms - e0 <= 200").replace("{}", " "))
def w1_merge_within_gap(spark: SparkSession, d: str) -> DataFrame:
    return islands.merge_neighbours(_for_islands(spark, d))


@query("w4_merge_labels", _islands_sql("").replace("{}", ""))
def w4_merge_labels(spark: SparkSession, d: str) -> DataFrame:
    return islands.merge_neighbours(_for_islands(spark, d), gap_ms=None, separator="")


@query(
    "a8_longest_run",
    f"""with r as ({_islands_sql("").replace("{}", "")}) select episode_id, key, max(n) as longest, count(*) as n_runs from r group by 1, 2""",
)
def a8_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return islands.merge_neighbours(_for_islands(spark, d), gap_ms=None, separator="").groupBy("episode_id", "key").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_runs"))


@query("w9_packed_lines")
def w9_packed_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", F.posexplode(chunks.pack_lines(F.col("raw_text"))).alias("chunk_no", "text"))


@query("w8_chunk_context")
def w8_chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_context(w9_packed_lines(spark, d).distinct().withColumnRenamed("episode_id", "doc"))


@query("w10_folded_sentences")
def w10_folded_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Turns as labelled lines of at most 1500 characters."""
    turns = islands.merge_neighbours(_for_islands(spark, d), gap_ms=None, separator="")
    return turns.select("episode_id", "first_no", F.posexplode(chunks.tagged_lines(F.col("key"), F.col("text"))).alias("line_no", "line"))


@query(
    "w14_uniform_sample",
    """
    with o as (select distinct podcast_name, episode_id from episodes), n as (select *, row_number() over (partition by podcast_name order by episode_id) - 1 as i, count(*) over (partition by podcast_name) as n from o),
    k as (select *, greatest(1, cast(floor(n * 0.25) as bigint)) as k from n)
    select podcast_name, episode_id from k where list_contains(list_transform(range(0, k), lambda j: j * n // k), i)
    """,
)
def w14_uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return chunks.uniform_sample(table(spark, d, "episodes").select("podcast_name", "episode_id").distinct(), "podcast_name", "episode_id", 0.25)


# --- Text rules --------------------------------------------------------------------------------------------------

_HAN, _FULL = "一-鿿", "，。！？、；："


@query("n0_quotes", """select episode_id, regexp_replace(translate(full_text, '“”', '""'), '"([^"]*)"', '「\\1」', 'g') as t from output_docs""")
def n0_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", text.quotes_to_corners(F.col("full_text")).alias("t"))


@query("n6_merge_repeats")
def n6_merge_repeats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", text.merge_repeats(F.col("raw_text")).alias("t"))


@query("n9_end_turns", "select episode_id, regexp_replace(full_text, '(?m)^(【[^】\\n]*】.*)[，,]([ \\t\\r\\f\\v]*)$', '\\1。\\2', 'g') as t from output_docs")
def n9_end_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", text.end_turns(F.col("full_text")).alias("t"))


@query("n12_count_marks")
def n12_count_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", text.count_marks(F.col("raw_text")).alias("n"))


@query("n16_strip_tags", "select episode_id, seg_no, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>|〈[^〉]*〉', '', 'g'), '\\s+', ' ', 'g')) as t from segments")
def n16_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("episode_id", "seg_no", text.strip_tags(F.col("text")).alias("t"))


_LABEL_SQL = "trim(split_part(regexp_replace(regexp_replace(trim(coalesce(typed_name, '')), '^(主持人|主理人|主播|主持|主理|嘉宾|客座)[：:\\s]*', ''), '[（(][^（）()]*[）)]', '', 'g'), '·', 1))"


@query("n19_display_labels", f"select episode_id, origin, ord, case when {_LABEL_SQL} = '' then '' else '【' || {_LABEL_SQL} || '】' end as label from roster")
def n19_display_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("episode_id", "origin", "ord", text.display_label(F.col("typed_name")).alias("label"))


_SAFE = "regexp_replace(trim(translate({c}, '\\/:*?\"<>|', '_________')), '\\.+$', '')"


@query(
    "n20_stems",
    f"""with s as (select episode_id, left({_SAFE.format(c="podcast_name")}, 40) as p, left({_SAFE.format(c="title")}, 100) as t from episodes)
    select episode_id, case when coalesce(p, '') = '' and coalesce(t, '') = '' then 'podcast' else left(concat_ws('-', nullif(p, ''), nullif(t, '')), 160) end as stem from s""",
)
def n20_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select("episode_id", text.episode_stem(F.col("podcast_name"), F.col("title")).alias("stem"))


@query("n_bare_text", "select episode_id, length(regexp_replace(full_text, '【[^】]*】|\\[SPEAKER_\\d+\\]|[\\s\\p{Z}]+', '', 'g')) as n from output_docs")
def n_bare_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", F.length(text.strip_labels(F.col("full_text"))).alias("n"))


_CLOCK = "cast(round_even(end_ms / 1000.0, 0) as bigint)"


@query("d6_minutes", "select distinct episode_id, cast(floor(trunc(duration_sec) / 60) as bigint) || '分' || cast(trunc(duration_sec) as bigint) % 60 || '秒' as t from transcripts")
def d6_minutes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", numbers.minutes_seconds(F.col("duration_sec")).alias("t")).distinct()


@query(
    "d4_publication_day",
    """select distinct episode_id, pub_date, case when regexp_matches(pub_date, '^\\d{4}-\\d{2}-\\d{2}T[\\d:.]+(Z|[+-]\\d{2}:?\\d{2})$') then strftime(cast(pub_date as timestamptz) at time zone 'Asia/Shanghai', '%Y-%m-%d')
    when regexp_matches(pub_date, '^\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2}') then regexp_extract(pub_date, '^(\\d{4})', 1) || '-' || lpad(regexp_extract(pub_date, '^\\d{4}[-/.年](\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(pub_date, '^\\d{4}[-/.年]\\d{1,2}[-/.月](\\d{1,2})', 1), 2, '0')
    else left(pub_date, 10) end as day from episodes""",
)
def d4_publication_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select("episode_id", "pub_date", numbers.publication_day(F.col("pub_date")).alias("day")).distinct()


@query("d7_start_seconds", oracles.MARKS)
def d7_start_seconds(spark: SparkSession, d: str) -> DataFrame:
    marks = F.explode(F.regexp_extract_all("show_notes", F.lit(r"(?m)^(\d{1,3}:\d{2}(?::\d{2})?)\s"), F.lit(1))).alias("mark")
    return table(spark, d, "episodes").select("episode_id", marks).select("episode_id", "mark", numbers.start_seconds(F.col("mark")).alias("seconds"))


# --- Sources -----------------------------------------------------------------------------------------------------


@query(
    "s3_page_fields",
    """select distinct episode_id, nullif(regexp_extract(url, '/episode/([0-9a-zA-Z]+)', 1), '') as page_id, coalesce(regexp_matches(audio_url, '(?i)\\.(mp3|m4a|wav|ogg)'), false) as is_audio,
    case when regexp_extract(split_part(split_part(coalesce(audio_url, ''), '?', 1), '#', 1), '(?i)(\\.(mp3|m4a|wav|ogg|aac|flac))$', 1) = '' then '.mp3' else lower(regexp_extract(split_part(split_part(coalesce(audio_url, ''), '?', 1), '#', 1), '(?i)(\\.(mp3|m4a|wav|ogg|aac|flac))$', 1)) end as extension from episodes""",
)
def s3_page_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes")
    return e.select("episode_id", pages.episode_id_of(F.col("url")).alias("page_id"), pages.looks_like_audio(F.col("audio_url")).alias("is_audio"), pages.audio_extension(F.col("audio_url")).alias("extension")).distinct()


# --- Documents ---------------------------------------------------------------------------------------------------


@query(
    "x1_tidy_payloads",
    """select episode_id, run_no, list_filter(list_transform(coalesce(keywords, []), lambda k: {'keyword': trim(coalesce(k.keyword, '')), 'descr': trim(coalesce(k.descr, ''))}), lambda k: k.keyword <> '')[:10] as keywords,
    list_filter(list_transform(coalesce(questions, []), lambda q: {'question': trim(coalesce(q.question, '')), 'answer': trim(coalesce(q.answer, '')), 'anchor': trim(coalesce(q.anchor, ''))}), lambda q: q.question <> '')[:5] as questions,
    trim(coalesce(summary, '')) as summary from struct_out""",
)
def x1_tidy_payloads(spark: SparkSession, d: str) -> DataFrame:
    return documents.tidy_payload(table(spark, d, "struct_out")).drop("speaker_mapping")


@query("k2_packages", oracles.PACKAGES)
def k2_packages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").groupBy("episode_id").agg(F.max_by(F.struct("title", "podcast_name", "pub_date", "show_notes"), "scraped_at").alias("e")).select("episode_id", "e.*")
    t = table(spark, d, "transcripts").select("episode_id", "raw_text").distinct()
    source = F.concat_ws(" | ", "podcast_name", "title", "pub_date")
    return e.join(t, "episode_id").select("episode_id", pages.package_text(F.coalesce("title", F.lit("")), source, F.col("show_notes"), F.coalesce("raw_text", F.lit(""))).alias("text"))


@query("s15_packages_read")
def s15_packages_read(spark: SparkSession, d: str) -> DataFrame:
    return pages.parse_packages(k2_packages(spark, d), "episode_id").select("episode_id", "title", F.length("notes").alias("n_notes"), F.length("transcript").alias("n_transcript"))


# --- Caches ------------------------------------------------------------------------------------------------------


@query("x8_episode_keys", "select distinct episode_id, left(sha256(trim(coalesce(url, '') || '|' || coalesce(pub_date, '') || '|final', '|')), 16) as key from episodes")
def x8_episode_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select("episode_id", cache.episode_key(F.col("url"), F.col("pub_date"), F.lit("final")).alias("key")).distinct()


@query("t3_fingerprints", "select distinct episode_id, sha256(case when raw_text is null then '~' else length(raw_text) || ':' || raw_text end || '|' || case when layout is null then '~' else length(layout) || ':' || layout end) as fp from transcripts")
def t3_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", cache.fingerprint(F.col("raw_text"), F.col("layout")).alias("fp")).distinct()


# --- Further ones ------------------------------------------------------------------------------------------------


@query("a14_shares", "with c as (select label, count(*) as n from embeddings group by 1), t as (select sum(n) as t from c) select label, n, round(n / t, 4) as share, round((select min(n) from c) / t, 4) as min_share from c, t")
def a14_shares(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = c.agg(F.sum("n").alias("t"), F.min("n").alias("m")).withColumn("one", F.lit(1))
    return c.withColumn("one", F.lit(1)).join(whole, "one").select("label", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"), F.round(F.col("m") / F.col("t"), 4).alias("min_share"))


@query("a17_time_units", "select episode_id, case when max(end_ms) >= 1000 then 'ms' else 's' end as unit, max(end_ms) as latest from segments group by 1")
def a17_time_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").groupBy("episode_id").agg(F.when(F.max("end_ms") >= 1000, "ms").otherwise("s").alias("unit"), F.max("end_ms").alias("latest"))


@query("a18_stated_counts")
def a18_stated_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select("episode_id", numbers.stated_count(F.col("show_notes")).alias("stated"))


@query(
    "a20_batch_status",
    "select case when o.episode_id is not null then 'done' when s.episode_id is not null then 'pending' else 'untouched' end as status, count(*) as n from (select distinct episode_id from episodes) e left join (select distinct episode_id from output_docs) o on e.episode_id = o.episode_id left join (select distinct episode_id from struct_out) s on e.episode_id = s.episode_id group by 1",
)
def a20_batch_status(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: table(spark, d, t).select("episode_id").distinct().withColumn(c, F.lit(True))
    e = ids("episodes", "e").join(ids("output_docs", "o"), "episode_id", "left").join(ids("struct_out", "s"), "episode_id", "left")
    return e.groupBy(F.when(F.col("o"), "done").when(F.col("s"), "pending").otherwise("untouched").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LABEL_OF = lambda x: f"'【' || trim(split_part(regexp_replace(regexp_replace(trim(coalesce({x}, '')), '^(主持人|主理人|主播|主持|主理|嘉宾|客座)[：:\\s]*', ''), '[（(][^（）()]*[）)]', '', 'g'), '·', 1)) || '】'"


def _replaced(x: str, n: int = 8) -> str:
    for i in range(n):
        k = f"SPEAKER_{i:02d}"
        x = f"case when map_contains(m, '{k}') then replace({x}, '[{k}]', {_LABEL_OF(f'''m['{k}']''')}) else {x} end"
    return x


@query(
    "j5_substituted_labels",
    f"with s as (select episode_id, arg_min(speaker_mapping, run_no) as m from struct_out where speaker_mapping is not null group by 1), t as (select distinct episode_id, raw_text from transcripts), x as (select t.episode_id, raw_text, m from t join s on t.episode_id = s.episode_id) select episode_id, {_replaced('raw_text', 4)} as t from x",
)
def j5_substituted_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "struct_out").where("speaker_mapping is not null").groupBy("episode_id").agg(F.min_by("speaker_mapping", "run_no").alias("m"))
    t = table(spark, d, "transcripts").select("episode_id", "raw_text").distinct()
    return t.join(s, "episode_id").select("episode_id", documents.substitute_labels(F.col("raw_text"), F.col("m")).alias("t"))


@query("j20_changed_lines")
def j20_changed_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "output_docs").select("episode_id", F.split("full_text", "\n").alias("a"), F.split(text.clean_marks(F.col("full_text")), "\n").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    return o.select("episode_id", F.aggregate(F.zip_with(F.slice("a", F.lit(1), n), F.slice("b", F.lit(1), n), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x).alias("changed"))


@query(
    "v23_turn_shares",
    f"""with r as ({_islands_sql("").replace("{}", "")}), p as (select episode_id, sum(k) as total, max(k) as top from (select episode_id, key, count(*) as k from r group by 1, 2) group by 1)
    select episode_id, 'V23' as "check", top as n_hits from p where total >= 4 and top > 0.85 * total union all select episode_id, 'V24', count(*) from r where n >= 3 group by 1""",
)
def v23_turn_shares(spark: SparkSession, d: str) -> DataFrame:
    return documents.turn_checks(islands.merge_neighbours(_for_islands(spark, d), gap_ms=None, separator=""))


@query("u3_names_in_both", "select episode_id, typed_name from roster where origin = 'show_notes' intersect select episode_id, typed_name from roster where origin = 'speaker_intro'")
def u3_names_in_both(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "roster")
    return r.where("origin = 'show_notes'").select("episode_id", "typed_name").intersect(r.where("origin = 'speaker_intro'").select("episode_id", "typed_name"))


@query("u6_all_intervals", "select episode_id, seg_no as no, start_ms, end_ms, 'asr' as source from segments union all select episode_id, dseg_no, start_ms, end_ms, 'diarizer' from diar_segments")
def u6_all_intervals(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, c, s: table(spark, d, t).select("episode_id", F.col(c).alias("no"), "start_ms", "end_ms", F.lit(s).alias("source"))
    return part("segments", "seg_no", "asr").unionByName(part("diar_segments", "dseg_no", "diarizer"))


@query("u7_sorted_labels", "select episode_id, list_sort(list_distinct(regexp_extract_all(raw_text, '\\[SPEAKER_\\d+\\]'))) as labels from transcripts where raw_text is not null")
def u7_sorted_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").where("raw_text is not null").select("episode_id", F.array_sort(F.array_distinct(F.regexp_extract_all("raw_text", F.lit(r"(\[SPEAKER_\d+\])"), F.lit(1)))).alias("labels"))


@query("k9_quality", "select case when n = 0 then 'final' else 'degraded' end as quality, count(*) as n_docs from (select len(coalesce(warnings, [])) as n from output_docs) group by 1")
def k9_quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.coalesce("warnings", F.array().cast("array<string>")))
    return table(spark, d, "output_docs").groupBy(F.when(n == 0, "final").otherwise("degraded").alias("quality")).agg(F.count(F.lit(1)).alias("n_docs"))


from castwright import document_queries, speaker_queries  # noqa: E402, F401
