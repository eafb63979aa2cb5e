"""Queries on finished documents: rendering, checks, anchors, glossary, rewriting, payloads, caches and continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright import oracles
from castwright.functions import anchors, numbers, text
from castwright.plans import backend, cache, checks, continuation, documents, glossary, handoff, render
from castwright.registry import query
from castwright.session import table
from castwright.sources import pages

STRIP, WS, NO = oracles.strip, oracles.WS, oracles.no


def finished(spark: SparkSession, d: str) -> DataFrame:
    """Finished documents with the show notes of their last scrape and the questions and mapping of their first run."""
    notes = table(spark, d, "episodes").groupBy("episode_id").agg(F.max_by(F.struct("show_notes"), "scraped_at").alias("n")).select("episode_id", "n.show_notes")
    runs = table(spark, d, "struct_out").groupBy("episode_id").agg(F.min_by(F.struct("questions", "speaker_mapping"), "run_no").alias("r")).select("episode_id", "r.*")
    return table(spark, d, "output_docs").join(notes, "episode_id", "left").join(runs, "episode_id", "left")


# --- Rendering ---------------------------------------------------------------------------------------------------


@query("k1_markdown", oracles.MARKDOWN)
def k1_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, without the bold anchors that SQL can't place (k1_documents has them)."""
    return render.render_markdown(finished(spark, d), marked=False)


@query("k1_documents")
def k1_documents(spark: SparkSession, d: str) -> DataFrame:
    return render.render_markdown(finished(spark, d))


@query("w5_merged_blocks", oracles.MERGED)
def w5_merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", render.merge_blocks(F.col("full_text")).alias("t"))


@query("r1_key_points", f"select episode_id, {oracles.POINTS} as lines from output_docs")
def r1_key_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", render.key_point_lines(F.col("key_points")).alias("lines"))


@query("r3_questions", f"select episode_id, run_no, {oracles.ASKED} as lines from struct_out")
def r3_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "struct_out").select("episode_id", "run_no", render.question_lines(F.col("questions")).alias("lines"))


_TIMED = "map {'transcribe': cast(length(full_text) as double), 'process': 61.5}"


@query("r5_footers", f"select episode_id, '耗时 转写 ' || (cast(length(full_text) as bigint) // 60) || '分' || (length(full_text) % 60) || '秒 / 校订 1分1秒' || coalesce('；' || {oracles.FOOT}, '') as foot from output_docs where full_text is not null")
def r5_footers(spark: SparkSession, d: str) -> DataFrame:
    times = F.create_map(F.lit("process"), F.lit(61.5), F.lit("transcribe"), F.length("full_text").cast("double"))
    return table(spark, d, "output_docs").where("full_text is not null").select("episode_id", render.footer(F.col("costs"), times).alias("foot"))


@query("r6_replaced_transcripts", f"with m as ({oracles.MARKDOWN}) select episode_id, {STRIP(f'''split_part(md, {oracles.NL} || '## 原文转录' || {oracles.NL}, 1)''')} as head, true as ends from m")
def r6_replaced_transcripts(spark: SparkSession, d: str) -> DataFrame:
    new = k1_markdown(spark, d).select("episode_id", render.replace_transcript(F.col("md"), F.lit("【甲】新。")).alias("md"))
    return new.select("episode_id", F.split("md", "\n\n## 原文转录\n\n")[0].alias("head"), F.endswith("md", F.lit("## 原文转录\n\n【甲】新。\n")).alias("ends"))


# --- Sections and checks -----------------------------------------------------------------------------------------


@query("sections", oracles.SECTIONS)
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    return documents.section_map(documents.sections(k1_markdown(spark, d)))


@query("bullets", oracles.BULLETS)
def bullet_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.bullets(documents.sections(k1_markdown(spark, d)))


@query("v_checks", oracles.CHECKS)
def v_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks that SQL can express."""
    return checks.check_documents(k1_markdown(spark, d), only=oracles.PLAIN_CHECKS)


@query("v_all_checks")
def v_all_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check, on whole documents with their packages."""
    packages = table(spark, d, "transcripts").groupBy("episode_id").agg(F.min("raw_text").alias("package"))
    return checks.check_documents(k1_documents(spark, d).join(packages, "episode_id", "left"), source="package")


_BLANK = "trim(coalesce({c}, '')) = ''"


@query(
    "v_gate",
    f"""with {oracles.FINISHED} select episode_id, list_filter([case when {_BLANK.format(c='title')} then 'title' end, case when {_BLANK.format(c='podcast_name')} then 'podcast' end, case when {_BLANK.format(c='pub_date')} then 'date' end,
    case when {_BLANK.format(c='full_text')} then 'full_text' end, case when {_BLANK.format(c='summary')} then 'summary' end, case when len(coalesce(key_points, [])) = 0 then 'key_points' end,
    case when len(list_filter(coalesce(key_points, []), lambda p: trim(coalesce(p.point, '')) = '')) > 0 then 'blank_point' end, case when len(coalesce(questions, [])) = 0 then 'questions' end,
    case when len(list_filter(coalesce(questions, []), lambda q: trim(coalesce(q.question, '')) = '')) > 0 then 'blank_question' end, case when regexp_matches(coalesce(full_text, ''), '\\[SPEAKER_\\d+\\]') then 'labels' end], lambda x: x is not null) as blocking from fin""",
)
def v_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents.gate(finished(spark, d))


@query("k_stripped_sections", f"with m as ({oracles.MARKDOWN}) select episode_id, md as t from m")
def k_stripped_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an outline and a mind map added are what they were when both are stripped."""
    spoiled = F.concat(F.split("md", "(?m)^(?=## 问题与思考)")[0], F.lit("## 大纲\n\n- 一\n\n## 问题与思考"), F.expr("substring(md, instr(md, '## 问题与思考') + length('## 问题与思考'))"), F.lit("```mermaid\nmindmap\n```\n"))
    return k1_markdown(spark, d).select("episode_id", checks.without_unwanted(spoiled).alias("t"))


_SPEECH = "regexp_replace({x}, '【[^】]*】|\\[SPEAKER_\\d+\\]|[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '', 'g')"
_PACKAGE = "case when regexp_matches(raw_text, '\\[SPEAKER_\\d+\\]') then regexp_extract(raw_text, '(?s)(\\[SPEAKER_\\d+\\].*)$', 1) else raw_text end"


@query(
    "a9_retention",
    f"""with o as (select distinct episode_id, length({_SPEECH.format(x="coalesce(full_text, '')")}) as n from output_docs), t as (select distinct episode_id, length({_SPEECH.format(x=f"coalesce({_PACKAGE}, '')")}) as n from transcripts)
    select o.episode_id, round(o.n / greatest(t.n, 1), 6) as kept from o join t on o.episode_id = t.episode_id""",
)
def a9_retention(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "output_docs").select("episode_id", "full_text").distinct()
    t = table(spark, d, "transcripts").select("episode_id", "raw_text").distinct()
    return o.join(t, "episode_id").select("episode_id", F.round(checks.retention(F.coalesce("full_text", F.lit("")), F.coalesce("raw_text", F.lit(""))), 6).alias("kept")).distinct()


# --- Glossary and anchors ----------------------------------------------------------------------------------------


@query("g3_terms", oracles.TERMS)
def g3_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.glossary_terms(k1_markdown(spark, d)).distinct()


@query("g4_inlined_terms")
def g4_inlined_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.inline_glossary(k1_markdown(spark, d))


@query("g5_placed_glossary", f"with m as ({oracles.MARKDOWN}) select episode_id, regexp_replace(md, '\\n{{3,}}', {oracles.NL} || {oracles.NL}, 'g') as t from m where contains(md, {oracles.NL} || '## 术语表' || {oracles.NL})")
def g5_placed_glossary(spark: SparkSession, d: str) -> DataFrame:
    """A glossary that was moved behind the questions comes back to its place."""
    blocks = F.split("md", r"(?m)^(?=##\s)")
    is_ = lambda b, h: F.startswith(b, F.lit(f"## {h}\n"))
    moved = F.array_join(F.flatten(F.transform(F.filter(blocks, lambda b: ~is_(b, "术语表")), lambda b: F.when(is_(b, "问题与思考"), F.concat(F.array(b), F.filter(blocks, lambda x: is_(x, "术语表")))).otherwise(F.array(b)))), "")
    return k1_markdown(spark, d).where(F.contains("md", F.lit("\n## 术语表\n"))).select("episode_id", F.regexp_replace(glossary.place_glossary(moved), r"\n{3,}", "\n\n").alias("t"))


@query("g6_without_empty_glossary", f"with m as ({oracles.MARKDOWN}) select episode_id, regexp_replace(md, '\\n{{3,}}', {oracles.NL} || {oracles.NL}, 'g') as t from m where not contains(md, {oracles.NL} || '## 术语表' || {oracles.NL})")
def g6_without_empty_glossary(spark: SparkSession, d: str) -> DataFrame:
    """A glossary with a placeholder alone goes."""
    filled = F.replace("md", F.lit("\n## 问题与思考\n"), F.lit("\n## 术语表\n\n- （无）\n\n## 问题与思考\n"))
    return k1_markdown(spark, d).where(~F.contains("md", F.lit("\n## 术语表\n"))).select("episode_id", F.regexp_replace(glossary.drop_empty_glossary(filled), r"\n{3,}", "\n\n").alias("t"))


@query("b1_candidates")
def b1_candidates(spark: SparkSession, d: str) -> DataFrame:
    return k1_markdown(spark, d).select("episode_id", anchors.document_candidates(F.col("md")).alias("found"))


@query("b3_anchors")
def b3_anchors(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "output_docs").select("episode_id", "full_text", F.posexplode(F.transform("key_points", lambda k: k["quote"])).alias("kp_no", "quote"))
    return quotes.select("episode_id", "kp_no", anchors.anchor(F.col("quote"), F.col("full_text")).alias("anchor"))


@query("b5_anchors")
def b5_anchors(spark: SparkSession, d: str) -> DataFrame:
    return k1_markdown(spark, d).select("episode_id", anchors.found_anchors(F.col("md")).alias("anchors"))


_SHORT = lambda a, most: f"list_filter(list_transform({a}, lambda x: trim(x)), lambda x: length(x) <= {most})"


@query(
    "b5_field_anchors",
    f"""with {oracles.FINISHED}, a as (select episode_id, list_concat(flatten(list_transform(coalesce(key_points, []), lambda k: list_concat({_SHORT('[k.quote]', 24)}, {_SHORT('[k.anchor]', 40)}, {_SHORT('list_transform(coalesce(k.terms, []), lambda t: t.term)', 12)}))),
    {_SHORT('list_transform(coalesce(keywords, []), lambda k: k.keyword)', 12)}, {_SHORT('list_transform(coalesce(questions, []), lambda q: q.anchor)', 40)}) as l from fin),
    u as (select episode_id, unnest(l) as x, unnest(range(len(l))) as i from (select distinct * from a)), f as (select episode_id, x, min(i) as i from u where length(x) >= 2 group by 1, 2)
    select episode_id, list(x order by length(x) desc, i) as anchors from f group by 1""",
)
def b5_field_anchors(spark: SparkSession, d: str) -> DataFrame:
    out = finished(spark, d).select("episode_id", anchors.document_anchors(F.col("key_points"), F.col("keywords"), F.col("questions")).alias("anchors"))
    return out.where("size(anchors) > 0").distinct()


@query("b6_bold_transcripts")
def b6_bold_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return finished(spark, d).select("episode_id", anchors.bold(F.col("full_text"), anchors.document_anchors(F.col("key_points"), F.col("keywords"), F.col("questions"))).alias("t"))


@query("b7_bold_documents")
def b7_bold_documents(spark: SparkSession, d: str) -> DataFrame:
    return k1_markdown(spark, d).select("episode_id", anchors.bold_document(F.col("md")).alias("md"))


# --- Rewriting ---------------------------------------------------------------------------------------------------


@query("n12_clean_documents")
def n12_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return k1_markdown(spark, d).select("episode_id", text.clean_markdown(F.col("md")).alias("md"))


@query("n11_clean_documents")
def n11_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    parts = documents.sections(k1_markdown(spark, d)).where("heading not like 'Show Notes%'")
    return parts.select("episode_id", "sec_no", "heading", text.clean_block(F.col("body"), F.concat(F.lit("## "), F.col("heading"))).alias("body"))


@query("a10_change_counts")
def a10_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return k1_markdown(spark, d).select("episode_id", text.change_counts(F.col("md")).alias("n")).select("episode_id", "n.*")


@query(
    "c3_open_quotes",
    f"""with l as (select distinct episode_id, unnest({oracles.POINTS}) as line from output_docs), q as (select episode_id, regexp_extract(line, '「([^」]+)」$', 1) as quote from l)
    select distinct episode_id, quote, regexp_matches(quote, '^(而|但|却|以及|还是|或|所以|就是)') as manual from q where quote <> '' and not regexp_matches(quote, '[。？！.?!]$')""",
)
def c3_open_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that end a key point without an end mark; those that begin with a connector are left to people."""
    line = table(spark, d, "output_docs").select("episode_id", F.explode(render.key_point_lines(F.col("key_points"))).alias("line"))
    q = line.select("episode_id", F.regexp_extract("line", "「([^」]+)」$", 1).alias("quote")).where((F.col("quote") != "") & ~F.col("quote").rlike("[。？！.?!]$"))
    return q.select("episode_id", "quote", F.col("quote").rlike(f"^(?:{'|'.join(text.CONNECTORS)})").alias("manual")).distinct()


@query(
    "j17_synced_quotes",
    """with q as (select distinct episode_id, list_transform(key_points, lambda k: k.quote) as qs from output_docs where key_points is not null),
    f as (select *, list_filter(qs, lambda x: coalesce(x, '') <> '' and not regexp_matches(x, '[。？！.?!]$')) as fix from q)
    select episode_id, list_transform(qs, lambda x, i: case when x is not null and list_contains(fix, x) and list_position(qs, x) = i then x || case when regexp_matches(x, '[吗呢？?]$') then '？' else '。' end else x end) as quotes from f""",
)
def j17_synced_quotes(spark: SparkSession, d: str) -> DataFrame:
    quotes = F.transform("key_points", lambda k: k["quote"])
    fix = F.filter(quotes, lambda q: (F.coalesce(q, F.lit("")) != "") & ~q.rlike("[。？！.?!]$"))
    docs = table(spark, d, "output_docs").where("key_points is not null").select("episode_id", F.transform(handoff.sync_quotes(F.col("key_points"), fix), lambda p: p["quote"]).alias("quotes"))
    return docs.distinct()


@query("j18_stale_anchors")
def j18_stale_anchors(spark: SparkSession, d: str) -> DataFrame:
    return handoff.stale_anchors(finished(spark, d))


@query("n13_synced_handoffs")
def n13_synced_handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs with cleaned marks and digits, and how many fields changed; the documents stay."""
    return handoff.sync_numbers(handoff.sync_marks(finished(spark, d))).select("episode_id", "n_marks", "n_numbers", F.to_json(F.struct("key_points", "questions")).alias("texts"))


# --- Payloads ----------------------------------------------------------------------------------------------------


@query("x1_parsed_payloads", oracles.PAYLOADS)
def x1_parsed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each payload whole, cut off (malformed), and with items that are no objects, a list for an introduction and further keys."""
    docs = finished(spark, d).select("episode_id", "summary", "key_points", "keywords", "questions", "speaker_mapping", "speaker_intro").dropDuplicates(["episode_id", "summary"])
    full = F.to_json(F.struct("summary", "key_points", "keywords", "questions", "speaker_mapping", "speaker_intro"))
    spoil = lambda c, key: F.replace(c, F.lit(f'"{key}":['), F.lit(f'"{key}":["text",3,null,'))
    plain = F.to_json(F.struct("summary", "key_points", "keywords", "questions", "speaker_mapping", F.array(F.lit(1)).alias("speaker_intro"), F.lit(1).alias("further")))
    mixed = spoil(spoil(spoil(F.replace(plain, F.lit(":[]"), F.lit(":[7]")), "key_points"), "keywords"), "questions")
    raws = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("raw")) for k, c in (("good", full), ("cut", F.left(full, F.length(full) - 2)), ("mixed", mixed))])
    keyed = docs.select(F.explode(raws).alias("r"), "episode_id").select(F.struct("episode_id", "r.kind").alias("key"), "r.raw")
    out = handoff.parse_payload(keyed, "key", "raw")
    return out.select("key.episode_id", "key.kind", "summary", "points", "keywords", "questions", F.size("speaker_mapping").cast("bigint").alias("n_mapped"), "speaker_intro")


@query("k3_handoff")
def k3_handoff(spark: SparkSession, d: str) -> DataFrame:
    return handoff.handoff(finished(spark, d))


@query(
    "x5_speaker_maps",
    """with e as (select episode_id, run_no, unnest(map_keys(speaker_mapping)) as k, unnest(map_values(speaker_mapping)) as v from (select distinct * from struct_out)),
    g as (select episode_id, run_no, bool_or(trim(replace(coalesce(v, ''), ',', '')) = '') as bad, count(*) as n from e group by 1, 2) select episode_id, run_no, case when not bad then n end as n from g""",
)
def x5_speaker_maps(spark: SparkSession, d: str) -> DataFrame:
    entries = F.array_sort(F.map_entries("speaker_mapping"))
    said = F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit(" : "), F.replace(F.coalesce(e["value"], F.lit("")), F.lit(","), F.lit("")))), ",")
    s = table(spark, d, "struct_out").where("speaker_mapping is not null and size(speaker_mapping) > 0").select("episode_id", "run_no", handoff.speaker_map(said).alias("m"))
    return s.select("episode_id", "run_no", F.when(F.col("m").isNotNull(), F.size("m").cast("bigint")).alias("n")).distinct()


@query("x6_candidates", "select distinct podcast_name, ['m-' || lower(podcast_name[1]), 'm-b'] as wanted, case when podcast_name is not null then case when lower(podcast_name[1]) in ('a', 'b') then 'm-' || lower(podcast_name[1]) else 'm-b' end end as first_offered from episodes where podcast_name is not null and lower(podcast_name[1]) <> 'b'")
def x6_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A comma list of models, and the first of them that is offered."""
    start = F.concat(F.lit("m-"), F.lower(F.left("podcast_name", F.lit(1))))
    c = handoff.candidates(F.concat(start, F.lit(" , ,m-b, "), start))
    e = table(spark, d, "episodes").where("podcast_name is not null and lower(left(podcast_name, 1)) <> 'b'").select("podcast_name", c.alias("wanted")).distinct()
    return e.select("podcast_name", "wanted", handoff.first_offered(F.col("wanted"), F.array(F.lit("m-a"), F.lit("m-b"))).alias("first_offered"))


# --- Caches and continuation -------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A result cache of all episodes, in two stages, and the files that exist: those of finished documents."""
    e = table(spark, d, "episodes").select("episode_id", cache.episode_key(F.col("url"), F.col("pub_date"), F.lit("final")).alias("key")).distinct()
    path = lambda end: F.concat(F.lit("/out/"), "episode_id", F.lit(end))
    entries = e.select("key", path(".md").alias("path"), F.lit("final").alias("stage")).unionByName(e.select("key", path("_handoff.json").alias("path"), F.lit("handoff").alias("stage")))
    files = table(spark, d, "output_docs").select(path(".md").alias("path")).distinct()
    return entries, files


_KEY = "left(sha256(trim(coalesce(url, '') || '|' || coalesce(pub_date, '') || '|final', '|')), 16)"


@query("t1_valid_results", f"select distinct {_KEY} as key, episode_id || '.md' as path from episodes e where exists (select 1 from output_docs o where o.episode_id = e.episode_id)")
def t1_valid_results(spark: SparkSession, d: str) -> DataFrame:
    entries, files = _results(spark, d)
    return continuation.valid_entries(entries, files).select("key", continuation.relative_path(F.col("path"), F.lit("/out")).alias("path"))


@query(
    "t1_cache_put",
    f"""with old as (select distinct {_KEY} as key, 'old' as path from episodes e where episode_id < '8'), new as (select distinct {_KEY} as key, episode_id as path from episodes e where episode_id >= '4')
    select key, path from new union all select key, path from old where key not in (select key from new)""",
)
def t1_cache_put(spark: SparkSession, d: str) -> DataFrame:
    """Entries for half of the episodes put onto a cache of another half: those of both are replaced."""
    e = table(spark, d, "episodes").select("episode_id", cache.episode_key(F.col("url"), F.col("pub_date"), F.lit("final")).alias("key")).distinct()
    return cache.put(e.where("episode_id < '8'").select("key", F.lit("old").alias("path")), e.where("episode_id >= '4'").select("key", F.col("episode_id").alias("path")))


def _fp(*fields: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(length(cast({f} as varchar)) || ':' || cast({f} as varchar), '~')" for f in fields) + ")"


@query("t2_transcript_keys", f"select distinct episode_id, {_fp('length(raw_text)', 'cast(duration_sec * 1000 as bigint)', 'layout', chr(39) + 'v30' + chr(39), 'null', '2')} as fp from transcripts")
def t2_transcript_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts")
    return t.select("episode_id", continuation.transcript_key(F.length("raw_text"), F.round(F.col("duration_sec") * 1000).cast("bigint"), F.col("layout"), F.lit("v30"), F.lit(None).cast("int")).alias("fp")).distinct()


@query("t4_text_keys", f"select distinct episode_id, {_fp('sha256(coalesce(raw_text, ' + chr(39) * 2 + '))', chr(39) + 'p' + chr(39), chr(39) + 'm' + chr(39), '28', 'left(sha256(coalesce(layout, ' + chr(39) * 2 + ')), 16)')} as fp from transcripts")
def t4_text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("episode_id", continuation.text_key(F.col("raw_text"), F.lit("p"), F.lit("m"), F.lit(28), F.col("layout")).alias("fp")).distinct()


@query("t7_latest_status", "select episode_id, arg_max(run_no, made_at) as stage, max(made_at) as ts from struct_out group by 1")
def t7_latest_status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "struct_out").select("episode_id", F.col("run_no").alias("stage"), F.lit(1.0).alias("progress"), F.lit("").alias("msg"), F.col("made_at").alias("ts"))
    return continuation.latest_status(s).select("episode_id", "stage", "ts")


@query("k4_backups", "select episode_id as path, coalesce(cast(length(full_text) as bigint), 0) as n from (select episode_id, min(full_text) as full_text from output_docs group by 1) union all select episode_id, -1 from (select distinct episode_id from episodes) where episode_id not in (select episode_id from output_docs)")
def k4_backups(spark: SparkSession, d: str) -> DataFrame:
    """What was kept first stays; only files without a backup are added."""
    kept = table(spark, d, "output_docs").groupBy(F.col("episode_id").alias("path")).agg(F.coalesce(F.length(F.min("full_text")).cast("bigint"), F.lit(0)).alias("n"))
    return continuation.backup_once(kept, table(spark, d, "episodes").select(F.col("episode_id").alias("path"), F.lit(-1).cast("bigint").alias("n")).distinct())


@query("k_source_lines", "select distinct episode_id, '> 来源：' || trim(podcast_name) || ' | ' || title || ' | ' || trim(pub_date) as line from episodes where trim(podcast_name) <> '' and trim(pub_date) <> '' and not contains(podcast_name || pub_date, '|')")
def k_source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Source lines without a title get it."""
    e = table(spark, d, "episodes").where("trim(podcast_name) <> '' and trim(pub_date) <> '' and not contains(podcast_name || pub_date, '|')")
    line = F.concat(F.lit("> 来源："), F.trim("podcast_name"), F.lit(" |  "), F.trim("pub_date"))
    return e.select("episode_id", continuation.repair_source(line, F.col("title")).alias("line")).distinct()


@query("r11_report")
def r11_report(spark: SparkSession, d: str) -> DataFrame:
    packages = table(spark, d, "transcripts").groupBy("episode_id").agg(F.min("raw_text").alias("text"))
    return continuation.report(k1_documents(spark, d).dropDuplicates(["episode_id"]), packages)


@query(
    "t8_continued",
    f"with m as ({oracles.MARKDOWN}) select episode_id, true as had from m union all select t.episode_id, false from (select distinct episode_id from transcripts) t where not exists (select 1 from output_docs o where o.episode_id = t.episode_id) and exists (select 1 from episodes e where e.episode_id = t.episode_id)",
)
def t8_continued(spark: SparkSession, d: str) -> DataFrame:
    """All packages have a document after a continuation; done twice, nothing more changes."""
    packages = package_texts(spark, d)
    parsed = pages.parse_packages(packages, "episode_id")
    once = continuation.continued(k1_markdown(spark, d), packages, parsed)
    twice = continuation.continued(once, packages, parsed)
    return twice.select("episode_id", (~F.contains("md", F.lit("**待校订"))).alias("had"))


def package_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").groupBy("episode_id").agg(F.max_by(F.struct("title", "podcast_name", "pub_date", "show_notes"), "scraped_at").alias("e")).select("episode_id", "e.*")
    t = table(spark, d, "transcripts").groupBy("episode_id").agg(F.min("raw_text").alias("raw_text"))
    return e.join(t, "episode_id").select("episode_id", pages.package_text(F.coalesce("title", F.lit("")), F.concat_ws(" | ", "podcast_name", "title", "pub_date"), F.col("show_notes"), F.coalesce("raw_text", F.lit(""))).alias("text"))


@query("j21_pairs", "select o.episode_id, s.run_no from (select distinct episode_id from output_docs) o left join (select distinct episode_id, run_no from struct_out) s on o.episode_id = s.episode_id")
def j21_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the handoffs of their name."""
    return table(spark, d, "output_docs").select("episode_id").distinct().join(table(spark, d, "struct_out").select("episode_id", "run_no").distinct(), "episode_id", "left")


# --- Backend -----------------------------------------------------------------------------------------------------

_SWEEP = """s0 as (select episode_id, dseg_no from diar_segments where dseg_no is not null group by 1, 2), ks as (select unnest([2, 3, 4]) as k), s1 as (select episode_id, k, (dseg_no * 7 + dseg_no // 3) % (k + 1) as c, count(*) as n from s0, ks group by 1, 2, 3),
sweep as (select episode_id, k, cast(round(min(n) / sum(n), 4) as double) as min_share, cast((sum(n) * k * 31) % 40 as double) / 100 as silhouette from s1 group by 1, 2)"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """Shares of clusters for each K; the clusters and silhouettes are made up of numbers."""
    e = table(spark, d, "diar_segments").where("dseg_no is not null").select("episode_id", "dseg_no").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    n = e.groupBy("episode_id", "k", F.expr("(dseg_no * 7 + dseg_no div 3) % (k + 1)").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("episode_id", "k").agg(F.round(F.min("n") / F.sum("n"), 4).alias("min_share"), ((F.sum("n") * F.col("k") * 31 % 40).cast("double") / 100).alias("silhouette"))


@query("o5_best_k", f"with {_SWEEP} select episode_id, k, silhouette, min_share from (select *, row_number() over (partition by episode_id order by silhouette desc, k) as r from sweep where silhouette >= 0.12 and min_share >= 0.05) where r = 1")
def o5_best_k(spark: SparkSession, d: str) -> DataFrame:
    return backend.best_k(_sweep(spark, d))


@query(
    "m8_suggestions",
    f"""with {_SWEEP}, b as (select * from (select *, row_number() over (partition by episode_id order by silhouette desc, k) as r from sweep where silhouette >= 0.12 and min_share >= 0.05) where r = 1)
    select s.episode_id, case when b.k is null then 'campplus' else 'wespeaker' end as backend, b.k, coalesce(b.min_share < 0.15, false) as minor from (select distinct episode_id from sweep) s left join b on s.episode_id = b.episode_id""",
)
def m8_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return backend.suggest(_sweep(spark, d)).select("episode_id", "backend", "k", "minor")


@query("o10_retried_k", f"with {_SWEEP} select episode_id, coalesce(min(case when silhouette > 0.2 then k end), max(k)) as k from sweep group by 1")
def o10_retried_k(spark: SparkSession, d: str) -> DataFrame:
    return backend.retried_k(_sweep(spark, d).withColumn("ok", F.col("silhouette") > 0.2))


@query(
    "r15_backends",
    f"""with {_SWEEP}, b as (select episode_id, -max(struct_pack(s := silhouette, m := -k)).m as k, bool_or(silhouette >= 0.12 and min_share >= 0.05) as ok, count(*) as n from sweep group by 1)
    select episode_id, case when ok then 'wespeaker' when k >= 3 then 'wespeaker' else 'campplus' end as backend, greatest(2, k) as k from b""",
)
def r15_backends(spark: SparkSession, d: str) -> DataFrame:
    """The choice where a probe suggests something, and where it gives nothing."""
    b = _sweep(spark, d).groupBy("episode_id").agg((-F.max(F.struct("silhouette", (-F.col("k")).alias("m")))["m"]).alias("k"), F.bool_or(F.expr("silhouette >= 0.12 and min_share >= 0.05")).alias("ok"))
    none = F.lit(None).cast("int")
    return b.select("episode_id", backend.chosen_backend(F.lit(False), F.lit(True), F.when(F.col("ok"), "wespeaker"), F.lit(False), F.col("k")).alias("backend"), backend.effective_k(none, none, none, F.col("k")).alias("k"))


@query("a22_real_time", "select distinct episode_id, round(length(raw_text) / nullif(duration_sec, 0), 6) as rtf, cast(floor(length(raw_text) / nullif(duration_sec, 0) * 7200) as bigint) as two_hours from transcripts")
def a22_real_time(spark: SparkSession, d: str) -> DataFrame:
    r = backend.real_time_factor(F.length("raw_text").cast("double"), F.col("duration_sec"))
    return table(spark, d, "transcripts").select("episode_id", r.alias("r")).select("episode_id", F.round("r.rtf", 6).alias("rtf"), "r.two_hours").distinct()


@query("d5_clock", "with c as (select episode_id, seg_no, cast(round_even(end_ms / 1000.0, 0) as bigint) as s from segments) select episode_id, seg_no, case when s is null then '??:??' when s // 3600 > 0 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', greatest(s, 0) // 60, greatest(s, 0) % 60) end as t from c")
def d5_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times before 0 show as 0."""
    return table(spark, d, "segments").select("episode_id", "seg_no", numbers.clock(F.when(F.col("end_ms") < 0, 0.0).otherwise(F.col("end_ms") / 1000.0)).alias("t"))


@query("a11_glossary_issues", f"with g as ({oracles.TERMS}) select episode_id, cast(count(*) as bigint) as n from g where state <> 'keep' group by 1")
def a11_glossary_issues(spark: SparkSession, d: str) -> DataFrame:
    return g3_terms(spark, d).where("state <> 'keep'").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


_MARKS, _HAN = text.FULL_MARKS, text.HAN


@query("n2_tight_marks", f"select episode_id, regexp_replace(regexp_replace(regexp_replace(full_text, '([{_MARKS}]) +([{_HAN}])', '\\1\\2', 'g'), '([{_HAN}])([{_MARKS}]) +([A-Za-z0-9])', '\\1\\2\\3', 'g'), '([{_HAN}]) +([{_MARKS}])', '\\1\\2', 'g') as t from output_docs")
def n2_tight_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "output_docs").select("episode_id", text.tighten_marks(F.col("full_text")).alias("t"))


_SPOILT = "regexp_replace(regexp_replace(full_text, '。', '，。、', 'g'), '，', '，、', 'g')"
_UNSTACKED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[，、；：]+([。！？])', '\\1', 'g'), '([。！？])[，、；：]+', '\\1', 'g'), '([，、])[，、]+', '\\1', 'g'), '。。+', '。', 'g'), '！！+', '！', 'g'), '？？+', '？', 'g')"


@query("n3_unstacked_marks", f"select episode_id, {_UNSTACKED.format(x=_SPOILT)} as t from output_docs")
def n3_unstacked_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks that were stacked come down again."""
    spoilt = F.regexp_replace(F.regexp_replace("full_text", "。", "，。、"), "，", "，、")
    return table(spark, d, "output_docs").select("episode_id", text.unstack_marks(spoilt).alias("t"))


@query("n17_sentences", f"select distinct episode_id, p as raw, {oracles.sent('p')} as t from (select episode_id, unnest(list_transform(key_points, lambda k: coalesce(k.evidence, ''))) as p from output_docs)")
def n17_sentences(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "output_docs").select("episode_id", F.explode(F.transform("key_points", lambda k: F.coalesce(k["evidence"], F.lit("")))).alias("raw"))
    return p.select("episode_id", "raw", text.as_sentence(F.col("raw")).alias("t")).distinct()


@query("n18_bold_questions", f"select distinct episode_id, q as raw, {oracles.bolded('q')} as t from (select episode_id, unnest(list_transform(questions, lambda k: coalesce(k.question, ''))) as q from struct_out)")
def n18_bold_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "struct_out").select("episode_id", F.explode(F.transform("questions", lambda k: F.coalesce(k["question"], F.lit("")))).alias("raw"))
    return q.select("episode_id", "raw", text.as_bold(F.col("raw")).alias("t")).distinct()
