"""Queries of the training-data operators: callables over a folder of tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.functions.labels import NARROW, NUMBERED, WIDE
from castwright.llm.abuse import score_documents, source_rates
from castwright.llm.leakage import leaked_items
from castwright.llm.lookalike import canonical_documents, equal_looking_quotes
from castwright.llm.names import link_names, name_pairs
from castwright.llm.packing import pack_documents, packing_report
from castwright.llm.runs import collapse_runs
from castwright.llm.sentences import all_sentences
from castwright.llm.turns import speaker_turns
from castwright.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    turns = speaker_turns(table(spark, d, "segments"), table(spark, d, "transcripts"), table(spark, d, "struct_out"), with_text=False)
    return turns.select("episode_id", "first_unit", "last_unit", "speaker")


@query("p5_turns")
def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "segments"), table(spark, d, "transcripts"), table(spark, d, "struct_out"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = all_sentences(table(spark, d, "transcripts"), table(spark, d, "output_docs"), table(spark, d, "documents"))
    return found.select("episode_id", "text_field", "end_pos").distinct()


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return equal_looking_quotes(table(spark, d, "output_docs")).select("episode_id", "kp_no")


@query("p6_canonical")
def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The full text (kp_no 0) and every quote in the one form in which equal-looking text is equal."""
    return canonical_documents(table(spark, d, "output_docs"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id").distinct()


@query("p9_scores")
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query("p9_rates")
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(_scored(spark, d))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(link_names(table(spark, d, "roster"), table(spark, d, "episodes")))


@query("p1_entities")
def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Membership: one row for each spelling, with the entity that it means."""
    return link_names(table(spark, d, "roster"), table(spark, d, "episodes"))


@query("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


@query("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(table(spark, d, "documents"))


# The speaker's key in SQL.
_BARE = f"regexp_replace(lower(translate(coalesce(speaker, ''), '{WIDE.replace(chr(39), chr(39) * 2)}', '{NARROW.replace(chr(39), chr(39) * 2)}')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
_NUMBER = f"cast(regexp_extract({_BARE}, '{NUMBERED}', 1) as bigint)"
SPEAKER_KEY_SQL = f"(case when regexp_matches({_BARE}, '{NUMBERED}') then 'SPEAKER_' || case when {_NUMBER} < 10 then '0' else '' end || cast({_NUMBER} as varchar) when {_BARE} in ('', 'unknown') then 'UNKNOWN' else {_BARE} end)"

_RUNS_SQL = f"""
with k as (select episode_id, cast(dseg_no as bigint) as dseg_no, start_ms, end_ms, {SPEAKER_KEY_SQL} as spk from diar_segments
           where dseg_no is not null and start_ms is not null and end_ms is not null),
o as (select * from (select *, row_number() over (partition by episode_id, dseg_no order by start_ms, end_ms, spk) as rn from k) where rn = 1),
s as (select *, lag(spk) over w as before_spk, row_number() over w as pos from o window w as (partition by episode_id order by start_ms, end_ms, dseg_no)),
t as (select *, sum(case when spk = before_spk then 0 else 1 end) over (partition by episode_id order by pos) as stretch from s),
u as (select *, max(end_ms) over (partition by episode_id, stretch order by pos rows between unbounded preceding and 1 preceding) as high from t),
v as (select *, sum(case when start_ms <= high + 200 then 0 else 1 end) over (partition by episode_id order by pos) as run from u),
r as (select episode_id, run, arg_min(dseg_no, pos) as first_no, arg_max(dseg_no, pos) as last_no, count(*) as n_events, min(start_ms) as start_ms, max(end_ms) as end_ms, min(spk) as speaker
      from v group by episode_id, run)
"""


@query("p3_found", _RUNS_SQL + "select episode_id, cast(first_no as int) as first_dseg_no, cast(last_no as int) as last_dseg_no from r where n_events >= 2")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    runs = collapse_runs(table(spark, d, "diar_segments"))
    return runs.where("n_events >= 2").select("episode_id", F.col("first_no").cast("int").alias("first_dseg_no"), F.col("last_no").cast("int").alias("last_dseg_no"))


@query("p3_runs", _RUNS_SQL + "select episode_id, speaker, first_no, last_no, n_events, start_ms, end_ms, end_ms - start_ms as duration_ms from r")
def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "diar_segments"))
