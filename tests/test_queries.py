"""Every core query runs on its tables, and those with SQL give the same rows."""

import glob
import os

import duckdb
import pytest

from castwright import queries


# Their cases are too rare for small tables; test_documents.py has some.
RARE = ("j6_aliased_names", "j18_stale_anchors", "a4_diarization_issues")


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert rows or name in queries.SQL or name in RARE
    if name in queries.SQL:
        cur = duck.execute(queries.SQL[name])
        names = [x[0] for x in cur.description]
        want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_core_does_not_import_llm():
    for f in glob.glob(os.path.join(os.path.dirname(queries.__file__), "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "castwright.llm" not in open(f, encoding="utf-8").read(), f


def test_bold_takes_all_sources(spark):
    from pyspark.sql import functions as F

    from castwright.functions import anchors

    points = "array<struct<point:string,evidence:string,quote:string,anchor:string,terms:array<struct<term:string,descr:string>>>>"
    rows = [("e1", "quoted words, anchor one, some term, key word, asked here.", [("p", "", " quoted words ", "anchor one", [("some term", "")])], [("key word", "")], [("q", "a", "asked here")]), ("e2", "asked here", None, None, None)]
    df = spark.createDataFrame(rows, f"episode_id string, full_text string, key_points {points}, keywords array<struct<keyword:string,descr:string>>, questions array<struct<question:string,answer:string,anchor:string>>")
    got = {r.episode_id: r.t for r in df.select("episode_id", anchors.bold(F.col("full_text"), anchors.document_anchors(F.col("key_points"), F.col("keywords"), F.col("questions"))).alias("t")).collect()}
    assert got == {"e1": "**quoted words**, **anchor one**, **some term**, **key word**, **asked here**.", "e2": "asked here"}
