"""Interval and neighbour merging against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from castwright.operators.intervals import merge_intervals
from castwright.operators.islands import merge_neighbours

SEG = "episode_id string, seg_no int, start_ms bigint, end_ms bigint, speaker string, entity string, `from_ms` int"


def brute_periods(rows, pause=1_800_000):
    out = set()
    for e in {r[0] for r in rows}:
        spans = sorted((r[2], r[3]) for r in rows if r[0] == e and r[2] is not None and r[3] is not None and r[3] > r[2])
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(e, "period", s, t) for s, t in merged}
        out |= {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] < pause}
    return out


def random_rows(seed, n, hot):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = "hot" if r.random() < hot else r.choice(["a", "b", "c", None])
        s = r.choice([None, r.randrange(0, n * 8)])
        rows.append((e, i, s if r.random() > 0.05 else None, None if s is None else s + r.randrange(-5, 40), r.choice(["SPEAKER_00", "spk_0", "说话人1", "SPK01", None, "unknown"]), "x", 1))
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periods_and_gaps(spark, seed):
    rows = random_rows(seed, 600, 0.5)
    df = spark.createDataFrame(rows, SEG).repartition(7)
    got = [tuple(r) for r in merge_intervals(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_periods(rows)


def test_periods_in_small_batches_and_many_partitions(spark):
    rows = random_rows(9, 800, 0.9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, SEG)).collect()} == brute_periods(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_periods_of_nothing(spark):
    assert merge_intervals(spark.createDataFrame([], SEG)).count() == 0
    assert merge_intervals(spark.createDataFrame([("a", 1, 5, 5, None, "x", 1), ("a", 2, 9, 3, None, "x", 1)], SEG)).count() == 0


def test_neighbours(spark):
    schema = "episode_id string, no int, key string, start_ms bigint, end_ms bigint, text string, island int"
    rows = [("e", 0, "A", 0, 1000, "一", 1), ("e", 1, "A", 1150, 2000, "二", 1), ("e", 2, "A", 2400, 3000, "三", 1), ("e", 3, "B", 3010, 3100, None, 1), ("e", 4, "A", 3110, 3200, "", 1), ("f", 0, None, None, None, "x", 1)]
    got = {(r.episode_id, r.key, r.first_no, r.last_no, r.end_ms, r.text) for r in merge_neighbours(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("e", "A", 0, 1, 2000, "一 二"), ("e", "A", 2, 2, 3000, "三"), ("e", "B", 3, 3, 3100, ""), ("e", "A", 4, 4, 3200, ""), ("f", "", 0, 0, 0, "x")}
    assert merge_neighbours(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_over_partitions(spark):
    df = spark.range(3000).select(F.lit("e").alias("episode_id"), F.col("id").alias("no"), (F.col("id") / 900).cast("int").cast("string").alias("key"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 9).alias("end_ms"), F.lit("t").alias("text")).repartition(9)
    got = sorted((r.first_no, r.last_no, r.n) for r in merge_neighbours(df).collect())
    assert got == [(0, 899, 900), (900, 1799, 900), (1800, 2699, 900), (2700, 2999, 300)]
