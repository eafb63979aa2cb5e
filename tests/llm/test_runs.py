"""Run collapsing against brute force."""

import random

import pytest

from castwright.llm.runs import collapse_runs

DIA = "episode_id string, dseg_no int, start_ms bigint, end_ms bigint, speaker string, pos int, head string"


def key(label):
    digits = "".join(c for c in label or "" if c.isdigit())
    return f"n{int(digits)}" if digits else "unknown"


def brute_runs(rows, gap=200):
    once = {}
    for e, n, s, t, spk, *_ in rows:
        if n is not None and s is not None and t is not None:
            once.setdefault((e, n), (s, t, key(spk)))
    out = set()
    for e in {k[0] for k in once}:
        events = sorted((s, t, n, spk) for (x, n), (s, t, spk) in once.items() if x == e)
        run = []
        for s, t, n, spk in events:
            if run and spk == run[-1][3] and s <= max(x[1] for x in run) + gap:
                run.append((s, t, n, spk))
            else:
                if run:
                    out.add((e, run[0][2], run[-1][2], len(run), max(x[1] for x in run) - run[0][0]))
                run = [(s, t, n, spk)]
        if run:
            out.add((e, run[0][2], run[-1][2], len(run), max(x[1] for x in run) - run[0][0]))
    return out


@pytest.mark.parametrize("seed,width,batch", [(4, 3, "10000"), (5, 300, "10000"), (6, 30, "1"), (7, 100, "7")])
def test_runs(spark, seed, width, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "b", None]), i, s, s + r.randrange(0, 500), r.choice(["SPEAKER_00", "ＳＰＥＡＫＥＲ＿00", "说话人1", "SPK01:", None, "unknown"]), 1, "x") for i in range(500) for s in [r.randrange(0, 500 * width)]]
    rows += [("a", 1, None, 5, "x", 1, "x")] + rows[:40]
    try:
        got = [(x.episode_id, x.first_no, x.last_no, x.n_events, x.duration_ms) for x in collapse_runs(spark.createDataFrame(rows, DIA)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got))
    assert set(got) == brute_runs(rows)


@pytest.mark.parametrize("batch", ["10000", "9"])
def test_one_long_run(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = [("hot", i, i * 100, i * 100 + 90, "SPEAKER_01", 1, "x") for i in range(700)]
    try:
        got = collapse_runs(spark.createDataFrame(rows, DIA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.first_no, r.last_no, r.n_events, r.duration_ms) for r in got] == [(0, 699, 700, 699 * 100 + 90)]
    assert collapse_runs(spark.createDataFrame([], DIA)).count() == 0
