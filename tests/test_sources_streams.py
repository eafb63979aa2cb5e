"""Sources, joins in time, resolution, payloads and the stream of runs on small fixtures."""

import io
import wave

from pyspark.sql import functions as F

from castwright.operators import joins, speakers
from castwright.operators.aggregates import collapsed_clusters, representative_clips
from castwright.operators.chunks import pack_lines, uniform_sample
from castwright.operators.clusters import greedy_labels, medoid_labels
from castwright.plans import cache, handoff, render
from castwright.sources import audio, pages
from castwright.streaming import turns


def test_overlap(spark):
    seg = spark.createDataFrame([("e", 1, 0, 1000, 9), ("e", 2, 1000, 2000, 9), ("e", 3, 50_000, 50_000, 9), ("e", 4, None, 5, 9), ("e", 5, 90_000, 130_000, 9)], "episode_id string, seg_no int, start_ms bigint, end_ms bigint, bucket int")
    dia = spark.createDataFrame([("e", 0, 500, "B"), ("e", 500, 1000, "A"), ("e", 900, 1000, None), ("e", 95_000, 96_000, "C"), ("e", 60_000, 200_000, "D"), ("f", 0, 9, "X")], "episode_id string, start_ms bigint, end_ms bigint, speaker string")
    got = {(r.seg_no, r.speaker, r.overlap_ms) for r in joins.overlap_speaker(seg, dia).collect()}
    assert got == {(1, "B", 500), (2, "UNKNOWN", 0), (3, "UNKNOWN", 0), (4, "UNKNOWN", 0), (5, "D", 40_000)}
    assert joins.overlap_speaker(seg.limit(0), dia).count() == 0


def test_collapse(spark):
    def reasons(counts, expected=None):
        rows = [("e", s) for s, n in counts.items() for _ in range(n)]
        return collapsed_clusters(spark.createDataFrame(rows, "episode_id string, speaker string"), F.lit(expected)).first().reasons

    assert reasons({"a": 49}) == [] and reasons({"a": 200}) == ["single"] and reasons({"a": 1000, "b": 20}) == ["taken"] and reasons({"a": 1090, "b": 139}) == []
    assert reasons({"a": 300, "b": 300}, 5) == ["fewer"] and reasons({"a": 299, "b": 2}) == [] and reasons({None: 300}) == ["single"]


def test_clips(spark):
    df = spark.createDataFrame([("e", "a", 1, 0, 2000), ("e", "a", 2, 0, 9000), ("e", "a", 3, 0, 9000), ("e", "b", 1, 0, 1000), ("e", "b", 2, 0, 2000), ("e", "b", 3, 0, 40_000), ("e", "c", 1, 0, 50_000), ("e", "c", 2, 0, 40_000), ("e", None, 1, 0, 5000)], "episode_id string, speaker string, seg_no int, start_ms bigint, end_ms bigint")
    assert {(r.speaker, r.seg_no) for r in representative_clips(df).collect()} == {("a", 2), ("b", 2), ("c", 2)}


def test_resolution(spark):
    seg = spark.createDataFrame([("e", "S0", "我是湫湫。"), ("e", "S0", "今天邀请"), ("e", "S1", "我是小朱，你好"), ("e", "S2", "我是小朱。"), ("e", "S3", "我是湫湫。我是小朱。"), ("e", "S4", "嗯"), ("e", None, "我是谁")], "episode_id string, speaker string, text string")
    notes = spark.createDataFrame([("e", "主播：湫湫\n嘉宾：小朱（作者）\n别的")], "episode_id string, n string")
    roster = notes.select("episode_id", F.posexplode(speakers.roster_of(F.col("n"))).alias("ord", "r")).select("episode_id", "ord", "r.*")
    assert {(r.role, r.name) for r in roster.collect()} == {("主播", "湫湫"), ("嘉宾", "小朱")}
    got = {(r.speaker, r.name, r.issue) for r in speakers.resolve_speakers(speakers.cluster_signals(seg), roster).collect()}
    assert got == {("S0", "主播湫湫", None), ("S1", "嘉宾小朱", None), ("S2", None, "taken"), ("S3", None, "several"), ("S4", None, "unreliable")}


def test_clusters():
    import numpy as np

    v = np.array([[1, 0.1, 0], [0, 1, 0.1], [1, 0, 0], [0, 1, 0]], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert greedy_labels(v) == [0, 1, 0, 1]
    labels = medoid_labels(v, 2)
    assert labels[0] == labels[2] != labels[1] == labels[3] and medoid_labels(v, 9) == [0, 1, 2, 3]


def test_chunks_and_samples(spark):
    df = spark.createDataFrame([("ab\ncd\n" + "x" * 7,), (None,), ("",)], "t string").select(pack_lines(F.col("t"), 5).alias("c"))
    assert [r.c for r in df.collect()] == [["ab", "cd", "xxxxx", "xx"], None, [""]]
    for n, ratio in ((1, 0.1), (7, 0.5), (10, 0.33), (9, 1.0)):
        k = max(1, int(n * ratio))
        got = sorted(r.id for r in uniform_sample(spark.range(n).withColumn("g", F.lit(1)), "g", "id", ratio).collect())
        assert got == [j * n // k for j in range(k)]


def test_payload(spark):
    rows = [("a", '{"summary": " s ", "key_points": [{"point": "p", "quote": 1}, 3, {"point": " "}], "keywords": [{"keyword": "k"}]}'), ("b", "{bad"), ("c", None), ("d", '{"key_points": "x"}')]
    got = {r.k: r for r in handoff.parse_payload(spark.createDataFrame(rows, "k string, raw string"), "k", "raw").collect()}
    assert got["a"].summary == "s" and [(p.point, p.quote) for p in got["a"].points] == [("p", "1")] and got["a"].keywords[0].keyword == "k"
    assert all(got[k].points == [] and got[k].summary == "" for k in "bcd")


def test_merge_blocks(spark):
    df = spark.createDataFrame([("【甲】没标点\n【甲】接着说，",), ("【甲】好。\n\n【乙】嗯\n\n无标签",)], "t string")
    assert [r.r for r in df.select(render.merge_blocks(F.col("t")).alias("r")).collect()] == ["【甲】没标点。接着说。", "【甲】好。\n\n【乙】嗯。无标签"]


def test_pages_and_packages(spark, tmp_path):
    html = '<script type="application/ld+json">{"@type": "PodcastEpisode", "name": "T", "partOfSeries": {"name": "P"}, "datePublished": "2026-01-01T20:00:00Z", "associatedMedia": {"contentUrl": "https://x/a.m4a"}}</script><meta property="og:description" content="notes">'
    row = pages.scan_pages(spark.createDataFrame([("https://x/episode/abc1", html), ("https://x/none", "<p>")], "url string, html string")).collect()
    assert [(r.episode_id, r.title, r.podcast_name, r.pub_date, r.show_notes, r.audio_url) for r in row] == [("abc1", "T", "P", "2026-01-02", "notes", "https://x/a.m4a")]
    (tmp_path / "ep_diarized.txt").write_text("# T\n\n> 来源：P | T | D\n\n# Show Notes\n（无）\n\n# 转录全文\n[SPEAKER_00] a\nb\n[SPEAKER_01] c", encoding="utf-8")
    parsed = pages.parse_packages(pages.read_texts(spark, str(tmp_path), "*_diarized.txt"))
    assert [(r.no, r.label, r.text) for r in pages.package_segments(parsed).orderBy("no").collect()] == [(0, "SPEAKER_00", "a\nb"), (1, "SPEAKER_01", "c")]
    assert pages.read_texts(spark, str(tmp_path), "*.txt").first().stem == "ep" and parsed.first().source == "P | T | D"


def test_pages_fall_back(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    html = ld("{bad") + ld('[{"@type": "Thing", "dateCreated": "2026-02-03"}, {"@type": "PodcastEpisode", "@graph": [{"url": "https://media.xyzcdn.net/x"}]}]') + "<title> Ein <b>Titel</b> - Show </title><div class='my show-notes'>text <i>here</i></div>"
    row = pages.scan_pages(spark.createDataFrame([("https://x/episode/q1", html)], "url string, html string")).first()
    assert (row.title, row.podcast_name, row.pub_date, row.show_notes, row.audio_url) == ("Ein Titel - Show", "Show", "2026-02-03", "text here", "https://media.xyzcdn.net/x")


def test_wav(spark, tmp_path):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 16000)
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = audio.read_durations(spark, str(tmp_path))
    assert sorted(r.seconds for r in got.collect()) == [0.0, 1.0]
    long = spark.createDataFrame([("x", 1250.0)], "path string, seconds double")
    assert [(r.chunk_idx, r.offset_sec, r.seconds) for r in audio.slices(long).orderBy("chunk_idx").collect()] == [(0, 0, 600.0), (1, 600, 600.0), (2, 1200, 50.0)]


def test_cache(spark):
    df = spark.createDataFrame([("u", "d", "final"), (None, None, "x")], "u string, d string, s string").select(cache.episode_key(F.col("u"), F.col("d"), F.col("s")).alias("k"))
    import hashlib

    assert [r.k for r in df.collect()] == [hashlib.sha256(t).hexdigest()[:16] for t in (b"u|d|final", b"x")]
    pair = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, ""), ("", None)], "x string, y string").select(cache.fingerprint(F.col("x"), F.col("y")).alias("f"))
    assert pair.distinct().count() == 4


def test_stream_of_runs(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("e", i, "t", i * 1000, i * 1000 + 900, s, None) for i, s in enumerate("AAABBA")]
    spark.createDataFrame(rows[:4], turns.SEGMENTS).coalesce(1).write.parquet(src)
    got = []

    def run():
        stream = turns.closed_runs(turns.read_segments(spark, src))
        keep = lambda df, _: got.extend((r.speaker, r.first_no, r.last_no) for r in df.collect())
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()

    run()
    spark.createDataFrame(rows[3:], turns.SEGMENTS).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(got) == [("A", 0, 2), ("B", 3, 4)]


def test_joins_with_very_long_intervals(spark):
    import random

    r = random.Random(8)
    span = lambda: (a := r.randrange(0, 3_000_000), a + r.choice([r.randrange(1, 5000), r.randrange(1, 400_000), 90_000_000]))
    seg = [("e", i, *span()) for i in range(60)]
    dia = [("e", i, *span(), f"S{i % 4}") for i in range(60)]
    df = spark.createDataFrame(seg, "episode_id string, seg_no int, start_ms bigint, end_ms bigint")
    got = {x.seg_no: (x.speaker, x.overlap_ms) for x in joins.overlap_speaker(df, spark.createDataFrame(dia, "episode_id string, dseg_no int, start_ms bigint, end_ms bigint, speaker string")).collect()}
    want = {}
    for _, n, s, e in seg:
        best = min(((-(min(e, y) - max(s, x)), x, y, k) for _, _, x, y, k in dia if x < e and s < y), default=(0, 0, 0, "UNKNOWN"))
        want[n] = (best[3], -best[0])
    assert got == want
    points = spark.createDataFrame([("e", t * 97_001) for t in range(40)], "episode_id string, at_ms bigint")
    hits = {(x.at_ms, x.seg_no) for x in joins.points_in_intervals(points, df).collect()}
    assert hits == {(t * 97_001, n) for t in range(40) for _, n, s, e in seg if s <= t * 97_001 < e}
