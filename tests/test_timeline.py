"""Timelines by stretches: the same rows whatever the length of a stretch, and a long medium in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import timeline as TL


@pytest.fixture(scope="module")
def tables(spark):
    r, seg, said = random.Random(2), [], []
    for m in range(4):
        t, i = 0, 0
        for _ in range(60):
            i += r.choice([1, 1, 1, 5])  # ids have holes
            s = max(0, t + r.choice([-300, 0, 0, 40, 60, 900]))
            e = s + r.choice([0, 5, 400, 2500])
            seg.append((m, i, s, e, f"t{i}", "A"))
            if r.random() < 0.9:
                said.append((m, i, r.choice([0, 100, 400, 3000, 9000])))
            t = e
    segments = spark.createDataFrame(seg, "media_id long, id long, start_ms long, end_ms long, text string, speaker string").repartition(3).cache()
    media = spark.createDataFrame([(m, 200_000 if m else 10) for m in range(5)], "media_id long, total_ms long")
    return segments, spark.createDataFrame(said, "media_id long, id long, tts_ms long").cache(), media


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_stretches_change_nothing(tables, stretch):
    seg, tts, media = tables
    whole = 1 << 40
    assert rows(TL.gaps(seg, media, stretch=stretch)) == rows(TL.gaps(seg, media, stretch=whole))
    assert rows(TL.retime(seg, tts, stretch=stretch)) == rows(TL.retime(seg, tts, stretch=whole))
    assert rows(TL.audio_plan(seg, tts, media, mix=0.3, stretch=stretch)) == rows(TL.audio_plan(seg, tts, media, mix=0.3, stretch=whole))
    assert rows(TL.rescale(seg, media, stretch=stretch)) == rows(TL.rescale(seg, media, stretch=whole))


def test_against_a_plain_scan(tables):
    seg, tts, media = tables
    said = {(r.media_id, r.id) for r in tts.collect()}
    sized = {(r.media_id, r.id): r for r in TL.sized(seg, tts).collect()}
    want, found, last = [], [], {}
    by = sorted(seg.collect(), key=lambda r: (r.media_id, r.id))
    for r in by:
        before = last.get(("all", r.media_id), 0)
        if r.start_ms - before > 50:
            found.append((r.media_id, r.id, before, r.start_ms))
        last["all", r.media_id] = r.end_ms
        if (r.media_id, r.id) in said:
            end, now = last.get(r.media_id, (0, 0))
            gap = r.start_ms - end if r.start_ms - end > 50 else 0
            now += gap * 1000
            chunk = sized[r.media_id, r.id].chunk_us
            want.append((r.media_id, r.id, now, now + chunk))
            last[r.media_id] = (r.end_ms, now + chunk)
    for m in media.collect():
        before = last.get(("all", m.media_id), 0)
        if m.total_ms - before > 50:
            found.append((m.media_id, None, before, m.total_ms))
    assert rows(TL.retime(seg, tts, stretch=9).select("media_id", "id", "start_us", "end_us")) == sorted(want, key=str)
    assert rows(TL.gaps(seg, media, stretch=9)) == sorted(found, key=str)
    plan = TL.audio_plan(seg, tts, media, stretch=9)
    for r in plan.groupBy("media_id", "track").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.max("ord").alias("top"), F.min("ord").alias("low")).collect():
        assert r.n == r.d == r.top + 1 and r.low == 0
    order = [(r.track, r.id is None, r.id or 0) for r in plan.where("media_id = 1").orderBy("track", "ord").collect()]
    assert order == sorted(order)


def test_one_long_medium_is_many_tasks(spark):
    """A quarter of a million segments of one medium: every partition has some, and both readers share one exchange."""
    n = 250_000
    seg = spark.range(n).select(F.lit(7).cast("long").alias("media_id"), "id", (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 800).alias("end_ms"), F.concat(F.lit("t"), "id").alias("text"), F.lit("A").alias("speaker"))
    tts = seg.select("media_id", "id", (F.col("id") % 900 + 100).alias("tts_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = TL.retime(seg, tts, stretch=2000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < n / 2
        plan = out._jdf.queryExecution().executedPlan()
        out.write.format("noop").mode("overwrite").save()
        assert TL.retime(seg, tts, stretch=2000).orderBy(F.desc("id")).first().end_us == TL.sized(seg, tts).agg(F.sum("chunk_us") + (n - 1) * 200_000).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    windows = [x for x in plan.toString().split("== Initial Plan ==")[-1].splitlines() if "Window [" in x]
    assert windows and all("stretch" in w for w in windows)


def test_empty_and_odd(spark, tables):
    seg, tts, media = tables
    assert TL.retime(seg.limit(0), tts).collect() == [] and TL.retime(seg, tts.limit(0)).collect() == []
    assert {r.id for r in TL.gaps(seg.limit(0), media).collect()} == {None}
