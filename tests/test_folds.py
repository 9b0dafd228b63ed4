"""Folds by stretches against a plain run through all rows, rule by rule, without Spark and with it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import segments as S
from cueloom.operators.folds import STRETCH, runs, summary, through


def plain(rule, ids, rows):
    state, before, out = None, None, []
    for i, row in zip(ids, rows):
        state = (rule.value(row), rule.blank(row), i) if rule.starts(state, before, row) else (state[0], state[1] and rule.blank(row), state[2])
        before = rule.after(before, row)
        out.append(state)
    return out


def cases(kind, r, n):
    """A rule and rows that reach every limit: equal times, times that go back, blanks, and long runs."""
    t, rows = 0, []
    if kind == "merging":
        for _ in range(n):
            start = t + r.choice([-5000, 0, 0, 10, 20, 30, 1001])
            end = start + r.choice([0, 10, 500, 900])
            blank = r.random() < 0.3
            rows.append((start if r.random() < 0.98 else None, end, r.choice("AAAAAAB"), not blank and r.random() < 0.2, not blank and r.random() < 0.3, blank))
            t = end
        return S._merging(1000, r.choice([900, 2000, None])), rows
    if kind == "overlapping":
        for _ in range(n):
            start = max(0, t + r.choice([-900, -40, -10, 0, 5]))
            rows.append((start, start + r.choice([0, 10, 60, 60, 2000 if r.random() < 0.1 else 7])))
            t = start + 20
        return S._overlapping(), rows
    for _ in range(n):
        t += r.choice([0, 20, 60, -30, 90, -250 if r.random() < 0.1 else 30])
        rows.append((r.choice("aaaaaaaab"), t))
    return S._rolling(100), rows


@pytest.mark.parametrize("kind", ["merging", "overlapping", "rolling"])
def test_summaries_in_order_are_the_fold(kind):
    r = random.Random(kind)
    for _ in range(600):
        rule, rows = cases(kind, r, r.choice([1, 5, 30, 90]))
        ids = list(range(len(rows)))
        want, size = plain(rule, ids, rows), r.choice([1, 2, 3, 8, 40])
        state = before = None
        for a in range(0, len(rows), size):
            s = json.loads(json.dumps(summary(rule, ids[a : a + size], rows[a : a + size], a == 0)))
            state, before = through(rule, state, before, s), rule.joined(before, s["tail"] and tuple(s["tail"]))
            assert state == want[min(a + size, len(rows)) - 1], (rows, size, a)


def test_a_summary_is_short_where_paths_run_together():
    """One speaker without a stop: thresholds that lead to the same end are one entry."""
    rule = S._overlapping()
    rows = [(10 * i, 10 * i + 12) for i in range(STRETCH)]
    s = summary(rule, list(range(STRETCH)), rows, False)
    assert len(s["high"][0]) <= 2
    words = [("uh", 150 * i) for i in range(STRETCH)]
    assert len(summary(S._rolling(100), list(range(STRETCH)), words, False)["high"][0]) <= 2


def test_one_island_is_many_stretches(spark):
    """A medium of one speaker without a sentence end is dealt out, and no array is longer than a stretch."""
    n = 5000
    seg = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), "id", (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 90).alias("end_ms"), F.lit("and so").alias("text"), F.lit("A").alias("speaker"))
    found = runs(seg.withColumns({"__ends": F.lit(False), "__frag": F.lit(True), "__blank": F.lit(False)}), S._merging(1000, 60000), 100)
    assert found.groupBy("run").count().agg(F.max("count")).first()[0] == 600
    out = S.merge_continuous(seg, stretch=100)
    assert [(r.id, r.start_ms, r.end_ms) for r in out.orderBy("id").collect()] == [(k, 60_000 * k, min(60_000 * (k + 1), 100 * n) - 10) for k in range(9)]


def test_the_rows_are_dealt_once(spark, sf_dir):
    from cueloom.plans import fixtures

    df = S.dedup_overlap(fixtures.cues_overlapped(spark, sf_dir), stretch=3)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_odd_rows(spark):
    schema = "media_id long, id long, start_ms long, end_ms long, text string, speaker string"
    rows = [(1, 0, 0, 10, None, "A"), (1, 1, None, 20, "x", "A"), (1, 2, 20, None, "y", "A"), (1, 3, 30, 40, "z", None), (None, 5, 0, 1, "q", "A"), (None, 6, 1, 2, "r", "A")]
    df = spark.createDataFrame(rows, schema)
    assert len(S.merge_continuous(df).collect()) == 5 and len(S.dedup_overlap(df).collect()) == 6
    assert S.merge_continuous(df.limit(0)).collect() == [] == S.dedup_overlap(df.limit(0)).collect()
