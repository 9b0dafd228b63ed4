"""Ranks over all rows against sorting in one place: equal times, hot times, nulls, and times far apart."""

import random

from cueloom.operators import jobs, ranks


def test_numbered(spark):
    r = random.Random(1)
    rows = [(i * 977 % 200_003 - 1000, r.choice([None, 5, 5, 5, r.randrange(10**6), r.randrange(10**10), -7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, at long").repartition(5)
    got = {x.id: x.n for x in ranks.numbered(df, "at", "id", "n").collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert got == {i: k for k, (i, _) in enumerate(order)}
    assert ranks.numbered(df.limit(0), "at", "id", "n").collect() == []


def test_queue_positions_of_one_large_queue(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), i, r.choice(["queued", "running", "done"]), r.choice([None, 0, 100, 100, r.randrange(10**9)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "queue long, id long, status string, created_at long")
    waiting = [x for x in rows if x[2] in ("queued", "running") and x[3]]
    got = {x.id: x.queue_position for x in jobs.queue_position(df).collect()}
    for q, i, status, at in rows:
        want = sum(w[0] == q and w[3] < at for w in waiting) if status == "queued" and at and q is not None else 0
        assert got[i] == want


def test_dispatch_deals_in_turn(spark):
    df = spark.createDataFrame([(i, 1000 - i // 3) for i in range(100)], "id long, created_at long")
    got = sorted(((x.turn, x.worker), x.id) for x in jobs.dispatch(df, 4).collect())
    assert [i for _, i in got] == [i for i, _ in sorted(((i, 1000 - i // 3) for i in range(100)), key=lambda x: (x[1], x[0]))]
    assert [w for (_, w), _ in got] == [k % 4 for k in range(100)]
