"""Streams of progress and expiry, runs that are timed, and runs that are cancelled."""

import json
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cueloom.operators import jobs
from cueloom.plans.runs import Run, StepListener
from cueloom.streaming import lifecycle, live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_progress_files_are_read_once(spark, tmp_path):
    """Files that come between two runs are read once; the states of jobs go on."""
    def add(job, name, lines):
        (tmp_path / "log" / job).mkdir(parents=True, exist_ok=True)
        (tmp_path / "log" / job / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")

    listener, seen = StepListener(), []
    spark.streams.addListener(listener)

    def run():
        rows = live.latest_progress(lifecycle.progress_stream(spark, f"file://{tmp_path}/log"))
        q = rows.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").queryName("progress").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
        q.awaitTermination()
        return [p.observedMetrics["progress_lines"] for p in q.recentProgress if "progress_lines" in p.observedMetrics]

    add("a", "0", [{"step": 1, "total": 9, "message": "x"}, "{broken", "", {"step": 3, "total": 9, "message": "y"}])
    add("b", "0", [{"total": 9}, {"step": 2, "total": 9, "message": "z"}])
    first = run()
    assert sorted(seen) == [("a", 3, 9, "y"), ("b", 2, 9, "z")]
    assert sum(m.lines for m in first) - sum(m.bad for m in first) == 3 and sum(m.bad for m in first) >= 2
    seen.clear()
    add("a", "1", [{"step": 2, "total": 9, "message": "late"}])
    add("b", "1", [{"step": 5, "total": 9, "message": "w"}])
    second = run()
    assert sum(m.lines for m in second) == 2
    assert sorted(seen) == [("a", 3, 9, "y"), ("b", 5, 9, "w")]
    for _ in range(100):  # events come a little later
        if sum(b[4] for b in listener.batches) == sum(m.lines for m in first) + 2:
            break
        time.sleep(0.1)
    steps = listener.steps(spark)
    assert steps.agg(F.sum("rows")).first()[0] == sum(m.lines for m in first) + 2
    assert {r.step for r in jobs.step_share(steps).collect()} == {"progress"}
    spark.streams.removeListener(listener)


def test_ended_jobs_expire_and_cancelled_ones_never(spark, tmp_path):
    """The stream, restarted from its checkpoint, gives what the batch sweep gives at the watermark."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKSDB)
    schema, hour = "job_id long, seq long, status string, at timestamp", timedelta(hours=1)
    batches = [
        [(1, 0, "queued", START), (1, 1, "done", START + hour), (2, 0, "cancelled", START), (3, 0, "running", START)],
        [(4, 0, "failed", START + 3 * hour), (1, 2, "running", START + 3 * hour)],
        [(5, 0, "done", START + 11 * hour), (6, 0, "running", START + 11 * hour)],
        [(3, 1, "done", START + 12 * hour), (7, 0, "queued", START + 30 * hour)],
        [(8, 0, "queued", START + 31 * hour)],
    ]
    out = []
    try:
        for k, rows in enumerate(batches):  # each batch is a run of its own
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            q = lifecycle.expired_jobs(events, 10).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend((r.job_id, r.status) for r in df.collect())).start()
            q.awaitTermination()
            if k == 2:
                assert sorted(out) == [(1, "done")]  # ended at 1 h, the watermark stands at 11 h
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    log = spark.createDataFrame([x for b in batches for x in b], schema)
    settled = jobs.settled_status(log)
    touched = log.join(settled, ["job_id", "status"]).groupBy(F.col("job_id").alias("id"), "status").agg(F.unix_seconds(F.min("at")).alias("touched_at"))
    want = jobs.ttl_sweep(touched, int((START + 31 * hour).timestamp()), 10)
    assert sorted(out) == sorted((r.id, r.status) for r in want.collect()) == [(1, "done"), (3, "done"), (4, "failed"), (5, "done")]


def test_a_run_records_its_steps(spark, tmp_path):
    run = Run(spark, "r1", f"file://{tmp_path}/r1", clock=lambda: 1000.0)
    out = run.all(spark.range(100), [("even", lambda d: d.where("id % 2 = 0")), ("few", lambda d: d.where("id < 10"))])
    assert out.count() == 5 and [tuple(r) for r in run.record().collect()] == [("r1", "done", 1000, None)]
    steps = run.steps().orderBy("pos").collect()
    assert [(r.step, r.rows) for r in steps] == [("even", 50), ("few", 5)] and all(r.elapsed > 0 for r in steps)
    shares = jobs.step_share(run.steps()).collect()
    assert abs(sum(r["share"] for r in shares) - 100) < 1e-6


def test_a_run_is_cancelled_in_the_middle_of_a_step(spark, tmp_path):
    run = Run(spark, "r2", f"file://{tmp_path}/r2")

    def slow(batches):
        import time as t

        for b in batches:
            t.sleep(60)
            yield b

    after = []
    done = []
    t = threading.Thread(target=lambda: done.append(run.all(spark.range(8), [("first", lambda d: d), ("slow", lambda d: d.mapInArrow(slow, "id long")), ("never", lambda d: after.append(1) or d)])))
    began = time.time()
    t.start()
    while not (tmp_path / "r2" / "tables" / "first").exists() and time.time() - began < 60:
        time.sleep(0.2)
    time.sleep(2)
    run.cancel()
    t.join(50)
    assert done == [None] and not after and time.time() - began < 55
    assert [r.status for r in run.record().collect()] == ["cancelled"]
    assert sorted(p.name for p in (tmp_path / "r2").iterdir() if p.name.strip(".") and not p.name.endswith(".crc")) == ["record", "steps"]  # no table, whole or half


def test_a_failed_run_says_why(spark, tmp_path):
    run = Run(spark, "r3", f"file://{tmp_path}/r3")
    with pytest.raises(Exception):
        run.all(spark.range(3), [("bad", lambda d: d.select(F.raise_error(F.lit("key sk-" + "a1" * 12)).alias("x")))])
    (r,) = run.record().collect()
    assert r.status == "failed" and "sk-a1" not in r.error and run.steps is not None
