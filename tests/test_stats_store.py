"""The stored statistics table against a whole log of its appends."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import jobs
from cueloom.sources.stats_store import StatsStore

SCHEMA = "id long, created_at long, status string, target_language string, segments_count long, audio_seconds long, tts_characters long, llm_input_tokens long, llm_output_tokens long, note string"
NOW = 40 * 86400 + 5000


def some(r, n):
    return [(r.randrange(80), None if r.random() < 0.05 else r.randrange(40 * 86400 + 9000), r.choice(["done", "failed", "queued", None]), r.choice(["de", "fr", None]), *[r.randrange(50) for _ in range(5)], f"n{r.random()}") for _ in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return StatsStore(spark, f"file://{tmp_path}/stats", spark.createDataFrame([], SCHEMA).schema, by=("created_at", "note"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def agrees(spark, store, log):
    """What the store says equals the whole log: by key the last append, in it the largest (created_at, note)."""
    last = {}
    for batch in log:
        best = {}
        for x in batch:
            order = (x[1] is not None, x[1] or 0, x[9])
            if x[0] not in best or order > best[x[0]][0]:
                best[x[0]] = (order, x)
        last |= {k: x for k, (_, x) in best.items()}
    whole = spark.createDataFrame(list(last.values()), SCHEMA)
    assert rows(store.read()) == rows(whole)
    for days in (3, 20):
        since = NOW - days * 86400
        assert rows(store.read(since)) == rows(whole.where(F.col("created_at") >= since))
        assert rows(store.summary(NOW, days)) == rows(jobs.stats_summary(whole, NOW, days))
        assert [tuple(r) for r in store.by_language(NOW, days).collect()] == [tuple(r) for r in jobs.stats_by_language(whole, NOW, days).collect()]


def test_appends_and_compactions(spark, store):
    r, log = random.Random(4), []
    assert store.read().collect() == [] and store.summary(NOW, 30).first().jobs == 0
    for step in range(4):
        log.append(some(r, 60))
        store.append(spark.createDataFrame(log[-1], SCHEMA))
        if step in (0, 2):
            store.compact()
            assert store.manifest()["deltas"] == []
        agrees(spark, store, log)
    store.compact()
    store.vacuum()
    agrees(spark, store, log)


def test_only_the_days_asked_for_are_opened(spark, store):
    day = lambda k, n: [(k * 100 + i, k * 86400 + i, "done", "de", 1, 1, 1, 1, 1, "x") for i in range(n)]
    for k in (10, 20, 38, 39):
        store.append(spark.createDataFrame(day(k, 5), SCHEMA))
    store.compact()
    before = store.manifest()["days"]
    store.append(spark.createDataFrame(day(39, 2), SCHEMA))
    files = {f.split("day=")[1].split("/")[0] for f in store.read(38 * 86400).inputFiles() if "day=" in f}
    assert files == {"38", "39"}
    store.compact()
    after = store.manifest()["days"]
    assert {d for d in after if after[d] != before[d]} == {"39"}  # other days keep their files
    rolled = {f.split("/day=")[1].split("/")[0] for f in store.partial(38 * 86400 - 5).inputFiles() if "/roll-" in f}
    assert rolled == {"38", "39"}


def test_a_second_writer_starts_over(spark, store):
    """Of two that build the same manifest one is first; the other's change is made on top of it."""
    seen = []

    def change(m):
        seen.append(m["n"])
        if len(seen) == 1:
            store._commit(lambda x: x | {"days": {"1": ["part-a", "roll-a"]}})
        return m | {"batches": m["batches"] + 1}

    done = store._commit(change)
    assert seen == [0, 1] and done["n"] == 2 and done["days"] == {"1": ["part-a", "roll-a"]} and store.manifest() == done
