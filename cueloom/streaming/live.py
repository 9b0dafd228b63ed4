"""Structured Streaming forms of the job log and of gap chunking; both also accept batch tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_progress(events: DataFrame) -> DataFrame:
    """(job_id, step, total, message): each job's furthest step; complete or update mode."""
    best = F.max_by(F.struct("step", "total", "message"), "step").alias("p")
    return events.groupBy("job_id").agg(best).select("job_id", "p.*")


def gap_sessions(words: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(media_id, start, end, n): words (media_id, ts) in sessions that a longer gap ends; append mode."""
    w = words.withWatermark("ts", late) if words.isStreaming else words
    g = w.groupBy("media_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("media_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settled_status(events: DataFrame) -> DataFrame:
    """A stream's (job_id, status), a row whenever a job's status changes; nothing follows an end state.

    events: (job_id, seq, status). The state of a job is one status and one number.
    """

    def step(key, frames: Iterator, state):
        import pandas as pd

        now, last = state.get if state.exists else (None, -1)
        before = now
        for seq, status in sorted((int(a), b) for f in frames for a, b in zip(f["seq"], f["status"])):
            if now not in ("done", "failed", "cancelled") and seq > last:
                now, last = status, seq
        state.update((now, last))
        if now != before:
            yield pd.DataFrame({"job_id": [key[0]], "status": [now]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string", "status string, seq long", "update", "NoTimeout")
