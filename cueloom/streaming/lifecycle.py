"""Jobs as streams: their progress log as files come in, and their expiry by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "step long, total long, message string"
ENDED, FINAL = ("done", "failed"), ("done", "failed", "cancelled")


def progress_stream(spark: SparkSession, path: str, files_a_batch: int = 1000, name: str = "progress_lines") -> DataFrame:
    """(job_id, step, total, message): the lines of progress files <path>/<job_id>/<file>, as a stream.

    The file source's log of offsets sees to it that each file is read once,
    over restarts too; writers add files and leave old ones alone. Lines that
    are no JSON object, have no step, or are blank are passed over. They are
    counted: the query's progress has `lines` and `bad` under `name`.
    """
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_a_batch)).load(path)
    job = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    said = lines.select(job.alias("job_id"), F.from_json("value", PROGRESS).alias("p"))
    bad = F.col("p.step").isNull()
    return said.observe(name, F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")).where(~bad).select("job_id", "p.*")


class Expiry(StatefulProcessor):
    """Of each job the last status and when it was touched; a timer from the end of a job on, none for cancelled ones."""

    def __init__(self, max_age_ms: int):
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, seq long, touched_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        status, seq, touched = self.last.get() if self.last.exists() else (None, -1, 0)
        was = status
        for r in sorted(rows, key=lambda r: r["seq"]):
            if status not in FINAL and r["seq"] > seq:
                status, seq, touched = r["status"], r["seq"], int(r["at"].timestamp() * 1000)
        if seq >= 0:
            self.last.update((status, seq, touched))
        if status in ENDED and was not in ENDED:
            self.handle.registerTimer(touched + self.max_age_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        status, _, touched = self.last.get()
        self.last.clear()
        yield Row(job_id=key[0], status=status, touched_ms=touched)

    def close(self) -> None:
        pass


def expired_jobs(events: DataFrame, max_age_hours: float, late: str = "0 seconds") -> DataFrame:
    """(job_id, status, touched_ms) of jobs that ended max_age_hours before the watermark or earlier; append mode.

    events: a stream (job_id, seq, status, at timestamp). A job's first end
    counts; cancelled and unfinished jobs never expire. What is kept of a job
    goes with it. The rows are those of jobs.ttl_sweep() at the time of the
    watermark. Needs the RocksDB state store (see ROCKSDB).
    """
    out = StructType().add("job_id", events.schema["job_id"].dataType).add("status", "string").add("touched_ms", "long")
    keyed = events.withWatermark("at", late).groupBy("job_id")
    return keyed.transformWithState(Expiry(int(max_age_hours * 3_600_000)), out, "Append", "EventTime")
