"""A run of steps that writes their tables, records their times and rows, and can be cancelled at any time.

Each step's table is written beside its place and appears there by a rename, so
a run that is cancelled or fails leaves whole tables or none. The jobs of a run
bear its tag; cancel() stops those that run and no step begins afterwards.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import jobs
from ..storage import _file_system

STEPS = "run string, pos long, step string, elapsed double, rows long"
RECORD = "id string, at long, seq long, status string, created_at long, error string"


class Cancelled(Exception):
    """The run was cancelled; what it had not finished is gone."""


class Run:
    """Steps of one job under `path`, with a record of statuses and of step times beside their tables."""

    def __init__(self, spark: SparkSession, run: str, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.run, self.path, self.clock = spark, run, path.rstrip("/"), clock
        self.tag, self._stop, self._seq, self._pos = f"run-{run}-{uuid.uuid4().hex}", threading.Event(), 0, 0
        self._say("queued", created=int(clock()))

    # -- what is kept ------------------------------------------------------

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _say(self, status: str, error: str | None = None, created: int | None = None) -> None:
        changes = self.spark.createDataFrame([(self.run, int(self.clock()), self._seq, status, error)], "id string, at long, seq long, status string, error string")
        row = jobs.job_updated(changes).withColumn("created_at", F.lit(created).cast("long"))
        row.select(*[x.split()[0] for x in RECORD.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.path}/record")
        self._seq += 1

    def record(self) -> DataFrame:
        """(id, status, created_at, error), as jobs.job_record() has them."""
        return jobs.job_record(self.spark.read.schema(RECORD).parquet(f"{self.path}/record"))

    def steps(self) -> DataFrame:
        """(run, pos, step, elapsed, rows) of the steps that have ended; jobs.step_share() and timings_json() take it."""
        return self.spark.read.schema(STEPS).parquet(f"{self.path}/steps")

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/{step}")

    # -- running -----------------------------------------------------------

    def cancel(self) -> None:
        """Stops the run: its Spark jobs at once, and the steps that have not begun. From any thread."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self._stop.is_set():
            raise Cancelled(self.run)

    def step(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes a step's rows and rereads them; its time and number of rows are recorded."""
        self.check()
        seen, began = Observation(f"{name}-{uuid.uuid4().hex}"), time.perf_counter()
        part, target = f"{self.path}/.{name}-{uuid.uuid4().hex}", f"{self.path}/tables/{name}"
        fs, scratch = _file_system(self.spark, part)
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(part)
            self.check()
            place = self.spark._jvm.org.apache.hadoop.fs.Path(target)
            fs.mkdirs(place.getParent())
            if not fs.rename(scratch, place):
                raise FileExistsError(target)
        except Exception:
            self.check()  # a failure of a cancelled run is its cancellation
            raise
        finally:
            sc.removeJobTag(self.tag)
            fs.delete(scratch, True)
        self._append("steps", [(self.run, self._pos, name, time.perf_counter() - began, seen.get["rows"])], STEPS)
        self._pos += 1
        return self.table(name)

    def all(self, first: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame | None:
        """Runs (name, function) steps one after another, each on what the one before wrote; None if cancelled.

        Statuses: running, then done, cancelled or failed (with the error, which is raised).
        """
        self._say("running")
        rows = first
        try:
            for name, make in steps:
                self.check()
                rows = self.step(name, make(rows))
            self.check()
        except Cancelled:
            self._drop_tables()
            self._say("cancelled")
            return None
        except Exception as e:
            self._say("failed", str(e)[:500])
            raise
        self._say("done")
        return rows

    def _drop_tables(self) -> None:
        fs, where = _file_system(self.spark, f"{self.path}/tables")
        fs.delete(where, True)


class StepListener(StreamingQueryListener):
    """Times and rows of a session's streaming batches, by the query's name: `spark.streams.addListener(StepListener())`."""

    def __init__(self):
        self.batches: list[tuple[str, int, str, float, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.runId), int(p.batchId), p.name or str(p.id), p.batchDuration / 1000.0, int(p.numInputRows)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def steps(self, spark: SparkSession) -> DataFrame:
        """(run, pos, step, elapsed, rows) of the batches so far, as Run.steps() has them."""
        return spark.createDataFrame(self.batches, STEPS)
