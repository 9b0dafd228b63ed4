"""A stored statistics table with upserts: rows by day, deltas, compaction, and roll-ups that merge.

    manifest-00000012.json   what the table is: parts by day, and the deltas since
    part-<id>/day=10440/     rows of a day, one a key
    roll-<id>/day=10440/     the day's partial sums by status and language
    delta-<id>/rows/day=...  upserted rows, and
    delta-<id>/keys/         which keys they have, with day and version

A change of the table is the next manifest, which appears by a rename that fails
if it is there already; its writer then starts over from the newer one. Readers
of an older manifest keep their files until vacuum().

A reader opens the parts of the days it asks for and no others. Of deltas it
reads all keys, as a key may have moved to another day, but rows of these days
alone. Sums over whole days come from roll-ups, less the rows that deltas
replace, plus the rows that they bring (sums of doubles may so differ in the last
place from those of the rows).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.jobs import DAY, MEASURES
from ..storage import _file_system

#: The day of rows without a time.
NO_DAY = -(1 << 31)


class StatsStore:
    """A table of rows (key, created_at, status, target_language, MEASURES, ...) under a shared path.

    by: columns that order a key's rows within one append; of the rest the later
    append counts, as in an upsert. days: how many make one folder `day=`, for
    tables with few rows a day; readers and writers must agree on it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", by: tuple[str, ...] = ("created_at",), days: int = 1):
        self.spark, self.path, self.schema, self.key, self.by = spark, path.rstrip("/"), schema, key, by
        self.seconds = days * DAY

    # -- manifests ---------------------------------------------------------

    def _fs(self):
        return _file_system(self.spark, self.path)[0]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """The newest manifest; that of an empty table before the first append."""
        fs, top = self._fs(), self._at("")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        found = sorted(n for n in names if n.startswith("manifest-"))
        if not found:
            return {"n": 0, "batches": 0, "days": {}, "deltas": []}
        stream = fs.open(self._at(found[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, change) -> dict:
        """Writes the next manifest, change(newest one); again if another writer was first."""
        while True:
            old = self.manifest()
            new = change(old) | {"n": old["n"] + 1}
            fs, scratch, target = self._fs(), self._at(f".{uuid.uuid4().hex}"), self._at(f"manifest-{old['n'] + 1:08d}.json")
            out = fs.create(scratch)
            out.write(json.dumps(new).encode())
            out.close()
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(scratch, target, none)
                return new
            except Exception as e:
                fs.delete(scratch, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    # -- writing -----------------------------------------------------------

    def _day(self) -> Column:
        return F.coalesce(F.floor(F.col("created_at") / self.seconds), F.lit(NO_DAY)).cast("int")

    def append(self, rows: DataFrame) -> None:
        """Upserts rows. Keys must not be null; of a key that occurs twice the row with the largest `by` counts, equal ones in any order."""
        name = f"delta-{uuid.uuid4().hex}"
        one = rows.select(*self.schema.names).where(F.col(self.key).isNotNull())
        others = F.struct(*[c for c in self.schema.names if c != self.key])
        one = one.groupBy(self.key).agg(F.max_by(others, F.struct(*self.by)).alias("r")).select(self.key, "r.*").select(*self.schema.names)
        where = f"{self.path}/{name}/rows"
        one.withColumn("day", self._day()).hint("rebalance", "day").write.partitionBy("day").parquet(where)
        self._rows([where], with_day=True).select(self.key, "day").write.parquet(f"{self.path}/{name}/keys")
        self._commit(lambda m: m | {"batches": m["batches"] + 1, "deltas": [*m["deltas"], {"name": name, "batch": m["batches"] + 1}]})

    def compact(self) -> None:
        """Folds the deltas into parts and roll-ups of the days that they touch; other days keep their files."""
        m = self.manifest()
        if not m["deltas"]:
            return
        keys = self._latest_keys(m)
        gone = self._parts(m, list(m["days"]), ("day",)).join(keys.select(self.key), self.key, "left_semi").select("day")  # where replaced rows lie
        days = sorted(r.day for r in keys.select("day").union(gone).distinct().collect())  # a number a day
        part, roll = f"part-{uuid.uuid4().hex}", f"roll-{uuid.uuid4().hex}"
        rows = self._current(m, days).withColumn("day", self._day())
        rows.hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.path}/{part}")
        stored = self._rows([f"{self.path}/{part}"], with_day=True)
        _partial(stored, "day").write.partitionBy("day").parquet(f"{self.path}/{roll}")
        left = {r.day for r in stored.select("day").distinct().collect()}
        folded = {x["name"] for x in m["deltas"]}

        def change(now: dict) -> dict:
            if now["days"] != m["days"]:
                raise RuntimeError("the table was compacted meanwhile")
            kept = {d: x for d, x in now["days"].items() if int(d) not in days}
            return now | {"days": kept | {str(d): [part, roll] for d in days if d in left}, "deltas": [x for x in now["deltas"] if x["name"] not in folded]}

        self._commit(change)

    def vacuum(self) -> list[str]:
        """Removes older manifests and what the newest doesn't name; readers of older ones must have ended."""
        m, fs = self.manifest(), self._fs()
        named = {x for pair in m["days"].values() for x in pair} | {x["name"] for x in m["deltas"]} | {f"manifest-{m['n']:08d}.json"}
        gone = [s.getPath().getName() for s in fs.listStatus(self._at("")) if s.getPath().getName() not in named]
        for name in gone:
            fs.delete(self._at(name), True)
        return gone

    # -- reading -----------------------------------------------------------

    def _rows(self, paths: list[str], with_day: bool = False, base: str | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("day", "integer") if with_day else self.schema)
        read = self.spark.read.schema(StructType([*self.schema.fields]).add("day", "integer"))
        found = (read.option("basePath", base) if base else read).parquet(*paths)
        return found if with_day else found.drop("day")

    def _parts(self, m: dict, days: list, also: tuple[str, ...] = ()) -> DataFrame:
        """Compacted rows of days, which are opened by their folders."""
        by_part: dict[str, list[str]] = {}
        for d in days:
            if str(d) in m["days"]:
                by_part.setdefault(m["days"][str(d)][0], []).append(f"{self.path}/{m['days'][str(d)][0]}/day={d}")
        out = self._rows([], True)
        for part, paths in by_part.items():
            out = out.unionByName(self._rows(paths, True, f"{self.path}/{part}"))
        return out if "day" in also else out.drop("day")

    def _latest_keys(self, m: dict) -> DataFrame:
        """(key, day, batch): which append counts for each key of the deltas."""
        kind = StructType([self.schema[self.key]]).add("day", "integer")
        out = None
        for x in m["deltas"]:
            one = self.spark.read.schema(kind).parquet(f"{self.path}/{x['name']}/keys").withColumn("batch", F.lit(x["batch"]))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], kind.add("batch", "integer"))
        return out.groupBy(self.key).agg(F.max_by("day", "batch").alias("day"), F.max("batch").alias("batch"))

    def _from_deltas(self, m: dict, keys: DataFrame, days: list[int] | None) -> DataFrame:
        out = self._rows([])
        for x in m["deltas"]:
            rows = self._rows([f"{self.path}/{x['name']}/rows"], True)
            rows = rows if days is None else rows.where(F.col("day").isin(days))  # partitions: other days aren't opened
            mine = keys.where(F.col("batch") == x["batch"]).select(self.key)
            out = out.unionByName(rows.drop("day").join(mine, self.key, "left_semi"))
        return out

    def _current(self, m: dict, days: list[int] | None) -> DataFrame:
        keys = self._latest_keys(m)
        parts = self._parts(m, list(m["days"]) if days is None else days)
        return parts.join(keys.select(self.key), self.key, "left_anti").unionByName(self._from_deltas(m, keys, days)).select(*self.schema.names)

    def _known_days(self, m: dict) -> list[int]:
        """The days that occur: those of parts, and those of deltas as their folders say."""
        fs, out = self._fs(), {int(d) for d in m["days"]}
        for x in m["deltas"]:
            names = [s.getPath().getName() for s in fs.listStatus(self._at(f"{x['name']}/rows"))]
            out |= {int(n[4:]) for n in names if n.startswith("day=")}
        return sorted(out)

    def read(self, since: int | None = None) -> DataFrame:
        """The latest row of each key; with `since`, of those created then or later, from the files of their days alone."""
        m = self.manifest()
        if since is None:
            return self._current(m, None)
        days = [d for d in self._known_days(m) if d != NO_DAY and d >= since // self.seconds]
        return self._current(m, days).where(F.col("created_at") >= since)

    def partial(self, since: int) -> DataFrame:
        """(status, target_language, n, MEASURES): sums over the rows created at `since` or later.

        Whole days of parts come from roll-ups, the day of `since` and deltas from rows.
        """
        m = self.manifest()
        keys, cut = self._latest_keys(m), since // self.seconds
        whole = [d for d in m["days"] if int(d) > cut]
        names = ["status", "target_language", "n", *MEASURES]
        rolled = self.spark.createDataFrame([], self._roll_schema())
        for roll in sorted({m["days"][d][1] for d in whole}):
            mine = [f"{self.path}/{roll}/day={d}" for d in whole if m["days"][d][1] == roll]
            rolled = rolled.unionByName(self.spark.read.schema(self._roll_schema()).parquet(*mine))
        less = _partial(self._parts(m, whole).join(keys.select(self.key), self.key, "left_semi"))
        less = less.select("status", "target_language", *[(-F.col(c)).alias(c) for c in names[2:]])
        days = [d for d in self._known_days(m) if d != NO_DAY and d >= cut]
        edge = self._parts(m, [cut]).join(keys.select(self.key), self.key, "left_anti")
        more = _partial(edge.unionByName(self._from_deltas(m, keys, days)).where(F.col("created_at") >= since))
        every = rolled.select(names).unionByName(less.select(names)).unionByName(more.select(names))
        return every.groupBy("status", "target_language").agg(*[F.sum(c).alias(c) for c in names[2:]])

    def _roll_schema(self) -> StructType:
        return _partial(self._rows([])).schema

    def summary(self, now: int, days: int = 30) -> DataFrame:
        """What jobs.stats_summary says of the table."""
        p = self.partial(now - days * DAY)
        of = lambda s: F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0))
        n = F.coalesce(F.sum("n"), F.lit(0))
        some = lambda c: F.when(n > 0, c)
        return p.agg(n.alias("jobs"), some(of("done")).alias("done"), some(of("failed")).alias("failed"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in MEASURES])

    def by_language(self, now: int, days: int = 30) -> DataFrame:
        """What jobs.stats_by_language says of the table."""
        g = self.partial(now - days * DAY).where("target_language is not null").groupBy("target_language").agg(F.sum("n").alias("n"), F.coalesce(F.sum("audio_seconds"), F.lit(0)).alias("audio_seconds"))
        return g.where("n > 0").orderBy(F.desc("n"), "target_language")


def _partial(rows: DataFrame, *also: str) -> DataFrame:
    """Sums of rows by status and language, which add up."""
    return rows.groupBy(*also, "status", "target_language").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])
