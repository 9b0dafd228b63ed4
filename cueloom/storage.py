"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, as in tests, may leave it unset; it gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="cueloom-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


_paths: list[str] = []


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """What lies at path goes with the application."""
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it.

    This cuts the lineage like checkpoint() does, but the table is columnar and
    compressed. Lost executors lose nothing of it. The table stays until
    release(), and at most as long as the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> list[str]:
    """Paths that written() has made in this process and release() has not removed, oldest first."""
    return list(_paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of written(); what is computed from them must have been saved."""
    for path in paths:
        fs, where = _file_system(spark, path)
        fs.delete(where, True)
        if path in _paths:
            _paths.remove(path)
