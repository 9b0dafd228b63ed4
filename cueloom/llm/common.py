"""Tables, Arrow batch size, working columns and ASCII word rules of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import release, shared_dir, tables_written, written

__all__ = ["release", "shared_dir", "tables_written", "written"]

#: The white space of the contracts, as bytes and as a Java class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch; a longer text has a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes: whole texts may be long.

    Plans are lazy, so the setting has to stay with the session; a smaller one is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key)
    if not found.isdigit() or int(found) > size:
        spark.conf.set(key, str(size))


def text_bytes(col: Column) -> Column:
    """A text's UTF-8 length, null counting as empty."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


_working: dict = {"on": None, "caches": [], "bytes": 0}
#: Bytes of text after which a task of many groups gives memory back.
EASE_BYTES = 64 << 20


def cached(clear) -> None:
    """Registers what empties a worker's cache of an operator."""
    _working["caches"].append(clear)


def working(on: str) -> None:
    """Called where a Python task begins. Workers outlive tasks, so what another operator has cached goes back to the system."""
    if _working["on"] not in (None, on):
        for clear in _working["caches"]:
            clear()
        trim()
    _working["on"] = on


def eased(size: int) -> None:
    """Called after `size` bytes of text have been worked on: now and then freed memory goes back to the system."""
    _working["bytes"] += size
    if _working["bytes"] > EASE_BYTES:
        _working["bytes"] = 0
        trim()


def trim() -> None:
    """Returns freed memory to the system, which the allocators keep otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def own(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under the same names."""
    have = {c.lower() for c in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in have])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these for working columns, none of which df has in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out
