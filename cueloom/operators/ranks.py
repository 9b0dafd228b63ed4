"""Ranks in an order over all rows, without a window over all rows.

Rows with equal times are cells. A running sum over cells inside a block of
time, over blocks inside a span of blocks, and over the spans gives a cell's
offset; inside a cell rows are numbered by their ids, in blocks of these. What one
task scans is a block's cells, a span's blocks, or a row for each span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a block, blocks of a span, ids of a cell.
BLOCK, SPAN, IDS = 3600, 4096, 1 << 16
#: The time of rows without one: they come first.
NO_TIME = -(1 << 60)


def _before(rows: DataFrame, n: str, *keys: str, by: list[str]) -> Column:
    """The sum of n over the rows before, by keys."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _offsets(cells: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """cells (keys, at, ..., n) with `offset`: the rows of the same keys in the cells before."""
    cells = cells.withColumn("__block", F.floor(F.col("at") / BLOCK)).withColumn("__span", F.floor(F.col("__block") / SPAN))
    blocks = cells.groupBy(*keys, "__span", "__block").agg(F.sum("n").alias("__n"))
    spans = blocks.groupBy(*keys, "__span").agg(F.sum("__n").alias("__m"))
    if keys:
        spans = spans.withColumn("__s", _before(spans, "__m", *keys, by=["__span"]))
    else:  # one array, an entry for each span (half a year)
        every = F.array_sort(F.collect_list(F.struct("__span", "__m")))
        summed = F.transform("a", lambda x, i: F.struct(x["__span"].alias("__span"), F.aggregate(F.slice("a", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["__m"]).alias("__s")))
        spans = spans.agg(every.alias("a")).select(F.explode(summed).alias("x")).select("x.*")
    blocks = blocks.withColumn("__b", _before(blocks, "__n", *keys, "__span", by=["__block"])).join(spans.select(*keys, "__span", "__s"), [*keys, "__span"])
    cells = cells.withColumn("__c", _before(cells, "n", *keys, "__span", "__block", by=by))
    out = cells.join(blocks.select(*keys, "__span", "__block", "__b", "__s"), [*keys, "__span", "__block"])
    return out.withColumn("offset", F.col("__c") + F.col("__b") + F.col("__s")).drop("__c", "__b", "__s", "__span", "__block")


def earlier(rows: DataFrame, *keys: str, at: str) -> DataFrame:
    """(keys, at, offset): for each time of rows with the same keys, how many lie before it. Keys and times must not be null."""
    cells = rows.groupBy(*keys, F.col(at).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return _offsets(cells, list(keys), ["at"]).select(*keys, F.col("at").alias(at), "offset")


def numbered(rows: DataFrame, at: str, id: str, name: str) -> DataFrame:
    """rows with `name`: their place from 0 in the order of the time `at` (nulls first), then the whole number `id`."""
    cell = [F.coalesce(F.col(at), F.lit(NO_TIME)).alias("__at"), F.floor(F.col(id) / IDS).alias("__ids")]
    r = rows.select("*", *cell)
    cells = r.groupBy(F.col("__at").alias("at"), F.col("__ids").alias("ids")).agg(F.count(F.lit(1)).alias("n"))
    offsets = _offsets(cells, [], ["at", "ids"]).select(F.col("at").alias("__at"), F.col("ids").alias("__ids"), "offset")
    inside = F.row_number().over(Window.partitionBy("__at", "__ids").orderBy(id)) - 1
    return r.withColumn("__n", inside).join(offsets, ["__at", "__ids"]).withColumn(name, F.col("__n") + F.col("offset")).select(*rows.columns, name)
