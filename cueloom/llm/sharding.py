"""Sharding: a reproducible shuffle with computable shard and slot.

Rows get global numbers 0..n-1 in the order of their key's hash: the hash's first
bits make buckets, about one for BUCKET_ROWS rows, their sizes are summed up, and
a row's number is its bucket's first number plus its rank there. Buckets follow
the order of the hash, so numbers don't depend on how many there are. A keyed Feistel network permutes the
numbers. Its two halves are numbers below a = ceil(sqrt(n)), so its domain a * a
exceeds n by at most 2 * sqrt(n) + 1; a result of n or more is walked along its
cycle until it falls below n. Row at place p of the permutation goes to shard
p % shards, slot p // shards: counts differ by one at most and slots have no gaps.

The whole path is DataFrame expressions. It depends on the rows alone, not on
files, partitions or the order of reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, own

SHARDS = 24
SEED = 20240229
ROUNDS = 6
#: Rows of a bucket, and the least and most bits of its number: 2 ** 18 sizes of some 20 bytes are broadcast at most.
BUCKET_ROWS, MIN_BITS, MAX_BITS = 1 << 16, 8, 18
#: Steps of a cycle: up to 900 rows none is longer than 62; beyond that each further step has a chance of 2 / sqrt(n). A longer one is an error.
WALK = 64


def feistel(x: Column, a: Column, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..a*a-1."""

    def turned(k: int):
        return lambda s: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], F.lit(seed), F.lit(k)), a), a).alias("r"))

    state = F.struct(F.floor(x / a).cast("long").alias("l"), (x % a).alias("r"))
    for k in range(rounds):
        # A one-element array binds the round's state, so that it isn't written out twice a round.
        state = F.transform(F.array(state), turned(k))[0]
    return F.transform(F.array(state), lambda s: s["l"] * a + s["r"])[0]


def root_above(n: Column) -> Column:
    """The smallest a with a * a >= n, for n below 2 ** 53."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return F.when(a * a < n, a + 1).when((a - 1) * (a - 1) >= n, a - 1).otherwise(a)


def permuted(x: Column, n: Column, a: Column, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of number x among 0..n-1, by cycle walking."""
    first = feistel(x, a, seed, rounds)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, seed, rounds)))
    over = F.raise_error(F.concat(F.lit(f"a cycle of over {WALK} steps; use another seed than {seed}"))).cast("long")
    return F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(over))[0]


def bucket_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (rows // BUCKET_ROWS).bit_length()))


def numbered(df: DataFrame, keys: list[str], number: str, total: str, bits: int | None = None) -> DataFrame:
    """df with the columns number (0..n-1 in the order of the keys' hash, then the keys) and total (n).

    Without `bits` the rows are counted for the number of buckets.
    """
    h, bucket, at, rank, first, size = fresh(df, "h", "bucket", "at", "rank", "first", "size")
    bits = bucket_bits(df.count()) if bits is None else bits
    hashed = df.withColumn(h, F.xxhash64(*[F.col(f"`{k}`") for k in keys]))
    hashed = hashed.withColumn(bucket, (F.shiftright(h, 64 - bits) if bits else F.lit(0)).cast("int"))
    sizes = hashed.groupBy(bucket).agg(F.count(F.lit(1)).alias(size))
    every = Window.orderBy(at)
    # At most 2 ** MAX_BITS rows, whatever the input; broadcast for that reason.
    offsets = sizes.select(F.col(bucket).alias(at), size).select(
        at,
        (F.sum(size).over(every) - F.col(size)).alias(first),
        F.sum(size).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(h, *[F.col(f"`{k}`") for k in keys])))
    met = ranked.join(F.broadcast(offsets), F.col(bucket) == F.col(at))
    return met.withColumn(number, F.col(first) + F.col(rank) - 1).drop(h, bucket, at, first, rank)


def assign(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS, bits: int | None = None) -> DataFrame:
    """df with shard (int) and slot (long); shards hold equally many rows, to one.

    keys: columns that tell rows apart. Rows that agree on all keys get
    consecutive numbers, in no stated order among themselves. Null keys are
    keys like any other, and very long ones are compared whole. Columns named shard or slot are replaced; others pass
    through. An empty table gives none.
    """
    df = own(df, "shard", "slot")
    number, total, side, place = fresh(df, "number", "total", "side", "place")
    rows = numbered(df, keys, number, total, bits).withColumn(side, F.transform(F.array(F.col(total)), root_above)[0])
    placed = rows.withColumn(place, permuted(F.col(number), F.col(total), F.col(side), seed, rounds))
    return placed.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col(place) / shards).cast("long")).drop(number, total, side, place)
