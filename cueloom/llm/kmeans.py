"""Centroid clustering of integer vectors, exact to the last bit.

Vectors are cut into blocks once and written. A round sends the centroids (k
times dims integers) to the blocks, finds the nearest of each vector from
|x|^2 - 2 x.c + |c|^2 with one matrix product a block, and adds up the vectors of
each centroid with treeAggregate: k sums a task, combined in stages, so neither
a shuffle of vectors nor a group ever forms, whatever share of them is alike.

float64 holds whole numbers below 2^53, and so does every number on the way if
dims * (max|x| + max|c|)^2 is below it. Blocks beyond that bound are computed in
64-bit integers where those suffice, else in Python's.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import written

#: Numbers below these are exact in float64 and in int64.
EXACT, LONG = 2**53, 2**63
#: Vectors of one block: its distances to 40 centroids take 1.3 MB.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Clusters:
    """rows: (id, cluster, distance); centroids: their components; inertia: the distances summed up by centroid."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def usable(vec: str, dims: int):
    """Whether a vector has dims components, none null or non-finite."""
    x = F.col(f"`{vec}`")
    return F.coalesce((F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def _blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """(ids, payload, n): blocks of floor(scale * x) as float64, in which any such number of a double is exact."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
            q = np.floor(scale * x)
            for i in range(0, len(q), BLOCK_ROWS):
                part = q[i : i + BLOCK_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), b.column(0).slice(i, len(part))), pa.array([part.tobytes()], pa.binary()), pa.array([len(part)], pa.int64())],
                    ["ids", "payload", "n"],
                )

    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(cut, f"ids array<{kind}>, payload binary, n long")


def _whole(floats):
    """float64 numbers without fractions as Python integers."""
    import numpy as np

    out = np.empty(floats.shape, object)
    out[...] = [[int(v) for v in row] for row in floats.tolist()] if floats.size else out
    return out


def nearest(x, centroids: list[list[int]]):
    """(clusters, distances) of a block: the nearest centroid by squared distance, the smaller number among equals.

    x: float64 whole numbers, a row a vector. Distances are int64, or Python integers where these don't suffice.
    """
    import numpy as np

    dims = x.shape[1]
    most = int(np.abs(x).max(initial=0)) + max((abs(v) for c in centroids for v in c), default=0)
    if dims * most * most < EXACT:
        c = np.array(centroids, "f8")
        d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
        d = d.astype("i8")
    else:
        small = dims * most * most < LONG
        whole = x.astype("i8") if small else _whole(x)
        d = np.empty((len(x), len(centroids)), "i8" if small else object)
        for j, c in enumerate(centroids):
            away = whole - np.array(c, "i8" if small else object)[None, :]
            d[:, j] = (away * away).sum(1)
    cluster = d.argmin(1)
    return cluster, d[np.arange(len(d)), cluster]


def sums(x, cluster, distance) -> dict[int, list]:
    """{cluster: [number of vectors, their component sums, their distances' sum]} of a block, in Python integers."""
    import numpy as np

    out = {}
    exact = len(x) * int(np.abs(x).max(initial=0)) < EXACT
    for j in np.unique(cluster).tolist():
        mine = cluster == j
        total = [int(v) for v in x[mine].sum(0)] if exact else [sum(column) for column in zip(*_whole(x[mine]).tolist())]
        out[j] = [int(mine.sum()), total, sum(distance[mine].tolist())]
    return out


def merged(a: dict[int, list], b: dict[int, list]) -> dict[int, list]:
    """Sums of two parts, neither of which is changed."""
    out = dict(a)
    for j, (n, total, far) in b.items():
        out[j] = [out[j][0] + n, [u + v for u, v in zip(out[j][1], total)], out[j][2] + far] if j in out else [n, total, far]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 1, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """k centroids of the vectors' floor(scale * component), moved `rounds` times, and every vector's nearest one.

    Centroids start as the vectors whose SHA-256 of `seed:id` is smallest, in
    that order. A round moves each to the floor of its vectors' mean; one without
    vectors stays. Of equally near ones the smaller number counts.

    Vectors that are null, have another length than dims or hold null or
    non-finite components take no part and have no row; nor do those with a
    component that isn't finite once scaled. Repeated rows are vectors of their
    own; where they share an id the smaller vector starts first. A null id takes
    part and is the last to start. With fewer than k vectors there are fewer
    centroids, without any no rows. A distance beyond a long is null (it is
    compared exactly all the same). Other columns are left behind.
    """
    kept = vectors.where(usable(vec_col, dims)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    kept = kept.where(~F.exists("v", lambda v: F.abs(v * float(scale)) == float("inf")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k vectors
    centroids = [[_floor(scale, v) for v in r.v] for r in first]
    blocks = written(_blocks(kept, dims, scale), "clustering")
    stored = blocks.select("payload").rdd.map(lambda r: bytes(r.payload))

    def totals(now):
        def add(acc, payload):
            import numpy as np

            x = np.frombuffer(payload, "<f8").reshape(-1, dims)
            return merged(acc, sums(x, *nearest(x, now)))

        return stored.treeAggregate({}, add, merged)

    for _ in range(rounds if first else 0):
        for j, (n, total, _) in totals(centroids).items():
            centroids[j] = [t // n for t in total]
    ends = totals(centroids) if first else {}
    inertia = [ends[j][2] if j in ends else 0 for j in range(len(centroids))]

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for ids, payload in zip(b.column(0), b.column(1)):
                j, d = nearest(np.frombuffer(payload.as_py(), "<f8").reshape(-1, dims), centroids)
                far = pa.array(d) if d.dtype != object else pa.array([v if v < LONG else None for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(j, pa.int32()), far], ["id", "cluster", "distance"])

    out = StructType().add(id_col, kept.schema["id"].dataType).add("cluster", IntegerType()).add("distance", LongType())
    return Clusters(blocks.select("ids", "payload").mapInArrow(assign, out), centroids, inertia)


def _floor(scale: int, v: float) -> int:
    import math

    return math.floor(scale * v)


def centroid_digest(centroid: list[int]) -> str:
    """Lowercase hex SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: Clusters) -> DataFrame:
    """found.rows with cluster_inertia, inertia (null beyond a long) and centroid_sha256."""
    import json

    fits = lambda n: n if n < LONG else None
    rows = [[fits(n), centroid_digest(c)] for n, c in zip(found.inertia, found.centroids)]
    # k entries as one literal: a map lookup a row in place of a join.
    facts = F.from_json(F.lit(json.dumps([{"n": n, "sha": sha} for n, sha in rows])), "array<struct<n:bigint,sha:string>>")
    of = F.get(facts, F.col("cluster"))
    return found.rows.withColumn("cluster_inertia", of["n"]).withColumn("inertia", F.lit(fits(sum(found.inertia))).cast("long")).withColumn("centroid_sha256", of["sha"])
