"""Centroid clustering against a plain version in Python's integers, and against its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import kmeans, queries, sql


def plain(rows, k, rounds, dims, scale):
    """[(id, cluster, distance)], centroids and inertia of rows (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cs = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), x in zip(kept, of) if x == j]
            cs[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return out, cs, [sum(d for _, c, d in out if c == j) for j in range(len(cs))]


def as_set(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("top", [1.0, 3e7, 1e12, 1e30])
def test_equals_plain_integers(spark, top):
    r = random.Random(5)
    rows = [(i, [r.uniform(-top, top) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 300)]  # a third are copies
    rows += [(500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [1.0] * 5 + [float("nan")]), (504, [1.0] * 5 + [float("-inf")]), (None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    found = kmeans.cluster(df, 9, 4, 6, 256)
    want, cs, inertia = plain(rows, 9, 4, 6, 256)
    assert found.centroids == cs and found.inertia == inertia
    assert as_set((x.vec_id, x.cluster, x.distance) for x in found.rows.collect()) == as_set((i, c, d if d < 2**63 else None) for i, c, d in want)
    assert found.rows.columns == ["vec_id", "cluster", "distance"]


def test_bounds_choose_the_arithmetic():
    """At the edges of float64 and int64 the distances stay exact."""
    for top in (2**23, 2**24 + 1, 2**29, 2**30 + 1, 2**40):
        x = np.array([[top, -top, 1.0, 0.0], [top - 1, 3 - top, 7.0, 2.0]])
        cs = [[-top, top, 0, 1], [top, -top, 1, 1], [5, 5, 5, 5]]
        j, d = kmeans.nearest(x, cs)
        assert [(int(b), int(a)) for a, b in zip(j, d)] == [min((sum((int(p) - q) ** 2 for p, q in zip(v, c)), k) for k, c in enumerate(cs)) for v in x]


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(20)] + [(90, [9.0, 9.0])], "vec_id long, embedding array<float>")
    found = kmeans.cluster(df, 5, 3, 2)
    assert found.centroids.count([0, 0]) >= 4
    assert {x.cluster for x in found.rows.where("vec_id < 20").collect()} == {found.centroids.index([0, 0])}
    assert sum(found.inertia) == (162 if [9, 9] not in found.centroids else 0)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5]), (2, [0.75])], "vec_id int, embedding array<float>")
    found = kmeans.cluster(df, 40, 5, 1, 256)
    assert len(found.centroids) == 2 and found.inertia == [0, 0]
    assert found.rows.schema["vec_id"].dataType.simpleString() == "int"
    none = kmeans.cluster(df.limit(0), 40, 5, 1, 256)
    assert none.centroids == [] and kmeans.with_inertia(none).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql.oracle_sql()['op11_centroid_clustering']}) ORDER BY 1").fetchall()
    mine = queries.op11_centroid_clustering(spark, sf_dir)
    assert mine.columns == cols and [f.dataType.simpleString() for f in mine.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert [tuple(r) for r in mine.orderBy("vec_id").collect()] == want
    assert mine.select(F.sum("distance")).first()[0] == want[0][4]
