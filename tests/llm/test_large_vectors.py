"""op3 with components of any size that a long holds."""

import numpy as np
import pytest

from cueloom.llm import knn


def frame(spark, vecs):
    return spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>")


def test_large_components_take_part(spark):
    rng = np.random.default_rng(3)
    vecs = {i: rng.normal(size=4).tolist() for i in range(300)}
    vecs |= {301: [65536.0, 0.5, 0.5, 0.5], 302: [-2.0**36, 1.0, 0.0, 0.0], 303: [2.0**35, 2.0**35, -(2.0**35), -(2.0**35)], 304: [0.0, 3.0, 2.0**33, -(2.0**33)]}
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in vecs.items()}
    want = []
    for q in (100, 200):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    got = knn.top_k(frame(spark, vecs), lambda i: i.isin(100, 200)).collect()
    assert sorted(map(tuple, got)) == want


def test_large_queries_beyond_the_bound_of_a_long(spark):
    # The largest components bound the scores by 2**66, while each score fits.
    vecs = {100: [2.0**23, 0.0], 101: [0.0, 2.0**23], 102: [3.0, 2.0**22], 103: [-1.0, 2.0], 104: [1.0, 1.0]}
    whole = {i: [int(x * 1024) for x in v] for i, v in vecs.items()}
    scores = sorted((-sum(a * b for a, b in zip(whole[100], v)), i) for i, v in whole.items() if i != 100)
    got = knn.top_k(frame(spark, vecs), lambda i: i == 100).collect()
    assert sorted(map(tuple, got)) == [(100, n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_a_score_that_does_not_fit_fails(spark):
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|int64"):
        knn.top_k(frame(spark, {100: [2.0**30, 0.0], 101: [2.0**30, 0.0]}), lambda i: i == 100).collect()


def test_a_score_below_all_longs_that_is_not_among_the_best(spark):
    vecs = {100: [2.0**30, 0.0], 101: [-(2.0**30), 0.0]} | {i: [1.0 + i, 2.0] for i in range(10)}
    whole = {i: [int(x * 1024) for x in v] for i, v in vecs.items()}
    scores = sorted((-sum(a * b for a, b in zip(whole[100], v)), i) for i, v in whole.items() if i != 100)[:10]
    got = knn.top_k(frame(spark, vecs), lambda i: i == 100).collect()
    assert sorted(map(tuple, got)) == [(100, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    with pytest.raises(Exception, match="Overflow"):
        knn.top_k(frame(spark, {i: v for i, v in vecs.items() if i > 99}), lambda i: i == 100).collect()
