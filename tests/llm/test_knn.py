import math
import random

import numpy as np
import pytest

from topspin.llm import knn


def brute(rows, queries, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in [r for r in ok if queries(r[0])]:
        scores = sorted(((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in ok if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=10, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in knn.top_k(df, df.where("vec_id % 10 = 0"), k, **more).collect())
    assert got == brute(rows, lambda i: i % 10 == 0, k)
    return got


@pytest.mark.parametrize(("pivots", "group"), [(1, 2048), (16, 2048), (2, 5)])
def test_matches_brute_force_with_ties_copies_and_unusable_vectors(spark, monkeypatch, pivots, group):
    monkeypatch.setattr(knn, "GROUP", group)
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "PACK", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.3).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(80)] + [(400, None), (410, [None] * 8), (420, [float("nan")] * 8), (430, [float("inf")] + [0.0] * 7), (440, [0.0] * 8), (450, [1.0, 2.0])]
    check(spark, rows, pivots=pivots)


def test_far_blocks_are_left_out(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(4) * 50
    rows = [(i, (centres[i % 4] + rng.normal(size=4) * 0.1).tolist()) for i in range(400)]
    check(spark, rows, k=3)


def test_few_rows_large_values_and_none(spark):
    assert check(spark, [(10, [1e6, -1e6]), (11, [2e6, 5e5])]) == [(10, 1, 11, 1536 * 10**12 * 1024 * 1024 // 1024)]
    assert check(spark, [(10, [1.0])]) == []
    assert check(spark, [(10, None)]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, df).count() == 0


def test_products_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(i, [4e6] * 3) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        knn.top_k(df, df)
    df = spark.createDataFrame([(i, [1.7e6 + i] * 3) for i in range(4)], "vec_id long, embedding array<double>")
    assert knn.top_k(df, df.where("vec_id = 0"), 1).first().score == 3 * 1024**2 * 1_700_000 * 1_700_003


def test_merge_prefers_smaller_ids():
    random.seed(1)
    q, s, i = knn._merge(np.array([1, 1, 1, 2]), np.array([5, 5, 5, 1]), np.array([9, 3, 7, 4]), 2)
    assert (q.tolist(), s.tolist(), i.tolist()) == ([1, 1, 2], [5, 5, 1], [3, 7, 4])


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (20, [3.0, 0.0]), (20, [2.0, 0.0])] + [(21, [0.5, 0.0])] * 30 + [(None, [9.0, 9.0]), (22, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in knn.top_k(df, df.where("vec_id = 10"), 5).collect())
    one = [(10, 1, 20, 3072 * 1024), (10, 2, 20, 2048 * 1024), (10, 3, 10, 1024 * 1024), (10, 4, 21, 512 * 1024), (10, 5, 21, 512 * 1024)]
    assert got == sorted(one * 2)  # the query is there twice, and its copy is a candidate
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.top_k(df, df.where("vec_id = 0"), 2).collect()] == [(0, 1, 1, 943104 // 1024 * 1024), (0, 2, 1, 524288)]


def test_repeated_ids_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(rng.randrange(40), [rng.choice([0.25, 0.5, -1.0, 2.0]) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 10 == 0:
            scores = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(rows) if n != at)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:6])]
    got = [tuple(r) for r in knn.top_k(df, df.where("vec_id % 10 = 0"), 6, pivots=5).collect()]
    assert sorted(got) == sorted(want)
    outside = spark.createDataFrame([(3, [7.0, 0.0, 0.0]), (3, [7.0, 0.0, 0.0])], df.schema)
    scores = sorted((-7168 * int(1024 * w[0]), i) for i, w in rows)[:2]
    assert sorted(tuple(r) for r in knn.top_k(df, outside, 2).collect()) == sorted([(3, r + 1, i, -s) for r, (s, i) in enumerate(scores)] * 2)
