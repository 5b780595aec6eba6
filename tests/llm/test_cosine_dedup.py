import math
import random

import numpy as np
import pytest

from topspin.llm import cosine_dedup

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """``(id, links, component, kept)`` of every row, from all pairs."""
    fine = [v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v in rows]
    dim = max((len(v) for (_, v), f in zip(rows, fine, strict=True) if f), default=1)
    m = np.array([np.pad(v, (0, dim - len(v))) if f else np.zeros(dim) for (_, v), f in zip(rows, fine, strict=True)])
    m = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)
    m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    reach = np.arange(len(rows))
    while (new := np.array([min([reach[i], *reach[near[i]]]) for i in range(len(rows))])).tolist() != reach.tolist():
        reach = new
    least = [min((rows[j][0] for j in np.flatnonzero(reach == reach[i]) if rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted((repr((r[0], int(near[i].sum()), least[i], r[0] == least[i])) for i, r in enumerate(rows)))


def clusters(rng, groups, dim, spread):
    rows = []
    for _ in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        rows += [[c + rng.gauss(0, spread) for c in centre] for _ in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id int, v string").repartition(3)
    return sorted(repr(tuple(r)) for r in cosine_dedup.near_duplicates(vectors, **kw).collect())


def test_equals_all_pairs_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(2)
    vectors = clusters(rng, 60, 8, 0.12)
    vectors += [None, [], [0.0] * 8, [None] * 8, [1.0, None], [NAN] * 8, [INF, *[1.0] * 7], [1e300] * 8, [1e-300] * 8, [3.0], [5.0, 0.0], [-0.0, 2.0]]
    vectors += vectors[:5] * 3 + [[2 * x for x in vectors[0]], [-x for x in vectors[0]]]
    rows = [(i + 10, v) for i, v in enumerate(vectors)]
    rows += [(12, vectors[7]), (12, vectors[2]), (None, vectors[3]), (None, [9.0, *[-9.0] * 7])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile", [2, 7])
def test_large_buckets_are_cut_into_cells(spark, monkeypatch, tile):
    monkeypatch.setattr(cosine_dedup, "TILE", tile)
    monkeypatch.setattr(cosine_dedup, "EVEN", 4)
    rng = random.Random(tile)
    rows = list(enumerate(clusters(rng, 6, 5, 0.03) + [[1.0 + 0.001 * i, 1.0, 0.0, 0.0, 0.001 * i] for i in range(60)]))
    assert run(spark, rows) == brute(rows)


def test_tables_follow_the_bound():
    for n in (1, 100, 10_000, 10**9):
        bits, tables = cosine_dedup.tables_for(n)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - agree) ** tables <= cosine_dedup.MISS
        assert n / 2**bits <= 2 * cosine_dedup.EVEN


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine of 0.9501 among many vectors, with several bits a table."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 48))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9501
    rows = [(2 * i + k, v.tolist()) for i in range(4000) for k, v in enumerate((a[i], c * a[i] + math.sqrt(1 - c * c) * b[i]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cosine_dedup.near_duplicates(vectors).where("n_links = 1 and component_id = vec_id - vec_id % 2").count()
    assert found >= 7990


def test_empty_table(spark):
    assert run(spark, []) == []
