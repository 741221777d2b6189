"""Nearest neighbours by one-bit codes against brute force: results, recall, bounds, odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellside.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def distance(v, w):
    total = 0.0
    for x, y in zip(v, w, strict=True):  # sum() would compensate
        total += (x - y) * (x - y)
    return math.sqrt(total)


def plain(rows, k=10, divisor=100):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    sizes = {}
    for _, v in rows:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    dims = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if len(v) == dims]
    out = []
    for i, v in rows:
        if i % divisor == 0:
            near = sorted((distance(v.tolist(), w.tolist()), j) for j, w in rows if j != i)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clusters(n, dims, seed=0, kinds=7):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((kinds, dims))
    data = (centres[rng.integers(0, kinds, n)] + rng.standard_normal((n, dims)) * 0.4).astype(np.float32)
    data[10:40] = data[5]  # copies: ties by identifier
    return [(i, v.tolist()) for i, v in enumerate(data)]


@pytest.mark.parametrize(("dims", "block"), [(1, 50), (3, 7), (24, 100), (64, 2048)])
def test_results_equal_brute_force(spark, monkeypatch, dims, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PER_CENTRE", 60)
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    monkeypatch.setattr(neighbours, "TOGETHER", 3)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rows = clusters(700, dims)
    got = rows_of(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == plain(rows)
    monkeypatch.setattr(neighbours, "QUERIES", 2)  # several rounds
    assert rows_of(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3))) == got


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = plain(rows), rows_of(neighbours.nearest_neighbours(df))
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.99 * len(want)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    vectors, queries = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    centres, turn = neighbours.fitted(vectors[:500], 4), neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    at, codes, rests, agrees = neighbours.encode(vectors, centres, turn)
    assert codes.shape == (3000, 8)
    for sure, least in ((5.0, 1.0), (1.9, 0.9)):
        inside, width = [], []
        for c in range(4):
            mine = at == c
            low, high = neighbours.bounds((queries - centres[c]) @ turn, np.linalg.norm(queries - centres[c], axis=1), codes[mine], rests[mine], agrees[mine], sure)
            true = ((queries[:, None] - vectors[mine][None]) ** 2).sum(2)
            inside.append((low <= true) & (true <= high))
            width.append((high - low).ravel())
        assert np.concatenate([x.ravel() for x in inside]).mean() >= least
        assert np.concatenate(width).mean() < 30 * sure


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (100, None), (100, []), (100, [0.0, 0.0]), (200, [nan, 1.0]), (200, [inf, 1.0]), (300, [1.0, None]), (None, [1.0, 1.0]), (400, [1.0, 2.0, 3.0]), (5, [1.0, 2.0]), (-100, [-1.0, -0.0]), (6, [1e30, 1e-30]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "ids", "q", "k1", "dims", "nth", "spread"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(neighbours.nearest_neighbours(df)) == plain(rows)
    assert rows_of(neighbours.nearest_neighbours(df.limit(0))) == []
    assert rows_of(neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0])], SCHEMA))) == []
    few = [(0, [1.0]), (1, [2.0])]
    assert rows_of(neighbours.nearest_neighbours(spark.createDataFrame(few, SCHEMA))) == [(0, 1, 1, 1.0)]
