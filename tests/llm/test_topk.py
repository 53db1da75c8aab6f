import math
import random

import numpy as np
import pytest

from sieveline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k=5):
    good = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) or math.isinf(256 * x) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, a) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(good) if j != at)[:k]  # noqa: B905
            out += [(q, rank, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got_from(df, **more):
    return sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, **more).collect())


@pytest.mark.parametrize(("seed", "shard", "group"), [(1, 8192, 8192), (2, 40, 3), (3, 10, 2)])
def test_equals_brute_force(spark, seed, shard, group):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, 0.3), 0.0, 0.5]) for _ in range(8)]) for i in range(400)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1050, [0.0] * 8), (1051, [-1.0] * 8), (1100, [1.0] * 8), (1101, [0.25] * 3)]
    rows += [(2000, None), (2050, []), (2051, [None] * 8), (2100, [float("nan")] + [0.0] * 7), (2101, [float("inf")] * 8), (None, [1.0] * 8), (7, rows[7][1]), (50, rows[50][1])]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    assert got_from(df, shard=shard, group=group) == brute(rows)


@pytest.mark.parametrize(("largest", "shard"), [(1e4, 8192), (1e6, 20), (1e9, 30), (1e17, 8192), (1e200, 40), (1e305, 8192)])
def test_large_components_and_mixed_lengths_are_exact(spark, largest, shard):
    """Sums in doubles, 64-bit and Python's integers; one outlier among common vectors, and
    lengths from 1 to thousands."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) * (largest if i % 7 == 3 else 1) for _ in range(r.choice([1, 6, 6, 6, 9]))]) for i in range(160)]
    rows += [(200, [0.0] * 3000 + [1.0]), (201, [0.0] * 2000 + [largest / 4] * 1001), (250, [largest, -largest]), (251, [largest, -largest])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA.replace("float", "double"))
    assert got_from(df, shard=shard) == brute(rows)


def test_rows_that_share_an_id_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])] + [(2, [0.25, 0.0])] * 9 + [(50, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    assert got_from(df) == brute(rows)


def test_few_rows_are_scored_in_full():
    """Of random directions, which no block bound can tell apart, a query scores a small part
    in full; of sparse ones it never meets most."""
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(8192, 64)) / 8)
    sparse = np.where(r.random((8192, 64)) < 0.05, x, 0)
    for rows, most in ((x, 0.35), (sparse, 0.3)):
        lens, (_, dims) = (rows != 0).sum(axis=1), np.nonzero(rows)
        part = topk.Shard(np.arange(8192), np.zeros(8192, np.int64), np.ones(8192, np.int64), lens, dims, rows[rows != 0])
        counts = []
        for q in range(0, 8192, 400):
            best, d = topk.Best(5), np.flatnonzero(rows[q])
            counts.append(part.search(d, rows[q][d], (q, 0), best))
            score = rows @ rows[q]
            assert [(-s, i) for s, i, _ in best.items] == [(int(score[i]), i) for i in sorted((i for i in range(8192) if i != q), key=lambda i: (-score[i], i))[:5]]  # noqa: B023
        assert np.median(counts) < most * 8192


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0], "s", 1), (1, [1.0], "s", 1)], SCHEMA)
    assert [tuple(x) for x in topk.top_k(df).collect()] == [(0, 1, 1, 65536)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.limit(1)).count() == 0
