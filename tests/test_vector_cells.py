"""Exact search through cells: equal to brute force, few cells on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    usable = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v]
    out = {}
    for i, q in usable:
        if asked(i):
            scores = sorted((-round(float(q @ v), 6), j) for j, v in usable if len(v) == len(q))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def clustered(n, rng):
    centres = rng.normal(size=(20, 8)) * 10
    return [(i, [float(x) for x in (centres[i % 20] + rng.normal(size=8) * 0.05).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 16, 64])
def test_equals_brute_force(spark, pivots, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "ROWS", 50)
    monkeypatch.setattr(vectors, "PACK", 7)
    rng = np.random.default_rng(3)
    rows = clustered(400, rng) + [(1000 + i, [float(round(x)) for x in rng.normal(size=8)]) for i in range(100)]  # with ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (None, [1.0] * 8), (2003, [0.0] * 8), (2004, [1.0, 2.0]), (2005, [3.0, 1.0]), (2010, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, lambda i: i % 5 == 0, 4)
    found = got(vectors.top_k(df, F.col("vec_id") % 5 == 0, 4))
    assert found.keys() == want.keys()
    for i, pairs in want.items():
        assert [j for j, _ in found[i]] == [j for j, _ in pairs] and np.allclose([s for _, s in found[i]], [s for _, s in pairs], atol=2e-6)


def test_few_cells_are_read(spark):
    """On clustered vectors a query meets a small share of the cells, and nothing of it passes the driver."""
    rows = clustered(2000, np.random.default_rng(5))
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cells, blocks = vectors.build_cells(df)
    queries = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = {i: pairs[-1][1] for i, pairs in brute(rows, lambda i: i % 10 == 0, 5).items()}
    limits = spark.createDataFrame(list(best.items()), "query_id long, threshold double")
    more = vectors.routes(queries.join(limits, "query_id"), cells, True).count()
    assert (200 + more) / (200 * len(cells.radii)) < 0.25
    assert blocks.count() >= len(cells.radii)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert vectors.top_k(df.limit(0), F.col("vec_id") == 1).count() == 0
    assert vectors.top_k(df, F.col("vec_id") == 2).count() == 0
    assert [tuple(r) for r in vectors.top_k(df, F.col("vec_id") == 1).collect()] == [(1, 1, 1, 5.0)]
