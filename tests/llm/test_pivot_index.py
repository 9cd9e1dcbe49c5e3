"""Top-k by the pivot-distance index against brute force over all rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storeline.llm import pivot_index
from storeline.llm.pivot_index import PivotIndex, bounds, far_apart, products, quantised, top_products

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows
         if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(v):
        if i is None or i % every:
            continue
        rank = sorted((-sum(x * y for x, y in zip(q, w)), j is None, j or 0, j) for b, (j, w) in enumerate(v) if b != a)
        out += [(i, n + 1, r[3], -r[0]) for n, r in enumerate(rank[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(n, dim=8, seed=1):
    rng = np.random.RandomState(seed)
    centres = rng.randn(6, dim) * 3
    return [(i, [float(x) for x in centres[i % 6] + rng.randn(dim) * .1]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clustered(1200)
    assert rows_of(top_products(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_hot_copies_ties_nulls_lengths(spark):
    rng = np.random.RandomState(2)
    rows = [(i, [0.5, -0.25]) for i in range(0, 900, 3)] + [(i, [float(x) for x in rng.randint(-2, 3, 2)]) for i in range(1, 600, 3)]
    rows += [(None, [0.5, -0.25]), (None, [2.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (200, [float("inf"), 0.0]),
             (350, [None, 1.0]), (400, []), (500, [1.0]), (550, [1.0, 1.0, 1.0]), (650, [2.0, 2.0]), (650, [2.0, 2.0]),
             (1000, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, vec string")
    assert rows_of(top_products(df)) == brute(rows)


def test_empty_and_few_rows(spark):
    assert top_products(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_products(spark.createDataFrame([(50, None)], SCHEMA)).count() == 0
    assert top_products(spark.createDataFrame([(50, [1.0])], SCHEMA)).count() == 0
    rows = [(50, [1.0]), (51, [2.0]), (100, [3.0])]
    assert rows_of(top_products(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_annuli_are_skipped_and_bounded(spark):
    # clusters far apart: a query's own cluster holds its results, and the bounds say so
    rows = clustered(3000)
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", quantised(F.col("embedding")).alias("vec"))
    index = PivotIndex(df, block=64, pivots=6)
    sizes = [r.m for r in index.blocks.select("m").collect()]
    assert max(sizes) <= 64 and sum(sizes) == 3000
    visited = []
    whole = index._visit
    index._visit = lambda visits: visited.append(sum(r.m for r in visits.select("m").collect())) or whole(visits)
    asked = df.where("vec_id % 50 = 0")
    assert rows_of(index.search(asked)) == brute(rows)
    assert sum(visited) < 60 * len(sizes) / 3


def test_bounds_hold(seed=4):
    rng = np.random.RandomState(seed)
    v, q = rng.randint(-300, 300, (500, 6)), rng.randint(-300, 300, (40, 6))
    pivots = far_apart(v, 5)
    d = pivot_index._distances(v, pivots)
    near = d.argmin(1)
    r = d[np.arange(500), near]
    norm = np.sqrt((v ** 2).sum(1))
    limit = bounds(q, pivots, near, r, r, norm)  # every vector a block of its own
    assert (limit >= products(q, v)).all()


@pytest.mark.parametrize("scale", [2**20, 2**29, 2**40])
def test_products_are_exact_for_large_components(scale):
    rng = np.random.RandomState(0)
    q, v = rng.randint(-scale, scale, (3, 5)), rng.randint(-scale, scale, (4, 5))
    lim = np.iinfo(np.int64)
    want = [[min(lim.max, max(lim.min, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in v] for x in q]
    assert products(q, v).tolist() == want


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = pivot_index.op12_pivot_top_k(spark, sf)
    res = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({pivot_index.SQL})").fetchall()
    assert rows_of(got) == sorted(res, key=str) and len(res) == 50
