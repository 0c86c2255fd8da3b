import math

import numpy as np
from pyspark.sql import functions as F

from attestia.llm import vafile


def brute(rows, k, is_query):
    """Top k by Python integers; every row is a candidate, and queries of one id share their k best."""
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    pooled = {}
    for q, a in kept:
        if is_query(q):
            pooled.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in kept if c != q and len(a) == len(b))
    return {(q, n): (c, -s) for q, scored in pooled.items() for n, (s, c) in enumerate(sorted(scored)[:k], 1)}


def check(spark, rows, k=10):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").drop("none")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.search(frame, F.col("vec_id") % 5 == 0, k).collect()}
    assert got == brute([r[:2] for r in rows], k, lambda q: q % 5 == 0)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(400)]
    check(spark, rows)


def test_ties_repeats_nulls_and_lengths(spark):
    same = [0.25, -0.5, 0.125]
    rows = [(i, list(same), 0) for i in range(60)]
    rows += [(100, None, 1), (105, [None, 1.0, 2.0], 1), (110, [float("nan"), 1.0, 1.0], 1), (115, [float("inf"), 0.0, 0.0], 1), (None, same, 1)]
    rows += [(10, [5.0, 0.0, 0.0], 0), (10, [5.0, 0.0, 0.0], 0), (11, [-9.0, 0.0, 0.0], 2), (200, [1.0], 0), (201, [2.0], 0), (205, [], 0), (300, [1e4, 1e4, 1e4], 0)]
    check(spark, rows)
    check(spark, rows, k=1)


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.25, 0.0], 0), (1, [0.875, 0.0], 0), (1, [0.875, 0.0], 0), (2, [0.5, 0.0], 0), (5, [1.0, 1.0], 0), (5, [0.0, 2.0], 0)]
    check(spark, rows)
    check(spark, rows, k=2)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e4, 1e9):
        vectors = np.floor(rng.normal(size=(500, 48)) * scale)
        vectors[:, 3] = 7.0
        queries = np.floor(rng.normal(size=(20, 48)) * scale)
        block = vafile.Block(np.arange(500), vectors)
        over = block.bounds(queries) - queries @ vectors.T
        assert (over >= 0).all() and over.mean() < 0.2 * np.abs(queries @ vectors.T).max()


def test_fewer_rows_than_k_and_none(spark):
    check(spark, [(0, [1.0], 0), (5, [2.0], 0), (7, [0.0], 0)])
    check(spark, [(0, [1.0], 0)])
    check(spark, [])


def test_large_components_stay_exact():
    block = vafile.Block(np.array([1, 2, 3]), np.array([[2.0**40, 3.0], [2.0**40, 2.0], [0.0, 0.0]]))
    q = np.array([2.0**20, 1.0])
    assert block.best(9, q, block.bounds(q[None])[0], 2) == [(2**60 + 3, 1), (2**60 + 2, 2)]


def test_contenders_hold_everyone_s_best():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 30, 400)
    vectors = rng.integers(0, 2, (400, 3)).astype(float)
    left = vafile.contenders(ids, vectors, 4)
    assert len(left) < 400
    for q in range(30):
        for v in vectors[:40]:
            best = lambda rows, q=q, v=v: sorted((-(vectors[r] @ v), ids[r]) for r in rows if ids[r] != q)[:4]
            assert best(range(400)) == best(left.tolist())
    assert len(vafile.contenders(np.arange(10_000), np.ones((10_000, 2)), 4)) == 5
    assert vafile.contenders(np.array([3, 3]), np.ones((2, 0)), 1).tolist() == [0]


def test_stored_cells_bound_as_their_block_does():
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(size=(300, 20)) * 1e3)
    block = vafile.Block(np.arange(300), vectors)
    again = vafile.Block.stored(block.cells.tobytes(), np.ascontiguousarray(block.middle - block.width / 2).tobytes(), block.width.tobytes(), float(block.reach))
    queries = np.floor(rng.normal(size=(9, 20)) * 1e3)
    assert np.allclose(again.bounds(queries), block.bounds(queries), rtol=1e-9) and (again.bounds(queries) >= queries @ vectors.T).all()


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(3000)] + [(i, [0.5] * 24, 0) for i in range(3000, 4500)]  # a third share one vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.search(frame, F.col("vec_id") % 100 == 0, 5).collect()}
    points = np.array([r[1] for r in rows])
    whole = np.floor(1024 * points)
    for q in (0, 100, 2900, 3000, 4400):
        own = whole @ whole[q]
        best = sorted((-int(own[i]), i) for i in range(4500) if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]
