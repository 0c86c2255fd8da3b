import math

import numpy as np
from pyspark.sql import functions as F

from attestia.llm import hardneg


def brute(rows, positives, negatives, ratio, is_anchor):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, u, label in kept:
        if is_anchor(a):
            near = [(-sum(x * y for x, y in zip(u, v, strict=True)), c, other == label) for c, v, other in kept if c != a and len(u) == len(v)]
            for p, i, _ in sorted(x for x in near if x[2])[:positives]:
                low, high, of = ratio
                fits = sorted((n, c) for n, c, same in near if not same and low * -p <= of * -n <= high * -p)
                out += [(a, i, r, c, -p, -n) for r, (n, c) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def check(spark, rows, positives=5, negatives=10, ratio=(30, 90, 100), every=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_row", F.lit(1)).withColumn("rank", F.lit("x"))
    found = hardneg.mine(frame, F.col("vec_id") % every == 0, F.col("label"), positives, negatives, ratio)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, positives, negatives, ratio, lambda i: i % every == 0)


def test_against_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 40)
    monkeypatch.setattr(hardneg, "ANCHORS", 8)
    monkeypatch.setattr(hardneg, "CHUNK", 5)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=12) + 0.5).tolist(), int(rng.integers(0, 3)) if i % 3 else 0) for i in range(260)]  # one label has most rows
    check(spark, rows)
    check(spark, rows, 2, 3, (-50, 100, 100), 7)


def test_ties_repeats_nulls_and_lengths(spark):
    same = [0.5, 0.25]
    rows = [(i, list(same), i % 2) for i in range(30)] + [(i, [0.25, 0.25], i % 3) for i in range(40, 60)]
    rows += [(5, list(same), 1), (5, [0.75, 0.0], 0), (10, list(same), 0)]  # anchors that repeat an id
    rows += [(100, None, 1), (105, same, None), (None, same, 1), (110, [None, 1.0], 1), (115, [float("nan"), 1.0], 0), (120, [float("inf"), 0.0], 1)]
    rows += [(200, [1.0], 0), (201, [2.0], 0), (202, [0.9], 1), (203, [0.5], 1), (205, [], 0), (206, [], 0), (207, [], 1)]
    check(spark, rows)
    check(spark, rows, 1, 1, (100, 100, 100))


def test_labels_of_one_group_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "GROUPS", 1)
    rng = np.random.default_rng(11)
    check(spark, [(i, rng.normal(size=4).tolist(), int(i % 4)) for i in range(80)], ratio=(0, 150, 100))
    check(spark, [(i, rng.normal(size=4).tolist(), i) for i in range(30)])  # no positives


def test_anchors_without_others_and_empty_table(spark):
    check(spark, [(0, [1.0], 1)])
    check(spark, [(0, [1.0], 1), (1, [0.5], 2)])
    check(spark, [(1, [1.0], 1), (2, [0.5], 1)])
    check(spark, [])


def test_products_and_sums_are_exact_or_saturated():
    big = np.array([[2**40, 3], [-(2**62), 2**62]], np.int64)
    assert hardneg.product(big, big).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
    assert hardneg.product(big[:1], np.array([[2**20, 5]])).tolist() == [[2**60 + 15]]
    a = np.array([2**63 - 1, -(2**63), 5], np.int64)
    assert hardneg.added(a, np.array([1, -1, -7], np.int64)).tolist() == [2**63 - 1, -(2**63), -2]


def test_windows_are_exact_for_all_signs():
    for p in range(-40, 41):
        low, high = hardneg.window(p, 30, 90, 100)
        for s in range(-60, 61):
            assert (low <= s <= high) == (30 * p <= 100 * s <= 90 * p)
