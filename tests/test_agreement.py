import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestia.operators import agreement as A


def kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    pe = sum(left[k] * right[k] for k in left) / n / n
    return po, None if pe == 1 else (po - pe) / (1 - pe)


def scores(spark, pairs):
    rows = spark.createDataFrame([("d", a, b) for a, b in pairs], "dimension string, a string, b string")
    return A.agreement(rows).first()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from("xyzw")), min_size=1, max_size=30))
def test_kappa_by_definition_and_symmetric(spark, pairs):
    got, turned = scores(spark, pairs), scores(spark, [(b, a) for a, b in pairs])
    raw, k = kappa(pairs)
    assert math.isclose(got.raw, raw) and got.n == len(pairs)
    assert (got.kappa is None) == (k is None) == (turned.kappa is None)
    if k is not None:
        assert math.isclose(got.kappa, k, abs_tol=1e-12) and math.isclose(got.kappa, turned.kappa, abs_tol=1e-12)


def test_nulls_are_a_value_and_policies(spark):
    units = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "b", "b")], "id int, l string, r string")
    got = A.agreement(A.pairs(units, {"d": (F.col("l"), F.col("r"))})).first()
    assert (got.n, got.disagreements) == (3, 1)
    one = spark.range(1).select(
        A.passes(F.lit(0.95), F.lit(None).cast("double")).alias("fallback"),
        A.passes(F.lit(0.95), F.lit(None).cast("double"), fallback="none").alias("strict"),
        A.passes(F.lit(0.89), F.lit(1.0)).alias("raw"),
        A.passes(F.lit(0.95), F.lit(0.79)).alias("kappa"),
        A.passes(F.lit(0.9), F.lit(0.8)).alias("both"),
    ).first()
    assert tuple(one) == (True, False, False, False, True)


def test_empty_tables_agree(spark):
    none = A.agreement(spark.createDataFrame([], "dimension string, a string, b string"))
    assert none.count() == 0
    m = A.macro(none).first()
    assert (m.units, m.exact, m.macro_kappa) == (0, True, None)
