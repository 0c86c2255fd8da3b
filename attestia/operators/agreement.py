"""Inter-annotator agreement over decision units: raw agreement, Cohen's kappa, policies, novelty, differences.

A pair table has one row for each unit that two raters decided: `dimension`, `a` and `b` (nulls are the value
`null`). Everything is grouped aggregation: one scan counts the contingency table, which is small, and the rest are its sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default metric policy.
MINIMUM_RAW, MINIMUM_KAPPA, UNDEFINED_FALLBACK = 0.9, 0.8, "raw-agreement"


def pairs(units: DataFrame, dimensions: dict[str, tuple[Column, Column]], keep: list[str] | None = None) -> DataFrame:
    """One row for each unit and dimension from columns of two raters' values side by side."""
    each = [F.struct(F.lit(d).alias("dimension"), value(a).alias("a"), value(b).alias("b")) for d, (a, b) in dimensions.items()]
    return units.select(*(keep or []), F.inline(F.array(*each)))


def value(c: Column) -> Column:
    """Canonical text of a decision; null and missing are the same value."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two raters' units (keys, field, value) side by side; a unit that only one has shows a null."""
    a = left.select(*keys, "field", F.col("value").alias("a"))
    b = right.select(*keys, "field", F.col("value").alias("b"))
    return a.join(b, [*keys, "field"], "full_outer").withColumnRenamed("field", "dimension")


def contingency(paired: DataFrame, *keys: str) -> DataFrame:
    """How often each pair of values occurs for each key: keys, a, b, n. Tables of parts of the pairs add up."""
    return paired.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def scores(cells: DataFrame, *keys: str) -> DataFrame:
    """n, disagreements, raw and kappa (null where chance agreement is complete) of each key's contingency table."""
    n, apart = F.col("n"), ~F.col("a").eqNullSafe(F.col("b"))
    # Each cell counts once for either rater's label, so that one pass gives both marginals.
    nothing = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("a").alias("label"), n.alias("l"), nothing.alias("r"), F.when(apart, n).otherwise(nothing).alias("d")),
        F.struct(F.col("b").alias("label"), nothing.alias("l"), n.alias("r"), nothing.alias("d")),
    )
    labels = cells.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in "lrd"])
    totals = labels.groupBy(*keys).agg(
        F.sum("l").alias("n"), F.sum("d").alias("disagreements"), F.sum(F.col("l").cast("double") * F.col("r")).alias("chance")
    )
    n = F.col("n").cast("double")
    po, pe = 1 - F.col("disagreements") / n, F.col("chance") / (n * n)
    return totals.select(*keys, "n", "disagreements", po.alias("raw"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def agreement(paired: DataFrame, dimension: str = "dimension", dimensions: tuple[str, ...] | None = None) -> DataFrame:
    """n, disagreements, raw and kappa (null where chance agreement is complete) for each dimension.

    With `dimensions` there is a row for each of them: one without pairs agrees entirely and has no kappa.
    """
    found = scores(contingency(paired, dimension), dimension)
    if dimensions is None:
        return found
    every = paired.sparkSession.createDataFrame([(d,) for d in dimensions], f"{dimension} string")
    zero = F.lit(0).cast("long")
    return every.join(found, dimension, "left").select(
        dimension, F.coalesce("n", zero).alias("n"), F.coalesce("disagreements", zero).alias("disagreements"), F.coalesce("raw", F.lit(1.0)).alias("raw"), "kappa"
    )


def macro(scored: DataFrame, *keys: str) -> DataFrame:
    """units, disagreements, exact agreement, mean raw agreement and mean of the defined kappas over all dimensions (of each key)."""
    return scored.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("units"),
        F.coalesce(F.sum("disagreements"), F.lit(0)).alias("disagreements"),
        F.coalesce(F.bool_and(F.col("disagreements") == 0), F.lit(True)).alias("exact"),
        F.avg("raw").alias("macro_raw"),
        F.avg("kappa").alias("macro_kappa"),
    )


def passes(
    raw: Column, kappa: Column, minimum_raw: float = MINIMUM_RAW, minimum_kappa: float = MINIMUM_KAPPA, fallback: str = UNDEFINED_FALLBACK
) -> Column:
    """Policy gate: an undefined kappa passes only if the policy falls back on raw agreement."""
    return F.when(raw < minimum_raw, False).when(kappa.isNull(), F.lit(fallback == "raw-agreement")).otherwise(kappa >= minimum_kappa)


def novel(units: DataFrame, final: str, first: str, second: str) -> Column:
    """How many final values neither rater gave, as an aggregate; null-safe."""
    f, a, b = value(F.col(final)), value(F.col(first)), value(F.col(second))
    return F.coalesce(F.sum(((f != a) & (f != b)).cast("long")), F.lit(0))


def differences(final: DataFrame, source: DataFrame, keys: list[str], fields: list[str], weight: Column | None = None) -> DataFrame:
    """Per row of `final`: 0 if all fields equal the source row's, else 1; a missing source row counts `weight`."""
    other = source.select(*keys, F.struct(*fields).alias("_source"), F.lit(True).alias("_there"))
    same = F.struct(*fields).eqNullSafe(F.col("_source"))
    missing = F.lit(1) if weight is None else weight
    return final.join(other, keys, "left").withColumn(
        "differences", F.when(F.col("_there").isNull(), missing).otherwise(F.when(same, 0).otherwise(1))
    ).drop("_source", "_there")
