"""Rounds of annotation, settled from their submissions: agreement, policy, novelty and the steps that follow.

A submission is a row: task_id, round_id, role (A, B, J1, J2), receipt_id, seq (order of arrival), decision (of J2) and units, an array of
(unit, dimension, value). The first submission of a role in a round counts; further ones are refused. Nulls and units
that a rater lacks are the value `null`. `attestia.streaming.rounds` does the same by micro-batches.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.operators import agreement as A
from attestia.operators.workflow import steps
from attestia.session import dealt, shared_dir, ship

KEY = ["task_id", "round_id"]
ROLES = ("A", "B", "J1", "J2")
SUBMISSION = "task_id long, round_id string, role string, receipt_id string, seq long, decision string, units array<struct<unit:string,dimension:string,value:string>>"


def first_submissions(log: DataFrame) -> DataFrame:
    """The first submission of each role and round, by a partial aggregate."""
    told = F.struct("receipt_id", "decision", "units", "seq")
    return log.filter(F.col("role").isin(*ROLES)).groupBy(*KEY, "role").agg(F.min_by(told, "seq").alias("s")).select(*KEY, "role", "s.*")


def refused(log: DataFrame, firsts: DataFrame) -> DataFrame:
    """Submissions that do not count, with the reason."""
    unknown = ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    left = log.join(firsts.select(*KEY, "role", "seq"), [*KEY, "role", "seq"], "left_anti")
    return left.withColumn("reason", F.when(unknown, "role").otherwise("occupied"))


def rounds(firsts: DataFrame) -> DataFrame:
    """A row for each round with the receipt of every role, the second judge's decision and the units of the others (`of_A`, `of_B`, `of_J1`)."""
    role = lambda name, c: F.max(F.when(F.col("role") == name, F.col(c)))
    receipts = [role(r, "receipt_id").alias(r) for r in ROLES]
    return firsts.groupBy(*KEY).agg(*receipts, role("J2", "decision").alias("decision"), *[role(r, "units").alias(f"of_{r}") for r in ROLES[:3]])


def codes(values: pa.Array) -> np.ndarray:
    """Equal values (nulls too) as equal numbers from 0."""
    return pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def groups(outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers as numbers from 0, and where each one is first."""
    _, first, number = np.unique(outer * (inner.max(initial=0) + 1) + inner, return_index=True, return_inverse=True)
    return number, first


def metrics(sides: list[pa.Array], minimum_raw: float, minimum_kappa: float, fallback: str) -> dict[str, pa.Array]:
    """units, disagreements, passed and novel of each row, whose three lists of units are those of A, B and J1.

    A submission that repeats a unit has the greatest value. Sums are those of `attestia.operators.agreement`.
    """
    rows, flat = len(sides[0]), [s.flatten().flatten() for s in sides]
    row = np.concatenate([pc.list_parent_indices(s).to_numpy(zero_copy_only=False) for s in sides]).astype(np.int64)
    side = np.repeat(np.arange(3), [len(f[0]) for f in flat])
    unit, dimension, value = (pa.chunked_array([f[k] for f in flat], pa.string()).combine_chunks() for k in range(3))
    value = pc.dictionary_encode(pa.concat_arrays([pc.fill_null(value, "null"), pa.array(["null"])]))
    rank = np.empty(len(value.dictionary), np.int64)
    rank[pc.sort_indices(value.dictionary).to_numpy()] = np.arange(len(rank))
    value = rank[value.indices.to_numpy()]
    value, null = value[:-1], value[-1]
    part, _ = groups(row, codes(dimension))  # a dimension of a row
    number, first = groups(part, codes(unit))
    given = np.full((3, len(first)), -1)
    np.maximum.at(given, (side, number), value)
    a, b = np.where(given[:2] < 0, null, given[:2])
    row, part, f, apart = row[first], part[first], given[2], a != b
    count = lambda at, n, weights=None: np.bincount(at, weights, minlength=n)
    novel = count(row[(f >= 0) & (f != a) & (f != b)], rows)
    rated = (given[:2] >= 0).any(axis=0)
    row, part, a, b, apart = row[rated], part[rated], a[rated], b[rated], apart[rated]
    parts = int(part.max(initial=-1)) + 1
    label, at = groups(np.concatenate([part, part]), np.concatenate([a, b]))
    left, right = count(label[: len(a)], len(at)), count(label[len(a) :], len(at))
    n, of = count(part, parts), np.zeros(parts, np.int64)
    of[part] = row
    chance = count(np.concatenate([part, part])[at], parts, left.astype(float) * right)
    held = n > 0  # the others have values of the judge only
    n, of, chance, d = n[held].astype(float), of[held], chance[held], count(part, parts, apart)[held]
    po, pe = 1 - d / n, chance / (n * n)
    sure = pe != 1
    raws, kappas = count(of, rows), count(of[sure], rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        raw = count(of, rows, po) / raws
        kappa = count(of[sure], rows, (po[sure] - pe[sure]) / (1 - pe[sure])) / kappas
    passed = np.where(raw < minimum_raw, False, np.where(kappas == 0, fallback == "raw-agreement", kappa >= minimum_kappa)) | (raws == 0)
    found = {"units": count(row, rows), "disagreements": count(row, rows, apart).astype(np.int64), "passed": passed, "novel": novel}
    return {name: pa.array(x) for name, x in found.items()}


def measured(found: DataFrame, minimum_raw: float, minimum_kappa: float, fallback: str) -> DataFrame:
    """Rounds that both raters have submitted, with units, disagreements, passed and novel, from Arrow batches of whole rounds.

    Turns up to `last` have been told: what has been measured for them is not measured again.
    """
    ship(found.sparkSession)
    judge, raters = F.col("J1").isNotNull(), F.col("A").isNotNull() & F.col("B").isNotNull()
    wanted = (F.col("last") < 1) | (judge & (F.col("last") < 2))
    known = ["last", *KEY, *ROLES, "decision", "before"]
    sent = found.filter(raters).withColumnRenamed("novel", "before").select(*known, *[F.when(wanted, F.col(f"of_{r}")).alias(f"of_{r}") for r in ROLES[:3]])

    def measure(batches):
        for batch in batches:
            sides = [batch.column(f"of_{r}") for r in ROLES[:3]]
            told = {n: batch.column(n) for n in known} | metrics(sides, minimum_raw, minimum_kappa, fallback)
            yield pa.RecordBatch.from_pydict(told)

    schema = sent.select(*known).schema.add("units", "long").add("disagreements", "long").add("passed", "boolean").add("novel", "long")
    return sent.mapInArrow(measure, schema).withColumn("novel", F.when(F.col("last") < 2, F.col("novel")).otherwise(F.col("before"))).drop("before")


def events(joined: DataFrame) -> DataFrame:
    """Every step that the measured rounds have reached and that was not told yet, in order (turn), with what it rests on."""
    novel = F.coalesce("novel", F.lit(0).cast("long"))
    passed = F.col("passed")
    raters, first, second = steps(passed, novel > 0, F.col("decision"))
    judge = F.col("J1").isNotNull()
    reached = [
        (F.lit(True), raters, (F.col("units"), F.col("disagreements"), passed, F.lit(None).cast("long"))),
        (judge, first, (F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("boolean"), novel)),
        (judge & (novel == 0) & F.col("J2").isNotNull() & F.col("decision").isNotNull(), second, (F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("boolean"), F.lit(None).cast("long"))),
    ]
    names = ("units", "disagreements", "passed", "novel")
    rows = [F.when(c & (F.col("last") < n), F.struct(F.lit(n).alias("turn"), s.alias("step"), F.struct(*[x.alias(k) for k, x in zip(names, told, strict=True)]).alias("told"))) for n, (c, s, told) in enumerate(reached, 1)]
    each = joined.select(*KEY, F.explode(F.array_compact(F.array(*rows))).alias("e"))
    return each.select(*KEY, "e.turn", "e.step.*", "e.told.*")


def settle(log: DataFrame, minimum_raw: float = A.MINIMUM_RAW, minimum_kappa: float = A.MINIMUM_KAPPA, fallback: str = A.UNDEFINED_FALLBACK) -> DataFrame:
    """The steps of all rounds, from a whole log of submissions, which is read once: what counts of it is a written table."""
    spark = log.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestia-rounds-{uuid.uuid4().hex}"
    first_submissions(log).write.parquet(path)
    return settled(dealt(spark.read.schema(SUBMISSION).parquet(path), *KEY), minimum_raw, minimum_kappa, fallback)


def settled(firsts: DataFrame, minimum_raw: float, minimum_kappa: float, fallback: str, last: DataFrame | None = None) -> DataFrame:
    """The steps of rounds from the submissions that count, four of a round at most; with `last` (turn and novel by round), those that are new.

    Submissions are dealt out by round, whole, and each round is settled in one row of an Arrow batch. So a
    round's units must fit a task, some times over.
    """
    found = rounds(firsts)
    if last is None:
        found = found.withColumns({"last": F.lit(0), "novel": F.lit(None).cast("long")})
    else:
        found = found.join(last.select(*KEY, F.col("turn").alias("last"), "novel"), KEY, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    return events(measured(found, minimum_raw, minimum_kappa, fallback))
