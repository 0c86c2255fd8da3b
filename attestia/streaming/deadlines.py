"""Deadlines that fire by themselves, and state with a time to live.

A log has rows (round, kind, at): a round opens, and each of the needed roles arrives. A round that has all roles by its
deadline is `reached` when the last of them came; one that has not is `expired` at its deadline, as soon as event time (the
latest time seen, less the allowed lateness) has passed it, whether or not any row of the round arrives then.
Rows that come after their round has ended are rejects. Closed rounds leave the state `ttl` after their end; a row that comes
later still is one of a round that has not opened, and waits for it.

A batch is reduced to a row for each round first, by a partial aggregate: a round with half of all rows is a row from each
task. The batch form is `outcomes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.streaming.ledger import Ledger

ROW = "round bigint, kind string, at bigint"
OUTCOME = "round bigint, outcome string, at bigint"


def _times(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    return rows.filter("round is not null").groupBy("round").agg(first("open").alias("opened"), *[first(r).alias(f"t{i}") for i, r in enumerate(roles)])


def _judged(n: int, life: int) -> tuple[Column, Column, Column]:
    """The deadline, whether all n roles came by it, and when the last did."""
    deadline = F.col("opened") + life
    came = F.col("opened").isNotNull()
    for i in range(n):
        came = came & F.coalesce(F.col(f"t{i}") <= deadline, F.lit(False))
    times = [F.col(f"t{i}") for i in range(n)]
    return deadline, came, F.greatest(*times) if n > 1 else times[0]


def outcomes(rows: DataFrame, roles: tuple[str, ...], life: int, lateness: int = 0) -> DataFrame:
    """round, outcome and its time, of a whole log, as a range rule."""
    deadline, came, at = _judged(len(roles), life)
    mark = rows.agg((F.max("at") - lateness).alias("mark"))
    found = _times(rows, roles).join(F.broadcast(mark))  # one row
    due = F.col("opened").isNotNull() & (deadline <= F.col("mark"))
    return found.filter(came | due).select("round", F.when(came, "reached").otherwise("expired").alias("outcome"), F.when(came, at).otherwise(deadline).alias("at"))


class Deadlines:
    def __init__(self, spark: SparkSession, path: str, roles: tuple[str, ...], life: int, lateness: int = 0, ttl: int | None = None):
        times = {"opened": ("bigint", "min")} | {f"t{i}": ("bigint", "min") for i in range(len(roles))}
        self.spark, self.path, self.roles, self.life, self.lateness, self.ttl = spark, path.rstrip("/"), roles, life, lateness, ttl
        self.rounds = Ledger(spark, f"{path}/rounds", {"round": "bigint"}, times | {"ended": ("bigint", "min")})
        self.mark = Ledger(spark, f"{path}/mark", {"one": "int"}, {"at": ("bigint", "max")})

    def __call__(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; it may be run again."""
        rows = batch.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in ROW.split(", "))])
        self.mark.add(number, rows.agg(F.max("at").alias("at")).select(F.lit(1).alias("one"), "at"))
        newest = self.mark.before(number + 1).first()["at"]  # one number
        mark = None if newest is None else newest - self.lateness
        state = self.rounds.before(number)
        ended = state.filter("ended is not null").select("round", F.col("ended").alias("_ended"))
        over = rows.join(ended, "round", "left")
        refused = over.filter("_ended is not null or round is null").select(*rows.columns)
        refused.write.mode("overwrite").parquet(f"{self.path}/refused/batch={number}")
        fresh = _times(over.filter("_ended is null").drop("_ended"), self.roles).withColumn("ended", F.lit(None).cast("long"))
        deadline, came, at = _judged(len(self.roles), self.life)
        open_ = self.rounds.merged(state.filter("ended is null").unionByName(fresh))
        due = F.col("opened").isNotNull() & F.coalesce(deadline <= F.lit(mark).cast("long"), F.lit(False))
        told = open_.filter(came | due).select("round", F.when(came, "reached").otherwise("expired").alias("outcome"), F.when(came, at).otherwise(deadline).alias("at"))
        told.write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={number}")
        closed = self.spark.read.schema(OUTCOME).parquet(f"{self.path}/outcomes/batch={number}")
        none = [F.lit(None).cast("long").alias(c) for c in ("opened", *[f"t{i}" for i in range(len(self.roles))])]
        delta = fresh.unionByName(closed.select("round", *none, F.col("at").alias("ended")))
        keep = None if self.ttl is None or mark is None else F.coalesce(F.col("ended") > mark - self.ttl, F.lit(True))
        self.rounds.add(number, delta, keep)

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(f"{OUTCOME}, batch bigint").option("basePath", f"{self.path}/outcomes").parquet(f"{self.path}/outcomes")

    def refused(self) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, batch bigint").option("basePath", f"{self.path}/refused").parquet(f"{self.path}/refused")
