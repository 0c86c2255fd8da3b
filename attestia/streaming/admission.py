"""Admission of events with rejects as a second output: every row of the input is in exactly one of two tables.

An event has an entity, an idempotency key, a digest of its payload, a kind (the state it leads to), a time and an id. It is
`repeat` or `conflict` if its key was used before, with the same payload or another one; `late` if an earlier
micro-batch applied an event of its entity that is not before it; `illegal` if the entity's state does not allow its
kind; else `accepted`, and the entity moves. A key is used by the first event that arrives with it, whatever becomes of that. Nothing is dropped, however late
it is: state is kept by key and by entity, not by time.

Keys and entities meet their state by joins, keys are reduced by partial aggregates first, and the transitions of an
entity are folded in chunks, so that one entity may have half of all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import consensus as C
from attestia.streaming.ledger import Ledger

EVENT = "entity bigint, key string, payload string, kind string, at bigint, id bigint"
ORDER = ("at", "id")
HOUR_US = 3_600_000_000


class Admission:
    def __init__(self, spark: SparkSession, path: str, transitions: dict[str, tuple[str, ...]] | None = None, start: str = "", chunk: Column | None = None):
        """Without transitions every first use of a key is accepted. `chunk` ascends with (at, id); an hour of `at` in
        microseconds by default."""
        self.spark, self.path, self.transitions, self.start = spark, path.rstrip("/"), transitions, start
        self.chunk = F.floor(F.col("at") / HOUR_US) if chunk is None else chunk
        first = "struct<batch:bigint,at:bigint,id:bigint,payload:string>"
        last = "struct<at:bigint,id:bigint,state:string>"
        self.keys = Ledger(spark, f"{path}/keys", {"key": "string"}, {"first": (first, "min")})
        self.entities = Ledger(spark, f"{path}/entities", {"entity": "bigint"}, {"last": (last, "max"), "version": ("bigint", "sum")})

    def __call__(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; it may be run again."""
        rows = batch.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in EVENT.split(", "))])
        used = F.struct(F.lit(number).cast("long").alias("batch"), *ORDER, "payload")
        own = rows.groupBy("key").agg(F.min(used).alias("own"))
        old = self.keys.before(number, own.select("key"))
        firsts = own.join(old, "key", "left").select("key", F.coalesce("first", "own").alias("first"))
        mine = (F.col("first.batch") == number) & (F.col("first.at") == F.col("at")) & (F.col("first.id") == F.col("id"))
        same = F.col("first.payload").eqNullSafe(F.col("payload"))
        tag = F.when(F.col("key").isNull(), "no-key").when(mine & same, "new").when(same, "repeat").otherwise("conflict")
        path = f"{self.path}/keyed/batch={number}"
        rows.join(firsts.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").select(*rows.columns, tag.alias("tag")).write.mode("overwrite").parquet(path)
        keyed = self.spark.read.schema(f"{EVENT}, tag string").parquet(path)
        again = keyed.filter("tag <> 'new'")
        new = keyed.filter("tag = 'new'").drop("tag")
        if new.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():  # rows that are repeated whole
            once = new.groupBy(*new.columns).agg(F.count(F.lit(1)).alias("n"))
            more = once.filter("n > 1").select(*new.columns, F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("_n")).drop("_n")
            again, new = again.unionByName(more.withColumn("tag", F.lit("repeat"))), once.select(*new.columns)
        judged = self._judged(new, number)
        final = again.unionByName(judged).withColumn("tag", F.coalesce("tag", F.lit("accepted")))
        final.write.mode("overwrite").parquet(f"{self.path}/judged/batch={number}")
        told = self.spark.read.schema(f"{EVENT}, tag string").parquet(f"{self.path}/judged/batch={number}")
        for name, test in (("accepted", F.col("tag") == "accepted"), ("rejected", F.col("tag") != "accepted")):
            told.filter(test).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        self.keys.add(number, own.filter("key is not null").select("key", F.col("own").alias("first")))
        if self.transitions:
            last = F.struct("at", "id", F.col("kind").alias("state")).alias("last")
            self.entities.add(number, told.filter("tag = 'accepted'").select("entity", last, F.lit(1).cast("long").alias("version")))

    def _judged(self, new: DataFrame, number: int) -> DataFrame:
        """New events with their tag, null for those that are accepted."""
        if not self.transitions:
            return new.withColumn("tag", F.lit(None).cast("string"))
        state = self.entities.before(number, new.select("entity").distinct()).select("entity", "last")
        known = new.join(state, "entity", "left")
        late = F.struct("at", "id") <= F.struct("last.at", "last.id")
        marked = known.withColumns({"_late": F.coalesce(late, F.lit(False)), "_begin": F.col("last.state")}).drop("last")
        whole = marked.filter("not _late")
        legal = C.judge_guarded(whole.drop("_late"), "entity", "kind", self.start, self.transitions, *ORDER, chunk=self.chunk, begin="_begin")
        fine = legal.select(*new.columns, F.when(~F.col("legal"), "illegal").alias("tag"))
        return fine.unionByName(marked.filter("_late").select(*new.columns, F.lit("late").alias("tag")))

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{EVENT}, tag string, batch bigint").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def accepted(self) -> DataFrame:
        return self._table("accepted")

    def rejected(self) -> DataFrame:
        return self._table("rejected")
