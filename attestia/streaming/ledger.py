"""Keyed state of a stream that merges: what micro-batches add is written, and folded when it is read.

Each micro-batch writes one delta under its own number, so a batch that is run again replaces what it wrote the first
time. The state before a batch is the merge (sum, min or max of each column, by key) of the deltas before it; every
`every` batches they are folded into one base. Merging is a partial aggregate before its shuffle, so a key that half of all rows
have costs a row for each task. Rows that `keep` no longer holds for, as of a mark in event time, leave at the next fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


class Ledger:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], values: dict[str, tuple[str, str]], every: int = 16, unique: bool = False):
        """keys: names and types; values: names with their types and merges. With `unique`, a key comes once in all batches, so nothing is merged."""
        self.spark, self.path, self.keys, self.values, self.every = spark, path.rstrip("/"), list(keys), values, every
        self.unique = unique
        self.types = keys | {n: t for n, (t, _) in values.items()}
        self.schema = ", ".join(f"`{n}` {t}" for n, t in self.types.items())

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def merged(self, rows: DataFrame) -> DataFrame:
        if self.unique:
            return rows.select(*self.types)
        return rows.groupBy(*self.keys).agg(*[MERGES[how](n).cast(t).alias(n) for n, (t, how) in self.values.items()])

    def _parts(self, batch: int) -> DataFrame:
        base = batch // self.every * self.every
        names = [f"base={base}"] * (base > 0) + [f"delta={b}" for b in range(base, batch)]
        found = [f"{self.path}/{n}" for n in names if self._exists(n)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in self.types.items()])

    def before(self, batch: int, touched: DataFrame | None = None) -> DataFrame:
        """The state that batches before this one left, of all keys or of those that share columns with `touched`."""
        rows = self._parts(batch)
        return self.merged(rows if touched is None else rows.join(touched, touched.columns, "left_semi"))

    def delta(self, batch: int) -> DataFrame:
        """What a batch has added."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/delta={batch}")

    def add(self, batch: int, delta: DataFrame, keep: Column | None = None) -> None:
        """What this batch adds, merged; `keep` is applied when the batches so far are folded."""
        self.merged(delta).write.mode("overwrite").parquet(f"{self.path}/delta={batch}")
        if (batch + 1) % self.every == 0:
            whole = self.merged(self._parts(batch).unionByName(self.delta(batch)))
            (whole if keep is None else whole.filter(keep)).write.mode("overwrite").parquet(f"{self.path}/base={batch + 1}")
