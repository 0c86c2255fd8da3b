"""Total orders without a task that holds a table: dense numbers, and digests of all rows in order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.session import shared_dir

#: Bytes that a range partition stands for.
RANGE_BYTES = 64 << 20


def ranges(rows: DataFrame) -> int:
    """Range partitions for a table: the session's shuffle width, more if its size asks for it."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, min(size // RANGE_BYTES + 1, 100_000))


def numbered(rows: DataFrame, *order: Column | str, out: str = "number") -> DataFrame:
    """The rows with dense numbers from 1 in a total order, which may be that of a collation.

    Rows are dealt into ranges of the order, which are written once, so that every reader sees the same ranges; a row's number is
    its place in its range after the rows of all ranges before, of which only the counts meet. Rows that are equal in
    the order get different numbers, which of them first is open.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestia-ranges-{uuid.uuid4().hex}"
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select(F.struct("*").alias("_row"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    named.repartitionByRange(ranges(rows), *names).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(named.schema.add("_part", "integer")).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return dealt.withColumn("_place", place).join(F.broadcast(first), "_part").select("_row.*", (F.col("_first") + F.col("_place")).alias(out))


def digest(lines: DataFrame, line: Column, *order: Column | str, between: str = "") -> DataFrame:
    """n and the SHA-256 of all lines, in order, joined by `between`.

    A plain SHA-256 is made from its first byte to its last, so one task reads the lines; they are sorted on disk if they
    don't fit, and go through the hash a batch at a time, so that task's memory does not grow with the table.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    text = lines.select(line.cast("binary").alias("_line"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    join = between.encode()

    def read(batches):
        import hashlib

        import pyarrow as pa

        n, whole = 0, hashlib.sha256()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                whole.update(join + x if n else x)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.hexdigest()], pa.string())], ["n", "digest"])

    names = [f"_k{i}" for i in range(len(keys))]
    told = text.filter("_line is not null").repartition(1).sortWithinPartitions(*names).select("_line").mapInArrow(read, "n long, digest string")
    empty = F.sha2(F.lit(b""), 256)
    return told.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("digest"), empty).alias("digest"))


def chained(rows: DataFrame, key: str, state: str, *order: str, version: str = "version", before: str = "before") -> DataFrame:
    """The rows with their version (from 1) and the state of the row before, in the order of each key, of any number of rows a key.

    As `consensus.chain`, but keys are cut: rows lie in ranges of (key, order), each range is numbered for itself, and a key that
    goes on in the next range hands over its count and last state. At most one key goes on from range to range, so what
    is handed over is two rows for each range. `order` must tell all rows of a key apart.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestia-chains-{uuid.uuid4().hex}"
    named = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(state).alias("_state"), F.struct(*order).alias("_order"))
    named.repartitionByRange(ranges(rows), "_key", "_order").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(named.schema.add("_part", "integer")).parquet(path)
    ends = dealt.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("_state"), "_order").alias("_last"))
    many = ends.groupBy("_key").agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").drop("_parts")
    cut = ends.join(F.broadcast(many), ends["_key"].eqNullSafe(many["_key"]), "left_semi")  # a key for each range at most
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = cut.select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"), F.last("_last").over(earlier).alias("_given")
    )
    own = Window.partitionBy("_part", "_key").orderBy("_order")
    placed = dealt.withColumns({"_place": F.row_number().over(own), "_prior": F.lag(F.struct("_state")).over(own)})
    joined = placed.join(F.broadcast(handed), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    prior = F.when(F.col("_place") > 1, F.col("_prior")).otherwise(F.col("_given"))
    return joined.select("_row.*", (F.col("_place") + F.coalesce("_from", F.lit(0))).alias(version), prior["_state"].alias(before))
