"""Durable intermediate tables, sizing and salted lookups shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.session import shared_dir, ship

#: Words in all contracts: runs of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a counted side is broadcast; beyond, a salted shuffle join does the work.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 8 << 20
#: Bytes of input that one shuffle bin may stand for.
BIN_BYTES = 64 << 20
SALTS = 16
#: Catalyst multiplies sizes that it cannot estimate; from here on an estimate says nothing.
UNKNOWN = 1 << 60
#: Bounds of what one task holds at once, for tables of very long texts: bytes of an Arrow batch, rows of a Parquet
#: reader's batch and bytes of a Parquet writer's row group. A session keeps its own values where they are smaller.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024, "parquet.block.size": 16 << 20}

_scratch: list[tuple[SparkSession, str, str]] = []
_scope = [""]


@contextlib.contextmanager
def scope(name: str):
    """Tables written inside belong to a named scope, which `sweep` can delete."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/attestia-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, _scope[-1], path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder: lost executors cannot undo it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope, when nothing lazy still reads them."""
    mine = [x for x in _scratch if x[0] is spark and x[1] == name]
    _scratch[:] = [x for x in _scratch if x not in mine]
    for _, _, path in mine:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(batches, limit: int = 4 << 20):
    """Batches of at most about `limit` bytes (or one row), so that copies of them stay small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_resident: dict = {}


def resident(key, make):
    """What a Python worker keeps between tasks: one value, the last operator's, so that memory stays bounded."""
    if "key" not in _resident or _resident["key"] is not key:
        release()
        _resident.update(key=key, value=make())
    return _resident["value"]


def release() -> None:
    """Free what an earlier operator keeps in this Python worker, and give its memory back to the system."""
    _resident.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system; Python workers live as long as their executor."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def freed(rows):
    """The rows of a generator; what this Python worker holds goes back to the system before and after them."""
    release()
    try:
        yield from rows
    finally:
        release()


def ready(spark: SparkSession) -> None:
    """Before an operator: the package is importable in Python workers, and what a task holds is bounded."""
    ship(spark)
    for name, most in BOUNDS.items():
        held = spark.conf.get(name, None)
        if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > most:
            spark.conf.set(name, str(most))


def shuffle_width(spark: SparkSession, df: DataFrame | None = None, bin_bytes: int = BIN_BYTES) -> int:
    """Bins for an explicit exchange: the configured width, more if the input's size asks for it.

    An input of unknown size (no file scan below it, or a join whose estimate multiplies) is measured by its files.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is not None:
        size = input_bytes(df)
        width = max(width, (size if size < UNKNOWN else file_bytes(df)) // bin_bytes + 1)
    return max(1, width)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return total


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes for scans; a size it does not know is a large one."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup(left: DataFrame, right: DataFrame, key: str, salt_from: Column, salts: int = SALTS) -> DataFrame:
    """Left join to a table that is unique by `key`, with hot keys of the left side dealt over `salts` tasks.

    The right side is broadcast if its counted rows are few; else it is repeated once for each salt, and never broadcast: Catalyst
    judges it by its compressed files, before it is repeated.
    """
    if broadcastable(right):
        return left.join(F.broadcast(right), key, "left")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
        .join(salted.hint("merge"), [key, "_salt"], "left")
        .drop("_salt")
    )


def broadcastable(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (written, small-row) table is proven small enough to send to every executor."""
    return input_bytes(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


