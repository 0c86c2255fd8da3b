"""Structured Streaming: the task state machine and idempotency by key, run as available-now streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from attestia.session import shared_dir, ship

RESULT = "user_id long, state string, version int, rejected int"
STATE = "state string, version int, rejected int, ms long, event_id long"


def machine(events: DataFrame, transitions: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """The state, version and rejected transitions of each user after every micro-batch that touches it.

    Within a micro-batch events apply in the order of time and id. An event older than the last one applied is
    late: it counts as rejected, like any other transition that the state does not allow.
    """
    ship(events.sparkSession)
    legal = {a: frozenset(b) for a, b in transitions.items()}

    def advance(key, frames, state):
        now = state.get if state.exists else (start, 0, 0, -(1 << 62), -1)
        at, version, rejected, ms, last = now
        batch = pd.concat(frames).sort_values(["ms", "event_id"])
        for kind, when, i in zip(batch.event_type, batch.ms, batch.event_id, strict=True):
            late = (when, i) <= (ms, last)
            if late or kind not in legal.get(at, ()):
                rejected += 1
            else:
                at, version = kind, version + 1
            if not late:
                ms, last = int(when), int(i)
        state.update((at, version, rejected, ms, last))
        yield pd.DataFrame({"user_id": [key[0]], "state": [at], "version": [version], "rejected": [rejected]})

    keyed = events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"))
    return keyed.groupBy("user_id").applyInPandasWithState(advance, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def source(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A file stream over a Parquet table (a file or a folder of files) with the schema that it has now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    read = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("maxFilesPerTrigger", files_per_batch)
    return read.parquet(f"{folder}/{name}") if status.isDirectory() else read.option("pathGlobFilter", name).parquet(folder)


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run an available-now stream to its end; each micro-batch is a folder of the result table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/attestia-stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    running = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def run_to_end(spark: SparkSession, folder: str, name: str, transitions: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """The last state of every user once the stream has read all there is."""
    rows = to_table(machine(source(spark, folder, name), transitions, start), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("state", "version", "rejected"), "batch").alias("r")).select("user_id", "r.*")


def arrivals(parts: list[DataFrame], step, path: str) -> None:
    """Feed parts to a stream as they arrive: each is appended to a log, and an available-now run takes it up.

    `step(batch, number)` gets the micro-batches. Log and checkpoint are in `path`, so the runs continue each other.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{path}/log")
        take_up(part.sparkSession, part.schema, step, path)


def deliveries(spark: SparkSession, folders: list[str], schema: str, step, path: str) -> None:
    """The same for parts that are folders of Parquet files: their files are moved into the log, none is read or written for it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    log = hadoop.Path(f"{path}/log")
    files = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(log)
    for n, folder in enumerate(folders):
        part = hadoop.Path(folder)
        there = [f for f in (files.listStatus(part) if files.exists(part) else []) if f.getPath().getName().endswith(".parquet")]
        if not there:  # a part without rows arrives too
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/log")
        for found in there:
            name = found.getPath().getName()
            if not files.rename(found.getPath(), hadoop.Path(log, f"{n}-{name}")):
                raise OSError(f"cannot move {found.getPath()} into {log}")
        take_up(spark, schema, step, path)


def take_up(spark: SparkSession, schema, step, path: str) -> None:
    rows = spark.readStream.schema(schema).parquet(f"{path}/log")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's log, checkpoint, state and results, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/attestia-{name}-{uuid.uuid4().hex}"
