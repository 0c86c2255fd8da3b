"""File lists as sources: paths, sizes and digests of files, and their root digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import ordered


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (relative to the folder) and content of the files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    base = path.rstrip("/")
    return read.select(F.regexp_replace("path", rf"^.*?\Q{base}\E/", "").alias("path"), "content")


def _line():
    return F.concat(F.sha2("content", 256), F.lit(" "), F.octet_length("content").cast("string"), F.lit(" "), F.col("path"), F.lit("\n"))


def root(listed: DataFrame) -> DataFrame:
    """files, bytes and the root digest over `<sha256> <bytes> <path>` lines in ordinal path order.

    Contents are reduced to their lines where they lie; the lines are sorted on disk and read through the digest in
    constant memory, by one task, as a flat digest has one order. `root_tree` shares the digest among tasks too.
    """
    lines = listed.select("path", F.octet_length("content").alias("bytes"), _line().alias("line"))
    found = ordered.digest(lines, F.col("line"), "path")
    total = lines.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return found.crossJoin(total).select(F.col("n").alias("files"), "bytes", F.col("digest").alias("root"))  # one row each


def root_tree(listed: DataFrame, digits: int = 2) -> DataFrame:
    """Like `root`, shared among tasks: a digest over the digests of hash ranges of the paths, each in path order.

    `digits`, the hexadecimal digits that name a range, is part of the format: keep it with the root. A range is one
    task's list, so take one digit more for every 16 times as many files (2 are 256 ranges, for some 10 million files).
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"])
    leaves = (
        listed.select("path", F.octet_length("content").alias("bytes"), _line().alias("line"))
        .groupBy(F.substring(F.sha2("path", 256), 1, digits).alias("range"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(ordered, ""), 256).alias("leaf"))
    )
    return leaves.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "leaf"))), lambda x: x["leaf"]), "\n"), 256).alias("root"),
    )
