"""Relational building blocks of annotation reports: latest child, dedup, windows, top-k and row-set changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that ends with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, *order: Column) -> DataFrame:
    """Every parent with its latest child, if any."""
    return parents.join(latest(children, [child_key], *order), parents[key] == F.col(child_key), "left")


def trailing_count(rows: DataFrame, key: str, at: str, width: int, out: str) -> DataFrame:
    """How many rows of the key lie in the `width` units of time up to each row, itself included."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-width, 0)
    return rows.withColumn(out, F.count(F.lit(1)).over(w))


def trailing_counts(rows: DataFrame, key: str, at: str, width: int, out: str, row_id: str, slices: int = 16) -> DataFrame:
    """`trailing_count` for keys of any number of rows: one key's rows are shared among tasks by slices of time.

    `at` is an integer and `row_id` unique. Rows up to a time are those of all slices before its own, from prefix sums of
    counts, and those of its slice up to it; the rows of a trailing window are the difference of two such numbers. A
    window's width is divided into `slices` slices, and a task holds one key's rows of one slice.
    """
    size = max(1, width // slices)
    ends = F.array(
        F.struct(F.col(at).cast("long").alias("_t"), F.lit(1).alias("_n"), F.lit(1).alias("_sign")),
        F.struct((F.col(at).cast("long") - width - 1).alias("_t"), F.lit(0).alias("_n"), F.lit(-1).alias("_sign")),
    )
    marks = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(row_id).alias("_id"), F.inline(ends)).withColumns(
        {"_slice": F.floor(F.col("_t") / size), "_row": F.when(F.col("_n") == 1, F.col("_row"))}
    )
    counts = marks.groupBy("_key", "_slice").agg(F.sum("_n").alias("_n"))  # a row for each slice
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum("_n").over(Window.partitionBy("_key", "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    placed = marks.withColumn("_own", own).join(bases, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")))
    total = F.sum(F.col("_sign") * (F.col("_base") + F.col("_own"))).alias("_total")
    return placed.groupBy("_id").agg(F.any_value("_row", True).alias("_row"), total).select("_row.*", F.when(F.col(f"_row.{at}").isNotNull(), F.col("_total")).alias(out))


def since_previous(rows: DataFrame, key: str, at: str, *ties: str, out: str = "gap") -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, *ties)
    return rows.withColumn(out, F.col(at) - F.lag(at).over(w))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows, repeats counted, as one row (only_left, only_right, equal)."""
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return a.crossJoin(b).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """The next version of a table: changed rows replace those of their key where the guard holds, new ones join.

    Inside `guard`, current columns are `old.x` and changed ones `new.x`; the same columns are needed on both sides. Of
    several changes of one key the one that is last by its other columns, in their order, counts.
    """
    columns = current.columns
    others = [c for c in columns if c not in keys]
    if others:
        changes = changes.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_last")).select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in columns])
    old = current.select(F.struct("*").alias("old"), *[F.col(k).alias(f"_{k}") for k in keys])
    new = changes.select(F.struct("*").alias("new"), *[F.col(k).alias(f"_{k}") for k in keys])
    both = old.join(new, [f"_{k}" for k in keys], "full_outer")
    change = F.col("new").isNotNull() & (F.col("old").isNull() | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))))
    return both.select(F.when(change, F.col("new")).otherwise(F.col("old")).alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])


def delete_oldest(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The rows left after the n oldest by time, then key, are deleted."""
    oldest = rows.orderBy(at, key).limit(n).select(key)
    return rows.join(F.broadcast(oldest) if n <= 100_000 else oldest, key, "left_anti")


def topological_levels(spark, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and level: 0 without references, else one above the highest table it refers to.

    Edges (child, parent) describe a schema, so the recursion runs over a configuration-sized table.
    """
    edges.createOrReplaceTempView("_topology_edges")
    nodes.createOrReplaceTempView("_topology_nodes")
    return spark.sql(
        """
        with recursive walk(node, level) as (
          select node, 0 from _topology_nodes
          union all
          select e.child, w.level + 1 from walk w join _topology_edges e on e.parent = w.node
        ) select node, max(level) as level from walk group by node
        """
    )
