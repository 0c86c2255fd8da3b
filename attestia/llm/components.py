"""Connected components of an edge table by repeated contraction.

Every node hooks onto the neighbour (or itself) of the least hashed id; the graph of the hooks' targets has at
most about half the nodes, and is contracted again. When a graph of at most SMALL edges is left, one task ends the
work with union-find. Look-ups of hot nodes are salted and minima are combined before they are shuffled.

Defined results: an edge with a null end joins nothing, nor does one from a node to itself, and a node with no other edge is
in no row of the result; repeated and reversed edges count once; a component has the least of its ids as its root, so
there are no ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import durable, lookup

SMALL = 10_000


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        forest.join(x, y)
    return nodes, nodes[forest.roots()] if len(nodes) else nodes


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b), as a written table."""
    spark = edges.sparkSession
    pairs = durable(
        edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    levels: list[DataFrame] = []
    hashed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))

    def finish(batches):
        from attestia.llm import components as c

        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if got:
            nodes, roots = c.settle(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "up"])

    while n := pairs.limit(SMALL + 1).count():
        if n <= SMALL:
            levels.append(durable(pairs.select("a", "b").coalesce(1).mapInArrow(finish, "node long, up long"), "settled"))
            break
        ways = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "to")
        hooks = ways.groupBy("node").agg(F.min(hashed("to")).alias("least"))
        level = durable(hooks.select("node", F.least("least", hashed("node"))["id"].alias("up")), "hooks")
        levels.append(level)
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            pairs = lookup(pairs, level.select(F.col("node").alias(end), "up"), end, F.col(other)).drop(end).withColumnRenamed("up", end)
        pairs = durable(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not levels:
        return spark.createDataFrame([], "node long, root long")
    found = levels[-1].select("node", F.col("up").alias("root"))
    for level in reversed(levels[:-1]):
        above = found.select(F.col("node").alias("up"), "root")
        found = durable(lookup(level, above, "up", F.col("node")).select("node", F.coalesce("root", "up").alias("root")), "roots")
    least = durable(found.groupBy("root").agg(F.min("node").alias("least")), "least")
    return durable(lookup(found, least, "root", F.col("node")).select("node", F.col("least").alias("root")), "components")
