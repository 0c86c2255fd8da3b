"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Groups (equal texts by default) are sorted by size and each enters the bin with the tightest remaining capacity
that still holds it, found in a balanced tree of remaining capacities. `pack` minimises the number of bins of a
given capacity (`shard` with `capacity`); `spread` searches the smallest capacity for which a given number of bins
suffices, which makes the shards nearly equal.

At any input size the packing handles a bounded number of items: groups of at least 1/BIG of all bytes are items
of their own (at most BIG of them), all smaller groups are first joined by hash into PARCELS parcels, themselves
indivisible. Only those item sizes reach the driver.

Slots follow doc_id and group in every shard; they are numbered within range partitions, so that neither a shard nor
the rows of one doc_id meet in a task.

Defined results: null and empty texts form one group, each row of size 1; rows may repeat, also in doc_id (null
too), and each gets its own slot; a very long text is an item like any other, and one above the capacity has a shard to
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.llm.common import BROADCAST_ROWS, durable, ready, shuffle_width

BIG, PARCELS = 16_384, 4_096


class _Node:
    __slots__ = ("key", "height", "left", "right")

    def __init__(self, key):
        self.key, self.height, self.left, self.right = key, 1, None, None


def _height(n):
    return n.height if n else 0


def _fixed(n):
    """Restore the height of n and its AVL balance."""
    tilt = _height(n.left) - _height(n.right)
    if tilt > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _rotate(n.left, "right", "left")
        return _rotate(n, "left", "right")
    if tilt < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _rotate(n.right, "left", "right")
        return _rotate(n, "right", "left")
    n.height = 1 + max(_height(n.left), _height(n.right))
    return n


def _rotate(n, up, down):
    top = getattr(n, up)
    setattr(n, up, getattr(top, down))
    setattr(top, down, n)
    n.height = 1 + max(_height(n.left), _height(n.right))
    top.height = 1 + max(_height(top.left), _height(top.right))
    return top


def _insert(n, key):
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = _insert(n.left, key)
    else:
        n.right = _insert(n.right, key)
    return _fixed(n)


def _remove(n, key):
    if key < n.key:
        n.left = _remove(n.left, key)
    elif key > n.key:
        n.right = _remove(n.right, key)
    elif n.left is None or n.right is None:
        return n.left or n.right
    else:
        least = n.right
        while least.left:
            least = least.left
        n.key = least.key
        n.right = _remove(n.right, least.key)
    return _fixed(n)


def _ceiling(n, key):
    """The smallest key that is not below `key`."""
    best = None
    while n:
        if n.key >= key:
            best, n = n.key, n.left
        else:
            n = n.right
    return best


def pack(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item by best-fit-decreasing; None if more than `most` bins would be needed.

    An item above the capacity gets a bin to itself.
    """
    tree, bins, where = None, 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = _ceiling(tree, (sizes[i], -1))
        if found is None:
            if bins == most:
                return None
            left, b = capacity - sizes[i], bins
            bins += 1
        else:
            tree = _remove(tree, found)
            left, b = found[0] - sizes[i], found[1]
        where[i] = b
        if left >= 0:
            tree = _insert(tree, (left, b))
    return where


def spread(sizes: list[int], bins: int, rounds: int = 24) -> list[int]:
    """Bin of each item such that `bins` bins are filled as evenly as best-fit-decreasing finds.

    An item of at least an equal share of what is left gets a bin to itself; the rest share the other bins.
    """
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, alone = sum(sizes), 0
    while alone < min(bins - 1, len(order)) and sizes[order[alone]] * (bins - alone) >= left:
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    own = [sizes[i] for i in rest]
    low = max(max(own, default=0), -(-left // (bins - alone)))
    high, step = low, 1
    best = pack(own, high, bins - alone)
    while best is None:
        high = low + step
        step *= 2
        best = pack(own, high, bins - alone)
    for _ in range(rounds):
        if low >= high:
            break
        mid = (low + high) // 2
        found = pack(own, mid, bins - alone)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    where = [0] * len(sizes)
    for b, i in enumerate(order[:alone]):
        where[i] = b
    for i, b in zip(rest, best, strict=True):
        where[i] = alone + b
    return where


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: Column | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group (binary digest), shard and slot (gapless in a shard, from 0) of every row.

    `shards` of nearly equal bytes, or as few as best-fit-decreasing finds of `capacity` bytes each.
    """
    spark = docs.sparkSession
    ready(spark)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.md5(F.encode(key.cast("string"), "utf-8") if key is not None else body)).alias("group"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-rows",
    )
    parcel = F.pmod(F.xxhash64("group"), F.lit(PARCELS)).cast("int")
    groups = durable(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_big = F.col("bytes") * BIG >= total
    big = groups.filter(is_big).collect()  # at most BIG rows, whatever the input
    small = groups.filter(~is_big).groupBy(parcel.alias("p")).agg(F.sum("bytes").alias("bytes")).collect()
    sizes = [r["bytes"] for r in big] + [r["bytes"] for r in small]
    where = spread(sizes, shards) if capacity is None else pack(sizes, capacity)
    big_at = spark.createDataFrame(
        [(bytes(r["group"]), s) for r, s in zip(big, where, strict=False)], "group binary, _s int"
    )
    of_parcel = [0] * PARCELS
    for r, s in zip(small, where[len(big) :], strict=True):
        of_parcel[r["p"]] = s
    placed = rows.join(F.broadcast(big_at), "group", "left").withColumn(
        "shard", F.coalesce("_s", F.element_at(F.lit(of_parcel), parcel + 1)).cast("int")
    )
    order = ["doc_id", "group", "rid"]  # rid only tells equal rows apart
    placed = durable(
        placed.drop("_s").repartitionByRange(shuffle_width(spark, rows), "shard", *order).withColumn("place", F.spark_partition_id()), "shard-placed"
    )
    counts = durable(placed.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("_n")), "shard-counts")
    prior = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "place", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_from"))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        start = F.broadcast(start)
    turn = F.row_number().over(Window.partitionBy("shard", "place").orderBy(*order))
    return (
        placed.withColumn("_i", turn - 1)
        .join(start, ["shard", "place"], "left")
        .withColumn("slot", F.col("_from") + F.col("_i"))
        .select("doc_id", "size", "text_crc32", "group", "shard", "slot")
    )
