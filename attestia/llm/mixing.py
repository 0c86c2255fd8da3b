"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document, in a shuffled order within its source and epoch, gets a virtual finish time: the words its
source has served up to and including it, divided by the source's weight. Sorting all documents by that time
and cutting at the word budget serves every source in proportion to its weight until it runs out of epochs,
and what it leaves is shared by the rest in proportion to theirs.

No source's rows, and no doc_id's, meet in one task: running sums are taken within range partitions of a total order
(of a source, then of the whole queue), then over the partitions' totals.

Defined results: a null or empty text has size 0, takes no words and is kept in the manifest; a null source is
a source of its own, ordered last; rows that repeat a doc_id (null too) are separate rows, ordered by a hash of their
text, so that the order of the input does not matter; rows equal in all these are interchangeable; a very
long document is one item, of which the mix takes all or nothing; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.llm.common import BROADCAST_ROWS, WORD, durable, lookup, ready, shuffle_width

SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key that sorts as the source does, by code point and null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def cyclic_weights(pattern: tuple[float, ...]):
    """Weights by position among the sources (ordered by code point, null last), repeating the pattern."""

    def weigh(sources: DataFrame) -> DataFrame:
        at = (F.row_number().over(Window.orderBy("skey")) - 1) % len(pattern)
        return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), at + 1))

    return weigh


def targets(sized: DataFrame, weigh, ratio: float, cap: float) -> DataFrame:
    """One row for each source: size, weight, target words and the virtual time at which it is exhausted.

    The table has one row for each source of the mix, which is configuration-sized; its windows are unpartitioned.
    """
    sources = weigh(sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    order = Window.orderBy("full_at", "skey")
    filled = (
        sources.withColumn("most", F.lit(float(cap)) * F.col("source_size").cast("double"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.lit(float(ratio)) * F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("turn", F.row_number().over(order))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
    )
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("turn", "level"))
    level = F.coalesce(F.min(fits).over(Window.partitionBy())["level"], F.lit(float("inf")))
    return filled.withColumn("target", F.least("most", F.col("weight") * level)).select(
        "skey", "source_size", "n", "weight", "budget", "target"
    )


def ranged(rows: DataFrame, order: list, width: int) -> DataFrame:
    """The rows, written in range partitions of a total order, with `place`: the number of their partition."""
    placed = rows.repartitionByRange(width, *order).withColumn("place", F.spark_partition_id())
    return durable(placed, "mix-ranged")


def running(rows: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` over all rows of a group up to this one, of rows in range partitions (`place`)."""
    totals = durable(rows.groupBy(*group, "place").agg(F.sum(value).alias("_t")), "mix-totals")
    before = totals.select(
        *group,
        "place",
        F.coalesce(
            F.sum("_t").over(Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    within = Window.partitionBy(*group, "place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    return (
        rows.withColumn("_in", F.sum(value).over(within))
        .join(before, [*group, "place"], "left")
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_in", "_before")
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shuffled(epoch: Column, seed: str = SEED) -> Column:
    """The place of a document in the shuffled order of an epoch: a digest of its doc_id."""
    return F.unhex(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def mix(docs: DataFrame, weigh, ratio: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix as a manifest: one row for each document and epoch.

    Columns: rid (row of the input), doc_id, skey, th (hash of the text), size, source_size, weight, target, epoch,
    finish (virtual time), place (range partition; the manifest is sorted by finish over places) and taken (within the
    budget). `weigh` adds a positive `weight` to a DataFrame of sources; `cap` bounds how often a source may be read.
    """
    spark = docs.sparkSession
    ready(spark)
    sized = durable(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            source_key(F.col("source")).alias("skey"),
            words_in(F.col("text")).alias("size"),
            text_hash(F.col("text")).alias("th"),
        ),
        "mix-sized",
    )
    sources = durable(targets(sized, weigh, ratio, cap), "mix-sources")
    width = shuffle_width(spark, sized)
    # Equal rows differ in rid alone, so that they have different places; only narrow columns travel.
    turn = [shuffled(F.col("epoch"), seed), F.col("doc_id"), F.col("th"), F.col("rid")]
    rows = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))))
    rows = running(ranged(rows, ["skey", "epoch", *turn], width), ["skey", "epoch"], turn, "size", "_served").drop("place")
    served = F.col("_served") + F.col("epoch") * F.col("source_size")
    rows = lookup(rows, sources.select("skey", "source_size", "weight"), "skey", F.col("rid")).select(
        *sized.columns, "epoch", served.alias("served"), (served.cast("double") / F.col("weight")).alias("finish")
    )
    order = ["finish", "skey", "epoch", *turn]
    cut = lookup(running(ranged(rows, order, width), [], order, "size", "spent"), sources.drop("n"), "skey", F.col("rid"))
    inside = (F.col("spent").cast("double") <= F.col("budget")) & (
        F.col("served").cast("double") <= F.lit(float(cap)) * F.col("source_size").cast("double")
    )
    return cut.withColumn("taken", inside).drop("budget", "served")


def taken_words(manifest: DataFrame) -> DataFrame:
    """One row for each input row: how many of its words the mix takes, repeats counted."""
    return (
        manifest.groupBy("rid")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("size").alias("size"),
            F.min("source_size").alias("source_size"),
            F.min("target").alias("target"),
            F.sum(F.when(F.col("taken"), F.col("size")).otherwise(F.lit(0))).alias("taken"),
        )
        .drop("rid")
    )


def cuts(manifest: DataFrame, seed: str = SEED) -> DataFrame:
    """skey and an array of (epoch, last, n, rows): what is taken of a source's epoch is what comes up to `last`.

    Virtual time grows along the shuffled order of a source, so the budget's cut is a cut in that order. `rows` rows
    equal the last one in doc_id and text, and `n` of them are taken.
    """
    last = F.struct(shuffled(F.col("epoch"), seed).alias("h"), "doc_id", "th")
    found = durable(manifest.filter("taken").groupBy("skey", "epoch").agg(F.max(last).alias("last")), "mix-cuts")
    side = F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found
    equal = (
        manifest.select("skey", "epoch", "taken", last.alias("mine"))
        .join(side, ["skey", "epoch"])
        .filter(F.col("mine").eqNullSafe(F.col("last")))
        .groupBy("skey", "epoch")
        .agg(F.first("last").alias("last"), F.sum(F.col("taken").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"))
    )
    return durable(equal.groupBy("skey").agg(F.collect_list(F.struct("epoch", "last", "n", "rows")).alias("cuts")), "mix-source-cuts")  # epochs


def take(docs: DataFrame, manifest: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents with their own columns, a document repeated as often as the mix takes it.

    Documents meet only the cuts of their source, one for each epoch; texts are not shuffled. Of rows that are equal in
    doc_id, source and text, and at a cut, as many are taken as the mix takes, whichever they are.
    """
    found = cuts(manifest, seed)
    named = docs.select(F.struct("*").alias("row"), "doc_id", source_key(F.col("source")).alias("skey"), text_hash(F.col("text")).alias("th"))
    rows = lookup(named, found, "skey", F.col("th"))
    at = lambda c: F.struct(shuffled(c["epoch"], seed).alias("h"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    split = lambda c: (c["n"] < c["rows"]) & at(c).eqNullSafe(c["last"])
    before = F.coalesce(F.size(F.filter("cuts", lambda c: (at(c) <= c["last"]) & ~split(c))), F.lit(0))
    taken = rows.select("row", F.greatest(before, F.lit(0)).alias("_times"))
    if found.filter(F.exists("cuts", lambda c: c["n"] < c["rows"])).limit(1).count():  # a cut among equal rows
        turn = F.row_number().over(Window.partitionBy("skey", "doc_id", "th").orderBy(F.lit(0)))
        odd = rows.filter(F.exists("cuts", split)).withColumn("_turn", turn)
        more = odd.withColumn("_times", F.size(F.filter("cuts", lambda c: split(c) & (F.col("_turn") <= c["n"]))))
        taken = taken.unionByName(more.select("row", "_times"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("row.*")
