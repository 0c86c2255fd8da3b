"""A journal of writes replayed onto a snapshot: merge on read, in the order of (generation, sequence).

A journal entry is one request: request_id, generation, sequence, status, receipt, payload (JSON) and payload_hash. Its payload lists
operations: `put` of a tagged value into a column of a row, or `delete` of a row. Entries are chosen as in
`queues.replay_set`, a request counts once, and the result is what running all operations in their order would leave:
for each row and column the last put after the row's last deletion. That is one partial aggregate by row, so a row
that half of all operations write costs a few values from each task, and one outer join with the snapshot.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.operators.queues import replay_set

# The tags of values in a payload.
TAGS = ("null", "string", "number", "bigint", "boolean", "blob", "json")
PAYLOAD = "struct<operations:array<struct<op:string,key:bigint,column:string,type:string,value:string>>>"
RECEIPT = ["request_id", "payload_hash"]


class Replayed(NamedTuple):
    table: DataFrame
    receipts: DataFrame  # request_id and payload_hash of every request that was applied now
    rejects: DataFrame  # request_id, generation, sequence and reason of the entries that were not


def decoded(tag: Column, value: Column, kind: str) -> Column:
    """A tagged value as a column of this type; null if it is none of it."""
    if kind == "binary":
        return F.when(tag == "blob", F.unbase64(value))
    return F.when(tag.isin("string", "number", "bigint", "boolean", "json"), value.try_cast(kind))


def _valid(columns: list[str]) -> Column:
    put = lambda o: (o["op"] == "put") & o["column"].isin(*columns) & o["type"].isin(*TAGS)
    sound = lambda o: o["key"].isNotNull() & ((o["op"] == "delete") | put(o))
    return F.forall("_ops", lambda o: F.coalesce(sound(o), F.lit(False)))


def judged(chosen: DataFrame, columns: list[str], receipts: DataFrame | None) -> DataFrame:
    """Chosen entries with _ops and why they are not applied: hash, payload, value, conflict or repeat; null if they are.

    The first entry of a request, or an earlier receipt, decides which payload the request has.
    """
    at = F.struct("generation", "sequence")
    entry = chosen.withColumn("_ops", F.from_json("payload", PAYLOAD)["operations"])
    fault = (
        F.when(~F.coalesce(F.sha2("payload", 256) == F.col("payload_hash"), F.lit(False)), "hash")
        .when(F.coalesce(F.size("_ops"), F.lit(0)) < 1, "payload")
        .when(~_valid(columns), "value")
    )
    told = entry.withColumn("_fault", fault)
    first = told.filter("_fault is null").groupBy("request_id").agg(F.min(F.struct(at.alias("at"), "payload_hash")).alias("_first"))
    known = told.join(first, "request_id", "left")
    if receipts is None:
        known = known.withColumn("_held", F.lit(None).cast("string"))
    else:
        known = known.join(receipts.select("request_id", F.col("payload_hash").alias("_held")), "request_id", "left")
    held = F.coalesce("_held", "_first.payload_hash")
    own = F.col("_held").isNull() & (F.col("_first.at") == at)
    reason = F.coalesce("_fault", F.when(held != F.col("payload_hash"), "conflict").when(~own, "repeat"))
    return known.withColumn("reason", reason).drop("_fault", "_first", "_held")


def replay(
    base: DataFrame, journal: DataFrame, key: str, snapshot: tuple[int, int], target_generation: int, receipts: DataFrame | None = None
) -> Replayed:
    """The snapshot after the replay, and what became of the journal's entries.

    Defined results: a row that is put after it was deleted has nulls in the columns that were not put again, as has a row that the
    snapshot lacks; an entry of a request that is applied twice in the same words is a repeat, in other words a
    conflict; a value that is not of its column's type is null. Entries that repeat generation and sequence have no order of
    their own and must not.
    """
    columns = [c for c in base.columns if c != key]
    kinds = dict(base.dtypes)
    entries = judged(replay_set(journal, snapshot, target_generation), columns, receipts)
    applied = entries.filter("reason is null")
    ops = applied.select("generation", "sequence", F.posexplode("_ops").alias("_n", "o")).select(
        F.struct("generation", "sequence", "_n").alias("_at"), F.col("o.key").cast(kinds[key]).alias(key), "o.op", "o.column", "o.type", "o.value"
    )
    put = lambda c: F.max(F.when((F.col("op") == "put") & (F.col("column") == c), F.struct("_at", "type", "value")))
    gone = F.max(F.when(F.col("op") == "delete", F.col("_at"))).alias("_gone")
    last = ops.groupBy(key).agg(gone, *[put(c).alias(f"_put_{i}") for i, c in enumerate(columns)])
    rows = base.withColumn("_there", F.lit(True)).join(last, key, "full_outer")
    fresh = lambda i: F.col(f"_put_{i}").isNotNull() & (F.col("_gone").isNull() | (F.col(f"_put_{i}._at") > F.col("_gone")))
    there = F.col("_there").isNotNull() & F.col("_gone").isNull()
    for i in range(len(columns)):
        there = there | fresh(i)
    value = lambda i, c: F.when(fresh(i), decoded(F.col(f"_put_{i}.type"), F.col(f"_put_{i}.value"), kinds[c])).when(F.col("_gone").isNull(), F.col(c))
    table = rows.filter(there).select(key, *[value(i, c).alias(c) for i, c in enumerate(columns)]).select(*base.columns)
    rejects = entries.filter("reason is not null").select("request_id", "generation", "sequence", "reason")
    return Replayed(table, applied.select(*RECEIPT).distinct(), rejects)
