"""Lease queues, retries, idempotency, watermark replay and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.operators.relational import latest


def ready(status: Column, next_attempt: Column, lease_until: Column, now_ms: int) -> Column:
    """Pending and due, or sending with an expired lease."""
    return ((status == "pending") & (next_attempt <= now_ms)) | ((status == "sending") & (lease_until <= now_ms))


def claim(queue: DataFrame, now_ms: int, lease_ms: int, limit: int) -> DataFrame:
    """The queue after the oldest `limit` ready rows are claimed: status, attempts and lease move on together."""
    due = queue.filter(ready(F.col("status"), F.col("next_attempt"), F.col("lease_until"), now_ms))
    taken = due.orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_taken"))
    joined = queue.join(F.broadcast(taken) if limit <= 100_000 else taken, "id", "left")
    hit = F.coalesce("_taken", F.lit(False))
    return (
        joined.withColumn("attempts", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")))
        .withColumn("lease_until", F.when(hit, F.lit(now_ms + lease_ms)).otherwise(F.col("lease_until")))
        .withColumn("status", F.when(hit, "sending").otherwise(F.col("status")))
        .drop("_taken")
    )


def claimable(outbox: DataFrame, parents: dict[str, DataFrame], receipts: dict[str, list[DataFrame]], now_ms: int, limit: int | None = None) -> DataFrame:
    """Outbox rows that may be claimed, oldest first: id, kind, related_id.

    outbox: id, kind, related_id, task_id, status, next_attempt, created_at. A kind's parent (id, done) must exist and not be done: it
    is found by the row's related id, or by its task for kinds whose parent has a task_id instead of an id. None of the kind's receipt
    tables (related_id) may have it. Each kind is joined apart, so no row meets a table of another kind, and rows without a match do not
    gather under a null key.
    """
    free = outbox.filter(F.col("status").isin("pending", "sent") | ((F.col("status") == "sending") & (F.col("next_attempt") <= now_ms)))
    found = []
    for kind, parent in parents.items():
        own = free.filter(F.col("kind") == kind)
        key = "task_id" if "task_id" in parent.columns else "related_id"
        open_ = parent.filter(~F.coalesce(F.col("done"), F.lit(True))).select(F.col("task_id" if key == "task_id" else "id").alias(key))
        own = own.join(open_, key, "left_semi")
        for given in receipts.get(kind, []):
            own = own.join(given.select("related_id"), "related_id", "left_anti")
        found.append(own.select("id", "kind", "related_id", "created_at"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return (whole.orderBy("created_at", "id").limit(limit) if limit else whole).drop("created_at")


def backoff_minutes(attempts: Column, most: int = 60, terminal: int = 5) -> Column:
    """Minutes until the next attempt, doubling; null once the attempts are used up."""
    return F.when(attempts < terminal, F.least(F.lit(most), F.pow(F.lit(2), attempts)).cast("long"))


def backoff_ms(attempts: Column, base: int = 30_000, most: int = 6 * 3_600_000, terminal: int = 8) -> Column:
    return F.when(attempts < terminal, F.least(F.lit(most), base * F.pow(F.lit(2), attempts)).cast("long"))


def idempotent(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each idempotency key."""
    return latest(rows, [key], *order)


def conflicts(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """Keys that were used with more than one payload digest."""
    return rows.groupBy(key).agg(F.countDistinct(digest).alias("payloads"), F.count(F.lit(1)).alias("uses")).filter("payloads > 1")


def up_to(generation: Column, sequence: Column, mark: tuple[int, int]) -> Column:
    """(generation, sequence) at most the watermark, lexicographically."""
    return (generation < mark[0]) | ((generation == mark[0]) & (sequence <= mark[1]))


def replay_set(journal: DataFrame, snapshot: tuple[int, int], target_generation: int) -> DataFrame:
    """Writes to replay: pending, applied without a receipt, or applied after the snapshot and before the target."""
    g, s = F.col("generation"), F.col("sequence")
    after = ~up_to(g, s, snapshot) & (g < target_generation)
    return journal.filter((F.col("status") == "pending") | ((F.col("status") == "applied") & (F.col("receipt").isNull() | after)))


def retain(items: DataFrame, group: str, now_ms: int, keep: int, most_bytes: int, recovering: Column | None = None) -> DataFrame:
    """Greedy retention within each group, newest first: items that are leased, or that a recovery is just reading
    (`recovering`), stay; others unless expired or over a cap.

    An item over the byte cap is skipped and later smaller ones may still stay, so this is a fold, not a running sum.
    Columns: the group, id, bytes, expires_at, lease_until, and generation, sequence, verified_at, created_at.
    """
    order = F.struct(*[(-F.col(c)).alias(c) for c in ("generation", "sequence", "verified_at", "created_at")], "id", "bytes", "expires_at", "lease_until", F.coalesce(F.lit(False) if recovering is None else recovering, F.lit(False)).alias("recovering"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        leased = F.coalesce(x["lease_until"] > now_ms, F.lit(False)) | x["recovering"]
        fits = (x["expires_at"] > now_ms) & (acc["n"] < keep) & (acc["held"] + x["bytes"] <= most_bytes)
        stay = leased | F.coalesce(fits, F.lit(False))
        return F.struct(
            (acc["n"] + stay.cast("long")).alias("n"),
            (acc["held"] + F.when(stay, x["bytes"]).otherwise(F.lit(0).cast("long"))).alias("held"),
            F.when(stay, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    folded = items.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(order)), begin, step).alias("r"))
    return folded.select(group, F.col("r")["n"].alias("kept"), F.col("r")["held"].alias("kept_bytes"), F.col("r")["ids"].alias("kept_ids"))


def chunk_check(chunks: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """Whether the chunks of each key are contiguous from 0."""
    return (
        chunks.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min(index).alias("low"), F.max(index).alias("high"))
        .withColumn("complete", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))
    )


def chunks(rows: DataFrame, content: str, size: int) -> DataFrame:
    """Binary content cut into parts of `size` bytes: part, bytes, body and sha256 of each."""
    n = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int")
    return (
        rows.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("body", F.expr(f"substring({content}, part * {size} + 1, {size})"))
        .withColumn("bytes", F.octet_length("body"))
        .withColumn("sha256", F.sha2("body", 256))
        .drop(content)
    )
