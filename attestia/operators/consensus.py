"""The task state machine: legal transitions, current states, versions, quorum and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal transitions between the states of a task, and the deadlines.
TRANSITIONS = {
    "draft": ("open", "failed"),
    "open": ("independent-review", "failed"),
    "independent-review": ("discussion", "escalated", "failed"),
    "discussion": ("final-review", "escalated", "failed"),
    "final-review": ("approved", "escalated", "failed"),
    "approved": ("published", "revoked", "escalated"),
    "published": ("revoked",),
    "escalated": ("reissued", "failed"),
    "reissued": ("independent-review", "failed"),
    "revoked": ("reissued", "failed"),
    "failed": (),
}
ROUND_DEADLINE_MS = APPEAL_WINDOW_MS = 14 * 24 * 60 * 60 * 1000


def legal(before: Column, after: Column, transitions: dict[str, tuple[str, ...]] = TRANSITIONS) -> Column:
    """Whether a transition is allowed; null and unknown states allow none."""
    allowed = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.element_at(allowed, before), after), F.lit(False))


def chain(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """Events with version (from 1) and the state before, in order within each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("version", F.row_number().over(w)).withColumn("before", F.lag(state).over(w))


def _allowed(transitions) -> Column:
    return F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])


def outcomes(events: DataFrame, key: str, state: str, start: str, transitions, *order: str, chunk: Column | None = None) -> DataFrame:
    """key, _chunk and _from: for every state in which a chunk of a key's events may begin, the state it ends in, with counts.

    These maps compose, so a key's chunks can be folded apart and then chained.
    """
    states = sorted({start, *transitions, *[s for t in transitions.values() for s in t]})
    allowed, zero = _allowed(transitions), F.lit(0).cast("long")

    def step(acc, e):
        ok = F.coalesce(F.array_contains(F.element_at(allowed, acc["state"]), e["_to"]), F.lit(False))
        return F.struct(
            F.when(ok, e["_to"]).otherwise(acc["state"]).alias("state"),
            (acc["version"] + ok.cast("long")).alias("version"),
            (acc["rejected"] + (~ok).cast("long")).alias("rejected"),
        )

    rows = events.select(key, (F.lit(0) if chunk is None else chunk).alias("_chunk"), F.struct(*order, F.col(state).alias("_to")).alias("_event"))
    chunks = rows.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list("_event")).alias("_events"))
    begin = lambda s: F.struct(s.alias("state"), zero.alias("version"), zero.alias("rejected"))
    found = F.map_from_arrays(F.array(*[F.lit(s) for s in states]), F.array(*[F.aggregate("_events", begin(F.lit(s)), step) for s in states]))
    return chunks.select(key, "_chunk", found.alias("_from"))


def apply_guarded(events: DataFrame, key: str, state: str, start: str, transitions=TRANSITIONS, *order: str, chunk: Column | None = None) -> DataFrame:
    """Fold the events of each key: a transition that is not legal from the state reached so far is ignored.

    Returns key, state, version (transitions applied) and rejected. Events are folded in chunks, each for every state
    that it may begin in; the chunks of a key are then chained, which is a look-up for each. `chunk` must ascend with
    the order (a day, an hour); with it, a key of any number of events is shared among tasks.
    """
    parts = outcomes(events, key, state, start, transitions, *order, chunk=chunk)
    chained = F.array_sort(F.collect_list(F.struct("_chunk", F.map_entries("_from").alias("_from"))))
    zero = F.lit(0).cast("long")
    begin = F.struct(F.lit(start).alias("state"), zero.alias("version"), zero.alias("rejected"))

    def follow(acc, c):
        out = F.element_at(F.map_from_entries(c["_from"]), acc["state"])
        return F.struct(
            out["state"].alias("state"), (acc["version"] + out["version"]).alias("version"), (acc["rejected"] + out["rejected"]).alias("rejected")
        )

    return parts.groupBy(key).agg(F.aggregate(chained, begin, follow).alias("r")).select(
        key, "r.state", F.col("r.version").cast("int").alias("version"), F.col("r.rejected").cast("int").alias("rejected")
    )


def judge_guarded(events: DataFrame, key: str, state: str, start: str, transitions, *order: str, chunk: Column, begin: str | None = None) -> DataFrame:
    """The events with `legal`: whether each is allowed from the state that the legal ones before it have reached.

    `begin` names a column with the state in which the key's first event finds it; `start` is that of keys without one. Chunks are
    folded and chained as in `apply_guarded`; then each chunk, whose first state is known by now, is read once in order.
    """
    first = F.coalesce(F.max(begin), F.lit(start)) if begin else F.lit(start)
    parts = outcomes(events, key, state, start, transitions, *order, chunk=chunk)
    chained = F.array_sort(F.collect_list(F.struct("_chunk", F.map_entries("_from").alias("_from"))))

    def follow(acc, c):
        after = F.element_at(F.map_from_entries(c["_from"]), acc["state"])["state"]
        return F.struct(after.alias("state"), F.concat(acc["starts"], F.array(F.struct(c["_chunk"].alias("_chunk"), acc["state"].alias("_state")))).alias("starts"))

    kind = f"array<struct<_chunk:{parts.schema['_chunk'].dataType.simpleString()},_state:string>>"
    firsts = events.groupBy(key).agg(first.alias("_first"))
    chains = parts.groupBy(key).agg(chained.alias("_chain")).join(firsts, key)
    starts = chains.select(key, F.inline(F.aggregate("_chain", F.struct(F.col("_first").alias("state"), F.array().cast(kind).alias("starts")), follow)["starts"]))
    legal = {a: frozenset(b) for a, b in transitions.items()}
    at = [events.columns.index(state)]

    def read(frames):
        own, now = None, None
        for frame in frames:
            ok = []
            for k, c, s, to in zip(frame[key], frame["_chunk"], frame["_state"], frame.iloc[:, at[0]], strict=True):
                if own != (k, c):
                    own, now = (k, c), s
                ok.append(to in legal.get(now, ()))
                now = to if ok[-1] else now
            yield frame.drop(columns=["_chunk", "_state"]).assign(legal=ok)

    placed = events.withColumn("_chunk", chunk).join(starts, [key, "_chunk"]).select(*events.columns, "_chunk", "_state")
    # A hash of the keys: an exchange by the keys themselves is left out after a join by them, whose partitions may then be read in parts.
    sorted_ = placed.repartition(F.xxhash64(key, "_chunk")).sortWithinPartitions(key, "_chunk", *order)
    return sorted_.mapInPandas(read, type(events.schema)([*events.schema.fields]).add("legal", "boolean"))


def verify_chain(events: DataFrame, key: str, hash_column: str, prior: str, *order: str) -> DataFrame:
    """Events whose recorded prior hash is not the hash of the event before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_expected", F.lag(hash_column).over(w)).filter(~F.col(prior).eqNullSafe(F.col("_expected"))).drop("_expected")


def quorum(rows: DataFrame, key: str, role: str, needed: tuple[str, ...]) -> DataFrame:
    """Keys for which every needed role is present."""
    return rows.filter(F.col(role).isin(*needed)).groupBy(key).agg(F.countDistinct(role).alias("_n")).filter(F.col("_n") == len(needed)).select(key)


def publication_gate(tasks: DataFrame, appeals: DataFrame, finals: DataFrame, key: str, now_ms: int) -> DataFrame:
    """Accepted tasks past their appeal window with an active final result and no pending appeal."""
    return (
        tasks.filter((F.col("state") == "approved") & (F.col("appeal_deadline") <= now_ms))
        .join(finals.filter("status = 'active'"), key, "left_semi")
        .join(appeals.filter("status = 'pending'"), key, "left_anti")
    )


# The states of a task in which a role may be taken.
ROLE_STATES = {"A": ("open", "independent-review"), "B": ("open", "independent-review"), "J1": ("discussion",), "J2": ("final-review",)}


def role_eligibility(requests: DataFrame, tasks: DataFrame, rounds: DataFrame, seats: DataFrame, raters: DataFrame, proposals: DataFrame) -> DataFrame:
    """request_id and why the request for a role is refused (the first rule), or `eligible`.

    requests: request_id, user_id, task_id, round_id, role, roots (of J1: the roots of the annotations it judges), receipt_id and root (of J2:
    the proposal it reviews). tasks: task_id, state, holdout_id; rounds: round_id, status; seats (taken ones): user_id,
    task_id, holdout_id, round_id, role; raters (active submissions of A and B): round_id, role, root; proposals: round_id,
    receipt_id, root. A user may not be in a task, or in the family of its holdout, twice.
    """
    row = requests.join(tasks, "task_id", "left").join(rounds.select("round_id", F.col("status").alias("_round")), "round_id", "left")
    mine = requests.select("request_id", "user_id", "task_id").join(tasks.select("task_id", "holdout_id"), "task_id", "left")
    taken = seats.select("user_id", F.col("task_id").alias("_task"), F.col("holdout_id").alias("_family"))
    again = mine.join(taken, "user_id").filter((F.col("task_id") == F.col("_task")) | (F.col("holdout_id") == F.col("_family"))).select("request_id").distinct().withColumn("_again", F.lit(True))
    full = seats.select("round_id", "role").distinct().withColumn("_full", F.lit(True))
    stored = raters.filter(F.col("role").isin("A", "B")).groupBy("round_id").agg(F.countDistinct("role").alias("_raters"), F.collect_set("root").alias("_roots"))  # two roles: two roots
    offered = proposals.select("round_id", "receipt_id", F.col("root").alias("_proposed"))
    known = row.join(again, "request_id", "left").join(full, ["round_id", "role"], "left").join(stored, "round_id", "left").join(offered, ["round_id", "receipt_id"], "left")
    allowed = F.lit(False)
    for role, states in ROLE_STATES.items():
        allowed = allowed | ((F.col("role") == role) & F.col("state").isin(*states))
    judge, second = F.col("role") == "J1", F.col("role") == "J2"
    roots = F.array_distinct(F.coalesce("roots", F.array().cast("array<string>")))
    bound = (F.size("_roots") == 2) & (F.size(F.array_except(roots, F.col("_roots"))) == 0) & (F.size(roots) > 0)
    rules = {
        "round-closed": ~F.coalesce(F.col("_round") == "open", F.lit(False)),
        "role-state": ~F.coalesce(allowed, F.lit(False)),
        "participated": F.col("_again"),
        "occupied": F.col("_full"),
        "raters-missing": judge & ~F.coalesce(F.col("_raters") == 2, F.lit(False)),
        "raters-other": judge & ~F.coalesce(bound, F.lit(False)),
        "proposal-missing": second & ~F.coalesce(F.col("root") == F.col("_proposed"), F.lit(False)),
    }
    return known.select("request_id", first_reason(rules).alias("reason"))


def publishable(tasks: DataFrame, appeals: DataFrame, finals: DataFrame, receipts: DataFrame, now_ms: int) -> DataFrame:
    """The tasks that may be published: approved, accepted by the repository, past their appeal window, without a pending appeal, with
    their active final result, and with a repository receipt of exactly that result.

    tasks: task_id, state, repository_status, appeal_deadline, active_receipt; appeals: task_id, status; finals:
    task_id, round_id, receipt_id, root, status; receipts: task_id, round_id, root, receipt.
    """
    ready = tasks.filter((F.col("state") == "approved") & (F.col("repository_status") == "accepted") & (F.col("appeal_deadline") <= now_ms))
    active = finals.filter("status = 'active'").select("task_id", F.col("receipt_id").alias("active_receipt"), "round_id", "root")
    free = ready.join(appeals.filter("status = 'pending'"), "task_id", "left_anti")
    first = receipts.groupBy("task_id", "round_id", "root").agg(F.min("receipt").alias("receipt"))
    return free.join(active, ["task_id", "active_receipt"]).join(first, ["task_id", "round_id", "root"]).select("task_id", "round_id", "root", "receipt")


def first_reason(rules: dict[str, Column], accepted: str = "eligible") -> Column:
    """The first rule that holds, in the given order; null conditions do not hold."""
    out = None
    for name, broken in rules.items():
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return F.lit(accepted) if out is None else out.otherwise(accepted)


def round_chain(rounds: DataFrame, key: str, number: str, round_id: Column) -> DataFrame:
    """Rounds with the id of the round before and whether their numbers follow on each other."""
    w = Window.partitionBy(key).orderBy(number)
    return rounds.withColumn("prior_round", F.lag(round_id).over(w)).withColumn("follows", F.col(number) == F.coalesce(F.lag(number).over(w), F.lit(0)) + 1)


def replay_protected(requests: DataFrame, nonce: str, at: str, signed: str, window_ms: int, *ties: str) -> DataFrame:
    """Requests signed within the window of their arrival whose nonce was not used before."""
    fresh = requests.filter(F.abs(F.col(at) - F.col(signed)) <= window_ms)
    w = Window.partitionBy(nonce).orderBy(at, *ties)
    return fresh.withColumn("_use", F.row_number().over(w)).filter("_use = 1").drop("_use")
