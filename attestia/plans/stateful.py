"""Queues, state machines, watermarks, retention and streams over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import consensus as C
from attestia.operators import queues as Q
from attestia.plans.registry import registry
from attestia.plans.relational import event_ms
from attestia.session import dealt, table

QUERIES, ORACLES, query = registry()

NOW = 1_705_320_000_000  # an instant within the event log, in epoch milliseconds

# The event log as an outbox: its status, attempts and times derive from type and value.
OUTBOX = f"""
outbox as (
  select event_id as id, (epoch_us(ts) // 1000) as created_at,
    case event_type when 'view' then 'pending' when 'click' then 'sending' when 'signup' then 'sent' when 'purchase' then 'failed' else 'pending' end as status,
    cast(floor(value) as int) % 7 as attempts, (epoch_us(ts) // 1000) + (event_id % 5) * 86400000 as next_attempt,
    case when event_type = 'click' then (epoch_us(ts) // 1000) + 600000 end as lease_until from events)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "sending").when(kind == "signup", "sent").when(kind == "purchase", "failed").otherwise("pending")
    return event_ms(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("ms").alias("created_at"),
        status.alias("status"),
        (F.floor("value").cast("int") % 7).alias("attempts"),
        (F.col("ms") + (F.col("event_id") % 5) * 86_400_000).alias("next_attempt"),
        F.when(kind == "click", F.col("ms") + 600_000).alias("lease_until"),
    )


_READY = f"((status = 'pending' and next_attempt <= {NOW}) or (status = 'sending' and lease_until <= {NOW}))"


@query(f"with {OUTBOX} select id, status, attempts from outbox where {_READY}")
def ready_queue(spark, sf_dir):
    return outbox(spark, sf_dir).filter(Q.ready(F.col("status"), F.col("next_attempt"), F.col("lease_until"), NOW)).select("id", "status", "attempts")


@query(f"with {OUTBOX} select id, attempts, case when attempts < 5 then least(60, cast(power(2, attempts) as bigint)) end as minutes, case when attempts < 8 then least(21600000, cast(30000 * power(2, attempts) as bigint)) end as wait_ms from outbox")
def retry_backoff(spark, sf_dir):
    a = F.col("attempts")
    return outbox(spark, sf_dir).select("id", "attempts", Q.backoff_minutes(a).alias("minutes"), Q.backoff_ms(a).alias("wait_ms"))


@query(f"""with {OUTBOX}, taken as (select id as t from outbox where {_READY} order by created_at, id limit 50)
select id, case when t is not null then 'sending' else status end as status, case when t is not null then attempts + 1 else attempts end as attempts,
  case when t is not null then {NOW} + 600000 else lease_until end as lease_until from outbox left join taken on t = id""")
def claim_next_state(spark, sf_dir):
    return Q.claim(outbox(spark, sf_dir), NOW, 600_000, 50).select("id", "status", "attempts", "lease_until")


# Event types stand for states; the machine of the tests has its own small transition table.
STEPS = {"signup": ("view", "error"), "view": ("click", "view"), "click": ("purchase", "view", "error"), "purchase": ("view",), "error": ("signup",)}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, t in STEPS.items() for b in t)


@query(f"""with steps(a, b) as (values {_PAIRS}), chained as (
  select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select before, event_type, count(*) as n, bool_or(a is not null) as legal from chained left join steps on a = before and b = event_type group by before, event_type""")
def transition_legality(spark, sf_dir):
    chained = C.chain(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "ts", "event_id")
    return chained.groupBy("before", "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("legal", C.legal(F.col("before"), F.col("event_type"), STEPS))


@query("select user_id, arg_max(event_type, struct_pack(ts, event_id)) as state, count(*) as version from events group by user_id")
def current_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("version"))


@query("""select event_id, row_number() over (partition by user_id order by ts, event_id) as version,
  lag(event_type) over (partition by user_id order by ts, event_id) as before from events""")
def state_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return C.chain(rows, "user_id", "event_type", "ts", "event_id").select("event_id", F.col("version").cast("long").alias("version"), "before")


_FOLD = f"""with recursive steps(a, b) as (values {_PAIRS}), ordered as (
  select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events),
fold(user_id, i, state, version, rejected) as (
  select distinct user_id, 0::bigint, 'signup', 0, 0 from events
  union all
  select f.user_id, o.i, case when a is not null then o.event_type else f.state end, f.version + case when a is not null then 1 else 0 end, f.rejected + case when a is null then 1 else 0 end
  from fold f join ordered o on o.user_id = f.user_id and o.i = f.i + 1 left join steps on a = f.state and b = o.event_type)
select user_id, arg_max(state, i) as state, arg_max(version, i) as version, arg_max(rejected, i) as rejected from fold group by user_id"""


@query(_FOLD)
def guarded_fold(spark, sf_dir):
    """The state each key reaches when illegal transitions are ignored."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return C.apply_guarded(rows, "user_id", "event_type", "signup", STEPS, "ts", "event_id", chunk=F.to_date("ts"))


@query("select l_orderkey from lineitem where l_returnflag in ('A', 'R') group by l_orderkey having count(distinct l_returnflag) = 2")
def quorum_release(spark, sf_dir):
    return C.quorum(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ("A", "R"))


@query("""select o_orderkey, case o_orderstatus when 'O' then 'escalated' else 'reissued' end as state from orders
  where o_orderstatus in ('O', 'P') and (epoch_us(o_orderdate) // 1000) + 1209600000 <= 946684800000""")
def deadline_expired(spark, sf_dir):
    due = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + C.ROUND_DEADLINE_MS
    state = F.when(F.col("o_orderstatus") == "O", "escalated").otherwise("reissued")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (due <= 946_684_800_000)).select("o_orderkey", state.alias("state"))


_JOURNAL = """journal as (select event_id as id, user_id % 5 as generation, event_id as sequence,
  case event_type when 'error' then 'pending' when 'signup' then 'failed' else 'applied' end as status, case when value >= 10 then event_id end as receipt from events)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).alias("generation"),
        F.col("event_id").alias("sequence"),
        F.when(kind == "error", "pending").when(kind == "signup", "failed").otherwise("applied").alias("status"),
        F.when(F.col("value") >= 10, F.col("event_id")).alias("receipt"),
    )


@query(f"with {_JOURNAL} select id, generation, sequence from journal where status = 'pending' or (status = 'applied' and (receipt is null or ((generation, sequence) > (1, 5000) and generation < 4)))")
def watermark_replay(spark, sf_dir):
    return Q.replay_set(journal(spark, sf_dir), (1, 5000), 4).select("id", "generation", "sequence")


@query(f"with {_JOURNAL} select generation, count(*) as removable, max(sequence) as up_to from journal where status = 'applied' and receipt is not null and (generation, sequence) <= (2, 4000) group by generation")
def watermark_cleanup(spark, sf_dir):
    g, s = F.col("generation"), F.col("sequence")
    done = journal(spark, sf_dir).filter((F.col("status") == "applied") & F.col("receipt").isNotNull() & Q.up_to(g, s, (2, 4000)))
    return done.groupBy("generation").agg(F.count(F.lit(1)).alias("removable"), F.max("sequence").alias("up_to"))


_ITEMS = f"""items as (select user_id, event_id as id, cast(floor(value * 10) as bigint) as bytes, (epoch_us(ts) // 1000) + 864000000 as expires_at,
  case when event_type = 'purchase' and event_id % 11 = 0 then {NOW} + 1 end as lease_until, (epoch_us(ts) // 1000) as created_at, event_id % 3 as generation from events)"""


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_ms(spark, sf_dir)
    return e.select(
        "user_id",
        F.col("event_id").alias("id"),
        F.floor(F.col("value") * 10).cast("long").alias("bytes"),
        (F.col("ms") + 864_000_000).alias("expires_at"),
        F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0), F.lit(NOW + 1)).alias("lease_until"),
        F.col("ms").alias("created_at"),
        (F.col("event_id") % 3).alias("generation"),
        F.lit(0).alias("sequence"),
        F.lit(0).alias("verified_at"),
    )


@query(f"""with recursive {_ITEMS}, ordered as (select *, row_number() over (partition by user_id order by generation desc, created_at desc, id) as i from items),
fold(user_id, i, n, held, ids) as (
  select distinct user_id, 0::bigint, 0::bigint, 0::bigint, '' from items
  union all
  select f.user_id, o.i, f.n + case when s.stay then 1 else 0 end, f.held + case when s.stay then o.bytes else 0 end, f.ids || case when s.stay then ',' || o.id else '' end
  from fold f join ordered o on o.user_id = f.user_id and o.i = f.i + 1,
  lateral (select coalesce(o.lease_until > {NOW}, false) or (o.expires_at > {NOW} and f.n < 7 and f.held + o.bytes <= 1500) as stay) s)
select user_id, arg_max(n, i) as kept, arg_max(held, i) as kept_bytes, arg_max(ids, i) as ids from fold group by user_id""")
def retention_greedy(spark, sf_dir):
    kept = Q.retain(retained(spark, sf_dir), "user_id", NOW, 7, 1500)
    return kept.select("user_id", "kept", "kept_bytes", F.array_join(F.transform("kept_ids", lambda x: F.concat(F.lit(","), x.cast("string"))), "").alias("ids"))


@query(f"""with recursive {_ITEMS}, ordered as (select *, row_number() over (partition by user_id order by generation desc, created_at desc, id) as i from items),
fold(user_id, i, n, held, ids) as (
  select distinct user_id, 0::bigint, 0::bigint, 0::bigint, '' from items
  union all
  select f.user_id, o.i, f.n + case when s.stay then 1 else 0 end, f.held + case when s.stay then o.bytes else 0 end, f.ids || case when s.stay then ',' || o.id else '' end
  from fold f join ordered o on o.user_id = f.user_id and o.i = f.i + 1,
  lateral (select coalesce(o.lease_until > {NOW}, false) or o.id % 97 = 0 or (o.expires_at > {NOW} and f.n < 7 and f.held + o.bytes <= 1500) as stay) s)
select user_id, arg_max(n, i) as kept, arg_max(held, i) as kept_bytes, arg_max(ids, i) as ids from fold group by user_id""")
def retention_recovery(spark, sf_dir):
    """Greedy retention in which items that a recovery is just reading stay, whatever the caps."""
    kept = Q.retain(retained(spark, sf_dir), "user_id", NOW, 7, 1500, F.col("id") % 97 == 0)
    return kept.select("user_id", "kept", "kept_bytes", F.array_join(F.transform("kept_ids", lambda x: F.concat(F.lit(","), x.cast("string"))), "").alias("ids"))


@query("select event_id, user_id from (select *, row_number() over (partition by user_id, event_type, cast(floor(value) as int) order by ts, event_id) as r from events) where r = 1")
def idempotent_dedup(spark, sf_dir):
    key = F.struct("user_id", "event_type", F.floor("value").cast("int").alias("v"))
    rows = table(spark, sf_dir, "events").withColumn("key", key)
    return Q.idempotent(rows, "key", F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("""select user_id * 1000 + cast(floor(value) as int) as request_id, count(distinct sha256(event_type)) as payloads, count(*) as uses from events
  group by request_id having count(distinct sha256(event_type)) > 1""")
def receipt_conflict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.floor("value").cast("int")).alias("request_id"), "event_type")
    return Q.conflicts(rows, "request_id", F.sha2("event_type", 256))


@query("""select event_id, user_id, revision from (
  select *, row_number() over (partition by user_id order by ts, event_id) as revision from (
    select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where event_type is distinct from before)""")
def draft_revisions(spark, sf_dir):
    """Revisions of a draft: an event that repeats the content before writes none."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    changed = C.chain(rows, "user_id", "event_type", "ts", "event_id").filter(~F.col("event_type").eqNullSafe(F.col("before"))).drop("version", "before")
    return C.chain(changed, "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", F.col("version").cast("long").alias("revision"))


@query(f"select event_type, count(*) as live from events where (epoch_us(ts) // 1000) + case event_type when 'view' then 86400000 else 2592000000 end > {NOW} group by event_type")
def prune_expired(spark, sf_dir):
    life = F.when(F.col("event_type") == "view", F.lit(86_400_000)).otherwise(F.lit(2_592_000_000))
    return event_ms(spark, sf_dir).filter(F.col("ms") + life > NOW).groupBy("event_type").agg(F.count(F.lit(1)).alias("live"))


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


@query("""with finals as (select distinct l_orderkey as k from lineitem where l_returnflag = 'A' and l_linestatus = 'F'), appeals as (select distinct l_orderkey as k from lineitem where l_tax >= 0.08)
select o_orderkey from orders where o_orderstatus = 'F' and (epoch_us(o_orderdate) // 1000) + 1209600000 <= 946684800000 and o_orderkey in (select k from finals) and o_orderkey not in (select k from appeals)""")
def publication_gate(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    finals = items.filter("l_returnflag = 'A' and l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("active").alias("status"))
    appeals = items.filter("l_tax >= 0.08").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("pending").alias("status"))
    state = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open")
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), (_ms("o_orderdate") + C.APPEAL_WINDOW_MS).alias("appeal_deadline"))
    return C.publication_gate(tasks, appeals, finals, "o_orderkey", 946_684_800_000).select("o_orderkey")


@query("""with c as (select o_orderkey, o_custkey, o_orderstatus, (o_orderkey * 7) % 1500 as person from orders),
suspended as (select c_custkey from customer where c_acctbal < 0), seats as (select distinct l_orderkey from lineitem where l_linenumber = 1 and l_returnflag = 'A')
select o_orderkey, case when o_orderstatus <> 'O' then 'state' when o_custkey = person then 'participant' when s.c_custkey is not null then 'suspended' when t.l_orderkey is not null then 'seat' else 'eligible' end as reason
from c left join suspended s on s.c_custkey = person left join seats t on t.l_orderkey = o_orderkey""")
def eligibility(spark, sf_dir):
    """Why a person may not take a task, or that they may."""
    suspended = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("suspended"))
    seats = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_returnflag = 'A'").select(F.col("l_orderkey").alias("seat")).distinct()
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", ((F.col("o_orderkey") * 7) % 1500).alias("person"))
    joined = asked.join(suspended, F.col("person") == F.col("suspended"), "left").join(seats, F.col("o_orderkey") == F.col("seat"), "left")
    rules = {
        "state": F.col("o_orderstatus") != "O",
        "participant": F.col("o_custkey") == F.col("person"),
        "suspended": F.col("suspended").isNotNull(),
        "seat": F.col("seat").isNotNull(),
    }
    return joined.select("o_orderkey", C.first_reason(rules).alias("reason"))


@query("""select task, round, lag('task:' || task || ':r' || round) over (partition by task order by round) as prior_round, round = coalesce(lag(round) over (partition by task order by round), 0) + 1 as follows
from (select distinct l_orderkey as task, l_linenumber as round from lineitem)""")
def round_chain(spark, sf_dir):
    rounds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("round")).distinct()
    name = F.concat(F.lit("task:"), F.col("task").cast("string"), F.lit(":r"), F.col("round").cast("string"))
    return C.round_chain(rounds, "task", "round", name)


@query("""select event_id from (select event_id, row_number() over (partition by nonce order by ms, event_id) as r from (
  select event_id, epoch_us(ts) // 1000 as ms, user_id * 100 + cast(floor(value) as int) as nonce, (event_id % 13 - 6) * 60000 as skew from events) where abs(skew) <= 300000) where r = 1""")
def replay_window(spark, sf_dir):
    requests = event_ms(spark, sf_dir).select(
        "event_id", "ms", (F.col("user_id") * 100 + F.floor("value").cast("int")).alias("nonce"), (F.col("ms") + (F.col("event_id") % 13 - 6) * 60_000).alias("signed")
    )
    return C.replay_protected(requests, "nonce", "ms", "signed", 300_000, "event_id").select("event_id")


@query(f"""select c_custkey, least(730, greatest(30, cast(floor(c_acctbal / 10) as int))) as days, greatest({NOW} + 86400000, coalesce(max(epoch_us(o_orderdate) // 1000), 0) + cast(least(730, greatest(30, cast(floor(c_acctbal / 10) as int))) as bigint) * 86400000) as retry_at
from customer left join orders on o_custkey = c_custkey group by c_custkey, c_acctbal""")
def retention_retry(spark, sf_dir):
    """Retention days within limits, and when erasure is tried again."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(_ms("o_orderdate")).alias("at"))
    days = F.least(F.lit(730), F.greatest(F.lit(30), F.floor(F.col("c_acctbal") / 10).cast("int")))
    people = table(spark, sf_dir, "customer").select("c_custkey", days.alias("days")).join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    retry = F.greatest(F.lit(NOW + 86_400_000), F.coalesce("at", F.lit(0)) + F.col("days").cast("long") * 86_400_000)
    return people.select("c_custkey", "days", retry.alias("retry_at"))


@query(_FOLD)
def stream_state_machine(spark, sf_dir):
    """The guarded fold as a stream, its events folded in chunks: the final states equal the batch's."""
    from attestia.streaming import machine
    from attestia.streaming.admission import HOUR_US, Admission

    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("event_id").cast("string").alias("key"), F.lit("").alias("payload"), F.col("event_type").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"),
    )
    path = machine.stream_path(spark, "machine")
    gate = Admission(spark, path, STEPS, "signup", F.floor(F.col("at") / (24 * HOUR_US)))
    machine.arrivals([log], gate, path)
    reached = gate.accepted().groupBy("entity").agg(F.max_by("kind", F.struct("at", "id")).alias("state"), F.count(F.lit(1)).cast("int").alias("version"))
    refused = gate.rejected().groupBy("entity").agg(F.count(F.lit(1)).cast("int").alias("rejected"))
    zero = F.lit(0)
    return reached.join(refused, "entity", "full_outer").select(
        F.col("entity").alias("user_id"), F.coalesce("state", F.lit("signup")).alias("state"), F.coalesce("version", zero).alias("version"), F.coalesce("rejected", zero).alias("rejected")
    )


@query("""with finals as (select l_orderkey, l_linenumber, min(l_partkey) as receipt, sha256('f' || min(l_partkey)) as root, bool_or(l_returnflag = 'A') as active from lineitem group by all),
receipts as (select l_orderkey, l_linenumber, case when min(l_suppkey) % 3 = 0 then '0' else sha256('f' || min(l_partkey)) end as root, min(l_suppkey) as number from lineitem group by all),
appeals as (select distinct l_orderkey as k from lineitem where l_tax >= 0.08),
tasks as (select o_orderkey, (select max(receipt) from finals where l_orderkey = o_orderkey and active) as active_receipt from orders where o_orderstatus <> 'O' and o_orderkey % 4 > 0)
select o_orderkey as task_id, f.l_linenumber as round_id, f.root, number as receipt from tasks join finals f on f.l_orderkey = o_orderkey and f.receipt = active_receipt and active
join receipts r on r.l_orderkey = o_orderkey and r.l_linenumber = f.l_linenumber and r.root = f.root where o_orderkey not in (select k from appeals)""")
def publication_receipts(spark, sf_dir):
    """Approved tasks whose active final result has a repository receipt of the same round and root."""
    items = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "task_id", "l_linenumber": "round_id"})
    items = dealt(items.select("task_id", "round_id", "l_partkey", "l_suppkey", "l_returnflag", "l_tax"), "task_id")
    root = F.sha2(F.concat(F.lit("f"), F.min("l_partkey").cast("string")), 256)
    finals = items.groupBy("task_id", "round_id").agg(F.min("l_partkey").alias("receipt_id"), root.alias("root"), F.when(F.bool_or(F.col("l_returnflag") == "A"), "active").otherwise("superseded").alias("status"))
    receipts = items.groupBy("task_id", "round_id").agg(F.when(F.min("l_suppkey") % 3 == 0, "0").otherwise(root).alias("root"), F.min("l_suppkey").alias("receipt"))
    active = finals.filter("status = 'active'").groupBy("task_id").agg(F.max("receipt_id").alias("active_receipt"))
    key = F.col("o_orderkey")
    tasks = table(spark, sf_dir, "orders").select(
        key.alias("task_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("approved").alias("state"), F.when(key % 4 == 0, "pending").otherwise("accepted").alias("repository_status"), _ms("o_orderdate").alias("appeal_deadline")
    ).join(active, "task_id", "left")
    appeals = items.filter("l_tax >= 0.08").select("task_id", F.lit("pending").alias("status"))
    return C.publishable(tasks, appeals, finals, receipts, 4_102_444_800_000)


@query("""select user_id, coalesce(max(case when event_type = 'purchase' and value > 60 then event_id end), 0) as watermark from events group by user_id""")
def receipt_watermarks(spark, sf_dir):
    """The highest receipt of each subject; 0 where there is none."""
    given = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.max(given), F.lit(0).cast("long")).alias("watermark"))


_ROLES = """requests as (select o_orderkey as id, o_custkey as person, o_orderkey as task, case o_orderkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'J1' else 'J2' end as role,
  case o_orderkey % 5 when 0 then 'open' when 1 then 'independent-review' when 2 then 'discussion' when 3 then 'final-review' else 'discussion' end as state, o_orderkey % 50 as family, o_orderkey % 13 > 0 as open from orders),
seats as (select l_suppkey as person, l_orderkey * 2 as task, (l_orderkey * 2) % 50 as family, case l_linenumber when 1 then 'A' when 2 then 'B' when 3 then 'J1' else 'J2' end as role from lineitem where l_linenumber <= 4 and l_returnflag = 'R'),
raters as (select l_orderkey as task, count(*) as n, count(distinct part) as roots from (select l_orderkey, l_linenumber, min(l_partkey) as part from lineitem where l_linenumber <= 2 and l_linestatus = 'O' group by all) group by l_orderkey)"""


@query(f"""with {_ROLES} select id as request_id, case when not open then 'round-closed'
  when not ((role in ('A', 'B') and state in ('open', 'independent-review')) or (role = 'J1' and state = 'discussion') or (role = 'J2' and state = 'final-review')) then 'role-state'
  when exists (select 1 from seats s where s.person = r.person and (s.task = r.task or s.family = r.family)) then 'participated'
  when exists (select 1 from seats s where s.task = r.task and s.role = r.role) then 'occupied'
  when role = 'J1' and coalesce((select n from raters x where x.task = r.task), 0) <> 2 then 'raters-missing'
  when role = 'J1' and (id % 3 = 0 or (select roots from raters x where x.task = r.task) <> 2) then 'raters-other'
  when role = 'J2' and (id % 7 = 0 or id % 11 = 0) then 'proposal-missing' else 'eligible' end as reason from requests r""")
def role_requests(spark, sf_dir):
    """Why a request for a role is refused: its round, the task's state, the user's family, the seat, and what the judges rest on."""
    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    root = lambda c: F.sha2(c.cast("string"), 256)
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rated = items.filter("l_linenumber <= 2 and l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    raters = rated.select(name(F.col("l_orderkey")).alias("round_id"), F.when(line == 1, "A").otherwise("B").alias("role"), root(F.col("part")).alias("root"))
    roots = rated.groupBy("l_orderkey").agg(F.collect_set(root(F.col("part"))).alias("roots"))
    role = F.when(key % 4 == 0, "A").when(key % 4 == 1, "B").when(key % 4 == 2, "J1").otherwise("J2")
    requests = orders.join(roots, key == F.col("l_orderkey"), "left").select(
        key.alias("request_id"), F.col("o_custkey").alias("user_id"), key.alias("task_id"), name(key).alias("round_id"), role.alias("role"),
        F.when(key % 3 == 0, F.array(F.lit("other"))).otherwise(F.col("roots")).alias("roots"), name(key).alias("receipt_id"), F.when(key % 11 == 0, "other").otherwise(root(key)).alias("root"),
    )
    state = F.when(key % 5 == 0, "open").when(key % 5 == 1, "independent-review").when(key % 5 == 3, "final-review").otherwise("discussion")
    tasks = orders.select(key.alias("task_id"), state.alias("state"), (key % 50).alias("holdout_id"))
    rounds = orders.select(name(key).alias("round_id"), F.when(key % 13 == 0, "closed").otherwise("open").alias("status"))
    task = F.col("l_orderkey") * 2
    taken = F.when(line == 1, "A").when(line == 2, "B").when(line == 3, "J1").otherwise("J2")
    seats = items.filter("l_linenumber <= 4 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("user_id"), task.alias("task_id"), (task % 50).alias("holdout_id"), name(task).alias("round_id"), taken.alias("role"))
    proposals = orders.filter(key % 7 != 0).select(name(key).alias("round_id"), name(key).alias("receipt_id"), root(key).alias("root"))
    return C.role_eligibility(requests, tasks, rounds, seats, raters, proposals)


@query("""with hot as (select event_id, case when event_id % 2 = 0 then 0 else user_id end as subject, event_type, ts from events)
select event_id, row_number() over (partition by subject order by ts, event_id) as version, lag(event_type) over (partition by subject order by ts, event_id) as before from hot""")
def state_versions_hot(spark, sf_dir):
    """Versions and states before, where one subject has half of all events: its chain is cut into ranges."""
    from attestia.operators.ordered import chained

    subject = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id"))
    rows = table(spark, sf_dir, "events").select("event_id", subject.alias("subject"), "event_type", "ts")
    return chained(rows, "subject", "event_type", "ts", "event_id").select("event_id", "version", "before")
