"""Queries over streams: rounds settled while submissions arrive, admissions with rejects, deadlines that fire by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import rounds as R
from attestia.plans.registry import registry
from attestia.plans.stateful import _PAIRS, STEPS
from attestia.plans.workflow import LINES, lines
from attestia.session import table
from attestia.streaming import machine
from attestia.streaming.admission import HOUR_US, Admission
from attestia.streaming.deadlines import Deadlines
from attestia.streaming.rounds import Rounds

QUERIES, ORACLES, query = registry()

POLICY = (0.7, 0.3, "raw-agreement")
_ROUNDS = f"""with {LINES}, units as (
  select l_orderkey as task, l_linenumber as unit, 'flag' as dimension, flag as a, case when part % 5 = 0 then 'X' else flag end as b,
    case when part % 41 = 0 then 'Z' when part % 3 = 0 then flag when part % 5 = 0 then 'X' else flag end as f from lines
  union all select l_orderkey, l_linenumber, 'size', cast(cast(floor(quantity / 10) as int) as varchar),
    case when part % 7 = 0 then null else cast(cast(floor(quantity / 10) as int) as varchar) end, cast(cast(floor(quantity / 10) as int) as varchar) from lines
), pairs as (select task, dimension, coalesce(a, 'null') as a, coalesce(b, 'null') as b, f from units),
totals as (select task, dimension, count(*) as n, cast(sum(case when a <> b then 1 else 0 end) as bigint) as d from pairs group by all),
lefts as (select task, dimension, a as label, count(*) as l from pairs group by all), rights as (select task, dimension, b as label, count(*) as r from pairs group by all),
chance as (select task, dimension, sum(cast(l as double) * r) as c from lefts join rights using (task, dimension, label) group by all),
scores as (select task, n, d, 1 - d / cast(n as double) as po, coalesce(c, 0) / (cast(n as double) * n) as pe from totals left join chance using (task, dimension)),
kappas as (select task, n, d, po, case when pe <> 1 then (po - pe) / (1 - pe) end as kappa from scores),
measured as (select task, cast(sum(n) as bigint) as units, cast(sum(d) as bigint) as disagreements,
  case when avg(po) < 0.7 then false when avg(kappa) is null then true else avg(kappa) >= 0.3 end as passed from kappas group by task),
judged as (select task, cast(sum(case when f <> a and f <> b then 1 else 0 end) as bigint) as novel from pairs group by task),
rounds as (select task, 'r' || task as round_id, units, disagreements, passed, novel, task % 5 > 0 as j1, task % 3 > 0 as j2,
  case task % 4 when 0 then 'disagree' when 1 then 'recuse' else 'agree' end as decision from measured join judged using (task) where task % 7 > 0)
select task as task_id, 1 as turn, 'discussion' as to_state, case when passed then 'independent-quorum-complete' else 'j1-adjudication-required' end as reason_code,
  'independent-quorum:' || round_id || ':A' || task || ':B' || task as idempotency_key, false as reissued, units, disagreements, passed, cast(null as bigint) as novel from rounds
union all select task, 2, case when novel > 0 then 'escalated' else 'final-review' end, case when novel > 0 then 'novel-primary-decision' else 'j1-final-root-proposed' end,
  'j1-proposal:J1' || task, novel > 0, null, null, null, novel from rounds where j1
union all select task, 3, case when decision = 'agree' then 'approved' else 'escalated' end,
  case decision when 'agree' then 'j2-exact-root-cosign' when 'recuse' then 'accepted-recusal' else 'j2-disagreement' end, 'j2-ratification:J2' || task, decision <> 'agree', null, null, null, null
from rounds where j1 and novel = 0 and j2"""
STEP = ["task_id", "turn", "to_state", "reason_code", "idempotency_key", "reissued", "units", "disagreements", "passed", "novel"]


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of submissions over orders and their lines: raters, a second try of the first, and both judges, in this order."""
    part, flag, task = F.col("part"), F.col("flag"), F.col("l_orderkey")
    size = F.floor(F.col("quantity") / 10).cast("int").cast("string")
    other = F.when(part % 5 == 0, "X").otherwise(flag)
    judge = F.when(part % 41 == 0, "Z").when(part % 3 == 0, flag).otherwise(other)
    unit = lambda a, b: F.array(*[F.struct(F.col("l_linenumber").cast("string").alias("unit"), F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("flag", a), ("size", b))])
    sides = {"A": (flag, size), "B": (other, F.when(part % 7 != 0, size)), "J1": (judge, size)}
    whole = lines(spark, sf_dir, by_order=True).groupBy(task).agg(*[F.flatten(F.collect_list(unit(*v))).alias(r) for r, v in sides.items()])
    decision = F.when(task % 4 == 0, "disagree").when(task % 4 == 1, "recuse").otherwise("agree")
    none = F.lit(None).cast("array<struct<unit:string,dimension:string,value:string>>")
    turns = [("A", F.lit(True), F.col("A"), 0), ("B", task % 7 > 0, F.col("B"), 1), ("A", task % 4 == 0, F.col("J1"), 2), ("J1", task % 5 > 0, F.col("J1"), 3), ("J2", task % 3 > 0, none, 4)]

    def row(role, given, units, turn):
        seq = F.lit(turn << 40).cast("long") + task
        named = [("role", F.lit(role)), ("receipt_id", F.concat(F.lit(role if turn != 2 else "again"), task.cast("string"))), ("seq", seq), ("decision", F.when(F.lit(role == "J2"), decision)), ("units", units)]
        return F.when(given, F.struct(*[c.alias(n) for n, c in named]))

    each = F.array_compact(F.array(*[row(*t) for t in turns]))
    return whole.select(task.alias("task_id"), F.concat(F.lit("r"), task.cast("string")).alias("round_id"), F.explode(each).alias("e")).select("task_id", "round_id", "e.*")


@query(_ROUNDS)
def rounds_settled(spark, sf_dir):
    """The steps of all rounds from their submissions: agreement, policy, novelty and decision in one plan."""
    return R.settle(submissions(spark, sf_dir), *POLICY).select(*STEP)


@query(_ROUNDS)
def stream_rounds(spark, sf_dir):
    """The same from submissions as they arrive in three parts, divided within roles; counts are kept as state."""
    path = machine.stream_path(spark, "rounds")
    turn, half = F.shiftright("seq", 40), F.col("task_id") % 2 == 0
    place = F.when(turn == 0, 0).when((turn == 1) & half, 0).when(turn < 3, 1).when((turn == 3) & half, 1).otherwise(2)
    submissions(spark, sf_dir).withColumn("place", place).write.partitionBy("place").parquet(f"{path}/parts")
    settled = Rounds(spark, path, POLICY)
    machine.deliveries(spark, [f"{path}/parts/place={n}" for n in range(3)], R.SUBMISSION, settled, path)
    return settled.events().select(*STEP)


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an idempotency key and a payload that may differ between uses of a key."""
    v = F.floor("value").cast("int").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", v).alias("key"), (F.col("event_id") % 4 == 0).cast("string").alias("payload"),
        F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"),
    )


@query(f"""with recursive steps(a, b) as (values {_PAIRS}), keyed as (
  select event_id, user_id, event_type, ts, event_id % 3 as part, event_id % 4 = 0 as payload, user_id || ':' || event_type || ':' || cast(floor(value) as int) as key from events
), ranked as (
  select *, row_number() over (partition by key order by part, ts, event_id) as use, first_value(payload) over (partition by key order by part, ts, event_id) as held,
    row_number() over (order by ts, event_id) as k from keyed
), fresh as (select *, row_number() over (partition by user_id order by part, k) as i from ranked where use = 1),
fold(user_id, i, part, state, last, now, event_id, tag) as (
  select distinct user_id, 0::bigint, -1::bigint, 'signup', 0::bigint, 0::bigint, -1::bigint, '' from fresh
  union all
  select f.user_id, o.i, o.part, case when x.late or a is null then f.state else o.event_type end, case when o.part > f.part then f.now else f.last end,
    case when x.late or a is null then f.now else greatest(f.now, o.k) end, o.event_id, case when x.late then 'late' when a is null then 'illegal' else 'accepted' end
  from fold f join fresh o on o.user_id = f.user_id and o.i = f.i + 1 left join steps on a = f.state and b = o.event_type,
  lateral (select o.k <= case when o.part > f.part then f.now else f.last end as late) x)
select event_id, tag from fold where i > 0 union all select event_id, case when payload = held then 'repeat' else 'conflict' end from ranked where use > 1""")
def stream_admission(spark, sf_dir):
    """Every event of a stream that comes in three parts out of order: accepted, or rejected with the reason."""
    path = machine.stream_path(spark, "admission")
    gate, log = Admission(spark, path, STEPS, "signup", F.floor(F.col("at") / (24 * HOUR_US))), arriving(spark, sf_dir)
    machine.arrivals([log.filter(F.col("id") % 3 == n) for n in range(3)], gate, path)
    return gate.accepted().unionByName(gate.rejected()).select(F.col("id").alias("event_id"), "tag")


@query("""select user_id, event_type, count(*) as n from (select distinct user_id, event_type, cast(floor(value) as int) as v from events) group by user_id, event_type""")
def stream_dedup(spark, sf_dir):
    """The first event of each idempotency key, whenever it comes; nothing is lost, repeats are rejects."""
    path = machine.stream_path(spark, "dedup")
    gate, log = Admission(spark, path), arriving(spark, sf_dir)
    machine.arrivals([log.filter(F.col("id") % 2 == n) for n in (1, 0)], gate, path)
    return gate.accepted().groupBy(F.col("entity").alias("user_id"), F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


DAY, LIFE = 86_400_000, 60 * 86_400_000
_TIMES = """times as (select o_orderkey as round, epoch_us(o_orderdate) // 1000 as opened, min(case when l_linenumber = 1 then epoch_us(l_shipdate) // 1000 end) as a,
  min(case when l_linenumber = 2 then epoch_us(l_shipdate) // 1000 end) as b from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber <= 2 group by all)"""


@query(f"""with {_TIMES}, mark as (select greatest(max(opened), max(a), max(b)) as now from times)
select round, case when a <= opened + {LIFE} and b <= opened + {LIFE} then 'reached' else 'expired' end as outcome,
  case when a <= opened + {LIFE} and b <= opened + {LIFE} then greatest(a, b) else opened + {LIFE} end as at from times, mark
where (a <= opened + {LIFE} and b <= opened + {LIFE}) or opened + {LIFE} <= now""")
def stream_deadlines(spark, sf_dir):
    """Rounds that reach their quorum, or expire by themselves, as three years of orders and shipments go by."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    opened = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round"), F.lit("open").alias("kind"), ms("o_orderdate").alias("at"))
    shipped = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "A").otherwise("B"), ms("l_shipdate"))
    known = shipped.join(opened.select("round"), F.col("l_orderkey") == F.col("round"), "left_semi")
    log, path = opened.unionAll(known), machine.stream_path(spark, "deadlines")
    watch = Deadlines(spark, path, ("A", "B"), LIFE, ttl=30 * DAY)
    year = F.year(F.timestamp_millis("at"))
    machine.arrivals([log.filter(year <= 1994), log.filter(year.between(1995, 1996)), log.filter(year > 1996)], watch, path)
    return watch.outcomes().select("round", "outcome", "at")
