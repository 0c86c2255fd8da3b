"""Joins, aggregates, windows, top-k and set operations of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import relational as R
from attestia.plans.registry import registry
from attestia.session import table

QUERIES, ORACLES, query = registry()


def event_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in epoch milliseconds."""
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query("select o_orderstatus, o_orderpriority, count(*) as seats from orders group by all")
def seat_occupancy(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("seats"))


@query("""select c_custkey, c_name, o.o_orderkey, o.o_totalprice from customer left join (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) o on o.o_custkey = c_custkey and o.r = 1""")
def latest_child(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.latest_child(people, orders, "c_custkey", "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(
        "c_custkey", "c_name", "o_orderkey", "o_totalprice"
    )


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def first_seen_dedup(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""select o_orderkey, c_name, n_name, r_name, case when o_orderpriority = '1-URGENT' then 0 else 1 end as lane from orders
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where o_orderstatus = 'O' and r_name in ('ASIA', 'EUROPE') order by lane, o_orderdate, o_orderkey limit 200""")
def inbox_join4(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lane = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1).alias("lane")
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate", lane)
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return (
        open_.join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region.filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
        .orderBy("lane", "o_orderdate", "o_orderkey")
        .limit(200)
        .select("o_orderkey", "c_name", "n_name", "r_name", "lane")
    )


@query("""select e.event_type, count(*) as messages, count(c.c_custkey) as people, count(o.o_orderkey) as tasks, count(s.s_suppkey) as parties,
  count(*) filter (where c.c_custkey is null and o.o_orderkey is null and s.s_suppkey is null) as orphans from events e
  left join customer c on e.event_type in ('view', 'click') and c.c_custkey = e.user_id * 20
  left join orders o on e.event_type in ('signup', 'purchase') and o.o_orderkey = e.event_id * 2
  left join supplier s on e.event_type = 'error' and s.s_suppkey = e.user_id group by e.event_type""")
def polymorphic_outbox(spark, sf_dir):
    """Messages refer to different tables by kind: the kind stays in the join condition."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    c, o, s = (table(spark, sf_dir, t).select(k) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")))
    joined = (
        e.join(c, F.col("event_type").isin("view", "click") & (F.col("c_custkey") == F.col("user_id") * 20), "left")
        .join(o, F.col("event_type").isin("signup", "purchase") & (F.col("o_orderkey") == F.col("event_id") * 2), "left")
        .join(s, (F.col("event_type") == "error") & (F.col("s_suppkey") == F.col("user_id")), "left")
    )
    orphan = F.col("c_custkey").isNull() & F.col("o_orderkey").isNull() & F.col("s_suppkey").isNull()
    return joined.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("c_custkey").alias("people"),
        F.count("o_orderkey").alias("tasks"),
        F.count("s_suppkey").alias("parties"),
        F.sum(orphan.cast("long")).alias("orphans"),
    )


_ARMS = """box as (select event_id as id, case event_type when 'view' then 'submission' when 'click' then 'comment' when 'purchase' then 'task-state' else 'other' end as kind, event_id as related_id, user_id as task_id,
  case event_id % 4 when 0 then 'pending' when 1 then 'sending' when 2 then 'sent' else 'failed' end as status, epoch_us(ts) // 1000 + (event_id % 3) * 86400000 as next_attempt, epoch_us(ts) // 1000 as created_at from events),
submissions as (select o_orderkey as id, o_orderstatus = 'F' as done from orders), comments as (select c_custkey * 3 as id, c_acctbal < 0 as done from customer), tasks as (select s_suppkey as task_id, s_suppkey % 5 = 0 as done from supplier),
taken as (select distinct case when l_linenumber = 1 then 'submission' else 'comment' end as kind, l_orderkey as related_id from lineitem where l_linenumber <= 2 and l_returnflag = 'R'),
states as (select distinct l_orderkey as related_id from lineitem where l_tax > 0.07), repos as (select p_partkey as related_id from part where p_size > 40)"""


@query(f"""with {_ARMS} select box.id, box.kind, box.related_id from box
  left join submissions s on box.kind = 'submission' and s.id = box.related_id left join comments c on box.kind = 'comment' and c.id = box.related_id left join tasks t on box.kind = 'task-state' and t.task_id = box.task_id
  left join taken r on box.kind = r.kind and r.related_id = box.related_id and box.kind in ('submission', 'comment') left join states e on box.kind = 'task-state' and e.related_id = box.related_id left join repos p on box.kind = 'task-state' and p.related_id = box.related_id
where box.kind in ('submission', 'comment', 'task-state') and r.related_id is null and (box.kind <> 'task-state' or (e.related_id is null and p.related_id is null))
  and (status in ('pending', 'sent') or (status = 'sending' and next_attempt <= 1705320000000)) and (box.kind <> 'submission' or not s.done) and (box.kind <> 'comment' or not c.done) and (box.kind <> 'task-state' or not t.done)""")
def evidence_claimable(spark, sf_dir):
    """Evidence of three kinds that may be claimed: each kind with its parent, and without any of its receipts."""
    from attestia.operators import queues as Q

    kind, number, items = F.col("event_type"), F.col("event_id"), table(spark, sf_dir, "lineitem")
    box = event_ms(spark, sf_dir).select(
        number.alias("id"), F.when(kind == "view", "submission").when(kind == "click", "comment").when(kind == "purchase", "task-state").otherwise("other").alias("kind"), number.alias("related_id"), F.col("user_id").alias("task_id"),
        F.when(number % 4 == 0, "pending").when(number % 4 == 1, "sending").when(number % 4 == 2, "sent").otherwise("failed").alias("status"), (F.col("ms") + (number % 3) * 86_400_000).alias("next_attempt"), F.col("ms").alias("created_at"),
    )
    parents = {
        "submission": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done")),
        "comment": table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id"), (F.col("c_acctbal") < 0).alias("done")),
        "task-state": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id"), (F.col("s_suppkey") % 5 == 0).alias("done")),
    }
    taken = lambda n: items.filter((F.col("l_linenumber") == n) & (F.col("l_returnflag") == "R")).select(F.col("l_orderkey").alias("related_id"))
    states = items.filter("l_tax > 0.07").select(F.col("l_orderkey").alias("related_id"))
    repos = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("related_id"))
    return Q.claimable(box, parents, {"submission": [taken(1)], "comment": [taken(2)], "task-state": [states, repos]}, 1_705_320_000_000)


@query("""select o_orderkey, o_orderstatus from orders where not exists (
  select 1 from lineitem where 'task-state:' || l_orderkey = 'task-state:' || o_orderkey and l_quantity > 40)""")
def missing_evidence_anti(spark, sf_dir):
    key = lambda c: F.concat(F.lit("task-state:"), F.col(c).cast("string"))
    evidence = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(key("l_orderkey").alias("evidence_id"))
    return table(spark, sf_dir, "orders").join(evidence, key("o_orderkey") == F.col("evidence_id"), "left_anti").select("o_orderkey", "o_orderstatus")


def _large(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_totalprice > 480000").select("o_custkey")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)")
def semi_exists(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_large(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_acctbal from customer where c_acctbal < 0 or c_custkey in (select o_custkey from orders where o_totalprice > 480000)")
def semi_in(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    marked = people.join(_large(spark, sf_dir).distinct().withColumn("large", F.lit(True)), F.col("c_custkey") == F.col("o_custkey"), "left")
    return marked.filter((F.col("c_acctbal") < 0) | F.col("large")).select("c_custkey", "c_acctbal")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)")
def anti_not_exists(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_large(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as revisions,
  (select o_orderpriority from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) as last_priority from customer""")
def scalar_count_subquery(spark, sf_dir):
    """Counts and a latest value for each parent, from one aggregation of the children."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("n"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"),
    )
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return people.join(each, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("revisions"), "last_priority")


@query("""select c_custkey, cast(coalesce(sum(case when o_orderstatus not in ('F') then 1 else 0 end), 0) as bigint) as open_tasks, max(o_orderdate) as updated_at,
  max(o_orderdate) + interval 730 day as erase_after from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def retention_boundary(spark, sf_dir):
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(~F.col("o_orderstatus").isin("F"), 1).otherwise(0)).alias("open"), F.max("o_orderdate").alias("updated_at")
    )
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return people.join(each, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("open", F.lit(0)).cast("long").alias("open_tasks"), "updated_at", (F.col("updated_at") + F.expr("interval 730 days")).alias("erase_after")
    )


@query("""select l_orderkey, count(*) as n, coalesce(sum(l_quantity), 0) as bytes, min(l_linenumber - 1) as low, max(l_linenumber - 1) as high,
  min(l_linenumber - 1) = 0 and max(l_linenumber - 1) = count(*) - 1 as complete from lineitem group by l_orderkey""")
def chunk_completeness(spark, sf_dir):
    from attestia.operators.queues import chunk_check

    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("part"), "l_quantity")
    return chunk_check(parts, "l_orderkey", "part", "l_quantity")


def _rate(width: int) -> str:
    return f"""select event_id, count(*) over (partition by user_id order by (epoch_us(ts) // 1000) range between {width} preceding and current row) as in_window from events"""


@query(_rate(3_600_000))
def rate_limit_hour(spark, sf_dir):
    return R.trailing_count(event_ms(spark, sf_dir).select("event_id", "user_id", "ms"), "user_id", "ms", 3_600_000, "in_window").select("event_id", "in_window")


@query(_rate(86_400_000))
def rate_limit_day(spark, sf_dir):
    return R.trailing_count(event_ms(spark, sf_dir).select("event_id", "user_id", "ms"), "user_id", "ms", 86_400_000, "in_window").select("event_id", "in_window")


_HOT = "hot as (select event_id, case when event_id % 2 = 0 then 0 else user_id end as subject, epoch_us(ts) // 1000 as ms from events)"


@query(f"""with {_HOT} select event_id, count(*) over (partition by subject order by ms range between 3600000 preceding and current row) as hour,
  count(*) over (partition by subject order by ms range between 604800000 preceding and current row) as week from hot""")
def rate_limit_hot(spark, sf_dir):
    """Trailing counts where one subject has half of all events: its rows are shared among tasks by slices of time."""
    subject = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id"))
    rows = event_ms(spark, sf_dir).select("event_id", subject.alias("subject"), "ms")
    hour = R.trailing_counts(rows, "subject", "ms", 3_600_000, "hour", "event_id")
    return R.trailing_counts(hour, "subject", "ms", 604_800_000, "week", "event_id").select("event_id", "hour", "week")


@query("""select event_id, gap, gap is null or gap >= 60000 as allowed, cast(case when gap < 60000 then ceil((60000 - gap) / 1000.0) else 0 end as bigint) as wait_seconds from (
  select event_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as gap from events)""")
def cooldown(spark, sf_dir):
    e = R.since_previous(event_ms(spark, sf_dir).select("event_id", "user_id", "ms"), "user_id", "ms", "event_id")
    wait = F.when(F.col("gap") < 60_000, F.ceil((60_000 - F.col("gap")) / 1000)).otherwise(0)
    return e.select("event_id", "gap", (F.col("gap").isNull() | (F.col("gap") >= 60_000)).alias("allowed"), wait.cast("long").alias("wait_seconds"))


@query("""with taken as (select o_custkey, list(distinct o_orderstatus) as t from orders group by o_custkey)
select o_custkey, list_aggregate(list_sort(list_filter(['A', 'F', 'O', 'P'], lambda x: not list_contains(t, x))), 'string_agg', ',') as free from taken""")
def seats_free(spark, sf_dir):
    taken = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("t"))
    return taken.select("o_custkey", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in "AFOP"]), "t")), ",").alias("free"))


@query("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 490000)
  or exists (select 1 from lineitem where l_suppkey = c_custkey and l_quantity >= 50) as conflict from customer""")
def conflict_union_all(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("k"))
    either = a.unionAll(b).distinct().withColumn("hit", F.lit(True))
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return people.join(either, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("conflict"))


@query("select o_orderstatus as role from orders union select l_returnflag from lineitem")
def occupied_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("role")).union(table(spark, sf_dir, "lineitem").select("l_returnflag")).distinct()


@query("""with a as (select l_orderkey, l_linenumber from lineitem), b as (select l_orderkey, l_linenumber from lineitem where l_linenumber < 7),
x as (select count(*) as only_left from (select * from a except all select * from b)), y as (select count(*) as only_right from (select * from b except all select * from a))
select only_left, only_right, only_left = 0 and only_right = 0 as equal from x, y""")
def coverage_equality(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.same_rows(a, a.filter("l_linenumber < 7"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def topk_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("select event_id, user_id from events where event_type = 'error' order by ts, event_id limit 20")
def fifo_dequeue(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").orderBy("ts", "event_id").limit(20).select("event_id", "user_id")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' order by o_orderdate desc, o_totalprice desc, o_custkey desc, o_orderkey desc limit 2")
def multi_key_top2(spark, sf_dir):
    keys = [F.desc(c) for c in ("o_orderdate", "o_totalprice", "o_custkey", "o_orderkey")]
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").orderBy(*keys).limit(2).select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 25 offset 100")
def page_offset(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        .offset(100)
        .limit(25)
        .select("l_orderkey", "l_linenumber")
    )


@query("select event_id, event_type from events where event_id not in (select event_id from events order by ts, event_id limit 1000)")
def delete_oldest_n(spark, sf_dir):
    return R.delete_oldest(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_id", "ts", 1000).select("event_id", "event_type")


@query("select distinct c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '2001-06-01'")
def recipients_distinct(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when n.c_custkey is not null and (o.c_custkey is null or n.version > o.version) then n.c_acctbal else o.c_acctbal end as c_acctbal,
  case when n.c_custkey is not null and (o.c_custkey is null or n.version > o.version) then n.version else o.version end as version
from (select c_custkey, c_acctbal, c_nationkey as version from customer) o
full join (select c_custkey + 1000 as c_custkey, -c_acctbal as c_acctbal, 12 as version from customer where c_custkey % 2 = 0) n on o.c_custkey = n.c_custkey""")
def upsert_guarded(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("version"))
    changes = current.filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000).alias("c_custkey"), (-F.col("c_acctbal")).alias("c_acctbal"), F.lit(12).alias("version"))
    return R.upsert(current, changes, ["c_custkey"], F.col("new.version") > F.col("old.version"))


_EDGES = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
_NODES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(f"""with recursive edges(child, parent) as (values {', '.join(map(str, _EDGES))}), nodes(node) as (values {', '.join(f"('{n}')" for n in _NODES)}),
walk(node, level) as (select node, 0 from nodes union all select child, level + 1 from walk join edges on parent = node)
select node, max(level) as level from walk group by node""")
def fk_topology(spark, sf_dir):
    return R.topological_levels(spark, spark.createDataFrame(_EDGES, "child string, parent string"), spark.createDataFrame([(n,) for n in _NODES], "node string"))
