"""Agreement queries over derived raters and reports over progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import agreement as A
from attestia.plans.registry import registry
from attestia.session import table

QUERIES, ORACLES, query = registry()


def bucket(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("int")


def rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived raters over line items, in three dimensions, one of them constant."""
    return A.pairs(
        table(spark, sf_dir, "lineitem"),
        {
            "size": (bucket(F.col("l_quantity"), 10), bucket(F.col("l_extendedprice"), 20_000)),
            "status": (F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N")),
            "constant": (F.lit("x"), F.lit("x")),
        },
    )


def rounded(scores: DataFrame) -> DataFrame:
    return scores.select("dimension", "n", "disagreements", F.round("raw", 9).alias("raw"), F.round("kappa", 9).alias("kappa"))


PAIRS = """
pairs as (
  select 'size' as dimension, cast(cast(floor(l_quantity / 10) as int) as varchar) as a, cast(cast(floor(l_extendedprice / 20000) as int) as varchar) as b from lineitem
  union all select 'status', l_returnflag, case when l_linestatus = 'F' then 'A' else 'N' end from lineitem
  union all select 'constant', 'x', 'x' from lineitem
)"""
SCORES = """
totals as (select dimension, count(*) as n, sum(case when a <> b then 1 else 0 end) as disagreements, avg(case when a = b then 1.0 else 0.0 end) as po from pairs group by dimension),
lefts as (select dimension, a as label, count(*) as l from pairs group by dimension, a),
rights as (select dimension, b as label, count(*) as r from pairs group by dimension, b),
chance as (select dimension, sum(cast(l as double) * r) as c from lefts join rights using (dimension, label) group by dimension),
scores as (
  select dimension, n, cast(disagreements as bigint) as disagreements, po as raw, coalesce(c, 0) / (cast(n as double) * n) as pe
  from totals left join chance using (dimension)
), kappas as (
  select dimension, n, disagreements, raw, case when pe <> 1 then (raw - pe) / (1 - pe) end as kappa from scores
)"""


@query(f"with {PAIRS}, {SCORES} select dimension, n, disagreements, round(raw, 9) as raw, round(kappa, 9) as kappa from kappas")
def agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.agreement(rater_pairs(spark, sf_dir)))


@query(f"""with {PAIRS}, {SCORES}, macro as (
  select cast(sum(n) as bigint) as units, bool_and(disagreements = 0) as exact, avg(raw) as macro_raw, avg(kappa) as macro_kappa from kappas)
select units, exact, round(macro_raw, 9) as macro_raw, round(macro_kappa, 9) as macro_kappa,
  case when macro_raw < 0.9 then false when macro_kappa is null then true else macro_kappa >= 0.8 end as passes_default,
  case when macro_raw < 0.2 then false when macro_kappa is null then true else macro_kappa >= 0.0 end as passes_lenient from macro""")
def agreement_macro_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.macro(A.agreement(rater_pairs(spark, sf_dir)))
    return m.select(
        "units",
        "exact",
        F.round("macro_raw", 9).alias("macro_raw"),
        F.round("macro_kappa", 9).alias("macro_kappa"),
        A.passes(F.col("macro_raw"), F.col("macro_kappa")).alias("passes_default"),
        A.passes(F.col("macro_raw"), F.col("macro_kappa"), 0.2, 0.0).alias("passes_lenient"),
    )


@query(f"""with pairs as (select 'quality-toxic' as dimension, cast(quality as varchar) as a, cast(1 - toxic as varchar) as b from labels), {SCORES}
select dimension, n, disagreements, round(raw, 9) as raw, round(kappa, 9) as kappa from kappas""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return rounded(A.agreement(A.pairs(labels, {"quality-toxic": (F.col("quality"), 1 - F.col("toxic"))})))


@query("""select l_returnflag, count(*) as units,
  cast(sum(case when f <> a and f <> b then 1 else 0 end) as bigint) as novel from (
  select l_returnflag, cast(floor(l_quantity / 10) as int) as a, cast(floor(l_extendedprice / 20000) as int) as b, l_linenumber as f from lineitem) group by l_returnflag""")
def novel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", bucket(F.col("l_quantity"), 10).alias("a"), bucket(F.col("l_extendedprice"), 20_000).alias("b"), F.col("l_linenumber").alias("f")
    )
    return units.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("units"), A.novel(units, "f", "a", "b").alias("novel"))


@query("""with source as (
  select l_orderkey, max(l_returnflag) as flag, count(*) as n from lineitem where l_discount > 0.05 group by l_orderkey)
select o_orderstatus, count(*) as rows_compared, cast(sum(case when s.l_orderkey is null then 2 when case o_orderstatus when 'O' then 'N' when 'F' then 'R' else 'A' end is not distinct from s.flag then 0 else 1 end) as bigint) as differences
from orders left join source s on o_orderkey = s.l_orderkey group by o_orderstatus""")
def decision_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("flag"))
    wanted = F.when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderstatus") == "F", "R").otherwise("A")
    final = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", wanted.alias("flag"))
    compared = A.differences(final, source, ["o_orderkey"], ["flag"], F.lit(2))
    return compared.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_compared"), F.sum("differences").cast("long").alias("differences"))


@query("""select field, value, count(*) as units from (
  select 'flag' as field, '"' || l_returnflag || '"' as value from lineitem
  union all select 'status', '"' || l_linestatus || '"' from lineitem
  union all select 'line', cast(l_linenumber as varchar) from lineitem
  union all select 'cheap', case when l_extendedprice < 1000 then null when l_discount = 0 then 'true' else 'false' end from lineitem) t
group by field, value""")
def units_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision units: text values keep their quotes, so that values of different types never meet."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    cheap = F.when(F.col("l_extendedprice") < 1000, None).otherwise((F.col("l_discount") == 0).cast("string"))
    wide = table(spark, sf_dir, "lineitem").select(
        quoted("l_returnflag").alias("flag"), quoted("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"), cheap.alias("cheap")
    )
    return wide.unpivot([], ["flag", "status", "line", "cheap"], "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("units"))


@query("""select o_orderpriority, count(*) as documents, cast(sum(n) as bigint) as tokens from (
  select o_orderkey, o_orderpriority, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by all) group by o_orderpriority""")
def nested_roundtrip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nested line items, whose items are counted inside the arrays."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("tokens"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    nested = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return nested.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.size("tokens"), F.lit(0))).cast("long").alias("tokens")
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion of each participant: the mean over assignments, a submitted one counting as complete."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.floor(100 * F.sum((F.col("l_linestatus") == "F").cast("int")) / F.count(F.lit(1)) + 0.5).cast("long").alias("percent")
    )
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    done = F.when(F.col("o_orderstatus") == "F", F.lit(100)).otherwise(F.coalesce("percent", F.lit(0)))
    each = orders.groupBy("o_custkey").agg(
        F.floor(F.avg(done) + 0.5).cast("long").alias("progress"),
        F.count(F.lit(1)).alias("assignments"),
        F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("submitted"),
        F.max("o_orderdate").alias("last_activity"),
    )
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    n, s = F.coalesce("assignments", F.lit(0)), F.coalesce("submitted", F.lit(0))
    status = F.when(n == 0, "not-started").when(s == n, "submitted").otherwise("in-progress")
    return people.join(each, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_mktsegment", F.coalesce("progress", F.lit(0)).alias("progress"), n.alias("assignments"), status.alias("status"), "last_activity"
    )


PROGRESS = """
percents as (select l_orderkey, cast(floor(100.0 * sum(case when l_linestatus = 'F' then 1 else 0 end) / count(*) + 0.5) as bigint) as percent from lineitem group by l_orderkey),
each as (
  select o_custkey, cast(floor(avg(case when o_orderstatus = 'F' then 100 else coalesce(percent, 0) end) + 0.5) as bigint) as progress, count(*) as assignments,
         sum(case when o_orderstatus = 'F' then 1 else 0 end) as submitted, max(o_orderdate) as last_activity
  from orders left join percents on o_orderkey = l_orderkey group by o_custkey),
progress as (
  select c_custkey, c_mktsegment, coalesce(progress, 0) as progress, coalesce(assignments, 0) as assignments,
         case when coalesce(assignments, 0) = 0 then 'not-started' when submitted = assignments then 'submitted' else 'in-progress' end as status, last_activity
  from customer left join each on c_custkey = o_custkey)"""


@query(f"with {PROGRESS} select * from progress")
def participant_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(spark, sf_dir)


@query(f"""with {PROGRESS} select c_mktsegment, count(*) as total, count(*) filter (where status = 'in-progress') as active,
  count(*) filter (where status = 'submitted') as completed, count(*) filter (where status = 'not-started') as not_started,
  cast(floor(avg(progress) + 0.5) as bigint) as average_progress from progress group by c_mktsegment""")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    having = lambda s: F.sum((F.col("status") == s).cast("long"))
    return progress(spark, sf_dir).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("total"),
        having("in-progress").alias("active"),
        having("submitted").alias("completed"),
        having("not-started").alias("not_started"),
        F.floor(F.avg("progress") + 0.5).cast("long").alias("average_progress"),
    )


@query("""with tokens as (select l_orderkey as o, l_linenumber as n, min(l_returnflag) as flag, min(l_partkey) as part from lineitem group by all),
sentences as (select o_custkey, o_orderkey, o_orderkey % 9 = 0 as missing, (o_orderkey % 7 = 0)::bigint + (o_orderkey % 4 = 0)::bigint as fields, count(n) as size,
  count(n) filter (where n % 4 = 0 or part % 5 = 0) as apart from orders left join tokens on o = o_orderkey group by all)
select o_custkey as doc, cast(sum(case when missing then 1 + size else fields + apart end) as bigint) as differences from sentences group by o_custkey""")
def sentence_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of final documents to their sources: customers as documents, orders as sentences, lines as tokens."""
    from attestia.operators import documents as D

    line, part, order = F.col("l_linenumber"), F.col("part"), F.col("o_orderkey")
    unique = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    token = lambda decision: F.struct(line.alias("token_id"), decision.alias("decision"))
    grouped = unique.groupBy("l_orderkey").agg(
        F.collect_list(token(F.col("flag"))).alias("final"), F.collect_list(F.when(line % 4 != 0, token(F.when(part % 5 == 0, "X").otherwise(F.col("flag"))))).alias("source")
    )
    rows = table(spark, sf_dir, "orders").join(grouped, order == F.col("l_orderkey"), "left")
    empty = F.array().cast(grouped.schema["final"].dataType)
    side = lambda tokens, apart: rows.select(F.col("o_custkey").alias("doc"), order.alias("sentence_id"), (order % 7 == (0 if apart else 7)).alias("structurallyAcceptable"), F.when(order % 4 == 0, F.lit(apart)).alias("completePredicate"), F.coalesce(tokens, empty).alias("tokens"))
    return D.sentence_differences(side("final", True), side("source", False).filter(F.col("sentence_id") % 9 != 0), "doc")
