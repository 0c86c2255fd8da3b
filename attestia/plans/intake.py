"""Queries over what comes in and goes out: program lines, statements, identifiers, chains and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.operators.consensus import verify_chain
from attestia.plans.registry import registry
from attestia.session import table
from attestia.sources.documents import statement_lines
from attestia.sources.statements import Database

QUERIES, ORACLES, query = registry()


@query(r"""select program_id, line, trim(case when contains(raw, '#') then left(raw, strpos(raw, '#') - 1) else raw end) as text,
  regexp_replace(trim(case when contains(raw, '#') then left(raw, strpos(raw, '#') - 1) else raw end), '"[^"]*"', '""', 'g') as unquoted
from (select p_partkey as program_id, unnest(['define "' || p_name || '" by ' || p_brand || ' # a "note"', '', '# ' || p_name, '  show "' || p_type || '"']) as raw,
        unnest([1, 2, 3, 4]) as line from part)
where trim(case when contains(raw, '#') then left(raw, strpos(raw, '#') - 1) else raw end) <> ''""")
def program_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines of programs with comments, blank lines and quoted names, also with the quoted parts left out."""
    name = F.col("p_name")
    source = F.concat_ws("\n", F.concat(F.lit('define "'), name, F.lit('" by '), F.col("p_brand"), F.lit(' # a "note"')), F.lit(""), F.concat(F.lit("# "), name), F.concat(F.lit('  show "'), F.col("p_type"), F.lit('"')))
    lines = statement_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("program_id"), source.alias("source")))
    return lines.withColumn("unquoted", T.strip_quoted(F.col("text")))


@query("""with after as (
  select c_custkey, c_nationkey + 1 as c_nationkey, c_acctbal from customer where c_acctbal > 5000
  union all select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal <= 5000 and c_acctbal >= 0
  union all select -1, 3, 1.5)
select c_nationkey as nation, count(*) as people, cast(min(c_custkey) as bigint) as first_key from after where c_nationkey >= 2 group by c_nationkey""")
def statement_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update, a deletion and an insertion as one batch, then a prepared read of the new versions."""
    db = Database(spark, {"customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")})
    db.batch([
        db.prepare("update customer set c_nationkey = c_nationkey + ? where c_acctbal > ?").bind(1, 5000),
        db.prepare("delete from customer where c_acctbal < ?").bind(0),
        db.prepare("insert into customer (c_custkey, c_nationkey, c_acctbal) values (?, ?, ?)").bind(-1, 3, 1.5),
    ])
    return db.prepare(
        "select c_nationkey as nation, count(*) as people, cast(min(c_custkey) as bigint) as first_key from customer where c_nationkey >= ? group by c_nationkey"
    ).bind(2).all()


@query("""with own as (select event_id, user_id, lag(sha256(cast(event_id as varchar))) over (partition by user_id order by ts, event_id) as expected from events),
recorded as (select *, case when event_id % 11 = 0 then 'spoiled' else expected end as prior from own)
select event_id, user_id from recorded where prior is distinct from expected""")
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose recorded hash of the event before is not that event's; every eleventh is spoiled."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.sha2(F.col("event_id").cast("string"), 256).alias("state_hash"))
    recorded = F.lag("state_hash").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spoiled = own.withColumn("prior_state_hash", F.when(F.col("event_id") % 11 == 0, "spoiled").otherwise(recorded))
    return verify_chain(spoiled, "user_id", "state_hash", "prior_state_hash", "ts", "event_id").select("event_id", "user_id")


def _uuid_sql(c: str) -> str:
    h = f"md5({c})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


@query(f"""select c_custkey, case when c_custkey % 3 = 0 then 2 when c_custkey % 5 > 0 then 1 end as n, c_custkey % 3 = 0 or c_custkey % 5 > 0 as valid,
  case when c_custkey % 3 = 0 then {_uuid_sql("c_name")} || '|' || {_uuid_sql("c_mktsegment")} when c_custkey % 5 > 0 then {_uuid_sql("c_name")} end as ids from customer""")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of UUIDs with repeats and spaces: the first of each stays, in order; a list with anything else is null."""

    def uuid(c: str):
        h = F.md5(c)
        part = lambda at, n, before="": F.concat(F.lit(before), F.substring(h, at, n))
        return F.concat_ws("-", part(1, 8), part(9, 4), part(14, 3, "4"), part(18, 3, "8"), part(21, 12))

    key, first, second = F.col("c_custkey"), uuid("c_name"), uuid("c_mktsegment")
    given = F.when(key % 3 == 0, F.array(first, second, F.concat(F.lit(" "), first))).when(key % 5 == 0, F.array(first, F.lit("none"))).otherwise(F.array(first, first))
    found = T.unique_list(given, T.UUID, 20)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(found.isNotNull(), F.size(found)).alias("n"), found.isNotNull().alias("valid"), F.array_join(found, "|").alias("ids"))


@query("""with expired as (select o_orderkey as id from orders where o_orderdate < '1993-01-01'), stale as (select o_orderkey as id from orders where o_orderstatus = 'P')
select id, 'expired' as part from expired union all select id, 'failed' from stale where id not in (select id from expired)""")
def ids_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of a first set, and of a second those that the first has not, each with the state it goes to."""
    orders = table(spark, sf_dir, "orders")
    expired = orders.filter("o_orderdate < '1993-01-01'").select(F.col("o_orderkey").alias("id"))
    stale = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return expired.withColumn("part", F.lit("expired")).unionAll(stale.join(expired, "id", "left_anti").withColumn("part", F.lit("failed")))


@query("""select event_id, case when event_id % 4 = 0 or value is null or floor(value) = 0 then epoch_us(ts) // 1000 else cast(floor(value) as bigint) end as started_at from events""")
def started_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times, of which 0 and null mean the time of the last change."""
    given = F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(F.floor("value")).cast("long")
    changed = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(given, F.lit(0).cast("long")), changed).alias("started_at"))


@query("""select conv_id, bool_and(length(text) > 20) as every_long, bool_or(role = 'user') as some_user, min_by(text, turn) filter (role = 'assistant') as first_answer from conversations group by conv_id""")
def turn_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all, and any, turns of a conversation pass a test, and the first that passes another; one pass, no lists."""
    answer = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.bool_and(F.length("text") > 20).alias("every_long"), F.bool_or(F.col("role") == "user").alias("some_user"),
        F.min_by(F.when(answer, F.col("text")), F.when(answer, F.col("turn"))).alias("first_answer"),
    )


@query("""select event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' || chr(10) as pretty from events""")
def pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts laid out with two spaces and a line end."""
    return table(spark, sf_dir, "events").select("event_id", T.pretty_json(F.col("props")).alias("pretty"))


@query("""with copies as (select l_orderkey, l_linenumber from lineitem union all select l_orderkey, l_linenumber from lineitem where l_orderkey % 10 = 0)
select l_orderkey, l_linenumber, count(*) as uses from copies group by l_orderkey, l_linenumber having count(*) > 1""")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys that are used more than once; a tenth of the orders is given twice."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return keys.unionAll(keys.filter("l_orderkey % 10 = 0")).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
