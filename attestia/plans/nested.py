"""Nested-document queries: canonical roots over arrays, validation, completion and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions.hashing import canonical_part
from attestia.operators import consensus as C
from attestia.operators import documents as D
from attestia.plans.registry import registry
from attestia.session import table

QUERIES, ORACLES, query = registry()

_PART = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-1:')"


@query(f"""with items as (select l_orderkey, count(*) as n, string_agg({_PART('l_linenumber')} || {_PART("nullif(l_returnflag, 'R')")}, '' order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as body from lineitem group by l_orderkey)
select o_orderkey, sha256({_PART('o_orderkey')} || {_PART('o_orderstatus')} || {_PART('coalesce(n, 0)')} || coalesce(body, '')) as root from orders left join items on l_orderkey = o_orderkey""")
def nested_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical root of each order with its nested lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>>"))
    body = F.array_join(F.transform(lines, lambda x: F.concat(canonical_part(x["l_linenumber"]), canonical_part(F.nullif(x["l_returnflag"], F.lit("R"))))), "")
    head = [canonical_part(c) for c in (F.col("o_orderkey"), F.col("o_orderstatus"), F.size(lines))]
    return joined.select("o_orderkey", F.sha2(F.concat(*head, body), 256).alias("root"))


@query(r"""with c as (select conv_id * 1000 + turn as comment_id, role, trim(text) as body, text from conversations)
select comment_id, unnest(list_filter([
  case when role <> 'user' then 'category' end, case when length(body) not between 20 and 4000 then 'length' end,
  case when regexp_matches(text, '[^\s@]+@[^\s@]+\.[^\s@]+') then 'unsafe-email' end, case when regexp_matches(text, '(?:\+?\d[\s().-]*){7,}') then 'unsafe-phone' end,
  case when regexp_matches(text, '(?i)</?[a-z][^>]*>') then 'unsafe-raw_html' end, case when regexp_matches(text, '!\[[^\]]*\]\s*\(') then 'unsafe-markdown_image' end,
  case when regexp_matches(text, '(?i)\b(?:javascript|data):') then 'unsafe-unsafe_url' end, case when regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') then 'unsafe-control' end], lambda x: x is not null)) as reason from c""")
def comment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.col("role").alias("category"), F.col("text").alias("body"))
    return D.comment_rejects(comments, ("user",))


@query("""with t as (select l_orderkey, l_linenumber, case when l_quantity > 10 then 'x' else '' end as upos, case when l_discount > 0.02 then 'x' else '' end as head,
  l_returnflag as relation, case when l_tax > 0.04 then 'nom' else '_' end as cat, case when l_linestatus = 'F' then 'x' else '' end as governor from lineitem),
each as (select l_orderkey, sum((upos <> '')::int + (head <> '')::int + (relation <> '')::int + (cat <> '')::int + case when cat <> '_' then (governor <> '')::int else 0 end) as done,
  sum(4 + (cat <> '_')::int) as total from t group by l_orderkey)
select l_orderkey as draft_id, cast(done + 1 as int) as completed, cast(total + 2 as int) as total, cast(floor(100.0 * (done + 1) / (total + 2) + 0.5) as int) as percentage from each""")
def draft_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion of drafts with one sentence whose tokens are line items."""
    mark = lambda c: F.when(c, "x").otherwise("")
    token = F.struct(
        mark(F.col("l_quantity") > 10).alias("upos"),
        mark(F.col("l_discount") > 0.02).alias("head"),
        F.col("l_returnflag").alias("relation"),
        F.when(F.col("l_tax") > 0.04, "nom").otherwise("_").alias("irabCategory"),
        mark(F.col("l_linestatus") == "F").alias("irabHead"),
    )
    drafts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("draft_id")).agg(F.collect_list(token).alias("tokens"))
    sentence = F.struct(F.lit("yes").alias("structural"), F.lit("").alias("predicate"), "tokens")
    return D.completion(drafts.select("draft_id", F.array(sentence).alias("fields")))


@query("""with chained as (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select event_id, '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Event | ' || event_id || ' |' || chr(10) || '| From | ' || coalesce(before, '—') || ' |' || chr(10)
  || '| To | ' || event_type || ' |' || chr(10) || '| Reason | a&#124;b &lt;c&gt; |' as card from chained""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.chain(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "ts", "event_id")
    return D.evidence_card(rows.select("event_id", F.col("before").alias("from_state"), F.col("event_type").alias("to_state"), F.lit("a|b <c>").alias("reason")))


@query("""with c as (select conv_id * 1000 + turn as comment_id, conv_id % 8 as r, turn from conversations)
select comment_id, unnest(list_filter([case when r = 1 then 'length' end, case when r = 2 then 'target' end, case when r = 3 then 'parent' end, case when r = 4 then 'sentence' end,
  case when r = 5 and turn % 3 > 0 then 'token' end, case when r = 6 then 'mentions' end, case when r = 7 then 'references' end], lambda x: x is not null)) as reason from c""")
def comment_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments whose places, receipts or length are not in order; white space alone is no text."""
    r, turn = F.col("conv_id") % 8, F.col("turn")
    h = F.md5(turn.cast("string"))
    part = lambda at, n, before="": F.concat(F.lit(before), F.substring(h, at, n))
    uid = F.concat_ws("-", part(1, 8), part(9, 4), part(14, 3, "4"), part(18, 3, "8"), part(21, 12))
    many = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: uid)
    comments = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("comment_id"), F.lit("other").alias("category"), F.when(r == 1, F.lit("\n" * 30 + "short")).otherwise(F.lit("\tA comment of enough letters\n")).alias("body"),
        F.when(r == 2, "none").when(r == 0, F.concat(F.lit(" "), uid)).alias("targetReceiptId"), F.when(r == 3, F.substring(uid, 1, 35)).otherwise(F.lit(" \n")).alias("parentCommentId"),
        F.when(r == 4, F.lit("s" * 121)).otherwise(F.lit(" " + "s" * 120)).alias("sentenceId"), F.when((r == 5) & (turn % 3 == 1), "1.5").when((r == 5) & (turn % 3 == 2), "100001").otherwise("1e5").alias("tokenId"),
        F.when(r == 6, many).otherwise(F.array(uid, uid)).alias("mentionedReceiptIds"), F.when(r == 7, F.array(uid, F.lit("x"))).alias("referencedReceiptIds"),
    )
    return D.comment_rejects(comments, ("other",))
