"""Queries of the workflow around annotation tasks, over orders as tasks and their lines as submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions import hashing as H
from attestia.functions import text as T
from attestia.operators import documents as D
from attestia.operators import workflow as W
from attestia.plans.registry import registry, trimmed
from attestia.plans.scalar import HMAC_SQL
from attestia.plans.stateful import NOW, OUTBOX, outbox
from attestia.session import table

QUERIES, ORACLES, query = registry()

# One submission for each order and line number: lines that repeat a number are reduced to their first part.
LINES = """lines as (select l_orderkey, l_linenumber, min(l_partkey) as part, max(l_quantity) as quantity, min(l_returnflag) as flag from lineitem group by l_orderkey, l_linenumber)"""


def lines(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """`by_order` deals them out by order first, so that groups by order need no exchange of their own."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return (rows.repartition("l_orderkey") if by_order else rows).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag")
    )


@query(f"""with {LINES}, slots as (
  select l_orderkey, max(case when l_linenumber = 1 then part end) as a, max(case when l_linenumber = 2 then part end) as b,
    max(case when l_linenumber = 3 then part end) as j1, max(case when l_linenumber = 4 then part end) as j2,
    max(case when l_linenumber = 3 then cast(quantity as bigint) % 3 end) as novel,
    max(case when l_linenumber = 4 then case part % 3 when 0 then 'agree' when 1 then 'disagree' else 'recuse' end end) as decision
  from lines where flag <> 'R' and l_linenumber <= 4 group by l_orderkey
), moved as (
  select o_orderkey as task_id, case o_orderkey % 3 when 0 then 'independent-review' when 1 then 'discussion' else 'final-review' end as from_state,
    o_totalprice < 250000 as passed, slots.* from orders join slots on o_orderkey = l_orderkey)
select task_id, from_state,
  case from_state when 'independent-review' then 'discussion' when 'discussion' then case when novel > 0 then 'escalated' else 'final-review' end
    else case when decision = 'agree' then 'approved' else 'escalated' end end as to_state,
  case from_state when 'independent-review' then case when passed then 'independent-quorum-reached' else 'independent-disagreement-routed' end
    when 'discussion' then case when novel > 0 then 'novel-primary-decision' else 'primary-adjudication-proposed' end
    else case when decision = 'agree' then 'secondary-ratification-approved' else 'secondary-ratification-escalated' end end as event_type,
  case from_state when 'independent-review' then case when passed then 'independent-quorum-complete' else 'j1-adjudication-required' end
    when 'discussion' then case when novel > 0 then 'novel-primary-decision' else 'j1-final-root-proposed' end
    else case decision when 'agree' then 'j2-exact-root-cosign' when 'recuse' then 'accepted-recusal' else 'j2-disagreement' end end as reason_code,
  case from_state when 'independent-review' then 'independent-quorum:r' || task_id || ':' || a || ':' || b when 'discussion' then 'j1-proposal:' || j1 else 'j2-ratification:' || j2 end as idempotency_key,
  case from_state when 'independent-review' then false when 'discussion' then novel > 0 else decision <> 'agree' end as reissued
from moved where (from_state = 'independent-review' and a is not null and b is not null) or (from_state = 'discussion' and j1 is not null) or (from_state = 'final-review' and j2 is not null)""")
def reconcile_tasks(spark, sf_dir):
    """The step of every task whose round has what it waits for."""
    key = F.col("o_orderkey")
    state = F.when(key % 3 == 0, "independent-review").when(key % 3 == 1, "discussion").otherwise("final-review")
    round_id = lambda c: F.concat(F.lit("r"), c.cast("string"))
    tasks = table(spark, sf_dir, "orders").select(key.alias("task_id"), round_id(key).alias("round_id"), state.alias("state"), (F.col("o_totalprice") < 250_000).alias("passed"))
    n, part = F.col("l_linenumber"), F.col("part")
    role = F.when(n == 1, "A").when(n == 2, "B").when(n == 3, "J1").when(n == 4, "J2")
    submissions = lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("task_id"), round_id(F.col("l_orderkey")).alias("round_id"), role.alias("role"), part.alias("receipt_id"), (F.col("flag") != "R").alias("active"),
        (F.col("quantity").cast("long") % 3).alias("novel"), F.when(part % 3 == 0, "agree").when(part % 3 == 1, "disagree").otherwise("recuse").alias("decision"),
    )
    return W.reconcile(tasks, submissions)


@query(f"with {OUTBOX} select id, case when status = 'sending' and next_attempt <= {NOW} then 'pending' else status end as status from outbox")
def outbox_rearm(spark, sf_dir):
    """Deliveries whose claim has run out are pending again."""
    return W.rearm(outbox(spark, sf_dir), NOW).select("id", "status")


@query(f"""with {OUTBOX}, due as (select * from outbox where status = 'pending' and next_attempt <= {NOW} order by created_at, id limit 20)
select id, attempts, 'sending' as status, cast({NOW} + 600000 as bigint) as next_attempt from due""")
def outbox_claim(spark, sf_dir):
    return W.claim(outbox(spark, sf_dir), NOW).select("id", "attempts", "status", "next_attempt")


@query(f"""with {OUTBOX}, claimed as (select *, case id % 4 when 0 then 'skipped' when 1 then 'error 5' else 'sent' end as outcome from outbox where status = 'sending')
select id, case when outcome <> 'error 5' then outcome when attempts + 1 >= 5 then 'failed' else 'pending' end as status,
  case when outcome = 'skipped' then attempts else attempts + 1 end as attempts,
  case when outcome = 'error 5' then {NOW} + least(60, cast(power(2, attempts + 1) as bigint)) * 60000 else next_attempt end as next_attempt,
  case when outcome = 'sent' then cast({NOW} as bigint) end as sent_at, case when outcome = 'error 5' then outcome end as last_error from claimed""")
def outbox_settle(spark, sf_dir):
    """Claimed deliveries after they were sent, skipped, or failed and are tried again or given up."""
    result = F.when(F.col("id") % 4 == 0, "skipped").when(F.col("id") % 4 == 1, "error 5").otherwise("sent")
    claimed = outbox(spark, sf_dir).filter("status = 'sending'").withColumn("outcome", result)
    return W.settle(claimed, NOW).select("id", "status", "attempts", "next_attempt", "sent_at", "last_error")


@query(f"""with {LINES} select o_orderkey, c_mktsegment, l_linenumber as round, part from orders join lines on l_orderkey = o_orderkey and l_linenumber = 1 + o_orderkey % 3 join customer on c_custkey = o_custkey""")
def current_round_join(spark, sf_dir):
    """Tasks with their current round, which is a column and no key, and their owner."""
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (1 + F.col("o_orderkey") % 3).cast("int").alias("current"))
    rounds = lines(spark, sf_dir)
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    now = (tasks.o_orderkey == rounds.l_orderkey) & (tasks.current == rounds.l_linenumber)
    return tasks.join(rounds, now).join(owners, "o_custkey").select("o_orderkey", "c_mktsegment", F.col("l_linenumber").alias("round"), "part")


@query(f"""with {LINES}, sides as (select f.l_orderkey, f.l_linenumber, f.part % 4 as final, a.part % 4 as a, b.part % 4 as b, a.l_orderkey is null or b.l_orderkey is null as rejected
  from lines f left join lines a on a.l_orderkey = f.l_orderkey and a.l_linenumber = f.l_linenumber + 1 left join lines b on b.l_orderkey = f.l_orderkey and b.l_linenumber = f.l_linenumber + 2)
select l_linenumber as dimension, count(*) as units, cast(sum(case when rejected then 1 else 0 end) as bigint) as rejected,
  cast(sum(case when not rejected and final <> a and final <> b then 1 else 0 end) as bigint) as novel from sides group by l_linenumber""")
def three_way_novel(spark, sf_dir):
    """Final decisions joined to both raters' by unit: units that a rater lacks are rejected, others may be novel."""
    all_lines = lines(spark, sf_dir)
    side = lambda by: all_lines.select("l_orderkey", (F.col("l_linenumber") - by).alias("l_linenumber"), (F.col("part") % 4).alias("value"))
    sides = W.three_sides(side(0), side(1), side(2), ["l_orderkey", "l_linenumber"])
    fresh = ~F.col("rejected") & (F.col("final") != F.col("a")) & (F.col("final") != F.col("b"))
    return sides.groupBy(F.col("l_linenumber").alias("dimension")).agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sum(fresh.cast("long")).alias("novel")
    )


@query("""select column_name from (describe select * from documents) where column_name not in (select column_name from (describe select * from labels))""")
def target_columns(spark, sf_dir):
    """Columns of the documents that the label table lacks."""
    found = W.missing_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query(f"""with {LINES}, kept as (select l_orderkey, list(part) filter (l_linenumber <= 2) as required, list(part) filter (flag <> 'R') as stored, list(part order by l_linenumber) as items from lines group by l_orderkey)
select l_orderkey, len(list_distinct(coalesce(required, []))) = 2 and len(list_filter(coalesce(required, []), lambda x: not list_contains(coalesce(stored, []), x))) = 0 as covered,
  case when len(items) <= 6 then array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), ',') end as listed,
  len(list_distinct(list_concat(coalesce(required, []), coalesce(stored, [])))) as to_delete from kept""")
def root_coverage(spark, sf_dir):
    """Whether the roots that a round requires are stored, its parts as a list of unique items, and ids to delete."""
    kept = lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_linenumber") <= 2, F.col("part"))).alias("required"), F.collect_list(F.when(F.col("flag") != "R", F.col("part"))).alias("stored"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))), lambda x: x["part"]).alias("items"),
    )
    listed = F.array_join(W.unique_list(F.col("items"), 6), ",")
    return kept.select("l_orderkey", W.covers(F.col("required"), F.col("stored")).alias("covered"), listed.alias("listed"), F.size(F.array_union("required", "stored")).cast("long").alias("to_delete"))


@query("""select event_id, case when event_id % 3 = 0 then user_id else coalesce(nullif(user_id % 5, 0), user_id) end as started, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def typed_payloads(spark, sf_dir):
    """JSON text columns read into typed columns, and start times that fall back on the last change."""
    user = F.col("user_id")
    noted = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(user % 5)
    payload = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", W.started(noted, user).alias("started"), payload["k"].alias("k"))


@query("""select conv_id, 'sentence' as place, text from conversations where turn % 2 = 1 and trim(text) <> '' union all
select conv_id, 'token', role from conversations where turn % 3 = 0 union all select conv_id, 'rationale', min(text) from conversations where conv_id % 2 = 0 group by conv_id""")
def note_texts(spark, sf_dir):
    """Free texts at the known places of nested documents, for screening."""
    turn = F.col("turn")
    token = F.struct(turn.alias("tokenId"), F.when(turn % 3 == 0, F.col("role")).alias("resolutionNote"))
    sentence = F.struct(turn.alias("sentenceId"), F.when(turn % 2 == 1, F.col("text")).otherwise(" ").alias("note"), F.array(token).alias("tokens"))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_list(sentence).alias("sentences"), F.when(F.col("conv_id") % 2 == 0, F.min("text")).alias("rationale")
    )
    return W.note_texts(nested, "conv_id")


_BOUND = """bound as (select o_orderkey as "packetId", o_custkey as task, case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as claimed,
  sha256('p' || o_orderkey) as packet, sha256('f' || o_custkey) as final, case when o_orderkey % 7 = 0 then 'J1' else 'J2' end as slot,
  case o_orderkey % 5 when 0 then 'agree' when 1 then 'recuse' when 2 then 'maybe' else 'disagree' end as decision,
  case when o_orderkey % 3 = 0 then '  ' || o_orderpriority || repeat(chr(10), 20) else o_orderpriority || ' is what both judges have seen' end as rationale from orders)"""


@query(f"""with {_BOUND} select "packetId", reason from (
  select "packetId", unnest(list_filter([case when claimed <> task then 'identity' end, case when "packetId" % 13 = 0 then 'packet-root' end, case when claimed <> task then 'final-root' end,
    case when slot <> 'J2' then 'slot' end, case when decision = 'maybe' then 'decision' end, case when length(""" + trimmed("rationale") + f""") < 20 or length(rationale) > 4000 then 'rationale' end], lambda x: x is not null)) as reason from bound)""")
def ratification_binding(spark, sf_dir):
    """Ratifications that are not bound to the result they judge, with every reason."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    root = lambda tag, c: F.sha2(F.concat(F.lit(tag), c.cast("string")), 256)
    orders = table(spark, sf_dir, "orders")
    finals = orders.select(key.alias("packetId"), cust.alias("taskId"), root("p", key).alias("packetMerkleRoot"), root("f", cust).alias("finalRoot"))
    claimed = F.when(key % 11 == 0, cust + 1).otherwise(cust)
    rows = orders.select(
        key.alias("packetId"), claimed.alias("taskId"), F.when(key % 13 == 0, "0").otherwise(root("p", key)).alias("packetMerkleRoot"),
        root("f", claimed).alias("primaryAdjudicationMerkleRoot"), F.when(key % 7 == 0, "J1").otherwise("J2").alias("reviewerSlot"),
        F.when(key % 5 == 0, "agree").when(key % 5 == 1, "recuse").when(key % 5 == 2, "maybe").otherwise("disagree").alias("decision"),
        F.when(key % 3 == 0, F.concat(F.lit("  "), "o_orderpriority", F.lit("\n" * 20))).otherwise(F.concat("o_orderpriority", F.lit(" is what both judges have seen"))).alias("rationale"),
    )
    return W.ratification_rejects(rows, finals, ["taskId"])


@query(r"""with reports as (select conv_id * 1000 + turn as report_id, turn % 9 > 0 as privacy, case when conv_id % 4 = 0 then 'praise' else 'display' end as category,
  trim(left(text, 150)) as summary, trim(text) as details, case when role = 'user' then text else '' end as steps from conversations),
flagged as (select *, (regexp_matches(details, '[^\s@]+@[^\s@]+\.[^\s@]+') or regexp_matches(details, '(?:\+?\d[\s().-]*){7,}') or regexp_matches(details, '(?i)</?[a-z][^>]*>')
  or regexp_matches(details, '!\[[^\]]*\]\s*\(') or regexp_matches(details, '(?i)\b(?:javascript|data):') or regexp_matches(details, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) as unsafe from reports)
select report_id, unnest(list_filter([case when not privacy then 'privacy' end, case when category = 'praise' then 'category' end, case when length(summary) not between 10 and 160 or contains(summary, chr(10)) then 'summary' end,
  case when length(details) not between 20 and 4000 then 'details' end, case when length(trim(steps)) > 2000 then 'steps' end, case when unsafe then 'unsafe' end,
  case when regexp_matches(details, '(?i)(?:https?://|www\.)') or regexp_matches(details, '\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|Bearer\s+[A-Za-z0-9._~+/-]{12,})\b') then 'secret' end], lambda x: x is not null)) as reason from flagged""")
def issue_reports(spark, sf_dir):
    """Issue reports that may not be published, with every reason."""
    reports = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("report_id"), (F.col("turn") % 9 > 0).alias("privacy_confirmed"),
        F.when(F.col("conv_id") % 4 == 0, "praise").otherwise("display").alias("category"), F.substring("text", 1, 150).alias("summary"),
        F.col("text").alias("details"), F.when(F.col("role") == "user", F.col("text")).alias("steps"),
    )
    return W.issue_rejects(reports, plain=True)


@query(f"""with sent as (select c_custkey as envelope_id, case c_custkey % 4 when 0 then 'annotation-v2' when 1 then 'report-v1' when 2 then 'packet-v9' else 'annotation-v2' end as kind,
  c_name as payload, {HMAC_SQL('c_name')} as right_sign, c_custkey % 5 = 0 as spoiled, c_acctbal, c_mktsegment from customer)
select envelope_id, kind, case when spoiled then 'signature' when kind = 'packet-v9' then 'schema' when kind = 'annotation-v2' and c_acctbal < 0 then 'balance'
  when kind = 'report-v1' and c_mktsegment <> 'FURNITURE' then 'segment' else 'accepted' end as verdict from sent""")
def envelope_dispatch(spark, sf_dir):
    """Signed envelopes, dispatched by their schema: accepted, or the first rule that fails."""
    kind = F.col("c_custkey") % 4
    signature = F.when(F.col("c_custkey") % 5 == 0, "0").otherwise(H.hmac_sha256(F.col("c_name"), b"example key"))
    schema = F.when(kind == 1, "report-v1").when(kind == 2, "packet-v9").otherwise("annotation-v2")
    sent = table(spark, sf_dir, "customer").withColumns({"envelope_id": F.col("c_custkey"), "schema": schema, "payload": F.col("c_name"), "signature": signature})
    kinds = {"annotation-v2": {"balance": F.col("c_acctbal") >= 0}, "report-v1": {"segment": F.col("c_mktsegment") == "FURNITURE"}}
    return W.envelope_kinds(sent, b"example key", kinds)


@query("""with gone as (select distinct o_custkey as k from orders where o_totalprice > 400000 and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P'))
select 'orders' as name, count(*) as n, cast(0 as bigint) as erased from orders where o_custkey not in (select k from gone) union all
select 'events', count(*), 0 from events where user_id not in (select k from gone) union all
select 'customer', count(case when c_custkey not in (select k from gone) then c_name end), cast(sum(case when c_custkey in (select k from gone) then 1 else 0 end) as bigint) from customer""")
def erasure_cascade(spark, sf_dir):
    """Rows left in every table, and names left, once people who asked are erased; open orders hold back."""
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    person = orders.withColumnRenamed("o_custkey", "person")
    left = W.cascade(
        person.filter("o_totalprice > 400000"), person.filter("o_orderstatus = 'P'"), "person",
        {"orders": (orders, "o_custkey"), "events": (table(spark, sf_dir, "events"), "user_id")}, {"customer": (people, "c_custkey", ["c_name", "c_acctbal"])},
    )
    count = lambda name, n, e: left[name].agg(F.lit(name).alias("name"), n.alias("n"), F.coalesce(e, F.lit(0).cast("long")).alias("erased"))
    none = F.sum(F.lit(0).cast("long"))
    return count("orders", F.count(F.lit(1)), none).unionAll(count("events", F.count(F.lit(1)), none)).unionAll(count("customer", F.count("c_name"), F.sum(F.col("erased").cast("long"))))


@query("select c_custkey, case when c_custkey % 6 > 0 then lower(replace(c_name, '#', '.')) || '@example.com' end as mail from customer")
def mail_addresses(spark, sf_dir):
    """Addresses in compatibility forms and odd case, normalised; those without a sign are none."""
    sign = F.when(F.col("c_custkey") % 6 == 0, " at ").otherwise("＠")
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalise_email(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(".")), sign, F.lit("Example.COM "))).alias("mail"))


@query(f"select p_partkey, regexp_replace(lower({trimmed("chr(9) || ' De_f-' || p_name || chr(1614) || chr(13) || chr(10)")})" + r""", '[_\-\x{064B}-\x{065F}\x{0670}]', '', 'g') as surface,
  regexp_replace(lower('De_f-' || p_name || '''s'), '[\s_\-''`]', '', 'g') as label, 'say "" now ' as bare from part""")
def keyword_keys(spark, sf_dir):
    """Keys of surface keywords and JSON labels, and statements without their comments and quoted texts."""
    name = F.col("p_name")
    line = F.concat(F.lit('say "'), name, F.lit('" now # '), name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.surface_key(F.concat(F.lit("\t De_f-"), name, F.lit("َ\r\n"))).alias("surface"), T.json_key(F.concat(F.lit("De_f-"), name, F.lit("'s"))).alias("label"),
        T.strip_quoted(T.strip_comment(line)).alias("bare"),
    )


_PART = "coalesce(strlen({0}) || ':' || {0}, '-1:')"


@query("""with r as (select o_orderkey, [cast('demo-ratification-root-v2' as varchar), 'demo-ratification-v2', cast(o_custkey as varchar), '1', cast(o_orderkey as varchar), null, 'p1', sha256('p' || o_orderkey),
    cast(o_orderkey + 1 as varchar), sha256('f' || o_custkey), 'J2', 'judge ' || o_custkey % 7, 'true', 'false', case when o_custkey % 2 = 0 then 'true' end, o_orderstatus, o_orderpriority] as parts from orders)
select o_orderkey, sha256(array_to_string(list_transform(parts, lambda x: """ + _PART.format("x") + "), '')) as root from r")
def ratification_roots(spark, sf_dir):
    """Canonical roots of ratifications: every field in order, with its length; the rationale is trimmed."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fields = {
        "schema": F.lit("demo-ratification-v2"), "taskId": cust, "taskVersion": F.lit(1), "packetId": key, "holdoutId": F.lit(None).cast("string"), "protocolVersion": F.lit("p1"),
        "packetMerkleRoot": F.sha2(F.concat(F.lit("p"), key.cast("string")), 256), "primaryReceiptId": key + 1, "primaryAdjudicationMerkleRoot": F.sha2(F.concat(F.lit("f"), cust.cast("string")), 256),
        "reviewerSlot": F.lit("J2"), "reviewerPseudonym": F.concat(F.lit("judge "), (cust % 7).cast("string")), "reviewerIsHuman": F.lit(True), "reviewerIsSynthetic": F.lit(False),
        "independentFromImplementationTeam": F.when(cust % 2 == 0, True), "decision": F.col("o_orderstatus"), "rationale": F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in fields.items()]).select("o_orderkey", D.ratification_root().alias("root"))


_ERASURE_NOW, _ERASURE_DAYS = 946_684_800_000, 400


@query(f"""with due as (select c_custkey as id from customer where c_custkey % 3 > 0 and c_custkey % 10 < 8),
bounds as (select o_custkey, max(epoch_us(o_orderdate) // 1000) as latest, count(*) filter (where o_orderstatus = 'P') as active from orders group by o_custkey),
judged as (select id, coalesce(latest, 0) as latest, coalesce(active, 0) > 0 or coalesce(latest, 0) + {_ERASURE_DAYS * 86_400_000} > {_ERASURE_NOW} as later from due left join bounds on o_custkey = id),
items as (select o_custkey, count(*) filter (where o_orderkey % 4 > 0 or o_custkey % 5 = 0) as n from orders group by o_custkey)
select id, case when later then 'retry' when coalesce(n, 0) > 0 then 'deleting' else 'completed' end as outcome,
  case when later then greatest({_ERASURE_NOW} + 86400000, latest + {_ERASURE_DAYS * 86_400_000}) end as retry_at, case when later then 0 else coalesce(n, 0) end as items from judged left join items on o_custkey = id""")
def erasure_requests(spark, sf_dir):
    """Due requests: tried again while tasks are active or fresh, else deleting item by item until they are complete."""
    person, order = F.col("o_custkey"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        key.alias("id"), key.alias("user_id"), F.when(key % 3 == 0, "completed").otherwise("pending").alias("status"), F.when(key % 10 < 8, F.lit(0)).otherwise(F.lit(_ERASURE_NOW + 1)).cast("long").alias("eligible_after")
    )
    state = F.when(F.col("o_orderstatus") == "P", "discussion").when(order % 2 == 0, "published").otherwise("revoked")
    tasks = orders.select(order.alias("task_id"), state.alias("state"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"))
    submissions = orders.select(person.alias("user_id"), order.cast("string").alias("receipt_id"))
    done = orders.filter((order % 4 == 0) & (person % 5 != 0)).select(person.alias("request_id"), F.concat(order.cast("string"), F.lit(".json")).alias("blob_name"), F.lit("deleted").alias("status"))
    told, _ = W.erasures(requests, orders.select(person.alias("user_id"), order.alias("task_id")), tasks, submissions, done, _ERASURE_NOW, _ERASURE_DAYS)
    return told


@query(r"""with r as (select conv_id * 1000 + turn as report_id, conv_id % 9 as k from conversations)
select report_id, unnest(case k when 1 then ['secret'] when 2 then ['secret'] when 3 then ['portal-version'] when 4 then ['step', 'task-lane'] when 5 then ['task-version-id'] when 6 then ['summary', 'details'] when 7 then ['operational-mode', 'unsafe'] else [] end) as reason from r""")
def issue_context(spark, sf_dir):
    """Issue reports with credentials, links, a context out of order, or texts of white space."""
    k = F.col("conv_id") % 9
    reports = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("report_id"), F.lit(True).alias("privacy_confirmed"), F.lit("other").alias("category"),
        F.when(k == 6, "\n\tbroken\n   \n\n").otherwise("\tA  line\t\tof text\n").alias("summary"),
        F.when(k == 1, "The key is ghp_" + "a" * 24 + " as you see").when(k == 2, "Please look at WWW.example.org there").when(k == 6, "x" * 19 + "\r\n\n\n").when(k == 7, "It calls javascript: as one can see").otherwise("What is wrong\r\nwith it all\r").alias("details"),
        F.lit(" \n").alias("steps"), F.when(k == 3, "1.2").otherwise("1.22.333").alias("portal_version"), F.when(k == 4, 6).otherwise(5).alias("step"), F.when(k == 4, "fast").when(k == 0, "standard").alias("task_lane"),
        F.when(k != 7, k == 0).alias("operational_mode"), F.when(k == 5, "a:").when(k == 0, "a:1").alias("task_version_id"),
    )
    return W.issue_rejects(reports)


@query(r"""select page_id, regexp_replace(replace(html, '\', '\\'), '([`*_\[\]<>#@|])', '\\\1', 'g') as plain from pages""")
def markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_markdown(F.col("html")).alias("plain"))
