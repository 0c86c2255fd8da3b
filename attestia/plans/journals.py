"""Queries over journals, templates, documents of several shapes and objects: writes replayed onto a snapshot, calls rendered, texts shredded, puts guarded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import shapes as S
from attestia.operators import templates as M
from attestia.operators.replay import Replayed, replay
from attestia.plans.registry import registry
from attestia.session import dealt, table
from attestia.sources import dumps
from attestia.sources.objects import ObjectStore
from attestia.streaming.machine import stream_path

QUERIES, ORACLES, query = registry()

# Requests over events, each with one operation: deletions of purchases, puts of the others; every tenth is journaled
# again, every fourteenth again with another payload, every thirteenth has a spoiled hash, every error an unknown tag.
_JOURNAL = """
first as (
  select 'q' || event_id as request, user_id % 3 as g, event_id as s, user_id * 7 as k, event_type as kind, value, event_id,
    case event_type when 'error' then 'pending' when 'signup' then case when event_id % 2 = 0 then 'failed' else 'applied' end else 'applied' end as status,
    case when value >= 10 then event_id end as receipt, '' as variant from events
), entries as (
  select * from first union all select * replace (s + 1000000 as s) from first where event_id % 10 = 0
  union all select * replace (s + 2000000 as s, 'x' as variant) from first where event_id % 14 = 0
), chosen as (
  select *, case when event_id % 13 = 0 then 'hash' when kind = 'error' and event_id % 2 = 0 then 'value' end as fault from entries
  where status = 'pending' or (status = 'applied' and (receipt is null or ((g, s) > (0, 500) and g < 2)))
), used as (select *, first_value(variant) over (partition by request order by g, s) as held, row_number() over (partition by request order by g, s) as use from chosen where fault is null)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    first = table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), number.cast("string")).alias("request_id"), (user % 3).alias("generation"), number.alias("sequence"), (user * 7).alias("key"), kind.alias("kind"), "value", number.alias("event_id"),
        F.when(kind == "error", "pending").when((kind == "signup") & (number % 2 == 0), "failed").otherwise("applied").alias("status"),
        F.when(F.col("value") >= 10, number).alias("receipt"), F.lit("").alias("variant"),
    )
    again = first.filter(number % 10 == 0).withColumn("sequence", F.col("sequence") + 1_000_000)
    other = first.filter(number % 14 == 0).withColumns({"sequence": F.col("sequence") + 2_000_000, "variant": F.lit("x")})
    entries = first.unionAll(again).unionAll(other)
    kind = F.col("kind")
    column = F.when(kind == "view", "c_acctbal").when(kind == "click", "c_name").when(kind == "signup", "c_nationkey").otherwise("c_mktsegment")
    tag = F.when(kind == "view", "number").when(kind == "click", "string").when(kind == "signup", "bigint").when(F.col("event_id") % 2 == 0, "unheard").otherwise("null")
    value = F.when(kind == "view", F.round("value").cast("int").cast("string")).when(kind == "click", F.concat(F.lit("n"), F.col("event_id").cast("string"), "variant")).when(kind == "signup", (F.col("event_id") % 25).cast("string"))
    put = F.struct(F.lit("put").alias("op"), "key", column.alias("column"), tag.alias("type"), value.alias("value"))
    gone = F.struct(F.lit("delete").alias("op"), "key", *[F.lit(None).cast("string").alias(c) for c in ("column", "type", "value")])
    payload = F.to_json(F.struct(F.array(F.when(kind == "purchase", gone).otherwise(put)).alias("operations"), "variant"))
    whole = entries.select("request_id", "generation", "sequence", "status", "receipt", payload.alias("payload"), "event_id")
    return whole.withColumn("payload_hash", F.when(F.col("event_id") % 13 == 0, "spoiled").otherwise(F.sha2("payload", 256))).drop("event_id")


def replayed(spark: SparkSession, sf_dir: str) -> Replayed:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment")
    return replay(base, requests(spark, sf_dir), "c_custkey", (0, 500), 2)


@query(f"""with {_JOURNAL}, ops as (select * from used where use = 1), gone as (select k, max((g, s)) as at from ops where kind = 'purchase' group by k),
puts as (select ops.*, row_number() over (partition by ops.k, kind order by g desc, s desc) as r from ops left join gone on gone.k = ops.k where kind <> 'purchase' and (gone.k is null or (g, s) > gone.at)),
last as (select k, max(case when kind = 'view' then round(value) end) as bal, max(case when kind = 'click' then 'n' || event_id || variant end) as name, max(case when kind = 'signup' then event_id % 25 end) as nation,
  bool_or(kind = 'view') as v, bool_or(kind = 'click') as c, bool_or(kind = 'signup') as n, bool_or(kind = 'error') as e from puts where r = 1 group by k),
base as (select c.*, g.k is not null as wiped from customer c left join gone g on g.k = c_custkey)
select coalesce(c_custkey, k) as c_custkey, case when c then name when not wiped then c_name end as c_name, case when v then bal when not wiped then c_acctbal end as c_acctbal,
  case when n then nation when not wiped then c_nationkey end as c_nationkey, case when e then null when not wiped then c_mktsegment end as c_mktsegment
from base full join last on k = c_custkey where k is not null or not wiped""")
def journal_replay(spark, sf_dir):
    """Customers after a journal of tagged writes and deletions has been replayed onto them."""
    return replayed(spark, sf_dir).table


@query(f"""with {_JOURNAL} select request as request_id, s as sequence, fault as reason from chosen where fault is not null
union all select request, s, case when variant <> held then 'conflict' else 'repeat' end from used where use > 1""")
def journal_rejects(spark, sf_dir):
    """Entries of the journal that were not applied, with the reason."""
    return replayed(spark, sf_dir).rejects.select("request_id", "sequence", "reason")


def called(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as templates, line items as calls, and their arguments, of which some are missing, unknown or hold places."""
    part, line = F.col("p_partkey"), F.col("l_linenumber")
    text = F.when(part % 11 == 0, "Open {name of {brand").when(part % 13 == 0, "No { } name").when(part % 2 == 0, "Part { name } of {brand}: {name}\n").otherwise("{brand}{size}")
    templates = table(spark, sf_dir, "part").select(part.alias("template_id"), text.alias("template"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + line).alias("call_id"), F.when(line == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("template_id"), "l_returnflag", "l_linestatus", line.alias("line"))
    items = dealt(items, "call_id").groupBy("call_id").agg(*[F.min(c).alias(c) for c in ("template_id", "l_returnflag", "l_linestatus", "line")])
    argument = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    given = F.array(
        argument("name", F.concat(F.lit("{brand}"), "l_returnflag")), argument("brand", F.when(F.col("line") != 3, F.col("l_linestatus"))), argument("size", F.when(F.col("line") == 5, F.lit("9")))
    )
    return templates, items.select("call_id", "template_id"), items.select("call_id", F.inline(given)).filter("value is not null")


_CALLS = """calls as (select l_orderkey * 8 + l_linenumber as id, min(case when l_linenumber = 7 then -l_partkey else l_partkey end) as t, min(l_returnflag) as flag, min(l_linestatus) as mode, min(l_linenumber) as line from lineitem group by 1),
kinds as (select p_partkey, case when p_partkey % 11 = 0 then 'open' when p_partkey % 13 = 0 then 'empty' when p_partkey % 2 = 0 then 'name' else 'size' end as kind from part),
used as (select calls.*, kind from calls left join kinds on p_partkey = t)"""


@query(f"""with {_CALLS} select id as call_id, case kind when 'name' then 'Part {{brand}}' || flag || ' of ' || mode || ': {{brand}}' || flag || chr(10) else mode || '9' end as text
from used where line <> 3 and (kind = 'name' or (kind = 'size' and line = 5))""")
def template_calls(spark, sf_dir):
    """Calls rendered from their templates by joins; places inside arguments are text."""
    templates, calls, arguments = called(spark, sf_dir)
    return M.rendered(calls, arguments, M.parsed(templates))


@query(f"""with {_CALLS} select case kind when 'open' then 'unterminated' else 'empty' end as kind, cast(p_partkey as varchar) as id, cast(null as varchar) as name from kinds where kind in ('open', 'empty')
union all select 'undefined', cast(id as varchar), null from used where kind is null
union all select 'missing', cast(id as varchar), 'brand' from used where kind in ('name', 'size') and line = 3
union all select 'missing', cast(id as varchar), 'size' from used where kind = 'size' and line <> 5
union all select 'unknown', cast(id as varchar), 'name' from used where kind = 'size' union all select 'unknown', cast(id as varchar), 'size' from used where kind = 'name' and line = 5""")
def template_diagnostics(spark, sf_dir):
    templates, calls, arguments = called(spark, sf_dir)
    return M.diagnostics(templates, calls, arguments, M.parsed(templates))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON of ten forms, by doc_id: each shape, some wrapped, some repeated, some malformed."""
    n, turn = F.col("doc_id"), F.col("doc_id") % 12
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    name = F.concat(F.lit('"packetId":"p'), (n - n % 2).cast("string"), F.lit('"'))
    text = F.substring_index(F.substring_index(quoted(F.substring("text", 1, 40)), '{"v":', -1), "}", 1)
    packet = F.concat(F.lit('{"schema":"annotation-packet-v1",'), name, F.lit(',"taskVersion":'), turn.cast("string"), F.lit(',"sentences":[{"sentenceId":"s","text":'), text, F.lit("}]}"))
    slot = F.when(n % 2 == 0, "A").otherwise("B")
    note = F.concat(F.lit('{"schema":"annotation-v1",'), name, F.lit(',"annotatorSlot":"'), slot, F.lit('"}'))
    decision = F.concat(F.lit("{"), name, F.lit(',"adjudicatorSlot":"J1"}'))
    made = F.concat(F.lit('{"kind":"adjudication-package","packet":'), packet, F.lit(',"adjudication":'), decision, F.lit("}"))
    form = (
        F.when(turn == 0, packet)
        .when(turn == 1, F.concat(F.lit(' {"artifact" : '), packet, F.lit("}")))
        .when(turn == 2, note)
        .when(turn == 3, F.concat(F.lit('{"packet":'), packet, F.lit(',"artifact":'), note, F.lit("}")))
        .when(turn == 4, F.concat(F.lit('{"kind":"independent-annotation","packet":'), packet, F.lit(',"annotation":'), note, F.lit("}")))
        .when(turn == 5, made)
        .when(turn == 6, F.concat(F.lit('{"kind":"ratification-package","ratification":{"decision":"agree"},"primaryArtifact":'), made, F.lit("}")))
        .when(turn == 7, F.concat(F.lit('{"schema":"annotation-draft-v1","role":"J2","packet":'), packet, F.lit("}")))
        .when(turn == 8, F.concat(F.lit('{"packet":'), packet, F.lit(',"annotation":'), note, F.lit("}")))
        .when(turn == 9, F.lit('{"kind":"ratification-package","primaryArtifact":{"kind":"none"}}'))
        .when(turn == 10, F.concat(F.lit('{"artifact":'), packet))
        .otherwise(F.lit('{"kind":"independent-annotation","packet":[]}'))
    )
    return table(spark, sf_dir, "documents").select("doc_id", form.alias("text"), "source")


@query("""with d as (select doc_id, doc_id % 12 as t, case when doc_id % 2 = 0 then 'A' else 'B' end as slot, 'p' || (doc_id - doc_id % 2) as p from documents),
again as (select doc_id, t, slot, p from d union all select doc_id + 1000000000, t, slot, p from d where t in (0, 2, 6) and doc_id % 5 = 0)
select doc_id, case when t in (0, 1) then 'packet' when t in (2, 3) then 'annotation' when t = 4 or t = 11 then 'annotation-artifact' when t = 5 then 'adjudication-artifact' when t = 6 then 'ratification-artifact'
    when t = 7 then 'draft' when t = 8 then 'container' when t = 9 then 'unknown' else 'malformed' end as kind,
  case when t in (2, 3, 4, 8) then slot when t in (5, 6) then 'ratification' when t = 7 then 'J2' end as role, t in (1, 3) as wrapped,
  case when t = 9 then 'unknown' when t = 10 then 'malformed' when t = 11 then 'hollow' when doc_id >= 1000000000 then 'duplicate' end as reason,
  case when t in (0, 1, 3, 4, 5, 6, 7, 8) then p end as packet, case when t in (2, 3, 4, 8) then p end as annotation, case when t in (5, 6) then 'J1' end as judge, case when t = 6 then 'agree' end as decision from again""")
def document_shapes(spark, sf_dir):
    """JSON texts of all shapes shredded into typed parts in one pass, copies in another layout and broken ones as rejects."""
    texts = shaped(spark, sf_dir).select("doc_id", "text")
    copies = texts.filter((F.col("doc_id") % 12).isin(0, 2, 6) & (F.col("doc_id") % 5 == 0)).select(F.col("doc_id") + 1_000_000_000, F.concat(F.lit(' {"artifact": '), "text", F.lit("}")))
    path = stream_path(spark, "texts")
    texts.unionAll(copies).write.parquet(path)
    found = S.shred(spark.read.parquet(path), "doc_id")
    wrapped = F.col("wrapped") & (F.col("doc_id") < 1_000_000_000)
    return found.select(
        "doc_id", "kind", "role", wrapped.alias("wrapped"), "reason", F.col("packet.packetId").alias("packet"), F.col("annotation.packetId").alias("annotation"),
        F.col("adjudication.adjudicatorSlot").alias("judge"), F.col("ratification.decision").alias("decision"),
    )


@query("""with named as (select c_custkey, case when c_custkey % 4 = 3 then 'identities' else 'submissions' end as scope, c_custkey % 5 = 0 as odd, c_custkey % 7 as r from customer)
select 1 as put, c_custkey, case when odd then 'invalid' else 'created' end as outcome from named union all
select 2, c_custkey, case when odd then 'invalid' when r = 0 then 'conflict' else 'same' end from named where c_custkey % 2 = 0 union all
select 3, c_custkey, 'stored' from named where not odd""")
def object_puts(spark, sf_dir):
    """Objects put once, and half of them again, some with other bytes; what is stored in the end."""
    key = F.col("c_custkey")
    h = F.md5("c_name")
    part = lambda at, n, before="": F.concat(F.lit(before), F.substring(h, at, n))
    uid = F.concat_ws("-", part(1, 8), part(9, 4), part(14, 3, "4"), part(18, 3, "8"), part(21, 12))
    scope = F.when(key % 4 == 3, "identities").otherwise("submissions")
    name = F.when(key % 5 == 0, F.concat(F.lit("../"), uid)).when(key % 4 == 1, F.concat(F.lit("comment-"), uid, F.lit(".json"))).when(key % 4 == 2, F.concat(uid, F.lit(".state.json"))).otherwise(F.concat(uid, F.lit(".json")))
    rows = table(spark, sf_dir, "customer").select(key, scope.alias("scope"), name.alias("name"), F.encode("c_name", "utf-8").alias("content"))
    other = F.when(key % 7 == 0, F.encode(F.lit("other"), "utf-8")).otherwise(F.col("content"))
    store = ObjectStore(spark, stream_path(spark, "objects"))
    first = store.put(rows)
    second = store.put(rows.filter(key % 2 == 0).withColumn("content", other))
    told = lambda put, found: rows.join(found, ["scope", "name"]).select(F.lit(put).alias("put"), "c_custkey", "outcome")
    stored = store.objects().select("scope", "name", F.lit("stored").alias("outcome"))
    return told(1, first).unionAll(told(2, second)).unionAll(told(3, stored))


@query("select doc_id, text, lang, n_chars * 1.5 as half from documents union all select conv_id * 1000 + turn, null, role, null from conversations")
def dump_import(spark, sf_dir):
    """Documents and turns written as an SQL dump, with quotes, semicolons, comments and line ends inside their strings, and read back in parallel."""
    text = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("-- it's a note; of a line\nINSERT INTO \"notes\" VALUES("), F.col("doc_id").cast("string"), F.lit(","), text(F.col("text")), F.lit(","), text(F.col("lang")), F.lit(","), (F.col("n_chars") * 1.5).cast("string"), F.lit(");")).alias("value")
    )
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("INSERT INTO notes (lang, doc_id)\n VALUES("), text(F.col("role")), F.lit(", "), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit("); SELECT ';';")))
    path = stream_path(spark, "dump")
    docs.unionAll(turns).write.text(path, lineSep="\n")
    return dumps.table(dumps.statements(spark, path), "notes", "doc_id long, text string, lang string, half double")
