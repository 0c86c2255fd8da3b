"""Queries over nested packets and annotations, built from conversations: one packet each, a sentence for each turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import documents as D
from attestia.plans.registry import registry
from attestia.session import table

QUERIES, ORACLES, query = registry()

_TASK = {"taskVersion": "1", "protocolId": "q", "guidelineVersion": "g", "dataVersion": "d", "protocolVersion": "v"}


def _text(value: str | None):
    return F.lit(value).cast("string")


def _identity(conv) -> dict:
    name = conv.cast("string")
    given = {"taskId": name, "packetId": F.concat(F.lit("p"), name), "holdoutId": _text(None)}
    return given | {k: F.lit(1) if k == "taskVersion" else _text(v) for k, v in _TASK.items()}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each conversation: its turns as sentences of two tokens (role and turn)."""
    turn = F.col("turn").cast("int")
    token = lambda i, form: F.struct(F.lit(i).alias("id"), form.alias("form"))
    sentence = F.struct(
        F.lpad(turn.cast("string"), 4, "0").alias("sentenceId"), "text", F.array(token(1, F.col("role")), token(2, turn.cast("string"))).alias("tokens")
    )
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(sentence)).alias("sentences"))
    policy = F.struct(
        F.lit(False).alias("automaticFinalization"), _text(None).alias("claimBoundary"), F.array(F.lit("raw")).alias("metrics"), F.lit(0.0).alias("minimumDefinedKappa"),
        F.lit(0.9).alias("minimumRawAgreement"), _text(None).alias("policyVersion"), F.lit("s").alias("schema"), _text(None).alias("undefinedKappaFallback"),
    )
    flags = {
        "releaseCandidateId": F.lit("r"), "pilotOnly": F.lit(True), "developerVisible": F.lit(False), "parserPredictionsExcluded": F.lit(True),
        "derivedFromExcludedCorpus": F.lit(False), "holdoutManifestSha256": _text(None),
    }
    return grouped.select(
        "conv_id", F.lit("demo-packet-v3").alias("schema"), *[c.alias(n) for n, c in _identity(F.col("conv_id")).items()], policy.alias("metricPolicy"),
        *[c.alias(n) for n, c in flags.items()], "sentences", F.lit(None).cast("array<string>").alias("instructions"),
    )


def annotations(spark: SparkSession, sf_dir: str, slot: str) -> DataFrame:
    """An annotation of each packet: every third names another root, every fourth has no slot, every fifth lacks a token."""
    all_packets = packets(spark, sf_dir).withColumn("root", D.packet_root())
    conv = F.col("conv_id")

    def token(t):
        odd = F.length(t["form"]) % 2 == 1
        values = {
            "universalPartOfSpeech": F.when(odd, "NOUN").otherwise("VERB"), "headTokenId": t["id"] - 1, "dependencyRelation": F.lit("nsubj"), "irabHeadTokenId": F.lit(None).cast("int"),
            "irabCategory": F.lit("_"), "irabNotApplicable": odd, "note": _text(None),
        }
        return F.struct(t["id"].alias("tokenId"), *[c.alias(n) for n, c in values.items()])

    def sentence(s):
        kept = F.when(conv % 5 == 0, F.slice(s["tokens"], 1, 1)).otherwise(s["tokens"])
        return F.struct(
            s["sentenceId"].alias("sentenceId"), (F.length(s["text"]) % 2 == 0).alias("structurallyAcceptable"), F.lit(True).alias("completePredicate"), _text("n").alias("note"),
            F.transform(kept, token).alias("tokens"),
        )

    return all_packets.select(
        "conv_id", F.lit("demo-annotation-v3").alias("schema"), F.when(conv % 3 == 0, "0").otherwise(F.col("root")).alias("packetMerkleRoot"), *D.TASK,
        F.when(conv % 4 == 0, "C").otherwise(slot).alias("annotatorSlot"), _text("x").alias("annotatorPseudonym"), F.lit(True).alias("isHuman"), F.lit(False).alias("isSynthetic"),
        *[F.lit(c != "parserPredictionsViewed").alias(c) for c in D.ORIGIN], F.transform("sentences", sentence).alias("sentences"),
    )


def _lp(*values: str) -> str:
    """SQL of length-prefixed values; a null is -1."""
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-1:')" for v in values)


_CONV, _ID, _FORM = "cast(conv_id as varchar)", "lpad(cast(turn as varchar), 4, '0')", "cast(turn as varchar)"
_TASK_SQL = (_CONV, "'1'", f"('p' || {_CONV})", "cast(null as varchar)", "'q'", "'g'", "'d'", "'v'")
_POLICY_SQL = """'{"automaticFinalization":false,"metrics":["raw"],"minimumDefinedKappa":0,"minimumRawAgreement":0.9,"schema":"s"}'"""
_BODY = f"string_agg({_lp(_ID, 'text')} || '1:2' || {_lp(chr(39) + '1' + chr(39), 'role', chr(39) + '2' + chr(39), _FORM)}, '' order by turn)"
_HEAD = _lp("'demo-packet-root-v3'", "'demo-packet-v3'", *_TASK_SQL, _POLICY_SQL, "'r'", "'true'", "'false'", "'true'", "'false'", "cast(null as varchar)")
PACKET_SQL = f"select conv_id, sha256({_HEAD} || {_lp('cast(count(*) as varchar)')} || {_BODY} || '1:0') as root from conversations group by conv_id"


@query(PACKET_SQL)
def packet_roots(spark, sf_dir):
    """Canonical roots of nested packets."""
    return packets(spark, sf_dir).select("conv_id", D.packet_root().alias("root"))


def _token_sql(i: int, form: str) -> str:
    odd = f"length({form}) % 2 = 1"
    return _lp(f"'{i}'", f"(case when {odd} then 'NOUN' else 'VERB' end)", f"'{i - 1}'", "'nsubj'", "cast(null as varchar)", "'_'", f"(case when {odd} then 'true' else 'false' end)", "cast(null as varchar)")


_ANNOTATED = f"""{_lp(_ID, "(case when length(text) % 2 = 0 then 'true' else 'false' end)", "'true'", "'n'")} || case when conv_id % 5 = 0 then '1:1' else '1:2' end || {_token_sql(1, 'role')} || case when conv_id % 5 = 0 then '' else {_token_sql(2, _FORM)} end"""
_ANNOTATION_HEAD = _lp(
    "'demo-annotation-root-v3'", "'demo-annotation-v3'", "(case when conv_id % 3 = 0 then '0' else root end)", *_TASK_SQL, "(case when conv_id % 4 = 0 then 'C' else 'A' end)", "'x'", "'true'", "'false'",
    "'true'", "'true'", "'false'",
)


@query(f"""with p as ({PACKET_SQL}), body as (select conv_id, count(*) as n, string_agg({_ANNOTATED}, '' order by turn) as b from conversations group by conv_id)
select conv_id, sha256({_ANNOTATION_HEAD} || {_lp('cast(n as varchar)')} || b) as root from p join body using (conv_id)""")
def annotation_roots(spark, sf_dir):
    """Canonical roots of nested annotations."""
    return annotations(spark, sf_dir, "A").select("conv_id", D.annotation_root().alias("root"))


@query("""with c as (select distinct conv_id from conversations) select 'p' || conv_id as "packetId", case when conv_id % 4 = 0 then 'C' else 'A' end as "annotatorSlot",
  unnest(list_filter([case when conv_id % 4 = 0 then 'slot' end, case when conv_id % 3 = 0 then 'packet-changed' end, case when conv_id % 5 = 0 then 'coverage' end], lambda x: x is not null)) as reason from c""")
def annotation_binding(spark, sf_dir):
    """Annotations that are not bound to their packet, with every reason."""
    return D.binding_rejects(annotations(spark, sf_dir, "A"), packets(spark, sf_dir))


@query("""with c as (select conv_id, max(turn) as last from conversations group by conv_id)
select 'p' || conv_id as "packetId", unnest(list_filter([case when conv_id % 7 = 0 then 'predictions-visible' end, case when conv_id % 6 = 0 then 'repeated-sentence' end], lambda x: x is not null)) as reason from c""")
def packet_rules(spark, sf_dir):
    """Packets that break a rule, with every reason."""
    conv = F.col("conv_id")
    rows = packets(spark, sf_dir).withColumn("holdoutId", F.lit("h")).withColumn("parserPredictionsExcluded", conv % 7 != 0)
    return D.packet_rejects(rows.withColumn("sentences", F.when(conv % 6 == 0, F.concat("sentences", "sentences")).otherwise(F.col("sentences"))))


@query("""with u as (select conv_id, count(*) as n from conversations group by conv_id)
select 'token.headTokenId' as dimension, cast(sum(2 * n) as bigint) as units, cast(sum(case when conv_id % 5 = 0 then n else 0 end) as bigint) as uncovered from u""")
def unit_alignment(spark, sf_dir):
    """Decision units of two raters side by side, and those that only one decided."""
    a = annotations(spark, sf_dir, "A")
    name = lambda rows: rows.withColumn("sentences", F.transform("sentences", lambda s: s.withField("sentenceId", F.concat(F.col("packetId"), F.lit("/"), s["sentenceId"]))))
    whole = packets(spark, sf_dir).select("packetId", F.explode("sentences").alias("s")).select(F.concat("packetId", F.lit("/"), "s.sentenceId").alias("sentence_id"), F.explode("s.tokens").alias("t"))
    first = D.units(name(a), F.lit("A"))
    second = whole.select(F.lit("B").alias("rater"), "sentence_id", F.col("t.id").alias("token_id"), F.lit("token.headTokenId").alias("field"), (F.col("t.id") - 1).cast("string").alias("value"))
    paired = D.side_by_side(first.unionByName(second), "A", "B").filter("dimension = 'token.headTokenId'")
    return paired.groupBy("dimension").agg(F.count(F.lit(1)).alias("units"), F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("long")).alias("uncovered"))


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packets, both annotations of each, and its adjudication; B doubts even turns, and some adjudications break a rule."""
    all_packets = packets(spark, sf_dir)
    roots = all_packets.select("conv_id", D.packet_root().alias("packetMerkleRoot"))
    whole = annotations(spark, sf_dir, "A").drop("packetMerkleRoot").join(roots, "conv_id")
    first = whole.withColumn("annotatorSlot", F.lit("A"))
    doubted = F.transform("sentences", lambda s: s.withField("structurallyAcceptable", s["structurallyAcceptable"] != (s["sentenceId"].cast("int") % 2 == 0)))
    second = whole.withColumn("annotatorSlot", F.lit("B")).withColumn("sentences", doubted)
    conv = F.col("conv_id")
    note = F.when(conv % 7 == 0, F.lit("\n\t")).otherwise(F.lit("because"))
    token = lambda t: t.dropFields("note").withField("resolutionNote", _text(None))
    final = F.transform("sentences", lambda s: s.dropFields("note").withField("resolutionNote", note).withField("tokens", F.transform(s["tokens"], token)))
    side = lambda rows, name: rows.select("conv_id", D.annotation_root().alias(name))
    made = first.join(side(first, "a"), "conv_id").join(side(second, "b"), "conv_id").select(
        "conv_id", F.lit("demo-adjudication-v3").alias("schema"), "packetMerkleRoot", F.when(conv % 17 == 0, "0").otherwise(F.col("a")).alias("annotationAMerkleRoot"), F.col("b").alias("annotationBMerkleRoot"), *D.TASK,
        F.lit("A").alias("annotationASlot"), F.when(conv % 13 == 0, "A").otherwise("B").alias("annotationBSlot"), F.when(conv % 11 == 0, "J2").otherwise("J1").alias("adjudicatorSlot"), _text("y").alias("adjudicatorPseudonym"),
        F.lit(True).alias("adjudicatorIsHuman"), F.lit(False).alias("adjudicatorIsSynthetic"), *D.ORIGIN, final.alias("sentences"),
    )
    return all_packets, first.unionByName(second), made


@query("""with c as (select conv_id, bool_or(turn % 2 = 0) as doubted from conversations group by conv_id)
select 'p' || conv_id as "packetId", unnest(list_filter([case when conv_id % 11 = 0 then 'slot' end, case when conv_id % 17 = 0 then 'annotation-a' end, case when conv_id % 13 = 0 then 'annotation-b' end,
  case when conv_id % 13 = 0 then 'same-slots' end, case when conv_id % 5 = 0 then 'coverage' end, case when conv_id % 7 = 0 and doubted and conv_id % 13 > 0 then 'unresolved' end], lambda x: x is not null)) as reason from c""")
def adjudication_binding(spark, sf_dir):
    """Adjudications that are not bound to their packet and annotations, or leave decisions unexplained, with every reason."""
    all_packets, both, made = judged(spark, sf_dir)
    return D.adjudication_rejects(made, all_packets, both)


_FINAL = f"""{_lp(_ID, "(case when length(text) % 2 = 0 then 'true' else 'false' end)", "'true'", "(case when conv_id % 7 = 0 then chr(10) || chr(9) else 'because' end)")} || case when conv_id % 5 = 0 then '1:1' else '1:2' end || {_token_sql(1, 'role')} || case when conv_id % 5 = 0 then '' else {_token_sql(2, _FORM)} end"""
_FINAL_HEAD = _lp("'demo-adjudication-root-v3'", "'demo-adjudication-v3'", "'r'", "'a'", "'b'", *_TASK_SQL, "'A'", "(case when conv_id % 13 = 0 then 'A' else 'B' end)", "(case when conv_id % 11 = 0 then 'J2' else 'J1' end)", "'y'", "'true'", "'false'", "'true'", "'true'", "'false'")


@query(f"""with body as (select conv_id, count(*) as n, string_agg({_FINAL}, '' order by turn) as b from conversations group by conv_id)
select conv_id, sha256({_FINAL_HEAD} || {_lp('cast(n as varchar)')} || b) as root from body""")
def adjudication_roots(spark, sf_dir):
    """Canonical roots of nested adjudications."""
    named = {"packetMerkleRoot": F.lit("r"), "annotationAMerkleRoot": F.lit("a"), "annotationBMerkleRoot": F.lit("b")}
    return judged(spark, sf_dir)[2].withColumns(named).select("conv_id", D.adjudication_root().alias("root"))


@query(PACKET_SQL)
def packet_files(spark, sf_dir):
    """Roots of packets that were written as files of one JSON document each and read back as such."""
    from attestia.sources.documents import json_documents
    from attestia.streaming.machine import stream_path

    path = stream_path(spark, "packets")
    packets(spark, sf_dir).drop("conv_id").write.option("maxRecordsPerFile", 1).json(path)
    return json_documents(spark, path, "packet").select(F.col("taskId").cast("long").alias("conv_id"), D.packet_root().alias("root"))
