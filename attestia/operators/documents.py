"""Nested annotation documents: decision units, canonical roots, bindings and validation.

Everything is column expressions over the nested schemas of `sources.documents`; no document leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.functions.hashing import canonical_part
from attestia.functions.text import IDENTIFIER, UUID, trim, unique_list, unsafe_flags

# Field orders of the canonical roots and the decision fields.
TASK = ("taskId", "taskVersion", "packetId", "holdoutId", "protocolId", "guidelineVersion", "dataVersion", "protocolVersion")
ORIGIN = ("independentFromImplementationTeam", "blindToParserInternals", "parserPredictionsViewed")
PACKET_FLAGS = ("releaseCandidateId", "pilotOnly", "developerVisible", "parserPredictionsExcluded", "derivedFromExcludedCorpus", "holdoutManifestSha256")
SENTENCE_FIELDS = ("structurallyAcceptable", "completePredicate")
TOKEN_FIELDS = ("universalPartOfSpeech", "headTokenId", "dependencyRelation", "irabHeadTokenId", "irabCategory", "irabNotApplicable")
POLICY_FIELDS = ("automaticFinalization", "claimBoundary", "metrics", "minimumDefinedKappa", "minimumRawAgreement", "policyVersion", "schema", "undefinedKappaFallback")
NOTE_LENGTHS = (20, 4000)


def _parts(values: list[Column]) -> Column:
    return F.concat(*[canonical_part(v) for v in values])


def _each(items: Column, render) -> Column:
    """Count of an array followed by its rendered items."""
    return F.concat(canonical_part(F.size(items)), F.array_join(F.transform(items, render), ""))


def root_tag(schema: Column) -> Column:
    """Domain tag of a root: the document's schema name with `root` before its version."""
    return F.regexp_replace(schema, r"-(v\d+)$", "-root-$1")


def packet_root() -> Column:
    """Canonical root of a packet row."""
    # Keys that a policy lacks are no part of it, and its whole numbers have no fraction.
    policy = F.to_json(F.struct(*[F.col("metricPolicy")[f].alias(f) for f in POLICY_FIELDS]))
    policy = F.regexp_replace(policy, r'"(minimumDefinedKappa|minimumRawAgreement)":(-?\d+)\.0(?=[,}])', r'"$1":$2')
    head = _parts([root_tag(F.col("schema")), F.col("schema"), *map(F.col, TASK), policy, *map(F.col, PACKET_FLAGS)])
    token = lambda t: _parts([t["id"], t["form"]])
    body = _each(F.col("sentences"), lambda s: F.concat(_parts([s["sentenceId"], s["text"]]), _each(s["tokens"], token)))
    notes = _each(F.coalesce("instructions", F.array().cast("array<string>")), canonical_part)
    return F.sha2(F.concat(head, body, notes), 256)


def _annotated(note: str) -> Column:
    token = lambda t: _parts([t["tokenId"], *[t[f] for f in TOKEN_FIELDS], t[note]])
    return _each(
        F.col("sentences"), lambda s: F.concat(_parts([s["sentenceId"], *[s[f] for f in SENTENCE_FIELDS], s[note]]), _each(s["tokens"], token))
    )


def annotation_root() -> Column:
    """Canonical root of an annotation row."""
    columns = ("packetMerkleRoot", *TASK, "annotatorSlot", "annotatorPseudonym", "isHuman", "isSynthetic", *ORIGIN)
    return F.sha2(F.concat(_parts([root_tag(F.col("schema")), F.col("schema"), *map(F.col, columns)]), _annotated("note")), 256)


def adjudication_root() -> Column:
    """Canonical root of an adjudication row."""
    columns = (
        "packetMerkleRoot", "annotationAMerkleRoot", "annotationBMerkleRoot", *TASK, "annotationASlot", "annotationBSlot",
        "adjudicatorSlot", "adjudicatorPseudonym", "adjudicatorIsHuman", "adjudicatorIsSynthetic", *ORIGIN,
    )
    return F.sha2(F.concat(_parts([root_tag(F.col("schema")), F.col("schema"), *map(F.col, columns)]), _annotated("resolutionNote")), 256)


RATIFICATION = (
    "taskId", "taskVersion", "packetId", "holdoutId", "protocolVersion", "packetMerkleRoot", "primaryReceiptId", "primaryAdjudicationMerkleRoot",
    "reviewerSlot", "reviewerPseudonym", "reviewerIsHuman", "reviewerIsSynthetic", "independentFromImplementationTeam", "decision",
)


def ratification_root() -> Column:
    """Canonical root of a ratification row; the rationale is trimmed."""
    return F.sha2(_parts([root_tag(F.col("schema")), F.col("schema"), *map(F.col, RATIFICATION), trim("rationale")]), 256)


def json_value(c: Column, text: bool) -> Column:
    """Canonical JSON text of a scalar: text keeps its quotes, null is `null`."""
    shown = F.to_json(F.struct(c.alias("v"))) if text else None
    plain = F.regexp_extract(shown, r"^\{\"v\":(.*)\}$", 1) if text else c.cast("string")
    return F.when(c.isNull(), "null").otherwise(plain)


def units(annotations: DataFrame, rater: Column) -> DataFrame:
    """Decision units: rater, sentence_id, token_id (null for sentence fields), field and canonical value."""
    sentences = annotations.select(rater.alias("rater"), F.explode("sentences").alias("s"))
    of_sentence = sentences.select(
        "rater",
        F.col("s.sentenceId").alias("sentence_id"),
        F.lit(None).cast("int").alias("token_id"),
        F.inline(F.array(*[F.struct(F.lit(f"sentence.{f}").alias("field"), json_value(F.col("s")[f], False).alias("value")) for f in SENTENCE_FIELDS])),
    )
    tokens = sentences.select("rater", F.col("s.sentenceId").alias("sentence_id"), F.explode("s.tokens").alias("t"))
    texts = {"universalPartOfSpeech", "dependencyRelation", "irabCategory"}
    of_token = tokens.select(
        "rater",
        "sentence_id",
        F.col("t.tokenId").alias("token_id"),
        F.inline(F.array(*[F.struct(F.lit(f"token.{f}").alias("field"), json_value(F.col("t")[f], f in texts).alias("value")) for f in TOKEN_FIELDS])),
    )
    return of_sentence.unionByName(of_token)


def side_by_side(all_units: DataFrame, left: str, right: str) -> DataFrame:
    """Paired units of two raters (dimension, a, b, and which side is missing), for `agreement`."""
    keys = [F.col("sentence_id"), F.coalesce("token_id", F.lit(-1)).alias("token_id"), F.col("field").alias("dimension")]
    a = all_units.filter(F.col("rater") == left).select(*keys, F.col("value").alias("a"))
    b = all_units.filter(F.col("rater") == right).select(*keys, F.col("value").alias("b"))
    return a.join(b, ["sentence_id", "token_id", "dimension"], "full_outer")


def uncovered(paired: DataFrame) -> DataFrame:
    """Units that only one of two raters decided: agreement needs this to be empty."""
    return paired.filter("a is null or b is null")


def unresolved(paired: DataFrame, final: DataFrame) -> DataFrame:
    """Units whose final decision needs a resolution note (raters differ, or it overrules both) but has none.

    `final` has sentence_id, token_id (-1 for sentence fields), dimension, value and note.
    """
    both = paired.join(final, ["sentence_id", "token_id", "dimension"])
    needs = (F.col("a") != F.col("b")) | (F.col("value") != F.col("a"))
    return both.filter(needs & (trim(F.coalesce("note", F.lit(""))) == ""))


def packet_rejects(packets: DataFrame) -> DataFrame:
    """packetId and reason of every rule that a packet breaks."""
    ids = ("taskId", "packetId", "holdoutId", "protocolId", "guidelineVersion", "dataVersion", "protocolVersion")
    named = ~F.forall(F.array(*[F.coalesce(F.col(c).rlike(IDENTIFIER), F.lit(False)) for c in ids]), lambda x: x)
    policy = F.col("metricPolicy")
    bad_policy = policy.isNull() | policy["metrics"].isNull() | ~F.coalesce(
        policy["minimumRawAgreement"].between(0, 1) & policy["minimumDefinedKappa"].between(-1, 1), F.lit(False)
    )
    sentences = F.col("sentences")
    hollow = F.exists(sentences, lambda s: (F.coalesce(s["sentenceId"], F.lit("")) == "") | (F.coalesce(s["text"], F.lit("")) == "") | (F.coalesce(F.size(s["tokens"]), F.lit(0)) < 1))
    dense = F.forall(sentences, lambda s: F.forall(F.transform(s["tokens"], lambda t, i: (t["id"] == i + 1) & (F.coalesce(t["form"], F.lit("")) != "")), lambda ok: ok))
    rules = {
        "identity": named | F.coalesce(F.col("taskVersion") < 1, F.lit(True)),
        "metric-policy": bad_policy,
        "predictions-visible": ~F.coalesce("parserPredictionsExcluded", F.lit(False)),
        "excluded-corpus": F.coalesce("derivedFromExcludedCorpus", F.lit(False)),
        "no-sentences": F.coalesce(F.size(sentences), F.lit(0)) < 1,
        "hollow-sentence": F.coalesce(hollow, F.lit(False)),
        "repeated-sentence": F.size(F.array_distinct(sentences["sentenceId"])) < F.size(sentences),
        "token-numbering": ~F.coalesce(dense, F.lit(True)),
    }
    return _reasons(packets, "packetId", rules)


def binding_rejects(annotations: DataFrame, packets: DataFrame) -> DataFrame:
    """packetId, slot and reason of annotations that do not belong to their packet."""
    bound = packets.select(F.col("packetId"), F.struct(*TASK).alias("_task"), packet_root().alias("_root"), F.col("sentences").alias("_sentences"))
    both = annotations.join(bound, "packetId", "left")
    cover = lambda items, key, inner: F.array_sort(F.transform(items, lambda s: F.struct(s["sentenceId"], F.array_sort(s["tokens"][inner]))))
    rules = {
        "no-packet": F.col("_root").isNull(),
        "identity": ~F.struct(*TASK).eqNullSafe(F.col("_task")),
        "slot": ~F.coalesce(F.col("annotatorSlot").isin("A", "B"), F.lit(False)),
        "packet-changed": ~F.col("packetMerkleRoot").eqNullSafe(F.col("_root")),
        "coverage": ~F.coalesce(cover(F.col("sentences"), "sentenceId", "tokenId") == cover(F.col("_sentences"), "sentenceId", "id"), F.lit(False)),
    }
    return _reasons(both, ["packetId", "annotatorSlot"], rules)


def sentence_differences(final: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """key and differences of each final document to its source: a sentence that the source lacks counts one more than it
    has tokens; else each sentence field that differs, and each token that the source lacks or decides otherwise, counts one.

    Both sides: the key, sentence_id, one column for each of SENTENCE_FIELDS and tokens, an array of (token_id, decision). Of sentences that
    a source repeats the last by content counts.
    """
    other = source.groupBy(key, "sentence_id").agg(F.max(F.struct(*SENTENCE_FIELDS, "tokens")).alias("_s"))
    both = final.join(other, [key, "sentence_id"], "left")
    fields = sum(((~F.col(f).eqNullSafe(F.col("_s")[f])).cast("long") for f in SENTENCE_FIELDS), F.lit(0).cast("long"))
    same = lambda t: F.exists("_s.tokens", lambda x: x["token_id"].eqNullSafe(t["token_id"]) & x["decision"].eqNullSafe(t["decision"]))
    tokens = F.coalesce(F.size(F.filter("tokens", lambda t: ~F.coalesce(same(t), F.lit(False)))), F.lit(0)).cast("long")
    missing = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long") + 1
    return both.groupBy(key).agg(F.sum(F.when(F.col("_s").isNull(), missing).otherwise(fields + tokens)).alias("differences"))


def adjudication_rejects(adjudications: DataFrame, packets: DataFrame, annotations: DataFrame) -> DataFrame:
    """packetId and reason of adjudications that are not bound to their packet and two annotations, or leave a decision unexplained.

    `annotations` are those that are bound to their packet themselves. A decision needs a resolution note where the
    raters differ or it overrules them.
    """
    bound = packets.select("packetId", F.struct(*TASK).alias("_task"), packet_root().alias("_root"), F.col("sentences").alias("_sentences"))
    side = lambda name: annotations.select("packetId", F.col("annotatorSlot").alias(f"annotation{name}Slot"), annotation_root().alias(f"_{name}"))
    both = adjudications.join(bound, "packetId", "left").join(side("A"), ["packetId", "annotationASlot"], "left").join(side("B"), ["packetId", "annotationBSlot"], "left")
    cover = lambda items, inner: F.array_sort(F.transform(items, lambda s: F.struct(s["sentenceId"], F.array_sort(s["tokens"][inner]))))
    rules = {
        "no-packet": F.col("_root").isNull(),
        "identity": ~F.struct(*TASK).eqNullSafe(F.col("_task")),
        "slot": ~F.col("adjudicatorSlot").eqNullSafe("J1"),
        "packet-changed": ~F.col("packetMerkleRoot").eqNullSafe(F.col("_root")),
        "annotation-a": F.col("_A").isNull() | ~F.col("annotationAMerkleRoot").eqNullSafe(F.col("_A")),
        "annotation-b": F.col("_B").isNull() | ~F.col("annotationBMerkleRoot").eqNullSafe(F.col("_B")),
        "same-slots": F.col("annotationASlot").eqNullSafe(F.col("annotationBSlot")),
        "coverage": ~F.coalesce(cover(F.col("sentences"), "tokenId") == cover(F.col("_sentences"), "id"), F.lit(False)),
    }
    place = ["rater", "sentence_id", F.coalesce("token_id", F.lit(-1)).alias("token_id"), "field"]
    decided = lambda rows, name: units(rows, F.col("packetId")).select(*place, F.col("value").alias(name))
    slot_of = lambda name: adjudications.select("packetId", F.col(f"annotation{name}Slot").alias("annotatorSlot")).distinct()
    rated = lambda name: decided(annotations.join(slot_of(name), ["packetId", "annotatorSlot"], "left_semi"), name)
    keys = ["rater", "sentence_id", "token_id", "field"]
    notes = adjudications.select(F.col("packetId").alias("rater"), F.explode("sentences").alias("s")).select(
        "rater",
        F.col("s.sentenceId").alias("sentence_id"),
        F.inline(F.concat(F.array(F.struct(F.lit(-1).alias("token_id"), F.col("s.resolutionNote").alias("note"))), F.transform("s.tokens", lambda t: F.struct(t["tokenId"].alias("token_id"), t["resolutionNote"].alias("note"))))),
    )
    compared = decided(adjudications, "final").join(rated("A"), keys).join(rated("B"), keys)
    needs = compared.filter(~F.col("A").eqNullSafe(F.col("B")) | ~F.col("final").eqNullSafe(F.col("A"))).select("rater", "sentence_id", "token_id").distinct()
    silent = needs.join(notes.filter(trim(F.coalesce("note", F.lit(""))) != ""), ["rater", "sentence_id", "token_id"], "left_anti")
    return _reasons(both, "packetId", rules).unionAll(silent.select(F.col("rater").alias("packetId")).distinct().withColumn("reason", F.lit("unresolved")))


def _reasons(rows: DataFrame, keys: str | list[str], rules: dict[str, Column]) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    broken = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(broken).alias("reason"))


# Limits of the places and lists that a comment names.
SENTENCE_NAME, MOST_TOKENS, MOST_RECEIPTS = 120, 100_000, 20


def comment_rejects(comments: DataFrame, categories: tuple[str, ...], key: str = "comment_id") -> DataFrame:
    """Reasons against a comment: its category, length, unsafe text, and, if it has such columns, what it refers to.

    targetReceiptId and parentCommentId are UUIDs, sentenceId a short text, tokenId a number written in a text, and
    mentionedReceiptIds and referencedReceiptIds lists of UUIDs; each may be null or empty.
    """
    body = trim(F.coalesce("body", F.lit("")))
    given = lambda c: trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    token = given("tokenId").try_cast("double") if "tokenId" in comments.columns else None
    told = {
        "target": lambda c: (given(c) != "") & ~given(c).rlike(UUID),
        "parent": lambda c: (given(c) != "") & ~given(c).rlike(UUID),
        "sentence": lambda c: F.length(given(c)) > SENTENCE_NAME,
        "token": lambda c: (given(c) != "") & ~F.coalesce(token.between(1, MOST_TOKENS) & (token == F.floor(token)), F.lit(False)),
        "mentions": lambda c: unique_list(F.col(c), UUID, MOST_RECEIPTS).isNull(),
        "references": lambda c: unique_list(F.col(c), UUID, MOST_RECEIPTS).isNull(),
    }
    names = ("targetReceiptId", "parentCommentId", "sentenceId", "tokenId", "mentionedReceiptIds", "referencedReceiptIds")
    more = {rule: test(c) for (rule, test), c in zip(told.items(), names, strict=True) if c in comments.columns}
    rules = {"category": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "length": ~F.length(body).between(*NOTE_LENGTHS)}
    return _reasons(comments, key, rules | {f"unsafe-{k}": v for k, v in unsafe_flags(F.col("body")).items()} | more)


def completion(drafts: DataFrame, key: str = "draft_id") -> DataFrame:
    """Completed and total fields and percentage of drafts: the governing head counts only where a category applies.

    `fields` is an array of (structural, predicate, tokens of upos, head, relation, irabCategory, irabHead) as text.
    """
    filled = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    plain = ("upos", "head", "relation", "irabCategory")

    def token(t):
        governed = (F.coalesce(t["irabCategory"], F.lit("")) != "_").cast("int")
        done = sum((filled(t[f]) for f in plain), F.lit(0)) + governed * filled(t["irabHead"])
        return F.struct(done.alias("done"), (F.lit(len(plain)) + governed).alias("all"))

    def sentence(s):
        tokens = F.transform(s["tokens"], token)
        add = lambda name: F.aggregate(tokens, F.lit(0), lambda a, t: a + t[name])
        return F.struct((filled(s["structural"]) + filled(s["predicate"]) + add("done")).alias("done"), (F.lit(2) + add("all")).alias("all"))

    totals = F.aggregate(
        F.transform("fields", sentence),
        F.struct(F.lit(0).alias("done"), F.lit(0).alias("all")),
        lambda a, s: F.struct((a["done"] + s["done"]).alias("done"), (a["all"] + s["all"]).alias("all")),
    )
    counted = drafts.select(key, totals.alias("t")).select(key, F.col("t.done").alias("completed"), F.col("t.all").alias("total"))
    share = F.when(F.col("total") > 0, F.floor(100 * F.col("completed") / F.col("total") + 0.5)).otherwise(0)
    return counted.withColumn("percentage", share.cast("int"))


def evidence_card(events: DataFrame) -> DataFrame:
    """Markdown evidence of task events: one text for each event."""
    from attestia.functions.text import table_cell

    line = lambda name, c: F.concat(F.lit(f"| {name} | "), table_cell(F.col(c).cast("string")), F.lit(" |"))
    rows = [line(n, c) for n, c in (("Event", "event_id"), ("From", "from_state"), ("To", "to_state"), ("Reason", "reason"))]
    return events.select("event_id", F.concat_ws("\n", F.lit("| Field | Value |"), F.lit("| --- | --- |"), *rows).alias("card"))
