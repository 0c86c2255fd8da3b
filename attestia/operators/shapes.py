"""Documents of several shapes taken apart by their shape: one scan classifies JSON texts as variants and shreds them into typed tables.

A text is read once into a variant; a document may be wrapped in an `artifact`. The first shape that holds is its kind, and the parts
that the kind has (packet, annotation, decision, ratification) become typed columns. The result is written once, by
kind, so each typed table reads its own files. What is no document is a reject with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.session import shared_dir
from attestia.sources.documents import ADJUDICATION, ANNOTATION, PACKET

# Kinds of documents, in the order in which their shapes are tried.
KINDS = ("draft", "annotation-artifact", "adjudication-artifact", "ratification-artifact", "packet", "annotation", "container")
RATIFICATION = "decision string, reviewerSlot string, rationale string, primaryReceiptId string, primaryAdjudicationMerkleRoot string"


@dataclass(frozen=True)
class Schemas:
    """Names that documents give as their schema."""

    packet: str = "annotation-packet-v1"
    annotation: str = "annotation-v1"
    draft: str = "annotation-draft-v1"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _object(found: Column) -> Column:
    """The text of a variant that is an object, else null."""
    text = F.to_json(found)
    return F.when(text.startswith("{"), text)


def kind_of(v: Column, schemas: Schemas = Schemas()) -> Column:
    """The kind of a document (a variant, no longer wrapped); `unknown` if no shape holds."""
    kind, schema = _text(v, "$.kind"), _text(v, "$.schema")
    # The names that documents give as their kind.
    return (
        F.when(schema == schemas.draft, "draft")
        .when(kind == "independent-annotation", "annotation-artifact")
        .when(kind == "adjudication-package", "adjudication-artifact")
        .when((kind == "ratification-package") & (_text(v, "$.primaryArtifact.kind") == "adjudication-package"), "ratification-artifact")
        .when(schema == schemas.packet, "packet")
        .when(schema == schemas.annotation, "annotation")
        .when(_text(v, "$.packet.schema") == schemas.packet, "container")
        .otherwise("unknown")
    )


def classified(texts: DataFrame, key: str, text: str = "text", schemas: Schemas = Schemas()) -> DataFrame:
    """key, kind, role, wrapped, digest and the typed parts of every text; kind `malformed` for what is no JSON object.

    The digest is that of the document without its wrapping, so that copies are found however they are wrapped or laid out.
    """
    whole = texts.select(key, F.try_parse_json(text).alias("_whole"))
    inner = F.try_variant_get("_whole", "$.artifact", "variant")
    wrapped = inner.isNotNull() & ~F.is_variant_null(inner)
    opened = whole.withColumns({"wrapped": F.coalesce(wrapped, F.lit(False)), "_v": F.when(wrapped, inner).otherwise(F.col("_whole"))})
    v, body = F.col("_v"), F.to_json(F.col("_v"))
    shaped = opened.withColumn("kind", F.when(~F.coalesce(body.startswith("{"), F.lit(False)), "malformed").otherwise(kind_of(v, schemas)))
    kind = F.col("kind")
    own = lambda *kinds: kind.isin(*kinds)
    at = lambda path, of=v: F.try_variant_get(of, path, "variant")
    packet = (
        F.when(own("packet"), v)
        .when(own("ratification-artifact"), at("$.primaryArtifact.packet"))
        .when(own("annotation"), at("$.packet", F.col("_whole")))
        .when(own("draft", "annotation-artifact", "adjudication-artifact", "container"), at("$.packet"))
    )
    annotation = F.when(own("annotation"), v).when(own("annotation-artifact", "container"), at("$.annotation"))
    decision = F.when(own("adjudication-artifact"), at("$.adjudication")).when(own("ratification-artifact"), at("$.primaryArtifact.adjudication"))
    ratification = F.when(own("ratification-artifact"), at("$.ratification"))
    role = (
        F.when(own("draft"), _text(v, "$.role"))
        .when(own("annotation"), _text(v, "$.annotatorSlot"))
        .when(own("annotation-artifact", "container"), _text(v, "$.annotation.annotatorSlot"))
        .when(own("adjudication-artifact", "ratification-artifact"), "ratification")
    )
    parts = {"packet": (packet, PACKET), "annotation": (annotation, ANNOTATION), "adjudication": (decision, ADJUDICATION), "ratification": (ratification, RATIFICATION)}
    return shaped.select(
        key, "kind", role.alias("role"), "wrapped", F.sha2(body, 256).alias("digest"), *[F.from_json(_object(x), schema).alias(n) for n, (x, schema) in parts.items()]
    )


def shred(texts: DataFrame, key: str, text: str = "text", schemas: Schemas = Schemas()) -> DataFrame:
    """What `classified` gives with `reason`: malformed, unknown, hollow (a part that its kind needs is missing) or
    duplicate (of copies the one of the least key stays); null for documents that are taken. A written table, by kind."""
    spark = texts.sparkSession
    found = classified(texts, key, text, schemas)
    taken = F.col("kind").isin(*KINDS)
    needs = {"packet": ("packet", "container"), "annotation": ("annotation", "annotation-artifact"), "adjudication": ("adjudication-artifact", "ratification-artifact"), "ratification": ("ratification-artifact",)}
    hollow = F.lit(False)
    for part, kinds in needs.items():
        hollow = hollow | (F.col("kind").isin(*kinds) & F.col(part).isNull())
    first = found.filter(taken).groupBy("digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    reason = F.when(~taken, F.col("kind")).when(hollow, "hollow").when(F.col("_first") < F.col(key), "duplicate")
    path = f"{shared_dir(spark).rstrip('/')}/attestia-shapes-{spark.range(1).select(F.uuid()).first()[0]}"
    whole = found.join(first, "digest", "left").withColumn("reason", reason).drop("_first")
    whole.write.partitionBy("kind").parquet(path)
    return spark.read.schema(whole.schema).parquet(path)


def typed(shredded: DataFrame, kind: str, part: str, key: str) -> DataFrame:
    """One part of the documents of one kind as a table with the part's own columns."""
    return shredded.filter((F.col("kind") == kind) & F.col("reason").isNull()).select(key, "role", f"{part}.*")
