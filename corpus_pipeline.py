"""A training-data pipeline: five stages, each written as Parquet and reread as the next one's documents.

Defined results. Nulls: a document without text goes in the first stage, as it is in no language; one without doc_id
is kept by the line stage as it is, is last in its group of near-duplicates and a row of its own in the mix; a null
source is a source of its own. Texts without letters go, as do texts in no learned or no dominant language; texts that the
line stage empties stay, and take no words of the mix. Very long texts are processed whole. Ties: of equal documents the
one of the least doc_id stays, of those with one doc_id that of the least hash of its text. Rows that repeat a doc_id with
other texts are documents of their own; of rows that repeat both one stays. An empty table gives an empty result, and
columns of any other name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.llm import bpe, langid, linededup, mixing, ngramjoin
from attestia.llm.common import durable, lookup, remove, scope, shared_dir, sweep
from attestia.session import table

SCOPE = "pipeline"
WEIGHTS, RATIO, CAP = (3, 1, 2), 1.5, 2.0
SHINGLE_WORDS, SIMILARITY = 5, (8, 10)


def stage(f):
    """A stage deletes the scratch tables of the one before, whose result its caller has written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, SCOPE)
        with scope(SCOPE):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose letters are mostly in scripts that no language of the training rows
    uses, or in no dominant language. A text in an unlearned language of a learned script is judged by the languages that were learned."""
    return langid.accept(docs, langid.model_of(docs))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; n_chars follows the text."""
    left = linededup.dedup(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by doc_id, then by a hash of its text.

    The nodes of the join are documents (a 64-bit hash of doc_id and text), so that rows that share only a doc_id are
    judged apart. Two documents whose hashes agree would count as one; that is to be expected from some billions of documents on.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)
    named = docs.select(F.struct("*").alias("row"), node.alias("node"))
    found = durable(ngramjoin.join(docs.select(node.alias("doc_id"), "text"), SHINGLE_WORDS, *SIMILARITY), "groups")
    grouped = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("rows"))
    many = durable(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("component_id").alias("component")), "many")
    crowd = durable(lookup(grouped, many.withColumn("many", F.lit(True)), "component", F.col("doc_id")).filter("many").select(F.col("doc_id").alias("node"), "component", "rows"), "crowd")
    members = lookup(named.select("node", F.col("row.doc_id").alias("doc_id")), crowd, "node", F.col("node"), 1).filter("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    first = members.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.node").alias("first"))
    lost = durable(lookup(crowd, durable(first, "first"), "component", F.col("node")).select("node", (F.col("node") != F.col("first")).alias("gone"), "rows"), "lost")
    kept = lookup(named, lost, "node", F.col("node"), 1).filter("gone is null or not gone")
    if lost.filter("not gone and rows > 1").limit(1).count():  # rows that repeat doc_id and text are one document
        again = kept.filter("rows > 1").dropDuplicates(["node"])
        kept = again.unionByName(kept.filter("rows is null or rows = 1"))
    return kept.select("row.*")


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights; a document may be taken twice."""
    return mixing.take(docs, mixing.mix(docs, mixing.cyclic_weights(WEIGHTS), RATIO, CAP))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every taken document, and of its decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), digest=True)


STAGES = [
    ("language identification", language),
    ("line deduplication", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]
#: Viterbi labels, patience alignment and BPE have no SQL form; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, f in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/attestia-stage-{uuid.uuid4().hex}"
        f(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
