"""Sources of nested annotation documents and of program texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = (
    "schema string, taskId string, taskVersion int, packetId string, holdoutId string, protocolId string, "
    "guidelineVersion string, dataVersion string, protocolVersion string"
)
POLICY = (
    "metricPolicy struct<schema:string,policyVersion:string,metrics:array<string>,minimumRawAgreement:double,"
    "minimumDefinedKappa:double,undefinedKappaFallback:string,automaticFinalization:boolean,claimBoundary:string>"
)
PACKET = (
    f"{_HEADER}, {POLICY}, releaseCandidateId string, pilotOnly boolean, developerVisible boolean, "
    "parserPredictionsExcluded boolean, derivedFromExcludedCorpus boolean, holdoutManifestSha256 string, "
    "sentences array<struct<sentenceId:string,text:string,tokens:array<struct<id:int,form:string>>>>, instructions array<string>"
)
_TOKENS = (
    "tokens:array<struct<tokenId:int,universalPartOfSpeech:string,headTokenId:int,dependencyRelation:string,"
    "irabHeadTokenId:int,irabCategory:string,irabNotApplicable:boolean,{note}:string>>"
)
_SENTENCES = "sentences array<struct<sentenceId:string,structurallyAcceptable:boolean,completePredicate:boolean,{note}:string," + _TOKENS + ">>"
_ORIGIN = "independentFromImplementationTeam boolean, blindToParserInternals boolean, parserPredictionsViewed boolean"
ANNOTATION = f"{_HEADER}, packetMerkleRoot string, annotatorSlot string, annotatorPseudonym string, isHuman boolean, isSynthetic boolean, {_ORIGIN}, " + _SENTENCES.format(note="note")
ADJUDICATION = (
    f"{_HEADER}, packetMerkleRoot string, annotationAMerkleRoot string, annotationBMerkleRoot string, annotationASlot string, annotationBSlot string, "
    f"adjudicatorSlot string, adjudicatorPseudonym string, adjudicatorIsHuman boolean, adjudicatorIsSynthetic boolean, {_ORIGIN}, " + _SENTENCES.format(note="resolutionNote")
)
SCHEMAS = {"packet": PACKET, "annotation": ANNOTATION, "adjudication": ADJUDICATION}


def json_documents(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Nested documents of a kind, one for each file, with the path they came from, in ordinal path order."""
    read = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path)
    return read.withColumn("source_path", F.col("_metadata.file_path")).orderBy("source_path")


def program_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """program_id (file name), form (json or surface) and source of program files."""
    read = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return read.select(name.alias("program_id"), F.when(name.endswith(".json"), "json").otherwise("surface").alias("form"), F.col("value").alias("source"))


def program_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Statement lines of surface programs: without comments and blanks, with their numbers from 1."""
    return statement_lines(program_files(spark, path))


def statement_lines(programs: DataFrame) -> DataFrame:
    """program_id, line and text of the statements in programs (program_id, source)."""
    from attestia.functions.text import strip_comment, trim

    lines = programs.select("program_id", F.posexplode(F.split("source", "\\R")).alias("at", "raw"))
    return lines.select("program_id", (F.col("at") + 1).alias("line"), trim(strip_comment(F.col("raw"))).alias("text")).filter("text <> ''")
