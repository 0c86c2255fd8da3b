"""Grammar queries over inline programs; their oracles are golden values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import grammar as G
from attestia.plans.programs import PROGRAMS
from attestia.plans.registry import registry

QUERIES, ORACLES, query = registry()


def done(spark: SparkSession) -> DataFrame:
    programs = spark.createDataFrame([p[:3] for p in PROGRAMS], "program_id string, form string, source string")
    return G.compiled(programs)


def _values(rows) -> str:
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_COUNTS = {"market": (10, 3, 18), "reason": (3, 1, 8), "technical": (4, 1, 8), "json-verbal": (2, 0, 4), "functions": (0, 0, 0)}


@query("select program_id, code, cast(relations as int) as relations, cast(operators as int) as operators, cast(frames as int) as frames from (values "
       + _values([(p, code, *_COUNTS.get(p, (0, 0, 0))) for p, _, _, code in PROGRAMS]) + ") t(program_id, code, relations, operators, frames)")
def grammar_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics and the sizes of each program's relations, operators and frames."""
    return done(spark).select("program_id", "code", *[F.size(c).alias(c) for c in ("relations", "operators", "frames")])


@query("select * from (values " + _values([
    ("market", "فتحَ الحارسُ البابَ ثم حملَ الجارُ الصندوقَ إلى سوقِ المدينةِ ثم رسمَ الأخُ الخريطةَ"),
    ("reason", "رسمَ الأخُ الخريطةَ لأنَّه سافرَ بعيدًا"),
    ("technical", "نامَ الطفلُ ثم فتحَ الحارسُ البابَ"),
    ("json-verbal", "فتحَ الحارسُ البابَ"),
]) + ") t(program_id, text)")
def grammar_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rendered from the node table."""
    return G.render(G.part(done(spark), "nodes"))


@query("select * from (values " + _values([
    ("market", 0, "ConnectiveRelation", "ConnectedSentence(ثم)", "VerbalSentence"),
    ("market", 1, "ConnectiveRelation", "VerbalSentence", "VerbalSentence"),
    ("market", 2, "Fa'il", "فتحَ", "الحارسُ"),
    ("market", 3, "Maf'ul", "فتحَ", "البابَ"),
    ("market", 4, "Fa'il", "حملَ", "الجارُ"),
    ("market", 5, "Maf'ul", "حملَ", "الصندوقَ"),
    ("market", 6, "HarfGovernance", "إلى", "IdafaPhrase(Ism[Jarr]: سوقِ, Ism[Jarr]: المدينةِ)"),
    ("market", 7, "Idafa", "سوقِ", "المدينةِ"),
    ("market", 8, "Fa'il", "رسمَ", "الأخُ"),
    ("market", 9, "Maf'ul", "رسمَ", "الخريطةَ"),
]) + ") t(program_id, ord, kind, head, dependent)")
def grammar_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.part(done(spark).filter("program_id = 'market'"), "relations")


@query("select 'functions' as program_id, 1 as functions, 2 as calls, '«البند رقم 1»' || chr(10) || 'ينقلُ سالمٌ البضاعةَ.' || chr(10) || 'الحمولةُ ثقيلةٌ: 45 رطلًا.' || chr(10) || chr(10) || '«البند رقم 2»' || chr(10) || 'ينقلُ هندٌ البضاعةَ.' || chr(10) || chr(10) as text")
def function_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return done(spark).filter("form = 'functions' and code is null").select("program_id", "functions", "calls", "text")
