"""Templates, calls and arguments as tables: rendering and its diagnostics as joins.

A template is parsed once into ordered segments (a literal, then the name of a place); calls join the segments of their
template, segments join the call's arguments, and texts are put together again by an ordered aggregate. Arguments are literal text: no
place is looked for in them. What does not fit is found by anti-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.text import segments, template_fault


def parsed(templates: DataFrame) -> DataFrame:
    """template_id, n, literal, place of sound templates (template_id, template), which may repeat."""
    sound = templates.filter(F.col("template").isNotNull() & template_fault(F.col("template")).isNull())
    return sound.groupBy("template_id").agg(F.min("template").alias("template")).select("template_id", F.posexplode(segments(F.col("template"))).alias("n", "s")).select(
        "template_id", "n", "s.literal", "s.place"
    )


def rendered(calls: DataFrame, arguments: DataFrame, parts: DataFrame) -> DataFrame:
    """call_id and text of the calls (call_id, template_id) that have every argument (call_id, name, value) they need.

    Of an argument that is given twice the least value counts; a null value is missing.
    """
    given = arguments.filter("value is not null").groupBy("call_id", F.col("name").alias("place")).agg(F.min("value").alias("value"))
    filled = calls.join(parts, "template_id").join(given, ["call_id", "place"], "left")
    piece = F.concat("literal", F.when(F.col("place").isNull(), F.lit("")).otherwise(F.col("value")))
    ordered = F.array_sort(F.collect_list(F.struct("n", piece.alias("text"))))
    whole = filled.groupBy("call_id").agg(ordered.alias("pieces"))
    return whole.filter(F.forall("pieces", lambda p: p["text"].isNotNull())).select("call_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))


def diagnostics(templates: DataFrame, calls: DataFrame, arguments: DataFrame, parts: DataFrame) -> DataFrame:
    """kind, id and name: `unterminated` and `empty` templates (id of the template); calls whose template is `undefined`,
    arguments that are `missing`, and ones that are `unknown` to the template (id of the call)."""
    key = lambda c: F.col(c).cast("string").alias("id")
    none = F.lit(None).cast("string").alias("name")
    faults = templates.filter("template is not null").select(template_fault(F.col("template")).alias("kind"), key("template_id"), none).filter("kind is not null")
    undefined = calls.join(templates.filter("template is not null").select("template_id"), "template_id", "left_anti").select(F.lit("undefined").alias("kind"), key("call_id"), none)
    places = calls.join(parts.filter("place is not null").select("template_id", F.col("place").alias("name")).distinct(), "template_id").select("call_id", "name")
    given = arguments.filter("value is not null").select("call_id", "name").distinct()
    missing = places.join(given, ["call_id", "name"], "left_anti").select(F.lit("missing").alias("kind"), key("call_id"), "name")
    usable = given.join(calls.join(parts.select("template_id").distinct(), "template_id", "left_semi").select("call_id"), "call_id", "left_semi")
    unknown = usable.join(places, ["call_id", "name"], "left_anti").select(F.lit("unknown").alias("kind"), key("call_id"), "name")
    return faults.unionAll(undefined).unionAll(missing).unionAll(unknown)
