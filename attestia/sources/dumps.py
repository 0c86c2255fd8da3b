"""SQL dumps read in parallel: file splits are lexed apart and their states composed.

Where a split begins, a string, a quoted name or a comment may be open. So each split is first read for all four states, which
gives its transition: the state at its end and the statements ended, for each state at its start. Transitions of a file
are chained in order (a row for each split), and with its state known each split is cut into statements. Only the first and
the last statement of a split can continue beyond it; these pieces are joined by a shuffle, all others stay where they are.
Statements are then read by column expressions. Nothing but rows of splits is ordered in one place.

Supported: INSERT INTO name [(columns)] VALUES (...)[, (...)], with strings, numbers, NULL and X'hex' values; other
statements are passed over. Line ends inside strings are kept.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE, STRING, NAME, LINE, BLOCK = range(5)
STATES = (CODE, STRING, NAME, BLOCK)  # a line comment ends with its line, before any split does
_MARKS = {
    CODE: re.compile(r"'|\"|--|/\*|;"),
    STRING: re.compile("'"),
    NAME: re.compile('"'),
    BLOCK: re.compile(r"\*/"),
}
_OPENS = {"'": STRING, '"': NAME, "/*": BLOCK}
#: Rows of splits up to which their states are sent to every task.
BROADCAST_ROWS = 100_000


def lexed(line: str, state: int) -> tuple[int, list[int]]:
    """The state after a line, and where statements end in it (after their semicolons)."""
    ends, at = [], 0
    while m := _MARKS[state].search(line, at):
        at = m.end()
        if state != CODE:
            state = CODE
        elif m[0] == ";":
            ends.append(at)
        elif m[0] == "--":
            break
        else:
            state = _OPENS[m[0]]
    return state, ends


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, split (its offset) and value of the lines of dump files; lines of a split come in their order."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def transitions(rows: DataFrame) -> DataFrame:
    """path, split, begin, end, n: for every state in which a split may begin, the state it ends in and the statements ended."""

    def read(frames):
        own, held = None, {}

        def told():
            return pd.DataFrame([(*own, s, end, n) for s, (end, n) in held.items()], columns=["path", "split", "begin", "end", "n"])

        for frame in frames:
            for path, split, value in zip(frame["path"], frame["split"], frame["value"], strict=True):
                if own != (path, split):
                    if own:
                        yield told()
                    own, held = (path, split), {s: (s, 0) for s in STATES}
                seen: dict[int, tuple[int, int]] = {}
                for s, (state, n) in held.items():
                    if state not in seen:
                        end, ends = lexed(value, state)
                        seen[state] = end, len(ends)
                    held[s] = seen[state][0], n + seen[state][1]
        if own:
            yield told()

    return rows.mapInPandas(read, "path string, split long, begin int, end int, n long")


def chained(moves: DataFrame) -> DataFrame:
    """path, split, begin and first (the number of its first statement) of every split, from the transitions before it."""

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        state, first, out = CODE, 0, []
        step = {(s, b): (e, n) for s, b, e, n in zip(frame["split"], frame["begin"], frame["end"], frame["n"], strict=True)}
        for split in sorted(set(frame["split"])):
            out.append((frame["path"].iloc[0], split, state, first))
            state, n = step[split, state]
            first += n
        return pd.DataFrame(out, columns=["path", "split", "begin", "first"])

    return moves.groupBy("path").applyInPandas(follow, "path string, split long, begin int, first long")


def pieces(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """path, split, statement (number), text and whole (whether the split holds all of it) of every piece of a statement."""
    known = starts.withColumnRenamed("path", "_p").withColumnRenamed("split", "_s")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        placed = rows.join(F.broadcast(known), (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s")))
    else:
        ordered = rows.withColumn("_n", F.monotonically_increasing_id())
        placed = ordered.join(known, (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s"))).repartition(F.xxhash64("path", "split")).sortWithinPartitions("path", "split", "_n")  # as in consensus.judge_guarded

    def read(frames):
        own, state, number, text, first, out = None, CODE, 0, [], True, []

        def close(whole):
            out.append((*own, number, "\n".join(text), whole))

        def drained():
            done = pd.DataFrame(out, columns=["path", "split", "statement", "text", "whole"])
            out.clear()
            return done

        for frame in frames:
            for path, split, value, begin, n in zip(frame["path"], frame["split"], frame["value"], frame["begin"], frame["first"], strict=True):
                if own != (path, split):
                    if own:
                        close(False)
                    own, state, number, text, first = (path, split), begin, n, [], True
                state, ends = lexed(value, state)
                at = 0
                for end in ends:
                    text.append(value[at:end])
                    close(not first)
                    at, number, text, first = end, number + 1, [], False
                text.append(value[at:])
            yield drained()
        if own:
            close(False)
            yield drained()

    return placed.select("path", "split", "value", "begin", "first").mapInPandas(read, "path string, split long, statement long, text string, whole boolean")


def statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, statement (number from 0) and text of all statements of dump files."""
    rows = lines(spark, path)
    found = pieces(rows, chained(transitions(rows)))
    parts = F.array_sort(F.collect_list(F.struct("split", "text")))
    cut = found.filter("not whole").groupBy("path", "statement").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return found.filter("whole").select("path", "statement", "text").unionByName(cut)


_STRING = "'[^']*+(?:''[^']*+)*+'"
_VALUE = rf"(?i)X?{_STRING}|[^\s,()']++"
_TUPLE = rf"\((?:[^'()]++|{_STRING})*+\)"
_HEAD = r"(?is)^(?:\s*+--[^\n]*+\n|\s*+/\*.*?\*/)*+\s*+INSERT\s+(?:OR\s+\w+\s+)?INTO\s+(\"[^\"]++\"|\w++)\s*+(\([^()']*+\))?\s*+VALUES\s*+(?=\()"


def _decoded(raw: Column, kind: str) -> Column:
    """A written value as a column of this type."""
    text = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
    blob = F.unhex(F.substring(raw, F.lit(3), F.length(raw) - 3))
    is_blob, is_text = raw.rlike("^[xX]'"), raw.startswith("'")
    if kind == "binary":
        return F.when(is_blob, blob).when(is_text, F.encode(text, "utf-8"))
    plain = F.when(is_blob, F.decode(blob, "utf-8")).when(is_text, text).when(F.upper(raw) != "NULL", raw)
    return plain if kind == "string" else plain.try_cast(kind)


def table(told: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows that statements insert into a table, with the columns of `schema` (DDL); columns that an insert does not name are null."""
    fields = told.sparkSession.createDataFrame([], schema).schema.fields
    head = F.regexp_extract("text", _HEAD, 0)
    into = F.lower(F.regexp_replace(F.regexp_extract("text", _HEAD, 1), '"', ""))
    inserts = told.filter(into == name.lower()).select(F.col("text"), head.alias("_head"), F.regexp_extract("text", _HEAD, 2).alias("_columns"))
    body = F.substring("text", F.length("_head") + 1, F.length("text"))
    given = F.transform(F.regexp_extract_all("_columns", F.lit(r'"[^"]++"|\w++'), F.lit(0)), lambda c: F.lower(F.regexp_replace(c, '"', "")))
    rows = inserts.select(given.alias("_given"), F.explode(F.regexp_extract_all(body, F.lit(_TUPLE), F.lit(0))).alias("_tuple"))
    values = rows.select("_given", F.regexp_extract_all("_tuple", F.lit(_VALUE), F.lit(0)).alias("_values"))
    place = lambda i, f: F.when(F.size("_given") == 0, F.lit(i + 1)).otherwise(F.array_position("_given", f.name.lower()).cast("int"))
    raw = lambda i, f: F.when(place(i, f) > 0, F.get("_values", place(i, f) - 1))
    return values.select(*[_decoded(raw(i, f), f.dataType.simpleString()).alias(f.name) for i, f in enumerate(fields)])
