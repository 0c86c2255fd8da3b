"""SQL statements with parameters over versioned tables.

Reads are Spark SQL over the current versions of the tables. A write computes the next version of its table from one
snapshot, as a set operation: rows that a condition selects are taken out and put back changed (or not at all), and
inserts are checked against the table's unique keys. `batch` runs several statements on one snapshot chain and
publishes their tables only if all succeed. A table has one writer; versions are written to the shared folder.

Supported writes: INSERT [OR IGNORE] INTO t (columns) VALUES (...), ... | SELECT ... [ON CONFLICT [(keys)] DO NOTHING |
DO UPDATE SET ... [WHERE ...]]; UPDATE t SET ... [WHERE ...]; DELETE FROM t [WHERE ...]. Parameters are `?`, `?1` or
`$1`. In DO UPDATE the new row is `excluded` and the old one has the table's name.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.session import shared_dir

_LEXEMES = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\?\d*|\$\d+", re.S)
_READS = ("select", "with", "values")


class Conflict(Exception):
    """A row that breaks a unique key."""


def parameters(sql: str, values: tuple) -> tuple[str, dict]:
    """The statement with named markers, and their values; quotes and comments are left alone."""
    at, args = 0, {}

    def mark(m: re.Match) -> str:
        nonlocal at
        text = m[0]
        if text[0] in "'\"-/":
            return text
        at = int(text[1:]) if text[1:] else at + 1
        if not 1 <= at <= len(values):
            raise ValueError(f"parameter {at} of {len(values)}")
        args[f"p{at}"] = values[at - 1]
        return f":p{at}"

    return _LEXEMES.sub(mark, sql), args


def split_list(text: str) -> list[str]:
    """A text cut at its outer commas."""
    out, depth, start, at = [], 0, 0, 0
    while at < len(text):
        m = _LEXEMES.match(text, at)
        if m:
            at = m.end()
            continue
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        if text[at] == "," and not depth:
            out.append(text[start:at].strip())
            start = at + 1
        at += 1
    return [*out, text[start:].strip()]


def cut(text: str, word: str) -> tuple[str, str | None]:
    """The text before and after an outer keyword."""
    depth, at = 0, 0
    pattern = re.compile(rf"\b{word}\b".replace(" ", r"\s+"), re.I)
    while at < len(text):
        m = _LEXEMES.match(text, at)
        if m:
            at = m.end()
            continue
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        if not depth and (m := pattern.match(text, at)) and (at == 0 or not text[at - 1].isalnum()):
            return text[:at].strip(), text[m.end() :].strip()
        at += 1
    return text.strip(), None


@dataclass(frozen=True)
class Statement:
    """A prepared statement; `bind` gives it values."""

    db: Database
    sql: str
    values: tuple = ()

    def bind(self, *values) -> Statement:
        return Statement(self.db, self.sql, values)

    def reads(self) -> bool:
        return self.sql.lstrip().split(None, 1)[0].lower() in _READS

    def all(self) -> DataFrame:
        return self.db.read(*parameters(self.sql, self.values))

    def first(self) -> dict | None:
        row = self.all().limit(1).collect()
        return row[0].asDict() if row else None

    def run(self) -> int:
        """Changed rows."""
        return self.db.batch([self])[0]


class Database:
    """Named tables with their unique keys."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], unique: dict[str, list[list[str]]] | None = None):
        self.spark, self.tables, self.unique = spark, dict(tables), unique or {}

    def prepare(self, sql: str) -> Statement:
        return Statement(self, sql)

    def read(self, sql: str, args: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        for name, frame in (tables or self.tables).items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args)

    def batch(self, statements: list[Statement]) -> list[int]:
        """Run writes (reads count their rows) on one chain of snapshots; publish all tables or none."""
        now, changes = dict(self.tables), []
        for s in statements:
            sql, args = parameters(s.sql, s.values)
            if s.reads():
                changes.append(self.read(sql, args, now).count())
                continue
            name, frame, n = self._write(sql.strip().rstrip(";"), args, now)
            now[name] = frame
            changes.append(n)
        self.tables = now
        return changes

    def _write(self, sql: str, args: dict, tables: dict[str, DataFrame]) -> tuple[str, DataFrame, int]:
        if m := re.match(r"(?is)delete\s+from\s+(\w+)\s*(?:where\s+(.*))?$", sql):
            name, where = m.groups()
            gone = self.read(f"select * from {name} where {where or 'true'}", args, tables)
            return name, self._version(self._kept(name, where, args, tables), tables[name]), gone.count()
        if m := re.match(r"(?is)update\s+(\w+)\s+set\s+(.*)$", sql):
            name, rest = m.groups()
            sets, where = cut(rest, "where")
            old = self.read(f"select * from {name} where {where or 'true'}", args, tables)
            new = self.read(f"select {self._columns(tables[name], sets)} from {name} where {where or 'true'}", args, tables)
            kept = self._kept(name, where, args, tables)
            self._check(name, new, kept)
            return name, self._version(kept.unionByName(_like(new, tables[name])), tables[name]), old.count()
        if m := re.match(r"(?is)insert\s+(or\s+ignore\s+)?into\s+(\w+)\s*\(([^)]*)\)\s*(.*)$", sql):
            return self._insert(m[2], [c.strip() for c in m[3].split(",")], m[4], bool(m[1]), args, tables)
        raise ValueError(f"Unsupported statement: {sql[:60]}")

    def _kept(self, name: str, where: str | None, args: dict, tables: dict[str, DataFrame]) -> DataFrame:
        """Rows for which a condition does not hold: a second filter of the same scan, nothing is shuffled."""
        return self.read(f"select * from {name} where not coalesce(({where or 'true'}), false)", args, tables)

    def _insert(self, name, columns, rest, ignore, args, tables):
        source, conflict = cut(rest, "on conflict")
        current = tables[name]
        given = self.read(f"select * from ({source}) as t({', '.join(columns)})", args, tables)
        rows = _like(given, current)
        if conflict is None and not ignore:
            self._check(name, rows, current)
            return name, self._version(current.unionByName(rows), current), rows.count()
        target = re.match(r"(?is)\(([^)]*)\)\s*(.*)$", conflict or "")
        keys = [[c.strip() for c in target[1].split(",")]] if target else self.unique.get(name, [])
        action = target[2] if target else conflict or "do nothing"
        fresh = rows
        for k in keys:
            fresh = fresh.join(current.select(*k), k, "left_anti").dropDuplicates(k)
        fresh = fresh.select(*current.columns)
        update = re.match(r"(?is)do\s+update\s+set\s+(.*)$", action)
        if not update:
            return name, self._version(current.unionByName(fresh), current), fresh.count()
        if len(keys) != 1:
            raise ValueError("DO UPDATE needs one conflict key")
        sets, where = cut(update[1], "where")
        on = " and ".join(f"{name}.{c} = excluded.{c}" for c in keys[0])
        both = tables | {"excluded": rows}
        join = f"from {name} join excluded on {on} where {where or 'true'}"
        old = self.read(f"select {name}.* {join}", args, both)
        new = self.read(f"select {self._columns(current, sets, name)} {join}", args, both)
        kept = current.join(old.select(*keys[0]), keys[0], "left_anti").select(*current.columns)
        next_ = kept.unionByName(_like(new, current)).unionByName(fresh)
        return name, self._version(next_, current), new.count() + fresh.count()

    def _columns(self, table: DataFrame, sets: str, prefix: str | None = None) -> str:
        """A select list that assigns the SET expressions."""
        given = dict(re.match(r"(?s)\s*(\w+)\s*=\s*(.*)$", s).groups() for s in split_list(sets))
        own = f"{prefix}." if prefix else ""
        return ", ".join(f"{given.get(c, own + c)} as {c}" for c in table.columns)

    def _check(self, name: str, rows: DataFrame, current: DataFrame) -> None:
        for k in self.unique.get(name, []):
            filled = rows.dropna(subset=k)
            clash = filled.join(current.select(*k), k, "left_semi").select(*k).unionByName(filled.groupBy(*k).count().filter("count > 1").select(*k))
            if clash.limit(1).count():
                raise Conflict(f"{name} has these {', '.join(k)} already")

    def _version(self, rows: DataFrame, like: DataFrame) -> DataFrame:
        """A written version of a table: later statements start from files, not from a growing plan."""
        path = f"{shared_dir(self.spark).rstrip('/')}/attestia-version-{uuid.uuid4().hex}"
        _like(rows, like).write.parquet(path)
        return self.spark.read.schema(like.schema).parquet(path)


def _like(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns and types of a table; columns that are not given are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
