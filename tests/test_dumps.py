"""SQL dumps that are cut anywhere, against the database that wrote them."""

import random
import sqlite3

import pytest

from attestia.sources import dumps


def drawn_text(r):
    return "".join(r.choice(["'", '"', ";", "\n", "--", "/*", "*/", "a", "é", "(", ")", ",", " ", "\r", "\t", "NULL", "INSERT INTO t VALUES(1);"]) for _ in range(r.choice([0, 1, 5, 40, 400])))


def written(rows):
    """A dump and the rows that a database has after it."""
    db = sqlite3.connect(":memory:")
    db.execute("create table t (id integer, name text, weight real, body blob)")
    db.execute('create table "an; other" (x text)')
    db.executemany("insert into t values (?, ?, ?, ?)", rows)
    db.executemany('insert into "an; other" values (?)', [(x[1],) for x in rows[:20]])
    return "\n".join(db.iterdump()), db.execute("select * from t").fetchall()


@pytest.mark.parametrize("size", ["41", "1000", "10m"])
def test_a_dump_cut_anywhere_gives_the_same_rows(spark, tmp_path, size):
    r = random.Random(3)
    rows = [(i, r.choice([None, drawn_text(r)]), r.choice([None, 1.5, -2.0, 1e100]), r.choice([None, b"", b"\x00'\xff"])) for i in range(60)]
    script, want = written(rows)
    if size == "41":
        script, want = written(rows[:12])
    (tmp_path / "a.sql").write_bytes(("-- it's; a comment\n/* 'more;\n */" + script).encode())
    (tmp_path / "b.sql").write_bytes(b"insert or ignore into T (weight, \"id\") values (2.5, 900),\n (NULL, 901); insert into t(name) values ('''')")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        told = dumps.statements(spark, str(tmp_path))
        got = dumps.table(told, "t", "id long, name string, weight double, body binary").collect()
        splits = dumps.lines(spark, str(tmp_path)).select("path", "split").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    show = lambda rows: sorted(map(repr, rows))
    more = [(900, None, 2.5, None), (901, None, None, None), (None, "'", None, None)]
    assert show((x.id, x.name, x.weight, None if x.body is None else bytes(x.body)) for x in got) == show([*map(tuple, want), *more])
    assert splits > 20 if size == "41" else splits >= 2
    numbers = sorted((x.path, x.statement) for x in told.collect())
    assert len(numbers) == len(set(numbers))


def test_transitions_compose():
    lines = ["insert 'a;", "b''; -- c", "';-- it's", '"x;\'" /* \' ;', "*/ ;'"]
    for start in dumps.STATES:
        state, whole = start, 0
        for line in lines:
            state, ends = dumps.lexed(line, state)
            whole += len(ends)
        again, n = start, 0
        for part in (lines[:2], lines[2:3], lines[3:]):
            for line in part:
                again, ends = dumps.lexed(line, again)
                n += len(ends)
        assert (again, n) == (state, whole)
    assert dumps.lexed("a;b';'c;", dumps.CODE) == (dumps.CODE, [2, 8]) and dumps.lexed("-- ';", dumps.CODE) == (dumps.CODE, [])


def test_empty_files_and_other_statements(spark, tmp_path):
    (tmp_path / "a.sql").write_text("")
    (tmp_path / "b.sql").write_text("PRAGMA x;\n\nCREATE TABLE t (a text default ';');\nCOMMIT;\n")
    assert dumps.table(dumps.statements(spark, str(tmp_path)), "t", "a string").count() == 0
