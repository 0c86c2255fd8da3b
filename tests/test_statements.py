"""Statements against the same statements in SQLite."""

import sqlite3

import pytest

from attestia.sources.statements import Conflict, Database, cut, parameters, split_list

SETUP = """
create table task(id text primary key, state text, version integer, round integer);
create table seat(task text, role text, person integer, unique(task, role));
insert into task values ('a', 'open', 1, 1), ('b', 'open', 2, 1), ('c', 'failed', 1, null);
insert into seat values ('a', 'A', 1), ('a', 'B', 2), ('b', 'A', 1);
"""
STEPS = [
    ("update task set state = ?, version = version + 1 where id = ? and state = ? and version = ?", ("review", "a", "open", 1)),
    ("update task set state = 'lost' where id = ? and version = ?", ("a", 1)),
    ("insert or ignore into seat (task, role, person) values (?, ?, ?), ('b', 'B', ?)", ("a", "A", 9, 4)),
    ("insert into task (id, state, version) values ($1, 'a, where (b) -- no', $2)", ("d", 7)),
    ("insert into task (id, state, version, round) values ('a', 'x', 9, 9), ('e', 'new', 1, 1) on conflict(id) do update set state = excluded.state, version = task.version + 10 where excluded.version > task.version", ()),
    ("delete from seat where task in (select id from task where state = 'x') and not exists (select 1 from task where task.id = seat.task and task.round > ?)", (5,)),
    ("update task set round = coalesce(round, 0) + 1 where state <> 'failed' or round is null", ()),
    ("insert into seat (task, role, person) select id, 'J1', version from task where version > ?", (5,)),
]


@pytest.fixture()
def both(spark):
    db = sqlite3.connect(":memory:")
    db.executescript(SETUP)
    frames = {
        "task": spark.createDataFrame(db.execute("select * from task").fetchall(), "id string, state string, version long, round long"),
        "seat": spark.createDataFrame(db.execute("select * from seat").fetchall(), "task string, role string, person long"),
    }
    return db, Database(spark, frames, {"task": [["id"]], "seat": [["task", "role"]]})


def same(db, ours):
    for name, frame in ours.tables.items():
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, frame.collect()), key=key) == sorted(db.execute(f"select * from {name}").fetchall(), key=key), name


def test_writes(both):
    db, ours = both
    for sql, values in STEPS:
        numbered = sql.replace("$", "?")
        changed = db.execute(numbered, values).rowcount
        assert ours.prepare(sql).bind(*values).run() == changed, sql
        same(db, ours)


def test_reads(both):
    db, ours = both
    sql = "select role, count(*) as n from seat where person < ? group by role order by role"
    assert [tuple(r) for r in ours.prepare(sql).bind(3).all().collect()] == db.execute(sql, (3,)).fetchall()
    assert ours.prepare("select id from task where state = ? and id <> '?' order by id limit 1").bind("failed").first() == {"id": "c"}
    assert ours.prepare("select id from task where id = ?").bind("zz").first() is None


def test_batches_are_all_or_nothing(both):
    db, ours = both
    before = {n: f.count() for n, f in ours.tables.items()}
    with pytest.raises(Conflict):
        ours.batch([ours.prepare("delete from seat"), ours.prepare("insert into task (id, state) values ('a', 'again')")])
    with pytest.raises(ValueError):
        ours.batch([ours.prepare("delete from seat"), ours.prepare("drop table task")])
    assert {n: f.count() for n, f in ours.tables.items()} == before
    assert ours.batch([ours.prepare("delete from seat where person = ?").bind(2), ours.prepare("select * from seat")]) == [1, 2]


def test_lexing():
    assert parameters("a = ? -- ?\n and b = '?' and c = $1", (5,)) == ("a = :p1 -- ?\n and b = '?' and c = :p1", {"p1": 5})
    with pytest.raises(ValueError):
        parameters("?", ())
    assert split_list("a = f(1, 2), b = ',', c=3") == ["a = f(1, 2)", "b = ','", "c=3"]
    assert cut("x = (select 1 where 2) where y", "where") == ("x = (select 1 where 2)", "y")
