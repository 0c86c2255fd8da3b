"""Total orders, JSON numbers, templates and journals against plain Python."""

import hashlib
import json
import random
import subprocess
import shutil

import pytest
from pyspark.sql import functions as F

from attestia.functions import hashing as H
from attestia.functions import text as T
from attestia.operators import consensus as C
from attestia.operators import ordered, templates
from attestia.operators.replay import replay


def test_numbers_are_dense_in_order_and_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ranges", lambda rows: 7)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("_part"), (F.col("id") % 3).alias("number"))
    got = {r.k: r.place for r in ordered.numbered(rows, "k", out="place").collect()}
    assert got == {k: n for n, k in enumerate(sorted(got), 1)} and len(got) == 1000
    same = ordered.numbered(spark.range(50).select(F.lit(1).alias("k")), "k").collect()
    assert sorted(r.number for r in same) == list(range(1, 51))
    assert ordered.numbered(rows.limit(0), "k", out="place").count() == 0
    names = spark.createDataFrame([(x,) for x in ("b", "B", "a", "Ä", "é", "z", "E", None)], "name string")
    told = ordered.numbered(names, F.collate("name", "UNICODE")).orderBy("number")
    assert [r.name for r in told.collect()] == [None, "a", "Ä", "b", "B", "E", "é", "z"]


def test_no_window_or_list_holds_the_table(spark):
    plan = ordered.numbered(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    plan = ordered.digest(spark.range(100), F.col("id").cast("string"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_digest_of_lines_in_order(spark):
    lines = [f"line {i * 37 % 101}" for i in range(101)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    for between in ("", "\n"):
        want = hashlib.sha256(between.join(sorted(lines)).encode()).hexdigest()
        assert tuple(ordered.digest(frame, F.col("line"), "line", between=between).first()) == (101, want)
    assert tuple(ordered.digest(frame.limit(0), F.col("line"), "line").first()) == (0, hashlib.sha256(b"").hexdigest())


NUMBERS = ["0", "-0", "-0.0", "1.0", "1e3", "1E21", "1e20", "123456789012345678901", "12345678901234567890123", "0.1", "1e-6", "1e-7", "1.5e-7", "-2.50", "1e400", "9007199254740993", "5e-324", "1.7976931348623157e308", "100", "0.000123", "123e-2", "-1e-10"]


def test_numbers_are_written_as_scripts_write_them():
    want = ["0", "0", "0", "1", "1000", "1e+21", "100000000000000000000", "123456789012345680000", "1.2345678901234568e+22", "0.1", "0.000001", "1e-7", "1.5e-7", "-2.5", "null", "9007199254740992", "5e-324", "1.7976931348623157e+308", "100", "0.000123", "1.23", "-1e-10"]
    assert [H.canonical_json(x) for x in NUMBERS] == want


@pytest.mark.skipif(not shutil.which("node"), reason="no script engine")
def test_numbers_against_a_script_engine():
    r = random.Random(1)
    texts = NUMBERS + [f"{r.uniform(-10, 10)}e{r.randint(-30, 30)}" for _ in range(500)] + [str(r.randint(-(10**k), 10**k)) for k in range(1, 25)]
    code = "for (const x of JSON.parse(process.argv[1])) console.log(JSON.stringify(JSON.parse(x)))"
    told = subprocess.run(["node", "-e", code, json.dumps(texts)], capture_output=True, text=True, check=True, timeout=60).stdout.split()
    assert [H.canonical_json(x) for x in texts] == told


def test_canonical_and_pretty_json(spark):
    text = '{"b": [1.0, {"d": [], "c": {}}], "a": "\\u00e9\\n", "\\uff61": null, "\\ud83d\\ude00": true, "a": 2e0}'
    assert H.canonical_json(text) == '{"a":2,"b":[1,{"c":{},"d":[]}],"\U0001f600":true,"｡":null}'
    assert H.canonical_json('"\\ud800"') == '"\\ud800"'
    assert [H.canonical_json(x) for x in (None, "", "{", "NaN", "[" * 100_000)] == [None] * 5
    frame = spark.createDataFrame([('{"b": [1.0, {}], "a": []}',), ("{",), (None,)], "t string")
    assert [r[0] for r in frame.select(T.pretty_json(F.col("t"))).collect()] == ['{\n  "b": [\n    1,\n    {}\n  ],\n  "a": []\n}\n', None, None]


def test_white_space_is_trimmed_whole(spark):
    row = spark.range(1).select(T.trim(F.lit("\t　﻿ a  b\r\n")), T.strip_diacritics(F.lit("\tab\n")), T.surface_key(F.lit("\rA_b\n"))).first()
    assert tuple(row) == ("a  b", "ab", "ab")


def rendered(spark, template, **values):
    return spark.range(1).select(T.render_template(F.lit(template), {k: F.lit(v) for k, v in values.items()})).first()[0]


def test_values_are_literal_text(spark):
    assert rendered(spark, "{a} {b}", a="{b}", b="x") == "{b} x"
    assert rendered(spark, "{ a }{c}\n}{b}$1{", a="$0\\", b="}{") == "$0\\{c}\n}}{$1{"
    assert rendered(spark, "", a="x") == "" and rendered(spark, "{}{a}", a="") == "{}"
    assert rendered(spark, "plain") == "plain" and rendered(spark, "{x}") == "{x}"
    faults = spark.createDataFrame([("a{b}c",), ("{ }",), ("{a",), ("}{a}{",), ("",), (None,)], "t string").select(T.template_fault(F.col("t"))).collect()
    assert [f[0] for f in faults] == [None, "empty", "unterminated", "unterminated", None, None]


def test_templates_calls_and_arguments_as_tables(spark):
    made = spark.createDataFrame([(1, "{a}-{b}{a}."), (2, "plain"), (3, "{a"), (4, "{ }"), (5, None), (1, "{a}-{b}{a}.")], "template_id int, template string")
    calls = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 9), (14, 3), (15, 5)], "call_id int, template_id int")
    given = spark.createDataFrame([(10, "a", "{b}"), (10, "b", "$1"), (11, "a", "x"), (11, "b", None), (12, "z", "1"), (13, "z", "1")], "call_id int, name string, value string")
    parts = templates.parsed(made)
    assert {tuple(r) for r in templates.rendered(calls, given, parts).collect()} == {(10, "{b}-$1{b}."), (12, "plain")}
    told = {tuple(r) for r in templates.diagnostics(made, calls, given, parts).collect()}
    assert told == {("unterminated", "3", None), ("empty", "4", None), ("undefined", "13", None), ("undefined", "15", None), ("missing", "11", "b"), ("unknown", "12", "z")}


ENTRY = "request_id string, generation long, sequence long, status string, receipt long, payload string, payload_hash string"


def drawn_journal(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ops = []
        for _ in range(r.randint(0, 3)):
            key = r.choice([0, 0, 0, *range(30)])  # one row has many of the writes
            column, tag, value = r.choice([("n", "number", "1.5"), ("n", "bigint", "77"), ("s", "string", f"v{i}"), ("s", "null", None), ("b", "boolean", "true"), ("x", "blob", "aGk="), ("s", "json", '{"a":1}'), ("n", "string", "none")])
            ops.append({"op": "delete", "key": key} if r.random() < 0.15 else {"op": "put", "key": key, "column": column, "type": tag, "value": value})
        if r.random() < 0.05:
            ops.append(r.choice([{"op": "put", "key": 1, "column": "other", "type": "null"}, {"op": "put", "key": 1, "column": "s", "type": "date", "value": ""}, {"op": "drop", "key": 2}, {"op": "delete"}]))
        payload = json.dumps({"operations": ops}) if r.random() < 0.97 else "{"
        digest = hashlib.sha256(payload.encode()).hexdigest() if r.random() < 0.95 else "0"
        status = r.choice(["applied", "applied", "pending", "failed"])
        rows.append((f"q{i}", r.randrange(3), i, status, i if r.random() < 0.8 else None, payload, digest))
        if r.random() < 0.1:
            rows.append((*rows[-1][:2], 1000 + i, *rows[-1][3:]))
        if r.random() < 0.1:
            other = json.dumps({"operations": [{"op": "put", "key": 3, "column": "s", "type": "string", "value": "again"}]})
            rows.append((f"q{i}", 1, 2000 + i, "pending", None, other, hashlib.sha256(other.encode()).hexdigest()))
    return rows


def brute_replay(base, journal, mark, target, receipts):
    table, held, told = {k: dict(v) for k, v in base.items()}, dict(receipts), {}
    for request, g, s, status, receipt, payload, digest in sorted(journal, key=lambda e: e[1:3]):
        if not (status == "pending" or status == "applied" and (receipt is None or ((g, s) > mark and g < target))):
            continue
        try:
            ops = json.loads(payload)["operations"]
        except ValueError:
            ops = []
        sound = all(o.get("key") is not None and (o["op"] == "delete" or o["op"] == "put" and o["column"] in ("n", "s", "b", "x") and o["type"] in ("null", "string", "number", "bigint", "boolean", "blob", "json")) for o in ops)
        if hashlib.sha256(payload.encode()).hexdigest() != digest:
            told[g, s] = "hash"
        elif not ops:
            told[g, s] = "payload"
        elif not sound:
            told[g, s] = "value"
        elif request in held:
            told[g, s] = "repeat" if held[request] == digest else "conflict"
        else:
            held[request] = digest
            for o in ops:
                if o["op"] == "delete":
                    table.pop(o["key"], None)
                    continue
                value = o.get("value")
                if o["column"] == "n":
                    value = None if value == "none" else float(value)
                elif o["column"] == "b":
                    value = True
                elif o["column"] == "x":
                    value = b"hi"
                table.setdefault(o["key"], dict.fromkeys("nsbx"))[o["column"]] = value
    return table, held, told


def test_replay_is_running_the_writes_in_order_once(spark):
    base = {k: {"n": float(k), "s": f"base{k}", "b": False, "x": b"x"} for k in range(0, 40, 2)}
    frame = spark.createDataFrame([(k, *v.values()) for k, v in base.items()], "k long, n double, s string, b boolean, x binary")
    show = lambda f: {r.k: {"n": r.n, "s": r.s, "b": r.b, "x": None if r.x is None else bytes(r.x)} for r in f.collect()}
    for seed in (1, 2, 3):
        rows = drawn_journal(seed=seed)
        journal = spark.createDataFrame(rows, ENTRY)
        table, held, told = brute_replay(base, rows, (0, 60), 2, {})
        done = replay(frame, journal, "k", (0, 60), 2)
        assert show(done.table) == table
        assert {tuple(r) for r in done.receipts.collect()} == set(held.items()) and len(held) > 20
        assert {(r.generation, r.sequence): r.reason for r in done.rejects.collect()} == told
        assert set(told.values()) == {"hash", "payload", "value", "repeat", "conflict"}
        again = replay(done.table, journal, "k", (0, 60), 2, done.receipts)
        assert show(again.table) == table and again.receipts.count() == 0
        assert {r.reason for r in again.rejects.collect()} == set(told.values())
        assert show(replay(done.table, journal, "k", (0, 60), 2).table) == table  # even without receipts
    empty = replay(frame, spark.createDataFrame([], ENTRY), "k", (0, 0), 1)
    assert show(empty.table) == base and empty.rejects.count() == 0


def test_a_hot_row_is_reduced_before_the_shuffle(spark):
    payload = F.concat(F.lit('{"operations":[{"op":"put","key":1,"column":"n","type":"number","value":"'), F.col("id").cast("string"), F.lit('"}]}'))
    journal = spark.range(0, 5000, 1, 8).select(
        F.col("id").cast("string").alias("request_id"), F.lit(0).cast("long").alias("generation"), F.col("id").alias("sequence"), F.lit("pending").alias("status"),
        F.lit(None).cast("long").alias("receipt"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_hash"),
    )
    done = replay(spark.createDataFrame([(1, 0.0)], "k long, n double"), journal, "k", (0, 0), 1)
    assert [tuple(r) for r in done.table.collect()] == [(1, 4999.0)]
    plan = done.table._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "collect_list" not in plan and "Window" not in plan


def test_chains_are_cut_and_handed_over(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ranges", lambda rows: 9)
    r = random.Random(4)
    rows = [(i, r.choice([0, 0, 0, 1, 2, None]), r.choice(["a", "b", None]), r.randrange(50)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, who long, state string, at long")
    got = ordered.chained(frame, "who", "state", "at", "id")
    assert got.columns == ["id", "who", "state", "at", "version", "before"]
    want = {x.id: (x.version, x.before) for x in C.chain(frame, "who", "state", "at", "id").collect()}
    assert {x.id: (x.version, x.before) for x in got.collect()} == want
    whole = ordered.chained(frame.withColumn("who", F.lit(1)), "who", "state", "at", "id")
    assert sorted(x.version for x in whole.collect()) == list(range(1, 601))
    assert ordered.chained(frame.limit(0), "who", "state", "at", "id").count() == 0
