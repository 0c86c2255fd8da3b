"""Streams against their batch forms, for several divisions into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from attestia.operators import consensus as C
from attestia.operators import rounds as R
from attestia.streaming import machine
from attestia.streaming.admission import Admission
from attestia.streaming.deadlines import Deadlines, outcomes
from attestia.streaming.ledger import Ledger
from attestia.streaming.rounds import Rounds

POLICY = (0.6, 0.2, "raw-agreement")


def drawn_log(n=60, seed=1):
    r = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n * 5):
        task = r.choice([0, 0, 0, *range(n)])  # one task has many of the submissions
        role = r.choice(["A", "A", "B", "B", "J1", "J2", "J9"])
        units = [(str(u), d, r.choice(["x", "x", "x", "y", None])) for u in range(r.choice([0, 3, 6])) for d in ("p", "q") if r.random() < 0.9]
        seq += 1
        rows.append((task, f"r{task % 2}", role, f"{role}{seq}", seq, r.choice(["agree", "agree", "recuse", None]) if role == "J2" else None, units))
    return rows


def brute_steps(rows):
    """Rounds by plain Python, over the first submission of each role."""
    from collections import Counter

    first, out = {}, set()
    for t, r, role, receipt, _, decision, units in rows:
        if role in R.ROLES:
            first.setdefault((t, r), {}).setdefault(role, (receipt, decision, {(u, d): v or "null" for u, d, v in units}))
    for (t, r), s in first.items():
        if not {"A", "B"} <= s.keys():
            continue
        a, b = s["A"][2], s["B"][2]
        raws, kappas, disagreements = [], [], 0
        for d in {k[1] for k in a | b}:
            pairs = [(a.get(k, "null"), b.get(k, "null")) for k in a.keys() | b.keys() if k[1] == d]
            n, apart = len(pairs), sum(x != y for x, y in pairs)
            left, right = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
            po, pe = 1 - apart / n, sum(left[v] * right[v] for v in left) / n**2
            raws.append(po)
            disagreements += apart
            if pe != 1:
                kappas.append((po - pe) / (1 - pe))
        raw = sum(raws) / len(raws) if raws else 1.0
        kappa = sum(kappas) / len(kappas) if kappas else None
        passed = raw >= POLICY[0] and (kappa is None or kappa >= POLICY[1])
        out.add((t, r, 1, "discussion", passed, len(a.keys() | b.keys()), disagreements, None))
        if "J1" in s:
            novel = sum(v not in (a.get(k, "null"), b.get(k, "null")) for k, v in s["J1"][2].items())
            out.add((t, r, 2, "escalated" if novel else "final-review", None, None, None, novel))
            if not novel and "J2" in s and s["J2"][1]:
                out.add((t, r, 3, "approved" if s["J2"][1] == "agree" else "escalated", None, None, None, None))
    return out


def told(events):
    rows = [(e.task_id, e.round_id, e.turn, e.to_state, e.passed, e.units, e.disagreements, e.novel) for e in events.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rounds_settle_as_plain_python_does(spark):
    for seed in (1, 2):
        rows = drawn_log(seed=seed)
        assert told(R.settle(spark.createDataFrame(rows, R.SUBMISSION), *POLICY)) == brute_steps(rows)
    assert R.settle(spark.createDataFrame([], R.SUBMISSION)).count() == 0


def exchanges(frame):
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_units_never_travel_once_submissions_are_dealt_by_round(spark):
    found = exchanges(R.settle(spark.createDataFrame(drawn_log(5), R.SUBMISSION), *POLICY))
    assert found and not [x for x in found if "dimension" in x or "unit#" in x]


@pytest.mark.parametrize("cuts", [(), (5,), (40, 41, 150, 290)])
def test_any_division_of_the_log_gives_the_same_rounds(spark, tmp_path, cuts):
    rows = drawn_log()
    edges = [0, *cuts, len(rows)]
    parts = [spark.createDataFrame(rows[a:b], R.SUBMISSION) for a, b in zip(edges, edges[1:], strict=False)]
    settled = Rounds(spark, str(tmp_path), POLICY)
    for part in settled.roles, settled.values, settled.cells, settled.turns:
        part.every = 2  # folds happen too
    machine.arrivals(parts, settled, str(tmp_path))
    assert told(settled.events()) == brute_steps(rows)
    counted = R.first_submissions(spark.createDataFrame(rows, R.SUBMISSION)).count()
    assert settled.refused().count() + counted == len(rows)
    assert {r.reason for r in settled.refused().collect()} == {"occupied", "role"}


def test_what_was_told_is_not_measured_again(spark):
    unit = lambda *v: [(str(n), "p", x) for n, x in enumerate(v)]
    rows = [(1, "r", "A", "A1", 1, None, unit("x", "y")), (1, "r", "B", "B1", 2, None, unit("x")), (1, "r", "J1", "J", 3, None, unit("z")), (1, "r", "J2", "K", 4, "agree", None)]
    firsts = spark.createDataFrame(rows, R.SUBMISSION)
    steps = lambda turn, novel: {(e.turn, e.to_state, e.novel) for e in R.settled(firsts, *POLICY, spark.createDataFrame([(1, "r", turn, novel)], "task_id long, round_id string, turn int, novel long")).collect()}
    assert steps(0, None) == {(1, "discussion", None), (2, "escalated", 1)}
    assert steps(1, None) == {(2, "escalated", 1)}
    assert steps(2, 0) == {(3, "approved", None)}  # the novelty that was told holds
    assert steps(2, 1) == steps(3, 0) == set()


def test_metrics_of_odd_units():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("unit", pa.string()), ("dimension", pa.string()), ("value", pa.string())]))
    row = lambda *us: [dict(zip(("unit", "dimension", "value"), u, strict=True)) for u in us]
    a = [None, [], row(("1", "p", "b"), ("1", "p", "a")), row((None, None, None)), row(("1", "p", "x")), row(("1", "p", "x"), ("1", "q", "x"))]
    b = [None, None, row(("1", "p", "b")), row((None, None, "null")), row(("2", "p", "x")), row(("1", "q", "y"), ("1", "p", "x"))]
    f = [None, row(("1", "p", "z")), row(("1", "p", "a")), [None], row(("3", "p", "null"), ("1", "p", "y")), row(("1", "q", "y"))]
    got = {k: v.to_pylist() for k, v in R.metrics([pa.array(x, kind) for x in (a, b, f)], 0.5, 0.2, "raw-agreement").items()}
    assert got == {"units": [0, 0, 1, 1, 2, 2], "disagreements": [0, 0, 0, 0, 2, 1], "passed": [True, True, True, True, False, False], "novel": [0, 1, 1, 0, 1, 0]}


def test_delivered_files_are_moved_and_taken_up_in_turn(spark, tmp_path):
    rows = spark.createDataFrame([(n, n % 2) for n in range(10)], "v long, place int")
    rows.write.partitionBy("place").parquet(f"{tmp_path}/parts")
    seen = []
    machine.deliveries(spark, [f"{tmp_path}/parts/place={n}" for n in range(3)], "v long", lambda batch, number: seen.append(sorted(r.v for r in batch.collect())), f"{tmp_path}/s")
    assert seen == [[0, 2, 4, 6, 8], [1, 3, 5, 7, 9], []]  # a part without rows arrives too
    assert not list(tmp_path.glob("parts/place=*/*.parquet"))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = drawn_log(20)
    settled = Rounds(spark, str(tmp_path), POLICY)
    for number, part in enumerate((rows[:50], rows[50:])):
        for _ in range(2):
            settled(spark.createDataFrame(part, R.SUBMISSION), number)
    assert told(settled.events()) == brute_steps(rows)


def test_ledger_merges_folds_and_forgets(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), {"k": "bigint"}, {"n": ("bigint", "sum"), "at": ("bigint", "max")}, every=2)
    delta = lambda *rows: spark.createDataFrame(list(rows), "k long, n long, at long")
    for number in range(5):
        book.add(number, delta((1, 1, number), (1, 1, number), (number, 5, 0)), keep=F.col("at") > 0)
    found = {r.k: (r.n, r["at"]) for r in book.before(5).collect()}
    assert found[1] == (15, 4) and found[4] == (5, 0) and 2 not in found and 0 not in found  # forgotten at a fold
    assert {r.k for r in book.before(5, spark.createDataFrame([(4,)], "k long")).collect()} == {4}
    assert book.before(0).count() == 0


STEPS = {"s": ("a", "x"), "a": ("b", "a"), "b": ("c", "a"), "c": ("a",)}
EVENT = "entity long, key string, payload string, kind string, at long, id long"


def drawn_events(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice([0, 0, 0, *range(8)]), r.choice([None, *map(str, range(300))]), r.choice("pq"), r.choice("abcx"), r.randrange(50) * 900_000_000, i) for i in range(n)]


def brute_admission(parts):
    """Tags of all events by plain Python, batch after batch."""
    used, state, out = {}, {}, {}
    for part in parts:
        firsts = {}
        for e in sorted(part, key=lambda e: (e[4], e[5])):
            if e[1] is None:
                out[e[5]] = "no-key"
            elif e[1] in used:
                out[e[5]] = "repeat" if used[e[1]] == e[2] else "conflict"
            else:
                used[e[1]] = e[2]
                firsts.setdefault(e[0], []).append(e)
        for entity, events in firsts.items():
            now, last = state.get(entity, ("s", (-1, -1)))
            before = last
            for e in events:
                if (e[4], e[5]) <= before:
                    out[e[5]] = "late"
                elif e[3] not in STEPS.get(now, ()):
                    out[e[5]] = "illegal"
                else:
                    out[e[5]], now, last = "accepted", e[3], (e[4], e[5])
            state[entity] = now, last
    return out


@pytest.mark.parametrize("order", ["given", "time", "reverse"])
def test_every_event_is_accepted_or_rejected_once(spark, tmp_path, order):
    rows = drawn_events()
    if order != "given":
        rows.sort(key=lambda e: (e[4], e[5]), reverse=order == "reverse")
    parts = [rows[:100], rows[100:101], rows[101:300], rows[300:]]
    gate = Admission(spark, str(tmp_path), STEPS, "s", F.floor(F.col("at") / 5_000_000_000))
    gate.keys.every = gate.entities.every = 2
    machine.arrivals([spark.createDataFrame(p, EVENT) for p in parts], gate, str(tmp_path))
    yes, no = gate.accepted().collect(), gate.rejected().collect()
    assert sorted((tuple(e)[:6] for e in yes + no), key=str) == sorted(rows, key=str)
    want = brute_admission(parts)
    assert {e.id: e.tag for e in yes + no} == want and {e.tag for e in yes} == {"accepted"}
    tags = set(want.values())
    assert {"no-key", "repeat", "conflict", "illegal", "accepted"} <= tags and ("late" in tags) == (order != "time")


def test_a_chunk_is_folded_whole_when_its_start_states_are_broadcast_late(spark):
    rows = [(i, i % 5, "abc"[i * 7 % 3], i) for i in range(4000)]
    events = spark.createDataFrame(rows, "id long, entity long, kind string, at long").repartition(8)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        told = C.judge_guarded(events, "entity", "kind", "s", STEPS, "at", "id", chunk=F.floor(F.col("at") / 1000))
        got = {r.id: r.legal for r in told.collect()}
    finally:
        for k in confs:
            spark.conf.unset(k)
    now, want = {}, {}
    for i, e, kind, _ in rows:
        want[i] = kind in STEPS.get(now.get(e, "s"), ())
        now[e] = kind if want[i] else now.get(e, "s")
    assert got == want


def test_no_event_is_too_late_for_deduplication(spark, tmp_path):
    day = 86_400_000_000
    parts = [[(1, "june", "p", "a", 150 * day, 1)], [(1, "june2", "p", "a", 151 * day, 2)], [(1, "january", "p", "a", 0, 3), (2, "june", "p", "a", 0, 4)]]
    gate = Admission(spark, str(tmp_path))
    machine.arrivals([spark.createDataFrame(p, EVENT) for p in parts], gate, str(tmp_path))
    assert {e.id for e in gate.accepted().collect()} == {1, 2, 3} and {(e.id, e.tag) for e in gate.rejected().collect()} == {(4, "repeat")}


def test_rows_repeated_whole_and_batches_run_again(spark, tmp_path):
    rows = [(1, "k", "p", "a", 5, 1)] * 4 + [(1, "l", "p", "b", 6, 2)]
    gate = Admission(spark, str(tmp_path), STEPS, "s")
    for number, part in enumerate((rows, rows[:1])):
        for _ in range(2):
            gate(spark.createDataFrame(part, EVENT), number)
    assert sorted((e.id, e.tag) for e in gate.accepted().collect()) == [(1, "accepted"), (2, "accepted")]
    assert [e.tag for e in gate.rejected().collect()] == ["repeat"] * 4


def test_one_entity_with_half_of_all_events_is_shared_among_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("entity"), F.col("id").cast("string").alias("key"), F.lit("p").alias("payload"),
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("kind"), (F.col("id") * 10_000_000).alias("at"), "id",
    )
    gate = Admission(spark, str(tmp_path), STEPS, "s")
    gate(rows, 0)
    hot = gate.accepted().filter("entity = 0")
    assert hot.count() == 10_000 and gate.rejected().count() == 10_000  # others cannot begin with b
    placed = C.outcomes(rows, "entity", "kind", "s", STEPS, "at", "id", chunk=gate.chunk)
    assert placed.filter("entity = 0").count() > 50  # folded in as many rows


ROW = "round long, kind string, at long"


def drawn_rounds(n=150, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        opened = r.randrange(1000)
        rows += [(k, "open", opened)] + [(k, role, opened + r.choice([5, 50, 99, 100, 101, 300])) for role in "ABA" if r.random() < 0.7]
    rows += [(0, "A", r.randrange(1400)) for _ in range(len(rows))]  # one round has half of all rows
    return sorted(rows + [(None, "A", 20), (9999, "B", 30)], key=lambda x: x[2])


@pytest.mark.parametrize("cuts", [(), (200,), (40, 41, 150, 290, 400)])
def test_deadlines_fire_as_the_range_rule_has_it(spark, tmp_path, cuts):
    rows = drawn_rounds()
    edges = [0, *cuts, len(rows)]
    whole = spark.createDataFrame(rows, ROW)
    want = {tuple(x) for x in outcomes(whole, ("A", "B"), 100).collect()}
    opened = {k: t for k, kind, t in rows if kind == "open"}
    first = lambda k, role: min((t for x, kind, t in rows if (x, kind) == (k, role)), default=10**9)
    for k, outcome, at in want:
        last = max(first(k, "A"), first(k, "B"))
        assert (outcome, at) == (("reached", last) if last <= opened[k] + 100 else ("expired", opened[k] + 100))
    watch = Deadlines(spark, str(tmp_path), ("A", "B"), 100, ttl=10**6)
    watch.rounds.every = 2
    machine.arrivals([spark.createDataFrame(rows[a:b], ROW) for a, b in zip(edges, edges[1:], strict=False)], watch, str(tmp_path))
    assert {tuple(x)[:3] for x in watch.outcomes().collect()} == want and {o for _, o, _ in want} == {"reached", "expired"}
    assert watch.outcomes().count() == len(want)


def test_a_round_expires_without_a_row_of_its_own_and_is_forgotten(spark, tmp_path):
    watch = Deadlines(spark, str(tmp_path), ("A", "B"), 100, ttl=70)
    watch.rounds.every = 2
    for number, rows in enumerate(([(1, "open", 0), (1, "A", 5)], [(2, "open", 150)], [(1, "B", 160)], [(3, "open", 400)])):
        watch(spark.createDataFrame(rows, ROW), number)
    assert {tuple(x) for x in watch.outcomes().collect()} == {(1, "expired", 100, 1), (2, "expired", 250, 3)}
    assert [tuple(x) for x in watch.refused().collect()] == [(1, "B", 160, 2)]
    assert {r["round"] for r in watch.rounds.before(4).collect()} == {3}  # the others have left the state
