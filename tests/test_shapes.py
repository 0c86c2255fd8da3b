"""Documents by shape, guarded puts and trailing counts of hot keys."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from attestia.operators import relational as R
from attestia.operators import shapes as S
from attestia.sources.objects import ObjectStore

PACKET = {"schema": "annotation-packet-v1", "packetId": "p1", "taskVersion": 2, "sentences": [{"sentenceId": "s", "text": "t", "tokens": [{"id": 1, "form": "f"}]}]}
NOTE = {"schema": "annotation-v1", "packetId": "p1", "annotatorSlot": "A"}
JUDGED = {"kind": "adjudication-package", "packet": PACKET, "adjudication": {"packetId": "p1", "adjudicatorSlot": "J1"}}
SHAPES = {
    "draft": ({"schema": "annotation-draft-v1", "role": "B", "packet": PACKET}, "B"),
    "annotation-artifact": ({"kind": "independent-annotation", "packet": PACKET, "annotation": NOTE}, "A"),
    "adjudication-artifact": (JUDGED, "ratification"),
    "ratification-artifact": ({"kind": "ratification-package", "primaryArtifact": JUDGED, "ratification": {"decision": "agree"}}, "ratification"),
    "packet": (PACKET, None),
    "annotation": (NOTE, "A"),
    "container": ({"packet": PACKET, "annotation": NOTE}, "A"),
    "unknown": ({"packet": {"schema": "other"}}, None),
}


def test_eight_shapes_wrapped_and_plain(spark):
    rows = [(f"{k}-{w}", json.dumps({"artifact": d, "packet": PACKET} if w else d)) for k, (d, _) in SHAPES.items() for w in (0, 1)]
    got = {r.id: r for r in S.classified(spark.createDataFrame(rows, "id string, text string"), "id").collect()}
    for k, (_, role) in SHAPES.items():
        plain, wrapped = got[f"{k}-0"], got[f"{k}-1"]
        assert (plain.kind, plain.role, plain.wrapped) == (k, role, False) and (wrapped.kind, wrapped.role, wrapped.wrapped) == (k, role, True)
        assert plain.digest == wrapped.digest
    assert got["annotation-1"].packet.packetId == "p1" and got["annotation-0"].packet is None  # the wrapping may hold the packet
    assert got["ratification-artifact-0"].adjudication.adjudicatorSlot == "J1" and got["ratification-artifact-0"].ratification.decision == "agree"
    assert got["packet-0"].packet.sentences[0].tokens[0].form == "f" and got["unknown-0"].packet is None


def test_order_of_shapes_decides_and_rejects_have_reasons(spark):
    both = {"kind": "independent-annotation", "schema": "annotation-draft-v1", "annotation": NOTE, "packet": PACKET}
    rows = [
        (1, json.dumps(both)), (2, json.dumps(PACKET)), (3, json.dumps(PACKET, indent=3)), (4, json.dumps({"artifact": PACKET})), (5, "{"), (6, "[1]"), (7, "7"), (8, None), (9, ""),
        (10, '{"artifact": null, "schema": "annotation-v1", "annotatorSlot": "B"}'), (11, '{"kind": "independent-annotation"}'), (12, '{"kind": "ratification-package", "primaryArtifact": 3}'),
        (13, '{"artifact": "x"}'), (14, '{"kind": 5, "schema": ["annotation-v1"]}'),
    ]
    shredded = S.shred(spark.createDataFrame(rows, "id long, text string"), "id")
    got = {r.id: (r.kind, r.reason) for r in shredded.collect()}
    assert got == {
        1: ("draft", None), 2: ("packet", None), 3: ("packet", "duplicate"), 4: ("packet", "duplicate"), 10: ("annotation", None), 11: ("annotation-artifact", "hollow"),
        12: ("unknown", "unknown"), 14: ("unknown", "unknown"), **{k: ("malformed", "malformed") for k in (5, 6, 7, 8, 9, 13)},
    }
    assert [(r.id, r.packetId, r.taskVersion) for r in S.typed(shredded, "packet", "packet", "id").collect()] == [(2, "p1", 2)]
    other = S.classified(spark.createDataFrame([(1, '{"schema": "x-v9"}')], "id long, text string"), "id", schemas=S.Schemas(packet="x-v9"))
    assert other.first().kind == "packet"
    assert S.shred(spark.createDataFrame([], "id long, text string"), "id").count() == 0


UID = "0a1b2c3d-1111-4222-8333-444455556666"
ROW = "scope string, name string, content binary"


def test_objects_are_never_overwritten(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    assert store.objects().count() == 0
    rows = [("submissions", f"{UID}.json", b"a"), ("submissions", f"comment-{UID}.json", None), ("identities", f"{UID}.json", b"secret"), ("identities", f"comment-{UID}.json", b"x")]
    rows += [("submissions", "../x.json", b"x"), ("submissions", f"{UID[:-1]}.json", b"x"), ("other", f"{UID}.json", b"x"), ("submissions", None, b"x"), ("submissions", f"{UID}.json", b"a")]
    told = sorted((r.scope, r.name or "", r.outcome) for r in store.put(spark.createDataFrame(rows, ROW)).collect())
    assert [o for *_, o in told].count("created") == 4 and [o for *_, o in told].count("invalid") == 5
    again = store.put(spark.createDataFrame([("submissions", f"{UID}.json", b"a"), ("submissions", f"comment-{UID}.json", b"other"), ("submissions", f"{UID}.state.json", b"s")], ROW))
    assert {r.name: r.outcome for r in again.collect()} == {f"{UID}.json": "same", f"comment-{UID}.json": "conflict", f"{UID}.state.json": "created"}
    held = {(r.scope, r.name): (bytes(r.content), r.kind, r.tier) for r in store.objects().collect()}
    assert held == {
        ("submissions", f"{UID}.json"): (b"a", "submission", "public"), ("submissions", f"comment-{UID}.json"): (b"", "comment", "public"),
        ("submissions", f"{UID}.state.json"): (b"s", "task-state", "public"), ("identities", f"{UID}.json"): (b"secret", "identity-envelope", "protected"),
    }


def test_a_put_that_is_killed_and_repeated_leaves_each_object_once(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("submissions", f"{UID}.json", b"a")] * 3, ROW)
    aside = tmp_path / "aside" / "p1"
    aside.mkdir(parents=True)
    (aside / "half").write_bytes(b"rest of a put that was killed")
    first = [tuple(r) for r in store.put(rows, "p1").collect()]
    assert [o for *_, o in first] == ["created"] * 3 and store.objects().count() == 1
    assert [tuple(r) for r in store.put(rows, "p1").collect()] == first and store.objects().count() == 1  # the same put again
    clash = spark.createDataFrame([("submissions", f"comment-{UID}.json", b"x"), ("submissions", f"comment-{UID}.json", b"y")], ROW)
    assert sorted(r.outcome for r in store.put(clash).collect()) == ["conflict", "created"]
    with pytest.raises(Exception, match="boom"):
        store.put(rows.withColumn("content", F.raise_error(F.lit("boom")).cast("binary")), "p3")
    assert store.objects().count() == 2


def test_trailing_counts_equal_the_range_window(spark):
    r = random.Random(5)
    rows = [(i, r.choice([7, 7, 7, 7, 1, 2, None]), r.choice([r.randrange(-500, 500), r.randrange(20)])) for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, who long, at long").withColumn("_t", F.lit("x"))
    for width, slices in ((0, 4), (1, 1), (37, 16), (100, 3), (2000, 16)):
        want = {x.id: x.n for x in R.trailing_count(frame, "who", "at", width, "n").collect()}
        got = R.trailing_counts(frame, "who", "at", width, "n", "id", slices)
        assert {x.id: x.n for x in got.collect()} == want and got.columns == [*frame.columns, "n"]
    assert R.trailing_counts(frame.limit(0), "who", "at", 5, "n", "id").count() == 0


def test_a_hot_key_s_counts_are_shared_among_tasks(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 1).alias("who"), (F.col("id") * 10).alias("at"))
    counted = R.trailing_counts(rows, "who", "at", 16_000, "n", "id")
    assert counted.agg(F.max("n")).first()[0] == 1601
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_key#\d+L?, _slice#", plan)
