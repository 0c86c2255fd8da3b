import pytest
from pyspark.sql import functions as F

from attestia.functions import hashing as H
from attestia.operators import workflow as W
from attestia.plans import workflow as plans
from attestia.session import dealt

TASKS = "task_id int, round_id string, state string, passed boolean"
SUBMISSIONS = "task_id int, round_id string, role string, receipt_id int, active boolean, novel int, decision string"


def test_reconcile(spark):
    tasks = [
        (1, "r1", "independent-review", True), (2, "r1", "independent-review", None), (3, "r1", "independent-review", True), (4, "r2", "discussion", None),
        (5, "r1", "discussion", None), (6, "r1", "final-review", None), (7, "r1", "final-review", None), (8, "r1", "final-review", None), (9, "r1", "approved", None),
    ]
    sent = [
        (1, "r1", "A", 10, True, None, None), (1, "r1", "B", 11, True, None, None), (2, "r1", "A", 20, True, None, None), (2, "r1", "B", 21, True, None, None),
        (3, "r1", "A", 30, True, None, None), (3, "r1", "B", 31, False, None, None), (4, "r1", "J1", 40, True, 9, None), (4, "r2", "J1", 41, True, 0, None),
        (5, "r1", "J1", 50, True, 2, None), (6, "r1", "J2", 60, True, None, "agree"), (7, "r1", "J2", 70, True, None, "recuse"), (8, "r1", "J2", 80, True, None, "disagree"),
        (9, "r1", "J2", 90, True, None, "agree"),
    ]
    got = {r.task_id: r for r in W.reconcile(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(sent, SUBMISSIONS)).collect()}
    assert {i: (r.to_state, r.reason_code, r.reissued) for i, r in got.items()} == {
        1: ("discussion", "independent-quorum-complete", False),
        2: ("discussion", "j1-adjudication-required", False),
        4: ("final-review", "j1-final-root-proposed", False),  # the submission of an earlier round does not count
        5: ("escalated", "novel-primary-decision", True),
        6: ("approved", "j2-exact-root-cosign", False),
        7: ("escalated", "accepted-recusal", True),
        8: ("escalated", "j2-disagreement", True),
    }
    assert got[1].idempotency_key == "independent-quorum:r1:10:11" and got[4].idempotency_key == "j1-proposal:41"


def test_deliveries_from_claim_to_end(spark):
    jobs = spark.createDataFrame([(1, 5, "sending", 0, 90), (2, 4, "pending", 4, 100), (3, 3, "pending", 0, 101), (4, 2, "sending", 1, 200)], "id int, created_at int, status string, attempts int, next_attempt long")
    armed = W.rearm(jobs, 100)
    assert {r.id for r in armed.filter("status = 'pending'").collect()} == {1, 2, 3}
    claimed = W.claim(armed, 100)
    assert [(r.id, r.status, r.next_attempt) for r in claimed.orderBy("id").collect()] == [(1, "sending", 600_100), (2, "sending", 600_100)]
    assert W.claim(armed, 100, 1).first().id == 2  # the oldest
    ended = W.settle(claimed.withColumn("outcome", F.when(F.col("id") == 2, "down").otherwise("sent")), 1000)
    got = {r.id: (r.status, r.attempts, r.sent_at, r.last_error) for r in ended.collect()}
    assert got == {1: ("sent", 1, 1000, None), 2: ("failed", 5, None, "down")}
    again = W.settle(claimed.withColumn("attempts", F.lit(2)).withColumn("outcome", F.lit("down")), 1000).first()
    assert (again.status, again.attempts, again.next_attempt) == ("pending", 3, 1000 + 8 * 60_000)


def test_lists_roots_and_starts(spark):
    row = spark.sql("select array('b ', 'a', 'b') as x, array('a', '') as y, cast(null as array<string>) as z, array('p', 'q') as r, array('q', 'p', 's') as s")
    got = row.select(W.unique_list(F.col("x")), W.unique_list(F.col("y")), W.unique_list(F.col("z")), W.unique_list(F.col("x"), 2), W.covers(F.col("r"), F.col("s")), W.covers(F.array(F.lit("p"), F.lit("p")), F.col("s"))).first()
    assert list(got) == [["b", "a"], None, [], None, True, False]
    assert [r[0] for r in spark.createDataFrame([(0, 7), (None, 7), (3, 7)], "a long, b long").select(W.started(F.col("a"), F.col("b"))).collect()] == [7, 7, 3]


def test_envelopes_and_issue_reports(spark):
    key, text = b"k" * 70, "payload é"
    signed = spark.createDataFrame([(1, "x", text), (2, "y", text), (3, None, text), (4, "x", None)], "envelope_id int, schema string, payload string")
    signed = signed.withColumn("signature", F.when(F.col("envelope_id") < 9, H.hmac_sha256(F.col("payload"), key)))
    got = {r.envelope_id: r.verdict for r in W.envelope_kinds(signed, key, {"x": {"short": F.length("payload") < 5}}).collect()}
    assert got == {1: "short", 2: "schema", 3: "schema", 4: "signature"}
    report = [(1, True, "other", "a summary of it", "details of what is wrong here", None), (2, None, "none", "short", "mail a@b.org about it all the time", "x" * 2001), (3, True, None, None, None, None)]
    frame = spark.createDataFrame(report, "report_id int, privacy_confirmed boolean, category string, summary string, details string, steps string")
    reasons = {}
    for r in W.issue_rejects(frame).collect():
        reasons.setdefault(r.report_id, set()).add(r.reason)
    assert reasons == {2: {"privacy", "category", "summary", "steps", "unsafe"}, 3: {"category", "summary", "details"}}


def test_a_cut_summary_with_a_line_end_is_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["x" * 149 + "\n" + "second line", "x" * 149 + " " + "second word", "  spaces at both ends of it  ", "\tten words  or   so in  this text\n", "\n" + "a" * 9 + " " * 12, "\u00a0" + "nine char" + " " * 20, None]
    rows = [(i, 1 + i % 2, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = db.execute(plans.ORACLES["issue_reports"]).fetchall()
    got = [tuple(r) for r in plans.issue_reports(spark, str(tmp_path)).select("report_id", "reason").collect()]
    assert sorted(got) == sorted(want) and (1002, "summary") in got


def test_cascade_keeps_who_is_held(spark):
    asked, held = (spark.createDataFrame([(i,) for i in x], "person int") for x in ((1, 2, 2), (2,)))
    notes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "owner int, note string")
    left = W.cascade(asked, held, "person", {"notes": (notes, "owner")}, {"people": (notes, "owner", ["note"])})
    assert {r.note for r in left["notes"].collect()} == {"b", "c", "d"}
    assert {(r.note, r.erased) for r in left["people"].collect()} == {(None, True), ("b", False), ("c", False), ("d", False)}


def test_tree_ranges_are_part_of_the_format(spark):
    rows = spark.range(100).selectExpr("id", "id % 7 as k")
    two, three = H.rowset_tree(rows, "id", "k").first(), H.rowset_tree(rows, "id", "k", digits=3).first()
    assert two.n_rows == three.n_rows == 100 and (two.digits, three.digits) == (2, 3) and two.digest != three.digest


def test_parts_follow_the_size_of_the_input(spark, tmp_path):
    spark.range(100_000).selectExpr("id as k", "uuid() as v").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert dealt(rows, "k").rdd.getNumPartitions() == max(4, dealt(rows, "k", bin_bytes=1 << 40).rdd.getNumPartitions())
    many = dealt(rows, "k", bin_bytes=100_000)
    assert many.rdd.getNumPartitions() > 20 and many.count() == 100_000
