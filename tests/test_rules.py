"""Rules of documents, retention, publication and erasure, each met both ways."""

from pyspark.sql import functions as F

from attestia.operators import consensus as C
from attestia.operators import documents as D
from attestia.operators import queues as Q
from attestia.operators import workflow as W

SENTENCE = "doc int, sentence_id string, structurallyAcceptable boolean, completePredicate boolean, tokens array<struct<token_id:int,decision:string>>"


def test_differences_count_missing_sentences_with_their_tokens(spark):
    tokens = [(1, "a"), (2, None), (3, "c")]
    final = [(1, "s", True, None, tokens), (1, "t", True, True, tokens), (2, "s", True, True, None), (3, "s", None, None, []), (3, "u", True, True, None)]
    source = [(1, "s", True, None, tokens), (2, "s", False, None, [(9, "z")]), (3, "s", None, None, [(1, "a")]), (4, "s", True, True, tokens)]
    frame = lambda rows: spark.createDataFrame(rows, SENTENCE)
    told = lambda a, b: {r.doc: r.differences for r in D.sentence_differences(frame(a), frame(b), "doc").collect()}
    assert told(final, source) == {1: 4, 2: 2, 3: 1}
    changed = [(1, "s", False, True, [(1, "b"), (3, "c")]), (1, "t", True, True, tokens[::-1])]
    assert told(final[:2], changed) == {1: 2 + 2 + 0}
    assert told([], source) == {}


def adjudicated(spark, **changes):
    """A packet, its two annotations and an adjudication that is in order, with changes to it."""
    task = {"taskId": "t1", "taskVersion": 1, "packetId": "p1", "holdoutId": "h", "protocolId": "q", "guidelineVersion": "g", "dataVersion": "d", "protocolVersion": "v"}
    origin = {"independentFromImplementationTeam": True, "blindToParserInternals": True, "parserPredictionsViewed": False}
    head = ", ".join(f"{k} {'int' if k == 'taskVersion' else 'string'}" for k in task)
    flags = ", ".join(f"{k} boolean" for k in origin)
    policy = "metricPolicy struct<automaticFinalization:boolean,claimBoundary:string,metrics:array<string>,minimumDefinedKappa:double,minimumRawAgreement:double,policyVersion:string,schema:string,undefinedKappaFallback:string>"
    packet = spark.createDataFrame(
        [("x-packet-v1", *task.values(), (False, None, ["raw"], 0.5, 0.9, None, "s", None), "r", True, False, True, False, None, [("s1", "text", [(1, "a"), (2, "b")])], None)],
        f"schema string, {head}, {policy}, releaseCandidateId string, pilotOnly boolean, developerVisible boolean, parserPredictionsExcluded boolean, derivedFromExcludedCorpus boolean, holdoutManifestSha256 string, "
        "sentences array<struct<sentenceId:string,text:string,tokens:array<struct<id:int,form:string>>>>, instructions array<string>",
    )
    root = packet.select(D.packet_root()).first()[0]
    tokens = lambda note: f"tokens:array<struct<tokenId:int,universalPartOfSpeech:string,headTokenId:int,dependencyRelation:string,irabHeadTokenId:int,irabCategory:string,irabNotApplicable:boolean,{note}:string>>"
    kind = lambda note: f"sentences array<struct<sentenceId:string,structurallyAcceptable:boolean,completePredicate:boolean,{note}:string,{tokens(note)}>>"
    body = lambda head_of_2, note, ok=True: [("s1", ok, True, note, [(1, "N", 0, "root", None, "_", True, None), (2, "V", head_of_2, "obj", None, "_", True, note)])]
    rows = [("x-annotation-v1", root, *task.values(), slot, "name", True, False, *origin.values(), body(n, None, ok)) for slot, n, ok in (("A", 1, True), ("B", changes.pop("other", 1), changes.pop("doubt", True)))]
    both = spark.createDataFrame(rows, f"schema string, packetMerkleRoot string, {head}, annotatorSlot string, annotatorPseudonym string, isHuman boolean, isSynthetic boolean, {flags}, {kind('note')}")
    roots = {r.annotatorSlot: r.root for r in both.select("annotatorSlot", D.annotation_root().alias("root")).collect()}
    row = {
        "schema": "x-adjudication-v1", "packetMerkleRoot": root, "annotationAMerkleRoot": roots["A"], "annotationBMerkleRoot": roots["B"], **task, "annotationASlot": "A", "annotationBSlot": "B",
        "adjudicatorSlot": "J1", "adjudicatorPseudonym": "judge", "adjudicatorIsHuman": True, "adjudicatorIsSynthetic": False, **origin, "sentences": body(changes.pop("final", 1), changes.pop("note", None)),
    }
    row |= changes
    schema = ", ".join(f"{k} {'int' if k == 'taskVersion' else 'boolean' if k in origin or k.startswith('adjudicatorIs') else 'string'}" for k in row if k != "sentences")
    made = spark.createDataFrame([tuple(row.values())], f"{schema}, {kind('resolutionNote')}")
    return {r.reason for r in D.adjudication_rejects(made, packet, both).collect()}


def test_adjudications_are_bound_and_explained(spark):
    assert adjudicated(spark) == set()
    assert adjudicated(spark, adjudicatorSlot="J2", packetMerkleRoot="0", taskVersion=2) == {"slot", "packet-changed", "identity"}
    assert adjudicated(spark, packetId="other") == {"no-packet", "identity", "packet-changed", "annotation-a", "annotation-b", "coverage"}
    assert adjudicated(spark, annotationBSlot="A") == {"annotation-b", "same-slots"}
    assert adjudicated(spark, annotationASlot="C", annotationAMerkleRoot=None) == {"annotation-a"}
    assert adjudicated(spark, other=2) == {"unresolved"} and adjudicated(spark, other=2, note=" \n\t") == {"unresolved"} and adjudicated(spark, other=2, note="why") == set()
    assert adjudicated(spark, final=2) == {"unresolved"} and adjudicated(spark, doubt=False) == {"unresolved"} and adjudicated(spark, doubt=False, note="why") == set()


def test_items_of_a_running_recovery_stay(spark):
    schema = "g int, id int, bytes long, expires_at long, lease_until long, generation int, sequence int, verified_at int, created_at int"
    items = spark.createDataFrame([(1, 1, 900, 5, None, 1, 0, 0, 0), (1, 2, 200, 99, None, 2, 0, 0, 0), (1, 3, 200, 99, 50, 3, 0, 0, 0)], schema)
    kept = lambda **more: Q.retain(items, "g", 10, 2, 1000, **more).first().kept_ids
    assert kept() == [3, 2] and kept(recovering=F.col("id") == 1) == [3, 2, 1] and kept(recovering=F.lit(None).cast("boolean")) == [3, 2]


def test_publication_needs_the_receipt_of_the_active_result(spark):
    tasks = spark.createDataFrame([(i, "approved", "accepted", 5, 10 * i) for i in range(1, 6)] + [(6, "approved", "pending", 5, 60), (7, "approved", "accepted", 50, 70), (8, "open", "accepted", 5, 80)], "task_id int, state string, repository_status string, appeal_deadline int, active_receipt int")
    finals = spark.createDataFrame([(i, 1, 10 * i, f"f{i}", "superseded" if i == 2 else "active") for i in range(1, 9)] + [(1, 2, 11, "g", "active")], "task_id int, round_id int, receipt_id int, root string, status string")
    receipts = spark.createDataFrame([(i, 2 if i == 3 else 1, "no" if i == 4 else f"f{i}", 100 + i) for i in range(1, 9)] + [(1, 1, "f1", 90)], "task_id int, round_id int, root string, receipt int")
    appeals = spark.createDataFrame([(5, "pending"), (1, "rejected")], "task_id int, status string")
    assert [tuple(r) for r in C.publishable(tasks, appeals, finals, receipts, 10).collect()] == [(1, 1, "f1", 90)]


def test_erasure_waits_then_deletes_item_by_item(spark):
    day = W.DAY_MS
    now = 1000 * day
    requests = spark.createDataFrame([(i, f"u{i}", "pending", 0) for i in range(1, 6)] + [(6, "u1", "completed", 0), (7, "u2", "pending", now + 1)], "id int, user_id string, status string, eligible_after long")
    part = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3), ("u3", 4), ("u4", 4)], "user_id string, task_id int")
    tasks = spark.createDataFrame([(1, "published", now - 40 * day), (2, "published", now - 20 * day), (3, "open", 0), (4, "failed", now - 400 * day)], "task_id int, state string, updated_at long")
    subs = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u4", "c"), ("u2", "d")], "user_id string, receipt_id string")
    items = spark.createDataFrame([(1, "a.json", "deleted"), (1, "old.json", "pending"), (4, "c.json", "deleted"), (2, "d.json", "pending")], "request_id int, blob_name string, status string")
    told, todo = W.erasures(requests, part, tasks, subs, items, now, days=1)  # 30 at least
    assert {tuple(r) for r in told.collect()} == {(1, "deleting", None, 2), (2, "retry", now + 10 * day, 0), (3, "retry", now + day, 0), (4, "completed", None, 0), (5, "completed", None, 0)}
    assert {tuple(r) for r in todo.collect()} == {(1, "b.json"), (1, "old.json")}
