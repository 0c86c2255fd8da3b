import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestia.operators import agreement as A
from attestia.operators import documents as D
from attestia.sources import documents as S
from attestia.sources import dumps

# The orders of the format, spelled out: a wrong order in the operators must not pass.
TASK_ORDER = ("taskId", "taskVersion", "packetId", "holdoutId", "protocolId", "guidelineVersion", "dataVersion", "protocolVersion")
FLAG_ORDER = ("releaseCandidateId", "pilotOnly", "developerVisible", "parserPredictionsExcluded", "derivedFromExcludedCorpus", "holdoutManifestSha256")
ORIGIN_ORDER = ("independentFromImplementationTeam", "blindToParserInternals", "parserPredictionsViewed")
TOKEN_ORDER = ("universalPartOfSpeech", "headTokenId", "dependencyRelation", "irabHeadTokenId", "irabCategory", "irabNotApplicable")
RATIFICATION_ORDER = (
    "taskId", "taskVersion", "packetId", "holdoutId", "protocolVersion", "packetMerkleRoot", "primaryReceiptId", "primaryAdjudicationMerkleRoot",
    "reviewerSlot", "reviewerPseudonym", "reviewerIsHuman", "reviewerIsSynthetic", "independentFromImplementationTeam", "decision",
)
TASK = {k: k[:3] for k in TASK_ORDER} | {"taskVersion": 2}
POLICY = {
    "schema": "s", "policyVersion": "p", "metrics": ["raw"], "minimumRawAgreement": 0.9, "minimumDefinedKappa": 0.8,
    "undefinedKappaFallback": "raw-agreement", "automaticFinalization": False, "claimBoundary": "c é",
}
SENTENCES = [{"sentenceId": "s1", "text": "كتبَ زيدٌ", "tokens": [{"id": 1, "form": "كتبَ"}, {"id": 2, "form": "زيدٌ"}]}]
PACKET = {
    "schema": "demo-packet-v3", **TASK, "metricPolicy": POLICY, "releaseCandidateId": "r", "pilotOnly": True, "developerVisible": False,
    "parserPredictionsExcluded": True, "derivedFromExcludedCorpus": False, "holdoutManifestSha256": None, "sentences": SENTENCES,
}


def digest(values):
    text = "".join("-1:" if v is None else f"{len(str(v).encode())}:{str(v).lower() if isinstance(v, bool) else v}" for v in values)
    return hashlib.sha256(text.encode()).hexdigest()


def packet_root(p):
    policy = json.dumps(p["metricPolicy"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    values = ["demo-packet-root-v3", p["schema"], *[p[k] for k in TASK_ORDER], policy, *[p[k] for k in FLAG_ORDER], len(p["sentences"])]
    for s in p["sentences"]:
        values += [s["sentenceId"], s["text"], len(s["tokens"]), *[x for t in s["tokens"] for x in (t["id"], t["form"])]]
    return digest([*values, 0])


def annotation(slot, head, root):
    token = {"universalPartOfSpeech": "NOUN", "headTokenId": 1, "dependencyRelation": "nsubj", "irabHeadTokenId": None, "irabCategory": "_", "irabNotApplicable": False, "note": None}
    tokens = [{"tokenId": 1, **token, "headTokenId": 0}, {"tokenId": 2, **token, "headTokenId": head}]
    return {
        "schema": "demo-annotation-v3", **TASK, "packetMerkleRoot": root, "annotatorSlot": slot, "annotatorPseudonym": "p", "isHuman": True, "isSynthetic": False,
        "independentFromImplementationTeam": True, "blindToParserInternals": True, "parserPredictionsViewed": False,
        "sentences": [{"sentenceId": "s1", "structurallyAcceptable": True, "completePredicate": True, "note": "n", "tokens": tokens}],
    }


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    root = packet_root(PACKET)
    for name, value in {"packet": PACKET, "a": annotation("A", 1, root), "b": annotation("B", 0, root)}.items():
        (folder / f"{name}.json").write_text(json.dumps(value, indent=2, ensure_ascii=False))
    packets = S.json_documents(spark, str(folder / "packet.json"), "packet")
    return packets, S.json_documents(spark, [str(folder / "a.json"), str(folder / "b.json")], "annotation")


def test_roots(files):
    packets, annotations = files
    assert packets.select(D.packet_root()).first()[0] == packet_root(PACKET)
    got = {r[0]: r[1] for r in annotations.select("annotatorSlot", D.annotation_root()).collect()}
    for slot, head in (("A", 1), ("B", 0)):
        a = annotation(slot, head, packet_root(PACKET))
        columns = ("packetMerkleRoot", *TASK_ORDER, "annotatorSlot", "annotatorPseudonym", "isHuman", "isSynthetic", *ORIGIN_ORDER)
        values = ["demo-annotation-root-v3", a["schema"], *[a[c] for c in columns], 1]
        for s in a["sentences"]:
            values += [s["sentenceId"], True, True, "n", 2]
            for t in s["tokens"]:
                values += [t["tokenId"], *[t[f] for f in TOKEN_ORDER], None]
        assert got[slot] == digest(values)


def test_whole_numbers_and_absent_keys_of_a_policy(spark, tmp_path):
    policy = {"metrics": ["raw"], "minimumRawAgreement": 1, "minimumDefinedKappa": 0, "schema": "s"}
    packet = {**PACKET, "metricPolicy": policy}
    (tmp_path / "p.json").write_text(json.dumps(packet, indent=2, ensure_ascii=False))
    got = S.json_documents(spark, str(tmp_path / "p.json"), "packet").select(D.packet_root()).first()[0]
    assert got == packet_root(packet)


def test_units_and_agreement(files):
    units = D.units(files[1], F.col("annotatorSlot"))
    assert units.groupBy("rater").count().select("count").distinct().first()[0] == 2 + 2 * 6
    paired = D.side_by_side(units, "A", "B")
    assert D.uncovered(paired).count() == 0
    scores = {r.dimension: r for r in A.agreement(paired).collect()}
    assert scores["token.headTokenId"].disagreements == 1 and sum(r.disagreements for r in scores.values()) == 1
    values = {r.field: r.value for r in units.filter("rater = 'A' and token_id = 2").collect()}
    assert values["token.dependencyRelation"] == '"nsubj"' and values["token.irabHeadTokenId"] == "null" and values["token.irabNotApplicable"] == "false"
    final = paired.select("sentence_id", "token_id", "dimension", F.col("a").alias("value"), F.lit(" ").alias("note"))
    assert [r.dimension for r in D.unresolved(paired, final).collect()] == ["token.headTokenId"]


def test_validation(spark, files):
    packets, annotations = files
    assert D.packet_rejects(packets).count() == 0 and D.binding_rejects(annotations, packets).count() == 0
    broken = packets.withColumn("taskId", F.lit("no spaces allowed")).withColumn("taskVersion", F.lit(0)).withColumn("parserPredictionsExcluded", F.lit(False))
    broken = broken.withColumn("sentences", F.concat("sentences", "sentences"))
    assert {r.reason for r in D.packet_rejects(broken).collect()} == {"identity", "predictions-visible", "repeated-sentence"}
    renumbered = packets.withColumn("sentences", F.transform("sentences", lambda s: s.withField("tokens", F.reverse(s["tokens"]))))
    assert {r.reason for r in D.packet_rejects(renumbered).collect()} == {"token-numbering"}
    assert {r.reason for r in D.binding_rejects(annotations, broken).collect()} == {"identity", "packet-changed", "coverage"}
    stray = annotations.withColumn("packetId", F.lit("other")).withColumn("annotatorSlot", F.lit("J1"))
    assert {r.reason for r in D.binding_rejects(stray, packets).collect()} >= {"no-packet", "slot"}


def test_adjudication_and_ratification_roots(spark):
    decision = spark.createDataFrame([], S.ADJUDICATION).select(D.adjudication_root().alias("root"))
    assert decision.columns == ["root"] and decision.count() == 0
    row = {c: c for c in RATIFICATION_ORDER} | {"taskVersion": 3, "reviewerIsHuman": True}
    values = ["demo-ratification-root-v1", "demo-ratification-v1", *[row[c] for c in RATIFICATION_ORDER], "because"]
    frame = spark.createDataFrame([{**row, "schema": "demo-ratification-v1", "rationale": "  because "}])
    assert frame.select(D.ratification_root()).first()[0] == digest(values)


def test_dimensions_without_pairs(spark):
    paired = spark.createDataFrame([("x", "1", "1"), ("x", "1", "2")], "dimension string, a string, b string")
    got = {r.dimension: (r.n, r.disagreements, r.raw, r.kappa) for r in A.agreement(paired, dimensions=("x", "y")).collect()}
    assert got["x"][:3] == (2, 1, 0.5) and got["y"] == (0, 0, 1.0, None)
    assert A.macro(A.agreement(paired, dimensions=("x", "y"))).first().macro_raw == 0.75


def test_program_sources(spark, tmp_path):
    (tmp_path / "x.src").write_text("اتجاهُ النصِّ: RTL\n# note\n\n clause fil \"كتبَ\" # end\n")
    lines = [tuple(r) for r in S.program_lines(spark, str(tmp_path)).collect()]
    assert lines == [("x.src", 1, "اتجاهُ النصِّ: RTL"), ("x.src", 4, 'clause fil "كتبَ"')]


def test_sql_dump(spark, tmp_path):
    (tmp_path / "dump.sql").write_text("create table t(id INTEGER, name TEXT); insert into t values (1, 'a'), (2, null);")
    got = dumps.table(dumps.statements(spark, str(tmp_path)), "t", "id long, name string")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a"), (2, None)]
