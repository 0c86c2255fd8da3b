import hashlib
import hmac
import random

from pyspark.sql import functions as F

from attestia.functions import hashing as H
from attestia.functions import text as T
from attestia.operators import consensus as C
from attestia.operators import queues as Q
from attestia.operators import relational as R
from attestia.plans import catalogue
from attestia.sources import manifests
from attestia.streaming import machine
from attestia.streaming.admission import Admission


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.surface_key(lit(" Fa_El- مرفوعٌ")), T.json_key(lit("Fi'l _x ء"))) == ("fael مرفوع", "filx")
    assert one(spark, T.parse_integer(lit("−١٢٣")), T.parse_integer(lit("۴۵")), T.parse_integer(lit("1x")), T.parse_integer(lit("9" * 30))) == (-123, 45, None, None)
    assert one(spark, T.tokens_quoted(lit('a "b c" d')), T.tokens_quoted(lit('a "b'))) == (["a", '"b c"', "d"], None)
    assert one(spark, T.strip_comment(lit('x "a # b"')), T.strip_quoted(lit('x "a b" y'))) == ('x "a ', 'x "" y')
    assert one(spark, T.placeholders(lit("{ a } and {b}")), T.render_template(lit("{a}{b}{a}"), {"a": lit("$1"), "b": lit("{c}")})) == (["a", "b"], "$1{c}$1")
    assert one(spark, T.excerpt(lit(" a \n\t b  c "), 3), T.excerpt(lit(None))) == ("a b", "")
    assert one(spark, T.table_cell(lit("a|b\r\n<c>@d")), T.table_cell(lit(""))) == ("a&#124;b<br>&lt;c&gt;@​d", "—")
    assert one(spark, T.base64url(lit("??>>ü")), T.normalise_email(lit("  ＡB@Ex.ORG ")), T.normalise_email(lit("x@y"))) == ("Pz8-PsO8", "ab@ex.org", None)
    flags = T.unsafe_flags(lit("call +49 123 4567 or <b>"))
    assert one(spark, *[flags[k] for k in ("email", "phone", "raw_html", "control")]) == (False, True, True, False)


def test_hashes(spark):
    want = hashlib.sha256("2:é-1:4:true".encode()).hexdigest()
    assert one(spark, H.canonical_hash(F.lit("é"), F.lit(None), F.lit(True)))[0] == want
    assert one(spark, H.hmac_sha256(F.lit("text"), b"k"), H.hmac_sha256(F.lit("text"), b"k" * 99)) == tuple(
        hmac.new(k, b"text", "sha256").hexdigest() for k in (b"k", b"k" * 99)
    )
    a, b, c = one(spark, *[H.canonical_json_hash(F.lit(x)) for x in ('{"b": [1, {"y": null, "x": "é"}], "a": 2}', '{"a":2,"b":[1,{"x":"é","y":null}]}', "{")])
    assert a == b == hashlib.sha256('{"a":2,"b":[1,{"x":"é","y":null}]}'.encode()).hexdigest() and c is None


def test_state_machine(spark):
    legal = [(a, b) for a, t in C.TRANSITIONS.items() for b in t]
    assert len(C.TRANSITIONS) == 11 and len(legal) == 23
    every = spark.createDataFrame([(a, b) for a in [*C.TRANSITIONS, None, "?"] for b in C.TRANSITIONS], "a string, b string")
    assert {tuple(r) for r in every.filter(C.legal(F.col("a"), F.col("b"))).collect()} == set(legal)
    events = spark.createDataFrame([("t", i, s) for i, s in enumerate(["open", "published", "independent-review", "failed", "open"])], "k string, i int, s string")
    assert tuple(C.apply_guarded(events, "k", "s", "draft", C.TRANSITIONS, "i").first()) == ("t", "failed", 3, 2)


def test_hash_chain(spark):
    rows = [("t", 1, "h1", None), ("t", 2, "h2", "h1"), ("t", 3, "h3", "hX"), ("u", 1, "g1", "g0")]
    broken = C.verify_chain(spark.createDataFrame(rows, "k string, i int, h string, p string"), "k", "h", "p", "i")
    assert {(r.k, r.i) for r in broken.collect()} == {("t", 3), ("u", 1)}


def test_retention_is_a_fold(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.randint(0, 400), r.choice([5, 20]), r.choice([None, None, 5, 20]), r.randint(0, 3), r.randint(0, 9), 0, i) for i in range(80)]
    frame = spark.createDataFrame(rows, "g string, id long, bytes long, expires_at long, lease_until long, generation long, sequence long, verified_at long, created_at long")
    got = {x.g: (x.kept, x.kept_bytes, x.kept_ids) for x in Q.retain(frame, "g", 10, 6, 1000).collect()}
    for g in "ab":
        ids, held = [], 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[5], -x[6], -x[7], -x[8], x[1])):
            leased = x[4] is not None and x[4] > 10
            if leased or x[3] > 10 and len(ids) < 6 and held + x[2] <= 1000:
                ids.append(x[1])
                held += x[2]
        assert got[g] == (len(ids), held, ids)


def test_upsert_and_sets(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "A", 2), (2, "B", 4), (3, "C", 0)], "id int, v string, n int")
    assert sorted(map(tuple, R.upsert(old, new, ["id"], F.col("new.n") > F.col("old.n")).collect())) == [(1, "A", 2), (2, "b", 5), (3, "C", 0)]
    assert tuple(R.same_rows(old, old.union(old.limit(1))).first()) == (0, 1, False)


def test_manifest(spark, tmp_path):
    for name, body in (("b.txt", b"two"), ("a.txt", b"one")):
        (tmp_path / name).write_bytes(body)
    got = manifests.root(manifests.files(spark, str(tmp_path))).first()
    lines = "".join(f"{hashlib.sha256(b).hexdigest()} {len(b)} {n}\n" for n, b in (("a.txt", b"one"), ("b.txt", b"two")))
    assert tuple(got) == (2, 6, hashlib.sha256(lines.encode()).hexdigest())


def test_chunks(spark):
    rows = spark.createDataFrame([(1, bytearray(b"x" * 25)), (2, bytearray())], "id int, body binary")
    parts = Q.chunks(rows.withColumnRenamed("body", "content"), "content", 10).collect()
    assert sorted((r.id, r.part, r.bytes) for r in parts) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]
    assert all(r.sha256 == hashlib.sha256(bytes(r.body)).hexdigest() for r in parts)


def test_stream_over_several_batches_equals_the_batch(spark, tmp_path):
    r = random.Random(1)
    steps = {"a": ("b",), "b": ("a", "c"), "c": ("a",)}
    rows = [(i, i // 40, r.randint(0, 5), r.choice("abc"), float(r.randint(0, 3))) for i in range(200)]
    frame = spark.createDataFrame(rows, "event_id long, day long, user_id long, event_type string, value double").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 60).cast("timestamp_ntz")
    )
    folder = tmp_path / "events.parquet"
    for d in range(5):  # one file for each day, in time order
        frame.filter(f"day = {d}").drop("day").coalesce(1).write.mode("append").parquet(str(folder))
    stream = machine.to_table(machine.machine(machine.source(spark, str(tmp_path), "events.parquet", 1), steps, "a"), "update")
    assert stream.select("batch").distinct().count() == 5
    last = stream.groupBy("user_id").agg(F.max_by(F.struct("state", "version", "rejected"), "batch").alias("r")).select("user_id", "r.*")
    batch = C.apply_guarded(frame, "user_id", "event_type", "a", steps, "ts", "event_id")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
    gate = Admission(spark, str(tmp_path / "gate"))
    keyed = frame.select(F.col("user_id").alias("entity"), F.concat_ws(":", "user_id", "event_type", "value").alias("key"), F.lit("").alias("payload"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), "day")
    machine.arrivals([keyed.filter(f"day = {d}").drop("day") for d in (3, 0, 1, 4, 2)], gate, str(tmp_path / "gate"))
    assert gate.accepted().count() == len({(u, t, v) for _, _, u, t, v in rows}) and gate.accepted().count() + gate.rejected().count() == len(rows)


def test_json_keys_and_times(spark):
    assert T.json_keys('{"A-b": [{"C": {"d_e": 1}}]}') == ["ab", "c", "de"] and T.json_keys("{") is None and T.json_keys("[1]") == []
    iso = T.iso_utc(F.lit(1_700_000_000_123))
    assert one(spark, iso, T.iso_millis(iso), T.iso_millis(F.lit("2024-01-01"))) == ("2023-11-14T22:13:20.123Z", 1_700_000_000_123, None)


def test_reasons_in_order(spark):
    rules = {"a": F.lit(None).cast("boolean"), "b": F.lit(True), "c": F.lit(True)}
    assert one(spark, C.first_reason(rules), C.first_reason({"a": F.lit(False)}), C.first_reason({})) == ("b", "eligible", "eligible")


def test_diacritics_go_from_whole_texts(spark, tmp_path):
    long = "be " * 400 + "end"
    spark.createDataFrame([(1, long), (2, "e"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.plain for r in catalogue.QUERIES["strip_diacritics"](spark, str(tmp_path)).collect()}
    assert got == {1: long, 2: "e", 3: None}


def test_manifest_tree_covers_every_document(spark, tmp_path):
    rows = [(i, f"text {i}", r) for i, r in enumerate(["en", "es", "fr", None] * 80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["manifest_tree"](spark, str(tmp_path)).first()
    leaves = {}
    for i, t, _ in rows:
        path = f"d/{i:09}"
        leaves.setdefault(hashlib.sha256(path.encode()).hexdigest()[:2], []).append(f"{hashlib.sha256(t.encode()).hexdigest()} {len(t)} {path}\n")
    digests = [hashlib.sha256("".join(x).encode()).hexdigest() for _, x in sorted(leaves.items())]
    assert tuple(got) == (320, sum(len(t) for _, t, _ in rows), hashlib.sha256("\n".join(digests).encode()).hexdigest())
