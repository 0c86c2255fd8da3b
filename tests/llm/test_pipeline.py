"""The pipeline against a brute-force version over a small fixture, stage by stage."""

import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from attestia.llm import bpe, langid  # noqa: E402
from tests.llm import test_langid, test_linededup, test_mixing, test_ngramjoin  # noqa: E402


def fixture():
    r = random.Random(12)
    rows = []
    for i in range(160):
        lang = r.choice(["en", "fr", "de"])
        rows.append([i, "\n".join(test_langid.text(lang, r.randint(6, 30), r) for _ in range(r.randint(1, 5))), lang, r.choice(["a", "b", None]), 0])
    for i in range(160, 200):
        base = rows[r.randrange(160)]
        t = base[1].replace("\n", " ")
        rows.append([i, t if r.random() < 0.5 else t + " " + test_langid.text(base[2], 1, r), base[2], "b", 0])
    rows += [[300, None, "en", "a", 0], [301, "", None, "a", 0], [302, "12 34", "en", "c", 0]]
    return rows


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(fixture(), schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{n}"))
        seen.append(docs.collect())
        after = spark.read.parquet(str(tmp_path / f"stage{n}"))
        if n < 4:
            assert after.columns == docs.columns, name
        docs = after
    seen.append(docs.collect())

    model = langid.model_of(spark.createDataFrame(seen[0], schema))
    told = {r.doc_id: r for r in langid.predict(spark.createDataFrame(seen[0], schema), model).collect()}
    assert {r.doc_id for r in seen[1]} == {i for i, r in told.items() if r.lang_pred != "und" and r.score * r.known >= 0.3}
    assert {300, 301, 302} & {r.doc_id for r in seen[1]} == set()

    assert {r.doc_id: r.text for r in seen[2]} == test_linededup.brute_runs([(r.doc_id, r.text) for r in seen[1]])
    assert all(r.n_chars == len(r.text) for r in seen[2])

    groups = test_ngramjoin.brute([(r.doc_id, r.text) for r in seen[2]], 5, 8, 10)
    kept = {i for i, _, c in groups if i == c}
    assert {r.doc_id for r in seen[3]} == kept and len(kept) < len(seen[2])

    sizes = [(r.doc_id, r.source, len(r.text.split())) for r in seen[3]]
    taken, _ = test_mixing.brute(sizes)
    words = {}
    for r in seen[4]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    digest = lambda t: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in seen[5]) == sorted((r.doc_id, digest(r.text)) for r in seen[4])

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[5]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node int, gone boolean"


def odd_rows():
    r = random.Random(3)
    a, b, c, d = (test_langid.text("en", 40, r) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " the"), (None, c), (None, c), (3, c), (None, d), (4, None), (5, ""), (6, test_langid.text("en", 30_000, r))]
    rows += [(10 + i, test_langid.text("en", 30, r)) for i in range(40)]
    return [(i, t, "en", "s", 0, "x", 7, True) for i, t in rows], (a, b, c, d)


def test_rows_that_repeat_ids_or_have_none(spark):
    rows, (a, b, c, d) = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((str(x.doc_id), x.text) for x in left if x.doc_id in (1, 2, 3) or x.doc_id is None) == sorted([("1", a), ("1", b), ("3", c), ("None", d)])
    assert {4, 5, 6} <= {x.doc_id for x in left} and len(left) == len(rows) - 4


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    rows, _ = odd_rows()
    for n, docs in enumerate([spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)]):
        docs.write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, "").write.parquet(str(tmp_path / f"{n}" / f"stage{k}"))
            after = spark.read.parquet(str(tmp_path / f"{n}" / f"stage{k}"))
            assert k == 4 or after.columns == docs.columns, name
            docs = after
        assert (docs.count() > 30) == (n == 0)
