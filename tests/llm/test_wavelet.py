import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from attestia.llm import bpe, wavelet  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
WORDS = wavelet.WordIds(open(PATH).read(), P.PATTERN)
ODD = "".join(map(chr, [*range(0, 0x30), 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B])) + "aéß中あ٣²ⅷ👍🏽'sll"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 999), max_size=700))
def test_matrix_operations(values):
    ids = np.array(values, np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 10)
    assert m.all().tolist() == values
    if values:
        assert m.access(np.arange(len(values))).tolist() == values
    for token in {*values[:5], 3, 999, 5000}:
        where = [i for i, v in enumerate(values) if v == token]
        assert m.count(token) == len(where) and m.occurrences(token).tolist() == where
        assert m.rank(token, len(values) // 2) == sum(i < len(values) // 2 for i in where)
        if where:
            assert m.select(token, len(where) - 1) == where[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ODD, max_size=30))
def test_words_as_the_whole_text(text):
    coded = np.frombuffer(WORDS.encode([text])[0], WORDS.kind).tolist()
    assert coded == LIBRARY.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_the_library_has_them():
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x<|endoftext|>", "a<|endoftext|"]
    coded = [np.frombuffer(c, WORDS.kind).tolist() for c in WORDS.encode(texts)]
    assert coded == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in coded[0]
    plain = wavelet.WordIds(open(PATH).read(), P.PATTERN, ordinary=True)
    other = tokenizers.Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    assert [np.frombuffer(c, plain.kind).tolist() for c in plain.encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_doc_id_with_half_of_all_rows(spark):
    rows = [(7 if i % 2 else i, f"text {i} " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = wavelet.write_shards(docs, PATH)
    assert shards.agg({"n_docs": "max"}).first()[0] < 200  # the rows of one id are dealt over partitions
    got = sorted(map(tuple, wavelet.documents(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    want = sorted((i, zlib.crc32(np.array(LIBRARY.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in rows)
    assert sorted((r[0], r[3]) for r in got) == want


def test_pattern_is_the_vocabulary_s():
    assert P.PATTERN == bpe.GENERAL_PATTERN


def test_operator(spark):
    texts = ["Hello world", None, "", "a <|endoftext|> b", "Éaux " * 2000, "Hello world"]
    rows = [(7 * i % 6, t, "x") for i, t in enumerate(texts)] + [(2, "again", "x"), (None, "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    shards = wavelet.write_shards(docs, PATH, shard_ids=1500)
    got = wavelet.documents(shards).collect()
    start, by_hash = 0, {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    want = []
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], by_hash[r[1]])):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert any(50256 in LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts)
    assert shards.count() > 1
    assert wavelet.documents(wavelet.write_shards(docs.limit(0), PATH)).count() == 0
