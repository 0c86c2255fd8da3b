import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from attestia.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = bpe.Splitter(P.PATTERN)
ODD = "".join(map(chr, [*range(0, 0x30), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF])) + "aéß中あ٣²ⅷ👍🏽'sll"


def ids(text):
    return [i for w in SPLIT(text) for i in bpe.fold(w.encode(), RANKS)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=40), st.text(max_size=40)))
def test_as_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_words():
    for word in ("a" * 5000, "abcdefg" * 300, "é中" * 400, "thethe" * 100 + "!" * 600, "=" * 3000):
        assert ids(word) == LIBRARY.encode_ordinary(word)


def test_operator(spark):
    texts = [None, "", "Hello world", "<|endoftext|> it's  \n\n x", "Éa " * 3000, "Hello world"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    plain = sorted(bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect())
    told = sorted(bpe.encode(docs, PATH, P.PATTERN, digest=True).collect())
    for t, a, b in zip(texts, plain, told, strict=True):
        want = LIBRARY.encode_ordinary(t or "")
        assert a.ids == want and bytes(a.decoded).decode() == (t or "")
        assert b.n_tokens == len(want)
        assert b.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert b.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_native_fold_of_distinct_words(spark):
    words = ["", " the", "onthonea", " Thstinnt", "éaux", "a" * 9, "中文", " zz!?qj"]
    frame = spark.createDataFrame([(w,) for w in words], "text string").withColumn("word", F.encode("text", "utf-8"))
    for r in bpe.fold_words(frame, PATH).collect():
        assert r.ids == [i for i in bpe.fold(r.text.encode(), RANKS)], r.text
