import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from attestia.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = tokencount.pieces_of(PATH)


def told(texts):
    return [len(LIBRARY.encode(x)) if x else 0 for x in texts]


def drawn(rng):
    letters = "ab ▁\nétheinr=.0,中文😀　"
    return "".join(rng.choice(letters[: rng.randint(2, len(letters))]) for _ in range(rng.choice([0, 1, 5, 50, 300, 700, 3000])))


HARD = ["a" * n for n in (1, 255, 256, 257, 5000)] + [" " * n for n in (1, 15, 16, 17, 255, 256, 1000)]
HARD += ["in" * 900, "the" * 1000, "=" * 3000, "ab " * 200 + "x" * 1000 + " cd" * 300, "international" * 400, "\x00" * 300, "▁" * 40]
HARD += ["<s> </s> <unk> <0x41>", "a\r\nb\tc", "é" * 200, "中" * 1000, "😀" * 300]


def test_counts_are_the_library_s(monkeypatch):
    rng = random.Random(2)
    texts = [drawn(rng) for _ in range(250)] + HARD
    machine = tokencount.Transducer(PIECES)
    assert machine.count(texts).tolist() == told(texts)
    monkeypatch.setattr(tokencount, "CHUNK", 7)  # most chunks begin within a word
    assert machine.count(texts).tolist() == told(texts)
    monkeypatch.setattr(tokencount, "WARM_UP", 1)  # and most guesses of their states are wrong
    assert machine.count(texts).tolist() == told(texts)


def test_wrong_guesses_are_found_and_mended(monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", 5)
    monkeypatch.setattr(tokencount, "WARM_UP", 0)
    machine, seen = tokencount.Transducer(PIECES), []
    extended = tokencount.StateMaps.extended
    monkeypatch.setattr(tokencount.StateMaps, "extended", lambda self, *a: (seen.append(len(a[0])), extended(self, *a))[1])
    texts = ["internationalrepresentations" * 20, "x", "aaaaaaaaa" * 9]
    assert machine.count(texts).tolist() == told(texts)
    assert seen  # the scan met states that the maps lacked


def test_transitions_are_dropped_without_effect(monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_TRANSITIONS", 50)
    machine = tokencount.Transducer(PIECES)
    for x in HARD:
        assert machine.count([x]).tolist() == told([x])


def test_composition_is_associative_and_keeps_unknown_states_apart():
    constant = np.array([True, False, False])
    maps = tokencount.StateMaps(constant, np.array([[0, -1], [3, 4], [5, 6]]), np.array([[3, -1], [5, 9], [7, 8]]), np.array([[1, 0], [10, 20], [100, 200]]))
    done = tokencount.scan(maps, np.zeros(3, np.int64))
    assert done.ends[:, 0].tolist() == [3, 5, 7] and done.counts[:, 0].tolist() == [1, 11, 111]
    maps.ends[0, 0] = 4  # then the last chunk is reached in state 9, which its map lacks
    assert tokencount.scan(maps, np.zeros(3, np.int64)).ends[:, 0].tolist() == [4, 9, -1]


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(tokencount, "PROBES", ("  a",))
    monkeypatch.setattr(tokencount.Transducer, "count", lambda self, texts: np.zeros(1, np.int64))
    with pytest.raises(ValueError, match="not a BPE model"):
        tokencount.pieces_of(PATH)


def test_operator_on_nulls_empty_long_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é\n"), (5, "word " * 5000), (6, "z" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("_text", F.lit(1))
    found = tokencount.count(docs, PATH, limit=5000)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 5000) for (i, t), n in zip(rows, told([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert tokencount.count(docs.filter("doc_id > 99"), PATH).count() == 0
