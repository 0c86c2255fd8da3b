import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestia.llm import suffixdedup as S


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=200))
def test_suffix_array_and_prefixes(values):
    text = np.array([*values, 0], np.int16)
    order = S.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    common = S.common_prefixes(text, order, np.array([0]), np.array([len(values)]), 1 << 20)
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while a + n < len(values) and b + n < len(values) and values[a + n] == values[b + n]:
            n += 1
        assert b == len(values) or common[b] == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=120), st.integers(1, 40))
def test_leftmost_least(values, width):
    width = min(width, len(values))
    got = S.leftmost_least(np.array(values, np.uint64), width).tolist()
    assert got == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


def brute(rows, length=S.LENGTH):
    docs = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (-1 if r[0] is None else r[0]))
    seen, out = set(), []
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, first int, body string")
    got = sorted(map(tuple, S.dedup(docs, digest=True).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def varied(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdé\0", k=r.randint(1, 9))) for _ in range(500)]
    passages = [" ".join(r.choices(vocabulary, k=k)) for k in (12, 18, 20, 25, 60, 300)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 3)
                p = p[a : len(p) - r.randint(0, len(p) // 3)]
                if r.random() < 0.3:
                    k = r.randrange(len(p))
                    p = p[:k] + "#" + p[k + 1 :]
                parts.append(p)
            else:
                parts.append(" ".join(r.choices(vocabulary, k=r.randint(1, 40))))
        rows.append((r.randrange(10**9), " ".join(parts)))
    rows += [(i + 10**9, rows[i][1]) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, varied(seed, 150))


def test_hot_anchors_are_merged_by_binary_search(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 7)
    check(spark, varied(3, 150))


def test_a_hot_anchor_takes_more_shards_once_they_are_full(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "SHARDS", 2)
    monkeypatch.setattr(S, "MOST", 4)
    check(spark, varied(4, 60))


def test_segments_of_long_texts_and_periods(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 500)
    monkeypatch.setattr(S, "SLICE", 900)
    r = random.Random(9)
    noise = "".join(r.choices("xyz ", k=3000))
    check(spark, [(1, noise), (2, noise[700:2900]), (3, "a" * 1500), (4, "ab" * 400 + "c"), (5, noise[:99]), (6, noise[:100]), (7, "ab" * 60)])


def test_nulls_and_empty_tables(spark):
    t = "".join(random.Random(2).choices("abcdefgh", k=300))
    check(spark, [(1, None), (2, ""), (3, t), (None, t), (5, t[:100]), (6, t[:99])])
    check(spark, [])


def test_rows_that_share_an_id(spark):
    t = "".join(random.Random(3).choices("abcdefgh", k=300))
    docs = spark.createDataFrame([(1, t), (1, t), (1, t + "!"), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.dedup(docs).collect())
    assert got[-1] == (2, 300, 300)
    assert [g[:2] for g in got] == [(1, 300), (1, 300), (1, 301), (2, 300)]
    assert got[0][2] == got[1][2] and sorted((got[0][2], got[2][2])) == [0, 300]


def test_bins_take_all_bits_of_an_anchor():
    anchors = np.random.default_rng(1).integers(0, 1 << 63, 400_000, np.uint64)
    for bins in (12, 1_600_000, 1 << 31):
        used = S.bins_of(anchors, bins)
        assert used.min() >= 0 and used.max() < bins
        assert len(np.unique(used)) > 0.8 * bins * (1 - np.exp(-len(anchors) / bins))
    assert len(np.unique(S.bins_of(np.arange(100_000, dtype=np.uint64) << np.uint64(20), 1 << 20))) > 90_000
