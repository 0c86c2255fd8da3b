import random

import numpy as np
import pytest

from attestia.llm import hashing, ngramjoin
from attestia.llm.components import components


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(a), None if i is None else root(i)) for i, a in sets), key=str)


def check(spark, rows, n=3, num=90, den=100):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, side string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(docs, n, num, den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def varied(seed, count):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéf", k=r.randint(1, 6))) for _ in range(300)]
    passage = r.choices(vocabulary, k=60)
    bases = [r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 9, 20, 60, 200])) for _ in range(14)]
    rows = []
    for i in range(count):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [r.choice(vocabulary).upper()] * r.randint(0, 2)
            w = w or ["x"]
        if r.random() < 0.3:
            w = w[:30] + passage
        rows.append((r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(w)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_against_brute_force(spark, n, num, den):
    check(spark, varied(n, 350), n, num, den)


def test_large_cluster_goes_through_blocks(spark, monkeypatch):
    for name, value in (("CLUSTER_DOCS", 10), ("BLOCK_DOCS", 8)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(1)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_large_clusters_are_grouped_again_by_rare_shingles(spark, monkeypatch):
    """Documents around one passage chain together, but few are similar."""
    for name, value in (("CLUSTER_DOCS", 5), ("BLOCK_DOCS", 4)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = [f"u{r.random()}" for _ in range(r.choice([2, 6, 12]))] + passage
        rows.append((3 * i, " ".join(w)))
        if i % 4 == 0:
            rows.append((3 * i + 1, " ".join(w[:-1])))
            rows.append((3 * i + 2, " ".join(w[1:])))
    check(spark, rows, 5, 8, 10)
    check(spark, varied(11, 250), 5, 8, 10)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (9, "a b c d"), (2, "A b C d"), (7, "a"), (1, "a"), (8, "a b"), (None, "a b c d"), (11, "x " * 20000), (12, "x " * 30000)]
    check(spark, rows)
    check(spark, [])


def test_rows_that_share_an_id_are_one_node(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "k l m"), (7, "k l m"), (3, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngramjoin.join(docs, 3, 9, 10).collect()} == {(5, 3), (7, 3), (3, 3)}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10)])
def test_every_link_shares_a_signature(num, den):
    r = np.random.default_rng(2)
    for size in [1, 2, 5, 8, 9, 10, 11, 15, 19, 30, 47, 100, 333]:
        for _ in range(30):
            a = r.integers(0, 1 << 62, size).astype(np.uint64)
            b = a.copy()
            while True:  # as far from a as a link may be
                c = b.copy()
                c = np.append(c[r.permutation(len(c))[: max(1, len(c) - r.integers(0, 2))]], r.integers(0, 1 << 62, r.integers(0, 2)).astype(np.uint64))
                both = len(np.intersect1d(a, c))
                if den * both < num * len(np.union1d(a, c)) or len(c) == len(b) and r.random() < 0.02:
                    break
                b = np.unique(c)
            sig, owner = ngramjoin.signatures([np.unique(a), np.unique(b)], num, den)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 3000) if i % 50] + [(5000, 6000 + i) for i in range(500)] + [(r.randrange(7000, 9000), r.randrange(7000, 9000)) for _ in range(900)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    from attestia.llm import components as c

    for small in (10_000, 40):
        c_small, c.SMALL = c.SMALL, small
        try:
            assert {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
        finally:
            c.SMALL = c_small


def test_words_are_split_at_ascii_space_only():
    texts = ["A b c\x0bd e", None, "", "É é"]
    _, counts = hashing.word_hashes([None if t is None else t.encode() for t in texts])
    assert counts.tolist() == [3, 0, 0, 2]


def test_a_large_cluster_with_few_apart(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CLUSTER_DOCS", 20)
    monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", 8)
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdef", k=5)) for _ in range(500)]
    base = r.choices(vocabulary, k=120)
    rows = []
    for i in range(150):  # near copies of one text
        w = list(base)
        w[r.randrange(120)] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(150, 190):  # a chain that drifts away from it
        w[3 * (i - 150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(r.choices(vocabulary, k=40) + base[:60])) for i in range(30)]  # share only a passage
    check(spark, rows, 3, 90, 100)
    check(spark, rows, 5, 8, 10)
