import random

from hypothesis import given, settings
from hypothesis import strategies as st

from attestia.llm import linededup as L


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_alignment_is_common_and_ascending(a, b):
    found = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_alignment_of_equal_and_moved_lines():
    a = list(range(50))
    assert L.patience(a, a) == [(i, i) for i in a]
    b = [100, *a[:20], 101, *a[20:]]
    assert [i for i, _ in L.patience(a, b)] == a
    assert len(L.patience(a, a[25:] + a[:25])) == 25


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))


def brute_runs(rows, block_words=L.BLOCK_WORDS):
    """(doc_id, text) -> text without the lines in any run of enough words that any earlier document has, by comparing all pairs."""
    docs = sorted((i, t.split("\n")) for i, t in rows if i is not None and t is not None)
    out = {}
    for i, lines in docs:
        mine, count, gone = [x.strip() for x in lines], [len(x.split()) for x in lines], set()
        for j, other in docs:
            theirs = [x.strip() for x in other]
            for a in range(len(mine) if j < i else 0):
                for b in range(len(theirs)):
                    k = 0
                    while a + k < len(mine) and b + k < len(theirs) and mine[a + k] == theirs[b + k]:
                        k += 1
                    if sum(count[a : a + k]) >= block_words:
                        gone |= set(range(a, a + k))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    pool = [words(r.choice([1, 3, 6, 12, 30]), k) for k in range(40)] + [""]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 12)))) for i in range(120)]
    shared = "\n".join(pool[:8])
    rows += [(200 + i, words(8, 900 + i) + "\n" + shared + "\n" + words(8, 999 + i)) for i in range(60)]
    rows += [(300, ""), (301, None), (302, "\n\n")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, keep string, me int")
    got = {x.doc_id: x for x in L.dedup(docs, count=True).collect()}
    want = brute_runs(rows)
    assert {i: x.text for i, x in got.items() if i in want} == want
    assert got[301].text is None and got[301].n_lines == 0 and got[300].text == ""
    assert sum(x.n_removed > 0 for x in got.values()) > 50
    assert L.dedup(docs).columns == docs.columns
    clash = L.dedup(docs.withColumnRenamed("me", "n_lines"), count=True)
    assert sorted(clash.columns) == ["doc_id", "keep", "n_lines", "n_removed", "text"]


def test_repeats_nulls_and_empty_tables(spark):
    a, b = words(20, 1), words(20, 2)
    rows = [(1, a + "\n" + b), (2, a), (2, a), (2, b + "\nother"), (None, a), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.text or "") for x in L.dedup(docs).collect())
    assert got == [(False, 0, a), (True, 1, a + "\n" + b), (True, 2, ""), (True, 2, ""), (True, 2, "other"), (True, 3, "")]
    assert L.dedup(docs.limit(0)).count() == 0


def test_blocks_name_their_partner(spark):
    x, y, z, u = (words(15, k) for k in (103, 104, 105, 106))
    rows = [(1, "\n".join([x, "gap", y, z])), (2, "\n".join([z, "own", x, "more", y])), (3, "\n".join([u, x])), (4, "\n".join([x, u]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: sorted((b.start, b.end, b.of, b.of_start, b.moved) for b in r.blocks) for r in L.common_blocks(docs).collect()}
    assert set(got) == {2, 3, 4}
    assert [b[:4] for b in got[2]] == [(0, 1, 1, 3), (2, 3, 1, 0), (4, 5, 1, 2)]
    assert [b[4] for b in got[2]] == [True, False, False]  # x and y keep their order, z is moved
    assert [b[:4] for b in got[4]] == [(0, 1, 1, 0), (1, 2, 3, 0)]  # two partners


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 3), st.integers(0, 20)), max_size=30))
def test_every_shared_run_lies_in_a_block(found):
    runs = [(s, s + n, f) for s, n, f in set(found)]
    blocks = L.aligned(runs)
    assert all(any(a <= s and e <= b and f - s == g - a for a, b, g, _ in blocks) for s, e, f in runs)
    assert {i for a, b, _, _ in blocks for i in range(a, b)} == {i for s, e, _ in runs for i in range(s, e)}
    order = [(a, g) for a, _, g, moved in blocks if not moved]
    assert order == sorted(order) and sorted(g for _, g in order) == [g for _, g in order]


def test_only_alignment_finds_blocks(spark, monkeypatch):
    r = random.Random(3)
    pool = [words(12, k) for k in range(30)]
    rows = [(i, "\n".join(r.choices(pool, k=8))) for i in range(40)]
    pairs = [[(s, s + 1, r.randrange(20)) for s in range(20)] for _ in range(50)]
    assert all({i for a, b, *_ in L.aligned(p) for i in range(a, b)} == set(range(20)) for p in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d.doc_id: d.text for d in L.dedup(docs).collect()} == brute_runs(rows)
    whole = L.patience
    monkeypatch.setattr(L, "patience", lambda a, b: [])
    assert all(L.aligned(p) == [] for p in pairs)  # nothing else removes a line
    monkeypatch.setattr(L, "patience", lambda a, b: whole(a, b) if list(b) == sorted(b) else [])
    assert any({i for a, b, *_ in L.aligned(p) for i in range(a, b)} < set(range(20)) for p in pairs)


def test_moved_and_repeated_runs_take_few_alignments(monkeypatch):
    calls, whole = [], L.patience
    monkeypatch.setattr(L, "patience", lambda a, b: (calls.append(1), whole(a, b))[1])
    n = 3000
    for runs, most in (
        ([(i, i + 1, n - i) for i in range(n)], 4),  # lines in reverse
        ([(i, i + 1, 7) for i in range(n)], 3),  # a line that repeats
        ([(i, i + 1, f) for i, f in enumerate(random.Random(1).sample(range(n), n))], 6 * int(n**0.5)),
    ):
        calls.clear()
        assert {i for a, b, *_ in L.aligned(runs) for i in range(a, b)} == set(range(n)) and len(calls) <= most


def test_line_ends_and_tabs_do_not_tell_lines_apart(spark):
    a, b = words(12, 1), words(15, 2)
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\r\n{b}\r"), (3, f"\t{a}\u00a0\n own \n  {b}\t"), (4, f"x{a}\n{b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d.doc_id: d.text for d in L.dedup(docs).collect()} == {1: rows[0][1], 2: "", 3: " own ", 4: "x" + a}


def test_a_document_of_many_lines(spark):
    lines = [words(11, k) for k in range(3000)]
    long = "\n".join(lines[k % 3000] + ("" if k < 3000 else " x") for k in range(100_000))
    rows = [(k, lines[k]) for k in range(3000)] + [(9000, long), (9001, "own\n" + long)]
    got = {x.doc_id: x for x in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), count=True).collect()}
    assert got[9000].n_lines == 100_000 and got[9000].n_removed == 3000  # each with a first holder of its own
    assert got[9001].text == "own" and got[9001].n_removed == 100_000


def test_scripts_without_spaces(spark):
    line = "今日は天気がとても良いので散歩に出かけました"
    docs = spark.createDataFrame([(1, line + "\n終"), (2, "別\n" + line), (3, "短い")], "doc_id long, text string")
    assert {d.doc_id: d.text for d in L.dedup(docs).collect()} == {1: line + "\n終", 2: "別", 3: "短い"}


def test_every_earlier_holder_counts(spark):
    r = random.Random(7)
    pool = [words(r.choice([0, 1, 3, 4, 6, 12]), k) for k in range(30)]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 14)))) for i in range(90)]
    p, q, x = words(6, 101), words(6, 102), words(15, 103)
    y, z = words(15, 104), words(15, 105)
    rows += [(200, p + "\n" + words(4, 110)), (201, q + "\n" + words(4, 111)), (202, words(4, 112) + "\n" + p + "\n" + q), (203, p + "\n" + q + "\nown")]
    rows += [(210, "\n".join([x, y, z])), (211, "\n".join([z, "own", x, "more", y])), (300, ""), (301, None), (302, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {d.doc_id: d.text for d in L.dedup(docs).collect()}
    want = brute_runs(rows)
    assert {i: t for i, t in got.items() if i in want} == want and got[301] is None
    assert got[202] == rows[92][1] and got[203] == "own"  # only 202, no first holder of a line, has both
    assert got[211] == "own\nmore"
    again = spark.createDataFrame([(1, x + "\n" + y), (2, x), (2, x), (2, y + "\nother"), (None, x)], "doc_id long, text string")
    assert sorted((d.doc_id or 0, d.text) for d in L.dedup(again).collect()) == [(0, x), (1, x + "\n" + y), (2, ""), (2, ""), (2, "other")]
    assert L.dedup(docs.limit(0)).count() == 0


def test_repeated_passages_align(spark):
    assert L.patience(list("aPbPc"), list("Pk")) == [(1, 0)]
    assert L.patience(list("xPy"), list("PkP")) == [(1, 0)]
    assert L.patience(list("aPbPc"), list("kPlPm")) == [(1, 1), (3, 3)]
    p = words(60, 1)
    rows = [(1, p + "\nk"), (2, f"a\n{p}\nb\n{p}\nc"), (3, f"{p}\nd\n{p}"), (4, f"e\n{p}\nf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d.doc_id: d.text for d in L.dedup(docs).collect()} == {1: rows[0][1], 2: "a\nb\nc", 3: "d", 4: "e\nf"}


def test_runs_of_short_lines_link(spark):
    verse = "\n".join(words(1, 500 + k) for k in range(12))
    docs = spark.createDataFrame([(1, verse), (2, "own\n" + verse)], "doc_id long, text string")
    assert {d.doc_id: d.text for d in L.dedup(docs).collect()} == {1: verse, 2: "own"}
