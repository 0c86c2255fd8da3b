import hashlib
import random
import zlib

from pyspark.sql import functions as F

from attestia.llm import queries, wordruns


def brute(words, least=12):
    """Runs by their definition: for each period, stretches of words equal to those a period on; the least period of each stays."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        at = 0
        while at + p < len(words):
            end = at
            while end + p < len(words) and words[end] == words[end + p]:
                end += 1
            if end > at and end + p - at >= max(least, 2 * p):
                found.setdefault((at, end + p - at), p)
            at = end + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def digests(doc_id, words):
    runs = sorted(brute(words), key=lambda x: (x[0], x[2]))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def drawn(rng):
    words = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.choice([0, 1, 2, 5, 12, 30, 80, 200]))]
    if len(words) > 20 and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = 1 + rng.randrange(max(1, (len(words) - a) // 2))
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_runs_of_many_texts_against_the_definition():
    rng = random.Random(4)
    for _ in range(150):
        docs = [drawn(rng) for _ in range(rng.randint(1, 6))]
        for least in (12, 2):
            owner, *runs = (x.tolist() for x in wordruns.maximal_runs(docs, least))
            got = [[r for o, *r in zip(owner, *runs, strict=True) if o == i] for i in range(len(docs))]
            assert [sorted(map(tuple, g)) for g in got] == [brute(d, least) for d in docs]


def test_long_periodic_texts_take_one_completion_for_each_run():
    for words, want in (([b"a"] * 200_000, (0, 200_000, 1)), ([b"a", b"b", b"a"] * 50_000, (0, 150_000, 3))):
        owner, start, length, period = wordruns.maximal_runs([[b"x"], words])
        assert list(zip(owner, start, length, period, strict=True)) == [(1, *want)]
    short, long = [b"a"], [b"a", b"b"]
    while len(long) < 3_000:  # Fibonacci words have as many runs as any
        short, long = long, long + short
    _, *runs = wordruns.maximal_runs([long], 2)
    assert sorted(zip(*(x.tolist() for x in runs), strict=True)) == brute(long, 2)


def test_query_shapes_nulls_spaces_and_repeats(spark):
    texts = {
        1: "a b " * 10,
        2: None,
        3: "",
        4: " \t\n",
        5: "one\ttwo\nthree\rone\x0btwo\x0cthree one two three one two three end",
        6: "x" * 100_000,
        7: "a " * 11,
        8: "  ".join(["é"] * 14),  # a no-break space is part of a word
        None: "z " * 12,
    }
    rows = [(i, t, "n", "s", 0) for i, t in texts.items()] + [(1, texts[1], "n", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start string, _text long")
    got = sorted((tuple(r) for r in wordruns.runs(docs, digest=True).collect()), key=str)
    assert got == sorted((digests(i, (t or "").encode().split()) for i, t, *_ in rows), key=str)
    full = {r.doc_id: r for r in wordruns.runs(docs).collect()}
    assert full[5].collapsed == "one two three end" and full[5].runs[0].asDict() == {"start": 0, "length": 12, "period": 3}
    assert full[7].runs == [] and full[7].collapsed == texts[7].strip() and full[2].collapsed == ""
    assert wordruns.runs(docs.filter("doc_id > 99")).count() == 0


def test_registered_query_repeats_words_as_its_contract_says(spark):
    rng = random.Random(9)
    texts = [(i, b" ".join(drawn(rng)).decode()) for i in range(120)] + [(500, None), (501, ""), (None, "q " * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r) for r in wordruns.runs(queries.periodic(docs), digest=True).collect()), key=str)
    want = []
    for i, text in texts:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        want.append(digests(i, words))
    assert got == sorted(want, key=str)
    assert queries.periodic(docs.withColumn("_w", F.lit(1))).columns == ["doc_id", "text"]
