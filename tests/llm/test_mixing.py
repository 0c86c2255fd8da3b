import hashlib
import random

from pyspark.sql import functions as F

from attestia.llm import mixing


def brute(rows, pattern=(3, 1, 2), ratio=1.5, cap=2):
    """(doc_id, source, size) -> taken words, target, by one global queue."""
    key = lambda s: "t" if s is None else "s" + s
    sources = sorted({key(s) for _, s, _ in rows})
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(sources)}
    size = {s: sum(n for _, x, n in rows if key(x) == s) for s in sources}
    budget = ratio * sum(size.values())
    target, open_ = {}, set(sources)
    while True:  # the excess over twice a source's size is shared again by weight
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * size[s]]
        if not over:
            target |= share
            break
        target |= {s: float(cap * size[s]) for s in over}
        open_ -= set(over)
        if not open_:
            break
    queue = []
    for s in sources:
        served = 0
        for e in range(cap):
            mine = sorted((hashlib.md5(f"mix:{e}:{i}".encode()).hexdigest(), i, n) for i, x, n in rows if key(x) == s)
            for h, i, n in mine:
                served += n
                queue.append((served / weight[s], s, e, h, i, n))
    taken, spent = {}, 0
    for *_, i, n in sorted(queue):
        spent += n
        taken[i] = taken.get(i, 0) + (n if spent <= budget else 0)
    return taken, {i: target[key(s)] for i, s, _ in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, s, None if n is None else " ".join(["w"] * n), 7, "q") for i, s, n in rows], "doc_id long, source string, text string, size int, weight string")


def test_against_one_queue(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", "B", "é", None, "c9"]), r.choice([0, 1, 5, 40, 300])) for i in range(500)]
    got = mixing.taken_words(mixing.mix(frame(spark, rows), mixing.cyclic_weights((3, 1, 2)))).collect()
    taken, target = brute(rows)
    assert {x.doc_id: x.taken for x in got} == taken
    assert all(abs(x.target - target[x.doc_id]) < 1e-6 for x in got)
    assert all(x.taken <= 2 * x.size for x in got)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a", None), (1, "a", 4), (1, "a", 4), (None, None, 3), (2, None, 0)]
    docs = frame(spark, rows)
    manifest = mixing.mix(docs, mixing.cyclic_weights((1,)))
    assert sorted((x.doc_id or -1, x.size) for x in mixing.taken_words(manifest).collect()) == [(-1, 3), (1, 0), (1, 4), (1, 4), (2, 0)]
    assert mixing.take(docs, manifest).columns == docs.columns
    assert mixing.taken_words(mixing.mix(docs.limit(0), mixing.cyclic_weights((1,)))).count() == 0
    nothing = frame(spark, [(1, "a", 0), (2, "b", None)])
    assert mixing.taken_words(mixing.mix(nothing, mixing.cyclic_weights((1, 2)))).agg(F.sum("taken")).first()[0] == 0


def test_take_repeats_rows(spark):
    rows = [(i, "a" if i < 30 else "b", 10) for i in range(60)]
    docs = frame(spark, rows)
    manifest = mixing.mix(docs, mixing.cyclic_weights((3, 1)))
    words = {x.doc_id: x.taken for x in mixing.taken_words(manifest).collect()}
    copies = {x.doc_id: x["count"] for x in mixing.take(docs, manifest).groupBy("doc_id").count().collect()}
    assert copies == {i: n // 10 for i, n in words.items() if n}
    assert max(copies.values()) == 2


def test_the_order_of_the_input_does_not_matter(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, None, i]), r.choice(["a", "b"]), r.choice([0, 10, 30, 50])) for i in range(300)]
    rows += [(None, "a", n) for n in range(1, 200)]  # one key with many rows
    seen = []
    for _ in range(2):
        r.shuffle(rows)
        docs = frame(spark, rows).repartition(r.randint(1, 9))
        seen.append(sorted(map(str, mixing.taken_words(mixing.mix(docs, mixing.cyclic_weights((3, 1)))).collect())))
    assert seen[0] == seen[1]


def test_no_id_meets_in_one_task(spark):
    rows = [(None if i % 2 else i, "a", 1 + i % 7) for i in range(4000)]
    manifest = mixing.mix(frame(spark, rows), mixing.cyclic_weights((1,)))
    most = manifest.filter("doc_id is null").groupBy("place").count().agg(F.max("count")).first()[0]
    assert most < 0.6 * 4000  # of 4,000 rows in two epochs, over four places


def test_take_shares_what_equal_rows_are_taken(spark):
    rows = [(None, "a", 10)] * 5 + [(1, "a", 10), (1, "a", 20), (1, "b", 20), (2, "b", 300)]
    docs = frame(spark, rows)
    manifest = mixing.mix(docs, mixing.cyclic_weights((1, 5)))
    words = mixing.taken_words(manifest).agg(F.sum("taken")).first()[0]
    got = mixing.take(docs, manifest)
    assert got.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == words
