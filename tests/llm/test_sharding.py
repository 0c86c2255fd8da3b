from pyspark.sql import functions as F
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from attestia.llm import sharding


def naive(sizes, capacity):
    """Best-fit-decreasing over a plain list of bins."""
    left, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
            left[b] -= sizes[i]
        else:
            b = len(left)
            left.append(capacity - sizes[i])
        where[i] = b
    return where


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 70))
def test_tree_packs_as_a_plain_list(sizes, capacity):
    assert sharding.pack(sizes, capacity) == naive(sizes, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=80), st.integers(1, 9))
def test_spread_is_near_equal(sizes, bins):
    where = sharding.spread(sizes, bins)
    loads = [0] * bins
    for s, b in zip(sizes, where, strict=True):
        loads[b] += s
    assert max(loads) <= max(max(sizes), -(-sum(sizes) // bins)) + max(sizes)


def test_shards(spark):
    r = random.Random(1)
    texts = ["x" * r.randint(0, 200) + str(r.randint(0, 300)) for _ in range(3000)] + ["copy é"] * 200 + [None, "", ""]
    rows = [(i if r.random() < 0.95 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, shard int, size string")
    got = sharding.shard(docs).collect()
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    loads, slots, groups = {}, {}, {}
    for x in got:
        loads[x.shard] = loads.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        groups.setdefault(bytes(x.group), set()).add(x.shard)
    assert sorted(loads) == list(range(8)) and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_a_group_of_a_third_of_all_rows_stays_whole(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i:06d}") for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(docs).collect()
    assert len({x.shard for x in got if x.doc_id % 3 == 0}) == 1
    others = {}
    for x in got:
        others[x.shard] = others.get(x.shard, 0) + x.size
    rest = sorted(others.values())[:-1]
    assert max(rest) - min(rest) <= 50


def test_rows_of_the_query_against_a_plain_version(spark):
    r = random.Random(6)
    texts = [None, "", "é" * 50, *("".join(r.choices("abc ", k=r.choice([1, 5, 40, 300, 2000]))) for _ in range(60))]
    rows = [(r.choice([None, 5, i]), r.choice(texts)) for i in range(500)]
    got = sharding.shard(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string"), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    where, load, slots = {}, [0] * 8, [[] for _ in range(8)]
    for x in got:
        where.setdefault(bytes(x.group), set()).add(x.shard)
        load[x.shard] += x.size
        slots[x.shard].append((x.slot, x.doc_id is not None, x.doc_id or 0, bytes(x.group)))
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together
    assert all([a for a, *_ in sorted(s)] == list(range(len(s))) for s in slots)
    assert all([k for _, *k in sorted(s)] == sorted(k for _, *k in s) for s in slots)  # slots follow doc_id
    largest = max(sum(size(u) for _, u in rows if (u or "") == (t or "")) for _, t in rows)
    assert max(load) - min(load) <= largest


def test_fixed_capacity_and_long_texts(spark):
    rows = [(i, "x" * (i % 90 + 9)) for i in range(300)] + [(900, "y" * 3_000_000), (901, "y" * 3_000_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), capacity=2000).collect()
    load = {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
    assert sorted(load.values())[-1] == 2 * 3_000_001 and all(n <= 2000 for n in sorted(load.values())[:-1])
    assert len(load) <= 1 + -(-11 * sum(i % 90 + 10 for i in range(300)) // (9 * 2000)) + 1


def test_one_doc_id_does_not_meet_in_a_task(spark):
    rows = [(1, f"t{i}") for i in range(3000)] + [(i, "same") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)
    assert got.groupBy("shard").agg({"slot": "max", "doc_id": "count"}).count() == 2
    assert all(x["max(slot)"] + 1 == x["count(1)"] for x in got.groupBy("shard").agg(F.max("slot"), F.count(F.lit(1))).collect())
