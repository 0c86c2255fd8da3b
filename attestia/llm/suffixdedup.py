"""Exact substring deduplication with per-shard suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier (in a smaller document, or before in the same
one) is removed; matches never cross documents and are judged on the input.

1. Routing. Each LENGTH-byte window is assigned to its anchor, the leftmost least-hashed GRAM-byte string in it, so
   equal windows have equal anchors. Consecutive windows of one anchor form a context. Contexts travel as hashes to
   the shard of their anchor; equal contexts are reduced there to the first (and before, in each slice of text),
   all others being repeats entirely. Anchors with one context need nothing more.
2. Suffix arrays. The bytes of the different contexts of an anchor are fetched; each shard builds the suffix array
   of its contexts by Larsson-Sadakane refinement (ranks doubled in depth, only groups that are still unsorted are
   sorted again), Kasai's common prefixes, and marks, in each run of suffixes with LENGTH bytes in common, all but
   the first window.
3. Merging. An anchor with more than HOT contexts is dealt over several shards; pairs of such shards are merged by
   binary search of one's windows in the other's suffix order.
4. Cutting. The marked windows of a document meet its bytes.

Defined results: null and empty texts have no bytes; rows without doc_id come before all others; rows that share a
doc_id are ordered by a hash of their text, and rows that repeat both are one document (each row is returned, with
the same result); an empty table gives an empty result; other columns are ignored. A very long text is hashed by segments,
but the contexts of one document that need a suffix array, and its repeated windows, meet in one row (24 and 8 bytes for each), at the
task that reads its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm import hashing
from attestia.llm.common import broadcastable, durable, ready, shuffle_width

#: A longer GRAM makes more anchors, a shorter one more chance repeats of anchors, whose number grows with its square.
LENGTH, GRAM = 100, 48
SEGMENT, SLICE = 1 << 19, 1 << 19
#: Contexts of one anchor beyond which they are dealt over shards: about SHARDS of them, more once a shard would have
#: more than MOST contexts. A pair of shards takes about 65 kB for each context of a shard while it is merged.
HOT, SHARDS, MOST = 400, 24, 4_000
FIRST = -(1 << 63)
SYMBOLS = 7  # of 9 bits in the first rank


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every window of `width` values, by doubling."""
    place = np.arange(len(values), dtype=np.int64)

    def halve(values, place, shift):
        right = values[shift:] < values[: len(values) - shift]
        return (
            np.where(right, values[shift:], values[: len(values) - shift]),
            np.where(right, place[shift:], place[: len(place) - shift]),
        )

    done = 1
    while done * 2 <= width:
        values, place = halve(values, place, done)
        done *= 2
    if done < width:
        values, place = halve(values, place, width - done)
    return place


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of segments of bytes: (segment, first window, last window, anchor hash, context hash) of every context."""
    nothing = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return nothing
    sums = hashing.prefix(data)
    grams = np.arange(len(data) - GRAM + 1)
    values = hashing.between(sums, grams, grams + GRAM)
    anchor = leftmost_least(values, LENGTH - GRAM + 1)
    long = ends - starts >= LENGTH
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts[long]] += 1
    steps[ends[long] - LENGTH + 1] -= 1
    windows = np.flatnonzero(np.cumsum(steps[: len(anchor)], dtype=np.int8))
    if not len(windows):
        return nothing
    at = anchor[windows]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = windows[fresh]
    last = windows[np.append(np.flatnonzero(fresh)[1:] - 1, len(windows) - 1)]
    at = at[fresh]
    shape = ((at - first) * LENGTH + (last - first)).astype(np.uint64)
    told = hashing.mix(hashing.spans(data, first, last + LENGTH) + hashing.mix(shape))
    return np.searchsorted(starts, first, "right") - 1, first, last, values[at], told


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _reduced(keys: list[np.ndarray], doc: np.ndarray, th: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each combination of keys, and the rows that repeat one at another place."""
    rows = np.lexsort((first, th, doc, *keys[::-1]))
    if not len(rows):
        return rows, rows
    fresh = np.append(True, np.logical_or.reduce([k[rows][1:] != k[rows][:-1] for k in keys]))
    lead = rows[fresh]
    of = lead[np.cumsum(fresh) - 1]
    again = (doc[rows] != doc[of]) | (th[rows] != th[of]) | (first[rows] != first[of])
    return lead, rows[again]


SKETCH = "bin int, kind int, anchor binary, told binary, doc binary, th binary, first binary, last binary"


def sketch_batch(batch: pa.RecordBatch, bins: int):
    """Packed contexts (kind 0) by bin of their anchor, and repeats within a slice (kind 1), of (doc, th, bytes)."""
    docs, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
    _, offsets, values = texts.buffers()
    base = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    whole = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    segments: list[tuple[int, int, int]] = []
    for row, size in enumerate(np.diff(base).tolist()):
        for k in range(0, max(1, size), SEGMENT):
            if size - k >= LENGTH:
                segments.append((row, k, min(size, k + SEGMENT + LENGTH - 1)))
    for a, b in hashing.slices(segments, lambda s: s[2] - s[1], SLICE):
        part = segments[a:b]
        data = np.concatenate([whole[base[r] + s : base[r] + e] for r, s, e in part])
        sizes = np.array([e - s for _, s, e in part])
        ends = np.cumsum(sizes)
        seg, first, last, anchor, told = contexts(data, ends - sizes, ends)
        if not len(seg):
            continue
        row = np.array([r for r, _, _ in part])[seg]
        move = np.array([s for _, s, _ in part])[seg] - (ends - sizes)[seg]
        doc, th, first, last = docs[row], ths[row], first + move, last + move
        keep, again = _reduced([anchor, told], doc, th, first)
        keep = np.sort(keep)
        to = bins_of(anchor[keep], bins)
        by = np.argsort(to, kind="stable")
        order, to = keep[by], to[by]
        edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)).tolist()  # of the bins that have contexts
        out = []
        for i, j in zip(edges, edges[1:], strict=False):
            if i < j:
                o = order[i:j]
                out.append((int(to[i]), 0, _six(anchor[o]), _six(told[o]), doc[o].tobytes(), th[o].tobytes(), first[o].astype(np.uint32).tobytes(), (last - first)[o].astype(np.uint8).tobytes()))
        if len(again):
            out.append((int(anchor[0] % np.uint64(bins)), 1, b"", b"", doc[again].tobytes(), th[again].tobytes(), first[again].astype(np.uint32).tobytes(), (last - first)[again].astype(np.uint8).tobytes()))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bin", "kind", "anchor", "told", "doc", "th", "first", "last"])


def bins_of(anchors: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each anchor, from all of its 64 bits: there may be any number of bins."""
    return (hashing.mix(anchors) % np.uint64(bins)).astype(np.int64)


MET = "open boolean, anchor long, doc long, th long, first long, last long"


def _met(is_open, anchor, doc, th, first, last):
    for i in range(0, len(doc), 200_000):
        p = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc[p]), is_open), pa.bool_()), *[pa.array(x[p].astype(np.int64), pa.int64()) for x in (anchor, doc, th, first, last)]],
            ["open", "anchor", "doc", "th", "first", "last"],
        )


def bin_rows(batches):
    """Of one bin: repeated windows (first to last), and the contexts that need a suffix array (`open`)."""
    held: list[list[bytes]] = [[] for _ in range(6)]
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("kind", "anchor", "told", "doc", "th", "first", "last")]
        for kind, *x in zip(*columns, strict=True):
            if kind:
                doc, th = (np.frombuffer(y, np.int64) for y in x[2:4])
                first = np.frombuffer(x[4], np.uint32).astype(np.int64)
                yield from _met(False, np.zeros(len(doc)), doc, th, first, first + np.frombuffer(x[5], np.uint8))
            else:
                for h, y in zip(held, x, strict=True):
                    h.append(y)
    if not held[0]:
        return
    anchor = _of_six(b"".join(held[0]))
    order = np.argsort(anchor, kind="stable")
    ranked = anchor[order]
    same = ranked[1:] == ranked[:-1]
    many = np.sort(order[np.append(same, False) | np.append(False, same)])
    anchor = anchor[many]
    told = _of_six(b"".join(held[1]))[many]
    doc, th = (np.frombuffer(b"".join(held[k]), np.int64)[many] for k in (2, 3))
    first = np.frombuffer(b"".join(held[4]), np.uint32)[many].astype(np.int64)
    last = first + np.frombuffer(b"".join(held[5]), np.uint8)[many]
    held.clear()
    lead, again = _reduced([anchor, told], doc, th, first)
    yield from _met(False, np.zeros(len(again)), doc[again], th[again], first[again], last[again])
    a = anchor[lead]
    same = a[1:] == a[:-1]
    lead = lead[np.append(same, False) | np.append(False, same)] if len(a) else lead
    yield from _met(True, anchor[lead], doc[lead], th[lead], first[lead], last[lead])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text (values below 512) in order."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(SYMBOLS, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(SYMBOLS):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots = np.arange(n)
    h = SYMBOLS
    while True:
        fresh = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(key)))
        rank[order[slots]] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes, sizes) > 1]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        key = key[by]
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Kasai: symbols that each suffix has in common with the one before it in the order, `most` at most.

    A suffix one symbol on has at most one symbol less in common. All pieces of the text (starts to ends, each ended
    by a separator that is not compared) advance together.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    by = np.argsort(starts - ends, kind="stable")
    first, size = starts[by], (ends - starts)[by]
    common = np.zeros(len(by), np.int64)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t, "left"))
        i = first[:live] + t
        j = before[i]
        common[:live] = np.maximum(common[:live] - 1, 0) * (j >= 0)
        more = np.flatnonzero(j >= 0)
        while len(more):
            x, y = i[more] + common[more], j[more] + common[more]
            fits = (common[more] < most) & (x < n) & (y < n)
            more, x, y = more[fits], x[fits], y[fits]
            more = more[(text[x] == text[y]) & (text[x] > 0)]
            common[more] += 1
        out[i] = common[:live]
    return out


class Shard:
    """Contexts of one shard with the suffix order of their windows."""

    def __init__(self, doc, th, first, last, bodies: list[bytes]):
        self.sizes = last - first + 1
        lengths = self.sizes + LENGTH  # with the separator
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self.bytes = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
        text = self.bytes.astype(np.int16) + 1
        text[ends - 1] = 0
        order = suffix_array(text)
        common = common_prefixes(text, order, starts, ends - 1, LENGTH)
        owner = np.repeat(np.arange(len(starts)), self.sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        window = np.full(len(text), -1, np.int64)
        window[starts[owner] + place] = np.arange(len(owner))
        self.start = starts[owner] + place
        self.doc, self.th, self.at = doc[owner], th[owner], first[owner] + place
        turn = np.empty(len(owner), np.int64)
        turn[np.lexsort((self.at, self.th, self.doc))] = np.arange(len(owner))
        ranked = order[window[order] >= 0]
        self.windows = window[ranked]  # in suffix order
        self.fresh = common[ranked] < LENGTH
        if len(self.fresh):
            self.fresh[0] = True
        self.run = np.cumsum(self.fresh) - 1
        heads = np.flatnonzero(self.fresh)
        self.least = np.minimum.reduceat(turn[self.windows], heads) if len(heads) else heads
        self.turn = turn

    def repeats(self) -> np.ndarray:
        """Windows that also start earlier in this shard."""
        return self.windows[self.turn[self.windows] != self.least[self.run]]

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """One window of each run, in suffix order, as fixed-length strings; and the run's first window."""
        at = self.start[self.windows[self.fresh]]
        strings = self.bytes[at[:, None] + np.arange(LENGTH)] if len(at) else np.zeros((0, LENGTH), np.uint8)
        by_turn = np.argsort(self.turn)
        return np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel(), by_turn[self.least]


def merged(left: Shard, right: Shard) -> list[tuple[Shard, np.ndarray]]:
    """Windows of each shard that also start earlier in the other, by binary search in the left's suffix order."""
    (a, a_first), (b, b_first) = left.heads(), right.heads()
    if not len(a) or not len(b):
        return []
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = np.flatnonzero(a[at] == b)
    of_a, of_b = at[hit], hit
    out = []
    for mine, theirs, run, other in ((left, right, of_a, b_first[of_b]), (right, left, of_b, a_first[of_a])):
        first = np.full(len(mine.least), -1, np.int64)
        first[run] = other
        w = mine.windows[first[mine.run] >= 0]
        f = first[mine.run][first[mine.run] >= 0]
        key = lambda s, i: (s.doc[i], s.th[i], s.at[i])
        (d, t, p), (e, u, q) = key(mine, w), key(theirs, f)
        out.append((mine, w[(e < d) | (e == d) & ((u < t) | (u == t) & (q < p))]))
    return out


def ranges(shard: Shard, windows: np.ndarray):
    """(doc, th, first, last) of runs of windows."""
    by = windows[np.lexsort((shard.at[windows], shard.th[windows], shard.doc[windows]))]
    doc, th, at = shard.doc[by], shard.th[by], shard.at[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:] - 1, len(by) - 1)[: len(heads)]
    return doc[heads], th[heads], at[heads], at[tails]


def solve(table: pa.Table) -> pa.Table:
    """Repeated windows of a shard (side 2), or between two shards (sides 0 and 1)."""
    side = table.column("side").to_numpy()
    doc, th, first, last = (table.column(c).to_numpy() for c in ("doc", "th", "first", "last"))
    body = table.column("body").to_pylist()
    shards = [Shard(doc[i], th[i], first[i], last[i], [body[k] for k in i.tolist()]) for s in (0, 1, 2) if len(i := np.flatnonzero(side == s))]
    if len(shards) == 2:
        found = merged(*shards)
    else:
        found = [(shards[0], shards[0].repeats())] if side[0] == 2 else []
    parts = [ranges(s, w) for s, w in found if len(w)]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4)]
    return pa.table(dict(zip(("doc", "th", "first", "last"), [pa.array(c, pa.int64()) for c in columns], strict=True)))


def uncovered(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes that no window from first to last covers, and how many runs were removed."""
    steps = np.zeros(len(data) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + LENGTH, -1)
    gone = np.cumsum(steps)[:-1] > 0
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return data[~gone], runs


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc, th and body; of rows with the least doc, those without doc_id have a negative th, the others none."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8")
    doc, th, sign = F.col("doc_id").cast("long"), F.xxhash64(body), F.lit(FIRST)
    th = F.when(doc.isNull(), th.bitwiseOR(sign)).when(doc == sign, th.bitwiseAND(F.lit(~FIRST))).otherwise(th)
    return docs.select(F.coalesce(doc, sign).alias("doc"), th.alias("th"), body.alias("body"))


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, th and windows (array of first and last) of the documents with repeated windows, as a written table."""
    spark = docs.sparkSession
    ready(spark)
    bins = shuffle_width(spark, docs)
    source = _keyed(docs, text)

    def sketch(batches):
        from attestia.llm import suffixdedup
        from attestia.llm.common import freed, small_batches

        yield from freed(x for batch in small_batches(batches) for x in suffixdedup.sketch_batch(batch, bins))

    def meet(batches):
        from attestia.llm import suffixdedup
        from attestia.llm.common import freed

        yield from freed(suffixdedup.bin_rows(batches))

    def fetch(batches):
        from attestia.llm.common import small_batches

        for batch in small_batches(batches, 2 << 20):
            anchors, docs_, ths, bodies, opened = (batch.column(c).to_pylist() for c in ("doc", "doc", "th", "body", "opened"))
            rows = [(o["anchor"], d, t, o["first"], o["last"], o["shards"], b[o["first"] : o["last"] + LENGTH]) for _, d, t, b, os_ in zip(anchors, docs_, ths, bodies, opened, strict=True) for o in os_]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "doc", "th", "first", "last", "shards", "body"])

    def solved(table: pa.Table) -> pa.Table:
        from attestia.llm import suffixdedup

        return suffixdedup.solve(table)

    met = durable(source.mapInArrow(sketch, SKETCH).repartitionById(bins, "bin").mapInArrow(meet, MET), "contexts")
    opened = met.filter("open")
    many = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    per = F.least(F.greatest(F.lit(HOT), F.col("n") / SHARDS), F.lit(MOST))
    hot = durable(many.select("anchor", F.ceil(F.col("n") / per).cast("int").alias("shards")), "hot")
    opened = opened.join(F.broadcast(hot), "anchor", "left") if broadcastable(hot) else opened.join(hot.hint("merge"), "anchor", "left")
    wanted = durable(
        opened.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "first", "last", F.coalesce("shards", F.lit(1)).alias("shards"))).alias("opened")), "opened"
    )
    keys = durable(wanted.select("doc", "th"), "keys")
    near = source.join(F.broadcast(keys), ["doc", "th"], "leftsemi") if broadcastable(keys) else source
    found = near.dropDuplicates(["doc", "th"]).join(wanted, ["doc", "th"]).select("doc", "th", "body", "opened").mapInArrow(
        fetch, "anchor long, doc long, th long, first long, last long, shards int, body binary"
    )
    mine = F.pmod(F.xxhash64("doc", "th", "first"), F.col("shards")).cast("int")
    dealt = (
        found.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select(
            F.when(F.col("shards") > 1, F.col("anchor")).otherwise(F.pmod(F.col("anchor"), F.lit(4 * bins))).alias("shard"),
            F.when(F.col("shards") > 1, F.least("mine", "other")).otherwise(F.lit(-1)).alias("p"),
            F.greatest("mine", "other").alias("q"),
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
            "doc",
            "th",
            "first",
            "last",
            "body",
        )
    )
    ranged = dealt.groupBy("shard", "p", "q").applyInArrow(solved, "doc long, th long, first long, last long")
    marks = met.filter("not open").select("doc", "th", "first", "last").unionByName(ranged)
    return durable(marks.groupBy("doc", "th").agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))).alias("windows")), "repeats")


def dedup(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans of every row and what is kept: bytes, or their kept_sha256 if `digest`."""
    found = repeats(docs, text)
    source = _keyed(docs, text)
    keys = durable(found.select("doc", "th"), "keys")

    def cut(batches):
        from attestia.llm import suffixdedup as s
        from attestia.llm.common import small_batches

        for batch in small_batches(batches):
            doc, th, body = batch.column("doc"), batch.column("th"), batch.column("body").to_pylist()
            lists = batch.column("windows")
            offsets, flat = lists.offsets.to_numpy(), lists.flatten()
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            offsets = offsets - offsets[0]
            kept, runs = [], []
            for b, i, j in zip(body, offsets.tolist(), offsets[1:].tolist(), strict=False):
                data, n = (np.frombuffer(b, np.uint8), 0) if i == j else s.uncovered(np.frombuffer(b, np.uint8), first[i:j], last[i:j])
                kept.append(data.tobytes())
                runs.append(n)
            sizes = np.fromiter(map(len, body), np.int64, len(body))
            left = np.fromiter(map(len, kept), np.int64, len(kept))
            out = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [doc, th, pa.array(sizes), pa.array(sizes - left), pa.array(runs, pa.int64()), out], ["doc", "th", "n_bytes", "n_removed", "n_spans", name]
            )

    name = "kept_sha256" if digest else "kept"
    none = F.array().cast("array<struct<first:int,last:int>>")
    joined = source.join(found, ["doc", "th"], "left")
    if broadcastable(keys):  # rows without repeats need not be dealt out
        has = keys.withColumn("has", F.lit(True))
        flagged = source.join(F.broadcast(has), ["doc", "th"], "left")
        joined = flagged.filter("has").drop("has").join(found, ["doc", "th"], "left").unionByName(flagged.filter("has is null").drop("has").withColumn("windows", F.lit(None).cast("array<struct<first:int,last:int>>")))
    rows = joined.select("doc", "th", "body", F.coalesce("windows", none).alias("windows"))
    cutout = rows.mapInArrow(cut, f"doc long, th long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")
    named = (F.col("doc") != FIRST) | (F.col("th") >= 0)
    return cutout.select(F.when(named, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", name)
