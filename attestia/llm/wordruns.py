"""Maximal periodic runs of words, and texts without their repetitions.

Words are the runs of bytes between ASCII white space. The suffixes of all texts of a slice are sorted by doubling,
with texts kept apart, and the common prefixes of neighbours give the suffix tree: its nodes are the intervals of the
order with a common depth. As Stoye and Gusfield have it, every leaf meets only those ancestors of which it is not in
the largest child, at most log2(n) of them: a leaf i of a node of depth p, with i + p (or i - p) below the node too, is the
start of a tandem repeat of period p, and a branching one if the next word breaks the period. A branching repeat is
the end of exactly one maximal run, which rotation to the left, word by word, completes; a run found with multiples of its
period is one run with the least.

A run has its smallest period q and a length of at least max(least, 2q). A word is dropped if any run contains it
after that run's first q words.

Defined results: null and empty texts, and texts without words, have no run and an empty collapsed text; runs never cross texts;
of equally long runs the first one by start, then period, is reported; rows that repeat give repeated rows; an empty
table gives an empty result; kept columns pass through; a very long text is processed whole in the memory of its
task, about 250 bytes a word.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import ready, small_batches

LEAST = 12
SLICE_BYTES = 384 << 10
#: Words compared at once when runs are completed.
COMPARED = 1 << 20


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that no two texts share, each text ended by a number of its own; and where each text starts."""
    numbers, base = [], 0
    for text in words:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in text), np.int64, len(text)) + base)
        base += len(seen) + 1
        numbers.append(np.array([base - 1]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.cumsum(sizes) - sizes


def sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order of all suffixes, and for each length h of the doubling the ranks of all substrings of h numbers."""
    n = len(text)
    rank = np.append(text.astype(np.int64), -1)
    width = int(text.max(initial=0)) + 2
    at = np.arange(n)
    h, key = 1, rank[at] + 1
    while h < 3 and width ** (h + 1) < 1 << 62:  # as many numbers in the first key as it holds
        key = key * width + rank[np.minimum(at + h, n)] + 1
        h += 1
    order = np.argsort(key, kind="stable")
    key, slots, levels = key[order], np.arange(n), [(1, rank[:n].astype(np.int32))]
    while True:
        fresh = np.append(True, key[1:] != key[:-1])
        begin = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begin, len(key)))
        rank[order[slots]] = np.repeat(slots[begin], sizes)
        levels.append((h, rank[:n].astype(np.int32)))
        slots = slots[np.repeat(sizes, sizes) > 1]
        if not len(slots):
            return order, levels
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        h *= 2


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Numbers that each suffix has in common with the one before it in the order; entries for the first and past the last are 0."""
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out
    same = np.flatnonzero(levels[0][1][order[1:]] == levels[0][1][order[:-1]]) + 1
    x, y, done = order[same], order[same - 1], np.zeros(len(same), np.int64)
    for h, rank in [*levels[:0:-1], levels[0], levels[0]]:  # the first key may hold three numbers: two of single ones follow
        fits = np.maximum(x, y) + done < n
        a, b = np.minimum(x + done, n - 1), np.minimum(y + done, n - 1)
        done += np.where(fits & (rank[a] == rank[b]), h, 0)
    out[same] = done
    return out


def nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each entry the nearest smaller one before (-1) or after it (+1), by jumps over what was already found."""
    n = len(values)
    to = np.arange(n) + step
    left = np.flatnonzero(values > 0)
    while len(left):
        left = left[values[to[left]] >= values[left]]
        to[left] = to[to[left]]
    return to


class SuffixTree:
    """Inner nodes below the root: depth, interval of the suffix order, parent, and where its path of largest children ends."""

    def __init__(self, order: np.ndarray, common: np.ndarray):
        n = len(order)
        before, after = nearest_smaller(common, -1), nearest_smaller(common, 1)
        inner = np.flatnonzero(common > 0)
        _, first, of = np.unique(before[inner] * (n + 1) + after[inner], return_index=True, return_inverse=True)
        nodes = len(first)
        self.low, self.high, self.depth = before[inner[first]], after[inner[first]] - 1, common[inner[first]]
        node = np.full(n + 1, nodes, np.int64)  # the last one is the root
        node[inner] = of
        leaf = np.where(common[:-1] >= common[1:], node[:-1], node[1:])
        up = np.where(common[self.low] >= common[self.high + 1], node[self.low], node[self.high + 1])
        size = self.high - self.low + 1
        by = np.lexsort((np.arange(nodes), size, up))
        largest = by[np.append(up[by][1:] != up[by][:-1], True)] if nodes else by
        heavy = np.zeros(nodes, bool)
        heavy[largest] = True
        heavy[up == nodes] = False
        has = np.zeros(nodes + 1, bool)
        has[up] = True
        head = np.append(np.where(heavy, up, np.arange(nodes)), nodes)
        while not np.array_equal(head, further := head[head]):
            head = further
        #: The nearest ancestor of each node of which the node is not in the largest child.
        self.light = np.append(up, nodes)[head]
        alone = (leaf < nodes) & ~has[leaf] & (np.arange(n) == np.append(self.low, -1)[leaf])  # the largest child of a node without inner children
        self.leaf = np.where(alone, self.light[leaf], leaf)
        self.root = nodes


def tandem_repeats(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats."""
    order, levels = sorted_suffixes(text)
    tree = SuffixTree(order, common_prefixes(order, levels))
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    starts, periods = [], []
    at = np.flatnonzero(tree.leaf < tree.root)
    i, node = order[at], tree.leaf[at]
    while len(i):
        p, low, high = tree.depth[node], tree.low[node], tree.high[node]
        for start, other in ((i, i + p), (i - p, i - p)):
            r = rank[np.clip(other, 0, n - 1)]
            found = np.flatnonzero((other >= 0) & (other < n) & (r >= low) & (r <= high))
            s, d = start[found], p[found]
            branching = text[s + d] != text[s + 2 * d]  # a repeat ends in its text, so its end has a number
            starts.append(s[branching])
            periods.append(d[branching])
        node = tree.light[node]
        more = node < tree.root
        i, node = i[more], node[more]
    s, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, periods))
    _, once = np.unique(s * (n + 1) + p, return_index=True)
    return s[once], p[once]


def completed(text: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The starts after all rotations to the left that keep the period."""
    starts = starts.copy()
    live, width = np.arange(len(starts)), 4
    while len(live):
        width = max(1, min(width * 2, COMPARED // len(live)))
        grown = []
        for k in range(0, len(live), COMPARED):
            part = live[k : k + COMPARED]
            at = starts[part][:, None] - 1 - np.arange(width)
            same = (at >= 0) & (text[np.maximum(at, 0)] == text[np.maximum(at, 0) + periods[part][:, None]])
            steps = np.where(same.all(1), width, same.argmin(1))
            starts[part] -= steps
            grown.append(part[steps == width])
        live = np.concatenate(grown)
    return starts


def primitive_runs(text: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of the run that each branching repeat ends.

    Of the repeats that end at one word, the one of the least period is completed first; its run also holds those whose
    period is a multiple and which it covers, so that a long run isn't completed once for each multiple.
    """
    ends = starts + 2 * periods
    by = np.lexsort((periods, ends))
    s, p, e = starts[by], periods[by], ends[by]
    found = []
    while len(s):
        first = np.append(True, e[1:] != e[:-1])
        begin = completed(text, s[first], p[first])
        found.append((begin, e[first] - begin, p[first]))
        leader = np.cumsum(first) - 1
        left = ~first & ~((p % p[first][leader] == 0) & (begin[leader] <= s))
        s, p, e = s[left], p[left], e[left]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (starts, ends, periods)


def maximal_runs(words: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length and period of every run, in this order."""
    text, origin = numbered(words)
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    begin, length, p = primitive_runs(text, *tandem_repeats(text))
    fits = length >= np.maximum(least, 2 * p)
    begin, length, p = begin[fits], length[fits], p[fits]
    owner = np.searchsorted(origin, begin, "right") - 1
    start = begin - origin[owner]
    by = np.lexsort((p, start, owner))
    return owner[by], start[by], length[by], p[by]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


KINDS = {
    "n_runs": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "period": pa.int64(),
    "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(),
    "collapsed_sha256": pa.string(),
}
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def found_batch(batch: pa.RecordBatch, least: int, digest: bool):
    """Slices of a batch whose last column is the text (binary), with runs and collapsed texts, or their digests."""
    for part in small_batches([batch], SLICE_BYTES):
        words = [(x or b"").split() for x in part.column(part.num_columns - 1).to_pylist()]
        owner, *runs = maximal_runs(words, least)
        edges = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        rows = []
        for text, a, b in zip(words, edges, edges[1:], strict=False):
            start, length, period = (x[a:b] for x in runs)
            listed = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
            kept = b" ".join(collapsed(text, start, length, period))
            if not digest:
                rows.append((kept.decode("utf-8", "replace"), [dict(zip(("start", "length", "period"), x, strict=True)) for x in listed]))
                continue
            best = min(listed, key=lambda x: (-x[1], x[0], x[2]), default=None)
            first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
            rows.append((len(listed), *first, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()))
        kinds = KINDS if digest else {"collapsed": pa.string(), "runs": pa.list_(RUN)}
        made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *kinds])


def runs(docs: DataFrame, least: int = LEAST, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The kept columns with `collapsed` (text) and `runs` (start, length, period), or with their digests. No shuffle."""
    spark = docs.sparkSession
    ready(spark)
    more = "collapsed string, runs array<struct<start:long,length:long,period:long>>"
    if digest:
        more = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    fields = spark.createDataFrame([], more).schema
    fields = type(fields)(docs.select(*keep).schema.fields + fields.fields)

    def run(batches):
        from attestia.llm import wordruns

        for batch in batches:
            yield from wordruns.found_batch(batch, least, digest)

    return docs.select(*keep, F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(run, fields)
