"""Line deduplication by pairwise alignment.

Documents are ordered by doc_id, then by a hash of their text; lines are trimmed of all white space, line ends included, and judged on the input, not on what
other deletions leave.

1. Rare line hashes. A single line may be anywhere; a run of neighbouring lines with BLOCK_WORDS words is rare. Every
   document gives the hashes of its least runs: from each line on, and up to each line, the fewest lines that reach
   BLOCK_WORDS words, so at most two for each line.
2. Pairs. A later document is paired with the first holder of each of its runs, so a run in n documents makes n - 1
   pairs, never all. A run has an earlier holder just if its first holder is earlier, so no other pair can add
   anything. What travels is the shared runs and their places in both, not the documents.
3. Alignment. Each pair is aligned by patience diff over its shared runs: runs that occur once in both, in the longest
   ascending order, then recursively between them, then repeated ones by occurrence. Blocks in another order than the
   earlier document's, which no alignment in order can hold, are found by further alignments of what is left (`moved`).
4. The aligned common blocks are deleted from the later document. The runs of a block cover it, so a line goes exactly
   if it lies in any run of neighbouring lines, of BLOCK_WORDS words or more, that some earlier document also has.

Words are runs of other characters than white space; two characters of a script that is written without spaces count
as a word more.

Defined results: documents without text or doc_id are kept as they are; rows that repeat both are the same
document and get the same deletions; rows that share only a doc_id are documents of their own; empty lines count
no words; a document may end up empty (an empty text, not null); a very long document is as many runs as it has
lines, at most twice, and meets each earlier holder with the shared ones only; an empty table gives an empty result;
further columns pass through (n_lines and n_removed, if asked for, replace columns of these names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.text import trim
from attestia.llm.common import WORD, durable, lookup, ready

BLOCK_WORDS = 10
# Code points of scripts written without spaces (Thai to Myanmar, Khmer, kana and Han).
UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x94D049BB133111EB


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), ascending in both: common ends, then lines unique in both, recursively.

    A range without such lines anchors on the occurrences of its common lines, the n-th here with the n-th there.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _rising(_unique_pairs(a, a0, a1, b, b0, b1) or _numbered_pairs(a, a0, a1, b, b0, b1))
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        found += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(found)


def _unique_pairs(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    once: dict = {}
    for i in range(a0, a1):
        once[a[i]] = None if a[i] in once else i
    there: dict = {}
    for j in range(b0, b1):
        if once.get(b[j]) is not None:
            there[b[j]] = None if b[j] in there else j
    return sorted((once[x], j) for x, j in there.items() if j is not None)


def _numbered_pairs(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    places: dict = {}
    for j in range(b1 - 1, b0 - 1, -1):
        places.setdefault(b[j], []).append(j)
    return [(i, places[a[i]].pop()) for i in range(a0, a1) if places.get(a[i])]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that ascends in its second place, by patience sorting."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[pile], at[pile] = j, n
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def aligned(runs: list[tuple]) -> list[tuple[int, int, int, bool]]:
    """Common blocks (start, end, start in the earlier document, moved) of one pair, from its shared runs of lines.

    `runs` are (start, end, start in the earlier document). The first alignment is in the earlier document's order. What it
    leaves is aligned again, in that order and against its reverse in turns, until no run is left: of n runs in any
    order, one of two alignments finds the root of n at least. Then a run that occurs for the n-th time meets the n-th
    of as many copies of the earlier document, one after the other.
    """
    blocks: list[tuple[int, int, int, bool]] = []
    rest, turn = sorted(runs), 0
    while rest:
        times: dict[tuple[int, int], int] = {}
        theirs = []
        for s, e, f in rest:
            times[f, e - s] = times.get((f, e - s), -1) + 1
            theirs.append((times[f, e - s] if turn else 0, f, e - s))
        backwards = turn > 0 and turn % 2 == 0
        found = {i for i, _ in patience(theirs, sorted(set(theirs), reverse=backwards))}
        if not found:
            break
        chain = [rest[i] for i in sorted(found)]
        if turn:
            chain.sort(key=lambda r: (r[2] - r[0], r))
        for s, e, f in chain:
            if blocks and blocks[-1][3] == (turn > 0) and f - s == blocks[-1][2] - blocks[-1][0] and blocks[-1][0] <= s <= blocks[-1][1]:
                blocks[-1] = (blocks[-1][0], max(e, blocks[-1][1]), blocks[-1][2], turn > 0)
            else:
                blocks.append((s, e, f, turn > 0))
        rest = [r for i, r in enumerate(rest) if i not in found]
        turn += 1
    return blocks


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), h (line hashes) and w (words of each line) of the documents that take part."""
    lines = F.split("_text", "\n", -1)
    def count(x):
        unspaced = F.when(F.octet_length(x) > F.length(x), F.floor(F.regexp_count(x, F.lit(UNSPACED)) / 2).cast("int")).otherwise(0)
        return F.regexp_count(x, F.lit(WORD)) + unspaced

    return (
        docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
        .select(
            "doc_id",
            F.xxhash64("_text").alias("th"),
            F.transform(lines, lambda x: F.xxhash64(trim(x))).alias("h"),
            F.transform(lines, count).alias("w"),
        )
    )


def windows(h: np.ndarray, w: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of the least runs of lines with enough words, from each line on and up to each line."""
    n = len(h)
    sums = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    end = np.searchsorted(sums, sums[:-1] + block_words, "left")
    start = np.searchsorted(sums, sums[1:] - block_words, "right") - 1
    places = np.arange(n)
    at = np.unique(np.concatenate([(places * (n + 1) + end)[end <= n], (start * (n + 1) + places + 1)[start >= 0]]))
    first, last = at // (n + 1), at % (n + 1)
    power = np.full(n + 1, np.uint64(BASE))
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * power[:-1], dtype=np.uint64)])
    key = (prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64)
    return first, last, key.view(np.int64)


BLOCKS = "array<struct<start:int,end:int,of:long,of_th:long,of_start:int,moved:boolean>>"


def common_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, th, n_lines, keep (one boolean for each line) and blocks of the documents that lose lines, as a written table.

    A block names its lines (start, end), the earlier document and its first line there, and whether it is moved.
    """
    ready(docs.sparkSession)

    def cut(batches):
        from attestia.llm import linededup
        from attestia.llm.common import freed

        yield from freed(linededup.window_batch(batch, block_words) for batch in batches)

    def align(batches):
        from attestia.llm import linededup
        from attestia.llm.common import freed, small_batches

        yield from freed(linededup.align_batch(batch) for batch in small_batches(batches, 1 << 20))

    cuts = durable(
        lines_of(docs).mapInArrow(cut, "doc_id long, th long, n int, s array<int>, e array<int>, k array<long>").filter(F.size("k") > 0), "windows"
    )
    me = F.struct("doc_id", "th").alias("me")
    held = cuts.select(me, "n", F.explode(F.arrays_zip("s", "e", "k")).alias("run"))
    place = F.struct("doc_id", "th", "run.s").alias("place")
    keys = cuts.select("doc_id", "th", F.explode(F.arrays_zip("s", "k")).alias("run")).select(F.col("run.k").alias("k"), place)
    spread = keys.groupBy("k").agg(F.min("place").alias("first"), F.max(F.struct("place.doc_id", "place.th")).alias("last"))
    firsts = durable(spread.filter(F.struct("first.doc_id", "first.th") < F.col("last")).select("k", "first"), "firsts")
    shared = lookup(held.select("me", "n", "run.s", "run.e", "run.k"), firsts, "k", F.struct("me", "s")).filter(
        F.col("first").isNotNull() & (F.struct("first.doc_id", "first.th") < F.col("me"))
    )
    run = F.struct("s", "e", F.col("first.doc_id").alias("of"), F.col("first.th").alias("of_th"), F.col("first.s").alias("of_start"))
    return durable(
        shared.groupBy("me")
        .agg(F.max("n").alias("n"), F.collect_set(run).alias("runs"))  # at most two runs for each of its own lines
        .select("me.doc_id", "me.th", "n", "runs")
        .mapInArrow(align, f"doc_id long, th long, n_lines int, keep array<boolean>, blocks {BLOCKS}"),
        "blocks",
    )


def window_batch(batch: pa.RecordBatch, block_words: int) -> pa.RecordBatch:
    """The least runs of the documents of a batch."""
    h, w = batch.column("h"), batch.column("w")
    hashes, words, ends = h.flatten().to_numpy(), w.flatten().to_numpy(), np.cumsum([0, *h.value_lengths().to_pylist()])
    found = [windows(hashes[a:b], words[a:b], block_words) for a, b in zip(ends, ends[1:], strict=False)]
    offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
    first, last, key = (np.concatenate([f[k] for f in found]) if found else [] for k in range(3))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((first, pa.int32()), (last, pa.int32()), (key, pa.int64()))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), h.value_lengths(), *lists], ["doc_id", "th", "n", "s", "e", "k"])


def align_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The alignments of the documents of a batch with the first holders of their runs."""
    keep, blocks = [], []
    for n, runs in zip(batch.column("n").to_pylist(), batch.column("runs").to_pylist(), strict=True):
        partners: dict[tuple[int, int], list] = {}
        for r in runs:
            partners.setdefault((r["of"], r["of_th"]), []).append((r["s"], r["e"], r["of_start"]))
        found = sorted((s, e, *p, f, moved) for p, own in partners.items() for s, e, f, moved in aligned(own))
        left = np.ones(n, bool)
        for s, e, *_ in found:
            left[s:e] = False
        keep.append(left.tolist())
        blocks.append([dict(zip(("start", "end", "of", "of_th", "of_start", "moved"), b, strict=True)) for b in found])
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("of", pa.int64()), ("of_th", pa.int64()), ("of_start", pa.int32()), ("moved", pa.bool_())])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("th"), batch.column("n"), pa.array(keep, pa.list_(pa.bool_())), pa.array(blocks, pa.list_(kind))],
        ["doc_id", "th", "n_lines", "keep", "blocks"],
    )


def dedup(docs: DataFrame, block_words: int = BLOCK_WORDS, count: bool = False) -> DataFrame:
    """The documents with their own columns, `text` without the deleted lines; with n_lines and n_removed if `count`."""
    found = common_blocks(docs, block_words)
    marks = found.select(F.struct("doc_id", "th").alias("me"), "keep")
    me = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    lines = F.split(F.col("row")["text"].cast("string"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.get(F.col("keep"), i)), "\n")
    text = F.when(F.col("keep").isNull(), F.col("row")["text"].cast("string")).otherwise(kept)
    told = [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size(F.filter("keep", lambda x: ~x)), F.lit(0)).alias("n_removed")]
    joined = lookup(docs.select(F.struct("*").alias("row"), me.alias("me")), marks, "me", F.col("me"), 1)
    own = [c for c in docs.columns if not (count and c in ("n_lines", "n_removed"))]
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in own], *(told if count else []))
