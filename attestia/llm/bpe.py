"""Byte-level BPE encoding and decoding by folding ranked merges over the bytes of distinct words.

A text is cut into words by the vocabulary's pattern; every distinct word is folded once: of all neighbouring
pieces the pair of the lowest rank (leftmost first) merges until none has a rank. Decoding concatenates the
pieces of the ids. `encode` does this beside the text in Arrow batches, each Python worker keeping the words it
has folded (at most MEMO_WORDS, then it starts over); `fold_words` is the same fold as Spark higher-order
functions over a literal rank map, for a table of distinct words.

Defined results: a null text encodes as the empty one, to no ids; repeated rows give repeated rows; kept columns
pass through; an empty table gives an empty result; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import ready, resident, small_batches

MEMO_WORDS = 200_000
#: The word pattern for texts of ASCII characters, or of those and Latin letters of two blocks, where the standard
#: library's engine is faster; all their white space is ASCII.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LATIN_PATTERN = ASCII_PATTERN.replace("A-Za-z", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f")
NOT_LATIN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search
GENERAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each piece in a vocabulary file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    pieces = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    scores = [ranks.get(a + b, none) for a, b in zip(pieces, pieces[1:], strict=False)]
    if len(word) > 256:
        return _fold_long(pieces, scores, ranks, none)
    while scores:
        low = min(scores)
        if low == none:
            break
        i = scores.index(low)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = ranks.get(pieces[i - 1] + pieces[i], none)
        if i < len(scores):
            scores[i] = ranks.get(pieces[i] + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _fold_long(pieces, scores, ranks, none) -> list[int]:
    """The same fold with a heap of pairs, for words whose length squared would tell."""
    import heapq

    n = len(pieces)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(s, i, 1, 1) for i, s in enumerate(scores) if s < none]  # rank, place, lengths of both pieces
    heapq.heapify(heap)

    def offer(i):
        j = after[i]
        if j < n and (s := ranks.get(pieces[i] + pieces[j], none)) < none:
            heapq.heappush(heap, (s, i, len(pieces[i]), len(pieces[j])))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(pieces[i]) != a or len(pieces[j]) != b:
            continue
        pieces[i] += pieces[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p, here in zip(pieces, alive, strict=True) if here]


class Splitter:
    """Cuts texts into the words of a vocabulary pattern."""

    def __init__(self, pattern: str):
        import regex

        self._general = regex.compile(pattern).findall
        known = pattern == GENERAL_PATTERN
        self._ascii = re.compile(ASCII_PATTERN, re.A).findall if known else self._general
        self._latin = re.compile(LATIN_PATTERN, re.A).findall if known else self._general

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text)
        return self._general(text) if NOT_LATIN(text) else self._latin(text)


class Memo(dict):
    """Folded words, as decimal ids joined by one space."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> str:
        found = " ".join(map(str, fold(word.encode(), self.ranks)))
        if len(word) < 64:
            self[word] = found
        return found


def worker(shared) -> tuple[Splitter, Memo, dict[str, bytes]]:
    """This Python worker's splitter, memo and pieces for a broadcast (pattern, ranks)."""
    pattern, ranks = shared.value
    return resident(ranks, lambda: (Splitter(pattern), Memo(ranks), {str(r): p for p, r in ranks.items()}))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False
) -> DataFrame:
    """The kept columns with ids (array of int), or with digests of the ids and of the decoded bytes.

    With digest: n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((pattern, read_ranks(ranks_path)))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    fields = spark.createDataFrame([], more).schema
    fields = type(fields)(docs.select(*keep).schema.fields + fields.fields)

    def run(batches):
        from attestia.llm import bpe

        for batch in batches:
            yield from bpe.encode_batch(batch, shared, digest)

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, fields)


def encode_batch(batch: pa.RecordBatch, shared, digest: bool):
    """Encoded slices of a batch whose last column is the text."""
    from hashlib import sha256

    split, memo, pieces = worker(shared)
    for part in small_batches([batch], 512 << 10):
        if len(memo) > MEMO_WORDS:
            memo.clear()
        coded = [" ".join(map(memo.__getitem__, split(x))) if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
        if digest:
            piece = pieces.__getitem__
            split_ids = [x.split(" ") if x else [] for x in coded]
            made = [
                pa.array([len(x) for x in split_ids], pa.int64()),
                pa.array([sha256(x.encode()).hexdigest() for x in coded], pa.string()),
                pa.array([sha256(b"".join(map(piece, x))).hexdigest() for x in split_ids], pa.string()),
            ]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            made, names = [pa.array([[int(i) for i in x.split()] for x in coded], pa.list_(pa.int32()))], ["ids"]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *names])


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input with the binary pieces of its ids concatenated; null ids give null.

    Native: the pieces are one literal array, an id is an index into it, and concat joins binary values.
    """
    ranks = read_ranks(ranks_path)
    names = [None] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        names[r] = base64.b64encode(p).decode()
    pieces = F.from_json(F.lit(json.dumps(names)), "array<string>")
    joined = F.aggregate(
        F.col(ids), F.lit("").cast("binary"), lambda done, i: F.concat(done, F.unbase64(F.element_at(pieces, i + 1)))
    )
    return coded.withColumn(out, joined)


def fold_words(words: DataFrame, ranks_path: str, word: str = "word", out: str = "ids", buckets: int = 1 << 16) -> DataFrame:
    """Ids of each distinct word (binary) by higher-order functions over a literal rank map.

    The map is a literal array of small maps, addressed by the crc32 of a piece: a look-up costs the same for
    any vocabulary size. Each step of the fold finds the lowest-ranked pair of neighbours and merges it.
    """
    ranks = read_ranks(ranks_path)
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for p, r in ranks.items():
        table[zlib.crc32(p) % buckets][p.hex().upper()] = r
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")
    none = F.lit(len(ranks) + 1)

    def rank(piece: Column) -> Column:
        slot = F.element_at(literal, (F.crc32(piece) % buckets).cast("int") + 1)
        return F.coalesce(F.element_at(slot, F.hex(piece)), none)

    def step(pieces: Column, _: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        pairs = F.transform(places, lambda i: F.struct(rank(F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))).alias("r"), i.alias("i")))
        low = F.array_min(pairs)
        merged = F.concat(
            F.slice(pieces, F.lit(1), low["i"] - 1),
            F.array(F.concat(F.element_at(pieces, low["i"]), F.element_at(pieces, low["i"] + 1))),
            F.slice(pieces, low["i"] + 2, F.size(pieces)),
        )
        return F.when((F.size(pieces) > 1), F.when(low["r"] < none, merged).otherwise(pieces)).otherwise(pieces)

    w = F.col(word)
    n = F.octet_length(w)
    singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), singles, step)
    ids = F.when(n == 0, F.array().cast("array<int>")).when(rank(w) < none, F.array(rank(w))).otherwise(F.transform(folded, rank))
    return words.withColumn(out, ids)
