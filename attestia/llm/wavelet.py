"""Token-ID output: one compressed wavelet matrix per shard of tokenized documents.

Documents are sorted by doc_id over range partitions and tokenized there; each document ends with an end id. Every
SHARD_IDS ids or more become one shard: a file that holds the doc_ids, their id counts and the bit-planes of a
wavelet matrix, each packed and compressed. Opening it rebuilds the rank directories; access, count, rank, select
and occurrence look-up work on the planes without unpacking the ids.

Shard files are single-row Parquet values written by Spark, so any shared store holds them and a lost executor
costs only its unfinished shards.

Defined results: a null or empty text has the end id only; rows that repeat a doc_id are documents of their own,
ordered by a hash of their text; a null doc_id comes first; an empty table gives an empty result; other columns are
ignored; the string of an added token is that token, as the library has it by default (with `ordinary`, it is
ordinary text). A very long text is one shard of its own, in the memory of its task (some 2 bytes of file an id); Spark holds no value of 2 GiB
or more, and a shard that would be one fails with its error.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestia.llm.bpe import GENERAL_PATTERN, Splitter
from attestia.llm.common import durable, lookup, ready, resident, shuffle_width, small_batches

SHARD_IDS = 4_000_000
MEMO_WORDS = 1_000_000
MAGIC = b"WMX1"


class Plane:
    """A packed bit sequence with a rank directory of one count for each 64 bits."""

    def __init__(self, packed: np.ndarray, n: int):
        self.n, self.packed = n, packed
        padded = np.zeros(-(-n // 64) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(">u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.ones = int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (63 - (i & 63)).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        i = np.asarray(i, np.int64)
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        have = np.append(self.words, np.uint64(0))[word]
        kept = np.where(rest > 0, have >> (np.uint64(64) - np.maximum(rest, 1)), np.uint64(0))
        return self.before[word] + np.bitwise_count(kept).astype(np.int64)

    def select(self, j: np.ndarray, one: bool) -> np.ndarray:
        """Place of the j-th (from 0) one or zero, by binary search in the directory and in its word."""
        j = np.asarray(j, np.int64)
        marks = self.before if one else np.arange(len(self.before)) * 64 - self.before
        low = np.searchsorted(marks, j, "right") - 1
        word = self.words[low] if one else ~self.words[low]
        bits = np.unpackbits(word.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        nth = (np.cumsum(bits, axis=1) <= (j - marks[low])[:, None]).sum(1)
        return low * 64 + nth


class WaveletMatrix:
    """Succinct sequence of ids: one plane for each bit, most significant first."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.depth = planes, zeros, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, depth: int) -> WaveletMatrix:
        planes, zeros = [], []
        for k in range(depth - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << k)).astype(bool)
            planes.append(Plane(np.packbits(bit), len(ids)))
            zeros.append(len(ids) - planes[-1].ones)
            ids = np.concatenate([ids.take(np.flatnonzero(~bit)), ids.take(np.flatnonzero(bit))])
        return cls(planes, zeros, len(ids))

    def all(self) -> np.ndarray:
        """Every id in order, rebuilt from the last plane to the first."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = plane.bits()
            up = np.empty_like(ids)
            up[np.flatnonzero(~bit)] = ids[:zeros]
            up[np.flatnonzero(bit)] = ids[zeros:] | kind(1 << k)
            ids = up
        return ids

    def access(self, i) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64)).copy()
        out = np.zeros(len(i), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i).astype(bool)
            rank = plane.rank(i)
            i = np.where(bit, zeros + rank, i - rank)
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among [start, end) lie below the last plane."""
        if not 0 <= token < 1 << self.depth:
            return 0, 0
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.rank(np.array([start, end])).tolist()
            start, end = (zeros + a, zeros + b) if token >> (self.depth - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the first-th to the last-th occurrence of a token, walking back up the planes."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a + first, b if last is None else min(b, a + last))
        for k in range(self.depth - 1, -1, -1):
            if not len(at):
                break
            one = bool(token >> (self.depth - 1 - k) & 1)
            at = self.planes[k].select(at - self.zeros[k] if one else at, one)
        return at

    def select(self, token: int, j: int) -> int:
        return int(self.occurrences(token, j, j + 1)[0])


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, depth: int) -> bytes:
    """One shard file."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids, depth)
    known = np.array([i is not None for i in doc_ids], bool)
    parts = [
        press(np.array([i or 0 for i in doc_ids], "<i8").tobytes()),
        press(np.packbits(known).tobytes()),
        press(lengths.astype("<i8").tobytes()),
        *[press(p.packed.tobytes()) for p in matrix.planes],
    ]
    head = struct.pack("<4sBQQ", MAGIC, depth, len(doc_ids), len(ids))
    return b"".join([head, struct.pack(f"<{len(parts)}Q", *map(len, parts)), *parts])


class Shard:
    """A shard file, opened: doc_ids, lengths and the wavelet matrix of its ids."""

    def __init__(self, data: bytes):
        import zstandard

        magic, depth, docs, n = struct.unpack_from("<4sBQQ", data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = struct.calcsize("<4sBQQ")
        sizes = struct.unpack_from(f"<{depth + 3}Q", data, at)
        at += 8 * len(sizes)
        parts = []
        for s in sizes:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + s]))
            at += s
        known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=docs)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known, strict=True)]
        self.lengths = np.frombuffer(parts[2], "<i8")
        planes = [Plane(np.frombuffer(p, np.uint8), n) for p in parts[3:]]
        self.matrix = WaveletMatrix(planes, [n - p.ones for p in planes], n)
        self.starts = np.cumsum(self.lengths) - self.lengths


class WordIds(dict):
    """Packed ids of words, each distinct word encoded once by the tokenizers library."""

    def __init__(self, definition: str, pattern: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.pending: dict[str, bytearray] = {}
        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = ordinary
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.split = Splitter(pattern)
        vocabulary = self.library.get_vocab()
        self.piece_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.piece_bytes[i] = len(piece)  # a byte-level piece has a character for each byte
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() < 1 << 16 else "<u4")
        self.depth = max(1, (self.library.get_vocab_size() - 1).bit_length())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > MEMO_WORDS:
            self.clear()
        get = self.__getitem__
        found = [[] if not t else [self.whole(t)] if self.added(t) else list(map(get, self.split(t))) for t in texts]
        fresh = list(self.pending)
        for k in range(0, len(fresh), 10_000):
            groups = [fresh[i : i + 500] for i in range(k, min(k + 10_000, len(fresh)), 500)]
            for words, e in zip(groups, self.library.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                # A word ends where its pieces have as many bytes as all words so far.
                ends = np.searchsorted(np.cumsum(self.piece_bytes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
                raw, start = ids.tobytes(), 0
                for w, end in zip(words, (ends * self.kind.itemsize).tolist(), strict=True):
                    self.pending[w] += raw[start:end]
                    start = end
        self.pending.clear()
        return [b"".join(f) for f in found]

    def whole(self, text: str) -> bytes:
        """Packed ids of a text that holds an added token, which the library cuts out before it looks for words."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytearray:
        """A place for the word's ids, filled before `encode` joins them."""
        place = self[word] = self.pending[word] = bytearray()
        return place


def shard_partition(batches, shared, end: int, shard_ids: int, partition: int):
    """Shard rows of one sorted partition."""
    coder = resident(shared.value, lambda: WordIds(*shared.value))
    stop = np.array([end], coder.kind).tobytes()
    doc_ids, coded, held, part = [], [], 0, 0

    def close():
        ids = np.frombuffer(b"".join(coded), coder.kind)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // coder.kind.itemsize
        blob = dump(doc_ids, lengths, ids, coder.depth)
        return pa.RecordBatch.from_arrays(
            [pa.array([partition << 32 | part], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
            ["shard", "n_docs", "n_ids", "file"],
        )

    for rows in small_batches(batches, 2 << 20):
        for i, c in zip(rows.column(0).to_pylist(), coder.encode(rows.column(1).to_pylist()), strict=True):
            doc_ids.append(i)
            coded.append(c + stop)
            held += len(coded[-1]) // coder.kind.itemsize
            if held >= shard_ids:
                yield close()
                doc_ids, coded, held, part = [], [], 0, part + 1
    if doc_ids:
        yield close()


def write_shards(
    docs: DataFrame, tokenizer_path: str, end: int = 0, text: str = "text", shard_ids: int = SHARD_IDS, ordinary: bool = False
) -> DataFrame:
    """The written shard table: shard (ascending with doc_id), n_docs, n_ids and file."""
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer_path) as f:
        shared = spark.sparkContext.broadcast((f.read(), GENERAL_PATTERN, ordinary))

    def run(batches):
        from pyspark import TaskContext

        from attestia.llm import wavelet

        yield from wavelet.shard_partition(batches, shared, end, shard_ids, TaskContext.get().partitionId())

    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
        .withColumn("_th", F.xxhash64("_text"))  # deals out the rows of one doc_id
        .repartitionByRange(shuffle_width(spark, docs, 32 << 20), "doc_id", "_th")
        .sortWithinPartitions("doc_id", "_th", "_text")
        .drop("_th")
    )
    return durable(ranged.mapInArrow(run, "shard long, n_docs long, n_ids long, file binary"), "shards")


def documents(shards: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ids_crc32 of every document."""
    ready(shards.sparkSession)

    def run(batches):
        import zlib

        from attestia.llm import wavelet

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = wavelet.Shard(data.as_py())
                ids = file.matrix.all().astype("<u4")
                ends = file.starts + file.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(file.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(crc), pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(file.starts, pa.int64()), pa.array(file.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "_at", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard file
    starts = durable(shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_from")), "shard-starts")
    rows = shards.select("shard", "file").mapInArrow(run, "shard long, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return lookup(rows, starts, "shard", F.col("_at")).select("doc_id", (F.col("_from") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
