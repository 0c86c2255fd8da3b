"""Exact top-k inner-product search with vector-approximation files.

1. The approximation file. Candidates are dealt into blocks, every component is quantised into CELLS cells of equal width, and each
   block's cells, one byte a component, are written as one row of a table. Of a block's equal vectors only the rows of the k + 1
   least ids can be among anyone's k best (ties go to the smaller id), so a vector that half of all rows share stays small.
2. Thresholds. A sample of the blocks (one in SAMPLE) is searched exactly; the k-th score of a query there is one that its k-th score
   overall can't fall below.
3. The scan. Each block of cells meets each panel of queries: one product in single precision gives every pair the score of the cell's
   middle, and half a cell's width in every component makes it an upper bound (the lower bound of the distance). Pairs
   whose bound reaches the query's threshold are kept; no exact vector is read.
4. Exact vectors are read in the order of the bounds: first those of the FIRST * k highest bounds of each query, whose k-th score is a new
   threshold, then those of the bounds that reach it. Every bound that is left lies below the k-th score, which makes it certain.

Vectors are integers here: `floor(scale * x)`, saturated to 64 bits. Scores are exact: products run in float64 where all partial sums
stay below 2**53, else in Python integers, saturated to 64 bits.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
an id; vectors of another length than the query's are no candidates for it, nor are rows of the query's own id; every
other row is one, so rows that repeat an id are candidates of their own, and queries that repeat an id share the k best
of all; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.llm.common import durable, ready

CELLS = 256
#: Vector components in a block of candidates, and the fewest blocks.
BLOCK_VALUES, LEAST_BLOCKS = 2 << 20, 48
#: Queries compared at once, queries in a panel, and exact vectors read for each query in a step.
QUERY_ROWS, PANEL, STEP = 256, 2048, 64
#: One block in so many is searched for thresholds, and so many times k bounds are read before the others.
SAMPLE, FIRST = 16, 2
LIMIT = 1 << 53


def clean(rows: DataFrame, vec_id: str, vector: str, scale: float, queries: Column) -> DataFrame:
    """_row (a number of its own, fixed once it is written), _id, _v (floored, scaled doubles) and _ask (is a query) of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(vec_id).cast("long").alias("_id"),
        F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("_v"),
        F.coalesce(queries, F.lit(False)).alias("_ask"),
    )


class Block:
    """One block of candidates of one length: exact vectors and their cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        low, high = vectors.min(0), vectors.max(0)
        self.width = (high - low) / CELLS
        cell = (self.vectors - low) / np.where(self.width > 0, self.width, 1)
        self.cells = np.clip(cell, 0, CELLS - 1).astype(np.uint8)
        self.middle = low + self.width / 2
        self.reach = np.abs(self.vectors).max(initial=0.0)

    @classmethod
    def stored(cls, cells: bytes, low: bytes, width: bytes, reach: float) -> Block:
        """A block of which only the cells were read."""
        self = cls.__new__(cls)
        low, self.width = np.frombuffer(low), np.frombuffer(width)
        self.cells = np.frombuffer(cells, np.uint8).reshape(-1, len(low)) if len(low) else np.zeros((len(cells), 0), np.uint8)
        self.middle, self.reach, self.ids = low + self.width / 2, reach, np.zeros(len(self.cells))
        return self

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, widened by what float arithmetic may lose."""
        steps = queries * self.width
        # Single precision holds 24 bits; scaled so that no step overflows it.
        scale = np.maximum(np.abs(steps).max(1, initial=0.0), 1e-300)[:, None]
        narrow = (steps / scale).astype(np.float32)
        out = np.empty((len(queries), len(self.ids)))
        rows = max(256, (1 << 20) // max(1, self.cells.shape[1]))
        for k in range(0, len(self.ids), rows):
            out[:, k : k + rows] = narrow @ self.cells[k : k + rows].astype(np.float32).T
        d = self.cells.shape[1]
        lost = (d + 2) * 2.0**-22 * CELLS * np.abs(narrow).sum(1)[:, None].astype(np.float64) * scale
        slack = np.abs(queries).sum(1) * self.reach * 1e-12
        reach = queries @ self.middle + np.abs(steps).sum(1) / 2 * (1 + 1e-9) + slack
        return out * scale + lost + reach[:, None]

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if np.abs(query).max(initial=0.0) * self.reach * max(1, len(query)) < LIMIT:
            return (self.vectors[rows] @ query).astype(np.int64)
        q = [int(x) for x in query]
        most, least = (1 << 63) - 1, -(1 << 63)
        return np.array([min(most, max(least, sum(int(a) * b for a, b in zip(v, q, strict=True)))) for v in self.vectors[rows]], np.int64)

    def best(self, own: int, query: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates but the query's own, ties to the smaller id."""
        bound = np.where(self.ids == own, -np.inf, bound)
        usable = len(self.ids) - int((self.ids == own).any())
        k = min(k, usable)
        if not k:
            return []
        read, n = [], min(usable, max(STEP, 2 * k))
        scores, rows, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while True:
            near = np.argpartition(-bound, n - 1)[:n] if n < len(bound) else np.arange(len(bound))
            near = near[np.isfinite(bound[near])]
            fresh = np.setdiff1d(near, rows, assume_unique=True) if done else near
            scores, rows = np.append(scores, self.exact(query, fresh)), np.append(rows, fresh)
            done = len(rows)
            order = np.lexsort((self.ids[rows], ~scores))[:k]
            read = [(int(scores[i]), int(self.ids[rows[i]])) for i in order]
            if done >= usable:
                return read
            left = bound.copy()
            left[rows] = -np.inf
            if left.max() < read[-1][0]:
                return read
            n = min(usable, max(2 * n, int((bound >= read[-1][0]).sum())))


def _matrices(batch: pa.RecordBatch):
    """(is query, length, keys, ids, vectors) for each vector length in a batch, candidates first."""
    vectors = batch.column("_v")
    ids, keys = batch.column("_id").to_numpy(), batch.column("_key").to_numpy()
    asks = batch.column("_q").to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for q in (False, True):
        for d in np.unique(lengths):
            if len(at := np.flatnonzero((lengths == d) & (asks == q))):
                yield q, int(d), keys[at], ids[at], flat[starts[at][:, None] + np.arange(d)]


def search_block(batches, k: int):
    """Best of each query among one partition's candidates, which come first."""
    gathered: dict[int, list] = {}
    blocks: dict[int, Block] | None = None
    for batch in batches:
        for asks, d, keys, ids, vectors in _matrices(batch):
            if not asks:
                gathered.setdefault(d, []).append((ids, vectors))
                continue
            if blocks is None:
                blocks = {n: Block(np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x])) for n, x in gathered.items()}
                gathered.clear()
            if d in blocks:
                yield from _answers(blocks[d], keys, ids, vectors, k)


def _answers(block: Block, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
    for i in range(0, len(ids), QUERY_ROWS):
        part, own, q = keys[i : i + QUERY_ROWS].tolist(), ids[i : i + QUERY_ROWS].tolist(), queries[i : i + QUERY_ROWS]
        found = [(a, s) for a, o, v, b in zip(part, own, q, block.bounds(q), strict=True) for s, _ in block.best(o, v, b, k)]
        if found:
            asks, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(asks, pa.int64()), pa.array(scores, pa.int64())], ["_ask", "score"])


CELL_FILE = "_b int, _d int, _rows array<long>, _ids array<long>, _cells binary, _low binary, _width binary, _reach double"


def contenders(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows that can be among the k best of any query: of equal vectors those of the k + 1 least ids, k of each id."""
    if len(ids) <= k:
        return np.arange(len(ids))
    packed = np.ascontiguousarray(vectors).view(f"V{8 * vectors.shape[1]}").ravel() if vectors.shape[1] else np.zeros(len(ids), "V8")
    _, group = np.unique(packed, return_inverse=True)
    by = np.lexsort((ids, group))
    g, i = group[by], ids[by]
    fresh = np.append(True, g[1:] != g[:-1])  # the first of its vector
    other = fresh | np.append(True, i[1:] != i[:-1])  # the first of its vector and id
    turn, place = np.cumsum(other), np.arange(len(by))
    rank = turn - turn[fresh][np.cumsum(fresh) - 1]
    copy = place - place[other][turn - 1]
    return np.sort(by[(rank <= k) & (copy < k)])


def cell_rows(batches, k: int):
    """The cells of one partition's vectors, a row for each block and length."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        vectors = batch.column("_v")
        lengths = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
        number, row, ids = (batch.column(c).to_numpy() for c in ("_b", "_row", "_id"))
        for b, d in {(int(x), int(y)) for x, y in zip(number, lengths, strict=True)}:
            at = np.flatnonzero((number == b) & (lengths == d))
            held.setdefault((b, d), []).append((row[at], ids[at], flat[starts[at][:, None] + np.arange(d)]))
    for (b, d), parts in held.items():
        rows, ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        chosen = contenders(ids, vectors, k)
        rows, ids, vectors = rows[chosen], ids[chosen], vectors[chosen]
        block = Block(np.arange(len(ids)), vectors)  # keeps the order of its rows
        # An empty vector has no byte to tell its row by.
        cells = block.cells.tobytes() if d else bytes(len(ids))
        low = np.ascontiguousarray(block.middle - block.width / 2)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.float64())
        values = (b, d, rows.tolist(), ids.tolist(), cells, low.tobytes(), np.ascontiguousarray(block.width).tobytes(), float(block.reach))
        names = [x.split()[0] for x in CELL_FILE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def scan(batches):
    """Pairs of a query and a candidate whose bound reaches the query's threshold, of tiles of cells and query panels."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            block = Block.stored(*(row[n].as_py() for n in ("_cells", "_low", "_width", "_reach")))
            rows, ids = (np.array(row[n].as_py(), np.int64) for n in ("_rows", "_ids"))
            panel = batch.column("_panel").slice(i, 1).flatten()
            asks, own, vectors, least = (panel.field(n) for n in range(4))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(panel), -1) if row["_d"].as_py() else np.zeros((len(panel), 0))
            asks, own, least = asks.to_numpy(), own.to_numpy(), least.to_numpy(zero_copy_only=False)
            for k in range(0, len(panel), QUERY_ROWS):
                part = slice(k, k + QUERY_ROWS)
                bounds = block.bounds(flat[part])
                q, c = np.nonzero((bounds >= least[part][:, None]) & (own[part][:, None] != ids[None]))
                for j in range(0, len(q), 100_000):
                    x, y = q[j : j + 100_000], c[j : j + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(asks[part][x]), pa.array(rows[y]), pa.array(bounds[x, y])], ["_ask", "_row", "_bound"])


def scores(batches):
    """_ask, _id and exact score of pairs of vectors (_q, _v) of one length."""
    for batch in batches:
        q, v = batch.column("_q"), batch.column("_v")
        lengths = np.diff(v.offsets.to_numpy())
        a, b = q.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        reach = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, int(lengths.max(initial=0)))
        if reach < LIMIT:
            ends = np.concatenate([[0], np.cumsum(a * b)]) if reach * max(1, batch.num_rows) < LIMIT else None
            edges = np.cumsum(np.append(0, lengths))
            if ends is not None:
                found = (ends[edges[1:]] - ends[edges[:-1]]).astype(np.int64)
            else:
                found = np.array([int(a[i:j] @ b[i:j]) for i, j in zip(edges, edges[1:], strict=False)], np.int64)
        else:
            most, least = (1 << 63) - 1, -(1 << 63)
            found = np.array([min(most, max(least, sum(int(x) * int(y) for x, y in zip(m, n, strict=True)))) for m, n in zip(q.to_pylist(), v.to_pylist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_ask"), batch.column("_own"), batch.column("_id"), pa.array(found)], ["_ask", "_own", "_id", "score"])


def sampled(points: DataFrame, asks: DataFrame, blocks: int, k: int) -> DataFrame:
    """_ask and _least: the k-th score of each query among the rows of one block in SAMPLE."""
    chosen = max(1, blocks // SAMPLE)
    spread = F.explode(F.sequence(F.lit(0), F.lit(chosen - 1)))
    candidates = points.filter(F.col("_b") % SAMPLE == 0).select((F.col("_b") / SAMPLE).cast("int").alias("_b"), F.lit(False).alias("_q"), F.col("_row").alias("_key"), "_id", "_v")
    asking = asks.select(spread.alias("_b"), F.lit(True).alias("_q"), F.col("_ask").alias("_key"), F.col("_own").alias("_id"), "_v")

    def run(batches):
        from attestia.llm import vafile

        yield from vafile.search_block(batches, k)

    near = candidates.filter(F.col("_b") < chosen).unionByName(asking).repartitionById(chosen, "_b").sortWithinPartitions("_q").select("_q", "_key", "_id", "_v").mapInArrow(run, "_ask long, score long")
    rank = F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("score")))
    return near.withColumn("_n", rank).filter(F.col("_n") == k).select("_ask", F.col("score").cast("double").alias("_least"))


def search(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of every row for which `queries` holds.

    A block holds about BLOCK_VALUES vector components, a panel about PANEL queries.
    """
    spark = vectors.sparkSession
    ready(spark)
    points = durable(clean(vectors, vec_id, vector, scale, queries), "vectors")
    values, wanted = points.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0)), F.count_if("_ask")).first()  # two numbers
    blocks, panels = max(LEAST_BLOCKS, -(-values // BLOCK_VALUES)), max(1, -(-wanted // PANEL))
    useful = points.select("_row", "_id", "_v", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_b"))
    asks = points.filter("_ask").select(F.col("_row").alias("_ask"), F.col("_id").alias("_own"), "_v")

    def write(batches):
        from attestia.llm import vafile

        yield from vafile.cell_rows(batches, k)

    cells = durable(useful.repartitionById(blocks, "_b").select("_b", "_row", "_id", "_v").mapInArrow(write, CELL_FILE), "cells")
    least = durable(sampled(useful, asks, blocks, k), "thresholds")
    known = asks.join(least, "_ask", "left").withColumn("_least", F.coalesce("_least", F.lit(float("-inf"))))
    panel = F.collect_list(F.struct("_ask", "_own", "_v", "_least")).alias("_panel")
    grouped = known.groupBy(F.size("_v").alias("_d"), F.pmod(F.xxhash64("_ask"), F.lit(panels)).cast("int").alias("_g")).agg(panel)
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    tiles = cells.select("*", spread(panels, "_g")).join(grouped.select("*", spread(blocks, "_b")), ["_b", "_g", "_d"])

    def bound(batches):
        from attestia.llm import vafile

        yield from vafile.scan(batches)

    def score(batches):
        from attestia.llm import vafile

        yield from vafile.scores(batches)

    found = tiles.select("_d", "_rows", "_ids", "_cells", "_low", "_width", "_reach", "_panel").mapInArrow(bound, "_ask long, _row long, _bound double")
    turn = F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("_bound"), "_row"))
    near = durable(found.withColumn("_turn", turn), "near")

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.select("_ask", "_row").join(useful.select("_row", "_id", "_v"), "_row").join(asks.withColumnRenamed("_v", "_q"), "_ask")
        return durable(both.select("_ask", "_own", "_id", "_q", "_v").mapInArrow(score, "_ask long, _own long, _id long, score long"), "exact")

    first = exact(near.filter(F.col("_turn") <= FIRST * k))
    place = F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("score")))
    sure = first.withColumn("_n", place).filter(F.col("_n") == k).select("_ask", F.col("score").alias("_kth"))
    rest = near.filter(F.col("_turn") > FIRST * k).join(sure, "_ask", "left").filter(F.col("_kth").isNull() | (F.col("_bound") >= F.col("_kth")))
    whole = first.unionByName(exact(rest)).select(F.col("_own").alias("query_id"), F.col("_id").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return whole.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
