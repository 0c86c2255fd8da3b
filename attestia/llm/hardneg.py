"""Hard negatives by a blocked matrix product of anchors and rows (SUMMA).

Rows are dealt by label groups into blocks of about BLOCK rows, anchors into blocks of about ANCHORS, and their
components into chunks of CHUNK dimensions. A panel is one block and chunk. Each pair of an anchor block and a row block is
a tile: it gets both panels of every chunk, multiplies them to a partial tile of 64-bit scores, and a shuffle adds the
partial tiles of all chunks, one at a time. Tiles within a label group give each anchor's best rows of the same label,
and a window keeps its positives. Tiles across groups (and within groups of several labels) then give, for each anchor
and positive, the best rows of other labels inside the score window; a second window keeps the best of all tiles.
A label of any size is only more blocks, and nothing but counts of blocks is held whole.

Vectors are integers here: `floor(scale * x)`, saturated to 64 bits, as are scores. Products run in float64 where all sums stay below 2**53, else
in Python integers.

Defined results: rows whose label, id or vector is null, or whose vector holds null or non-finite components, take no
part. Rows of an anchor's own id are no candidates for it, nor are vectors of another length; rows that repeat an id
are anchors and candidates of their own. Higher scores come first, ties by the smaller id. An anchor without positives, or a pair
without rows in its window, gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.llm.common import durable, lookup, ready, shuffle_width

BLOCK, ANCHORS, CHUNK = 2048, 256, 32
#: Groups into which labels are hashed; pairs of the same label meet within one.
GROUPS = 64
LIMIT, MOST = 1 << 53, (1 << 63) - 1


def clean(rows: DataFrame, anchors: Column, label: Column, vec_id: str, vector: str, scale: float) -> DataFrame:
    """_row (a number of its own), _id, _label, _v (integers), _ask (is an anchor) and _dg of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite
    found = rows.filter(usable).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(vec_id).cast("long").alias("_id"),
        label.cast("long").alias("_label"),
        F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("_v"),
        F.coalesce(anchors, F.lit(False)).alias("_ask"),
    )
    group = F.concat_ws(":", F.size("_v"), F.pmod(F.xxhash64("_label"), F.lit(GROUPS)))
    return durable(found.withColumn("_dg", group), "hardneg")  # _row is fixed by writing it


def panels(points: DataFrame, groups: DataFrame, blocks: str, name: str) -> DataFrame:
    """Panels of a side: block name, group, chunk and its rows in the order of their numbers."""
    placed = lookup(points, groups.select("_dg", blocks), "_dg", F.col("_row"))
    block = F.concat_ws(":", "_dg", F.pmod(F.xxhash64("_row"), F.col(blocks)))
    count = F.greatest(F.lit(1), F.ceil(F.size("_v") / CHUNK).cast("int"))
    cut = placed.select(block.alias(name), F.explode(F.sequence(F.lit(0), count - 1)).alias("_k"), "_row", "_id", "_label", "_v")
    part = F.slice("_v", F.col("_k") * CHUNK + 1, F.lit(CHUNK)).alias("_part")
    rows = F.sort_array(F.collect_list(F.struct("_row", "_id", "_label", part))).alias(f"{name}_rows")
    return durable(cut.groupBy(name, "_k").agg(rows), name)


def tile_table(groups: DataFrame) -> DataFrame:
    """A row for each anchor block and row block of one vector length; alike: one group, mixed: it has several labels."""
    length = F.substring_index("_dg", ":", 1).alias("_d")
    anchors = groups.filter("_asks > 0").select(length, F.col("_dg").alias("_ga"), F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_a"))
    rows = groups.select(length, F.col("_dg").alias("_gc"), "_mixed", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("_c"))
    return anchors.join(rows, "_d").select(
        F.concat_ws(":", "_ga", "_a").alias("_anchors"),
        F.concat_ws(":", "_gc", "_c").alias("_block"),
        (F.col("_ga") == F.col("_gc")).alias("_alike"),
        "_mixed",
    )


def _panel(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids, labels and the matrix of one panel."""
    number, ids, labels, parts = (rows.field(i) for i in range(4))
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    return number.to_numpy(), ids.to_numpy(), labels.to_numpy(), flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, saturated to 64 bits."""
    reach = float(np.abs(a.astype(np.float64)).max(initial=0.0)) * float(np.abs(b.astype(np.float64)).max(initial=0.0)) * max(1, a.shape[1])
    if reach < LIMIT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
    return np.array([[max(-MOST - 1, min(MOST, s)) for s in row] for row in exact], np.int64)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two tiles, saturated."""
    with np.errstate(over="ignore"):
        s = a + b
    over = ((a ^ s) & (b ^ s)) < 0
    return np.where(over, np.where(a < 0, -MOST - 1, MOST), s) if over.any() else s


def multiply(batches):
    """Partial tiles of pairs of panels, with the rows of both sides beside the first chunk's."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            a = row.column("_anchors_rows").flatten()
            c = row.column("_block_rows").flatten()
            (na, ia, la, ma), (_, ic, lc, mc) = _panel(a), _panel(c)
            lead = row.column("_k")[0].as_py() == 0
            whole = lambda x, lead=lead: pa.array([x.tolist() if lead else None], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [row.column("_anchors"), row.column("_block"), row.column("_k"), pa.array([product(ma, mc).tobytes()], pa.binary()), whole(na), whole(ia), whole(la), whole(ic), whole(lc), row.column("_asked")],
                ["_anchors", "_block", "_k", "_tile", "_na", "_ia", "_la", "_ic", "_lc", "_asked"],
            )


ASKED = "array<struct<_row:long,_turn:long,positive_id:long,positive_score:long>>"
PARTIAL = f"_anchors string, _block string, _k int, _tile binary, _na array<long>, _ia array<long>, _la array<long>, _ic array<long>, _lc array<long>, _asked {ASKED}"


def sums(batches):
    """Tiles in order of their name: name, rows of both sides, scores and the anchors' windows."""
    name = heads = total = asked = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            own = (row["_anchors"].as_py(), row["_block"].as_py())
            part = np.frombuffer(row["_tile"].as_buffer(), np.int64)
            if own != name:
                if name is not None:
                    yield name, heads, total.reshape(len(heads[0]), -1), asked
                name, total = own, part.copy()
                heads = [np.array(row[n].as_py(), np.int64) for n in ("_na", "_ia", "_la", "_ic", "_lc")]
                asked = row["_asked"].as_py()
            else:
                total = added(total, part)
    if name is not None:
        yield name, heads, total.reshape(len(heads[0]), -1), asked


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k entries of `at` with the highest scores, ties to the smaller id."""
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def _table(rows: list[tuple], names: list[str]):
    if rows:
        kinds = [pa.string() if n == "_anchors" else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


POSITIVE = ["_anchors", "_row", "anchor_id", "positive_id", "positive_score"]
NEGATIVE = ["_row", "_turn", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def alike(batches, k: int):
    """Of each tile, each anchor's k best rows of the same label."""
    for (block, _), (number, ids, labels, others, theirs), scores, _ in sums(batches):
        found = []
        for i in range(len(number)):
            s = scores[i]
            for j in best(s, others, np.flatnonzero((theirs == labels[i]) & (others != ids[i])), k):
                found.append((block, int(number[i]), int(ids[i]), int(others[j]), int(s[j])))
        yield from _table(found, POSITIVE)


def window(positive: int, low: int, high: int, of: int) -> tuple[int, int]:
    """Scores s with low * positive <= of * s <= high * positive, as bounds; empty if the first is above the second."""
    return -(-low * positive // of), high * positive // of


def apart(batches, k: int, low: int, high: int, of: int):
    """Of each tile, the k best rows of other labels in the window of each anchor and positive."""
    for _, (number, ids, labels, others, theirs), scores, asked in sums(batches):
        place = {n: i for i, n in enumerate(number.tolist())}
        found = []
        for x in asked or []:
            i = place[x["_row"]]
            least, most = window(x["positive_score"], low, high, of)
            if least > most:
                continue
            s = scores[i]
            for j in best(s, others, np.flatnonzero((theirs != labels[i]) & (others != ids[i]) & (s >= least) & (s <= most)), k):
                found.append((x["_row"], x["_turn"], int(ids[i]), x["positive_id"], x["positive_score"], int(others[j]), int(s[j])))
        yield from _table(found, NEGATIVE)


def mine(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    ratio: tuple[int, int, int] = (30, 90, 100),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are its best rows of the same label; for each of them the best rows of other labels are returned whose score
    is between the first and the second ratio (both over the third) of the positive's.
    """
    spark = rows.sparkSession
    ready(spark)
    points = clean(rows, anchors, label, vec_id, vector, scale)
    counts = points.groupBy("_dg").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_ask").alias("_asks"), (F.min("_label") < F.max("_label")).alias("_mixed")
    )
    whole = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    groups = durable(counts.withColumn("_na", whole("_asks", ANCHORS)).withColumn("_nc", whole("_n", BLOCK)), "groups")
    left = panels(points.filter("_ask"), groups, "_na", "_anchors")
    right = panels(points, groups, "_nc", "_block")
    tiles = durable(tile_table(groups), "tiles")

    def summed(of: DataFrame, panels: DataFrame, run, schema: str) -> DataFrame:
        pairs = panels.join(of, "_anchors").join(right, ["_block", "_k"]).select("_anchors", "_block", "_k", "_anchors_rows", "_block_rows", "_asked")
        partial = pairs.mapInArrow(multiply, PARTIAL)
        width = shuffle_width(spark)
        return partial.repartition(width, "_anchors", "_block").sortWithinPartitions("_anchors", "_block", "_k").mapInArrow(run, schema)

    same = summed(
        tiles.filter("_alike").select("_anchors", "_block"),
        left.withColumn("_asked", F.lit(None).cast(ASKED)),
        lambda batches: alike(batches, positives),
        "_anchors string, _row long, anchor_id long, positive_id long, positive_score long",
    )
    turn = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = same.withColumn("_turn", turn.cast("long")).filter(F.col("_turn") <= positives)
    asked = durable(chosen.groupBy("_anchors").agg(F.collect_list(F.struct("_row", "_turn", "positive_id", "positive_score")).alias("_asked")), "asked")
    other = summed(
        tiles.filter("not _alike or _mixed").select("_anchors", "_block"),
        left.join(asked, "_anchors").withColumn("_asked", F.when(F.col("_k") == 0, F.col("_asked"))),
        lambda batches: apart(batches, negatives, *ratio),
        "_row long, _turn long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    rank = F.row_number().over(Window.partitionBy("_row", "_turn").orderBy(F.desc("negative_score"), "negative_id"))
    return (
        other.withColumn("rank", rank)
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
