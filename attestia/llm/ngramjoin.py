"""Exact n-gram Jaccard join of documents through a token-group matrix, and its connected components.

Two documents link when den * |A and B| >= num * |A or B| for their sets of distinct n-word shingles.

1. Grouping. For linked sets the symmetric difference is at most H, so when shingles are dealt by hash into more
   than H parts, one part is equal in both. Documents with an equal, non-empty part form a group of similar
   documents (sizes are split into classes in which H is fixed; a document deals itself for its own class and the
   one below). Groups chained over common members are clusters; links never leave a cluster. Equal sets are
   reduced to their first document beforehand, in each batch and then over all.
   Passages shared by many documents can chain large clusters of documents that are not similar. Large clusters are
   therefore grouped again, among themselves, by their rarest shingles: the members count the documents of each
   shingle, and linked documents share one of their rarest n - ceil(num * n / den) + 1.
2. Token-group matrix. Within a cluster (or a pair of its blocks, where it is large) documents are sorted by their
   least shingle and cut into groups of GROUP; the matrix has a row for each group: the union of its tokens. A
   query's overlap with a row bounds its overlap with every member, so only groups that can reach the threshold
   and are not yet connected to the query are opened and compared exactly.
   Members of a large cluster first meet a few representatives of it. Where these link nearly all, as in a group of near
   copies, only the members left apart are compared with the others, so that texts are not copied for all pairs of blocks.
3. Components. Small clusters are settled where they are; links of large ones meet in a distributed components
   step.

No step emits the pairs within a group, no group is capped, and hashes are of 64 bits (sets: 128).

Defined results: documents without words (or text) have no shingles and link with nothing; rows without doc_id
link with nothing and have no component; rows that share a doc_id are one node with all their links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm import hashing
from attestia.llm.common import broadcastable, durable, lookup, ready, shuffle_width
from attestia.llm.components import Forest, components

GROUP = 16
#: A cluster of more documents or shingles is dealt into blocks; a block holds about so many.
CLUSTER_DOCS, BLOCK_DOCS, MOST_BLOCK_DOCS, BLOCK_TOKENS = 192, 124, 2_048, 1_000_000
SLICE = 1 << 19
#: Members of a large cluster that all others are compared with first.
REPRESENTATIVES = 3


class Scheme:
    """Size classes, numbers of parts and tolerated differences for a threshold num / den."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        first = [1]
        while first[-1] <= largest:
            first.append(first[-1] * den // num + 1)
        self.first = np.array(first + [first[-1] * den // num + 1])
        self.differ = (den - num) * (self.first[1:] - 1) // num
        # Spare parts let a document leave out its empty parts: a link still has an equal part that is not empty.
        self.parts = np.where(self.differ == 0, 1, self.differ + 3 + self.differ // 12)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of every set, and the set (its place) that each belongs to."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    used = np.flatnonzero(sizes)
    if not len(used):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    scheme = Scheme(num, den, int(sizes.max()))
    tokens = np.concatenate([sets[i] for i in used])
    low, high = (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), (tokens >> np.uint64(32)).astype(np.float64)
    # Another bijection than the one summed up deals the tokens out.
    dealt = hashing.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(33)
    each = sizes[used]
    own = scheme.of(each)
    out, owner = [], []
    for space, live in ((own, own >= 0), (own - 1, own >= 1)):
        space = np.maximum(space, 0)
        parts = np.where(live, scheme.parts[space], 0)
        base = np.cumsum(parts) - parts
        keep = np.repeat(live, each)
        place = (dealt[keep] % np.repeat(np.maximum(parts, 1), each)[keep].astype(np.uint64)).astype(np.int64) + np.repeat(base, each)[keep]
        total = int(parts.sum())
        n = np.bincount(place, minlength=total)
        a = np.bincount(place, low[keep], total).astype(np.uint64)
        b = np.bincount(place, high[keep], total).astype(np.uint64)
        who = np.repeat(np.arange(len(used)), parts)
        part = np.arange(total) - base[who]
        empty = np.bincount(who, n == 0, len(used)) if total else np.zeros(len(used))
        spare = scheme.parts[space] - 1 - scheme.differ[space]
        told = (n > 0) | (empty > spare)[who]
        label = (space[who].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64)
        h = hashing.mix(hashing.mix(hashing.mix(a + np.uint64(1)) + b * np.uint64(3)) + hashing.mix(label) + n.astype(np.uint64))
        out.append(h[told])
        owner.append(used[who[told]])
    return np.concatenate(out), np.concatenate(owner)


def _dealt(kind: int, keys: np.ndarray, bins: int, *columns: np.ndarray):
    """Packed rows (bin, kind, columns) of arrays dealt by key."""
    to = (keys % np.uint64(bins)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(bins + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield (b, kind, *[c[edges[b] : edges[b + 1]].tobytes() for c in columns], *[b""] * (3 - len(columns)))


def sketch_batch(batch: pa.RecordBatch, n: int, num: int, den: int, bins: int):
    """Packed rows of a batch of (doc_id, bytes): signatures of sets (0), sets (1) and documents (2)."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for a, b in hashing.slices(texts, lambda t: len(t or b"") + 64, SLICE):
        sets = hashing.shingle_sets(texts[a:b], n)
        docs = np.array([i or 0 for i in ids[a:b]], np.int64)
        named = np.array([i is not None for i in ids[a:b]], bool)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        sums = np.array([(s.sum(), hashing.mix(s).sum()) for s in sets], np.uint64).reshape(-1, 2)
        first: dict[tuple, int] = {}
        keys = [(*k, m) for k, m in zip(sums.tolist(), sizes.tolist(), strict=True)]
        live = (sizes > 0) & named
        for i in np.flatnonzero(live).tolist():
            d = int(docs[i])
            first[keys[i]] = min(first.get(keys[i], d), d)
        same = np.array([first[k] if ok else int(d) for k, ok, d in zip(keys, live.tolist(), docs, strict=True)], np.int64)
        lead = np.flatnonzero(live & (same == docs))
        lead = lead[np.unique(sums[lead], axis=0, return_index=True)[1]] if len(lead) else lead
        rows = []
        sig, owner = signatures([sets[i] for i in lead], num, den)
        rows += _dealt(0, hashing.mix(sig), bins, sig, docs[lead][owner])
        rows += _dealt(1, hashing.mix(sums[lead, 0] + sizes[lead].astype(np.uint64)), bins, np.ascontiguousarray(sums[lead]), docs[lead], sizes[lead])
        rows += _dealt(2, np.full(len(docs), hashing.mix(docs[:1].view(np.uint64))[0]), bins, docs, same, np.where(named, sizes, -1 - sizes))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bin", "kind", "a", "b", "c"])


def _leaders(order: np.ndarray, fresh: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of equal keys: (document, least document) for all but the least."""
    docs = docs[order]
    starts = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))
    other = docs != least
    return docs[other], least[other]


def bin_rows(batches):
    """Of one bin: documents (kind 2: doc, first equal in its batch, size, below 0 without doc_id), equal sets (1) and group links (0)."""
    held: dict[int, list] = {0: [], 1: [], 2: []}
    for batch in batches:
        kinds, a, b, c = (batch.column(x).to_pylist() for x in ("kind", "a", "b", "c"))
        for k, *x in zip(kinds, a, b, c, strict=True):
            held[k].append(x)
    found = []
    for x in held[2]:
        docs, same, sizes = (np.frombuffer(y, np.int64) for y in x)
        found.append((2, docs, same, sizes))
    if held[1]:
        sums = np.frombuffer(b"".join(x[0] for x in held[1]), np.uint64).reshape(-1, 2)
        docs, sizes = (np.frombuffer(b"".join(x[i] for x in held[1]), np.int64) for i in (1, 2))
        order = np.lexsort((sizes, sums[:, 1], sums[:, 0]))
        rows = np.column_stack([sums, sizes.astype(np.uint64)])[order]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
        doc, least = _leaders(order, fresh, docs)
        found.append((1, *np.unique(np.column_stack([doc, least]), axis=0).T, np.zeros(0)))
    if held[0]:
        sig = np.frombuffer(b"".join(x[0] for x in held[0]), np.uint64)
        docs = np.frombuffer(b"".join(x[1] for x in held[0]), np.int64)
        order = np.argsort(sig, kind="stable")
        ranked = sig[order]
        doc, least = _leaders(order, np.concatenate([[True], ranked[1:] != ranked[:-1]]), docs)
        found.append((0, *np.unique(np.column_stack([doc, least]), axis=0).T, np.zeros(0)))
    for kind, x, y, n in found:
        size = n if kind == 2 else np.zeros(len(x), np.int64)
        for i in range(0, len(x), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x[part]), kind), pa.int32()), *[pa.array(v[part], pa.int64()) for v in (x, y, size)]], ["kind", "x", "y", "n"]
            )


def spread_tokens(batch: pa.RecordBatch, n: int, bins: int):
    """Packed (bin, tokens, documents) of a batch of (doc_id, bytes), dealt by token."""
    ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    for a, b in hashing.slices(texts, lambda t: len(t or b"") + 64, SLICE):
        sets = hashing.shingle_sets(texts[a:b], n)
        tokens = np.concatenate(sets)
        docs = np.repeat(ids[a:b], [len(s) for s in sets])
        yield from _packed(_dealt(0, tokens, bins, tokens, docs))


def _packed(rows):
    rows = list(rows)
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bin", "kind", "a", "b", "c"])


def _unpacked(batches, kind: int | None = None) -> list[tuple]:
    return [x[1:] for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True) if kind is None or x[0] == kind]


def _join_bytes(rows: list[tuple], k: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), kind)


def count_tokens(batches, bins: int):
    """Of one bin of tokens: those of two documents or more (0: tokens, documents, counts), and how many others a
    document has (1: numbers, documents), dealt by document."""
    rows = _unpacked(batches)
    if not rows:
        return
    tokens, docs = _join_bytes(rows, 0, np.uint64), _join_bytes(rows, 1, np.int64)
    rows.clear()
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    n = np.diff(np.append(starts, len(tokens)))
    df = np.repeat(n, n)
    alone, number = np.unique(docs[df == 1], return_counts=True)
    deal = lambda d: hashing.mix(d.view(np.uint64))
    yield from _packed(_dealt(1, deal(alone), bins, number, alone))
    many = df > 1
    yield from _packed(_dealt(0, deal(docs[many]), bins, tokens[many], docs[many], df[many]))


def rarest_tokens(batches, num: int, den: int, bins: int):
    """Of one bin of documents: their rarest tokens as far as others have them, dealt by token."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True)]
    single = [r[1:] for r in rows if r[0] == 1]
    shared = [r[1:] for r in rows if r[0] == 0]
    if not shared:
        return
    docs, tokens, df = _join_bytes(shared, 1, np.int64), _join_bytes(shared, 0, np.uint64), _join_bytes(shared, 2, np.int64)
    order = np.lexsort((tokens, df, docs))
    docs, tokens = docs[order], tokens[order]
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    n = np.diff(np.append(starts, len(docs)))
    own = docs[starts]
    others = np.zeros(len(own), np.int64)
    if single:
        who, number = _join_bytes(single, 1, np.int64), _join_bytes(single, 0, np.int64)
        at = np.minimum(np.searchsorted(own, who), len(own) - 1)
        np.add.at(others, at[own[at] == who], number[own[at] == who])
    whole = n + others
    take = np.maximum(whole - -(-num * whole // den) + 1 - others, 0)
    keep = np.arange(len(docs)) - np.repeat(starts, n) < np.repeat(take, n)
    yield from _packed(_dealt(0, hashing.mix(tokens[keep]), bins, tokens[keep], docs[keep]))


def token_links(batches):
    """Of one bin of rare tokens: (document, least document with the token)."""
    rows = _unpacked(batches)
    if not rows:
        return
    tokens, docs = _join_bytes(rows, 0, np.uint64), _join_bytes(rows, 1, np.int64)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    doc, least = _leaders(order, np.append(True, ranked[1:] != ranked[:-1]), docs)
    a, b = np.unique(np.column_stack([doc, least]), axis=0).T
    for i in range(0, len(a), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 200_000], pa.int64()), pa.array(b[i : i + 200_000], pa.int64())], ["a", "b"])


class Matrix:
    """Token-group matrix over sets: groups of similar sets with the unions of their tokens, stored by token."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, width: int):
        """`members` are places of the sets to be grouped; tokens are numbered below `width`, as in `sets`."""
        order = members[np.lexsort((members, [len(sets[i]) for i in members], [sets[i].min() for i in members]))]
        self.groups = [order[k : k + GROUP] for k in range(0, len(order), GROUP)]
        self.sizes = [np.array([len(sets[i]) for i in of]) for of in self.groups]
        self.low, self.high = (np.array([f(s) for s in self.sizes]) for f in (np.min, np.max))
        self.tokens = [np.concatenate([sets[i] for i in of]) for of in self.groups]
        self.starts = [np.cumsum(s) - s for s in self.sizes]
        unions = [np.unique(t) for t in self.tokens]
        of_token = np.concatenate(unions)
        by = np.argsort(of_token, kind="stable")
        self.rows = np.repeat(np.arange(len(unions), dtype=np.int32), [len(u) for u in unions])[by]
        self.ends = np.cumsum(np.bincount(of_token, minlength=width))

    def qualifying(self, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Groups whose union overlaps the query enough for a member of a fitting size."""
        n = len(q)
        ends = self.ends[q]
        lengths = ends - np.where(q > 0, self.ends[q - 1], 0)
        at = np.arange(lengths.sum()) + np.repeat(ends - np.cumsum(lengths), lengths)
        most = np.bincount(self.rows[at], minlength=len(self.groups))
        fits = (self.high * den >= n * num) & (self.low * num <= n * den)
        return np.flatnonzero(fits & (most * den >= num * np.maximum(n, self.low)))


def link_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (places) that join all connected components among left x right."""
    forest = Forest(len(sets))
    filled = [i for i in right.tolist() if len(sets[i])]
    if not filled:
        return []
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    local = [at[e - len(s) : e] for s, e in zip(sets, ends.tolist(), strict=True)]
    matrix = Matrix(local, np.array(filled), len(tokens))
    mark = np.zeros(len(tokens), bool)
    links = []
    for i in left.tolist():
        if not len(sets[i]):
            continue
        mark[local[i]] = True
        for g in matrix.qualifying(local[i], num, den).tolist():
            of = matrix.groups[g].tolist()
            root = forest.root(i)
            if all(forest.root(j) == root for j in of):
                continue
            common = np.add.reduceat(mark[matrix.tokens[g]].astype(np.int64), matrix.starts[g])
            hit = common * den >= num * (len(sets[i]) + matrix.sizes[g] - common)
            links += [(i, of[k]) for k in np.flatnonzero(hit).tolist() if of[k] != i and forest.join(i, of[k])]
        mark[local[i]] = False
    return links


def solve(table: pa.Table, n: int, num: int, den: int) -> pa.Table:
    """Links of one cluster, or of one pair of its blocks (`side` 0 and 1; a block with itself has side 2)."""
    docs = table.column("doc_id").to_numpy()
    side = table.column("side").to_numpy()
    sets = hashing.shingle_sets(table.column("text").to_pylist(), n)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found = link_sets(sets, left, right, num, den)
    links = [(min(docs[i], docs[j]), max(docs[i], docs[j])) for i, j in found]
    if len(table) and (table.column("settled")[0].as_py()):
        nodes, roots = _settled(links)
        links = list(zip(nodes, roots, strict=True))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64()), "settled": pa.array([table.column("settled")[0].as_py()] * len(links), pa.bool_())})


def _settled(links):
    from attestia.llm.components import settle

    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return settle(a, b)


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    ready(spark)
    bins = shuffle_width(spark, docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col(text).cast("string"), "utf-8").alias("text"))

    def sketch(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed, small_batches

        yield from freed(x for batch in small_batches(batches) for x in ngramjoin.sketch_batch(batch, n, num, den, bins))

    def meet(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed

        yield from freed(ngramjoin.bin_rows(batches))

    def solved(table: pa.Table) -> pa.Table:
        from attestia.llm import ngramjoin

        return ngramjoin.solve(table, n, num, den)

    found = durable(
        source.mapInArrow(sketch, "bin int, kind int, a binary, b binary, c binary")
        .repartitionById(bins, "bin")
        .mapInArrow(meet, "kind int, x long, y long, n long"),
        "sketch",
    )
    equal = durable(found.filter("kind = 1").select("x", "y"), "equal")
    links = found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        first = equal.select(F.col("x").alias(end), "y")
        links = lookup(links, first, end, F.col(other)).withColumn(end, F.coalesce("y", end)).drop("y")
    clusters = components(links)

    every = found.filter("kind = 2 and n >= 0").select(F.col("x").alias("node"), "n")
    sizes = durable(every.groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "sizes")

    def weigh(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their sizes, and the large clusters with their numbers of blocks."""
        weighed = durable(lookup(clusters, sizes, "node", F.col("node"), 1), "weighed")
        whole = weighed.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.max("rows").alias("rows"))
        block = F.least(F.greatest(F.col("docs") / 20, F.lit(BLOCK_DOCS)), F.lit(MOST_BLOCK_DOCS))
        blocks = F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
        large = whole.filter((F.col("docs") > CLUSTER_DOCS) | (F.col("tokens") > BLOCK_TOKENS))
        return weighed, durable(large.select("root", blocks.alias("blocks"), "rows"), "large")

    def of(members: DataFrame) -> DataFrame:
        return source.join(F.broadcast(members) if broadcastable(members) else members.hint("merge"), "doc_id")

    def rarely(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed, small_batches

        yield from freed(x for batch in small_batches(batches) for x in ngramjoin.spread_tokens(batch, n, bins))

    def counted(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed

        yield from freed(ngramjoin.count_tokens(batches, bins))

    def rarest(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed

        yield from freed(ngramjoin.rarest_tokens(batches, num, den, bins))

    def shared(batches):
        from attestia.llm import ngramjoin
        from attestia.llm.common import freed

        yield from freed(ngramjoin.token_links(batches))

    weighed, large = weigh(clusters)
    again = large.filter("rows = 1").select("root", F.lit(True).alias("again"))  # one text for each node
    if again.limit(1).count():
        marked = durable(lookup(clusters, durable(again, "again"), "root", F.col("node")), "marked")
        crowd = durable(marked.filter("again").select(F.col("node").alias("doc_id")), "crowd")
        packed = "bin int, kind int, a binary, b binary, c binary"
        tokens = of(crowd).select("doc_id", "text").mapInArrow(rarely, packed).repartitionById(bins, "bin").mapInArrow(counted, packed)
        rare = tokens.repartitionById(bins, "bin").mapInArrow(rarest, packed).repartitionById(bins, "bin").mapInArrow(shared, "a long, b long")
        clusters = durable(marked.filter("again is null").select("node", "root").union(components(rare)), "clusters")
        weighed, large = weigh(clusters)
    blocks = large.select("root", "blocks")
    members = durable(lookup(weighed, blocks, "root", F.col("node")).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "members")
    texts = of(members)
    one = texts.filter("blocks = 1").select("cluster", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side"), "doc_id", "text", F.lit(True).alias("settled"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = lambda rows: rows.groupBy("cluster", "p", "q").applyInArrow(solved, "a long, b long, settled boolean")

    def side(rows: DataFrame, p, q, k) -> DataFrame:
        return rows.withColumn("p", p).withColumn("q", q).select("cluster", "p", "q", F.lit(k).alias("side") if isinstance(k, int) else k.alias("side"), "doc_id", "text", F.lit(False).alias("settled"))

    if large.limit(1).count():
        # Members of a large cluster meet a few representatives; those linked through them need no more comparisons.
        crowded = members.filter("blocks > 1")
        chosen = crowded.groupBy("cluster", "blocks").agg(
            F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("doc_id", F.lit(k)), "doc_id"))["doc_id"] for k in range(REPRESENTATIVES)])).alias("ids")
        )
        chosen = durable(chosen.select("cluster", "blocks", F.explode("ids").alias("doc_id")), "representatives")
        met = side(texts.filter("blocks > 1"), deal("blocks"), F.lit(0), 0).union(side(of(chosen), every("blocks"), F.lit(0), 1))
        first = durable(near(met), "first-links")
        through = components(first.select("a", "b"))
        ranked = durable(lookup(crowded.withColumnRenamed("doc_id", "node"), through, "node", F.col("node")).select("cluster", "blocks", F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("root")), "linked")
        main = ranked.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("docs"))
        main = durable(main.select("cluster", F.col("main.root").alias("main"), "docs", (F.col("docs") - F.col("main.n")).alias("loose")), "main")
        state = lookup(ranked, main, "cluster", F.col("doc_id")).filter("loose > 0")
        left = F.ceil(F.col("loose") * F.col("blocks") / F.col("docs")).cast("int")
        open_ = durable(state.select("cluster", "doc_id", "blocks", left.alias("lefts"), (F.col("root") != F.col("main")).alias("apart"), (2 * F.col("loose") > F.col("docs")).alias("whole")), "unlinked")
        rest = of(open_)

        # Most members apart: all pairs of blocks. Else blocks of those apart against all blocks.
        mine = deal("blocks")
        whole = rest.filter("whole").withColumn("mine", mine).withColumn("other", every("blocks"))
        both = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        some = rest.filter("not whole")
        many = (
            side(whole, F.least("mine", "other"), F.greatest("mine", "other"), both)
            .union(side(some.filter("apart"), deal("lefts"), every("blocks"), 0))
            .union(side(some, every("lefts"), mine, 1))
        )
        pairs = durable(near(one.union(many)).union(first), "links")
    else:  # no cluster is large
        pairs = durable(near(one), "links")
    far = components(pairs.filter("not settled").select("a", "b"))
    roots = durable(pairs.filter("settled").select(F.col("a").alias("node"), F.col("b").alias("root")).union(far.select("node", "root")), "roots")
    through = lookup(equal.select(F.col("x").alias("same"), F.col("y").alias("node")), roots, "node", F.col("same")).select("same", F.coalesce("root", "node").alias("root"))
    final = durable(through.union(roots.select(F.col("node").alias("same"), "root")).groupBy("same").agg(F.min("root").alias("root")), "final")
    told = lookup(found.filter("kind = 2").select(F.col("x").alias("doc_id"), F.col("y").alias("same"), "n"), final, "same", F.col("doc_id"))
    named = F.col("n") >= 0
    return told.select(
        F.when(named, F.col("doc_id")).alias("doc_id"),
        F.when(named, F.col("n")).otherwise(-1 - F.col("n")).alias("n_shingles"),
        F.when(named, F.coalesce("root", "same")).alias("component_id"),
    )
