"""Exact top-k search by inner product: a cover tree over queries and data, searched by pairs of nodes.

The tree is a farthest-first traversal of a bounded sample: its prefixes are nested nets whose separation shrinks, each
centre hanging from the nearest one of the level above.  Every row, query or candidate, belongs to its nearest leaf, and
each node's covering radius holds over all its rows, so bounds are exact though the centres come from a sample.  Scores
against the sample give each query a k-th score that it surely reaches; a pair of nodes is pruned if no inner product
inside its radii can reach the worst of these in the query node.

What remains is streamed.  Queries stand in blocks of a bounded number; the candidates of the leaves that a block must
see are dealt to LANES lanes and pass by it in small parts, the leaves of the largest possible scores first.  The block
keeps its best k so far, and each query skips the parts whose leaves can't reach its k-th score any more.  So a block and
lane give k rows for each query, however many candidates there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.cut import cut

SCALE, K, EVERY = 64, 20, 20
#: Rows of the sample, rows for each leaf, most leaves, queries in a block, lanes for each block, and candidates at a time.
SAMPLE, PER_LEAF, MAX_LEAVES, QUERY_BLOCK, LANES, PART = 2048, 1024, 256, 4096, 8, 512
LEVELS = 24
#: Scaled components beyond this take a vector out of the search, as scores must fit a long.
LARGEST = 1 << 28


@dataclass
class Tree:
    """Leaf centres in farthest-first order; level i has the centres that were more than top / 2^i away when added."""

    centres: np.ndarray
    level: np.ndarray  # the first level of each centre
    parent: np.ndarray  # the centre of the level above that it hangs from (its own index for the root)


def grow(sample: np.ndarray, leaves: int) -> Tree:
    picked, reach = [0], [np.inf]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(leaves, len(sample)) and far.max() > 0:
        i = int(far.argmax())
        picked.append(i)
        reach.append(float(far[i]))
        far = np.minimum(far, np.linalg.norm(sample - sample[i], axis=1))
    centres, reach = sample[picked], np.array(reach)
    top = reach[1] if len(reach) > 1 else 1.0
    level = np.r_[0, np.minimum(LEVELS, 1 + np.floor(np.log2(top / reach[1:]))).astype(int)]
    parent = np.zeros(len(centres), int)
    for i in range(1, len(centres)):
        above = np.flatnonzero(level < level[i])
        parent[i] = above[np.linalg.norm(centres[above] - centres[i], axis=1).argmin()]
    return Tree(centres, level, parent)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and distance from, each row's nearest centre."""
    d = (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * (v @ centres.T)
    at = d.argmin(1)
    return at, np.linalg.norm(v - centres[at], axis=1)


def surviving(tree: Tree, q_radius: np.ndarray, q_worst: np.ndarray, d_radius: np.ndarray) -> np.ndarray:
    """Which (query leaf, data leaf) pairs the dual search reaches.  Radii are negative for leaves without rows."""
    n = len(tree.centres)
    children = [[j for j in range(1, n) if tree.parent[j] == i] for i in range(n)]
    norm = np.linalg.norm(tree.centres, axis=1)

    def cover(leaf: np.ndarray) -> np.ndarray:
        """Radius of each whole node, itself and all below."""
        r = leaf.copy()
        for i in range(n - 1, 0, -1):  # a centre comes after its parent
            if r[i] >= 0:
                p = tree.parent[i]
                r[p] = max(r[p], r[i] + np.linalg.norm(tree.centres[i] - tree.centres[p]))
        return r

    q_cover, d_cover, worst = cover(q_radius), cover(d_radius), q_worst.copy()
    for i in range(n - 1, 0, -1):
        worst[tree.parent[i]] = min(worst[tree.parent[i]], worst[i])

    def reaches(a: int, ra: float, w: float, b: int, rb: float) -> bool:
        if ra < 0 or rb < 0:
            return False
        most = float(tree.centres[a] @ tree.centres[b]) + norm[a] * rb + ra * norm[b] + ra * rb
        return most * (1 + 1e-9 * np.sign(most)) + 1e-6 >= w

    alive = np.zeros((n, n), bool)
    # a node: (centre, whether the whole node or the centre's own leaf)
    stack = [(0, True, 0, True)]
    while stack:
        a, whole_a, b, whole_b = stack.pop()
        ra, w = (q_cover[a], worst[a]) if whole_a else (q_radius[a], q_worst[a])
        rb = d_cover[b] if whole_b else d_radius[b]
        if not reaches(a, ra, w, b, rb):
            continue
        if not whole_a and not whole_b:
            alive[a, b] = True
        elif whole_a and (ra >= rb or not whole_b):
            stack += [(a, False, b, whole_b), *((c, True, b, whole_b) for c in children[a])]
        else:
            stack += [(a, whole_a, b, False), *((a, whole_a, c, True) for c in children[b])]
    return alive


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b, as int64."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best k candidates so far of a block of queries; of equal scores those of smaller ids."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.queries, self.worst, self.k = ids, queries, least.copy(), k
        self.norm = np.linalg.norm(queries, axis=1)
        self.found = np.zeros((3, 0), np.int64)  # row, score, id

    def see(self, ids: np.ndarray, data: np.ndarray, centre: np.ndarray, radius: float) -> None:
        """Candidates that lie within radius of centre."""
        most = self.queries @ centre + self.norm * radius
        at = np.flatnonzero(most + 1e-9 * np.abs(most) + 1e-6 >= self.worst)
        if not len(at):
            return
        s = exact(self.queries[at], data)
        row, col = np.nonzero((s >= self.worst[at][:, None]) & (self.ids[at][:, None] != ids[None]))
        if len(row):
            self.found = np.hstack([self.found, np.stack([at[row], s[row, col], ids[col]])])
            self.settle()

    def settle(self) -> None:
        """Keeps k for each query and raises what a candidate must reach."""
        row, score, ids = self.found[:, np.lexsort((self.found[2], -self.found[1], self.found[0]))]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        last = place == self.k - 1
        self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last])
        self.found = np.stack([row, score, ids])[:, place < self.k]


def packed_blocks(queries: np.ndarray, block: int = QUERY_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf's queries and how many blocks they fill; small leaves, in order, share a block."""
    first, blocks, filled, at = np.zeros(len(queries), int), np.ones(len(queries), int), 0, 0
    for i, n in enumerate(queries):
        if filled + n > block and filled:
            at, filled = at + 1, 0
        first[i], blocks[i] = at, max(1, -(-n // block))
        if blocks[i] > 1:
            at = at + blocks[i]
        else:
            filled += n
    return first, blocks


def block_spans(leaves: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int]]:
    """The blocks, as few spans (first and last), that hold queries of these leaves."""
    spans: list[tuple[int, int]] = []
    for i in np.flatnonzero(leaves):
        a, b = int(first[i]), int(first[i] + blocks[i] - 1)
        if spans and a <= spans[-1][1] + 1:
            spans[-1] = spans[-1][0], max(b, spans[-1][1])
        else:
            spans.append((a, b))
    return spans


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as array<bigint>; null if the vector is null or has a component that is null,
    non-finite or beyond LARGEST when scaled."""
    x = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < float(LARGEST)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of packed doubles; shorter vectors are padded with zeros, as components that they don't have."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width) if width else np.zeros((len(column), 0))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose id `every` divides its k best rows.

    Ties go to the smaller vec_id.  Vectors that are null or hold null or non-finite components, or one of LARGEST or more
    when scaled (a sum of such products needn't fit a long), and rows with a null id, take no part.  A row's own is every row with its id, so repeats of a query row don't find each other, and a query
    id that is repeated is asked once for each row, ranked together as one (the least k of their results); vectors of
    different lengths meet in their common components; an empty vector scores zero; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null"))
    size = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        return empty

    def padded(values: pa.Array) -> np.ndarray:
        length = np.diff(values.offsets.to_numpy())
        out = np.zeros((len(values), width))
        out[np.arange(width)[None] < length[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
        return out

    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    sample, sample_ids = np.array([[*r.v, *[0] * (width - len(r.v))] for r in rows], float).reshape(len(rows), width), np.array([r.vec_id for r in rows])
    tree = grow(sample, max(4, min(MAX_LEAVES, n // PER_LEAF)))
    shared = spark.sparkContext.broadcast((tree.centres, sample, sample_ids))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sample, sample_ids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, m = part.column("vec_id").to_numpy(), padded(part.column("v"))
                leaf, far = nearest(m, centres)
                asks = ids % every == 0
                least = np.full(len(ids), -np.inf)
                if asks.any() and len(sample) > k:
                    s = exact(m[asks], sample).astype(float)
                    s[ids[asks][:, None] == sample_ids[None]] = -np.inf
                    least[asks] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
                packed = [x.astype("<f8").tobytes() for x in m]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(packed, pa.binary()), pa.array(leaf, pa.int32()), pa.array(far), pa.array(asks), pa.array(least)], names=["vec_id", "packed", "leaf", "far", "asks", "least"])

    d = cut(v.mapInArrow(settle, "vec_id bigint, packed binary, leaf int, far double, asks boolean, least double"))
    m = len(tree.centres)
    queries, radius, q_radius, worst = np.zeros(m, int), np.full(m, -1.0), np.full(m, -1.0), np.full(m, np.inf)
    asked = lambda c: F.when(F.col("asks"), F.col(c))
    for r in d.groupBy("leaf").agg(F.count_if("asks").alias("q"), F.max("far").alias("far"), F.max(asked("far")).alias("q_far"), F.min(asked("least")).alias("worst")).collect():
        radius[r.leaf], queries[r.leaf] = r.far, r.q
        if r.q:
            q_radius[r.leaf], worst[r.leaf] = r.q_far, r.worst
    alive = surviving(tree, q_radius, worst, radius)
    first, blocks = packed_blocks(queries)
    # the leaves of long vectors and wide radii come first
    order = np.empty(m, int)
    order[np.argsort(-(np.linalg.norm(tree.centres, axis=1) + radius), kind="stable")] = np.arange(m)
    listed = lambda xs: F.array(*(F.lit(int(x)) for x in xs))
    leaf_at, lane = F.col("leaf"), F.pmod(F.xxhash64("vec_id", "packed"), F.lit(LANES)).cast("int")
    q_block = F.get(listed(first), leaf_at) + F.pmod(F.xxhash64("vec_id"), F.get(listed(blocks), leaf_at)).cast("int")
    q = d.where("asks").select(q_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(-1).alias("order"), "leaf", "vec_id", "packed", "least")
    # a candidate passes by the blocks that hold queries of the leaves that survived with its own
    spans = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in block_spans(alive[:, j] & (queries > 0), first, blocks))).cast("array<struct<a:int,b:int>>") for j in range(m)))
    c = d.select("leaf", "vec_id", "packed", "least", lane.alias("lane"), F.get(listed(order), leaf_at).alias("order"), F.explode(F.get(spans, leaf_at)).alias("span"))
    c = c.select(F.explode(F.sequence("span.a", "span.b")).alias("block"), "lane", "order", "leaf", "vec_id", "packed", "least")
    n_blocks = int((first + blocks).max()) if queries.any() else 1
    tasks = min(n_blocks * LANES, max(2 * LANES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    stream = q.unionAll(c).repartition(tasks, "block", "lane").sortWithinPartitions("block", "lane", "order", "leaf", "vec_id")
    nodes = spark.sparkContext.broadcast((tree.centres, radius))

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = nodes.value
        now: tuple[int, int] | None = None
        asking: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: Best | None = None

        def rows() -> pa.RecordBatch:
            row, score, ids = held.found if held is not None else np.zeros((3, 0), np.int64)
            own = held.ids[row] if held is not None else row
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            block, lanes, kind, leaf, ids, _, least = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            data = _matrix(batch.column("packed"), width)
            # parts of one block, lane and leaf, of a bounded number of rows
            new = (block[1:] != block[:-1]) | (lanes[1:] != lanes[:-1]) | (kind[1:] != kind[:-1]) | (leaf[1:] != leaf[:-1])
            edges = np.r_[0, np.flatnonzero(new) + 1, len(ids)]
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (block[start], lanes[start]) != now:
                    yield rows()
                    now, asking, held = (block[start], lanes[start]), [], None
                if kind[start] < 0:
                    asking.append((ids[start:stop], data[start:stop], least[start:stop]))
                    continue
                if held is None:
                    held = Best(*(np.concatenate(x) for x in zip(*asking, strict=True)), k)
                for at in range(start, stop, PART):
                    held.see(ids[at : min(at + PART, stop)], data[at : min(at + PART, stop)], centres[leaf[start]], radii[leaf[start]])
        yield rows()

    found = stream.mapInArrow(pass_by, "query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
