"""SimHash near-dedup: an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in three bits at most share five of their eight positional bytes at least.  Posting
lists of single positional bytes (256 values) would hold a 256th of all documents each, and the tallies of pairs in them
would grow with the square of the corpus; so a posting list here is the one of three joint positions.  Of any five
positions at least three lie in one half of the fingerprint, so the four triples of each half's positions, eight lists a
fingerprint, hold every pair that can reach the minimum.  A pair's tally, the number of single-byte lists that hold both,
is counted where it is met: it is the number of positions in which the two have the same byte.  Pairs with the minimum of
five or more are kept and verified.

Fingerprints are indexed once each, however many documents have them.  A list is compared in blocks, so a frequent one
is dealt to as many tasks as its blocks have pairs, and each block pair gives a spanning forest of its links, not all
of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.line_dedup import texts_of
from quarry.operators.components import connected_components
from quarry.plans.cut import cut
from quarry.plans.skew import heavy, spread_join

SHINGLE, SEED, MAX_BITS, BYTES = 3, 42, 3, 8
MIN_SHARED = BYTES - MAX_BITS
#: The joint positions of the posting lists, from the least significant byte.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Fingerprints in a block.
BLOCK = 1024
_WS = b" \t\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(_WS, b" " * len(_WS))


def fingerprint(text: bytes) -> int:
    """The 64 majority bits of the shingles' hashes, ties 0; zero without words."""
    # str.split() would part at more than the six characters; they are one byte each in UTF-8
    words = [w for w in text.translate(_TO_SPACE).lower().split(b" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp the fingerprint as a signed long, for each row of docs (doc_id, text); doc_id keeps its type."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the lists of (position, byte) hold both of each pair."""
    return (a.view(np.uint8).reshape(-1, BYTES) == b.view(np.uint8).reshape(-1, BYTES)).sum(axis=1)


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether each pair has the guaranteed tally and, if so, differs in few enough bits."""
    ok = tally(a, b) >= BYTES - max_bits
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= max_bits
    return ok


class _Forest:
    """Union-find over the rows of one batch of posting lists; gives an edge for each union."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        # most pairs of a large group have met already: flatten, then drop those in bulk
        while (up := self.root[self.root] != self.root).any():
            self.root[up] = self.root[self.root[up]]
        new = self.root[a] != self.root[b]
        made = []
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            p, q = self.find(i), self.find(j)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                made.append((i, j))
        return made


def forest_edges(run: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning edges of the links inside each run of equal values in run (sorted), as pairs of rows."""
    forest, edges = _Forest(len(fp)), []
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[first, len(run)])
    left = np.repeat(length, length) - (np.arange(len(run)) - np.repeat(first, length))  # rows to the run's end
    at = np.arange(len(run))
    for d in range(1, int(length.max(initial=1))):
        at = at[left[at] > d]
        ok = _linked(fp[at], fp[at + d], max_bits)
        if ok.any():
            edges += forest.join(at[ok], at[ok] + d)
    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst): edges between distinct fingerprints (fp) that connect just those which links connect.

    max_bits: three or fewer.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the posting lists find pairs that differ in three bits at most")
    byte = lambda k: F.shiftright("fp", 8 * k).bitwiseAND(255)
    keys = [F.lit(n * (1 << 24)) + byte(a) * 65536 + byte(b) * 256 + byte(c) for n, (a, b, c) in enumerate(TRIPLES)]
    posts = cut(fps.select("fp", F.explode(F.array(*keys)).alias("key")))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = spread_join(posts, sizes, "key", heavy(F.col("n"), posts.count())).where("n is not null")
    # the list's blocks, two at a time; a list of one block is one tile
    blocks = F.ceil(F.col("n") / block)
    posts = posts.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    others = F.when(F.col("blocks") <= 2, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own")))
    posts = posts.select("key", "fp", "blocks", "own", F.explode_outer(others).alias("other"))
    pair = F.when(F.col("blocks") <= 2, F.lit(0).cast("long")).otherwise(F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    tiles = posts.select("key", pair.alias("tile"), "fp")
    n = max(tiles.sparkSession.sparkContext.defaultParallelism, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = tiles.repartition(n, "key", "tile").sortWithinPartitions("key", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a tile that may go on in the next batch

        def edges(key: np.ndarray, tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            run = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            found = np.array(forest_edges(run, fp.view(np.uint64), max_bits), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["src", "dst"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut_at = int(np.argmax(last))
            held = [c[cut_at:] for c in cols]
            if cut_at:
                yield edges(*(c[:cut_at] for c in cols))
        if held is not None:
            yield edges(*held)

    return tiles.mapInArrow(compare, "src bigint, dst bigint")


def _components(f: DataFrame, max_bits: int) -> DataFrame:
    """(fp, n, component_id, chosen) by distinct fingerprint; n: its rows; chosen: whether it is its component's, with the smallest id."""
    classes = cut(f.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    comp = connected_components(links(classes.select("fp"), max_bits)).select(F.col("node").alias("fp"), "component")
    of = cut(classes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = of.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("least"))
    of = of.select("fp", "n", "component").join(least, "component")
    return of.select("fp", "n", F.col("least.first").alias("component_id"), (F.col("fp") == F.col("least.fp")).alias("chosen"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach.  Null and empty texts have fingerprint zero and are linked like
    any other; a component_id is null only if all ids of its component are; repeated rows are linked; a text is taken
    whole, however long; ids may be of any type that has an order; an empty table gives an empty result.
    """
    f = cut(fingerprints(docs))
    c = _components(f, max_bits).drop("chosen")
    r = spread_join(f, c, "fp", heavy(F.col("n"), f.count()))
    return r.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of docs for each component, that of its smallest doc_id, with the columns of docs.

    If rows repeat a doc_id, one of the component's least fingerprint with that id stays.
    """
    names = docs.columns
    row = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*(docs[c] for c in names if c != "text")).alias("__row"))
    f = cut(fingerprints(row))
    chosen = _components(f, max_bits).where("chosen").select(F.col("component_id").alias("__id"), F.col("fp").alias("__fp"))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=["doc_id", "text", "__row", "fp"])

    kind, own = (row.schema[c].dataType.simpleString() for c in ("doc_id", "__row"))
    d = row.mapInArrow(attach, f"doc_id {kind}, text string, __row {own}, fp bigint")
    d = d.join(chosen, (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["fp", "doc_id"])
    return d.select(*(F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in names))
