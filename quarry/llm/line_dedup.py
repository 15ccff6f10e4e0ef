"""Line dedup with two Bloom filters: one of lines seen once, one of lines seen twice.

Every task sets its documents' line hashes in a first filter, and those it has seen before in a second one.  Merged over
tasks by segments, a bit of the second filter is set where a task set it or where two tasks' first filters meet; so it
misses no line of two documents.  Only lines that the second filter suspects are shuffled, for the exact count of
documents by key; the documents are joined once with the keys that they lose.

The filters have a size that follows the number of lines.  Where that is more than MAX_BITS, hashes are split into up to
MAX_RANGES ranges, each with filters of its own and a pass over the texts.  Past that the filters let more lines through
to the exact step, and results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import cut
from quarry.plans.skew import heavy, spread_join

MIN_CODE_POINTS, MIN_DOCS = 20, 3
#: Filter bits for each line, the bounds of their number, ranges at most, hashes for each line, and the bytes of a segment.
#: A task holds two filters of MAX_BITS / 8 bytes while they are built, and one later.
BITS_PER_LINE, MIN_BITS, MAX_BITS, MAX_RANGES, HASHES, SEGMENT = 12, 1 << 20, 1 << 30, 16, 4, 1 << 16
#: Bytes of a key up to which it may be sent to all tasks.
LONG_KEY = 4096
_STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """A line's key; bytes.lower() changes A-Z only."""
    return line.strip(_STRIP).lower()


def keys_of(text: bytes, least: int = MIN_CODE_POINTS) -> set[bytes]:
    """The keys of a text that are long enough (in code points: bytes that don't continue a character)."""
    keys = {key_of(line) for line in text.split(b"\n")}
    return {k for k in keys if len(k) >= least and (k.isascii() or len(k.decode()) >= least)}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """One row of HASHES bit positions for each hash."""
    odd = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * odd[:, None]) % np.uint64(bits)).astype(np.int64)


def has(packed: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether all bits of each row of p are set."""
    return ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)


def put(packed: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(packed, (p >> 3).ravel(), (1 << (7 - (p & 7))).astype(np.uint8).ravel())


def in_range(h: np.ndarray, part: int, ranges: int) -> np.ndarray:
    """Whether each hash is one of range `part` of `ranges`; by bits that no filter of MAX_BITS depends on alone."""
    return (h >> np.uint64(40)) % np.uint64(ranges) == part


def seen_twice(docs: DataFrame, bits: int, part: int = 0, ranges: int = 1) -> np.ndarray:
    """The second filter, packed, for one range of hashes; a superset of the lines that two rows of docs have."""
    size = bits // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for text in texts_of(batch):
                if keys := list(keys_of(text)):
                    h = hashes(keys)
                    p = places(h[in_range(h, part, ranges)], bits)
                    put(twice, p[has(once, p)])
                    put(once, p)
        for k in range(-(-size // SEGMENT)):
            at = slice(k * SEGMENT, (k + 1) * SEGMENT)
            if once[at].any():
                pack = lambda x: pa.array([zlib.compress(x[at].tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pack(once), pack(twice)], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by segment: two arrays of SEGMENT bytes are all that is held
        at, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["segment", "twice"])
        for batch in batches:
            for k, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if k != at:
                    if at is not None:
                        yield done()
                    at, once, twice = k, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if at is not None:
            yield done()

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    parts = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    found = np.zeros(size, np.uint8)
    for r in parts.collect():  # at most bits / 8 bytes
        piece = np.frombuffer(zlib.decompress(bytes(r.twice)), np.uint8)
        found[r.segment * SEGMENT : r.segment * SEGMENT + len(piece)] = piece
    return found


def filter_sizes(n_lines: int) -> tuple[int, int]:
    """Bits of a filter, a power of two, and the number of ranges."""
    want = max(1, n_lines * BITS_PER_LINE)
    ranges = min(MAX_RANGES, -(-want // MAX_BITS))
    return min(MAX_BITS, max(MIN_BITS, 1 << (-(-want // ranges) - 1).bit_length())), ranges


def suspects(docs: DataFrame, twice: np.ndarray, bits: int, part: int = 0, ranges: int = 1) -> DataFrame:
    """(own, doc_id, key): the keys of each document in one range of hashes that the second filter has."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)  # at most MAX_BITS / 8 bytes
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(texts_of(batch)):
                if found := list(keys_of(text)):
                    h = hashes(found)
                    hit = has(packed, places(h, bits)) & in_range(h, part, ranges)
                    new = [k for k, x in zip(found, hit, strict=True) if x]
                    keys += new
                    rows += [i] * len(new)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("own").take(at), batch.column("doc_id").take(at), pa.array(keys, pa.binary())], names=["own", "doc_id", "key"])

    return docs.mapInArrow(run, f"own string, doc_id {kind.simpleString()}, key binary")


def losses(docs: DataFrame, least_docs: int = MIN_DOCS) -> DataFrame:
    """(own, lost): the keys of which each document loses its lines, as an array of binary; docs: (own, doc_id, text)."""
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    bits, ranges = filter_sizes(docs.agg(F.sum(n_lines)).first()[0] or 0)
    passes = [cut(suspects(docs, seen_twice(docs, bits, part, ranges), bits, part, ranges)) for part in range(ranges)]
    s = cut(reduce(DataFrame.unionAll, passes).distinct())
    by_key = cut(s.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where(F.col("n") >= least_docs))
    total = by_key.agg(F.sum("rows")).first()[0] or 0
    # very long keys are never heavy ones, so that these are few and short
    is_heavy = heavy(F.col("rows"), total) & (F.octet_length("key") <= LONG_KEY)
    s = spread_join(s, by_key, "key", is_heavy).where("n is not null").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return s.groupBy("own").agg(F.collect_set("key").alias("lost"))


def strip_lines(text: bytes, lost: list[bytes] | None) -> tuple[bytes, int, int]:
    """The text without the lines whose keys are lost, its number of lines before, and the number of dropped lines."""
    lines = text.split(b"\n")
    if not lost:
        return text, len(lines), 0
    gone = set(lost)
    kept = [x for x in lines if key_of(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, least_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with their columns, text without repeated lines, and __n_lines, __n_dropped.

    Keys of MIN_CODE_POINTS code points or more that stand in least_docs documents or more lose their lines except in the
    largest doc_id.  Rows with one doc_id are one document.  Rows with a null doc_id make up none: they don't count, and
    lose the lines that others count enough of.  Ids may be of any type that has an order.  A null text is one empty line
    and becomes an empty text; a text all of whose lines go becomes empty; texts are taken whole, however long; an empty
    table gives an empty result.
    """
    names = docs.columns
    # what a row's losses are found by: its id, or else its text
    own = F.coalesce(F.concat(F.lit("i"), docs["doc_id"].cast("string")), F.concat(F.lit("t"), F.md5(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8"))))
    row = docs.select(own.alias("own"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*(docs[c] for c in names if c != "text")).alias("__row"))
    lost = losses(row.select("own", "doc_id", "text"), least_docs).select(F.col("own").alias("__own"), "lost")
    joined = row.join(lost, F.col("own") == F.col("__own"), "left").select("__row", "text", "lost")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [strip_lines(t, x) for t, x in zip(texts_of(batch), batch.column("lost").to_pylist())]
            kept = pa.array([x[0] for x in out], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            counts = [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), kept, *counts], names=["__row", "text", "__n_lines", "__n_dropped"])

    kind = row.schema["__row"].dataType.simpleString()
    done = joined.mapInArrow(strip, f"__row {kind}, text string, __n_lines bigint, __n_dropped bigint")
    return done.select(*(F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in names), "__n_lines", "__n_dropped")
