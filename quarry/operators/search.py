"""Search: chunks, BM25, nearest neighbours, reciprocal rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.cut import cut


def chunks(docs: DataFrame, lines: int = 60) -> DataFrame:
    """doc_id, chunk, n_lines, first_line of each block of `lines` lines."""
    d = docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    d = d.select("doc_id", "n", F.explode_outer(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / lines))).alias("chunk"))
    return d.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.least(F.lit(lines), F.col("n") - F.col("chunk") * lines).cast("bigint").alias("n_lines"), (F.col("chunk") * lines + 1).cast("bigint").alias("first_line"))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score (six places) of documents with one of the terms.  Only the terms' counts are shuffled."""
    words = F.split(F.lower("text"), r"[^a-z]+")
    d = docs.select("doc_id", words.alias("w")).withColumn("n", F.size("w"))
    for i, t in enumerate(terms):
        d = d.withColumn(f"t{i}", F.size("w") - F.size(F.array_remove("w", t)))
    # counts only, a few numbers a document: else the filter on the score splits each text again for every term
    d = cut(d.drop("w"))
    s = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.lit(float(s["docs"])) - s[f"df{i}"] + 0.5
        tf = F.col(f"t{i}")
        score = score + F.log(1 + idf / (s[f"df{i}"] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (s["mean"] or 1.0)))
    return d.select("doc_id", F.round(score, 6).alias("score")).where("score > 0")


def knn(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 256, data_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, similarity (six places): the k nearest by cosine of each query, ties to the smaller id.

    Queries and vectors meet block by block, and a block gives k rows a query, so neither side is sent whole to a task.
    Similarity is null, and ranks last, with a null vector or component, of vectors of two lengths and of length zero.
    """
    q = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    q_blocks, v_blocks = -(-q.count() // query_block) or 1, -(-v.count() // data_block) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).select("*", every(v_blocks).alias("v_block"))
    v = v.withColumn("v_block", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks))).select("*", every(q_blocks).alias("q_block"))

    def unit(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors padded to a width, those that have no similarity of NaN, and their lengths."""
        rows = column.to_pylist()
        size = np.array([-1 if r is None else len(r) for r in rows])
        m = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            m[i, : len(r or ())] = np.nan if r is None else np.array(r, float)
        with np.errstate(all="ignore"):
            return m / np.where(size >= 0, np.sqrt((m * m).sum(1)), np.nan)[:, None], size

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            ids, own = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (left["q"], right["v"]))
            (a, n), (b, m) = unit(left["q"], width), unit(right["v"], width)
            with np.errstate(all="ignore"):
                s = a @ b.T
            known = np.isfinite(s) & (n[:, None] == m[None])
            # millionths, then places in the order of ids: whole numbers, so that ties fall as in the final ranking
            s = np.where(known, np.copysign(np.floor(np.abs(np.where(known, s, 0)) * 1e6 + 0.5), s), -2e6).astype(np.int64)
            s[own[:, None] == ids[None]] = -3_000_000
            order = s * len(ids) + (len(ids) - 1 - np.arange(len(ids)))
            j = np.argpartition(order, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), s.shape)
            i = np.broadcast_to(np.arange(len(own))[:, None], j.shape)
            fine = s[i, j] > -3_000_000
            i, j = i[fine], j[fine]
            out = [own[i], ids[j], s[i, j]]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "s"])

    found = q.groupBy("q_block", "v_block").cogroup(v.groupBy("q_block", "v_block")).applyInArrow(block, "query_id bigint, vec_id bigint, s bigint")
    found = found.select("query_id", "vec_id", F.when(F.col("s") >= -1_000_001, F.col("s") / 1e6).alias("similarity"))
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score: reciprocal rank fusion of rankings (key, rank from 1)."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionAll(r.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(1 / (F.col("rank") + k)), 6).alias("score"))


def hybrid(vector: DataFrame, keyword: DataFrame, key: str | list[str], k: int = 60) -> DataFrame:
    """key, score, matched (vector, keyword or both): reciprocal rank fusion of two rankings (key, rank from 1)."""
    key = [key] if isinstance(key, str) else key
    v, w = vector.select(*key, F.col("rank").alias("__v")), keyword.select(*key, F.col("rank").alias("__w"))
    part = lambda c: F.coalesce(1 / (F.col(c) + k), F.lit(0.0))
    matched = F.when(F.col("__w").isNull(), "vector").when(F.col("__v").isNull(), "keyword").otherwise("both")
    return v.join(w, key, "full_outer").select(*key, F.round(part("__v") + part("__w"), 6).alias("score"), matched.alias("matched"))
