"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Every document gets a rate, the expected number of its copies, from 0 to `most`.  The rates are those nearest to one, in
relative entropy, for which each source's words meet its target.  A document counts in the entropy as its words and an
average document's together, so the convex dual, one multiplier for each source, gives tilted rates

    rate = min(most, exp(multiplier * size / (size + mean size of the source))).

Newton's steps run for all sources side by side.  Each is a distributed sum over documents, those alike in source and size
taken together, of the dual's gradient (words by rate, less the target) and Hessian; a bracket around each multiplier
makes up for steps that lead out of it.  Rates become copies by systematic rounding along the documents of a source by
size, in whole numbers of billionths, so that sums are exact: first for the number of copies of all documents of one
size, then, inside buckets of about BUCKET documents, for each.  Rows alike in id, source and text are counted together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import split_words, whole
from quarry.plans.cut import cut
from quarry.plans.skew import heavy

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BUCKET, OFFSETS, UNIT = 256, 16, 1_000_000_000
#: Newton's steps at most (the bracket halves at least at each that leads out of it), the residual, as a part of the
#: target, at which they end, and the bracket's width at the start.
STEPS, RESIDUAL, WIDEST = 100, 1e-12, float(1 << 20)
#: Documents of more than one part in HEAVY of their source's words are rounded before the others.
HEAVY = 40


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size, n), n documents of one size; one row per source.

    The sources, by code point with null last, weigh as weights repeat.  They share `share` of all words; a target stops
    at `most` times its source's size and what is over is shared again.  That is t = min(most * size, level * weight)
    with one level for all, which a running sum over the sources by most * size / weight finds.  The windows without
    partitions below run over this table of sources, a few numbers each, not over documents.
    """
    s = cut(sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), order % len(weights)).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("k", F.row_number().over(by)).withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("k", "level"))
    s = s.withColumn("first", F.min(fits).over(everything))
    target = F.when(F.col("k") < F.col("first.k"), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    s = s.withColumn("target", F.coalesce(target, F.col("cap")))
    return s.select("source", "n_docs", "source_size", "target")


def tilt() -> Column:
    """What the multiplier is tilted by: from 0 for an empty document to 1 for a very long one."""
    return F.col("size") / (F.col("size") + F.col("source_size") / F.col("n_docs"))


def dual(hist: DataFrame, s: DataFrame, most: int = MOST) -> DataFrame:
    """s (source, n_docs, source_size, target) with multiplier, which meets the target, from rows of (source, size, n).

    The multiplier of a source without words is 0, and null where all documents are to be taken `most` times.
    """
    full = F.col("target") >= F.col("source_size") * F.lit(float(most))
    start = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), F.lit(0.0)).when(~full, F.lit(0.0))
    s = s.withColumn("multiplier", start).withColumn("low", F.lit(-WIDEST)).withColumn("high", F.lit(WIDEST))
    s = cut(s.withColumn("open", F.coalesce((F.col("source_size") > 0) & (F.col("target") > 0) & ~full, F.lit(False))))
    rows = cut(hist.withColumnRenamed("source", "__s").join(s.where("open").select("source", "n_docs", "source_size"), F.col("__s").eqNullSafe(F.col("source"))).select("source", "n", "size", tilt().alias("x")))
    for _ in range(STEPS):
        if s.where("open").isEmpty():
            break
        now = s.where("open").select(F.col("source").alias("__s"), "multiplier")
        z = F.col("multiplier") * F.col("x")
        words = F.col("n") * F.col("size")
        bound = F.lit(math.log(most))
        d = rows.join(now, F.col("source").eqNullSafe(F.col("__s")))
        d = d.groupBy("source").agg(F.sum(words * F.exp(F.least(z, bound))).alias("taken"), F.sum(F.when(z < bound, words * F.col("x") * F.exp(z))).alias("slope"))
        d = s.join(d.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        over = F.col("taken") - F.col("target")
        d = d.withColumn("low", F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("multiplier")).otherwise(F.col("high")))
        step = F.col("multiplier") - over / F.nullif("slope", F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        done = F.abs(over) <= RESIDUAL * F.col("target")
        moved = F.when(done, F.col("multiplier")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        d = d.withColumn("moved", F.when(F.col("open"), moved).otherwise(F.col("multiplier")))
        d = d.withColumn("open", F.col("open") & ~done & (F.col("moved") != F.col("multiplier")))
        s = cut(d.select("source", "n_docs", "source_size", "target", F.col("moved").alias("multiplier"), "low", "high", "open"))
    return s.select("source", "n_docs", "source_size", "target", F.round("multiplier", 9).alias("multiplier"))


def rates(hist: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, size, n, n_docs, source_size, target, rate) for rows of (source, size, n); rate in parts of UNIT."""
    s = dual(hist, cut(targets(hist, weights, share, most)), most).withColumnRenamed("source", "__s")
    d = hist.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    r = F.least(F.lit(float(most)), F.exp(F.coalesce(F.col("multiplier") * tilt(), F.lit(0.0))))
    r = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("multiplier").isNull(), float(most)).otherwise(r)
    return d.withColumn("rate", F.floor(r * UNIT + 0.5).cast("long")).drop("multiplier")


def allotted(d: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, n_docs, source_size, target, rate, copies): the copies of all n documents of a size together.

    The few heavy documents are rounded first; the others' rates make up for what the heavy ones took too much or too
    little.  Each time the longest come first, and of OFFSETS starts the one that comes nearest to the words wanted is taken.
    """
    each = Window.partitionBy("source")
    words = lambda c: F.coalesce(F.sum(c * F.col("size")).over(each).cast("double"), F.lit(0.0))
    d = d.withColumn("heavy", F.col("size") * HEAVY > F.col("source_size"))
    weight = _many(F.col("rate")) * F.col("n")
    d = d.withColumn("own", F.when(F.col("heavy"), weight))
    d = _rounded(d, "own", words(F.col("own")) / UNIT, "first")
    d = d.withColumn("left", F.col("target") - words(F.col("first"))).withColumn("light", words(F.when(~F.col("heavy"), weight)) / UNIT)
    scale = F.coalesce(F.round(F.greatest(F.lit(0.0), F.try_divide("left", "light")), 9), F.lit(0.0))
    scaled = F.floor(F.least(F.lit(float(most * UNIT)), F.col("rate") * scale) + 0.5).cast("long")
    again = F.when(F.col("size") == 0, F.col("rate")).otherwise(scaled)
    d = d.withColumn("own", F.when(~F.col("heavy"), _many(again) * F.col("n")))
    d = _rounded(d, "own", F.col("left"), "rest")
    return d.select("source", "size", "n", "n_docs", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), F.coalesce("first", "rest").alias("copies"))


def _many(c: Column) -> Column:
    return c.cast("decimal(28,0)")


def _rounded(d: DataFrame, own: str, goal: Column, name: str) -> DataFrame:
    """Adds name: the whole copies of each size from its expected ones in parts of UNIT (own), where these aren't null."""
    each = Window.partitionBy("source")
    d = d.withColumn("__goal", goal).withColumn("__upto", F.sum(own).over(each.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda x: F.call_function("div", x, F.lit(UNIT))
    at = lambda u: part(F.col("__upto") + u) - part(F.col("__upto") - F.col(own) + u)
    starts = [UNIT * (2 * i + 1) // (2 * OFFSETS) for i in range(OFFSETS)]
    off = lambda u: F.round(F.abs(F.coalesce(F.sum(at(F.lit(u)) * F.col("size")).over(each), F.lit(0)) - F.col("__goal")), 3)
    d = d.withColumn("__u", F.array_min(F.array(*(F.struct(off(u).alias("off"), F.lit(u).cast("long").alias("u")) for u in starts)))["u"])
    return d.withColumn(name, at(F.col("__u"))).drop("__goal", "__upto", "__u")


def _kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, m): rows alike in id, source and text, and how many they are."""
    digest = F.md5(F.encode(whole(F.col("text")), "UTF-8"))
    size = F.size(split_words(whole(F.col("text")))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), digest.alias("digest")).groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("m"))


def _shares(kinds: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """_kinds() with source_size, target, rate and together, the copies of all m rows."""
    hist = cut(kinds.groupBy("source", "size").agg(F.sum("m").alias("n")))
    total = hist.agg(F.sum("n")).first()[0] or 0
    classes = cut(allotted(rates(hist, weights, share, most), most))
    # sizes of which very many documents are: fewer than a fixed number of rows
    few = classes.where(heavy(F.col("n"), total)).select(F.col("source").alias("__s"), F.col("size").alias("__size"), F.ceil(F.col("n") / BUCKET).alias("parts"))
    d = kinds.join(F.broadcast(few), F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size")), "left").drop("__s", "__size")
    order = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "digest"), "UTF-8"))
    d = d.withColumn("order", order)
    d = d.withColumn("part", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.coalesce("parts", F.lit(1).cast("long"))))
    # the copies of a size are dealt to its parts, and those of a part to its rows, each time in proportion
    parts = d.groupBy("source", "size", "part").agg(F.sum("m").alias("np"))
    parts = parts.join(classes.select(F.col("source").alias("__s"), F.col("size").alias("__size"), "n", "source_size", "target", "rate", "copies"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size"))).drop("__s", "__size")
    parts = _dealt(parts, Window.partitionBy("source", "size").orderBy("part"), "np", "n", "copies", "part_copies")
    parts = cut(parts.select(F.col("source").alias("__s"), F.col("size").alias("__size"), F.col("part").alias("__part"), "np", "source_size", "target", "rate", "part_copies"))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size")) & (F.col("part") == F.col("__part"))).drop("__s", "__size", "__part")
    return _dealt(d, Window.partitionBy("source", "size", "part").orderBy("order", "doc_id"), "m", "np", "part_copies", "together")


def _dealt(d: DataFrame, by: Window, own: str, all_: str, copies: str, name: str) -> DataFrame:
    """Adds name: each row's part of copies, in whole numbers; a row stands for own of all_ documents."""
    d = d.withColumn("__upto", F.sum(own).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    upto = lambda x: F.call_function("div", _many(F.col(copies)) * x, F.col(all_))
    return d.withColumn(name, upto(F.col("__upto")) - upto(F.col("__upto") - F.col(own))).drop("__upto")


def _times(k: Column) -> Column:
    """The copies of the k-th (from 1) of m rows that get `together` copies together."""
    upto = lambda x: F.call_function("div", _many(F.col("together")) * x, F.col("m"))
    return upto(k) - upto(k - 1)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs (doc_id, text, source).

    Null ids, sources and texts are allowed (size 0 for a null text; a document without words has the rate 1); repeated
    rows share their copies; ties of size are dealt by a digest of id and text, so reruns give the same rows; a text is
    taken whole, however long; an empty table gives an empty result.
    """
    d = _shares(cut(_kinds(docs)), weights, share, most)
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).withColumn("copies", _times(F.col("k")))
    return d.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with their columns.

    Texts are shuffled once, by id, source and digest.  Rows alike in these are numbered, so that all of them together
    are written as often as mix() takes them.
    """
    names = docs.columns
    m = _shares(cut(_kinds(docs.select("doc_id", "text", "source"))), weights, share, most).where("together > 0")
    m = m.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"), "m", "together")
    digest = F.md5(F.encode(whole(docs["text"]), "UTF-8"))
    row = docs.select(F.struct(*(docs[c] for c in names)).alias("__row"), docs["doc_id"].alias("__doc"), docs["source"].alias("__src"), digest.alias("__d"))
    d = row.join(m, F.col("__doc").eqNullSafe(F.col("__id")) & F.col("__src").eqNullSafe(F.col("__source")) & (F.col("__d") == F.col("__digest")))
    by = Window.partitionBy("__doc", "__src", "__d").orderBy("__d")
    d = d.withColumn("__times", _times(F.row_number().over(by).cast("long"))).where("__times > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), "__times"))
    return d.select("__row", again.alias("__copy")).select("__row.*")
