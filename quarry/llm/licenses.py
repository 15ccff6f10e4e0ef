"""License scans: base phrases, and diagonal voting of word k-grams against license templates (DataFrame only).

All rolling k-gram hashes of a text are joined with the positions of the same k-grams in the templates.  Hits are
summed by (text, template, offset diagonal) before anything is shuffled, and diagonals at most DRIFT apart are merged to
bands.  A band whose hits cover enough of the template's words is verified by windows: of the hits of one band, those
that lie within a length like the template's from some hit on must cover enough of it; the best window is the span.  A
hit is compared word by word, so hashes only preselect.  A text is known by its digest, so that rows that share an id
are judged by their own texts and rows that share a text are voted on once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.license_texts import NOTICES, TEXTS
from quarry.llm.text import literal_rows, split_words, whole
from quarry.plans.cut import cut
from quarry.plans.skew import heavy, spread_join

K, DRIFT, COVERED, STRETCH = 3, 3, 0.8, 1.5
#: Words of all templates up to which they are sent to all tasks; beyond it they are joined as any table.
SENT = 50_000
_NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_ENDS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase, label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

TEMPLATES = [*NOTICES, *TEXTS]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return split_words(F.translate(whole(text), _UPPER, _LOWER), f"[{_NOT_WORD}]+", _ENDS)


def grams(k: int = K) -> Column:
    """The hashes of the k-grams that start at each place, from the columns w (words) and h (their hashes)."""
    g = F.transform("h", lambda h, i: F.xxhash64(h, *(F.get("h", i + j) for j in range(1, k))))
    return F.when(F.size("w") >= k, F.slice(g, F.lit(1), F.size("w") - (k - 1)))


def _places(parts: list[str], label: str) -> Column:
    """Structs (at, label) for the places in w where parts stand one after the other."""

    def at(x: Column, i: Column) -> Column:
        rest = [F.get("w", i + j).eqNullSafe(F.lit(p)) for j, p in enumerate(parts[1:], 1)]
        return F.when(reduce(and_, rest, x == parts[0]), F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.filter(F.transform("w", at), lambda x: x.isNotNull())


def with_base(d: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_base, first_word, last_word and base_set to rows that have w."""
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    found = [F.when(F.contains("joined", F.lit(f" {p} ")), _places(p.split(" "), label)) for p, label in phrases]
    none = F.array().cast("array<struct<at:int,label:string>>")
    d = d.withColumn("joined", joined)
    d = d.withColumn("places", F.concat(*(F.coalesce(x, none) for x in found)))
    d = d.withColumn("n_base", F.size("places").cast("long"))
    d = d.withColumn("first_word", F.array_min("places")["at"].cast("long")).withColumn("last_word", F.array_max("places")["at"].cast("long"))
    return d.withColumn("base_set", F.array_distinct(F.transform("places", lambda x: x["label"]))).drop("joined", "places")


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, length, tpos, gram, tw): a template's k-grams with their hashes and words.

    templates: (label, text) pairs, or a table of these columns.  A template of fewer than k words has no k-grams.
    """
    if isinstance(templates, DataFrame):
        t = templates.select(F.xxhash64("label", "text").alias("template"), "label", "text").distinct()
    else:
        t = literal_rows(spark, ["template", "label", "text"], [(i, *x) for i, x in enumerate(templates)])
    t = t.select(F.col("template").cast("long").alias("template"), "label", words(F.col("text")).alias("w"))
    t = t.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("length", F.size("w")).withColumn("g", grams(k))
    t = t.select("template", "label", "length", "w", F.posexplode_outer("g").alias("tpos", "gram"))
    return t.select("template", "label", "length", "tpos", "gram", F.slice("w", F.col("tpos") + 1, F.lit(k)).alias("tw"))


def _coverage(tposes: Column, k: int) -> Column:
    """The share of the template's words that k-grams at these of its positions cover."""
    covered = F.array_distinct(F.flatten(F.transform(tposes, lambda p: F.sequence(p, p + (k - 1)))))
    return F.size(covered) / F.col("length")


def spans(d: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(key, template, label, coverage, start, stop, copies): the best verified span of each template and band in rows of
    (key, w), rows of one key having equal words; copies is how many rows have the key."""
    t = template_grams(d.sparkSession, templates, k)
    g = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("g", grams(k))
    # outer: else the optimizer filters by the size of g below all projections, where g is computed word by word again
    g = g.select("key", "w", F.posexplode_outer("g").alias("pos", "gram"))
    if not isinstance(templates, DataFrame) and sum(text.count(" ") + 1 for _, text in templates) <= SENT:
        t = F.broadcast(t)
    hits = g.join(t, "gram").where(F.slice("w", F.col("pos") + 1, F.lit(k)) == F.col("tw"))
    hits = hits.select("key", "template", "label", "length", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = hits.groupBy("key", "template", "label", "length", "diagonal").agg(F.collect_set("tpos").alias("tposes"), F.count("*").alias("n"))
    votes = cut(votes)
    # a band of neighbouring diagonals ends where the next one is more than DRIFT away
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT, F.lit(True))
    votes = votes.withColumn("band", F.sum(fresh.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    band = votes.groupBy("key", "template", "label", "length", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("all"), F.collect_list(F.struct("diagonal", "tposes")).alias("parts"), F.max((F.col("n") / F.size("tposes")).cast("long")).alias("copies")
    )
    band = band.where(_coverage(F.col("all"), k) >= COVERED).select("key", "template", "label", "length", "band", "copies", F.explode("parts").alias("part"))
    hit = band.select("key", "template", "label", "length", "band", "copies", "part.diagonal", F.explode("part.tposes").alias("tpos")).withColumn("pos", F.col("diagonal") + F.col("tpos"))
    # places by the longest way between a window's first and last hit, which is less than 1 then, and more than 1 one word further
    reach = F.floor(F.col("length") * F.lit(STRETCH)) + F.lit(DRIFT - k + 0.5)
    on = Window.partitionBy("key", "template", "band").orderBy("place").rangeBetween(0, 1)
    hit = hit.withColumn("place", F.col("pos").cast("double") / reach)
    hit = hit.withColumn("in", F.collect_set("tpos").over(on)).withColumn("stop", F.max("pos").over(on) + k).withColumn("coverage", _coverage(F.col("in"), k))
    best = F.max(F.struct("coverage", (-F.col("pos")).alias("before"), "stop")).alias("best")
    found = hit.where(F.col("coverage") >= COVERED).groupBy("key", "template", "label", "band").agg(best, F.max("copies").alias("copies"))
    return found.select("key", "template", "label", "best.coverage", (-F.col("best.before")).alias("start"), "best.stop", "copies")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    score is the largest share of a template that a span covers; 1 if there is a base phrase; 0 without either.  A null
    text is empty and has no words; a text is taken whole, however long, in one row; rows that share a doc_id, null
    included, are judged by their own texts; rows alike in both give rows alike; ties between spans don't show, since
    labels are sets and scores maxima; an empty table gives an empty result.
    """
    # a text's key is a digest of it, with its length: the same at each reading, whatever task reads it
    key = F.concat(F.md5(F.encode(whole(F.col("text")), "UTF-8")), F.char_length(whole(F.col("text"))).cast("string"))
    d = docs.select("doc_id", key.alias("key"), words(F.col("text")).alias("w"))
    base = with_base(d, phrases).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_set")
    found = spans(d.select("key", "w"), templates, k)
    found = cut(found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"), F.max("copies").alias("copies")))
    total = found.agg(F.sum("copies")).first()[0] or 0  # rows that have spans
    r = spread_join(base, found, "key", heavy(F.col("copies"), total))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    every = F.concat("base_set", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return r.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_set")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))
