"""Quality rules: word statistics and distribution divergence from language references (DataFrame operations only).

A document's reference is the summed histograms of all documents of its language, so one narrow scan of the corpus makes
the references and its per-document numbers; texts are never shuffled.  Null and empty texts have no words and fail the
base rules; a null language is a language of its own; repeated rows are judged one by one; an empty table gives an empty
result.  Repeated windows are found by 64-bit hashes of eight words inside one row, by sorting, so the longest texts cost
n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import split_words, whole
from quarry.plans.cut import cut

# Frequent function words of four languages; how often each occurs is counted in the corpus.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on are this an at "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au avec il "
    "el y los se del las por con no una su para es al lo como más pero sus o"
).split()
WORDS = tuple(dict.fromkeys(COMMON_WORDS))
#: What isn't of a class, by class: white space, capitals, digits, punctuation, symbols.
CLASSES = (r"[^ \t-\r]+", r"[^A-Z]+", r"[^0-9]+", r"""[^.,;:!?'"()\-]+""", r"[^#*$%&|<>]+")
SYMBOLS = 4
#: The same for classes outside ASCII: Greek and Cyrillic, other letters up to U+1FFF, ideographs and all beyond U+2E80.
SCRIPTS = (r"[^\u0370-\u052F]+", r"[^\u0530-\u1FFF]+", r"[^\u2E80-\x{10FFFF}]+")
#: Besides these, continuation bytes of UTF-8 and the rest.
N_CLASSES = len(CLASSES) + len(SCRIPTS) + 2
WINDOW = 8


def histograms(docs: DataFrame) -> DataFrame:
    """Adds words, n_words, classes (counts of bytes by class) and commons (counts of WORDS, then of other words)."""
    text = F.col("__text")
    counts = [F.char_length(F.regexp_replace(text, c, "")) for c in CLASSES]
    # a pass for what isn't ASCII, if there is any; its classes are counted in that alone
    counts += [F.char_length(F.regexp_replace("__wide", c, "")) for c in SCRIPTS]
    d = docs.withColumn("__text", whole(F.col("text")))
    d = d.withColumn("__wide", F.when(F.octet_length(text) > F.char_length(text), F.regexp_replace(text, r"[\x00-\x7F]+", "")).otherwise(""))
    d = d.withColumn("words", split_words(text)).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("marks", F.array(*counts, F.octet_length(text) - F.char_length(text)).cast("array<bigint>"))
    rest = F.octet_length(text) - F.aggregate("marks", F.lit(0).cast("long"), lambda s, x: s + x)
    d = d.withColumn("classes", F.concat("marks", F.array(rest)))
    d = d.withColumn("known", F.filter("words", lambda w: w.isin(*WORDS)))
    # known is named twice in the lambda, so that the optimizer doesn't move its computation in there
    found = F.transform(F.array(*map(F.lit, WORDS)), lambda v: (F.size("known") - F.size(F.array_remove("known", v))).cast("long"))
    d = d.withColumn("commons", F.concat(found, F.array(F.col("n_words") - F.size("known"))))
    return d.drop("known", "__wide")


def base_counts(d: DataFrame) -> DataFrame:
    """Adds the base columns to what histograms() gave; drops its words."""
    text, n = F.col("__text"), F.size("words")
    d = d.withColumn("word_chars", F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
    d = d.withColumn("n_symbols", F.element_at("marks", SYMBOLS + 1))
    d = d.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform("hashes", lambda h, i: F.xxhash64(h, *(F.get("hashes", i + k) for k in range(1, WINDOW))))
    d = d.withColumn("windows", F.when(n > WINDOW, F.slice(window, F.lit(1), n - (WINDOW - 1))))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    s = lambda j: F.get("sorted", j)["w"]
    twice = F.filter("sorted", lambda x, j: (s(j - 1).eqNullSafe(x["w"])) | (s(j + 1).eqNullSafe(x["w"])))
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each repeated window covers up to the next one's start, the last all its words
    gaps = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return d.drop("words", "lines", "hashes", "windows", "sorted", "starts", "marks")


#: The largest distances from its language's reference that a document may have, and the least sizes that are judged.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_BYTES, MIN_WORDS = 0.32, 0.45, 200, 50
#: A text without any common word lies at a distance that its language's share of common words gives.  Documents beyond this part
#: of it are far too, if that share leads one to expect so many common words among theirs (8: one text in 2,900 has none by chance).
NO_COMMON, MIN_EXPECTED = 0.97, 8

MANY_LANGUAGES = 1000


def _js_distance(d: DataFrame, name: str, p: str, q: str) -> DataFrame:
    """Adds the Jensen-Shannon distance (base 2, 0 to 1) of two histograms of one length; null if one of them is empty.

    The totals are columns of their own, so that they aren't summed for each entry again.
    """
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    d = d.withColumns({"__p": F.nullif(total(p), F.lit(0.0)), "__q": F.nullif(total(q), F.lit(0.0))})
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = lambda x, y: (half(x, (x + y) / 2) + half(y, (x + y) / 2)) / 2
    parts = F.zip_with(p, q, lambda x, y: both(x / F.col("__p"), y / F.col("__q")))
    return d.withColumn(name, F.sqrt(F.greatest(total(parts), F.lit(0.0)))).drop("__p", "__q")


def references(d: DataFrame) -> DataFrame:
    """(__lang, class_ref, common_ref): the summed histograms of all documents of each language; null is one of them."""
    sums = [F.sum(F.get(h, F.lit(i))).alias(f"{h}{i}") for h, n in (("classes", N_CLASSES), ("commons", len(WORDS) + 1)) for i in range(n)]
    ref = d.groupBy(F.col("lang").alias("__lang")).agg(*sums)
    pick = lambda h, n: F.array(*(F.col(f"{h}{i}") for i in range(n)))
    return ref.select("__lang", pick("classes", N_CLASSES).alias("class_ref"), pick("commons", len(WORDS) + 1).alias("common_ref"))


def with_common_share(refs: DataFrame) -> DataFrame:
    """Adds __share (common words among all words of the language) and __without (the word distance of a text that has none)."""
    rest = F.element_at("common_ref", -1) / F.nullif(F.aggregate("common_ref", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    refs, rest = refs.withColumn("__rest", rest), F.col("__rest")
    alike = F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(0.0)
    without = F.sqrt(F.greatest((F.log2(2 / (1 + rest)) + (1 - rest) + alike) / 2, F.lit(0.0)))
    return refs.withColumn("__share", 1 - rest).withColumn("__without", without).drop("__rest")


def judge(d: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance (null under the length guards) and kept."""
    refs = with_common_share(cut(refs))
    # a row for each language: sent to all tasks if there are as few as that, else joined as any table
    refs = F.broadcast(refs) if refs.count() <= MANY_LANGUAGES else refs
    d = d.join(refs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    size = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    d = _js_distance(d, "class_distance", "classes", "class_ref")
    d = _js_distance(d, "word_distance", "commons", "common_ref")
    d = d.withColumn("class_distance", F.when(size >= MIN_BYTES, F.col("class_distance")))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, F.col("word_distance")))
    bare = F.when(F.col("n_words") * F.col("__share") >= MIN_EXPECTED, NO_COMMON * F.col("__without"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > F.least(F.lit(MAX_WORD_DISTANCE), bare))
    return d.withColumn("kept", ~F.col("base_failed") & ~far).drop("__lang", "class_ref", "common_ref", "classes", "commons", "__share", "__without")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the distances, for each row of docs (doc_id, text, lang)."""
    d = cut(base_counts(histograms(docs.select("doc_id", "lang", "text"))).drop("text", "__text"))
    return judge(d, references(d)).drop("lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns.  The references are made first; texts aren't shuffled."""
    names, key = docs.columns, "__row"
    row = F.struct(*(docs[c] for c in names))
    d = docs.select(row.alias(key), docs["lang"].alias("lang"), docs["text"].alias("text"))
    refs = references(histograms(d.select("lang", "text")))
    # the optimizer doesn't push a filter below the projection that numbers rows; it would compute everything anew there
    judged = judge(base_counts(histograms(d)), refs).withColumn("__number", F.monotonically_increasing_id())
    return judged.where("kept and __number >= 0").select(f"{key}.*")
