"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts, normalised by length, with exception phrases.

Folding undoes disguises: letters that look like Latin ones (other scripts, accents, full width) and digits and signs
that stand for letters become the letter; i, l and 1 become one.  A number, a run of digits and signs without any
letter beside it, is none of these.  Words of the lexicon count where they stand as words; learned fragments where a
word starts with them; neither inside an exception phrase.

Fragments, first letters of words of any language, and the calibration come from a sample of at most TRAIN_DOCS labelled
rows, chosen by a hash of the id.  A fragment weighs the lower confidence bound of its log odds: how much more often a
word form of a toxic text starts with it than one of a clean text.  Near copies among the learned texts count once.  The
least weight is chosen by cross-validation inside the sample, and so is the calibration: each row's features come from
fragments that were weighed without its fold.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import cut

#: Labelled rows that are learned from at most; one row of FOLDS is held out, the others are cross-validated in INNER folds.
TRAIN_DOCS, FOLDS, INNER = 12_000, 5, 4
#: Letters of a fragment, toxic texts that it must be in at least, standard errors below its log odds, least weights tried,
#: and the most fragments in a lexicon, the heaviest ones.
SHORTEST, LONGEST, MIN_TOXIC, CONFIDENCE, BOUNDS, MOST_FRAGMENTS = 4, 8, 4, 2.33, (0.75, 1.25, 1.75, 2.25), 5000
#: Near copies: words in a shingle, hashes of a signature, hashes in a band, and the share of equal hashes.
SHINGLE, SIGNATURE, BAND, ALIKE = 5, 32, 4, 0.8

# Common insults, slurs on persons' worth and profanities, with first weights; words learned add to them.
LEXICON = {
    2.0: "idiot moron imbecile scum scumbag pathetic worthless disgusting bastard asshole bitch whore slut cunt fuck fucker fucking motherfucker shithead dickhead subhuman vermin retard",
    1.5: "stupid loser trash clown dumbass jackass crap shit degenerate filthy repulsive despicable",
    1.0: "dumb ugly garbage hate kill freak creep pig fool jerk",
}
EXCEPTIONS = "trash can, trash bin, trash bag, class clown, clown fish, kill switch, kill process, garbage collection, garbage collector, fool proof, guinea pig, sore loser rule, hate crime, hate speech, filthy rich"
# A letter, and the lower-case letters of other scripts, digits and signs that pass for it.
LOOKALIKES = {
    "a": "аαɑ4@", "b": "вβƅ", "c": "сϲ", "d": "ԁ", "e": "еεє3", "f": "ƒ", "g": "ɡց", "h": "һн", "i": "іιıɩ1", "j": "јϳ", "k": "кκ",
    "l": "ӏł", "m": "мϻ", "n": "пηո", "o": "оοσөø0", "p": "рρ", "q": "ԛ", "r": "гɾ", "s": "ѕꜱ5", "t": "тτ7", "u": "υսʋ", "v": "νѵ",
    "w": "ԝωѡ", "x": "хχ", "y": "уγү", "z": "ᴢʐ",
}
_LATIN = {x: letter for letter, xs in LOOKALIKES.items() for x in xs}


class Fold(dict):
    """Code point -> folded character, for str.translate; made as code points turn up."""

    def __missing__(self, point: int) -> str:
        low = chr(point).lower()
        c = low if low in _LATIN else unicodedata.normalize("NFKD", chr(point)).lower()
        c = "".join(_LATIN.get(x, x) for x in c if not unicodedata.combining(x))
        c = c.replace("l", "i").replace("|", "i")
        if unicodedata.category(chr(point)) == "Cf":
            c = ""  # invisible characters inside words
        self[point] = c
        return c


_fold = Fold()
_SIGNS = re.compile(r"[$!](?=[a-z])", re.I)
#: Digits and signs with no letter beside them.
_NUMBER = re.compile(r"(?<![^\W_])(?<![@$!|])[\d@$!|]++(?![^\W_])")
_BETWEEN = re.compile(r"\s+")
_MARKS = re.compile(r"[^\w ]+|_+")


def fold(text: str) -> str:
    """The text with its disguises undone."""
    if "$" in text or "!" in text:
        text = _SIGNS.sub(lambda m: "s" if m[0] == "$" else "i" if m.start() and text[m.start() - 1].isalnum() else "!", text)
    return text.translate(_fold)


def plain(text: str) -> str:
    """The folded words, a blank before and after each; other marks stand between words as words of their own."""
    return f" {_MARKS.sub(' . ', _BETWEEN.sub(' ', fold(_NUMBER.sub('.', text))))} "


def word_forms(text: str) -> list[str]:
    """The folded words of a text."""
    return [w for w in plain(text).split() if w != "."]


@dataclass
class Model:
    """Weights by folded word, weights by fragment, exception phrases, and the calibration: a factor for each feature."""

    words: dict[str, float]
    fragments: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=lambda: [plain(e) for e in EXCEPTIONS.split(",")])
    beta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 1.0, 1.0]))

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns with the blanks around them, each with its length and its weight, none for an exception."""
        a = ahocorasick.Automaton()
        for w, x in self.words.items():
            for form in (w, w + "s", w + "es"):
                if form == w or form not in self.words:
                    a.add_word(f" {form} ", (len(form) + 2, x))
        for f, x in self.fragments.items():
            a.add_word(f" {f}", (len(f) + 1, x))
        for e in self.exceptions:
            a.add_word(re.sub(" +", " ", e), (len(re.sub(" +", " ", e)), None))
        a.make_automaton()
        return a


def first_model() -> Model:
    """The lexicon with its first weights."""
    return Model({fold(w): x for x, ws in LEXICON.items() for w in ws.split()})


def hits(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, stop, weight) in the plain text: the heaviest match at each word."""
    found: dict[int, tuple[int, int, float]] = {}
    spared = []
    for end, (n, weight) in automaton.iter(re.sub(" +", " ", plain(text))):
        a, b = end + 1 - n, end + 1
        if weight is None:
            spared.append((a, b))
        elif a not in found or found[a][2] < weight:
            found[a] = (a, b, weight)
    return [x for x in found.values() if not any(a <= x[0] and x[1] <= b for a, b in spared)]


def summary(weights: list[float], n_words: int) -> tuple[float, float, float, float]:
    """1, whether there is a hit, log of the weights' sum, log of that sum per hundred words."""
    total = sum(weights)
    return 1.0, float(total > 0), math.log1p(total), math.log1p(100 * total / max(1, n_words))


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float, float]:
    return summary([x[2] for x in hits(text, automaton)], text.count(" ") + text.count("\n"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ b)
        g = x.T @ (p - y) + ridge * b
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return b


def fragments_of(text: str) -> Counter[str]:
    """How many different words of a text start with each fragment; '' counts them all."""
    forms = {w for w in word_forms(text) if len(w) >= SHORTEST}
    found = Counter(w[:n] for w in forms for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    found[""] = len(forms)
    return found


def signature(text: str) -> list[int]:
    """Least hashes of a text's word shingles, one for each of SIGNATURE orders."""
    w = word_forms(text)
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + SHINGLE])) for i in range(max(1, len(w) - SHINGLE + 1))], np.uint64)
    odd = np.arange(1, 2 * SIGNATURE, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int((h * k ^ (h >> np.uint64(29))).min() >> np.uint64(1)) for k in odd]


def copies(signatures: list[list[int]], kinds: list[int]) -> list[bool]:
    """Whether each row is a near copy of an earlier one of its kind."""
    bands, again = defaultdict(list), []
    for i, (s, kind) in enumerate(zip(signatures, kinds, strict=True)):
        keys = [(kind, k, *s[k : k + BAND]) for k in range(0, SIGNATURE, BAND)]
        near = {j for key in keys for j in bands[key]}
        again.append(any(sum(a == b for a, b in zip(s, signatures[j], strict=True)) >= ALIKE * SIGNATURE for j in near))
        if not again[-1]:
            for key in keys:
                bands[key].append(i)
    return again


#: fragment -> INNER x 4 counts: toxic texts, clean texts, words in toxic texts, words in clean texts; '' has the totals.
Counts = dict[str, np.ndarray]


def weigh(counts: Counts, but: int | None, least: float) -> dict[str, float]:
    """The fragments that weigh `least` or more, by counts without fold `but`; of a fragment and a longer one, the longer
    stays only if it weighs more, the shorter only if it stands before other letters too."""

    def of(c: np.ndarray) -> list[float]:
        return (c.sum(axis=0) - (c[but] if but is not None else 0)).tolist()

    if "" not in counts:
        return {}
    _, _, all_toxic, all_clean = of(counts[""])
    weights, size = {}, {}
    for f, c in counts.items():
        toxic, clean, w_toxic, w_clean = of(c)
        if f and toxic >= MIN_TOXIC:
            odds = math.log((w_toxic + 0.5) / (all_toxic + 1)) - math.log((w_clean + 0.5) / (all_clean + 1))
            weights[f], size[f] = odds - CONFIDENCE * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), (toxic, clean, w_toxic, w_clean)
    closed = set(weights) - {g[:-1] for g in weights if size.get(g[:-1]) == size[g]}
    kept: dict[str, float] = {}
    for f in sorted(closed, key=len):
        if weights[f] >= least and not any(kept.get(f[:n], -math.inf) >= weights[f] for n in range(SHORTEST, len(f))):
            kept[f] = weights[f]
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MOST_FRAGMENTS])


def models(counts: Counts) -> list[tuple[float, list[Model], Model]]:
    """By least weight: the models without each fold, and that of all folds."""
    words = first_model().words
    with_fragments = lambda but, least: Model(words, weigh(counts, but, least))
    return [(least, [with_fragments(k, least) for k in range(INNER)], with_fragments(None, least)) for least in BOUNDS]


def calibrated(tried: list[tuple[float, list[Model], Model]], x: np.ndarray, y: np.ndarray) -> Model:
    """The model whose features x[:, k] (of rows judged without their fold) fit the labels y best, with its calibration."""
    if not 0 < y.sum() < len(y):
        return first_model()
    betas = [logistic(x[:, k], y) for k in range(len(tried))]
    p = [np.clip(_sigmoid(x[:, k] @ b), 1e-6, 1 - 1e-6) for k, b in enumerate(betas)]
    best = int(np.argmin([-(y * np.log(q) + (1 - y) * np.log(1 - q)).sum() for q in p]))
    model = tried[best][2]
    model.beta = betas[best]
    return model


def fit(texts: list[str], labels: list[int]) -> Model:
    """What train() learns, from a few texts in memory; folds by the texts' checksum."""
    folds = [zlib.crc32(t.encode("utf-8", "replace")) % INNER for t in texts]
    counts: Counts = defaultdict(lambda: np.zeros((INNER, 4)))
    for t, label, k, again in zip(texts, labels, folds, copies([signature(t) for t in texts], labels), strict=True):
        for f, n in ({} if again else fragments_of(t)).items():
            counts[f][k, [1 - label, 3 - label]] += 1, n
    tried = models(counts)
    automata = [[m.automaton() for m in inner] for _, inner, _ in tried]
    x = np.array([[features(t, a[k]) for a in automata] for t, k in zip(texts, folds, strict=True)]).reshape(-1, len(BOUNDS), 4)
    return calibrated(tried, x, np.array(labels, float))


def training_rows(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` (doc_id, label) that may be learned from: rows without nulls whose crc32 of the id isn't 0 mod FOLDS."""
    d = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return d.where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _texts(batch: pa.RecordBatch) -> Iterable[str]:
    return (t or "" for t in batch.column("text").to_pylist())


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learns from a sample of labelled texts; without labelled rows of both kinds the first weights hold.

    Texts stay on the executors: the driver takes a signature and a few numbers for each of `most` rows, and the
    fragments that may come into a lexicon.
    """
    rows = training_rows(labels, "toxic", most)
    d = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id")
    d = d.select("label", "text", F.xxhash64("doc_id", "label", "text").alias("row"))
    d = cut(d.where("label in (0, 1)").withColumn("fold", F.pmod(F.shiftright("row", 20), F.lit(INNER)).cast("int")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.array([signature(t) for t in _texts(b)], pa.list_(pa.int64()))], names=["row", "label", "signature"])

    signed = sorted(map(tuple, d.mapInArrow(sign, "row bigint, label int, signature array<bigint>").distinct().collect()))
    if len({r[1] for r in signed}) < 2:
        return first_model()
    again = {r[0] for r, c in zip(signed, copies([r[2] for r in signed], [r[1] for r in signed]), strict=True) if c}
    skipped = docs.sparkSession.sparkContext.broadcast(again)  # numbers of at most `most` rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, label, k, t in zip(b.column("row").to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist(), _texts(b), strict=True):
                found = {} if row in skipped.value else fragments_of(t)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([label] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["f", "label", "fold", "n"])

    parts = d.dropDuplicates(["row"]).mapInArrow(split, "f string, label int, fold int, n bigint")
    cell = lambda k, label, x: F.sum(F.when((F.col("fold") == k) & (F.col("label") == label), x).otherwise(0))
    cells = F.array(*(cell(k, label, x) for k in range(INNER) for x in (F.lit(1), F.col("n")) for label in (1, 0)))
    counts = parts.groupBy("f").agg(cells.alias("c"), F.sum("label").alias("toxic"))
    counts = counts.where((F.col("f") == "") | (F.col("toxic") >= MIN_TOXIC)).select("f", "c")
    table = cut(counts)
    total = np.array(table.where("f = ''").first().c, float).reshape(INNER, 4).sum(axis=0)
    # the others can't reach the least weight
    toxic, clean = (sum((F.get("c", F.lit(4 * k + x)) for k in range(INNER)), F.lit(0)) for x in (2, 3))
    lifted = toxic * float(total[3] + 1) > (clean + 1) * float(total[2] + 1) * math.exp(min(BOUNDS))
    got = {r.f: np.array(r.c, float).reshape(INNER, 4) for r in table.where((F.col("f") == "") | lifted).collect()}
    tried = models(got)
    inner = docs.sparkSession.sparkContext.broadcast([x[1] for x in tried])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [[m.automaton() for m in ms] for ms in inner.value]
        for b in batches:
            x = [[v for a in automata for v in features(t, a[k])] for k, t in zip(b.column("fold").to_pylist(), _texts(b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["row", "label", "x"])

    judged = sorted(map(tuple, d.mapInArrow(judge, "row bigint, label int, x array<double>").collect()))
    return calibrated(tried, np.array([r[2] for r in judged]).reshape(len(judged), len(BOUNDS), 4), np.array([r[1] for r in judged], float))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    A null text is an empty one and scores as any text without hits; a text is taken whole, however long, by itself; rows
    are scored one by one, repeated or not; a null doc_id isn't held out; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([features(t, automaton) for t in _texts(batch)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(x @ model.beta))], names=["doc_id", "score"])

    s = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
