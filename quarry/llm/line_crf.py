"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  Its potential is linear in its own features and in those of the lines before and after it;
transitions tie neighbouring labels.  Lines of a labelled document learn its label; forward-backward gives each line's
marginal, and a document's quality is the mean of its lines' marginals weighted by their length.  The field is trained on
a sample of at most TRAIN_DOCS labelled rows, chosen by a hash of the id, with all their lines: executors give the
likelihood and its gradient, the driver holds the weights alone.

Long texts are worked on by pieces of lines: of each line only its three potentials stay, and the chain is cut into
blocks whose messages are carried on from one to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.line_dedup import texts_of
from quarry.llm.toxicity import held_out, training_rows
from quarry.plans.cut import cut

#: Labelled rows, the likelihood's evaluations at most, remembered steps, ridge, and the gradient at which training ends.
TRAIN_DOCS, EVALUATIONS, MEMORY, RIDGE, FLAT = 3000, 60, 8, 1e-3, 1e-4
#: Bytes of texts that are worked on at a time, and lines in a block of a chain.
CHUNK, BLOCK = 1 << 21, 256

_CLASS_OF = np.full(256, 7, np.uint8)  # lower-case letters and all else
for _n, _bytes in enumerate((b" \t\r\x0b\x0c", bytes(range(65, 91)), b"0123456789", b".,;:'\"()-", b"!?", b"#*$%&@^~=+_\\/", b"|<>[]{}`")):
    _CLASS_OF[np.frombuffer(_bytes, np.uint8)] = _n
CLASSES = 8
#: Features of a line; the last is 1.
OWN = CLASSES + 9
#: Weights: a line's own features, those of the line before and of the line after (without the 1), and transitions.
WIDTH = OWN + 2 * (OWN - 1)


def line_features(pieces: list[bytes], seen: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line (rows x OWN), lines by piece, and length of each line in bytes.

    A piece is a number of whole lines; its text's earlier lines are in its set of `seen`, which takes in its own.
    """
    raw = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    stops = np.flatnonzero(raw == 10)
    starts = np.r_[0, stops[:-1] + 1]
    length = (stops - starts).astype(float)
    kind = _CLASS_OF[raw]
    x = np.zeros((len(stops), OWN))
    size = np.maximum(length, 1)
    for c in range(CLASSES - 1):
        x[:, c] = np.add.reduceat(kind == c, starts, dtype=np.int64) / size
    x[:, CLASSES - 1] = np.add.reduceat(raw >= 128, starts, dtype=np.int64) / size
    x[:, CLASSES + 7] = np.log1p(length) / 8
    x[:, CLASSES + 8] = 1.0
    n_lines = np.zeros(len(pieces), int)
    at = 0
    for t, (piece, before) in enumerate(zip(pieces, seen, strict=True)):
        lines = piece.split(b"\n")
        n_lines[t] = len(lines)
        for line in lines:
            words = line.split()
            n, own = len(words), x[at]
            if n:
                kinds = set(words)
                own[CLASSES] = 1 - len(kinds) / n  # repeated words
                own[CLASSES + 1] = min(1.0, n / 20)
                own[CLASSES + 2] = min(3.0, length[at] / n / 10)
                own[CLASSES + 3] = line.rstrip()[-1:] in (b".", b":", b"?", b'"')
                own[CLASSES + 4] = line in before
                own[CLASSES + 5] = float(n >= 8 and len(kinds) < n / 4)
                before.add(line)
            else:
                own[CLASSES + 6] = 1.0
            at += 1
    return x, n_lines, length


def _firsts(n_lines: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n_lines)[:-1]].astype(int) if len(n_lines) else np.zeros(0, int)


def potentials(parts: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's potential from (rows x 3): what it gives itself, the line after it and the line before it."""
    u = parts[:, 0].copy()
    u[1:] += parts[:-1, 1]
    u[:-1] += parts[1:, 2]
    first = _firsts(n_lines)
    inner = first[first > 0]  # starts of texts after the first one: their neighbours are another text's
    u[inner] -= parts[inner - 1, 1]
    u[inner - 1] -= parts[inner, 2]
    return u


def split_weights(w: np.ndarray) -> np.ndarray:
    """The weights of own features, of those for the line after and of those for the line before: OWN x 3."""
    before, after = w[OWN : 2 * OWN - 1], w[2 * OWN - 1 : WIDTH]
    return np.stack([w[:OWN], np.r_[before, 0.0], np.r_[after, 0.0]], axis=1)


def forward_backward(u: np.ndarray, trans: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The probability that each line is good, the pair marginals of each line with the next one (rows x 2 x 2, 0 at a
    text's last line), and each text's log partition; also the rows of texts' last lines.

    u: the good label's potential (the bad one's is 0).  Texts are cut into blocks of lines; all blocks go side by side,
    first to their products, which are carried along each text, then to the lines' messages.
    """
    n, move = len(u), np.exp(trans)
    top = np.maximum(u, 0)
    emit = np.stack([np.exp(-top), np.exp(u - top)], axis=1)
    first = _firsts(n_lines)
    n_blocks = -(-n_lines // BLOCK)
    text = np.repeat(np.arange(len(n_lines)), n_blocks)
    index = np.arange(len(text)) - np.repeat(_firsts(n_blocks), n_blocks)  # a block's number in its text
    start = first[text] + index * BLOCK
    length = np.minimum(BLOCK, n_lines[text] - index * BLOCK)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), side="right")  # blocks of more than t lines
    head = index == 0

    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x.reshape(len(x), -1).sum(axis=1)
        return x / s.reshape(-1, *[1] * (x.ndim - 1)), np.log(s)

    product = np.tile(np.eye(2), (len(text), 1, 1))
    scale = np.zeros(len(text))
    for t in range(int(length.max(initial=0))):
        b = order[: active[t]]
        step = product[b] if t == 0 else product[b] @ move
        if t == 0:
            step[~head[b]] = product[b][~head[b]] @ move
        product[b], more = scaled(step * emit[start[b] + t][:, None, :])
        scale[b] += more
    # messages into each block from the left, and onto its last line from the right
    left, right = np.ones((len(text), 2)), np.ones((len(text), 2))
    log_z = np.zeros(len(n_lines))
    for k in range(int(index.max(initial=-1)) + 1):
        b = np.flatnonzero(index == k)
        out, more = scaled(np.einsum("bi,bij->bj", left[b], product[b]))
        log_z[text[b]] += more + scale[b]
        on = k + 1 < n_blocks[text[b]]
        left[b[on] + 1] = out[on]
    for k in range(int(index.max(initial=-1)), 0, -1):
        b = np.flatnonzero(index == k)
        right[b - 1] = scaled(np.einsum("bij,bj->bi", product[b], right[b]))[0]
    log_z += np.add.reduceat(top, first) if len(first) else 0
    alpha, beta = np.empty((n, 2)), np.empty((n, 2))
    for t in range(int(length.max(initial=0))):
        b = order[: active[t]]
        a = left[b] if t == 0 else alpha[start[b] + t - 1] @ move
        if t == 0:
            a = np.where(head[b][:, None], a, a @ move)
        alpha[start[b] + t] = scaled(a * emit[start[b] + t])[0]
    for t in range(int(length.max(initial=0))):  # from the blocks' ends
        b = order[: active[t]]
        at = start[b] + length[b] - 1 - t
        beta[at] = right[b] if t == 0 else scaled((beta[at + 1] * emit[at + 1]) @ move.T)[0]
    m = alpha * beta
    good = m[:, 1] / m.sum(axis=1)
    last = np.cumsum(n_lines) - 1
    pairs = np.zeros((n, 2, 2))
    if n > 1:
        joint = alpha[:-1, :, None] * move * (beta[1:] * emit[1:])[:, None, :]
        pairs[:-1] = joint / joint.sum(axis=(1, 2), keepdims=True)
    pairs[last] = 0
    return good, pairs, log_z, last


def likelihood(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The texts' summed log-likelihood of all lines having their text's label, and its gradient, in one row.

    A text's log-likelihood is divided by its number of lines, transitions as well, so that texts weigh alike.
    """
    w, trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    u = potentials(x @ split_weights(w), n_lines)
    good, pairs, log_z, last = forward_backward(u, trans, n_lines)
    line = np.repeat(np.arange(len(n_lines)), n_lines)
    weight = 1.0 / n_lines
    value = np.where(labels == 1, np.add.reduceat(u, _firsts(n_lines)), 0) + (n_lines - 1) * trans[labels, labels] - log_z
    r = (labels[line] - good) * weight[line]
    inner = np.ones(len(u), bool)
    inner[last] = False  # rows with a next line in their text
    at = np.flatnonzero(inner)
    expected = (pairs * weight[line][:, None, None]).sum(axis=0)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = ((n_lines - 1) * weight)[labels == label].sum()
    g = [x.T @ r, x[at, :-1].T @ r[at + 1], x[at + 1, :-1].T @ r[at], (seen - expected).ravel()]
    return np.r_[(value * weight).sum(), np.concatenate(g), len(n_lines)]


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = EVALUATIONS) -> np.ndarray:
    """A minimum of a smooth convex function by limited-memory quasi-Newton steps with backtracking."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < most and np.abs(g).max() > FLAT:
        q, coefficients = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            coefficients.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(coefficients), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(q).max())
        while used < most:
            new = x - size * q
            new_value, new_g = f(new)
            used += 1
            if new_value <= value - 1e-4 * size * (g @ q):
                break
            size /= 2
        else:
            break
        if (new_g - g) @ (new - x) > 1e-12:
            steps = [*steps[-MEMORY + 1 :], (new - x, new_g - g)]
        x, value, g = new, new_value, new_g
    return x


def objective(sums: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean negative log-likelihood with ridge, from a function that gives likelihood()'s row over all texts."""

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        row = sums(theta)
        n = max(1.0, row[-1])
        return float(-row[0] / n + RIDGE / 2 * theta @ theta), -row[1:-1] / n + RIDGE * theta

    return f


class Crf:
    """Weights of the good label's potential (the bad one's is 0) and transitions."""

    def __init__(self, theta: np.ndarray):
        self.theta = theta
        self.weights, self.trans = split_weights(theta[:WIDTH]), theta[WIDTH:].reshape(2, 2)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The quality of each text."""
        out = np.zeros(len(texts))
        for a, b in _parts(texts):
            parts, n_lines, length = [], np.zeros(b - a, int), []
            seen: list[set[bytes]] = [set() for _ in range(a, b)]
            pieces = [(texts[a:b], seen)] if b - a > 1 else (([p], seen) for p in _pieces(texts[a]))
            for some, before in pieces:
                x, n, size = line_features(some, before)
                parts.append(x @ self.weights)
                length.append(size)
                n_lines += n
            good = forward_backward(potentials(np.vstack(parts), n_lines), self.trans, n_lines)[0]
            weight, first = np.concatenate(length) + 1e-6, _firsts(n_lines)
            out[a:b] = np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)
        return out


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most CHUNK bytes together, or one longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text by whole lines, about CHUNK bytes at a time."""
    at = 0
    while (stop := text.find(b"\n", at + CHUNK)) >= 0:
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


def fit(texts: list[bytes], labels: list[int]) -> Crf:
    """What train() learns, from a few texts in memory."""
    if len(set(labels)) < 2:
        return Crf(np.zeros(WIDTH + 4))
    x, n_lines, _ = line_features(texts, [set() for _ in texts])
    return Crf(minimum(objective(lambda theta: likelihood(x, n_lines, np.array(labels), theta)), np.zeros(WIDTH + 4)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Crf:
    """Learns from a sample of labelled texts; without labelled rows of both kinds every line is as likely good as bad.

    Repeated rows and labels count as often as they stand; a null text isn't learned from.
    """
    rows = training_rows(labels, "quality", most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), texts_of(batch), strict=True):
                seen: set[bytes] = set()
                parts = [line_features([p], [seen])[0].astype("<f4") for p in _pieces(text)]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([np.vstack(parts).tobytes()], pa.binary())], names=["label", "x"])

    d = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows.where("label in (0, 1)")), "doc_id")
    d = cut(d.select("label", "text").mapInArrow(features, "label int, x binary"))
    if d.select("label").distinct().count() < 2:
        return Crf(np.zeros(WIDTH + 4))

    def sums(theta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(WIDTH + 6)
            for batch in batches:
                held: list[np.ndarray] = []
                kinds: list[int] = []
                for label, x in zip(batch.column("label").to_pylist(), batch.column("x"), strict=True):
                    held.append(np.frombuffer(x.as_buffer(), "<f4").reshape(-1, OWN))
                    kinds.append(label)
                    if sum(map(len, held)) >= CHUNK // OWN:
                        total, held, kinds = total + _likelihood(held, kinds, theta), [], []
                if held:
                    total = total + _likelihood(held, kinds, theta)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["row"])

        return np.sum([r.row for r in d.mapInArrow(run, "row array<double>").collect()], axis=0)  # a row for each task

    return Crf(minimum(objective(sums), np.zeros(WIDTH + 4)))


def _likelihood(xs: list[np.ndarray], labels: list[int], theta: np.ndarray) -> np.ndarray:
    return likelihood(np.vstack(xs).astype(float), np.array([len(x) for x in xs]), np.array(labels), theta)


def score(docs: DataFrame, crf: Crf, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    A null or empty text is one empty line; a very long text is worked on by pieces, with the same result; rows are scored
    one by one, repeated or not; a null doc_id isn't held out; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crf.scores(texts_of(batch)))], names=["doc_id", "score"])

    s = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
