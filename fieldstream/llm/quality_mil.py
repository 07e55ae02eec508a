"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by a small network
over hashed byte trigrams and measures of its form; gated attention

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs the passages, and a logistic layer scores the weighted sum.  Only
documents are labelled: the attention is learnt from their labels.  Training is
numpy with Adam, on a bounded sample; scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts, labelled_sample, remainder

#: Labelled rows of either class that training takes at most.
PER_CLASS = 2000
PASSAGE_WORDS, TRIGRAMS, HIDDEN, ATTENTION = 100, 512, 24, 12
EPOCHS, RATE, DECAY, SEED = 12, 0.01, 1e-4, 11
FORMS = 10

# Classes of bytes: upper, lower, digit, space, line feed, sentence mark, other mark, above ASCII.
KIND = np.full(256, 6, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 0, 1, 2, 7
KIND[[9, 11, 12, 13, 32]], KIND[10], KIND[[33, 44, 46, 63]] = 3, 4, 5


def passages(text: str) -> np.ndarray:
    """One row of features per passage of 100 words; a text without words has one row of zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((n, TRIGRAMS + FORMS), np.float32)
    if not words:
        return out
    for k in range(n):
        own = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        out[k, -1], out[k, -2] = len(set(own)) / len(own), min(sum(map(len, own)) / len(own) / 16, 4)
    b = np.frombuffer(data, np.uint8)
    kinds = KIND[b]
    blank = (kinds == 3) | (kinds == 4)
    starts = ~blank
    starts[1:] &= blank[:-1]
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE_WORDS
    sizes = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    out[:, TRIGRAMS : TRIGRAMS + 8] = np.bincount(at * 8 + kinds, minlength=8 * n).reshape(n, 8) / np.maximum(sizes, 1)
    if len(b) > 2:
        wide = b.astype(np.uint32)
        code = ((wide[:-2] * np.uint32(65_599) + wide[1:-1]) * np.uint32(65_599) + wide[2:]) * np.uint32(2_654_435_769)
        grams = np.bincount(at[:-2] * TRIGRAMS + (code >> np.uint32(23)), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(grams / np.maximum(sizes, 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights: W, c (encoder), V, U, w (attention), o, d (output)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = TRIGRAMS + FORMS
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(size, HIDDEN) * 2, "c": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.prior = None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        """Logit of each bag; ``bag`` says which of the n bags a passage is in, ascending, none empty."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        first = np.searchsorted(bag, np.arange(n))
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return z @ p["o"] + p["d"][0], (h, t, g, a, z)

    def gradients(self, x, bag, y) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the bags."""
        p, n = self.p, len(y)
        logit, (h, t, g, a, z) = self.forward(x, bag, n)
        e = (_sigmoid(logit) - y) / n
        dz = e[:, None] * p["o"]
        da = (dz[bag] * h).sum(1)
        mean = np.add.reduceat(a * da, np.searchsorted(bag, np.arange(n)))
        ds = a * (da - mean[bag])
        dh = a[:, None] * dz[bag]
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = dh + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "c": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "o": z.T @ e, "d": np.array([e.sum()], np.float32)}

    def fit(self, bags: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> Model:
        y = np.array(labels, np.float32)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        rng, step = np.random.default_rng(SEED), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        batch = 32
        for _ in range(max(epochs, -(-400 * batch // len(y)) if len(y) < 400 else epochs)):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                x = np.concatenate([bags[i] for i in part])
                bag = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
                step += 1
                for k, g in self.gradients(x, bag, y[part]).items():
                    g = g + DECAY * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None or not bags:
            return np.full(len(bags), self.prior if self.prior is not None else 0.5)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return _sigmoid(self.forward(np.concatenate(bags), bag, len(bags))[0].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labels.quality`` from rows that aren't held out, at most ``per_class`` of either class."""
    texts, y = labelled_sample(docs, labels, "quality", remainder(3, 1), per_class)
    return Model().fit([passages(t) for t in texts], y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, most=2 << 20):
            found = shared.value.scores([passages(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of held-out rows are never read for training; nothing but the text
    makes a score, so equal texts and repeated rows score alike, up to 1e-6: the
    network sums in single precision, and the texts beside one in its batch decide the order.  Without labels of both classes the score is the share of label 1, or 0.5.
    A null or empty text scores as one passage without words; a very long one is read whole, passage by passage.
    A null doc_id stays null and is not held out; an empty table gives no rows; other columns are not read, so their names don't matter.
    """
    return score(docs, train(docs, labels)).select("doc_id", remainder(3, 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
