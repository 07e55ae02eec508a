"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a learned word vector (hashed) and the mean of learned vectors
of its character n-grams (hashed), so new forms of a known stem are understood.
Two gated recurrent layers read a window of words in both directions; attention
pools their states; a logistic layer scores the window.  Every text is covered
by overlapping windows, all of which are scored; the document's score is
calibrated from its highest window and the number of windows.

Training is numpy with back-propagation through time and Adam, on a bounded
sample of labelled documents.  Labels belong to documents: after the first
rounds, a toxic document trains with its highest windows, a clean one with its
highest and others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts, labelled_sample, remainder

#: Labelled rows of either class that training takes at most.
PER_CLASS = 1500
#: Words of a window, and between the starts of two.
WINDOW, STRIDE = 48, 36
WORDS, GRAMS, WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 1 << 13, 1 << 15, 4, 12, 8, 8
EPOCHS, RATE, SEED, BATCH = 10, 0.01, 5, 128
#: Shares of n-grams and of word vectors that training leaves out, and decay of either at each step.
DROP_GRAMS, DROP_WORDS, DECAY = 0.2, 0.5, 0.0004
#: Words whose gate inputs a worker keeps.
KEPT = 150_000
#: Windows that one pass of the recurrence takes.
AT_ONCE = 2048

#: A word of more bytes and more characters than this is read as overlapping chunks of so many characters, each so many characters after the
#: start of the last: a text in a script without spaces has windows like any other.
LONG_WORD, CHUNK, CHUNK_STEP = 24, 12, 8

#: ASCII letters become lower case, other ASCII signs than letters and digits a space.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: str) -> list[bytes]:
    """Folded words in order, each one that the text has; very long ones as overlapping chunks."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [x for w in words for x in (chunks_of(w) if len(w) > LONG_WORD else (w,))]


def chunks_of(word: bytes) -> list[bytes]:
    """Overlapping chunks of a word of more than LONG_WORD characters; together they cover it."""
    c = word.decode("utf-8", "surrogatepass")
    if len(c) <= LONG_WORD:
        return [word]
    return [c[k : k + CHUNK].encode("utf-8", "surrogatepass") for k in range(0, len(c) - CHUNK + CHUNK_STEP, CHUNK_STEP)]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte n-grams (3 to 5, with word ends) of all words: buckets, the word of each, and n-grams per word."""
    joined = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    code, found, of = joined * np.uint32(0x9E3779B1), [], []
    for n in range(2, 6):
        if len(joined) < n:
            break
        code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + joined[n - 1 :] * np.uint32(0x9E3779B1)
        if n > 2:
            ok = left[: len(code)] >= n
            found.append((code[ok] ^ (code[ok] >> np.uint32(13))) % np.uint32(GRAMS))
            of.append(owner[: len(code)][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(words))
    buckets, of = np.concatenate(found).astype(np.int64), np.concatenate(of)
    return buckets, of, np.maximum(np.bincount(of, minlength=len(words)), 1)


def buckets_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % WORDS for w in words), np.int64, len(words))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; the last ends with the text."""
    return [(s, min(s + WINDOW, n)) for s in range(0, max(n - WINDOW + STRIDE, 1), STRIDE)] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes.  For each direction d: W (input), U (state), b, gates in the order update, reset, candidate."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = WORD_DIM + GRAM_DIM
        draw = lambda scale, *s: (scale * rng.standard_normal(s)).astype(np.float32)
        self.p = {"word": draw(0.01, WORDS, WORD_DIM), "gram": draw(0.02, GRAMS, GRAM_DIM)}  # small, so what training never met stays neutral
        for d in "fb":
            self.p |= {f"W{d}": draw(size**-0.5, size, 3 * HIDDEN), f"U{d}": draw(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION**-0.5, ATTENTION), "o": draw((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.calibration = None  # (slope, bias, weight of the logarithm of the number of windows)
        self.prior = None

    def inputs(self, words: list[bytes], rng: np.random.Generator | None = None):
        """Vectors of distinct words, and what their gradients need; with ``rng``, some n-grams and most word vectors are left out."""
        grams, of, counts = grams_of(words)
        whole = np.ones((len(words), 1), np.float32)
        if rng is not None:
            stay = rng.random(len(grams)) >= DROP_GRAMS
            grams, of = grams[stay], of[stay]
            counts = np.maximum(np.bincount(of, minlength=len(words)), 1)
            whole = (rng.random((len(words), 1)) >= DROP_WORDS).astype(np.float32)
        mean = np.zeros((len(words), GRAM_DIM), np.float32)
        for k in range(GRAM_DIM):
            mean[:, k] = np.bincount(of, self.p["gram"][grams, k], len(words)) / counts
        hashed = buckets_of(words)
        return np.concatenate([self.p["word"][hashed] * whole, mean], 1), (hashed, grams, of, counts, whole)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates of both directions, side by side."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def _read(self, g: np.ndarray, mask: np.ndarray, u: np.ndarray, steps: list[int], trace: list | None) -> np.ndarray:
        """States (time, window, hidden) of one direction; where the mask is 0 the state stays."""
        n = HIDDEN
        h, out = np.zeros((g.shape[1], n), np.float32), np.zeros((g.shape[0], g.shape[1], n), np.float32)
        for t in steps:
            zr = _sigmoid(g[t, :, : 2 * n] + h @ u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            k = np.tanh(g[t, :, 2 * n :] + (r * h) @ u[:, 2 * n :])
            new = h + mask[t][:, None] * z * (k - h)
            if trace is not None:
                trace.append((t, h, z, r, k))
            h = out[t] = new
        return out

    def forward(self, index: np.ndarray, table: np.ndarray, lengths: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logit of each window; ``index`` (time, window) points into ``table``, the gates of distinct words."""
        p, n = self.p, 3 * HIDDEN
        times = np.arange(len(index))
        mask = (times[:, None] < lengths).astype(np.float32)
        g = table[index]
        tf, tb = ([], []) if trace is not None else (None, None)
        h = np.concatenate([self._read(g[:, :, :n], mask, p["Uf"], list(times), tf), self._read(g[:, :, n:], mask, p["Ub"], list(times[::-1]), tb)], 2)
        q = np.tanh(h @ p["A"] + p["a"])
        s = np.where(mask > 0, q @ p["v"], -1e9)
        e = np.exp(s - s.max(0))
        w = e / e.sum(0)
        pooled = (w[:, :, None] * h).sum(0)
        if trace is not None:
            trace.update(tf=tf, tb=tb, mask=mask, h=h, q=q, w=w, pooled=pooled)
        return pooled @ p["o"] + p["c"][0]

    def _unread(self, dout: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: list, dg: np.ndarray) -> np.ndarray:
        """Gradients of one direction: of the inputs (into ``dg``), and of U."""
        n, du, dh = HIDDEN, np.zeros_like(u), np.zeros(dout.shape[1:], np.float32)
        for t, h, z, r, k in reversed(trace):
            dh = dh + dout[t]
            m = mask[t][:, None]
            dk = dh * m * z * (1 - k * k)
            dz = dh * m * (k - h) * z * (1 - z)
            back = dk @ u[:, 2 * n :].T
            dr = back * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            dg[t] = np.concatenate([dzr, dk], 1)
            du[:, : 2 * n] += h.T @ dzr
            du[:, 2 * n :] += (r * h).T @ dk
            dh = dh * (1 - m * z) + back * r + dzr @ u[:, : 2 * n].T
        return du

    def gradients(self, index: np.ndarray, words: list[bytes], lengths: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the windows."""
        p, trace, n = self.p, {}, 3 * HIDDEN
        x, (hashed, grams, of, counts, whole) = self.inputs(words, rng)
        logit = self.forward(index, self.gates(x), lengths, trace)
        h, q, w, mask = (trace[k] for k in ("h", "q", "w", "mask"))
        e = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        dpooled = e[:, None] * p["o"]
        dw = (h * dpooled).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        dq = ds[:, :, None] * p["v"] * (1 - q * q)
        dh = w[:, :, None] * dpooled + dq @ p["A"].T
        dg = np.zeros((*index.shape, 2 * n), np.float32)
        out = {"o": trace["pooled"].T @ e, "c": np.array([e.sum()]), "v": np.einsum("tba,tb->a", q, ds), "A": np.einsum("tbh,tba->ha", h, dq), "a": dq.sum((0, 1))}
        out["Uf"] = self._unread(dh[:, :, :HIDDEN], mask, p["Uf"], trace["tf"], dg[:, :, :n])
        out["Ub"] = self._unread(dh[:, :, HIDDEN:], mask, p["Ub"], trace["tb"], dg[:, :, n:])
        flat, dtable = index.reshape(-1), np.zeros((len(words), 2 * n), np.float32)
        rows = dg.reshape(-1, 2 * n)
        for k in range(2 * n):
            dtable[:, k] = np.bincount(flat, rows[:, k], len(words))
        dx = dtable[:, :n] @ p["Wf"].T + dtable[:, n:] @ p["Wb"].T
        out |= {"Wf": x.T @ dtable[:, :n], "bf": dtable[:, :n].sum(0), "Wb": x.T @ dtable[:, n:], "bb": dtable[:, n:].sum(0)}
        out["word"], out["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        for k in range(WORD_DIM):
            out["word"][:, k] = np.bincount(hashed, dx[:, k] * whole[:, 0], WORDS)
        share = dx[:, WORD_DIM:] / counts[:, None]
        for k in range(GRAM_DIM):
            out["gram"][:, k] = np.bincount(grams, share[of, k], GRAMS)
        return out

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
        y = np.array(labels, np.float32)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.prior = float(y.mean()) if len(y) else 0.0
            return self
        docs = [words_of(t) for t in texts]
        words = sorted({w for d in docs for w in d})
        place = {w: k for k, w in enumerate(words)}
        ids = [np.array([place[w] for w in d], np.int64) for d in docs]
        rng, step = np.random.default_rng(SEED), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        spans = [(i, s, e) for i, d in enumerate(docs) for s, e in windows_of(len(d))]
        if not spans:  # no text has a word
            self.prior = float(y.mean())
            return self
        owner = np.array([i for i, _, _ in spans], np.int64)
        for epoch in range(max(epochs, min(60, 12_000 // len(y)))):
            # by score, the toxic documents' highest windows; of clean ones the highest and two others
            z = self._spans(spans, ids, words) if epoch else rng.random(len(spans))
            rank = np.lexsort((-z, owner))
            nth = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
            chosen = rank[nth < 2] if epoch > 3 else rank[nth < 4]
            other = rng.permutation(np.flatnonzero(y[owner] == 0))[: 2 * len(y)]
            take = rng.permutation(np.concatenate([chosen, other]))
            for part in np.array_split(take, max(1, len(take) // BATCH)):
                index, lengths, own = self._index([spans[k] for k in part], ids)
                step += 1
                for k, g in self.gradients(index, [words[j] for j in own], lengths, y[owner[part]], rng).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] = (self.p[k] * (1 - DECAY * (k in ("word", "gram"))) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._calibrate(self._spans(spans, ids, words), owner, y)
        return self

    @staticmethod
    def _index(spans: list[tuple[int, int, int]], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, window) places in a list of distinct words, the lengths, and those words."""
        lengths = np.array([e - s for _, s, e in spans])
        flat = np.zeros((len(spans), lengths.max()), np.int64)
        for k, (i, s, e) in enumerate(spans):
            flat[k, : e - s] = ids[i][s:e]
        own, index = np.unique(flat, return_inverse=True)
        return index.reshape(flat.shape).T, lengths, own

    def _spans(self, spans, ids, words) -> np.ndarray:
        """Logits of many windows of the training texts."""
        table = self.gates(self.inputs(words)[0])
        out = []
        for k in range(0, len(spans), AT_ONCE):
            index, lengths, own = self._index(spans[k : k + AT_ONCE], ids)
            out.append(self.forward(index, table[own], lengths))
        return np.concatenate(out) if out else np.zeros(0)

    def _calibrate(self, z: np.ndarray, owner: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the highest window and the number of windows, by Newton steps."""
        seen, first, counts = np.unique(owner, return_index=True, return_counts=True)
        x = np.stack([np.clip(np.maximum.reduceat(z, first), -12, 12), np.ones(len(seen)), np.log(counts)], 1).astype(np.float64)
        w, t = np.zeros(3), y[seen]
        for _ in range(30):
            q = _sigmoid(x @ w)
            # the ridge keeps the slope finite where the classes are apart
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (t - q) - 0.05 * w)
        self.calibration = w

    def score(self, top: np.ndarray, windows: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return _sigmoid(a * np.clip(top, -12, 12) + b + c * np.log(np.maximum(windows, 1)))


class Reader:
    """Scores texts with a network; keeps the gate inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net, self.places, self.table = net, {}, np.zeros((1024, 6 * HIDDEN), np.float32)

    def _look_up(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        new = sorted({w for d in docs for w in d if w not in self.places})
        if len(self.places) + len(new) > KEPT:
            self.places = {}
            new = sorted({w for d in docs for w in d})
        if new:
            start = len(self.places)
            while len(self.table) < start + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start : start + len(new)] = self.net.gates(self.net.inputs(new)[0])
            self.places.update(zip(new, range(start, start + len(new)), strict=True))
        return [np.fromiter(map(self.places.__getitem__, d), np.int64, len(d)) for d in docs]

    def scores(self, texts: list[str]) -> np.ndarray:
        """A text without words scores 0."""
        if self.net.prior is not None:
            return np.full(len(texts), self.net.prior)
        docs = [words_of(t) for t in texts]
        ids = self._look_up(docs)
        spans = [(i, s, e) for i, d in enumerate(docs) for s, e in windows_of(len(d))]
        top, count = np.full(len(texts), -np.inf), np.zeros(len(texts))
        for k in range(0, len(spans), AT_ONCE):
            part = spans[k : k + AT_ONCE]
            lengths = np.array([e - s for _, s, e in part])
            index = np.zeros((lengths.max(), len(part)), np.int64)
            for j, (i, s, e) in enumerate(part):
                index[: e - s, j] = ids[i][s:e]
            owner = np.array([i for i, _, _ in part])
            np.maximum.at(top, owner, self.net.forward(index, self.table, lengths))
            np.add.at(count, owner, 1)
        return np.where(count > 0, self.net.score(np.where(count > 0, top, 0), count), 0.0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """A network of ``labels.toxic`` from rows that aren't held out, at most ``per_class`` of either class."""
    return Network().fit(*labelled_sample(docs, labels, "toxic", remainder(4, 2), per_class))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null or empty text scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in in_parts(batches, most=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reader.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of held-out rows are never read for training; nothing but the text
    makes a score, so equal texts and repeated rows score alike, up to 1e-6: the
    network sums in single precision, and the texts beside one in its batch decide the order.  Without labels of both classes, or where no labelled text has a word, every score is the share of label 1, or 0.
    A null or empty text scores 0; a very long one is read whole, in windows.  A null doc_id stays null and is not held out; an empty table gives
    no rows; other columns are not read, so their names don't matter.
    """
    return score(docs, train(docs, labels)).select("doc_id", remainder(4, 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
