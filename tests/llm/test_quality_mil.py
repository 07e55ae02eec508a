import random

import numpy as np

from fieldstream.llm.quality_mil import FORMS, TRIGRAMS, Model, classify, passages


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, bag, y = rng.random((7, TRIGRAMS + FORMS)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([0.0, 1.0, 1.0])

    def loss():
        z = model.forward(x, bag, 3)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = model.gradients(x, bag, y)
    for k, g in found.items():
        flat, at = model.p[k].reshape(-1), rng.integers(model.p[k].size)
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-5, k


def test_passages():
    assert passages("").shape == (1, TRIGRAMS + FORMS) and not passages(" \n").any()
    assert len(passages("w " * 100)) == 1 and len(passages(" w" * 101)) == 2
    two = passages(" ".join(["Aa"] * 100 + ["b,1"] * 50))
    assert two[0, TRIGRAMS] == 100 / 300 and two[1, TRIGRAMS + 2] > 0.2


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(5, 350))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), 0.0))
        if i % 10:
            labels.append((i, 0 if bad else 1))
    rows += [(None, "", 1.0), (1000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held if r.doc_id < 300) > 0.95 * len(held)
    none = classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_scores_equal_a_plain_reading():
    """Gated attention over the passages of one text, passage by passage."""
    model, texts = Model(), ["", "one", "Word, " * 250, " ".join(f"w{k % 37}" for k in range(1000)), "x" * 100_000]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, want = model.p, []
    for t in texts:
        h = [np.tanh(x @ p["W"] + p["c"]) for x in passages(t)]
        a = np.exp([p["w"] @ (np.tanh(x @ p["V"]) * sigmoid(x @ p["U"])) for x in h])
        z = sum(w * x for w, x in zip(a / a.sum(), h, strict=True))
        want.append(sigmoid(z @ p["o"] + p["d"][0]))
    assert np.allclose(model.scores([passages(t) for t in texts]), want, atol=1e-5)
    again = model.scores([passages(t) for t in texts * 2])
    assert np.allclose(again[: len(texts)], again[len(texts) :], atol=1e-6)
