import random

import numpy as np

from fieldstream.llm import toxicity
from fieldstream.llm.toxicity import Network, Reader, classify, windows_of, words_of


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"ab", b"abc", b"xyz", b"q", b"longer"]
    index, lengths, y = rng.integers(0, 5, (6, 3)), np.array([6, 4, 1]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(index, net.gates(net.inputs(words)[0]), lengths).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = net.gradients(index, words, lengths, y)
    for k, g in found.items():
        at = int(np.abs(g.reshape(-1)).argmax())
        flat = net.p[k].reshape(-1)
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-2 - g.reshape(-1)[at]) < 2e-3 * max(1, abs(g.reshape(-1)[at]) * 10), k


def test_windows_cover_and_overlap():
    assert windows_of(0) == []
    for n in (1, 47, 48, 49, 84, 85, 1000):
        w = windows_of(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(a[1] > b[0] for a, b in zip(w, w[1:], strict=False)) and all(e - s <= toxicity.WINDOW for s, e in w)


def test_words():
    assert words_of("Ab, c-D été ÉTÉ!") == [b"ab", b"c", b"d", "été".encode(), "été".encode()]


def test_memo_of_words_is_bounded(monkeypatch):
    net = Network()
    net.calibration = np.array([1.0, 0.0, 0.0])
    texts = [" ".join(f"w{k * j}" for k in range(60)) for j in range(8)]
    whole = Reader(net).scores(texts)
    monkeypatch.setattr(toxicity, "KEPT", 70)
    reader = Reader(net)
    assert np.allclose([reader.scores([t])[0] for t in texts], whole, atol=1e-6)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 300))]
        bad = i % 4 == 0
        for _ in range(2 + len(words) // 60 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["bogus", "blarg"]) + rng.choice(["", "ed", "ing", "ly"]))
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int(bad)))
    rows += [(None, "", 1.0), (1000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.93 * len(held)
    assert {r.score for r in classify(docs, known.limit(0)).collect()} == {0.0}
    assert classify(docs.limit(0), known).count() == 0


def test_every_word_is_read():
    assert words_of("no no no") == [b"no"] * 3
    long = "漢字" * 500
    parts = words_of(f"a {long} b")
    assert parts[0] == b"a" and parts[-1] == b"b" and len(parts) > 100 and set(long.encode()) == set(b"".join(parts[1:-1]))
    chunks = [p.decode() for p in parts[1:-1]]
    assert all(a[toxicity.CHUNK_STEP :] == b[: toxicity.CHUNK - toxicity.CHUNK_STEP] for a, b in zip(chunks, chunks[1:], strict=False)) and long.endswith(chunks[-1])


def plain_score(net, text):
    """The forward pass for one text, window by window and word by word."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = words_of(text)
    vectors = [net.inputs([w])[0][0] for w in words]
    tops = []
    for s, e in windows_of(len(words)):
        states = []
        for d, order in (("f", range(s, e)), ("b", range(e - 1, s - 1, -1))):
            h, n, own = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN, {}
            for t in order:
                g = vectors[t] @ net.p[f"W{d}"] + net.p[f"b{d}"]
                zr = sigmoid(g[: 2 * n] + h @ net.p[f"U{d}"][:, : 2 * n])
                k = np.tanh(g[2 * n :] + (zr[n:] * h) @ net.p[f"U{d}"][:, 2 * n :])
                h = own[t] = h + zr[:n] * (k - h)
            states.append([own[t] for t in range(s, e)])
        h = np.concatenate(states, 1)
        a = np.exp(np.tanh(h @ net.p["A"] + net.p["a"]) @ net.p["v"])
        tops.append((a / a.sum()) @ h @ net.p["o"] + net.p["c"][0])
    if not tops:
        return 0.0
    slope, bias, per = net.calibration
    return float(sigmoid(slope * np.clip(max(tops), -12, 12) + bias + per * np.log(len(tops))))


def test_scores_equal_a_plain_reading():
    rng = random.Random(6)
    net = Network()
    net.calibration = np.array([3.0, 0.2, 0.1])
    texts = ["", " ", "one", "a a a a", " ".join(f"w{rng.randrange(40)}" for _ in range(200)), " ".join(f"v{rng.randrange(9)}" for _ in range(49)), "字" * 300]
    assert np.allclose(Reader(net).scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_training_without_words_and_repeats(spark):
    net = Network().fit(["", " !"], [0, 1])
    assert Reader(net).scores(["", "word"]).tolist() == [0.5, 0.5]
    docs = spark.createDataFrame([(k, "" if k % 2 else None, "x") for k in range(8)] + [(9, "word " * 50_000, "x")] * 2, "doc_id long, text string, held_out string")
    got = classify(docs, spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")).collect()
    assert len(got) == 10 and len({r.score for r in got}) == 1
