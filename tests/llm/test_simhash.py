import numpy as np
import pyarrow as pa
import xxhash

from fieldstream.llm import simhash


def brute(rows, words=3, radius=2):
    """doc_id -> (fingerprint, component) with all pairs compared."""
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
                    moved = True
    return sorted((d, f"{f:016x}", min(rows[k][0] for k in range(len(rows)) if group[k] == g)) for (d, _), f, g in zip(rows, fps, group, strict=True))


def texts(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 60))]
        rows.append((10 * i + 3, " ".join(w)))
        for k in range(int(rng.integers(0, 4))):
            v = list(w)
            if k:
                v[int(rng.integers(len(v)))] = "other"
            rows.append((10 * i + 4 + k, "  ".join(v).upper()))
    return [*rows, (1, ""), (2, None), (0, " \t"), (5, "one two"), (6, "One  two")]


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.fingerprints(df).collect()))
    assert got == brute(rows)
    small = sorted(map(tuple, simhash.fingerprints(df, tile=2).collect()))
    assert small == got


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "other words here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.fingerprints(df).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    assert simhash.fingerprints(df.limit(0)).count() == 0


def test_rows_without_id_link_too(spark, monkeypatch):
    fps = {b"a": 0, b"b": 3, b"c": 15, b"d": 31 << 40}
    monkeypatch.setattr(simhash, "_narrow", lambda words: lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([fps[t] for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"]) for b in batches))
    df = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c"), (None, "d"), (5, "a")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.fingerprints(df).collect()) == [("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]


def test_link_matches_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6 << 20)]).reshape(-1, 1)
    label = simhash._link(fps, None, 2, np.arange(len(fps)))
    near = np.bitwise_count(fps ^ fps.T) <= 2
    assert all(label[i] == label[j] for i, j in zip(*np.nonzero(near), strict=True))
    assert len(set(label)) == 40


def test_near_groups(spark):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    near = [*base[:200], "x", *base[201:]]
    far = [f"v{x}" for x in rng.integers(0, 5000, 400)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, ""), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.root for r in simhash.near_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert sorted(r.doc_id for r in simhash.drop_near(df).collect()) == [1, 3, 4]


def test_first_shingles_meet():
    """Two sets alike by 0.8 share one of their first shingles in any order that holds for both."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and both >= 0.8 * (len(a) + len(b) - both):
            reach = [simhash.reach_of(len(x), 0.8) for x in (a, b)]
            firsts = [set(sorted(simhash.first_ones(x, r).tolist(), key=lambda h: (h % simhash.FIRST_CLASS != 0, h))[:r]) for x, r in zip((a, b), reach, strict=True)]
            assert firsts[0] & firsts[1]


def test_long_common_and_repeated(spark):
    """A passage that all share links nobody; a group of near copies with edits at other places is one; long texts and repeated rows count whole."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    passage, base, long = words(60), words(200), words(60_000)
    rows = [(k, [*passage, *words(120)]) for k in range(60)]
    for k in range(60):
        v = list(base)
        v[int(rng.integers(200))] = f"e{k}"
        rows.append((100 + k, v))
    rows += [(300, long), (301, [*long[:-50], *words(50)]), (302, ["x"]), (302, ["x"]), (303, ["x", "X"]), (304, words(3))]
    df = spark.createDataFrame([(d, " ".join(w), "k") for d, w in rows], "doc_id long, text string, key string")
    for tile in (simhash.TILE, 7):
        got = simhash.near_groups(df, tile=tile).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.root for r in got} == {d: 100 if 100 <= d < 160 else 300 if d == 301 else d for d, _ in rows}


def test_near_groups_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        w = [f"a{x}" for x in rng.integers(0, 5000, int(rng.choice([8, 14, 60, 300])))]
        rows.append((10 * i, w))
        for k in range(2):
            v = list(w)
            for at in rng.choice(len(v) // 5, max(1, round(len(v) * rng.uniform(0.015, 0.035))), replace=False):
                v[5 * at] = f"b{rng.integers(5000)}"
            rows.append((10 * i + 1 + k, v if len(w) > 20 else w[: len(w) - 1 - k]))
    sets = [{*zip(*(w[i:] for i in range(5)), strict=False)} for _, w in rows]
    group, close = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += 0.7 <= alike < 0.9
            if alike >= 0.8 and group[i] != group[j]:
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    assert close > 100
    want = {d: rows[g][0] for (d, _), g in zip(rows, group, strict=True)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    for tile in (simhash.TILE, 5):
        assert {r.doc_id: r.root for r in simhash.near_groups(df, tile=tile).collect()} == want


def test_large_group_is_linear(spark):
    """Of a group over many tiles, neighbours meet, and then only rows that are not of it; nothing is lost."""
    rng = np.random.default_rng(8)
    base, own = [f"w{x}" for x in rng.integers(0, 100_000, 300)], lambda n: [f"v{x}" for x in rng.integers(0, 100_000, n)]
    rows = [(k, [*base[: 5 * int(rng.integers(60))], f"e{k}", *base]) for k in range(240)]
    rows = [(d, w[-300:] if d % 2 else w[-300:-8]) for d, w in rows]
    rows += [(1000 + k, [*base[:150], *own(150)]) for k in range(20)]
    rows += [(2000 + k, [*w[:-2], f"z{k}", "z"]) for k, (_, w) in enumerate(rows[240:])]
    sets = [{*zip(*(w[i:] for i in range(5)), strict=False)} for _, w in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    want = {d: rows[g][0] for (d, _), g in zip(rows, group, strict=True)}
    assert len(set(want.values())) == 21
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.root for r in simhash.near_groups(df, tile=9).collect()} == want


def test_joined_meets_every_pair(spark):
    """Sets of one key over many tiles: a bridge from the large group to a row far from it in the order is found."""
    rng = np.random.default_rng(6)
    core = rng.integers(0, 2**63, 100, dtype=np.uint64)
    def row(vid, h):
        h = np.unique(h)
        return (1, bytes(32), vid, len(h), h.tobytes())
    rows = [row(k, np.r_[core, rng.integers(0, 2**63, 1 + k % 12, dtype=np.uint64)]) for k in range(60)]
    rows += [row(100, core[:82]), row(101, core[:67]), row(102, rng.integers(0, 2**63, 90, dtype=np.uint64)), row(103, rng.integers(0, 2**63, 107, dtype=np.uint64))]
    df = spark.createDataFrame(rows, "key long, fp binary, vid long, size long, hashes binary")
    for tile in (4, 1000):
        got = {r.id: r.root for r in simhash._joined(df, tile, 0.8).collect()}
        assert got == {k: 0 for k in [*range(60), 100, 101]}, tile


def test_pure_tiles_do_not_meet(spark):
    """Tiles of a key's largest component are in no pair with one another."""
    rows = [(1, bytes(32), 5, 10, k) for k in range(400)] + [(1, bytes(32), 900 + k, 10, 900 + k) for k in range(6)] + [(2, bytes(32), 7, 10, 7000)]
    df = spark.createDataFrame(rows, "key long, fp binary, vid long, size long, own long")
    tiles = simhash._tiles(simhash._open(df, 8), 8, 0.8)
    assert tiles.where("key != 1").count() == 0
    assert tiles.where("pure").count() > 40 and tiles.where("not pure").count() <= 2
    assert sum(r.n for r in tiles.selectExpr("size(rows) n").collect()) == 406
