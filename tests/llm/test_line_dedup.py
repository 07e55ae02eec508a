import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldstream.llm import line_dedup as L

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=20, least_docs=3):
    """What stays of each row, by a dictionary of all keys."""
    holders, number = defaultdict(set), lambda d: L.NO_ID if d is None else d
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(number(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or number(d) == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def made(seed, n, hot):
    """Documents of lines that repeat in several of them, a hot line in most, keys of 19 and 20 code points, and lines that differ in case and white space."""
    rng = random.Random(seed)
    pool = [f"line number {k} of the common stock" for k in range(40)] + ["é" * 19, "é" * 20, "x" * 19, "y" * 20, "  Mixed CASE of One line\t", "mixed case of one line", "É" * 20, "", "short"]
    rows = []
    for k in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own line {k} {rng.random()}" for _ in range(rng.randrange(0, 12))]
        lines += ["the hot line of a third of all rows"] * (rng.randrange(1, 4) if rng.random() < hot else 0)
        rng.shuffle(lines)
        rows.append((rng.choice([k, k, k, rng.randrange(n), None]) if k % 7 == 0 else k, "\n".join(lines) if rng.random() < 0.97 else None))
    return rows


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_equals_brute_force(spark, parts):
    rows = made(parts, 400, 0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs over many partitions
    try:
        got = L.dedup_lines(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute(rows)
    assert all((r.keep is None) == (r.n_dropped == 0) for r in got) and any(r.keep for r in got)
    for r in got:
        assert np.count_nonzero(L.unpack_bits(r.keep) == 0) == r.n_dropped


def test_other_bounds(spark):
    rows = made(3, 120, 0.3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chars, docs in ((1, 2), (30, 6)):
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(df, chars, docs).collect()) == brute(rows, chars, docs)
    with pytest.raises(ValueError):
        L.bitmaps(df, 20, 1)


def test_stream_in_batches_and_partitions():
    """However the sorted rows are cut, the same lines go, and what is carried stays small."""
    rng, least = np.random.default_rng(2), 3
    rows = np.array([(h // 3, h % 3, -d, 0, p) for h in range(60) for d in sorted(rng.choice(50, rng.integers(1, 30), replace=False)) for p in range(rng.integers(1, 4))], "i8")
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    by = defaultdict(set)
    for r in rows:
        by[tuple(r[:2])].add(r[2])
    want = {tuple(r) for r in rows if len(by[tuple(r[:2])]) >= least and r[2] != max(by[tuple(r[:2])])}
    for size, cuts in ((1, [0, len(rows)]), (7, [0, 100, 101, 333, 334, 335, len(rows)]), (5000, [0, len(rows) // 2, len(rows)])):
        gone, waiting, ends = set(), [], defaultdict(set)
        for a, b in zip(cuts, cuts[1:], strict=False):
            stream = L.RunStream(least)
            for k in range(a, b, size):
                stream.feed(rows[k : min(b, k + size)])
                assert len(stream.open) <= 20
            stream.close()
            for batch in stream.out:
                for r in batch.to_pylist():
                    if r["kind"] == 2:
                        ends[r["hi"], r["lo"]] |= set(r["docs"])
                    else:
                        (gone.add if r["kind"] == 0 else waiting.append)(tuple(r[c] for c in ("hi", "lo", "doc", "mark", "pos")))
        gone |= {r for r in waiting if len(ends[r[:2]]) >= least and r[2] != max(ends[r[:2]])}
        assert gone == want


def test_bitmaps():
    for gone in ([0], [7], [8], [3, 3, 900], list(range(5000))):
        bits = L.unpack_bits(L.pack_bits(gone))
        assert np.flatnonzero(bits == 0).tolist() == sorted(set(gone))
    assert len(L.pack_bits(list(range(100_000)))) < 200


def test_odd_rows(spark):
    line = "a line that all of these documents hold"
    rows = [(1, line), (1, line), (2, f"{line}\n{line}"), (3, f"x\n {line.upper()} \ny"), (None, line), (None, line + "\n"), (4, None), (5, ""), (6, "w" * 300_000 + "\n" + line), (6, line)]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "doc_id long, text string, doc string, mark string, keep string").repartition(3)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(df).collect()) == brute(rows)
    assert L.dedup_lines(df.limit(0)).count() == 0
    assert {r.n_dropped for r in L.dedup_lines(df.where("doc_id < 3")).collect()} == {0}
