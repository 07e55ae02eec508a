import hashlib
import random
import re
from collections import defaultdict

from fieldstream.llm.exact_dedup import GraceTable, drop_copies, exact_groups


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_grace_table_spills_and_groups():
    rng = random.Random(3)
    rows = [(k, (b"%d " % rng.randrange(300)) * 40) for k in range(3000)] + [(k, b"hot" * 100) for k in range(3000, 6000)]
    rng.shuffle(rows)
    for budget in (1, 2_000, 20_000, 1 << 30):
        found = GraceTable(budget, fanout=3)
        for k, content in rows:
            found.add(k, content)
        got = {c: sorted(keys) for c, keys, _ in found.groups()}
        want = defaultdict(list)
        for k, content in rows:
            want[content].append(k)
        assert got == {c: sorted(v) for c, v in want.items()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " ", "\t\n", "a b", "a  b", " a b", "a\x1cb", "a b", "é", *(f"text {rng.randrange(30)}" for _ in range(150)), "long " * 40_000, "long  " * 40_000]
    rows = [(7 * i % 199, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    by = defaultdict(list)
    for d, t, _ in rows:
        by[squeezed(t)].append(d)
    want = sorted((d, min(by[s := squeezed(t)]), len(by[s]), d == min(by[s]), hashlib.sha256(s.encode()).hexdigest()) for d, t, _ in rows)
    for budget in (1 << 26, 500):
        assert sorted(map(tuple, exact_groups(df, budget).collect())) == want
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == sorted(map(min, by.values()))


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (5, "a b"), (5, "c")], "doc_id long, text string").repartition(3)
    got = exact_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, None, 2), (None, None, 2), (5, 5, 1), (5, 5, 1)], key=str)
    assert sum(r.kept for r in got) == 4 and not any(r.kept for r in got if r.doc_id is None and r.keep_id == 3)
    assert sorted(((r.doc_id, r.text) for r in drop_copies(df).collect()), key=str) == sorted([(3, "a"), (None, "b"), (5, "a b"), (5, "c")], key=str)
    assert exact_groups(df.limit(0)).count() == 0
