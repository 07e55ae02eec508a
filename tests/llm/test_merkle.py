import hashlib
import random
import zlib
from collections import Counter

import pytest

from fieldstream.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    """(root, the siblings of each leaf from below, the root's fold for a leaf put in place k)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])

    def siblings(k):
        out = []
        for level in levels[:-1]:
            out += [level[k ^ 1]] if k ^ 1 < len(level) else []
            k //= 2
        return out

    def fold(k, node):
        for level in levels[:-1]:
            pair = [node if j == k else level[j] for j in range(k & ~1, min(len(level), (k & ~1) + 2))]
            node, k = sha(*pair), k // 2
        return node

    return levels[-1][0], siblings, fold


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        order[lang] = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = tree([leaf(*r) for r in order[lang]])
    root, up, fold_up = tree([trees[x][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        sub, siblings, fold = trees[lang]
        for k, r in enumerate(order[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = fold_up(at, fold(k, leaf(r[0], r[1], lang, r[3] + hit if r[3] is not None else None, r[4])))
            out.append((r[0], leaf(*r), sub, root, sha(*siblings(k), *up(at)), folded, folded == root))
    return Counter(out)


def run(spark, rows, levels=M.LEVELS):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, i string, n string, path string").repartition(5)
    return M.manifest(df, levels)


def same(spark, rows, levels=M.LEVELS):
    got = run(spark, rows, levels).collect()
    assert Counter(tuple(r)[:7] for r in got) == brute(rows)
    return got


@pytest.mark.parametrize("levels", [2, 10])
def test_equals_brute_force(spark, levels):
    """Blocks of four leaves make several distributed levels, some trees end earlier than others."""
    rng, rows = random.Random(levels), []
    for lang, n in {"en": 37, "de": 16, None: 9, "fr": 1, "é": 3, "": 2, "+": 1, "zz": 4}.items():
        rows += [(rng.randrange(10**12), rng.choice(["web", None]), lang, rng.choice([None, k]), f"text {k} é\n" if k else None) for k in range(n)]
    got = same(spark, rows, levels)
    assert not all(r.verified for r in got) and all((r.copied > 0) >= (not r.verified) for r in got)


def test_a_whole_block_and_one_more(spark):
    for n in (1024, 2100):
        same(spark, [(k, "s", "en", k, f"t{k}") for k in range(n)])


def test_odd_rows(spark):
    rows = [(1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 4, "abcd"), (2, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 1, "x"), (None, "s", "en", 1, "y"), (9, "s", "en", 2**63 - 1, "w" * 300_000), (10, "s", "en", 2**63 - 1, "w"), (15, "s", "fr", 5, "z")]
    rows += [(k, "s", "it", 2**63 - 1, "big") for k in range(20)]
    same(spark, rows)
    same(spark, rows[:1])
    assert run(spark, rows[:1]).first().root == leaf(*rows[0])
    assert run(spark, rows).limit(0).count() == 0 and M.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_versions_share_what_is_untouched():
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    base = M.BlockTree(nodes)
    before = [list(level) for level in base.levels]
    for k in range(11):
        version = base.with_leaf(k, b"\1" * 32)
        whole = M.BlockTree([b"\1" * 32 if j == k else d for j, d in enumerate(nodes)])
        assert version.root == whole.root and len(version.copied) == len(base.levels)
        for h, level in enumerate(whole.levels):
            for j, node in enumerate(level):
                assert version.node(h, j) == node
                assert j == k >> h or version.node(h, j) is base.levels[h][j]
        assert M.unpack(M.pack(base.path(k))) == base.path(k)
    assert base.levels == before
