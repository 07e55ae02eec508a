import random

from fieldstream.llm.components import components


def brute(edges):
    group = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                moved = True
    return group


def test_components(spark):
    rng = random.Random(4)
    chain = list(range(60))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(2000, 2000 + k) for k in range(1, 30)]
    got = components(spark.createDataFrame([*edges, *edges[:5], (7777, 7777), (None, 3)], "a long, b long")).collect()
    assert len(got) == len({r.id for r in got})
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.id: r.root for r in got} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
