import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldstream.llm.packing import best_cuts, pack
from fieldstream.llm.vocab import byte_bpe


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "a", "a  b", " lead", "trail ", "tab\tand\nline\n\nmore \n x", "nb sp x y", "it's we'll  DON'T", "日本語 text、です", "x\x1cy z", "a\r\nb", "emoji 😀 ok", "end<|endoftext|>more<|endoftext|>", "1234 5,6.7", "é́ combining"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é.'s\n\t   \x1c1,😀", max_size=30), min_size=1, max_size=5))
def test_ids_equal_tokenizers(texts):
    assert [byte_bpe().ids(t).tolist() for t in texts] == reference_ids(texts)


def test_ids_of_odd_texts():
    assert [byte_bpe().ids(t).tolist() for t in ODD] == reference_ids(ODD)


LONG = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + " " * 100_000 + "y" + " \t" * 50_000, "a b" + "\t" * 300_000 + "b c", "\u3000" * 100_000 + "漢", " " * 5000 + "\x1c" + " " * 5000 + "'s"]


def test_ids_of_long_runs():
    for text in LONG:
        assert byte_bpe().ids(text).tolist() == reference_ids([text])[0]


def test_packs_long_runs(spark):
    rows = pack(spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == {i: len(ids) + 1 for i, ids in enumerate(reference_ids(LONG))}


def brute(at, tolls, w, stride, inner):
    cost = [0.0]
    for j in range(1, len(at)):
        cost.append(min(cost[i] + m * w - (at[j] - at[i]) + (m - 1) * inner for i in range(j) for m in range(1, stride + 1) if at[j] - at[i] <= m * w) + tolls[j])
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 1.0, 6.0])), min_size=1, max_size=60))
def test_best_cuts_is_optimal(steps):
    at = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    tolls = [0.0, *(t for _, t in steps)]
    cost, _ = best_cuts(at, tolls, 16, 3, 2.0)
    assert cost == brute(at, tolls, 16, 3, 2.0)


def test_every_id_in_one_piece(spark):
    texts = [*ODD, None, "word. " * 5000, "nostop " * 4000, "z" * 9000] + [f"Short text {i}. It ends." for i in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int").coalesce(2)
    rows = pack(df).collect()
    want = {i: [*ids, 0] for i, ids in enumerate(reference_ids([t or "" for t in texts]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * total
    assert pack(df.limit(0)).count() == 0
