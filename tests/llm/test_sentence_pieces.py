import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldstream.llm.sentence_pieces import CharMap, Normalizer, encode, spans
from fieldstream.llm.vocab import pieces

NAME = "piece_bpe_32k.model"
ODD = ["", " ", "a", " a", "a ", "  a  b ", "tab\tnew\nline", "▁", "a▁b", "▁▁x y▁ z", "日本語です", "😀 ok é", "<s> </s> <0x0A>", "\x00 null", "ＡＢ ﬁ"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abthe ▁ é\n\t.日😀", max_size=40))
def test_ids_and_spans(text):
    check(text)


def check(text):
    model = pieces(NAME)
    ids = model.ids(text)
    assert ids.tolist() == library().encode(text)
    b, e = spans(NAME, model, text, ids)
    data = text.encode()
    at = 0
    for k, (x, y) in enumerate(zip(b.tolist(), e.tolist(), strict=True)):
        assert x <= y <= len(data) and x >= at - 3
        at = max(at, y)
        name = model.names[ids[k]]
        if not model.byte[ids[k]]:
            assert data[x:y].decode().replace(" ", "▁") in (name, name[1:])
    assert at == len(data)


def test_odd_texts(spark):
    for text in ODD:
        check(text)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None, "word " * 30000])], "doc_id long, text string, ids string")
    sp = library()
    for r in encode(df).collect():
        text = ([*ODD, None, "word " * 30000])[r.doc_id] or ""
        want = sp.encode(text, add_eos=True)
        assert r.ids == want and r.decoded == sp.decode(want)
        assert len(r.begins) == len(r.ends) == len(want) and r.ends[-1] == len(text.encode())
    assert encode(df.limit(0)).count() == 0


def unit(offset=0, label=0, leaf=False, value=None):
    if value is not None:
        return value | 1 << 31
    return offset << 10 | leaf << 8 | label


def test_longest_prefix_and_alignment():
    """A hand-made double array with the keys "A" -> "a" and "AB" -> "xyz"."""
    units = [0] * 512
    root, a, ab = 1, 256, 300
    units[0] = unit(root)
    at_a = root ^ ord("A")
    units[at_a] = unit(at_a ^ a, ord("A"), True)
    units[a] = unit(value=0)
    at_ab = a ^ ord("B")
    units[at_ab] = unit(at_ab ^ ab, ord("B"), True)
    units[ab] = unit(value=2)
    trie = np.array(units, "<u4").tobytes()
    blob = len(trie).to_bytes(4, "little") + trie + b"a\0xyz\0"
    chars = CharMap(blob)
    assert chars.longest(b"ABC", 0) == (2, b"xyz") and chars.longest(b"AC", 0) == (1, b"a") and chars.longest(b"C", 0) is None
    spec = b"\x12" + bytes([len(blob) & 127 | 128, len(blob) >> 7]) + blob + b"\x18\x00\x20\x01\x28\x00"
    text, begin, end = Normalizer(spec)(b"  ABA   cA ")
    assert text == b"xyza ca"
    assert begin.tolist() == [2, 2, 2, 4, 5, 8, 9] and end.tolist() == [4, 4, 4, 5, 6, 9, 10]
    assert hashlib.sha256(text).hexdigest()
