"""Offset-preserving SentencePiece encoding, and decoding.

``Normalizer`` reads a model's normalisation rules: at each place the longest
key of the compiled character map that is a prefix of what follows is replaced, and
every normalised byte remembers the source bytes it stands for.  ``encode``
projects the pieces of a text through that alignment, so each id carries the byte span of
the original text that it came from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts
from fieldstream.llm.vocab import SPACE, Pieces, pieces

SIGN = SPACE.encode()


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; groups don't occur here."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class CharMap:
    """The compiled character map: the trie's size, a double-array trie of 32-bit units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        if not self.units:
            return None
        found, unit, node = None, self.units[0], 0
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        n, start = found
        return n, self.texts[start : self.texts.index(b"\0", start)]


class Normalizer:
    """Rules of a model: character map, dummy prefix, extra white space, and the sign for a space."""

    def __init__(self, spec: bytes):
        rules = dict(proto_fields(spec))
        self.map = CharMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))

    @property
    def plain(self) -> bool:
        """Only the prefix and the sign for a space change a text."""
        return not self.map.units and not self.squeeze and self.escape

    def _replaced(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(normalised, begin, end) for each key of the map or else each character."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            n = hit[0] if hit else 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            yield (hit[1] if hit else data[at : at + n]), at, at + n
            at += n

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes; for each, begin and end of the source bytes it stands for."""
        space = SIGN if self.escape else b" "
        chunks = list(self._replaced(data))
        if self.squeeze:
            blank = lambda c: not c[0].strip(b" ")
            while chunks and blank(chunks[0]):
                chunks.pop(0)
            while chunks and blank(chunks[-1]):
                chunks.pop()
        out, begin, end = bytearray(), [], []

        def put(text: bytes, b: int, e: int) -> None:
            out.extend(text)
            begin.extend([b] * len(text))
            end.extend([e] * len(text))

        if chunks and self.prefix:
            put(space, chunks[0][1], chunks[0][1])
        for text, b, e in chunks:
            for k in range(len(text)):
                c = text[k : k + 1]
                if c != b" ":
                    put(c, b, e)
                elif not (self.squeeze and out.endswith(space)):
                    put(space, b, e)
        if self.squeeze and chunks:
            while out.endswith(space):
                del out[-len(space) :], begin[-len(space) :], end[-len(space) :]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)


@lru_cache(maxsize=2)
def normalizer(path: str) -> Normalizer:
    with open(path, "rb") as f:
        return Normalizer(dict(proto_fields(f.read())).get(3, b""))


@lru_cache(maxsize=2)
def _widths(path_of: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each piece in a normalised text, and in a source that differs from it only in the sign for a space."""
    model = pieces(path_of)
    normal = np.array([1 if b else len(n.encode()) for n, b in zip(model.names, model.byte, strict=True)])
    source = np.array([1 if b else len(n.replace(SPACE, " ").encode()) for n, b in zip(model.names, model.byte, strict=True)])
    return normal, source


def spans(name: str, model: Pieces, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each id in the UTF-8 bytes of ``text``."""
    rules = normalizer(model.path)
    normal, source = _widths(name)
    if rules.plain and SPACE not in text:
        end = np.cumsum(source[ids]) - rules.prefix
        return np.maximum(np.concatenate([[-int(rules.prefix)], end[:-1]]), 0)[: len(ids)], np.maximum(end, 0)
    _, first, last = rules(text.encode())
    stop = np.cumsum(normal[ids])
    start = stop - normal[ids]
    return first[start], last[stop - 1]


def _run(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        close = np.array([model.sp.eos_id()], "<u4")
        for batch in in_parts(batches, most=4 << 20):
            at, ids, begins, ends, decoded = [0], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = model.ids(text)
                b, e = spans(name, model, text, own)
                n = len(text.encode())
                ids += [own, close]
                begins += [b, [n]]
                ends += [e, [n]]
                at.append(at[-1] + len(own) + 1)
                decoded.append(model.sp.decode(own.tolist()))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], schema=schema)

    return run


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids (the end id last), begins and ends (byte spans in the source text), decoded.

    A null text is empty and has the end id only.  ``decoded`` is what the
    model's decoder makes of the ids.  A very long text is encoded whole.  Equal rows give equal rows; a null doc_id stays null;
    an empty table gives no rows; other columns are not read, so their names don't matter.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_run(model), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")
