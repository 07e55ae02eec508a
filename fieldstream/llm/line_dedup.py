"""Line deduplication over range-partitioned hashes.

Every long line becomes one narrow row: a 128-bit hash of its key, its document
and its place.  The rows are range-partitioned by hash, document and place, so a
line that a third of all documents hold is spread over partitions, and sorted
by the same inside each.  One pass streams them: the first occurrences of a hash, those of
its largest document, stay, and all others go if enough documents hold it.
Only the two runs at the ends of a partition can reach into its neighbours, so
only these wait, for a table with at most two rows for each partition.

What comes back is no text but one compressed bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts, keep

#: Code points from which a key counts, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
SPACE = b" \t\n\v\f\r"
FOLLOWERS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _document() -> Column:
    """doc_id; rows without one count together as one document below all others (that of the least long)."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, the document, a mark that tells rows of one document apart, and the text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", _document().alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


LINES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])


def _hash_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in in_parts(batches):
            hashes, rows, places = bytearray(), [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least_chars and (key.isascii() or len(key.translate(None, FOLLOWERS)) >= least_chars):
                        hashes += digest(key)
                        rows.append(row)
                        places.append(pos)
            both = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
            own = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), own.column(0), own.column(1), pa.array(places, pa.int32())], schema=LINES)

    return run


#: kind 0: this line goes; 1: it goes if the table of ends says so; 2: a row of that table, with the first documents of the run.
JUDGED = pa.schema([("kind", pa.int8()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("docs", pa.list_(pa.int64()))])


class RunStream:
    """Judges sorted rows (hi, lo, doc descending, mark, pos) of one partition.

    Between batches it carries only the run that is still open: one mark (pos -1) for each of its
    first ``least_docs`` documents, and, until so many are found, the rows of those after the first.
    """

    def __init__(self, least_docs: int):
        self.least, self.open, self.first, self.out = least_docs, None, None, []

    def _put(self, kind: int, rows: np.ndarray) -> None:
        rows = rows[rows[:, 4] >= 0]
        if len(rows):
            fields = [pa.array(np.full(len(rows), kind, "i1")), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)), pa.array(rows[:, 4].astype("i4")), pa.nulls(len(rows), JUDGED.field("docs").type)]
            self.out.append(pa.RecordBatch.from_arrays(fields, schema=JUDGED))

    def _end(self, run: np.ndarray) -> None:
        """A row of the table of ends."""
        docs = list(dict.fromkeys(run[:, 2].tolist()))[: self.least]
        self.out.append(pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((2, int(run[0, 0]), int(run[0, 1]), None, None, None, docs), JUDGED.types, strict=True)], schema=JUDGED))

    def _carry(self, run: np.ndarray) -> np.ndarray:
        """What has to be known of an open run."""
        fresh = np.r_[True, run[1:, 2] != run[:-1, 2]]
        nth = np.cumsum(fresh)
        marks = run[fresh][: self.least].copy()
        marks[:, 4] = -1
        if run[0, 0] == self.first[0] and run[0, 1] == self.first[1] or nth[-1] >= self.least:
            return marks
        return np.concatenate([marks[:1], run[nth > 1]])

    def feed(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if self.first is None:
            self.first = tuple(rows[0, :2])
        rows = rows if self.open is None else np.concatenate([self.open, rows])
        change = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        fresh = change | np.r_[True, rows[1:, 2] != rows[:-1, 2]]
        starts, run = np.flatnonzero(change), np.cumsum(change) - 1
        many = np.add.reduceat(fresh.astype("i8"), starts) >= self.least
        gone = many[run] & (rows[:, 2] != rows[starts, 2][run])
        if tuple(rows[0, :2]) == self.first:
            n = starts[1] if len(starts) > 1 else len(rows)
            self._put(1, rows[:n])
            gone[:n] = False
            if len(starts) > 1:
                self._end(rows[:n])
        self._put(0, rows[gone])
        self.open = self._carry(rows[starts[-1] :])

    def close(self) -> None:
        if self.open is not None:
            self._put(1, self.open)  # marks have no place, so only rows that still wait
            self._end(self.open)


def _judge(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = RunStream(least_docs)
        for batch in batches:
            stream.feed(np.column_stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns]) if batch.num_rows else np.empty((0, 5), "i8"))
            yield from stream.out
            stream.out = []
        stream.close()
        yield from stream.out

    return run


def pack_bits(gone: list[int]) -> bytes:
    """The bitmap of a document, one bit for each line to the last that goes, 1 for those that stay; all later ones stay.  Deflated."""
    bits = np.ones(-(-(max(gone) + 1) // 8) * 8, "u1")
    bits[gone] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def unpack_bits(bitmap: bytes | None) -> np.ndarray:
    """The bits of ``pack_bits``; none for null."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"), bitorder="little") if bitmap is not None else np.empty(0, "u1")


BITMAPS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("keep", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(pack_bits, batch.column(2).to_pylist()), pa.binary())], schema=BITMAPS)


def bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, mark, keep): the bitmap of each document that loses lines; see ``dedup_lines``."""
    if least_docs < 2:
        raise ValueError("a line repeats in two documents at least")
    order = ["hi", "lo", F.desc("doc"), "mark", "pos"]
    lines = _texts(docs).select("doc", "mark", "text").mapInArrow(_hash_lines(least_chars), "hi long, lo long, doc long, mark long, pos int")
    judged = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_judge(least_docs), "kind byte, hi long, lo long, doc long, mark long, pos int, docs array<long>")
    judged = keep(judged, "lines")
    # at most two rows a partition, with ``least_docs`` documents each
    runs = judged.where("kind = 2").select("hi", "lo", F.explode("docs").alias("__doc")).groupBy("hi", "lo").agg(F.max("__doc").alias("__first"), F.count_distinct("__doc").alias("__n"))
    waiting = judged.where("kind = 1").join(F.broadcast(runs), ["hi", "lo"]).where((F.col("__n") >= least_docs) & (F.col("doc") != F.col("__first")))
    gone = judged.where("kind = 0").select("doc", "mark", "pos").union(waiting.select("doc", "mark", "pos"))
    return gone.groupBy("doc", "mark").agg(F.collect_list("pos").alias("gone")).mapInArrow(_pack, "doc long, mark long, keep binary")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary()), ("text", pa.binary())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        lines, dropped, texts = [], [], []
        for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = text.split(b"\n")
            gone = np.flatnonzero(unpack_bits(bitmap) == 0)
            lines.append(len(parts))
            dropped.append(len(gone))
            if len(gone):
                out = set(gone.tolist())
                text = b"\n".join(p for k, p in enumerate(parts) if k not in out)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), batch.column(2), pa.array(texts, pa.binary())], schema=KEPT)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines and n_dropped (long), keep (the bitmap, null where nothing goes), and what stays as text.

    A text is split at \\n; a null or empty one is one empty line.  Lines with a key (``line_key``) of at
    least ``least_chars`` code points that at least ``least_docs`` documents hold go from all of these but the one with the largest doc_id,
    which keeps each of its lines.  Rows that share a doc_id are one document; rows without one are
    together one document, below all others.  Very long texts are split whole.  An empty table gives an empty
    result.  Other columns of ``docs`` are not read, so their names don't matter.
    """
    found = bitmaps(docs, least_chars, least_docs)
    joined = _texts(docs).join(found, ["doc", "mark"], "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, keep binary, text binary").withColumn("text", F.col("text").cast("string"))
