"""Order-preserving packing of documents into windows of tokens.

Each task walks its documents in input order, with a separator id after each.
Cuts lie at document ends (free), at sentence ends (a small toll) or, at a
higher toll, inside a sentence where a window is full.  Dynamic programming
minimises padding plus tolls:

    cost(j) = toll(j) + min over m, i of  cost(i) + (m * W - (j - i)) + (m - 1) * inner

where i lies at most m windows of W tokens before j.  The minimum of
cost(i) + i over a sliding range is read off one monotone queue that has a head
for each m.  A task buffers a bounded number of tokens: the best cut near the end of
the buffer is final, and what follows it stays for the next round.  What a task
has left at its end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts
from fieldstream.llm.vocab import byte_bpe

WINDOW = 1024
#: Padding tokens that one cut inside a document, or inside a sentence, is worth.
SENTENCE_TOLL, INNER_TOLL = 1.0, 6.0
#: Windows that one step may take together.
STRIDE = 4
#: Tokens that a task holds before it packs them.
BUFFER = 1 << 18
SEPARATOR = 0


def best_cuts(at: list[int], tolls: list[float], window: int = WINDOW, stride: int = STRIDE, inner: float = INNER_TOLL) -> tuple[list[float], list[int]]:
    """Least cost to each candidate position, and the candidate before it.

    ``at`` ascends from 0; neighbours lie at most ``window`` apart.  A step of m
    windows cuts all but its last one when they are full.
    """
    n = len(at)
    cost, back, value = [0.0] * n, [0] * n, [0.0] * n
    queue, heads = [0], [0] * stride
    value[0] = at[0]
    steps = [(m, (m + 1) * window, (m + 1) * window + m * inner) for m in range(stride)]
    for j in range(1, n):
        x, least, via, size = at[j], float("inf"), 0, len(queue)
        for m, reach, price in steps:
            h = heads[m]
            while h < size and at[queue[h]] < x - reach:
                h += 1
            heads[m] = h
            if h < size and value[queue[h]] + price < least:
                least, via = value[queue[h]] + price, queue[h]
        cost[j] = least - x + tolls[j]
        back[j] = via
        v = value[j] = cost[j] + x
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
        top = len(queue) - 1
        heads = [h if h < top else top for h in heads]
    return cost, back


def _powers(n: int) -> list[int]:
    """n as powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs a stream of documents; ``pieces`` holds finished rows (doc, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, closes: np.ndarray, window: int = WINDOW, buffer: int = BUFFER, base: int = 0):
        self.closes, self.window, self.buffer, self.next = closes, window, buffer, base
        self.docs: list[tuple] = []  # (doc_id, ids, ids that are already packed)
        self.held = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        if self.held >= self.buffer:
            self._pack(False)

    def finish(self) -> None:
        if self.held:
            self._pack(True)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        at, toll, begin = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, done in self.docs:
            rest = ids[done:]
            ends = np.flatnonzero(self.closes[rest[:-1]]) + 1
            ends = np.append(ends[ends < len(rest)], len(rest))
            wide = np.diff(np.concatenate([[0], ends]))
            if (wide > self.window // 2).any():  # inside a long sentence, half-window steps
                more = np.concatenate([np.arange(e - w + self.window // 2, e, self.window // 2) for e, w in zip(ends, wide, strict=True) if w > self.window // 2])
                merged = np.concatenate([ends, more])
                order = np.argsort(merged, kind="stable")
                ends, t = merged[order], np.concatenate([np.full(len(ends), SENTENCE_TOLL), np.full(len(more), INNER_TOLL)])[order]
            else:
                t = np.full(len(ends), SENTENCE_TOLL)
            t[-1] = 0
            at.append(begin + ends)
            toll.append(t)
            begin += len(rest)
        return np.concatenate(at), np.concatenate(toll)

    def _pack(self, last: bool) -> None:
        w = self.window
        at, toll = self._candidates()
        cost, back = best_cuts(at.tolist(), toll.tolist(), w)
        end = len(at) - 1
        if not last:
            near = int(np.searchsorted(at, at[-1] - w))
            end = near + int(np.argmin(cost[near:]))
        path = [end]
        while path[-1]:
            path.append(back[path[-1]])
        sizes = []
        for i, j in zip(path[:0:-1], path[-2::-1], strict=True):
            span = int(at[j] - at[i])
            sizes += [w] * ((span - 1) // w) + [(span - 1) % w + 1]
        if last:
            sizes += _powers(sizes.pop())
        self._write(sizes)

    def _write(self, sizes: list[int]) -> None:
        k, (doc, ids, done) = 0, self.docs[0]
        for size in sizes:
            offset = 0
            while offset < size:
                if done == len(ids):
                    k += 1
                    doc, ids, done = self.docs[k]
                n = min(size - offset, len(ids) - done)
                self.pieces.append((doc, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), self.next, offset))
                done += n
                offset += n
            self.next += 1
        left = [(doc, ids, done)] if done < len(ids) else []
        self.docs = left + self.docs[k + 1 :]
        self.held = sum(len(i) - d for _, i, d in self.docs)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _run(vocabulary: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        packer = Packer(bpe.closes, window, base=TaskContext.get().partitionId() << 36)

        def flush():
            rows, packer.pieces = packer.pieces, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

        for batch in in_parts(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, bpe.ids(text))
            if len(packer.pieces) > 20_000:
                yield flush()
        packer.finish()
        if packer.pieces:
            yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep their order inside an input split, and no text is shuffled.
    Every document has its ids and then id 0, so an empty or null text is one piece of one id.  Rows
    with equal or null doc_ids are packed like any other; a very long text is cut into as many windows as it fills.  An empty table gives no rows;
    other columns are not read, so their names don't matter.
    """
    # the split of the input decides the sequences; a retried task reads the same split and makes the same rows
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_run(vocabulary, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
