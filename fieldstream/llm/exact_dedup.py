"""Exact deduplication by Grace hashing.

Every task first removes the copies inside its own input split, so a text that
a third of all rows share leaves each split once.  The texts that stay are
shuffled by hash; each hash partition is deduplicated in the same way.  A
member row carries only ids through the second shuffle.

Within a task, ``GraceTable`` keeps distinct texts in an open-addressing table
up to a byte budget.  Records that meet an equal resident text are resolved at
once; all others go to spill files by hash bits, and each file is treated
likewise with other bits, until its distinct texts fit.  Texts count as equal
only when their complete contents are.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts, keep, squeeze, texts_of

#: Bytes of distinct text that one task holds; beyond it, records spill.
TABLE_BYTES = 96 << 20
#: Spill files for each level.
FANOUT = 16


class GraceTable:
    """Groups of equal contents in a stream of (key, content, weight) records.

    ``groups()`` yields (content, keys, weights) for each distinct content; the
    keys are in order of arrival.  Memory: ``budget`` bytes of distinct content,
    and 16 bytes for each record of the resident contents.
    """

    def __init__(self, budget: int = TABLE_BYTES, fanout: int = FANOUT, level: int = 0):
        self.budget, self.fanout, self.level = budget, fanout, level
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keys: list[array] = []
        self.weights: list[array] = []
        self.size, self.files = 0, None

    def _find(self, h: int, content: bytes) -> int:
        """The slot of an equal content, or the free slot where it belongs."""
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return at
            at = (at + 1) & self.mask
        return at

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def add(self, key: int, content: bytes, weight: int = 1) -> None:
        h = xxhash.xxh3_64_intdigest(content, self.level)
        at = self._find(h, content)
        k = self.slots[at]
        if k < 0:
            if self.contents and self.size + len(content) > self.budget:
                self._spill(h, key, content, weight)
                return
            k = self.slots[at] = len(self.contents)
            self.hashes.append(h)
            self.contents.append(content)
            self.keys.append(array("q"))
            self.weights.append(array("q"))
            self.size += len(content) + 200
            if 3 * len(self.contents) > 2 * len(self.slots):
                self._grow()
        self.keys[k].append(key)
        self.weights[k].append(weight)

    def _spill(self, h: int, key: int, content: bytes, weight: int) -> None:
        if self.files is None:
            self.files = [tempfile.TemporaryFile() for _ in range(self.fanout)]
        pickle.dump((key, content, weight), self.files[(h >> 40) % self.fanout], protocol=5)

    def groups(self) -> Iterator[tuple[bytes, array, array]]:
        yield from zip(self.contents, self.keys, self.weights, strict=True)
        files, self.files = self.files, None
        self.slots, self.hashes, self.contents, self.keys, self.weights = [], [], [], [], []
        for f in files or ():
            with f:
                if not f.tell():
                    continue
                f.seek(0)
                part = GraceTable(self.budget, self.fanout, self.level + 1)
                while True:
                    try:
                        part.add(*pickle.load(f))
                    except EOFError:
                        break
            yield from part.groups()


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text] or b"") if text is not None else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


LOCAL = pa.schema([("doc_id", pa.int64()), ("group_key", pa.int64()), ("stands", pa.bool_()), ("least_id", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])


def _least(ids: list[int | None]) -> int:
    """Position of the smallest id, nulls last, the first of equals."""
    return min(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))


def _locally(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, base = GraceTable(budget), [], TaskContext.get().partitionId() << 40
        for batch in in_parts(batches):
            for text in batch.column(1).to_pylist():
                found.add(len(ids), squeeze(text))
                ids.append(None)
            ids[-batch.num_rows :] = batch.column(0).to_pylist()

        def rows():
            for g, (content, keys, _) in enumerate(found.groups()):
                own = [ids[k] for k in keys]
                first = _least(own)
                for i, doc in enumerate(own):
                    yield (doc, base + g, i == first, own[first], len(own), content if i == first else None)

        yield from _emit(rows(), LOCAL, text=5)

    return run


WHOLE = pa.schema([("group_key", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("wins", pa.bool_()), ("text_sha256", pa.string())])


def _globally(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, least, keys = GraceTable(budget), [], []
        for batch in in_parts(batches):
            for doc, n, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found.add(len(least), text, n)
                least.append(doc)
            keys += batch.column(0).to_pylist()

        def rows():
            for content, at, sizes in found.groups():
                first = min(at, key=lambda i: (least[i] is None, least[i] or 0, keys[i]))
                size, digest = sum(sizes), hashlib.sha256(content).hexdigest()
                for i in at:
                    yield (keys[i], least[first], size, i == first, digest)

        yield from _emit(rows(), WHOLE)

    return run


def exact_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space; a null text is empty.  Of equal texts the smallest doc_id stays;
    of rows that repeat both, one.  A null doc_id loses to every other; a group
    of nulls has keep_id null and still keeps one row.  A very long text is compared whole.  An empty table gives an
    empty result.  Other columns of ``docs`` are not read, so their names don't matter.
    """
    local = keep(texts_of(docs).mapInArrow(_locally(budget), "doc_id long, group_key long, stands boolean, least_id long, n long, text binary"), "dedup")
    standing = local.where("stands").select("group_key", "least_id", "n", "text").repartition(F.xxhash64("text"))
    whole = standing.mapInArrow(_globally(budget), "group_key long, keep_id long, group_size long, wins boolean, text_sha256 string")
    return local.select("doc_id", "group_key", "stands").join(whole, "group_key").select("doc_id", "keep_id", "group_size", (F.col("stands") & F.col("wins")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns; of rows that repeat doc_id and text, one.

    Null and empty texts are equal, so one of them stays, as it is; an empty table stays empty; other columns may have any name that doesn't begin with "__".

    The join deals rows by id and digest, so the last step needs no further shuffle.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))  # a plain key, so that all steps deal rows alike
    stay = exact_groups(docs, budget).where("kept").select(name.alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__id", name).withColumn("__sha", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))
    return keyed.join(stay, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(docs.columns)
