"""Whitening of embeddings, fitted and applied once for each distinct vector.

Entries become integers, so equal vectors are exactly equal.  Every input split
first groups its own rows, so a vector that a third of all rows share leaves a split once;
the distinct vectors get their multiplicity as weight.  Sums are exact integers, the covariance is a weighted
product of centred blocks, summed over partitions, and only that square of the dimension reaches
the driver.  Each distinct vector is whitened once; rows find theirs by the number of their group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import keep

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no exact x and count as not finite.
TOO_LARGE = float(1 << 56)
COMPONENTS = 32
#: Bytes of distinct vectors that a task of the first step holds before it starts new groups.
GROUP_BYTES = 64 << 20


def usable(column: str, size: int | Column) -> Column:
    """Whether a vector has ``size`` entries, none of them null or not finite; false for a null vector."""
    c = F.col(column)
    return F.coalesce((F.size(c) == size) & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < TOO_LARGE, F.lit(False))), F.lit(False))


GROUPED = pa.schema([("id", pa.int64()), ("group", pa.int64()), ("x", pa.binary()), ("n", pa.int64())])


def _group(size: int, budget: int):
    """Rows with the number of their group, and for each group of a split its vector and how many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, counts, numbers = TaskContext.get().partitionId() << 40, 0, {}, {}

        def groups() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int64()), pa.array(numbers.values(), pa.int64()), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=GROUPED)
            counts.clear()
            numbers.clear()
            return out

        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8")
            x = (np.floor(SCALE * values).astype("i8") + SHIFT).astype("<i8").reshape(batch.num_rows, size)
            own = []
            for row in x:
                key = row.tobytes()
                if key not in counts:
                    counts[key], numbers[key] = 0, base + number
                    number += 1
                counts[key] += 1
                own.append(numbers[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64())], schema=GROUPED)
            if len(counts) * 8 * size > budget:
                yield groups()
        yield groups()

    return run


def _int_sum(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of columns, exact."""
    if x.size and float(np.abs(x.astype("f8")).max()) * float(w.sum()) < 2.0**62:
        return (w @ x).astype(object)
    return w.astype(object) @ x.astype(object) if len(x) else np.zeros(x.shape[1], object)


def _vectors(batch: pa.RecordBatch, size: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of a batch of packed vectors and weights."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, size), batch.column(1).to_numpy(zero_copy_only=False)


def totals(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension over packed vectors (x, weight); exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for batch in batches:
            x, w = _vectors(batch, size, "<i8")
            n, sums = n + int(w.sum()), sums + _int_sum(x, w)
        yield pa.RecordBatch.from_pydict({"k": list(range(-1, size)), "s": [str(n), *map(str, sums)]}, schema=pa.schema([("k", pa.int32()), ("s", pa.string())]))

    parts = rows.select("x", "weight").mapInArrow(run, "k int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    found = {r.k: int(r.s) for r in parts.groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def gram(rows: DataFrame, size: int, kind: str, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over vectors of weight * c c', c = ``centred`` of the vector; a product for each block, summed row by row over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, size))
        for batch in batches:
            v, w = _vectors(batch, size, kind)
            c = centred(v)
            out += c.T @ (w[:, None] * c)
        yield pa.RecordBatch.from_pydict({"k": list(range(size)), "row": out.tolist()}, schema=pa.schema([("k", pa.int32()), ("row", pa.list_(pa.float64()))]))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = rows["row"].combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
        return pa.table({"k": [key[0].as_py()], "row": [total.tolist()]}, schema=pa.schema([("k", pa.int32()), ("row", pa.list_(pa.float64()))]))

    found = rows.mapInArrow(run, "k int, row array<double>").groupBy("k").applyInArrow(add, "k int, row array<double>")
    out = np.zeros((size, size))
    for r in found.collect():  # the dimension bounds this, not the rows
        out[r.k] = r.row
    return out


def mean(rows: DataFrame, size: int, n: int) -> np.ndarray:
    """Weighted mean of packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            v, w = _vectors(batch, size, "<f8")
            total += w @ v
        yield pa.RecordBatch.from_pydict({"k": list(range(size)), "s": total.tolist()}, schema=pa.schema([("k", pa.int32()), ("s", pa.float64())]))

    found = {r.k: r.s for r in rows.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return np.array([found.get(k, 0.0) for k in range(size)]) / n


def axes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, those that are zero within rounding left out; the largest entry of a vector is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    found = min(most, int((e > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum())) if len(e) else 0
    e, u = e[:found], u[:, :found]
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(found)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, exact; null where that is no long."""
    low = [s // n for s in sums]
    d = x.astype(object) - np.array(low, object) if np.abs(x.astype("f8")).max(initial=0) >= 2.0**61 else x - np.array(low, "i8")
    rest = np.array([s - n * m for s, m in zip(sums, low, strict=True)], object)
    if n * (float(np.abs(d.astype("f8")).max(initial=0)) + 1) < 2.0**30 / max(1, len(sums)) ** 0.5:
        e = n * d.astype("i8") - rest.astype("i8")
        return (e * e).sum(axis=1).tolist()
    e = n * d.astype(object) - rest
    return [s if s < 1 << 63 else None for s in (e * e).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, weigh: str = "counts", budget: int = GROUP_BYTES) -> DataFrame:
    """For each row with a usable vector and each component: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or one with a null or non-finite entry, are left out; so are entries of 2**56 or more, and
    vectors shorter than the longest usable one, whose missing entries are null (an empty vector among others).  The fit weighs a distinct
    vector by its rows, or, with ``weigh="one"``, once.  Components whose eigenvalue is zero within rounding have no scale and are left out,
    so a table of equal vectors, like an empty one, gives no rows.  Rows that repeat, share an id or have none each get their
    results.  ``deviation`` is null where it is no long.  Other columns are not read, so their names don't matter.
    """
    if weigh not in ("counts", "one"):
        raise ValueError("weigh must be counts or one")
    spark = vectors.sparkSession
    names = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    size = rows.where(usable("v", F.size("v"))).agg(F.max(F.size("v"))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], names)
    grouped = keep(rows.where(usable("v", size)).mapInArrow(_group(size, budget), "id long, group long, x binary, n long"), "grouped")
    weight = F.sum("n") if weigh == "counts" else F.lit(1).cast("long")
    # as many numbers for a vector as splits (or their budgets) hold it, not as rows
    distinct = keep(grouped.where("x is not null").groupBy("x").agg(weight.alias("weight"), F.collect_list("group").alias("groups")), "distinct")
    n, sums = totals(distinct, size)
    low, rest = np.array([s // n for s in sums], "i8"), np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - low).astype("f8") - rest

    v = gram(distinct.select("x", "weight"), size, "<i8", centred) / n
    e, u = axes(v, components)
    k = len(e)
    if not k:
        return spark.createDataFrame([], names)
    scaled = u / np.sqrt(e)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _vectors(batch, size, "<i8")
            y = (centred(x) @ scaled).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array(deviations(x, n, sums), pa.int64()), pa.array([r.tobytes() for r in y], pa.binary()), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["groups", "weight", "deviation", "packed", "white"]
            )

    white = keep(distinct.select("x", "weight", "groups").mapInArrow(apply, "groups array<long>, weight long, deviation long, packed binary, white array<double>"), "white")
    packed = white.select("packed", "weight")
    middle = mean(packed, k, n)
    error = float(np.abs(gram(packed, k, "<f8", lambda y: y - middle) / n - np.eye(k)).max())
    share = F.array(*(F.lit(float(x)) for x in e / np.trace(v)))
    found = white.select(F.explode("groups").alias("group"), "deviation", "white")
    joined = grouped.where("x is null").select("id", "group").join(found, "group")
    return joined.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
