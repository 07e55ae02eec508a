"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import forget, keep


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, least): the smallest v of each u, joined back (AQE splits a hot u)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every id with an edge; root is the smallest id of its component.

    ``edges`` has two long columns in any order; self loops, repeated edges and
    rows with a null are ignored.  An id without an edge is absent from the
    result.  Every round halves the depth at least, and its edges are written to
    the shared folder in place of the last one's; only two counts per round reach the driver.
    """
    a, b = edges.columns[:2]
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = keep(now, "edges"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = mark
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        down = _toward_least(large)
        past, now = now, keep(down.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(down.select("u", F.col("least"))).distinct(), "edges")
        forget(past)  # the next round is written, so a long session doesn't fill the folder
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
