"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to keys, inside a key to tiles in order of
population count, and each pair of tiles whose counts can lie within the radius
is compared completely with numpy's exclusive-or and bit counts.

* ``fingerprints``: 64 bits, radius r.  Keys: r + 1 blocks of bits.  Two
  fingerprints within r differ in at most r blocks, so they share one.
* ``near_groups``: 256 bits find candidates for a wanted Jaccard similarity.  Keys: shingles.  Of two sets alike
  by 0.8, the first fifths (and one more) in any common order of shingles share one, so each set is dealt to these; the order
  puts rare shingles first, so passages that many documents share bring nobody together, and a document with enough shingles of its own
  is dealt to none.  Tiles are in order of size.  Then the candidates of a component are compared again, and linked by the exact Jaccard of their shingle sets.

A tile emits no pairs but a spanning forest of what it linked, so a group of
copies costs one edge for each member, and ``components`` joins the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm.components import components
from fieldstream.llm.shared import in_parts, keep, texts_of

#: Fingerprints of a tile, and of the square blocks it is compared in.
TILE, BLOCK = 4096, 512
SEED = 42
#: Lanes of the wide fingerprint: odd multipliers by the golden-ratio step of splitmix64.
LANES = 4
STEP, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Candidates at a Jaccard of 0.8: bits that may differ.  A bit differs with a chance of 0.152 for large
#: sets and 0.188 at most (4 of 5 shingles shared), so a pair exceeds the radius with a chance under 1e-11.
RADIUS = 94
#: One in so many shingles, by hash, comes before all others in the order and is counted.
FIRST_CLASS = 4
#: Keys of a document that candidates are sought by first.
FIRST_KEYS = 2


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle (``words`` words, one space between); A-Z become lower case."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """64 bits; each is 1 if set in over half of the hashes.

    Counts eight bit positions at once: a byte of a sum of 255 masked words can't overflow.
    """
    if not len(hashes):
        return 0
    ones, counts = np.uint64(0x0101010101010101), np.zeros(64, np.int64)
    starts = np.arange(0, len(hashes), 255)
    for s in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(s)) & ones, starts)
        counts[s::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """An independent 64-bit hash of a hash, for one lane."""
    z = h + np.uint64((lane * STEP) & ALL)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _narrow(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            fp = np.array([majority(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return run


def reach_of(size: int, similarity: float) -> int:
    """How many shingles of a set, the first in any order, hold one of every set that is alike."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def first_ones(hashes: np.ndarray, reach: int) -> np.ndarray:
    """All first-class hashes of a sorted set; where they are fewer than ``reach``, the smallest others as well."""
    first = hashes % np.uint64(FIRST_CLASS) == 0
    own = hashes[first]
    return own if len(own) >= reach else np.concatenate([own, hashes[~first][: reach - len(own)]])


def _wide(words: int, similarity: float | None = None):
    """doc_id, size, fp and sig (a 128-bit hash of the whole shingle set); with ``similarity`` the hashes that may become keys, else the sorted set of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            sizes, fps, sigs, held = [], [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                sizes.append(len(h))
                fps.append(np.array([majority(_mixed(h, lane)) for lane in range(LANES)], np.uint64).tobytes())
                sigs.append(xxhash.xxh3_128_digest(h.tobytes()))
                held.append(h.tobytes() if similarity is None else first_ones(h, reach_of(len(h), similarity)).view(np.int64))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(held, pa.binary() if similarity is None else pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "fp", "sig", "hashes"])

    return run


def _link_alike(label: np.ndarray, x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], flag: np.ndarray, similarity: float) -> None:
    """Joins the labels of the pairs (x, y), in order of x, whose sets of ranks have this exact Jaccard or more."""
    at = np.flatnonzero(np.diff(x)) + 1
    for k, ys in zip(x[np.r_[0, at]], np.split(y, at), strict=True):
        ys = ys[label[ys] != label[k]]
        if not len(ys):
            continue
        flag[sets[k]] = True
        sizes = np.array([len(sets[q]) for q in ys])
        shared = np.add.reduceat(flag[np.concatenate([sets[q] for q in ys])], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
        flag[sets[k]] = False
        ys = ys[shared >= similarity * (len(sets[k]) + sizes - shared)]
        if len(ys):
            joined = np.unique(np.r_[label[k], label[ys]])
            label[np.isin(label, joined)] = joined[0]


def _link(fps: np.ndarray, other: np.ndarray | None, radius: int, vids: np.ndarray, sizes: np.ndarray | None = None, similarity: float = 0.0, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """Local component labels of the rows of ``fps`` (then of ``other``) within the radius; rows with equal ``vids`` are one from the start.

    With ``other``, only pairs between the two are compared.  With ``sizes``, only those whose
    sizes allow the similarity; with ``sets`` (of shingle hashes, not empty), only those that have it.
    """
    n = len(fps)
    rows = fps if other is None else np.concatenate([fps, other])
    by = np.bitwise_count(rows).sum(1, dtype=np.int64) if sizes is None else sizes
    far = (lambda low, high: high - low > radius) if sizes is None else (lambda low, high: low < similarity * high)
    left = np.argsort(by[:n], kind="stable")
    right = left if other is None else n + np.argsort(by[n:], kind="stable")
    _, first_of, place = np.unique(vids, return_index=True, return_inverse=True)
    label = first_of[place]
    if sets is not None:
        ranks = np.unique(np.concatenate(sets), return_inverse=True)[1]
        flag = np.zeros(len(ranks), bool)
        sets = np.split(ranks, np.cumsum([len(h) for h in sets])[:-1])

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        bits = np.bitwise_count(rows[a, None, 0] ^ rows[None, b, 0])
        if rows.shape[1] > 1:
            bits = bits.astype(np.uint16)
        for lane in range(1, rows.shape[1]):
            bits += np.bitwise_count(rows[a, None, lane] ^ rows[None, b, lane])
        x, y = np.nonzero(bits <= radius)
        x, y = a[x], b[y]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if sizes is not None:
            near = ~far(np.minimum(by[x], by[y]), np.maximum(by[x], by[y]))
            x, y = x[near], y[near]
        if sets is not None:
            if len(x):
                _link_alike(label, x, y, sets, flag, similarity)
            return
        while len(x):
            p, q = label[x], label[y]
            low = np.minimum(p, q)
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]

    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if other is None else 0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            if far(by[a[-1]], by[b[0]]) or far(by[b[-1]], by[a[0]]):
                continue
            # rows that are joined already needn't meet: of the commonest label, only against others
            names, counts = np.unique(label[np.concatenate([a, b])], return_counts=True)
            if len(names) == 1:
                continue
            same = names[counts.argmax()]
            odd = b[label[b] != same]
            inside = label[a] == same
            for p, q in ((a[~inside], b), (a[inside], odd)):
                if len(p) and len(q):
                    compare(p, q)
    return label


def _forest(radius: int, lanes: int, similarity: float | None = None):
    """One edge for each linked row of a tile (column ``a``), or of a pair of tiles (``a`` and ``b``)."""

    def members(cell: pa.Array, k: int) -> dict:
        part = cell.slice(k, 1).flatten()
        got = {f.name: part.field(f.name) for f in part.type}
        out = {"fp": np.frombuffer(b"".join(got["fp"].to_pylist()), np.uint64).reshape(-1, lanes), "vid": got["vid"].to_numpy(zero_copy_only=False), "size": None, "hashes": None}
        if "size" in got:
            out["size"] = got["size"].to_numpy(zero_copy_only=False)
        if "hashes" in got:
            out["hashes"] = [np.frombuffer(h, np.uint64) for h in got["hashes"].to_pylist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for k in range(batch.num_rows):
                one = members(batch.column(0), k)
                vid, size, hashes, other = one["vid"], one["size"], one["hashes"], None
                if batch.num_columns > 1:
                    two = members(batch.column(1), k)
                    other, vid = two["fp"], np.concatenate([vid, two["vid"]])
                    size = None if size is None else np.concatenate([size, two["size"]])
                    hashes = None if hashes is None else hashes + two["hashes"]
                to = vid[_link(one["fp"], other, radius, vid, size, similarity or 0.0, hashes)]
                moved = np.unique(np.stack([vid, to], 1)[vid != to], axis=0)
                u.append(moved[:, 0])
                v.append(moved[:, 1])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], names=["u", "v"])

    return run


def _tiles(rows: DataFrame, tile: int, similarity: float | None = None) -> DataFrame:
    """The tiles of ``rows``, a table: key, tile, rows, and the least and greatest vid and size (or pop) of each.

    Columns: key, fp binary and vid; pop, or with ``similarity`` size, by which tiles are in order; perhaps
    hashes, the sets whose exact similarity decides; own, which tells rows of one vid apart; and lead, by which tiles are in order
    before that: a tile is pure if all its rows are of the vid that leads its key.
    """
    by = "pop" if similarity is None else "size"
    carried = [c for c in ("fp", "vid", "size", "hashes") if c in rows.columns]
    first = [c for c in ("lead",) if c in rows.columns]
    room = _room(rows)
    order = Window.partitionBy("key").orderBy(*first, by)
    whole = Window.partitionBy("key")
    counts = rows.groupBy("key", *first, by).count().withColumn("room", F.col("count") * room)
    counts = counts.select("key", *first, by, "count", (F.sum("room").over(order) - F.col("room")).alias("before"), F.sum("count").over(whole).alias("all"))
    placed = rows.join(counts.where("all > 1").drop("all"), ["key", *first, by])
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("own" if "own" in rows.columns else "vid"), F.col("count")) * room) / tile)
    ends = [f(c).alias(f"{n}_{c}") for c in (by, "vid") for n, f in (("low", F.min), ("high", F.max))]
    return keep(placed.groupBy("key", at.alias("tile")).agg(F.collect_list(F.struct(*carried)).alias("rows"), *ends, *(F.min(c).alias("pure") for c in first)), "tiles")


def _room(rows: DataFrame):
    """How much of a tile a row takes: those with shingle sets take more."""
    return F.lit(1) if "hashes" not in rows.columns else 1 + F.floor(F.col("size") / 256)


def _compared(tiles: DataFrame, radius: int, lanes: int, similarity: float | None = None, neighbours: bool = False) -> DataFrame:
    """Edges (u, v) between the vids of ``tiles`` that share a key and lie within the radius.

    With ``neighbours``, a tile meets itself and the next one only.  Two pure tiles of a key needn't meet.
    """
    by = "pop" if similarity is None else "size"
    run = _forest(radius, lanes, similarity)
    found = tiles.where("low_vid < high_vid").select("rows").mapInArrow(run, "u long, v long")
    pure = ["pure"] if "pure" in tiles.columns else []
    ends = lambda x: tiles.select("key", F.col("tile").alias(f"t{x}"), *(F.col(c).alias(f"{c}_{x}") for c in (*pure, *(f"{n}_{c}" for c in (by, "vid") for n in ("low", "high")))))
    within = f"low_{by}_b - high_{by}_a <= {radius} and low_{by}_a - high_{by}_b <= {radius}" if similarity is None else f"low_{by}_b * {similarity}D <= high_{by}_a and low_{by}_a * {similarity}D <= high_{by}_b"
    apart = "least(low_vid_a, low_vid_b) < greatest(high_vid_a, high_vid_b)"
    one, two = ends("a"), ends("b")
    if neighbours:
        met = one.withColumn("tb", F.col("ta") + 1).join(two, ["key", "tb"])
    elif pure:
        met = one.where("not pure_a").join(two, "key").where("pure_b or ta < tb")
    else:
        met = one.join(two, "key").where("ta < tb")
    pairs = met.where(f"{within} and {apart}").select("key", "ta", "tb")
    ra = tiles.select("key", F.col("tile").alias("ta"), F.col("rows").alias("a"))
    rb = tiles.select("key", F.col("tile").alias("tb"), F.col("rows").alias("b"))
    across = pairs.join(ra, ["key", "ta"]).join(rb, ["key", "tb"]).select("a", "b").mapInArrow(run, "u long, v long")
    return found.union(across)


def _open(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` of the keys that hold several vids, and lead: whether the vid is the commonest of a key that fills more than a tile."""
    each = rows.groupBy("key", "vid").agg(F.count("*").alias("n"), F.sum(_room(rows)).alias("room"))
    keys = each.groupBy("key").agg(F.min("vid").alias("low"), F.max("vid").alias("high"), F.sum("room").alias("room"), F.max(F.struct("n", "vid")).alias("most"))
    several = keys.where("low < high").select("key", F.when(F.col("room") > tile, F.col("most.vid")).alias("leader"))
    # a table, so that the join can be split at a key that a third of all rows have
    return rows.join(keep(several, "open"), "key").withColumn("lead", F.coalesce(F.col("vid") == F.col("leader"), F.lit(False))).drop("leader")


def _chained(first: DataFrame, then: DataFrame) -> DataFrame:
    """(id, root): the roots ``first``, themselves joined by the roots ``then`` (both tables)."""
    then = then.select(F.col("id").alias("root"), F.col("root").alias("last"))
    every = first.union(first.select("root", "root")).union(then.select("root", "root")).distinct()
    return every.join(then, "root", "left").select("id", F.coalesce("last", "root").alias("root"))


def _joined(rows: DataFrame, tile: int, similarity: float) -> DataFrame:
    """(id, root): components of the vids of ``rows`` over links inside their keys.

    Neighbouring tiles meet first, which joins a large group of near copies at a cost that is linear in its rows.  Of a key with more
    tiles that still holds several components, the rows of the largest then meet all others, and the others one another, so no link is lost.
    """
    tiles = _tiles(rows, tile, similarity)
    first = keep(components(_compared(tiles, RADIUS, LANES, similarity, neighbours=True)), "roots")
    wide = tiles.groupBy("key").agg(F.max("tile").alias("tiles")).where("tiles > 1").select("key")
    held = tiles.join(wide, "key", "left_semi").select("key", F.explode("rows").alias("row")).select("key", "row.*")
    rooted = held.join(first.withColumnRenamed("id", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    rooted = keep(rooted.withColumnRenamed("vid", "own").withColumnRenamed("root", "vid"), "rooted")
    rest = _open(rooted, tile)
    return _chained(first, keep(components(_compared(_tiles(rest, tile, similarity), RADIUS, LANES, similarity)), "roots"))


def fingerprints(docs: DataFrame, words: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of ``radius`` bits or fewer.

    Repeated shingles count each time.  A text of fewer than ``words`` words has
    one shingle, its whole sequence of words; one without words, or a null text, has the
    fingerprint zero.  Very long texts count whole.  Rows with equal fingerprints are one vertex, so copies
    and repeated rows cost nothing.  A row with a null doc_id gets a fingerprint and links like any other, but does
    not name its component: one of such rows only has component_id null.  An empty table gives no rows; other columns are not read.
    """
    marks = keep(texts_of(docs).mapInArrow(_narrow(words), "doc_id long, fp long"), "fp")
    vertices = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    blocks = radius + 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    key = F.array(*(F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * blocks + k for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))
    # the order of the bytes is of no account to exclusive-or and bit counts
    rows = vertices.select(F.explode(key).alias("key"), F.bit_count("fp").alias("pop"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("bits"), F.col("fp").alias("vid"))
    roots = components(_compared(_tiles(rows.withColumnRenamed("bits", "fp"), tile), radius, 1))
    rooted = vertices.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marks.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _dealt(marks: DataFrame, vertices: DataFrame, similarity: float) -> DataFrame:
    """own, vid, size, fp and keys of the vertices that have any: the first shingles of each, rare ones first, which other rows have too."""
    each = marks.select("own", F.explode("hashes").alias("key"))
    known = keep(each.groupBy("key").count().where("count > 1"), "known")  # a table, so that the join can be split at a shingle that a third of all rows have
    shared = each.join(known, "key").groupBy("own").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("shared"))
    reach = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    # those that nobody else has come first in the order and take up places
    alone = F.col("n") - F.size("shared")
    keys = F.transform(F.slice("shared", 1, F.greatest(reach - alone, F.lit(0)).cast("int")), lambda x: x.key)
    named = marks.select("own", "size", "fp", "n").join(vertices.select("own", "vid"), "own")
    return named.join(shared, "own").select("own", "vid", "size", "fp", keys.alias("keys")).where(F.size("keys") > 0)


def _candidates(marks: DataFrame, vertices: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(id, root): components of vertices whose fingerprints are near.

    A group of copies shares many keys.  So neighbouring tiles of a few keys of each document come first, and then only the
    keys that still hold more than one component, with components for vertices: the rows of a key's largest one meet all others, not
    one another.  No link is lost, few pairs are compared twice, and a large group costs what is linear in its rows.
    """
    dealt = keep(_dealt(marks, vertices, similarity), "dealt")
    few = dealt.select(F.explode(F.slice(F.sort_array("keys"), 1, FIRST_KEYS)).alias("key"), "size", "fp", "vid", "own")
    first = keep(components(_compared(_tiles(few, tile, similarity), RADIUS, LANES, similarity, neighbours=True)), "roots")
    rooted = dealt.join(first.withColumnRenamed("id", "vid"), "vid", "left").select("own", "size", "fp", "keys", F.coalesce("root", "vid").alias("root"))
    rooted = keep(rooted, "rooted")
    rest = _open(rooted.select(F.explode("keys").alias("key"), "size", "fp", F.col("root").alias("vid"), "own"), tile)
    return _chained(first, keep(components(_compared(_tiles(rest, tile, similarity), RADIUS, LANES, similarity)), "roots"))


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """(doc_id, root) for each document.  Near copies: texts whose sets of ``words``-word shingles are alike by ``similarity`` (0.8 at least).

    root is the smallest doc_id of the document's group, over links of any number.  A null text is empty; empty texts and texts of white space are alike; a
    text of fewer than ``words`` words has one shingle, its whole sequence.  Very long texts count whole.  Repeated rows share their root; rows with a null
    doc_id are absent; an empty table gives no rows; other columns are not read.
    Only documents that the fingerprints make candidates are read again, for their sets.
    """
    if similarity < 0.8:
        raise ValueError("the radius of the candidates holds for similarities of 0.8 or more")
    marks = texts_of(docs).mapInArrow(_wide(words, similarity), "doc_id long, size long, fp binary, sig binary, hashes array<long>")
    marks = keep(marks.select("*", F.size("hashes").alias("n"), F.monotonically_increasing_id().alias("own")), "fp")  # once written, the numbers are settled
    # one row stands for all that have one set, under their smallest doc_id
    vertices = keep(marks.where("doc_id is not null").groupBy("sig").agg(F.min("own").alias("own"), F.min("doc_id").alias("vid")), "vertices")
    maybe = keep(_candidates(marks, vertices, similarity, tile), "maybe")
    held = docs.join(maybe.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = texts_of(held).mapInArrow(_wide(words), "vid long, size long, fp binary, sig binary, hashes binary")
    sets = sets.groupBy("vid", "sig").agg(*(F.first(c).alias(c) for c in ("size", "fp", "hashes")))
    # a doc_id that repeats has sets of its own that other documents stand for
    named = vertices.join(maybe.withColumnRenamed("id", "vid"), "vid").select("vid", "sig", F.col("root").alias("key"))
    roots = _joined(sets.join(named, ["vid", "sig"]).drop("sig"), tile, similarity)
    named = vertices.join(roots.withColumnRenamed("id", "vid"), "vid", "left").select("sig", F.coalesce("root", "vid").alias("root"))
    return marks.select("doc_id", "sig").join(named, "sig").select("doc_id", "root").where("doc_id is not null")


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but the first (by doc_id) document of each group of near copies.

    Rows with a null doc_id stay; rows that share a doc_id stay or go together.  Null and empty texts are alike, so one of them stays; very long texts count
    whole; an empty table stays empty; all columns stay as they are, whatever their names.
    """
    lost = near_groups(docs, words, similarity).where("doc_id != root").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
