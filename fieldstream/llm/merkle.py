"""A Merkle manifest of a table, and what every tampered row does to it.

Rows are leaves; each language has a tree of its own, and the roots of the
languages are the leaves of the last one.  A tree is cut into aligned blocks of
1,024 leaves, so a block is a complete subtree that one group builds alone, and
its root is one leaf of the next, distributed level.  Going up writes one small table for each
level; going down, every block gets the path from its root to the top.

Inside a block the tree is persistent: a tampered leaf makes a version that
shares all untouched nodes and copies only the ancestors of the leaf.  The version goes on
through the levels above along the block's path, which is again a copy of the
ancestors alone.  So versions never meet in one task, however many there are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm.shared import keep

#: A block holds 2 ** LEVELS leaves.
LEVELS = 10
#: Rows whose crc32 of the decimal doc_id this divides are tampered with.
TAMPERED = 7
ALONE, LEFT, RIGHT = 0, 1, 2  # no sibling, or on which side it is


def parent(*children: bytes) -> bytes:
    """sha256 over the digests as lowercase hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Version:
    """A root that shares all nodes of its base but those on one path: ``copied[k]`` is the new node of level k."""

    def __init__(self, base: BlockTree, at: int, copied: list[bytes]):
        self.base, self.at, self.copied = base, at, copied

    @property
    def root(self) -> bytes:
        return self.copied[-1]

    def node(self, level: int, k: int) -> bytes:
        return self.copied[level] if k == self.at >> level else self.base.levels[level][k]


class BlockTree:
    """All levels of the tree over the leaves of one block; persistent, ``with_leaf`` leaves it as it is.

    ``height`` levels are built above the leaves, though one node may be left earlier; None: until one is left.
    """

    def __init__(self, leaves: list[bytes], height: int | None = None):
        self.levels = [leaves]
        while len(self.levels) - 1 < height if height is not None else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([parent(*below[k : k + 2]) for k in range(0, len(below), 2)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, k: int) -> list[tuple[int, bytes]]:
        """(side, sibling) from leaf k up; nothing for the root."""
        out = []
        for nodes in self.levels[:-1]:
            other = k ^ 1
            out.append((ALONE, b"") if other >= len(nodes) else (LEFT if other < k else RIGHT, nodes[other]))
            k >>= 1
        return out

    def with_leaf(self, k: int, leaf: bytes) -> Version:
        """A version with another leaf k: the ancestors are copied, everything else is shared."""
        return Version(self, k, climb(leaf, self.path(k)))


def climb(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
    """The nodes from ``node`` up along a path."""
    out = [node]
    for side, other in path:
        out.append(parent(out[-1]) if side == ALONE else parent(other, out[-1]) if side == LEFT else parent(out[-1], other))
    return out


def pack(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + other for side, other in path)


def unpack(packed: bytes) -> list[tuple[int, bytes]]:
    out, k = [], 0
    while k < len(packed):
        n = 0 if packed[k] == ALONE else 32
        out.append((packed[k], packed[k + 1 : k + 1 + n]))
        k += 1 + n
    return out


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """The digest of a document, with ``n_chars`` in its place."""
    return F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang")), field(n_chars), field(F.col("text"))), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the tree (empty for a null language), digest, and tampered: the digest after tampering, null where there is none."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # never over the end of a long
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"), leaf(F.col("n_chars")).alias("digest"), F.when(hit, leaf(more)).alias("tampered"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds ``i``, the place of a row in its tree from 0, and ``n``, the rows of the tree.

    Rows are range-partitioned by tree and ``order``, so a large tree is spread; each partition counts its own rows, and
    one row for each partition and tree carries the sums on.
    """
    by = ["tree", *order]
    placed = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("tree", "__part").agg(F.min("__at").alias("__from"), F.count("*").alias("__count"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__count").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "__part", (before - F.col("__from")).alias("__shift"), F.sum("__count").over(whole).alias("n"))
    return placed.join(starts, ["tree", "__part"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("i"), "n")


def build(rows: pa.Table, levels: int) -> tuple[pa.Table, BlockTree]:
    """The rows of one block in order, and its tree: as high as a block if the tree has others, else up to one node."""
    rows = rows.sort_by("i")
    return rows, BlockTree(rows["digest"].to_pylist(), levels if rows["n"][0].as_py() > 1 << levels else None)


def block_of(levels: int) -> Column:
    return F.shiftright("i", levels).alias("block")


NODE = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])


def upward(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of blocks from ``nodes`` (tree, i, digest, n) up, each a table; in the last one every tree has one node."""

    def root(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        return pa.table([[tree], [block], [build(rows, levels)[1].root], [-(-rows["n"][0].as_py() >> levels)]], schema=NODE)

    most, out = nodes.agg(F.max("n")).first()[0] or 1, [nodes]
    while most > 1:
        out.append(keep(out[-1].groupBy("tree", block_of(levels)).applyInArrow(root, "tree string, i long, digest binary, n long"), "nodes"))
        most = -(-most >> levels)
    return out


PATH = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("path", pa.binary()), ("sub", pa.binary()), ("top", pa.binary())])


def with_paths(nodes: DataFrame, above: DataFrame, run, schema: str, levels: int) -> DataFrame:
    """``run`` over each block of nodes and the path of its root."""
    return nodes.groupBy("tree", block_of(levels)).cogroup(above.groupBy("tree", F.col("i").alias("block"))).applyInArrow(run, schema)


def downward(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The path (tree, i, path, sub, top) of each node of the lowest of ``rounds``; ``above`` has those of the tops."""

    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, tree = build(nodes, levels)
        rest, sub, top = (above[c][0].as_py() for c in ("path", "sub", "top"))
        n = nodes.num_rows
        return pa.table([nodes["tree"], nodes["i"], [pack(tree.path(k)) + rest for k in range(n)], [sub] * n, [top] * n], schema=PATH)

    for nodes in reversed(rounds[:-1]):
        above = keep(with_paths(nodes, above, down, "tree string, i long, path binary, sub binary, top binary", levels), "paths")
    return above


PROVED = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_()), ("copied", pa.int64())])


def proofs(ranked: DataFrame, blocks: DataFrame, levels: int) -> DataFrame:
    """The result rows: each leaf with its proof, and the root of its version."""

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = build(rows, levels)
        rest, sub, root = unpack(above["path"][0].as_py()), above["sub"][0].as_py().hex(), above["top"][0].as_py().hex()
        tail, n = "".join(other.hex() for _, other in rest), rows.num_rows
        found, folded, copied = [], [], []
        for k, tampered in enumerate(rows["tampered"].to_pylist()):
            found.append(hashlib.sha256(("".join(other.hex() for _, other in tree.path(k)) + tail).encode()).hexdigest())
            version = tree.with_leaf(k, tree.levels[0][k] if tampered is None else tampered)
            over = climb(version.root, rest)
            folded.append(over[-1].hex())
            copied.append(0 if tampered is None else len(version.copied) + len(over) - 1)
        return pa.table([rows["doc_id"], [d.hex() for d in tree.levels[0]], [sub] * n, [root] * n, found, folded, [f == root for f in folded], copied], schema=PROVED)

    return with_paths(ranked, blocks, prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied long", levels)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root (hex), verified, and copied (the nodes of its version; 0: not tampered with).

    Leaves are digests of doc_id, source, lang, n_chars and text.  In the tree of a language they
    ascend by doc_id, nulls first and rows of one id by leaf; the roots of the languages ascend bytewise, null first.
    Pairs of neighbours become one node, a last one alone too, until one is left; a lone leaf is its tree's root.  A null text
    differs from an empty one.  A tampered row has n_chars + 1; a null stays null, so it is verified, and
    rows without an id are never tampered with.  Very long texts are hashed whole.  An empty table has no rows and no root.
    Other columns are not read, so their names don't matter.
    """
    ranked = keep(numbered(keep(leaves(docs), "leaves"), [F.asc_nulls_first("doc_id"), "digest"]), "ranked")
    rounds = upward(ranked.select("tree", "i", "digest", "n"), levels)
    subs = keep(numbered(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), ["lang"]), "subroots")
    over = upward(subs.select("tree", "i", "digest", "n"), levels)
    root = over[-1].select("tree", "i", F.lit(b"").alias("path"), F.lit(b"").alias("sub"), F.col("digest").alias("top"))
    paths = downward(over, root, levels).select("i", "path", "top").join(subs.select("i", "lang", F.col("digest").alias("sub")), "i")
    tops = paths.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("i"), "path", "sub", "top")
    return proofs(ranked, downward(rounds[1:], tops, levels) if len(rounds) > 1 else tops, levels)
