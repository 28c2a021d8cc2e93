"""A Merkle manifest of a table: a ternary hash tree per source, and one over the sources' roots.

The tree of a source is cut into aligned subtrees ("blocks") of `height` levels of hashing. A block is one row that
stores its digests in van Emde Boas order: the tree is split at half its height, the upper part is stored first and the
lower trees behind it, each laid out in the same way. `address` finds a node in that order by arithmetic alone, without
pointers or a machine's cache size; building a block and fetching siblings both go through it. The roots of the blocks
are the leaves of the next round, until each source has one root; the roots of the sources are built up likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import small_batches
from matchloom.session import cut

ARITY, DIGEST = 3, 32
HEX = 2 * DIGEST
PATH = "array<struct<left:string,right:string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def nodes(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index):
    """Place of node `index` (a number or an array) at `depth` in the van Emde Boas order of a tree of `levels` levels."""
    at = index * 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        under = ARITY ** (depth - upper)
        at = at + nodes(upper) + index // under * nodes(levels - upper)
        index, depth, levels = index % under, depth - upper, levels - upper
    return at


def steps_to_root(n: int) -> int:
    """How often n nodes are grouped by threes until one is left."""
    steps = 0
    while n > 1:
        n, steps = -(-n // ARITY), steps + 1
    return steps


def build(leaves: bytes, height: int) -> bytes:
    """The stored block over consecutive leaf digests, hashed `height` times (a run of one is hashed alone)."""
    n, levels = len(leaves) // DIGEST, height + 1
    tree = np.zeros((nodes(levels), DIGEST), np.uint8)
    tree[address(levels, height, np.arange(n))] = np.frombuffer(leaves, np.uint8).reshape(-1, DIGEST)
    for depth in range(height, 0, -1):
        below = tree[address(levels, depth, np.arange(n))].tobytes().hex().encode()
        made = b"".join(sha256(below[at : at + ARITY * HEX]).digest() for at in range(0, len(below), ARITY * HEX))
        n = -(-n // ARITY)
        tree[address(levels, depth - 1, np.arange(n))] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
    return tree.tobytes()


class Block:
    """A stored block with n leaves."""

    def __init__(self, layout: bytes, n: int):
        self.tree = np.frombuffer(layout, np.uint8).reshape(-1, DIGEST)
        self.n, self.height = n, 0
        while nodes(self.height + 1) < len(self.tree):
            self.height += 1
        self.rows: list[str] = []

    def level(self, up: int) -> str:
        """All digests of the level `up` steps above the leaves, left to right, as hex."""
        while len(self.rows) <= up:
            depth, wide = self.height - len(self.rows), -(-self.n // ARITY ** len(self.rows))
            self.rows.append(self.tree[address(self.height + 1, depth, np.arange(wide))].tobytes().hex())
        return self.rows[up]

    def root(self) -> bytes:
        return self.tree[0].tobytes()

    def path(self, slot: int) -> list[tuple[str, str]]:
        """Siblings of a leaf, level by level upwards: those to its left and those to its right."""
        found = []
        for up in range(self.height):
            row, run = self.level(up), slot // ARITY * ARITY
            found.append((row[run * HEX : slot * HEX], row[(slot + 1) * HEX : (run + ARITY) * HEX]))
            slot //= ARITY
        return found


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def leaf_of(text: Column) -> Column:
    def field(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    columns = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("string"), text]
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the source in order: null before all others), doc_id, digest, and the digest of the tampered row."""
    text = F.col("text").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"), F.col("doc_id").cast("long"),
        leaf_of(text).alias("digest"), leaf_of(F.when(tampered, F.translate(text, "\n", "")).otherwise(text)).alias("altered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `at`, the exact position of a row in its group, and `n`, the rows of the group. Sorted ranges number their
    rows; only a row per range and group is added up, so that a group of any size is never in one task."""
    ranges = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranges = cut(ranges.withColumn("place", F.monotonically_increasing_id())).withColumn("task", F.shiftright("place", 33))
    parts = ranges.groupBy("grp", "task").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("grp")
    before = F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "task", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    return ranges.join(parts, ["grp", "task"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("place", "task", "first", "before")


def store(level: DataFrame, height: int) -> DataFrame:
    """The blocks of a level (grp, at, n, digest, doc_id, altered): grp, block, n (of the group), layout, root, and the
    ids and altered digests of the slots. A block has 3^height slots at most, whatever the size of its group."""
    width = ARITY**height
    slot = F.struct((F.col("at") % width).alias("slot"), "digest", "doc_id", "altered")
    block = F.floor(F.col("at") / width).cast("long")
    grouped = level.groupBy("grp", block.alias("block"), "n").agg(F.sort_array(F.collect_list(slot)).alias("s"))
    grouped = grouped.select("grp", "block", "n", *(F.col(f"s.{c}").alias(c) for c in ("digest", "doc_id", "altered")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, roots = [], []
            for n, digests in zip(batch.column("n").to_pylist(), batch.column("digest").to_pylist()):
                layouts.append(build(b"".join(digests), min(height, steps_to_root(n))))
                roots.append(layouts[-1][:DIGEST])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("grp", "block", "n", "doc_id", "altered")), pa.array(layouts, pa.binary()), pa.array(roots, pa.binary())],
                names=["grp", "block", "n", "doc_id", "altered", "layout", "root"])

    schema = "grp string, block long, n long, doc_id array<long>, altered array<binary>, layout binary, root binary"
    return cut(small_batches(grouped, 64).mapInArrow(run, schema))


def rounds(level: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The blocks of every round, and the roots (grp, last round, root). The number of rounds is that of the largest group."""
    stored, roots, width = [], None, ARITY**height
    while True:
        blocks = store(level, height)
        done = blocks.where(F.col("n") <= width).select("grp", F.lit(len(stored)).alias("last"), "root")
        stored.append(blocks)
        roots = done if roots is None else roots.unionByName(done)
        most = blocks.agg(F.max("n")).first()[0] or 0
        if most <= width:
            return stored, roots
        level = blocks.where(F.col("n") > width).select(
            "grp", F.col("block").alias("at"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))


def hand_down(row: dict, block: Block, above: list, width: int) -> Iterator[dict]:
    """Paths of the slots of a block: their siblings in it, then the path above it."""
    for slot in range(block.n):
        yield {"grp": row["grp"], "block": row["block"] * width + slot, "path": [{"left": a, "right": b} for a, b in block.path(slot) + above],
               "subroot": row["subroot"], "root": row["root"]}


def prove(row: dict, block: Block, above: list, width: int) -> Iterator[dict]:
    """The rows of RESULT for the documents of a block."""
    whole = block.level(0)
    for slot, (doc_id, altered) in enumerate(zip(row["doc_id"], row["altered"])):
        path = block.path(slot) + above
        folded = fold(altered.hex(), path)
        yield {"doc_id": doc_id, "leaf": whole[slot * HEX : (slot + 1) * HEX], "subroot": row["subroot"], "root": row["root"],
               "proof_sha256": sha256("".join(left + right for left, right in path).encode()).hexdigest(),
               "folded_root": folded, "verified": folded == row["root"]}


def descend(stored: list[DataFrame], tops: DataFrame, height: int, first: Callable, schema: str) -> DataFrame:
    """From the last round to the first, joins each block with the path above it and makes the paths of its slots. `tops`
    has grp, last, path, subroot and root; `first` makes the rows of the first round."""
    carried = f"grp string, block long, path {PATH}, subroot string, root string"
    lower = None
    for number in range(len(stored) - 1, -1, -1):
        upper = tops.where(F.col("last") == number).select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        upper = upper if lower is None else upper.unionByName(cut(lower))
        make, form = (hand_down, carried) if number else (first, schema)
        lower = small_batches(stored[number].drop("root").join(upper, ["grp", "block"]), 64).mapInArrow(by_block(make, form, ARITY**height), form)
    return lower


def by_block(make: Callable, schema: str, width: int) -> Callable:
    names = [part.split()[0] for part in schema.replace(PATH, "path_type").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                above = [(step["left"], step["right"]) for step in row["path"]]
                rows = list(make(row, Block(row["layout"], len(row["doc_id"])), above, width))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, TYPES.get(n, pa.string())) for n in names]))

    return run


TYPES = {"doc_id": pa.int64(), "block": pa.int64(), "verified": pa.bool_(),
         "path": pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}


def manifest(docs: DataFrame, height: int = 6) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot (of its source), root (of the table), proof_sha256 (over its siblings), and
    what becomes of it when the rows whose decimal doc_id has an even crc32 lose the line feeds of their text:
    folded_root and verified.

    Nulls: a null field counts as "-" in its leaf; a null source is a source of its own, before all others; rows with a
    null doc_id come first in their source and are never tampered with. Ties: rows of a source that share a doc_id are in
    order of their leaves; repeated rows are leaves of their own. Long texts are hashed whole by Spark, in their row, and
    never reach Python. A lone leaf is its source's subroot, a lone subroot the root, and a row alone has no siblings
    (the hash of nothing). Columns other than the five are not read. An empty table gives an empty result.
    """
    stored, subroots = rounds(placed(leaves(docs), "doc_id", "digest"), height)
    over = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source_key"), "last", F.col("root").alias("digest"),
                           F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    over = cut(placed(over, "source_key"))
    above, top = rounds(over, height)
    top = top.select("grp", "last", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                     F.lower(F.hex("root")).alias("root"))
    paths = descend(above, top, height, hand_down, f"grp string, block long, path {PATH}, subroot string, root string")
    paths = cut(paths.select(F.col("block").alias("at"), "path", "root"))
    tops = over.join(paths, "at").select(F.col("source_key").alias("grp"), "last", "path", F.lower(F.hex("digest")).alias("subroot"), F.col("root"))
    return descend(stored, cut(tops), height, prove, RESULT)
