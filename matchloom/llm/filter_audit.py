"""What each filter of a chain removes in each order of the filters, per part of the corpus.

A document counts only by the set of filters that it fails (its mask), so the table is reduced to counts per part and
mask. Orders are numbered by their Lehmer rank, that is lexicographically: the orders that begin alike are an interval of
ranks. A mask is removed at step k by the orders that begin with k - 1 filters it passes and then one it fails, so its
count is added at the begin and taken off at the end of those intervals, and one prefix sum over the ranks gives
what every order removes at every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import cut

FILTERS = "ABCDE"
SPACE = " \t\n\x0b\x0c\r"
MEASURES = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def lehmer_rank(beginning: tuple[int, ...], size: int) -> int:
    """The rank of the first of the orders of `size` filters that begin so."""
    left, rank = list(range(size)), 0
    for taken, f in enumerate(beginning):
        rank += left.index(f) * factorial(size - 1 - taken)
        left.remove(f)
    return rank


def order_of(rank: int, names: str) -> str:
    """The order with that Lehmer rank."""
    left, order = list(names), ""
    for at in range(len(names) - 1, -1, -1):
        digit, rank = divmod(rank, factorial(at))
        order += left.pop(digit)
    return order


def intervals(size: int) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first rank, rank behind the last) of every removal."""
    found = []
    for step in range(1, size + 1):
        for beginning in permutations(range(size), step):
            low = lehmer_rank(beginning, size)
            passed, failed = sum(1 << f for f in beginning[:-1]), 1 << beginning[-1]
            found += [(mask, step - 1, beginning[-1], low, low + factorial(size - step))
                      for mask in range(1 << size) if mask & failed and not mask & passed]
    return found


def all_orders(counts: np.ndarray, names: str = FILTERS) -> dict[str, np.ndarray]:
    """counts: per mask the documents, the good and the toxic ones. Gives arrays by (step, rank)."""
    size = len(names)
    ranks = factorial(size)
    mask, step, _, low, high = np.array(intervals(size)).T
    ends = np.zeros((size, ranks + 1, counts.shape[1]), np.int64)
    np.add.at(ends, (step, low), counts[mask])
    np.subtract.at(ends, (step, high), counts[mask])
    removed = np.cumsum(ends, axis=1)[:, :ranks]
    orders = [order_of(rank, names) for rank in range(ranks)]
    letter = np.array([[names.index(order[k]) for order in orders] for k in range(size)])
    masks = np.arange(len(counts))
    failing = np.array([counts[masks >> f & 1 == 1, 0].sum() for f in range(size)])
    credit = np.bincount(letter.ravel(), removed[:, :, 0].ravel(), size).astype(np.int64)
    return {"order": np.array(orders), "removed": removed, "kept": counts[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=0),
            "redundant": failing[letter] - removed[:, :, 0], "unique": counts[1 << np.arange(size), 0][letter], "shapley": credit[letter]}


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's digest, and the mask of the filters that need the text alone (bit 0: A, to bit 3: D)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"))
    n, upper = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * upper.cast("long") > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((f.cast("int") * (1 << bit) for bit, f in enumerate(fails)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def tally(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per part and mask, filter E (bit 4: a smaller doc_id has the same text) included.

    Copies meet as counts per text and part, so that a text of any number of copies is one row after map-side sums."""
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = cut(failures(docs))
    named = rows.where("doc_id IS NOT NULL").join(judged, "doc_id", "left").groupBy("digest", "part", "mask", "doc_id").agg(
        F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    sums = [F.sum(c).alias(c) for c in MEASURES]
    copies = named.groupBy("digest", "part", "mask").agg(*sums, F.min("doc_id").alias("low"), F.min_by(F.struct(*MEASURES), "doc_id").alias("kept"))
    least = copies.groupBy("digest").agg(F.min("low").alias("least"))
    copies = copies.join(least, "digest").withColumn("first", F.col("low") == F.col("least"))
    held = [F.when(F.col("first"), F.col(f"kept.{c}")).otherwise(0).alias(c) for c in MEASURES]
    firsts = copies.select("part", "mask", *held)
    others = copies.select("part", (F.col("mask") + 16).alias("mask"), *(
        (F.col(c) - F.when(F.col("first"), F.col(f"kept.{c}")).otherwise(0)).alias(c) for c in MEASURES))
    unnamed = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return firsts.unionByName(others).unionByName(unnamed).groupBy("part", "mask").agg(*sums).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang; null: empty string), order of the five filters and step: what is kept and removed, what the
    filter would have removed had it come first, what it alone removes, what is lost of the labelled rows, and the
    filter's sum over all orders. 600 rows per part.

    Nulls and empty: a null text is empty, which fails A only; a null doc_id has no order, so it neither fails E nor makes
    others fail it, and has no label. Ties: repeated rows count each; rows with an equal doc_id and text don't fail E by one
    another; of several labels of a doc_id one that says good (toxic) is enough, a null label says neither. Long texts are measured
    whole, in their row. Other columns are not read. An empty table gives an empty result.
    """
    per_part = tally(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("rows"))  # 32 masks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((1 << len(FILTERS), len(MEASURES)), np.int64)
                for r in row["rows"]:
                    counts[r["mask"]] = [r[c] for c in MEASURES]
                found = all_orders(counts)
                steps, ranks = found["kept"].shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * (steps * ranks)), pa.array(np.tile(found["order"], steps)), pa.array(np.repeat(np.arange(1, steps + 1, dtype=np.int32), ranks)),
                     *(pa.array(a.ravel().astype(np.int64)) for a in (found["kept"], found["removed"][:, :, 0], found["redundant"], found["unique"],
                                                                     found["removed"][:, :, 1], found["removed"][:, :, 2], found["shapley"]))],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return per_part.mapInArrow(run, RESULT)
