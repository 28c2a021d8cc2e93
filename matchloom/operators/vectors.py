"""Exact threshold join of two vector tables by cosine, without meeting all pairs.

For unit vectors a cosine of at least t means a distance of at most d = sqrt(2 - 2t), so no coordinate differs by more
than d. Vectors are rotated to the axes along which the data spread most and dealt into a grid of width d over the first
of them; only neighbouring cells are joined, by their cell. Cells are cut by the nearest of a bounded number of pivots into
blocks of bounded size, and two blocks meet only if their centres and radii allow an angle that is small enough. Within two blocks the product over the leading
coordinates plus the product of the lengths of the rest (Cauchy-Schwarz) decides which pairs are worked out in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import acos, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import cut

SLACK = 1e-9  # bounds are widened by this much, so that rounding loses no pair
BLOCK = "side string, cell array<int>, chunk long, terms array<string>, rows binary, n int, centre array<double>, radius double"


@dataclass
class VectorJoin:
    """pairs (l, r, cos) at or above the threshold, both directions; met: the sizes of the blocks that were compared."""

    pairs: DataFrame
    met: DataFrame


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(term, embedding) -> term, u of length 1. Null and zero vectors have no direction and are left out."""
    v = F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.where("term IS NOT NULL AND embedding IS NOT NULL").select("term", v.alias("v")).withColumn("norm", norm)
    return rows.where("norm > 0").select("term", F.transform("v", lambda x: x / F.col("norm")).alias("u"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def rotation(units: DataFrame, width: int) -> np.ndarray:
    """Axes in order of decreasing spread. Each task sends one sum per pair of coordinates, whatever its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("u"), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "x"])

    sums = units.select("u").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # width squared
    moments = np.zeros(width * width)
    for row in sums:
        moments[row.i] = row.x
    return np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1]


def some_vectors(units: DataFrame, width: int, n: int) -> np.ndarray:
    """At most n vectors, those of the smallest term hashes: pivots that shape the blocks and change no result."""
    rows = units.select("term", "u").orderBy(F.xxhash64("term"), "term").limit(n).collect()
    out = np.zeros((max(1, len(rows)), width))
    for i, row in enumerate(rows):
        out[i, : len(row.u)] = row.u
    return out


def blocks(sides: DataFrame, axes: np.ndarray, pivots: np.ndarray, reach: float, grid: int, size: int) -> DataFrame:
    """sides(side, term, u) as rows of BLOCK."""
    width = len(axes)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = matrix(batch.column("u"), width) @ axes
            cells = np.floor(turned[:, :grid] / reach).astype(np.int32)
            nearest = np.argmax(turned @ (pivots @ axes).T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("side"), batch.column("term"), pa.array(list(cells), pa.list_(pa.int32())), pa.array(nearest), pa.array([r.tobytes() for r in turned], pa.binary())],
                names=["side", "term", "cell", "pivot", "row"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                packed = b"".join(x["row"] for x in row["rows"])
                m = np.frombuffer(packed).reshape(-1, width)
                centre = m.mean(axis=0)
                length = np.linalg.norm(centre)
                centre = centre / length if length > 0 else m[0]
                out.append({"side": row["side"], "cell": row["cell"], "chunk": row["chunk"], "terms": [x["term"] for x in row["rows"]], "rows": packed, "n": len(m),
                            "centre": centre.tolist(), "radius": float(np.arccos(np.clip(m @ centre, -1, 1)).max())})
            yield pa.RecordBatch.from_pylist(out, pa.schema(
                [("side", pa.string()), ("cell", pa.list_(pa.int32())), ("chunk", pa.int64()), ("terms", pa.list_(pa.string())), ("rows", pa.binary()),
                 ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    rows = cut(sides.mapInArrow(turn, "side string, term string, cell array<int>, pivot long, row binary"))
    counts = rows.groupBy("side", "cell", "pivot").agg(F.ceil(F.count("*") / size).alias("chunks"))
    chunk = F.expr("pivot * 1000000000L + pmod(xxhash64(term), chunks)").alias("chunk")
    dealt = rows.join(counts, ["side", "cell", "pivot"]).select("side", "cell", chunk, F.struct("term", "row").alias("x"))
    packed = dealt.groupBy("side", "cell", "chunk").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    return cut(packed.mapInArrow(pack, BLOCK))


def vector_join(left: DataFrame, right: DataFrame, threshold: float, grid: int = 3, size: int = 512, most_pivots: int = 1024) -> VectorJoin:
    """Every (l, r, cos) with a cosine of `threshold` or more between distinct terms of left and right (term, embedding).

    Terms are distinct per side; vectors of unlike length count as filled up with zeros. With `left is right` each pair
    of blocks is worked out once and its pairs come in both directions.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1 is needed")
    same = left is right
    sides = unit_vectors(left).withColumn("side", F.lit("l"))
    if not same:
        sides = sides.unionByName(unit_vectors(right).withColumn("side", F.lit("r")))
    sides = cut(sides)
    width, n = sides.agg(F.max(F.size("u")), F.count("*")).first()
    width, grid = width or 1, min(grid, width or 1)
    pivots = some_vectors(sides, width, max(1, min(most_pivots, n // size)))
    angle, reach = acos(threshold) + SLACK, sqrt(2 - 2 * threshold) + SLACK
    made = blocks(sides, rotation(sides, width), pivots, reach, grid, size)

    def of(side: str, mark: str) -> DataFrame:
        return made.where(F.col("side") == side).select(*[F.col(c).alias(f"{mark}_{c}") for c in made.columns])

    a, b = of("l", "a"), of("l" if same else "r", "b")
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in product((-1, 0, 1), repeat=grid)])
    near = a.select("a_cell", "a_chunk", "a_n", "a_centre", "a_radius", F.explode(offsets).alias("o")).withColumn(
        "b_cell", F.zip_with("a_cell", "o", lambda x, y: x + y)).drop("o")
    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between: Column = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    close = between - F.col("a_radius") - F.col("b_radius") <= angle + SLACK * 100
    if same:
        close = close & (F.struct("a_cell", "a_chunk") <= F.struct("b_cell", "b_chunk"))
    met = cut(near.join(b.select("b_cell", "b_chunk", "b_n", "b_centre", "b_radius"), "b_cell").where(close).select(
        "a_cell", "a_chunk", "a_n", "b_cell", "b_chunk", "b_n"))
    rows = met.select("a_cell", "a_chunk", "b_cell", "b_chunk").join(
        a.select("a_cell", "a_chunk", "a_terms", "a_rows"), ["a_cell", "a_chunk"]).join(b.select("b_cell", "b_chunk", "b_terms", "b_rows"), ["b_cell", "b_chunk"])
    both_ways = rows.withColumn("turned", F.lit(same) & F.expr("(a_cell, a_chunk) <> (b_cell, b_chunk)"))
    return VectorJoin(both_ways.mapInArrow(lambda batches: products(batches, width, threshold), "l string, r string, cos double"), met)


def products(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    lead = max(1, width // 4)
    schema = pa.schema([("l", pa.string()), ("r", pa.string()), ("cos", pa.float64())])
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            x, y = np.frombuffer(row["a_rows"]).reshape(-1, width), np.frombuffer(row["b_rows"]).reshape(-1, width)
            rest = np.sqrt(np.square(x[:, lead:]).sum(axis=1))[:, None] * np.sqrt(np.square(y[:, lead:]).sum(axis=1))
            i, j = np.nonzero(x[:, :lead] @ y[:, :lead].T + rest >= threshold - SLACK)
            for part in range(0, len(i), 1 << 18):
                k, m = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                cos = np.einsum("pd,pd->p", x[k], y[m])
                good = cos >= threshold
                names = np.array(row["a_terms"], object)[k[good]], np.array(row["b_terms"], object)[m[good]]
                l, r = (np.concatenate(names), np.concatenate(names[::-1])) if row["turned"] else names
                cos = np.tile(cos[good], 2) if row["turned"] else cos[good]
                other = l != r
                yield pa.RecordBatch.from_arrays([pa.array(l[other], pa.string()), pa.array(r[other], pa.string()), pa.array(cos[other])], schema=schema)
