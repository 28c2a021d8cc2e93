"""Pair tables that are small enough to be known to every task, and what is looked up in them record by record.

A pair table grows with the vocabulary, records with the data. Where the table has at most `MOST_PAIRS` rows (some MB, as
in Spark's own broadcast joins) a record's terms are looked up in its row, so that no row per pair of terms of a record is
ever formed. Larger tables are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_PAIRS = 200_000
HIT = "array<struct<query: string, sim: double, term: string>>"


def small_rows(pairs: DataFrame, most: int | None = None) -> list[tuple] | None:
    """The rows of a pair table, or nothing if it has too many."""
    most = MOST_PAIRS if most is None else most
    if pairs.count() > most:
        return None
    return [tuple(row) for row in pairs.collect()]


# ---- leaders ----------------------------------------------------------------------------------------------------------

def neighbours(rows: list[tuple], threshold: float) -> dict[str, dict[str, float]]:
    """rows (l, r, sim, back) -> term -> the terms that it is close to, by its own direction."""
    near: dict[str, dict[str, float]] = {}
    for l, r, sim, back in rows:
        for a, b, value in ((l, r, sim), (r, l, back)):
            if value >= threshold and l != r:
                close = near.setdefault(a, {})
                close[b] = max(value, close.get(b, value))
    return near


def fold(near: dict[str, dict[str, float]], terms: list[str]) -> list[int]:
    """Per term, in order, the place of its leader: the closest earlier leader, the earliest of equals, else itself."""
    places: dict[str, int] = {}
    out = []
    for i, term in enumerate(terms):
        close = near.get(term, {})
        if len(close) <= len(places):
            found = [(-sim, places[other]) for other, sim in close.items() if other in places]
        else:
            found = [(-close[other], at) for other, at in places.items() if other in close]
        if found:
            out.append(min(found)[1])
        else:
            places[term] = i
            out.append(i)
    return out


def leader_places(spark, near: dict[str, dict[str, float]]):
    known = spark.sparkContext.broadcast(near)

    @F.arrow_udf("array<int>")
    def run(terms: pa.Array) -> pa.Array:
        return pa.array([fold(known.value, row) for row in terms.to_pylist()], pa.list_(pa.int32()))

    return run


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def most_of_cluster(places: pa.Array, values: pa.Array) -> pa.Array:
    """Per member the largest value among the members with the same leader."""
    out = []
    for at, row in zip(places.to_pylist(), values.to_pylist()):
        best = np.full(len(row), -np.inf)
        np.maximum.at(best, at, row)
        out.append(best[at])
    return pa.array(out, pa.list_(pa.float64()))


# ---- best matches -----------------------------------------------------------------------------------------------------

@dataclass
class Lookup:
    """Per own term its (query, similarity, term) as sorted whole numbers: queries first, then falling similarity, then the term."""

    queries: list[str]
    sims: list[float]
    terms: list[str]
    keys: dict[str, np.ndarray]


def lookup(rows: list[tuple], floor: float) -> Lookup:
    rows = [r for r in rows if r[2] >= floor]
    queries, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    sims = sorted({r[2] for r in rows}, reverse=True)
    q, s, t = ({v: i for i, v in enumerate(x)} for x in (queries, sims, terms))
    keys: dict[str, list[int]] = {}
    for l, r, sim in rows:
        keys.setdefault(r, []).append((q[l] * len(sims) + s[sim]) * len(terms) + t[r])
    return Lookup(queries, sims, terms, {k: np.array(v, np.int64) for k, v in keys.items()})


def best_of(found: Lookup, rows: list[list[str] | None]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest key of every query per row, and where each row ends."""
    per_query, parts, ends, n = len(found.sims) * len(found.terms), [], [], 0
    for row in rows:
        held = [found.keys[t] for t in row or () if t in found.keys]
        if held:
            keys = np.sort(np.concatenate(held))
            query = keys // per_query
            keys = keys[np.concatenate(([True], query[1:] != query[:-1]))]
            parts.append(keys)
            n += len(keys)
        ends.append(n)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array([0, *ends], np.int32)


def best_hits(spark, rows: list[tuple], floor: float):
    """A function over columns of own terms: per column the best own term of every query, the alphabetically first of equals."""
    known = spark.sparkContext.broadcast(lookup(rows, floor))

    @F.arrow_udf(HIT)
    def run(terms: pa.Array) -> pa.Array:
        found = known.value
        keys, ends = best_of(found, terms.to_pylist())
        n, m = max(1, len(found.terms)), max(1, len(found.sims))
        hit = pa.StructArray.from_arrays(
            [pa.array(found.queries, pa.string()).take(pa.array(keys // (n * m))), pa.array(found.sims, pa.float64()).take(pa.array(keys // n % m)),
             pa.array(found.terms, pa.string()).take(pa.array(keys % n))], names=["query", "sim", "term"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hit)

    return run
