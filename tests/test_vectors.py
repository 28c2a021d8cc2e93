"""The vector join against all pairs, on spread, clustered and degenerate vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import vectors as vc

SCHEMA = "term string, embedding array<float>, cell string, chunk int"


def table(spark, names, m):
    return spark.createDataFrame([(n, None if v is None else [float(x) for x in v], "c", 1) for n, v in zip(names, m)], SCHEMA).repartition(3)


def brute(left, right, threshold):
    out = {}
    for a, x in left.items():
        for b, y in right.items():
            if a == b or x is None or y is None or not np.any(x) or not np.any(y):
                continue
            n = max(len(x), len(y))
            x1, y1 = (np.pad(np.float32(v).astype(float), (0, n - len(v))) for v in (x, y))
            cos = x1 @ y1 / (np.linalg.norm(x1) * np.linalg.norm(y1))
            if cos >= threshold:
                out[a, b] = round(float(cos), 6)
    return out


def clustered(r, n, width, centres):
    middle = r.normal(size=(centres, width))
    return middle[r.integers(0, centres, n)] + r.normal(size=(n, width)) * 0.25


@pytest.mark.parametrize("threshold", [0.35, 0.75, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_equals_all_pairs(spark, threshold, kind):
    r = np.random.default_rng(4)
    make = (lambda n: r.normal(size=(n, 12))) if kind == "spread" else (lambda n: clustered(r, n, 12, 9))
    one, two = list(make(160)), list(make(110))
    one[3], one[4], one[5], one[6] = None, np.zeros(12), one[7], two[9]
    one.append(two[3][:5])
    left, right = {f"a{i}": v for i, v in enumerate(one)}, {f"b{i}": v for i, v in enumerate(two)} | {"a1": one[1], "a2": two[0]}
    ours = vc.vector_join(table(spark, left, left.values()), table(spark, right, right.values()), threshold, size=16)
    got = [(r.l, r.r, round(r.cos, 6)) for r in ours.pairs.collect()]
    if threshold < 1:  # at 1 rounding decides
        assert sorted(got) == sorted((a, b, c) for (a, b), c in brute(left, right, threshold).items())
    whole = table(spark, left, left.values())
    own = [(r.l, r.r, round(r.cos, 6)) for r in vc.vector_join(whole, whole, threshold, size=16).pairs.collect()]
    if threshold < 1:
        assert sorted(own) == sorted((a, b, c) for (a, b), c in brute(left, left, threshold).items())


def test_few_pairs_are_compared(spark):
    """On clustered vectors at a high threshold, blocks that are far apart never meet."""
    r = np.random.default_rng(5)
    names = [f"t{i}" for i in range(3000)]
    df = table(spark, names, clustered(r, 3000, 24, 60))
    met = vc.vector_join(df, df, 0.9, size=32).met.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0]
    assert met < 0.3 * 3000 * 3000 / 2


def test_a_hot_cell_is_cut_into_blocks(spark):
    names = [f"t{i}" for i in range(600)]
    df = table(spark, names, [[1.0, 1e-4 * i, 0.0] for i in range(600)])
    found = vc.vector_join(df, df, 0.9, size=50)
    assert found.met.agg(F.max("a_n")).first()[0] < 120
    assert found.pairs.count() == 600 * 599


def test_empty(spark):
    df = table(spark, [], [])
    assert vc.vector_join(df, df, 0.5).pairs.collect() == []
    with pytest.raises(ValueError):
        vc.vector_join(df, df, 0.0)
