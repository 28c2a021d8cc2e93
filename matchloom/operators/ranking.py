"""Exact positions within groups of any size, ranking of scored pairs, and top-k."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.config import DEFAULT


def position_in_group(
    df: DataFrame, keys: list[str], buckets: list[Column], order: list[Column], name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Exact row number per group without ever sorting a whole group in one task.

    ``buckets`` are coarse ascending sort keys: sorting by buckets and then by ``order`` is the wanted order. Bucket
    sizes are counted (with map-side combine), their running sum gives each bucket its first position, and only the
    rows of one bucket meet in one task. A group with a third of all rows is spread over all its buckets.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    marked = df.withColumns(dict(zip(names, buckets)))
    sizes = marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    sides = offsets.drop("_n").withColumnsRenamed({k: f"_o{k}" for k in [*keys, *names]})
    same = reduce(and_, [marked[k].eqNullSafe(sides[f"_o{k}"]) for k in [*keys, *names]])  # null keys are keys as well
    return (
        marked.join(sides, same).drop(*[f"_o{k}" for k in [*keys, *names]])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .drop("_before", *names)
    )


def match_ratio(ratio: Column, matched: Column, missing: Column) -> Column:
    """Given ratio clamped to 0..1, else matched / (matched + missing), 1 when nothing is required."""
    n = F.size(matched) + F.size(missing)
    fallback = F.when(n == 0, F.lit(1.0)).otherwise(F.size(matched) / n)
    given = F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(ratio, F.lit(1.0))))  # least and greatest pass over nulls
    return F.coalesce(given, fallback)


def effective_ratio(df: DataFrame) -> Column:
    ratio = F.col("required_match_ratio")
    return match_ratio(ratio, F.col("matched"), F.col("missing")) if {"matched", "missing"} <= set(df.columns) else ratio


def rank_results(df: DataFrame) -> DataFrame:
    """Rank per job: total desc, required ratio desc (where null: from the matched and missing skills, if the columns are
    there), confidence desc, risk asc, then candidate id, which may be text.

    Two levels: rows are counted per total (at most 101 of them) and then per profile of ratio, confidence and risk inside
    a total, and only rows of one profile meet in a task. Nulls rank after all values.
    """
    ratio = effective_ratio(df)
    last = lambda c, worst: F.coalesce(-c.cast("double"), F.lit(worst))
    totals = last(F.col("total_score"), 1.0)
    fine = F.struct(last(ratio, 1.0).alias("ratio"), last(F.col("confidence_score"), 1.0).alias("confidence"),
                    F.coalesce(F.col("risk_score").cast("double"), F.lit(float("inf"))).alias("risk"))
    inner = position_in_group(df.withColumns({"_total": totals, "_fine": fine}), ["job_id", "_total"], [F.col("_fine")], [F.col("candidate_id")], "_inner")
    counts = inner.groupBy("job_id", "_total").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("job_id").orderBy("_total").rowsBetween(Window.unboundedPreceding, -1)  # a row per total
    offsets = counts.select(F.col("job_id").alias("_job"), F.col("_total").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = inner.join(offsets, inner["job_id"].eqNullSafe(offsets["_job"]) & (inner["_total"] == offsets["_t"]))
    return out.withColumn("rank", (F.col("_before") + F.col("_inner")).cast("long")).drop("_job", "_t", "_before", "_inner", "_total", "_fine")


def best_first(df: DataFrame) -> list[Column]:
    return [
        F.desc("total_score"), effective_ratio(df).desc(), F.desc("confidence_score"), F.asc_nulls_last("risk_score"),
        F.asc("candidate_id"),
    ]


def top_k(df: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """First k per job. Spark keeps k rows per job in every map task before it shuffles (window group limit)."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    w = Window.partitionBy("job_id").orderBy(*best_first(df))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
