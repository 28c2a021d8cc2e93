"""Greedy leader clustering of the terms of each record, in the order of their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import near
from matchloom.session import cut

STATE = "struct<terms: array<string>, leaders: array<string>>"


def _edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """Undirected edges, stored under the end with fewer edges.

    'python' may be close to a million phrases, each of them to few terms. Expanding records from the end with few
    edges keeps the join below linear in what the records hold.
    """
    e = pairs.where((F.col("l") != F.col("r")) & ((F.col("sim") >= threshold) | (F.col("back") >= threshold)))
    flipped = e.select(F.col("r").alias("l"), F.col("l").alias("r"), F.col("back").alias("sim"), F.col("sim").alias("back"))
    one = e.union(flipped).where("l < r").groupBy("l", "r").agg(F.max("sim").alias("sim"), F.max("back").alias("back"))
    degree = one.select(F.col("l").alias("t")).union(one.select("r")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    both = one.join(degree.select(F.col("t").alias("l"), F.col("n").alias("ln")), "l").join(
        degree.select(F.col("t").alias("r"), F.col("n").alias("rn")), "r"
    )
    keep = F.col("ln") <= F.col("rn")
    return both.select(
        F.when(keep, F.col("l")).otherwise(F.col("r")).alias("low"), F.when(keep, F.col("r")).otherwise(F.col("l")).alias("high"),
        F.when(keep, F.col("sim")).otherwise(F.col("back")).alias("up"), F.when(keep, F.col("back")).otherwise(F.col("sim")).alias("down"),
    )


def near_terms(items: DataFrame, pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, term, pos, other, other_pos, sim): the earlier terms of the same record that a term may join."""
    rows = items.select(*keys, "term", "pos")
    low = rows.select(*keys, F.col("term").alias("low"), F.col("pos").alias("low_pos"))
    high = rows.select(*keys, F.col("term").alias("high"), F.col("pos").alias("high_pos"))
    near = low.join(_edges(pairs, threshold), "low").join(high, [*keys, "high"])
    later = F.col("low_pos") > F.col("high_pos")
    return near.select(
        *keys,
        F.when(later, F.col("low")).otherwise(F.col("high")).alias("term"),
        F.when(later, F.col("low_pos")).otherwise(F.col("high_pos")).alias("pos"),
        F.when(later, F.col("high")).otherwise(F.col("low")).alias("other"),
        F.when(later, F.col("high_pos")).otherwise(F.col("low_pos")).alias("other_pos"),
        F.when(later, F.col("up")).otherwise(F.col("down")).alias("sim"),
    ).where(F.col("sim") >= threshold)


def in_one_row(near: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, leader) of the terms that join a leader: each record is folded in its row."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("n"), "other_pos", "other")))
    per_term = near.groupBy(*keys, "term", "pos").agg(ranked.alias("near"))
    per_record = per_term.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "near"))).alias("todo"))

    def step(state, x):
        free = F.get(F.filter(x["near"], lambda o: ~F.array_contains(state["terms"], o["other"])), F.lit(0))["other"]
        return F.transform(
            F.array(free),
            lambda leader: F.when(leader.isNull(), state).otherwise(
                F.struct(
                    F.concat(state["terms"], F.array(x["term"])).alias("terms"),
                    F.concat(state["leaders"], F.array(leader)).alias("leaders"),
                )
            ),
        )[0]

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("terms"), empty.alias("leaders")).cast(STATE)
    return per_record.select(*keys, F.aggregate("todo", start, step).alias("s")).select(
        *keys, F.explode(F.arrays_zip(F.col("s.terms").alias("term"), F.col("s.leaders").alias("leader"))).alias("z")
    ).select(*keys, F.col("z.term").alias("term"), F.col("z.leader").alias("leader"))


def in_rounds(near: DataFrame, keys: list[str]) -> DataFrame:
    """The same by joins to a fixed point, for records of any size.

    Leaders are the lexicographically first independent set: a term leads if none of its earlier near terms does. A round
    decides every term that has an earlier near leader, and every term all of whose earlier near terms are decided; what
    was decided leaves the edges. There are as many rounds as the longest chain of terms that wait for each other.
    """
    open_ = cut(near.select(*keys, "term", "other"))
    ends = [*keys, F.col("other").alias("term")]
    leading = cut(open_.select(*ends).distinct().join(open_.select(*keys, "term"), [*keys, "term"], "left_anti"))
    new, out = leading.withColumn("leads", F.lit(True)), [leading]
    while not open_.isEmpty():
        known = new.withColumnRenamed("term", "other")
        seen = cut(open_.join(known, [*keys, "other"], "left"))
        waits = seen.groupBy(*keys, "term").agg(F.max(F.coalesce("leads", F.lit(False))).alias("joins"), F.max(F.col("leads").isNull()).alias("waits"))
        new = cut(waits.where("joins OR NOT waits").select(*keys, "term", (~F.col("joins")).alias("leads")))
        if new.isEmpty():  # an earliest open term always can be decided
            raise ValueError("positions repeat in a record")
        out.append(new.where("leads").drop("leads"))
        # an edge is used once, in the round after its earlier end was decided; the edges of terms that are decided now go
        open_ = cut(seen.where("leads IS NULL").drop("leads").join(new, [*keys, "term"], "left_anti"))
    leads = out[0]
    for more in out[1:]:
        leads = leads.unionByName(more)
    best = F.min(F.struct((-F.col("sim")).alias("n"), "other_pos", "other"))
    joined = near.join(leads.withColumnRenamed("term", "other"), [*keys, "other"]).groupBy(*keys, "term").agg(best.alias("b"))
    return joined.join(leads, [*keys, "term"], "left_anti").select(*keys, "term", F.col("b.other").alias("leader"))


def by_joins(items: DataFrame, pairs: DataFrame, keys: list[str], threshold: float, one_row: int) -> DataFrame:
    """items with their leader, from a row per pair of close terms of a record: for pair tables or records of any size."""
    near = cut(near_terms(items, pairs, keys, threshold))
    large = cut(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_row).select(*keys))
    if large.isEmpty():
        joined = in_one_row(near, keys)
    else:
        joined = in_one_row(near.join(large, keys, "left_anti"), keys).unionByName(in_rounds(near.join(large, keys, "left_semi"), keys))
    return items.join(joined, [*keys, "term"], "left").withColumn("leader", F.coalesce("leader", "term"))


def records(
    items: DataFrame, pairs: DataFrame, keys: list[str], threshold: float, one_row: int = 20_000, most: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per record: ``members``, its terms in order of pos with their other columns and their leader.

    A term joins the most similar earlier leader at or above the threshold (the earliest of equals), else it leads. With a
    small pair table a record is folded in its row; records of more than `one_row` terms, and all records if the table is
    large, are decided by joins. All ways give the same leaders. ``most``: (column, name), the largest value in each cluster.
    """
    rest = [c for c in items.columns if c not in (*keys, "pos", "term")]
    rows = near.small_rows(pairs.where((F.col("l") != F.col("r")) & ((F.col("sim") >= threshold) | (F.col("back") >= threshold))).select("l", "r", "sim", "back"))
    large = None
    if rows is not None:
        large = cut(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_row).select(*keys))
        if large.isEmpty():
            large = None
    small = items if large is None else items.join(large, keys, "left_anti")
    hard = items if rows is None else None if large is None else items.join(large, keys, "left_semi")
    out = None
    if rows is not None:
        place = near.leader_places(items.sparkSession, near.neighbours(rows, threshold))
        packed = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "term", *rest))).alias("t"))
        packed = packed.withColumn("place", place(F.col("t.term")))
        best = [] if most is None else [near.most_of_cluster(F.col("place"), F.col(f"t.{most[0]}")).alias("best")]
        packed = packed.select(*keys, "t", "place", *best)
        out = packed.select(*keys, F.transform("t", lambda x, i: F.struct(
            *[x[c].alias(c) for c in ("pos", "term", *rest)], F.get("t", F.get("place", i))["term"].alias("leader"),
            *([] if most is None else [F.get("best", i).alias(most[1])]))).alias("members"))
    if hard is not None:
        led = by_joins(hard, pairs, keys, threshold, one_row)
        if most is not None:
            led = led.withColumn(most[1], F.max(most[0]).over(Window.partitionBy(*keys, "leader")))
        columns = ["pos", "term", *rest, "leader", *([] if most is None else [most[1]])]
        grouped = led.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("members"))
        out = grouped if out is None else out.unionByName(grouped)
    return out


def leaders(items: DataFrame, pairs: DataFrame, keys: list[str], threshold: float, one_row: int = 20_000) -> DataFrame:
    """items(keys, term, pos) with distinct terms per record -> the same rows with their leader."""
    return records(items, pairs, keys, threshold, one_row).select(*keys, F.inline("members")).select(*items.columns, "leader")


def clusters(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cluster: canonical (its leader) and sorted members."""
    return assigned.groupBy(*keys, F.col("leader").alias("canonical")).agg(
        F.array_sort(F.collect_set("term")).alias("members")
    )
