"""Skill graph as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as tx

RELATIONS = ["equivalent", "parent", "adjacent"]


def graph_rows(entries: DataFrame) -> DataFrame:
    """entries(term, value) as a model answers them -> raw rows for `skill_graph`.

    value is a JSON object with a list or a single term per relation, under its name or else its plural, or a bare list,
    which names parents. Anything else relates the term to nothing.
    """
    text = F.trim("value")
    by_name = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")

    def listed(raw):
        many = F.from_json(F.when(F.trim(raw).startswith("["), raw), "array<string>")
        single = F.when(~F.trim(raw).startswith("[") & (F.trim(raw) != ""), F.array(raw))
        return F.coalesce(many, single, tx.strings([]))

    def related(relation: str):
        named = listed(F.element_at("m", F.lit(relation)))
        found = F.when(F.size(named) > 0, named).otherwise(listed(F.element_at("m", F.lit(relation + "s"))))
        return F.when((F.lit(relation) == "parent") & text.startswith("["), listed(text)).otherwise(found)

    relations = F.array(*[F.struct(F.lit(r).alias("relation"), related(r).alias("names")) for r in RELATIONS])
    split = entries.withColumn("m", by_name).select("term", F.explode(relations).alias("x"))
    return split.select("term", "x.relation", F.posexplode("x.names").alias("pos", "related"))


def skill_graph(raw: DataFrame, per_relation: int = 8, per_term: int = 16) -> DataFrame:
    """raw(term, relation, related, pos) -> edges(term, relation, related_term).

    The first eight distinct related terms per relation and the first sixteen terms per skill, itself included, are
    what the graph holds. Repeats are merged before the ranking and ranking keeps at most those rows per map task.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation")).alias("ro")
    rows = raw.where(F.col("relation").isin(RELATIONS)).groupBy(
        tx.skill("term").alias("term"), "relation", tx.skill("related").alias("related_term")
    ).agg(F.min("pos").alias("pos")).where((F.col("related_term") != "") & (F.length("related_term") <= 80))
    first = Window.partitionBy("term", "relation").orderBy("pos", "related_term")
    kept = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_relation)
    once = kept.withColumn("ro", order).groupBy("term", "related_term").agg(F.min(F.struct("ro", "rn", "relation")).alias("f"))
    others = once.where(F.col("term") != F.col("related_term"))
    whole = Window.partitionBy("term").orderBy("f.ro", "f.rn")
    return others.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= per_term - 1).select(
        "term", F.col("f.relation").alias("relation"), "related_term"
    )
