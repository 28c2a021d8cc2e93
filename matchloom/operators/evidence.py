"""Skill evidence of candidates: long rows (candidate_id, term, units, ord), summed and capped per term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx

UNIT = 1e12  # weights are added as whole units, so the sum does not depend on the order of rows


def _units(weight: Column) -> Column:
    return F.round(weight * UNIT).cast("long")


def _order(source: int, place, kind: int, i: Column) -> Column:
    """Place of a mention as one whole number (32 bits for the place of its entry, 27 for that in a list): a number is
    aggregated in a hash table, an array would have to be sorted."""
    place = place if isinstance(place, Column) else F.lit(place)
    return ((F.lit(source).cast("long") * 2**32 + place) * 2 + kind) * 2**27 + i


def evidence_rows(people: DataFrame, entries: DataFrame) -> DataFrame:
    """Every mention with its weight and place; entries carry ``recency`` (newest 0)."""
    out = None
    for rank, name in enumerate(["skills", "tools", "certifications"]):
        part = people.select("candidate_id", F.posexplode(name).alias("i", "v")).select(
            "candidate_id", tx.canonical("v").alias("term"), _units(F.lit(fv.LISTED_WEIGHT)).alias("units"),
            _order(rank, 0, 0, F.col("i")).alias("ord"),
        )
        out = part if out is None else out.union(part)
    decay = F.pow(F.lit(fv.EVIDENCE_DECAY), F.col("recency"))
    for rank, (terms, weight) in enumerate([
        (tx.canonical_each("skills_used"), fv.ENTRY_SKILL_WEIGHT),
        (tx.score_phrases(F.array_join("highlights", "\n"), 12), fv.HIGHLIGHT_WEIGHT),
    ]):
        out = out.union(
            entries.select("candidate_id", "recency", F.posexplode(terms).alias("i", "term")).select(
                "candidate_id", "term", _units(weight * decay).alias("units"),
                _order(3, F.col("recency"), rank, F.col("i")).alias("ord"),
            )
        )
    projects = people.select("candidate_id", F.posexplode("projects").alias("p", "project")).select(
        "candidate_id", "p", F.posexplode(tx.score_phrases("project", 8)).alias("i", "term")
    )
    out = out.union(projects.select(
        "candidate_id", "term", _units(fv.PROJECT_WEIGHT * F.pow(F.lit(fv.EVIDENCE_DECAY), F.col("p"))).alias("units"),
        _order(4, F.col("p"), 0, F.col("i")).alias("ord"),
    ))
    return out.where((F.col("term") != "") & ~F.col("term").isin(fv.SCORING_NOISE))


def skill_evidence(people: DataFrame, entries: DataFrame) -> DataFrame:
    """Weight per candidate and term, capped at 1 (a cap after each addition of positive weights is the same)."""
    return evidence_rows(people, entries).groupBy("candidate_id", "term").agg(
        (F.least(F.sum("units"), F.lit(int(UNIT))) / UNIT).alias("weight"), F.min("ord").alias("pos")
    )


def cluster_evidence(evidence: DataFrame) -> DataFrame:
    """Every member of a cluster has the largest weight of the cluster; input has candidate_id, term, weight, leader."""
    w = Window.partitionBy("candidate_id", "leader")
    return evidence.withColumn("cluster_weight", F.max("weight").over(w))


def domain_mentions(people: DataFrame, entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Domain terms of candidates: evidence, titles, highlights, summary and projects. A term comes as often as it is named."""
    out = evidence.select("candidate_id", "term")
    for df, terms in [
        (entries, tx.score_phrases("title", 5)),
        (entries, tx.score_phrases(F.array_join("highlights", "\n"), 10)),
        (people, tx.score_phrases("summary", 10)),
        (people, F.flatten(F.transform("projects", lambda p: tx.score_phrases(p, 8)))),
    ]:
        out = out.union(df.select("candidate_id", F.explode(terms).alias("term")))
    return out


def domain_terms(people: DataFrame, entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct domain terms per candidate."""
    return domain_mentions(people, entries, evidence).distinct()


def education_terms(entry: Column) -> Column:
    """Terms that an education entry stands for, with degree families spelled out."""

    def expand(e: Column) -> Column:
        degree, field, school = e["d"], e["f"], e["i"]
        has_field = field != ""
        bachelor = tx.contains_any(degree, fv.BACHELOR_MARKS)
        master = tx.contains_any(degree, fv.MASTER_MARKS)

        def terms(condition: Column, *values) -> Column:
            items = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
            return F.when(condition, items).otherwise(tx.strings([]))

        def with_field(word: str) -> Column:
            return F.concat(F.lit(word + " "), field)

        combined = tx.skill(F.concat_ws(" ", e["raw_d"], e["raw_f"], e["raw_i"]))
        parts = F.concat(
            tx.score_phrases(degree, 12, 8), tx.score_phrases(field, 12, 8), tx.score_phrases(school, 12, 8),
            terms((degree != "") & has_field, F.concat_ws(" ", degree, field)),
            tx.score_phrases(combined, 12, 10),
            terms(field.contains("cse"), "computer science", "computer science engineering"),
            terms(F.array_contains(F.split(field, " "), "ai") | field.contains("artificial intelligence"), "artificial intelligence"),
            terms(bachelor, *fv.BACHELOR_TERMS),
            terms(bachelor & has_field, with_field("b.tech"), with_field("bachelor")),
            terms(bachelor & field.contains("computer science"), "b.tech computer science", "bachelor computer science"),
            terms(master, *fv.MASTER_TERMS),
            terms(master & has_field, with_field("m.tech"), with_field("master")),
            terms(master & field.contains("artificial intelligence"), "m.tech artificial intelligence", "master artificial intelligence"),
        )
        return tx.normalised(parts)

    raw = {n: F.coalesce(entry[c], F.lit("")) for n, c in [("d", "degree"), ("f", "field_of_study"), ("i", "institution")]}
    return tx.let(
        F.struct(*[tx.skill(v).alias(n) for n, v in raw.items()], *[v.alias(f"raw_{n}") for n, v in raw.items()]), expand
    )
