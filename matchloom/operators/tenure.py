"""Experience entries (a long table, one row per entry): durations, tenure, order, seniority and progression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT, MatchConfig
from matchloom.functions import dates, text as tx
from matchloom.operators.ranking import position_in_group

UNKNOWN_MONTH = 999999  # entries without a readable start come last


def tidy(entries: DataFrame, cfg: MatchConfig = DEFAULT, mode: str = "safe") -> DataFrame:
    """Packed ranges split, dates parsed, inverted ranges closed at 'Present', duration in months.

    Dates recur far more often than they differ, so each distinct start, end and duration is parsed once and joined back.
    """
    given = F.col("duration_months") if "duration_months" in entries.columns else F.lit(0)
    rest = [c for c in entries.columns if c not in ("start_date", "end_date", "duration_months")]
    rows = entries.select(*rest, F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), given.alias("_m"))
    entry = dates.tidy_entry(F.col("_rs"), F.col("_re"), F.col("_rm"), cfg.as_of_index, mode).alias("_t")
    each = rows.select(F.col("_s").alias("_rs"), F.col("_e").alias("_re"), F.col("_m").alias("_rm")).distinct().select("_rs", "_re", "_rm", entry)
    same = F.col("_s").eqNullSafe(F.col("_rs")) & F.col("_e").eqNullSafe(F.col("_re")) & F.col("_m").eqNullSafe(F.col("_rm"))
    return rows.join(each, same).select(*rest, "_t.*")


def is_employment(title: Column, company: Column, months: Column) -> Column:
    """False for education that was listed as experience."""

    def judge(r: Column) -> Column:
        t, c, found = r["t"], r["c"], r["words"]
        student = F.arrays_overlap(found, tx.strings(["student", "undergraduate"]))
        degrees = F.size(F.array_intersect(found, tx.strings(fv.DEGREE_WORDS)))
        jobs = F.size(F.array_intersect(found, tx.strings(fv.JOB_WORDS)))
        campus = tx.contains_any(c, ["college", "university", "institute"])
        return (
            ~tx.contains_any(t, fv.DOTTED_DEGREES)
            & (degrees == 0)
            & (jobs >= 1)
            & (jobs > degrees + F.when(student, 2).otherwise(0))
            & ~((r["months"] >= 36) & (t.contains("student") | campus))
            & ~((campus | c.contains("school")) & ~t.contains("intern"))
        )

    t = F.lower(F.coalesce(title, F.lit("")))
    return tx.let(
        F.struct(
            t.alias("t"), F.lower(F.coalesce(company, F.lit(""))).alias("c"),
            F.array_distinct(tx.matches(t, r"\b[a-z]+\b")).alias("words"),
            F.coalesce(months, F.lit(0)).alias("months"),
        ),
        judge,
    )


def employment(entries: DataFrame) -> DataFrame:
    return entries.where(is_employment(F.col("title"), F.col("company"), F.col("duration_months")))


def years(weighted_tenths: Column, n_entries: Column, stated: Column, policy: str = "entries") -> Column:
    """Weighted years at one digit; the stated total wins only when larger.

    ``entries``: no entries means 0 whatever is stated. ``largest``: the larger of both, as the batch worker does.
    """
    calculated = F.coalesce(tx.half_even(weighted_tenths / 12) / 10, F.lit(0.0))
    stated = F.coalesce(stated, F.lit(0.0))
    if policy == "largest":
        return F.greatest(calculated, stated)
    use = (calculated > 0) & ((calculated >= stated) | (stated == 0))
    return F.when(F.coalesce(n_entries, F.lit(0)) == 0, 0.0).when(use, calculated).otherwise(stated)


def tenure(entries: DataFrame) -> DataFrame:
    """Per candidate: entry count and weighted months in tenths (whole numbers, so the sum has no rounding order)."""
    tenths = (F.col("duration_months") * F.round(dates.role_weight(F.col("title")) * 10)).cast("long")
    return entries.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(tenths).alias("weighted_tenths")
    )


def start_key(cfg: MatchConfig = DEFAULT) -> Column:
    return F.coalesce(dates.month_index("start_date", cfg.as_of_index), F.lit(UNKNOWN_MONTH))


def ordered(entries: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Adds order_no (oldest 1) and recency (newest 0); a candidate's entries are never sorted in one task."""
    buckets = [start_key(cfg), F.floor(F.col("pos") / cfg.rank_bucket)]
    ranked = position_in_group(entries, ["candidate_id"], buckets, [F.col("pos")], "order_no", "_total")
    return ranked.withColumn("recency", F.col("_total") - F.col("order_no")).drop("_total")


def seniority(title: Column) -> Column:
    """Highest level whose token occurs anywhere in the title (substring, also inside words)."""
    t = tx.skill(title)
    by_level: dict[int, list[str]] = {}
    for token, level in fv.SENIORITY_LEVELS.items():
        by_level.setdefault(level, []).append(token)
    out = F.lit(0)
    for level in sorted(by_level):
        out = F.when(tx.contains_any(t, by_level[level]), level).otherwise(out)
    return out


def progression_value(n: Column, rises: Column, first: Column, last: Column) -> Column:
    single = tx.clamp(F.lit(0.4) + (first / 5.0) * 0.6, 0.0, 1.0)
    many = tx.clamp(
        fv.NON_DECREASING_WEIGHT * (rises / (n - 1)) + fv.UPWARD_GAIN_WEIGHT * (F.greatest(last - first, F.lit(0)) / 5.0), 0.0, 1.0
    )
    return F.when(n == 1, single).when(n > 1, many).otherwise(0.0)


def progression(entries: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Per candidate: growth and peak level.

    Steps are counted inside (start month, position range) buckets first and between neighbouring buckets second, so
    no task ever holds more than one bucket of a candidate.
    """
    rows = entries.select(
        "candidate_id", "pos", seniority(F.col("title")).alias("level"), start_key(cfg).alias("_m"),
        F.floor(F.col("pos") / cfg.rank_bucket).alias("_p"),
    ).where("level > 0")
    inside = Window.partitionBy("candidate_id", "_m", "_p").orderBy("pos")
    steps = rows.withColumn("up", (F.col("level") >= F.lag("level").over(inside)).cast("int"))
    pieces = steps.groupBy("candidate_id", "_m", "_p").agg(
        F.min_by("level", "pos").alias("first"), F.max_by("level", "pos").alias("last"),
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("up"), F.lit(0)).alias("up"), F.max("level").alias("peak"),
    )
    between = Window.partitionBy("candidate_id").orderBy("_m", "_p")
    joined = pieces.withColumn("up", F.col("up") + F.coalesce((F.col("first") >= F.lag("last").over(between)).cast("int"), F.lit(0)))
    spot = F.struct("_m", "_p")
    whole = joined.groupBy("candidate_id").agg(
        F.sum("n").alias("n"), F.sum("up").alias("up"), F.min_by("first", spot).alias("first"),
        F.max_by("last", spot).alias("last"), F.max("peak").alias("peak_level"),
    )
    growth = progression_value(F.col("n"), F.col("up"), F.col("first"), F.col("last"))
    return whole.select("candidate_id", "peak_level", growth.alias("growth"))


def intern_share(entries: DataFrame) -> DataFrame:
    """Per candidate: are at least half of the titled entries internships?"""
    title = tx.skill("title")
    return entries.where(title != "").groupBy("candidate_id").agg(
        (F.avg(title.rlike(fv.INTERN_TITLE).cast("int")) >= 0.5).alias("intern_dominant")
    )
