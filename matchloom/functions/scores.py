"""Score arithmetic as column expressions; every rounding to whole points is half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT, MatchConfig
from matchloom.functions.text import clamp, half_even, let

PARTS = ["skills", "experience", "education", "keyword", "completeness"]


def points(c: Column) -> Column:
    return half_even(c).cast("int")


def budgets(archetype: Column) -> Column:
    """struct of five budgets; the first archetype word that occurs decides."""

    def row(values) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(PARTS, values)])

    name, out = F.lower(F.coalesce(archetype, F.lit(""))), None
    for word, values in fv.BUDGETS.items():
        out = F.when(name.contains(word), row(values)) if out is None else out.when(name.contains(word), row(values))
    return out.otherwise(row(fv.DEFAULT_BUDGET))


def skill_ratio(req_credit: Column, n_req: Column, pref_credit: Column, n_pref: Column) -> Column:
    breadth = clamp(n_req / fv.BREADTH_MIN_SKILLS, fv.BREADTH_FLOOR, 1.0)
    req = F.when(n_req > 0, F.sqrt(req_credit / n_req) * breadth)
    pref = F.when(n_pref > 0, F.sqrt(pref_credit / n_pref))
    return (
        F.when((n_req > 0) & (n_pref > 0), clamp((3 * req + pref) / 4, 0.0, 1.0))
        .when(n_req > 0, clamp(req, 0.0, 1.0))
        .when(n_pref > 0, clamp(pref, 0.0, 1.0))
        .otherwise(1.0)
    )


def skills_score(budget: Column, ratio: Column, n_req: Column, match_ratio: Column) -> Column:
    base = points(budget * ratio)
    return (
        F.when((n_req > 0) & (match_ratio == 0), F.least(base, points(budget * 0.15)))
        .when((n_req > 0) & (match_ratio < 0.34), F.least(base, points(budget * 0.30)))
        .otherwise(base)
    )


def bonus_caps(ratio: Column, cfg: MatchConfig = DEFAULT) -> tuple[Column, Column]:
    """(cap of the additional-skill bonus, cap of the domain bonus) by the share of matched required skills."""
    def cap(base: int, none: int, few: int, some: int) -> Column:
        return (
            F.when(ratio <= 0, min(base, none)).when(ratio < 0.34, min(base, few)).when(ratio < 0.67, min(base, some))
            .otherwise(max(base, 0))
        )

    return cap(cfg.additional_bonus_max, 2, 4, 6), cap(cfg.domain_bonus_max, 1, 2, 3)


def years_fit(years: Column, minimum: Column) -> Column:
    return F.when(minimum > 0, clamp(years / minimum, 0.0, 1.0)).otherwise(clamp(years / 2.0, 0.0, 1.0))


def seniority_fit(peak: Column, target: Column) -> Column:
    return (
        F.when(target > 0, clamp(peak / target, 0.0, 1.0)).when(peak > 0, clamp(peak / 4, 0.0, 1.0)).otherwise(0.0)
    )


def experience_score(
    budget: Column, years: Column, y_fit: Column, s_fit: Column, growth: Column, domain: Column, interns: Column,
    match_ratio: Column,
) -> Column:
    ratio = clamp(0.40 * y_fit + 0.25 * s_fit + 0.15 * growth + 0.20 * domain, 0.0, 1.0)
    ratio = F.when(years < 1.0, F.least(ratio, F.lit(0.35))).otherwise(ratio)
    score = points(budget * ratio)
    capped = F.when(interns & (match_ratio < 0.5), F.least(score, points(budget * 0.25))).otherwise(score)
    return F.when(years == 0, 0).otherwise(capped)


def completeness(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total / len(flags)


def total_score(base: Column, n_req: Column, n_matched: Column, n_critical: Column, bonus: Column) -> Column:
    capped = F.when((n_req > 0) & (n_matched == 0), F.least(base, F.lit(40))).when(n_critical > 0, F.least(base, F.lit(65))).otherwise(base)
    return F.least(capped + bonus, F.lit(100))


def confidence(ratio: Column, complete: Column, n_clusters: Column, proof: Column, n_additional: Column, domain: Column) -> Column:
    value = (
        0.30 * ratio + 0.25 * complete + 0.15 * F.least(n_clusters / 12, F.lit(1.0)) + 0.15 * proof
        + 0.10 * F.least(n_additional / 5, F.lit(1.0)) + 0.05 * domain
    )
    return points(clamp(value * 100, 0.0, 100.0))


def risk(n_critical: Column, n_req: Column, n_matched: Column, gap: Column, complete: Column, domain: Column) -> Column:
    value = (
        F.least(n_critical * 20, F.lit(60)) + F.when((n_req > 0) & (n_matched == 0), 40).otherwise(0)
        + F.least(gap * 8, F.lit(25.0)) + F.when(complete < 0.5, 15).otherwise(0) + F.when(domain < 0.5, 10).otherwise(0)
    )
    return points(clamp(value, 0.0, 100.0))


def percent(value: Column, budget: Column) -> Column:
    """Share of the budget in whole percent, 0 when there is no budget."""
    return F.when(F.coalesce(budget, F.lit(0)) == 0, 0).otherwise(points(clamp(value / budget, 0.0, 1.0) * 100))


def decision(total: Column, threshold: int = DEFAULT.shortlist) -> Column:
    return F.when(total >= threshold, "SHORTLISTED").otherwise("REJECTED")


def fit_band(total: Column, risk_score: Column) -> Column:
    return (
        F.when((total >= 80) & (risk_score <= 45), "strong").when(total >= 60, "moderate").when(total >= 40, "partial")
        .otherwise("limited")
    )


def quantified(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in fv.IMPACT:
        hit = hit | text.rlike(pattern)
    return hit


def ownership_kind(text: Column, mode: str = "reference") -> Column:
    """'own', 'contribute' or '' by the first word. ``reference`` strips trailing e, d and punctuation first."""
    first = F.get(F.split(F.lower(F.trim(text)), r"\s+", 2), F.lit(0))
    if mode == "words":
        return F.when(first.isin(fv.OWNERSHIP_VERBS), "own").when(first.isin(fv.CONTRIBUTOR_VERBS), "contribute").otherwise("")

    def starts(word: Column, verbs) -> Column:
        hit = F.lit(False)
        for verb in verbs:
            hit = hit | word.startswith(verb)
        return hit

    return let(F.rtrim(first, F.lit("ed,.:;")), lambda word: (
        F.when(starts(word, fv.OWNERSHIP_VERBS), "own").when(starts(word, fv.CONTRIBUTOR_VERBS), "contribute").otherwise("")))
