"""Merging stored documents with what was extracted from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx


def posting_text(title, skills, years, description):
    """A job posting as the text that extraction reads; lines without a value are left out."""
    value = lambda name, v: F.when(F.trim(v) != "", F.concat(F.lit(f"{name}: "), v))
    return F.concat_ws(
        "\n", value("Job title", tx.squash(title)),
        value("Required skills", F.array_join(F.filter(tx.empty_if_null(skills), lambda x: F.trim(x) != ""), ", ")),
        value("Minimum experience", F.concat(F.coalesce(F.col(years).cast("string"), F.lit("0")), F.lit(" years"))),
        value("Description", tx.squash(description)))


def merge_jobs(postings: DataFrame, extracted: DataFrame) -> DataFrame:
    """Explicit skills stay required, inferred ones become preferred, keywords unite, the description is the duty."""
    e = extracted.select("job_id", *[F.col(c).alias(f"x_{c}") for c in extracted.columns if c != "job_id"])
    j = postings.join(e, "job_id", "left")
    description = tx.squash("description")
    explicit = tx.normalised(tx.empty_if_null("skills"))
    found = lambda c: tx.empty_if_null(f"x_{c}")
    base_words = tx.extract_terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), description, F.array_join(tx.empty_if_null("skills"), " ")), 12)
    title_words = tx.extract_terms(F.concat_ws(" ", tx.squash("title"), description), 12)
    step = j.select(
        "job_id", tx.squash("title").alias("title"), explicit.alias("must"), base_words.alias("base_words"), title_words.alias("title_words"),
        F.array_except(tx.normalised(F.concat(found("must_have_skills"), found("good_to_have_skills"), found("domain_keywords"))), explicit).alias("inferred"),
        F.col("x_title").isNotNull().alias("has_x"), found("domain_keywords").alias("x_domain"),
        tx.normalised(found("required_education")).alias("required_education"),
        (tx.normalised(found("required_certifications")) if "x_required_certifications" in j.columns else tx.strings([])).alias("required_certifications"),
        F.when(description != "", F.array(description)).otherwise(found("responsibilities")).alias("responsibilities"),
        F.coalesce(F.col("min_years_experience").cast("double"), F.lit(0.0)).alias("min_years_experience"),
        F.coalesce(F.when(F.col("x_archetype") != "", F.col("x_archetype")), F.lit("standard")).alias("archetype"),
    )
    return step.select(
        "job_id", "title", F.col("must").alias("must_have_skills"), F.col("inferred").alias("good_to_have_skills"),
        F.when(F.col("has_x"), tx.normalised(F.concat("base_words", "x_domain", "inferred", "title_words"))).otherwise(F.col("base_words")).alias("domain_keywords"),
        "required_education", "required_certifications", "responsibilities", "min_years_experience", "archetype",
    )


def merge_candidates(profiles: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed fields first, the profile fills empty ones; skills unite; years are the largest of all sources.

    The phone is the parsed one, else the profile's contact, else its phone. Every other parsed field stays as it is, and
    metadata keeps what was parsed beside the candidate's id and own skills.
    """
    p = parsed.select("candidate_id", *[F.col(c).alias(f"x_{c}") for c in parsed.columns if c != "candidate_id"])
    j = profiles.join(p, "candidate_id", "left")

    def filled(name: str):
        return F.coalesce(F.when(F.col(f"x_{name}") != "", F.col(f"x_{name}")), F.col(name), F.lit(""))

    def first(*names: str):
        there = [F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", F.col(n).cast("string")) for n in names if n in j.columns]
        return F.coalesce(*there, F.lit(""))

    own = tx.normalised(tx.empty_if_null("skills"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    metadata = F.map_concat(
        F.create_map(F.lit("candidateId"), F.col("candidate_id").cast("string")),
        F.when(F.size(own) > 0, F.create_map(F.lit("profileSkills"), F.array_join(own, ", "))).otherwise(F.create_map().cast("map<string,string>")),
    )
    if "x_metadata" in j.columns:
        parsed_only = F.map_filter(F.coalesce("x_metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("candidateId", "profileSkills"))
        kept = F.coalesce(F.map_filter("x_metadata", lambda k, v: (k == "profileSkills") & (F.size(own) == 0)), F.create_map().cast("map<string,string>"))
        metadata = F.map_concat(parsed_only, kept, metadata)
    named = {"name", "email", "phone", "location", "skills", "computed_years", "stated_years", "metadata"}
    others = [F.col(c).alias(c[2:]) for c in j.columns if c.startswith("x_") and c[2:] not in named]
    return j.select(
        "candidate_id", filled("name").alias("name"), filled("email").alias("email"), first("x_phone", "contact", "phone").alias("phone"),
        filled("location").alias("location"), *others,
        tx.normalised(F.concat(tx.empty_if_null("x_skills"), own)).alias("skills"),
        F.greatest(number("x_computed_years"), number("x_stated_years"), number("stated_years")).alias("total_years_experience"),
        metadata.alias("metadata"),
    )
