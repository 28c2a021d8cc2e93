"""Raw rows to typed records: parsing, defaults, bounds, and merging of two extractions of the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx

JOB_LISTS = ["must_have_skills", "good_to_have_skills", "required_education", "required_certifications", "domain_keywords"]
CANDIDATE_TEXTS = ["name", "location", "summary", "linkedin", "portfolio"]
CANDIDATE_LISTS = ["skills", "tools", "certifications"]


def parse_model_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse JSON that came with fences, trailing commas or wrapped in a list (its first object counts).

    Rows that still do not parse keep their text and are marked ``corrupt``, for a quarantine table.
    """
    fixed = tx.repair_json(F.col(column))
    parsed = F.from_json(fixed, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("record", parsed).withColumn(
        "corrupt", F.col("record").isNull() | F.col("record._bad").isNotNull()
    )


def _terms(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return tx.strings([])
    return tx.normalised(tx.empty_if_null(name)) if kind.startswith("array") else tx.split_tokens(name)


def _lines(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return tx.strings([])
    return tx.clean_lines(tx.empty_if_null(name) if kind.startswith("array") else tx.lines_of(name))


def _text(df: DataFrame, name: str) -> Column:
    return tx.squash(name) if name in df.columns else F.lit("")


def _years(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(0.0)
    return tx.first_number(name) if kind == "string" else F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def validate_jobs(df: DataFrame, key: str = "job_id") -> DataFrame:
    """Every field present, typed and non-null; what breaks a bound is named in ``reject_reason``."""
    years = _years(df, "min_years_experience")
    return df.select(
        key, _text(df, "title").alias("title"), *[_terms(df, c).alias(c) for c in JOB_LISTS],
        _lines(df, "responsibilities").alias("responsibilities"),
        F.greatest(years, F.lit(0.0)).alias("min_years_experience"),
        (F.coalesce(F.col("archetype"), F.lit("standard")) if "archetype" in df.columns else F.lit("standard")).alias("archetype"),
        F.when(years < 0, "min_years_experience is below 0").otherwise("").alias("reject_reason"),
    )


def validate_candidates(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    years = _years(df, "total_years_experience")
    return df.select(
        key, *[_text(df, c).alias(c) for c in CANDIDATE_TEXTS],
        (tx.clean_email("email") if "email" in df.columns else F.lit("")).alias("email"),
        (tx.clean_phone("phone") if "phone" in df.columns else F.lit("")).alias("phone"),
        *[_terms(df, c).alias(c) for c in CANDIDATE_LISTS], _lines(df, "projects").alias("projects"),
        F.greatest(years, F.lit(0.0)).alias("total_years_experience"),
        F.when(years < 0, "total_years_experience is below 0").otherwise("").alias("reject_reason"),
    )


def is_empty(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == (F.lit("") if kind == "string" else F.lit(0).cast(kind)))


def fill_empty(primary: DataFrame, fallback: DataFrame, key: str, meaningful: list[str]) -> DataFrame:
    """Empty fields of the first extraction come from the second; a first one without any meaningful field is ignored."""
    kinds = dict(primary.dtypes)
    fields = [c for c in primary.columns if c != key]
    keep = F.lit(False)
    for c in meaningful:
        keep = keep | ~is_empty(F.col(f"a.{c}"), kinds[c])
    keep = F.coalesce(keep, F.lit(False))
    joined = primary.alias("a").join(fallback.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for c in fields:
        use_b = ~keep | is_empty(F.col(f"a.{c}"), kinds[c])
        out.append(F.when(use_b & F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    out.append(F.when(keep, "primary").otherwise("heuristic").alias("provenance"))
    return joined.select(*out)
