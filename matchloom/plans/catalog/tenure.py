"""Dates, tenure, order of entries, seniority."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT
from matchloom.functions import dates
from matchloom.operators import tenure as tn
from matchloom.plans import sqltext as s
from matchloom.plans.registry import query
from matchloom.sources import views
from matchloom.sources.tables import table

AS_OF = DEFAULT.as_of_index

_th = "CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END"
SHAPES_SQL = f"""CASE o_orderkey % 6 WHEN 0 THEN 'since ' || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y %B')
  WHEN 3 THEN strftime(o_orderdate, '%B ') || day(o_orderdate) || {_th} || strftime(o_orderdate, ', %Y') WHEN 4 THEN strftime(o_orderdate, '%b ') || chr(39) || strftime(o_orderdate, '%y')
  ELSE strftime(o_orderdate, 'joined in %B %Y as lead') END"""
RAW_DATES_SQL = f"""raw AS (SELECT o_orderkey, o_orderdate AS d, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN o_orderkey % 6 ELSE 0 END AS shape, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%b %Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%m/%Y') WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'O' THEN ' current ' ELSE strftime(o_orderdate, '%d %B %Y') END
  ELSE CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y') WHEN 'F' THEN {SHAPES_SQL} ELSE '' END END AS raw FROM orders)"""
_mon = "CASE lower(substring(m, 1, 3)) " + " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(fv.MONTHS)) + " END"
PARSED_SQL = f"""parsed AS (SELECT o_orderkey, CASE WHEN shape > 1 OR (shape = 1 AND day(d) > 12) THEN strftime(d, '%Y-%m') WHEN shape = 1 THEN strftime(d, '%Y-%d') WHEN t = '' THEN '' WHEN lower(t) IN ('present', 'current', 'now', 'ongoing') THEN 'Present' WHEN regexp_matches(t, '^[0-9]{{4}}$') THEN t
  WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN substring(t, 1, 7) WHEN regexp_matches(t, '^[0-9]{{2}}/[0-9]{{4}}$') THEN substring(t, 4, 4) || '-' || substring(t, 1, 2)
  WHEN regexp_matches(t, '^[A-Za-z]+ [0-9]{{4}}$') AND {_mon} IS NOT NULL THEN right(t, 4) || '-' || {_mon}
  WHEN regexp_matches(t, '^[0-9]+ [A-Za-z]+ [0-9]{{4}}$') THEN right(t, 4) || '-' || {_mon} ELSE t END AS parsed
  FROM (SELECT o_orderkey, d, shape, trim(raw) AS t, regexp_extract(raw, '[A-Za-z]{{3,}}') AS m FROM raw))"""


def shapes(d):
    """Dates as people also write them: day first, year first, ordinals, short years, inside a sentence."""
    n, day = F.col("o_orderkey") % 6, F.dayofmonth(d)
    th = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    month = F.date_format(d, "MMMM")
    return (
        F.when(n == 0, F.concat(F.lit("since "), F.col("o_orderkey").cast("string"))).when(n == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(n == 2, F.date_format(d, "yyyy MMMM"))
        .when(n == 3, F.concat(month, F.lit(" "), day.cast("string"), th, F.lit(", "), F.date_format(d, "yyyy")))
        .when(n == 4, F.concat(F.date_format(d, "MMM"), F.lit(" '"), F.date_format(d, "yy")))
        .otherwise(F.concat(F.lit("joined in "), month, F.lit(" "), F.date_format(d, "yyyy"), F.lit(" as lead"))))


def raw_dates(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "MMM yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "MM/yyyy"))
        .when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "O"), " current ")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "dd MMMM yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy"))
        .when(F.col("o_orderstatus") == "F", shapes(d))
        .otherwise("")
    )
    return o.select("o_orderkey", text.alias("raw"))


@query("parse_dates", s.with_(RAW_DATES_SQL, PARSED_SQL) + "SELECT * FROM parsed")
def parse_dates(spark, sf):
    return raw_dates(spark, sf).select("o_orderkey", dates.parse_date("raw").alias("parsed"))


@query("month_index", s.with_(RAW_DATES_SQL, PARSED_SQL) + f"""SELECT o_orderkey, CAST(CASE WHEN parsed = 'Present' THEN {AS_OF}
  WHEN regexp_matches(parsed, '^[0-9]{{4}}$') THEN CAST(parsed AS INT) * 12 + 1
  WHEN regexp_matches(parsed, '^[0-9]{{4}}-[0-9]{{2}}$') THEN CAST(substring(parsed, 1, 4) AS INT) * 12 + CAST(substring(parsed, 6, 2) AS INT) END AS INT) AS month_index FROM parsed""")
def month_index(spark, sf):
    return parse_dates(spark, sf).select("o_orderkey", dates.month_index("parsed", AS_OF).alias("month_index"))


RANGES_SQL = """ranges AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y') || ' - Present' WHEN 'F' THEN strftime(o_orderdate, '%Y-%m')
  ELSE strftime(o_orderdate, '%Y') END AS s, CASE WHEN o_orderpriority < '3' THEN '' ELSE strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m') END AS e FROM orders)"""


@query("split_ranges", s.with_(RANGES_SQL) + r"""SELECT o_orderkey,
  CASE WHEN p AND (e = '' OR e LIKE '%-%') THEN trim(string_split(s, '-')[1]) ELSE s END AS ref_start,
  CASE WHEN p AND e = '' THEN trim(substring(s, strpos(s, '-') + 1)) WHEN p AND e LIKE '%-%' THEN trim(string_split(e, '-')[-1]) ELSE e END AS ref_end,
  CASE WHEN p AND NOT iso AND e = '' THEN trim(string_split(s, '-')[1]) ELSE s END AS safe_start,
  CASE WHEN p AND NOT iso AND e = '' THEN trim(substring(s, strpos(s, '-') + 1)) ELSE e END AS safe_end
  FROM (SELECT *, s LIKE '%-%' AS p, regexp_matches(s, '^[0-9]{4}-[0-9]{2}$') AS iso FROM ranges)""")
def split_ranges(spark, sf):
    d = F.col("o_orderdate")
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.concat(F.date_format(d, "yyyy"), F.lit(" - Present")))
        .when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy")).alias("s"),
        F.when(F.col("o_orderpriority") < "3", "").otherwise(F.date_format(F.date_add(d, 400), "yyyy-MM")).alias("e"),
    )
    ref, safe = (dates.split_range(F.col("s"), F.col("e"), m) for m in ("reference", "safe"))
    return raw.select("o_orderkey", ref[0].alias("ref_start"), ref[1].alias("ref_end"), safe[0].alias("safe_start"), safe[1].alias("safe_end"))


def _mi(c):
    return f"(CASE WHEN {c} = 'Present' THEN {AS_OF} WHEN {c} <> '' THEN CAST(substring({c}, 1, 4) AS INT) * 12 + CAST(substring({c}, 6, 2) AS INT) END)"


_words = "regexp_extract_all(lower(title), '\\b[a-z]+\\b')"
H_ENTRIES = f"""h_tidy AS (SELECT candidate_id, pos, title, company, start_date, skills_used, highlights, {_mi('start_date')} AS start_index,
    CASE WHEN {_mi('end_date')} < {_mi('start_date')} THEN 'Present' ELSE end_date END AS end_date,
    CAST(CASE WHEN {_mi('end_date')} < {_mi('start_date')} THEN greatest({AS_OF} - {_mi('start_date')}, 0) ELSE coalesce(greatest({_mi('end_date')} - {_mi('start_date')}, 0), 0) END AS INT) AS duration_months
  FROM h_experience),
h_jobs_only AS (SELECT * FROM h_tidy WHERE
  len(list_filter(list_distinct({_words}), lambda w: {s.inside('w', fv.JOB_WORDS)})) >= 1
  AND len(list_filter(list_distinct({_words}), lambda w: {s.inside('w', fv.DEGREE_WORDS)})) = 0
  AND NOT (duration_months >= 36 AND (lower(title) LIKE '%student%' OR regexp_matches(lower(company), 'college|university|institute')))
  AND NOT (regexp_matches(lower(company), 'college|university|institute|school') AND lower(title) NOT LIKE '%intern%'))"""


def tidy_entries(spark, sf):
    return tn.tidy(views.experience(spark, sf))


def entries(spark, sf):
    return tn.employment(tidy_entries(spark, sf))


@query("duration_months", s.with_(s.H_EXPERIENCE, H_ENTRIES) + "SELECT pos, start_date, end_date, duration_months FROM h_tidy")
def duration_months(spark, sf):
    return tidy_entries(spark, sf).select("pos", "start_date", "end_date", "duration_months")


_weight = "CASE WHEN lower(title) LIKE '%intern%' THEN 0.5 WHEN lower(title) LIKE '%freelance%' OR lower(title) LIKE '%self-employed%' THEN 0.7 WHEN lower(title) LIKE '%contract%' THEN 0.8 ELSE 1.0 END"


@query("role_weight", s.with_(s.H_EXPERIENCE) + f"SELECT pos, CAST({_weight} AS DOUBLE) AS weight FROM h_experience")
def role_weight(spark, sf):
    return views.experience(spark, sf).select("pos", dates.role_weight(F.col("title")).alias("weight"))


@query("drop_education_rows", s.with_(s.H_EXPERIENCE, H_ENTRIES) + "SELECT candidate_id, pos, title, company FROM h_jobs_only")
def drop_education_rows(spark, sf):
    return entries(spark, sf).select("candidate_id", "pos", "title", "company")


H_YEARS = f"""h_tenure AS (SELECT candidate_id, count(*) AS n_entries, sum(CAST(duration_months * CAST(({_weight}) * 10 AS INT) AS BIGINT)) AS tenths FROM h_jobs_only GROUP BY 1),
h_years AS (SELECT candidate_id, CASE WHEN n_entries IS NULL THEN 0.0::DOUBLE WHEN calc > 0 AND (calc >= stated_years OR stated_years = 0) THEN calc ELSE stated_years END AS years,
    greatest(coalesce(calc, 0), stated_years) AS largest
  FROM (SELECT c.candidate_id, c.stated_years, n_entries, round_even(CAST(tenths AS DOUBLE) / 12, 0) / 10 AS calc FROM h_candidates c LEFT JOIN h_tenure USING (candidate_id)))"""


def years_table(spark, sf):
    people = views.candidates(spark, sf).select("candidate_id", "stated_years")
    t = tn.tenure(entries(spark, sf))
    parts = F.col("weighted_tenths"), F.col("n_entries"), F.col("stated_years")
    return people.join(t, "candidate_id", "left").select(
        "candidate_id", tn.years(*parts).alias("years"), tn.years(*parts, policy="largest").alias("largest")
    )


@query("tenure_years", s.with_(s.H_CANDIDATES, s.H_EXPERIENCE, H_ENTRIES, H_YEARS) + "SELECT * FROM h_years")
def tenure_years(spark, sf):
    return years_table(spark, sf)


H_ORDER = """h_order AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(start_index, 999999), pos) AS order_no,
  row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(start_index, 999999) DESC, pos DESC) - 1 AS recency FROM h_jobs_only)"""


@query("experience_order", s.with_(s.H_EXPERIENCE, H_ENTRIES, H_ORDER) + "SELECT candidate_id, pos, order_no FROM h_order")
def experience_order(spark, sf):
    return tn.ordered(entries(spark, sf)).select("candidate_id", "pos", "order_no")


@query("recency_rank", s.with_(s.H_EXPERIENCE, H_ENTRIES, H_ORDER) + "SELECT candidate_id, pos, recency FROM h_order")
def recency_rank(spark, sf):
    return tn.ordered(entries(spark, sf)).select("candidate_id", "pos", "recency")


def seniority_sql(x: str) -> str:
    terms = ", ".join(f"CASE WHEN contains({x}, '{k}') THEN {v} ELSE 0 END" for k, v in fv.SENIORITY_LEVELS.items())
    return f"greatest({terms})"


@query("seniority_level", s.with_(s.H_JOBS, s.H_EXPERIENCE) + f"""SELECT 'entry ' || pos AS id, {seniority_sql('t')} AS level FROM (SELECT pos, {s.skill('title')} AS t FROM h_experience)
  UNION ALL SELECT 'job ' || job_id, {seniority_sql('t')} FROM (SELECT job_id, {s.skill("title || ' ' || array_to_string(responsibilities, ' ')")} AS t FROM h_jobs)""")
def seniority_level(spark, sf):
    e = views.experience(spark, sf).select(F.concat(F.lit("entry "), F.col("pos").cast("string")).alias("id"), "title")
    j = views.jobs(spark, sf).select(
        F.concat(F.lit("job "), "job_id").alias("id"), F.concat_ws(" ", "title", F.array_join("responsibilities", " ")).alias("title")
    )
    return e.union(j).select("id", tn.seniority(F.col("title")).alias("level"))


H_GROWTH = f"""h_levels AS (SELECT candidate_id, order_no, level, lag(level) OVER (PARTITION BY candidate_id ORDER BY order_no) AS previous FROM (
    SELECT candidate_id, order_no, {seniority_sql(s.skill('title'))} AS level FROM h_order) WHERE level > 0),
h_growth AS (SELECT candidate_id, max(level) AS peak_level, CASE WHEN count(*) = 1 THEN least(greatest(0.4::DOUBLE + (min(level) / 5.0::DOUBLE) * 0.6::DOUBLE, 0), 1)
    ELSE least(greatest(0.65::DOUBLE * (sum(CASE WHEN level >= previous THEN 1 ELSE 0 END)::DOUBLE / (count(*) - 1))
      + 0.35::DOUBLE * (greatest(arg_max(level, order_no) - arg_min(level, order_no), 0) / 5.0::DOUBLE), 0), 1) END AS growth
  FROM h_levels GROUP BY candidate_id)"""


@query("progression", s.with_(s.H_EXPERIENCE, H_ENTRIES, H_ORDER, H_GROWTH) + "SELECT * FROM h_growth")
def progression(spark, sf):
    return tn.progression(entries(spark, sf))


H_INTERN = f"""h_intern AS (SELECT candidate_id, avg(CASE WHEN regexp_matches(t, '{fv.INTERN_TITLE}') THEN 1.0 ELSE 0.0 END) >= 0.5 AS intern_dominant
  FROM (SELECT candidate_id, {s.skill('title')} AS t FROM h_jobs_only) WHERE t <> '' GROUP BY 1)"""


@query("intern_dominant", s.with_(s.H_EXPERIENCE, H_ENTRIES, H_INTERN) + "SELECT * FROM h_intern")
def intern_dominant(spark, sf):
    return tn.intern_share(entries(spark, sf))
