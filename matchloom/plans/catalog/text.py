"""Text and list functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx
from matchloom.plans import sqltext as s
from matchloom.plans.registry import query
from matchloom.sources import views
from matchloom.sources.tables import table
from matchloom.operators import records


def documents(spark, sf):
    return table(spark, sf, "documents")


@query("norm_ws", f"SELECT doc_id, {s.squash('text')} AS text FROM documents")
def norm_ws(spark, sf):
    return documents(spark, sf).select("doc_id", tx.squash("text").alias("text"))


@query("norm_skill", f"SELECT doc_id, {s.skill('text')} AS term FROM documents")
def norm_skill(spark, sf):
    return documents(spark, sf).select("doc_id", tx.skill("text").alias("term"))


@query("split_tokens", f"""SELECT doc_id, {s.uniq('raw')} AS terms FROM (
  SELECT doc_id, list_transform({s.split_list('text')}, lambda v: {s.skill('v')}) AS raw FROM documents)""")
def split_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", tx.split_tokens("text").alias("terms"))


@query("canonical_skill", s.with_(s.H_RESUME) + f"""SELECT doc_id, list_transform({s.split_list('text')}, lambda v: {s.canonical('v')}) AS terms FROM h_resume""")
def canonical_skill(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.canonical_terms(tx.listed("text")).alias("terms"))


@query("token_set", f"""SELECT doc_id, {s.uniq('raw')} AS tokens FROM (
  SELECT doc_id, regexp_extract_all({s.canonical('text')}, '[a-z0-9+#./]+') AS raw FROM documents)""")
def token_set(spark, sf):
    return documents(spark, sf).select("doc_id", tx.token_set("text").alias("tokens"))


@query("phrases_extract", s.with_(s.H_RESUME) + f"""SELECT a.doc_id, a.phrases, b.skills FROM (
  {s.phrases('h_resume', 'doc_id', 'text', 16, 6, False)}) a JOIN ({s.phrases('h_resume', 'doc_id', 'text', 16, 5, False, 'skills')}) b USING (doc_id)""")
def phrases_extract(spark, sf):
    both = tx.let(tx.distinct_terms(tx.listed("text")), lambda t: F.struct(
        tx.short_terms(t).alias("phrases"), tx.short_terms(t, 16, 5).alias("skills")))
    return views.resume_text(spark, sf).select("doc_id", both.alias("p")).select("doc_id", "p.*")


@query("phrases_score", s.with_(s.H_RESUME) + s.phrases('h_resume', 'doc_id', 'text', 15, 4, True))
def phrases_score(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.score_phrases("text").alias("phrases"))


_role = r"regexp_replace({x}, '\bfullstack\b', 'full stack', 'g')"
_keep = "list_filter({c}, lambda x, i: NOT " + s.inside("x", fv.NON_SKILL_PHRASES + fv.SCORING_NOISE) + ")"


@query("sanitize_terms", s.with_(s.H_JOB_TEXT) + f"""SELECT item_id, {_keep.format(c=s.uniq('a'))}[:16] AS extraction, {_keep.format(c=s.uniq('b'))} AS scoring FROM (
  SELECT item_id, list_transform(parts, lambda v: {s.squash(_role.format(x=s.skill('v')))}) AS a,
    list_transform(parts, lambda v: {s.skill(_role.format(x=s.skill('v')))}) AS b
  FROM (SELECT item_id, {s.split_list('text')} AS parts FROM h_job_text))""")
def sanitize_terms(spark, sf):
    parts = tx.split_list("text")
    return views.job_text(spark, sf).select(
        "item_id", tx.sanitise_terms(parts, 16, renormalise=False).alias("extraction"),
        tx.sanitise_terms(parts).alias("scoring"),
    )


@query("normalize_set", s.with_(s.H_RESUME) + f"""SELECT doc_id, list_sort(list_filter({s.uniq('raw')}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)})) AS terms FROM (
  SELECT doc_id, list_transform({s.split_list('text')}, lambda v: {s.canonical('v')}) AS raw FROM h_resume)""")
def normalize_set(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.sorted_terms(tx.canonical_terms(tx.listed("text"))).alias("terms"))


@query("skill_like_filter", s.with_(s.H_CANDIDATES) + f"""SELECT candidate_id, list_filter({s.uniq('raw')}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)}
   AND NOT ({s.n_words('x')} >= 2 AND {s.inside("string_split(x, ' ')[-1]", fv.PROJECT_TAIL_TOKENS)})) AS terms FROM (
  SELECT candidate_id, list_transform(list_concat(tools, string_split_regex(array_to_string(projects, ','), ',')), lambda v: {s.canonical('v')}) AS raw FROM h_candidates)""")
def skill_like_filter(spark, sf):
    values = F.concat("tools", F.split(F.array_join("projects", ","), ","))
    return views.candidates(spark, sf).select("candidate_id", tx.skill_like(values).alias("terms"))


KEYWORDS_SQL = f"""SELECT job_id, list_sort(list_filter({s.uniq('raw')}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)})) AS keywords FROM (
  SELECT job_id, list_transform(list_concat(
    list_filter(regexp_extract_all(lower(title), '[a-z0-9+#]{{3,}}'), lambda x: NOT {s.inside('x', fv.STOPWORDS)}),
    list_filter(regexp_extract_all(lower(array_to_string(responsibilities, ' ')), '[a-z0-9+#]{{4,}}'), lambda x: NOT {s.inside('x', fv.STOPWORDS)}),
    domain_keywords), lambda v: {s.canonical('v')}) AS raw FROM h_jobs)"""


@query("keyword_set", s.with_(s.H_JOBS) + KEYWORDS_SQL)
def keyword_set(spark, sf):
    return views.jobs(spark, sf).select(
        "job_id", tx.keyword_set(F.col("title"), F.col("responsibilities"), F.col("domain_keywords")).alias("keywords")
    )


@query("extract_terms", f"""SELECT doc_id, list_filter({s.uniq('raw')}, lambda x: NOT {s.inside('x', fv.TERM_STOPWORDS)})[:30] AS terms FROM (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9+#.]{{2,}}'), lambda v: {s.skill('v')}) AS raw FROM documents)""")
def extract_terms(spark, sf):
    return documents(spark, sf).select("doc_id", tx.extract_terms("text").alias("terms"))


def _strip(x):
    return f"regexp_replace({x}, {s.rx('^' + s.WS + '+|' + s.WS + '+$')}, '', 'g')"


_junk = r"'^[\-|\]\[()''`]+'"


@query("clean_text", f"""SELECT page_id, array_to_string(list_filter(list_transform({s.lines('t')}, lambda x: {_strip(f"regexp_replace(x, {_junk}, '')")}), lambda x: x <> ''), chr(10)) AS text FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
    {s.rx(s.WS + '+([,.;:])')}, '\\1', 'g') AS t FROM pages)""")
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_scan_text("html").alias("text"))


@query("compact_text", f"""SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substring(t, 1, 237), ' ,.;:') || '...' END AS text FROM (
  SELECT doc_id, {s.squash('text')} AS t FROM documents)""")
def compact_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.compact("text").alias("text"))


@query("scrub_pii", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\p{L}\p{N}\p{M}_][\p{L}\p{N}\p{M}_.%+\-]*@[\p{L}\p{N}\p{M}_.\-]+\.[a-zA-Z]{2,}\b', '[EMAIL]', 'g'),
  '(?:\+?[0-9][0-9\s\-\(\)]{8,14}[0-9])', '[PHONE]', 'g') AS text FROM documents""")
def scrub_pii(spark, sf):
    return documents(spark, sf).select("doc_id", tx.scrub_pii("text").alias("text"))


@query("contact_clean", s.with_(s.H_RESUME) + f"""SELECT doc_id, regexp_extract(lower({s.squash('text')}), {s.rx(fv.EMAIL)}) AS email,
  regexp_replace(regexp_replace(regexp_extract({s.squash('text')}, {s.rx(fv.PHONE)}), '[^0-9+]', '', 'g'), '^\\+\\+', '+') AS phone FROM h_resume""")
def contact_clean(spark, sf):
    return views.resume_text(spark, sf).select(
        "doc_id", tx.clean_email("text").alias("email"), tx.clean_phone("text").alias("phone")
    )


@query("first_number", s.with_(s.H_RESUME) + f"""SELECT doc_id, coalesce(try_cast(regexp_extract(text, {s.rx(fv.NUMBER)}, 1) AS DOUBLE), 0.0::DOUBLE) AS number FROM h_resume""")
def first_number(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.first_number("text").alias("number"))


@query("clean_lines", f"""SELECT doc_id, list_filter(list_transform({s.lines('text')}, lambda x: {s.squash('x')}), lambda x: x <> '') AS lines FROM documents""")
def clean_lines(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_lines(tx.lines_of("text")).alias("lines"))


_bullet = s.rx(r"^(?:[\-*\x{2022}]|" + s.WS + ")+")


@query("project_lines", s.with_(s.H_RESUME) + f"""SELECT doc_id, list_filter(l, lambda x, i: list_position(k, lower(x)) = i)[:5] AS projects FROM (
  SELECT doc_id, l, list_transform(l, lambda x: lower(x)) AS k FROM (
    SELECT doc_id, list_filter(list_transform({s.lines('text')}, lambda x: {s.squash(f"regexp_replace(x, {_bullet}, '')")}), lambda x: x <> '') AS l FROM h_resume))""")
def project_lines(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.project_lines(tx.lines_of("text")).alias("projects"))


_unfence = ("regexp_replace(trim(regexp_replace(trim(raw), '^```(?:json)?\\s*\\n?', '')), '\\n?```\\s*$', '')")
REPAIR_SQL = f"""SELECT event_id, try_cast(json_extract_string(body, '$.k') AS BIGINT) AS k, NOT json_valid(body) AS corrupt FROM (
  SELECT event_id, regexp_replace(regexp_extract({_unfence}, '(?s)\\{{.*\\}}'), ',(\\s*[}}\\]])', '\\1', 'g') AS body FROM h_model)"""


@query("repair_json", s.with_(s.H_MODEL) + REPAIR_SQL)
def repair_json(spark, sf):
    parsed = records.parse_model_json(views.model_output(spark, sf), "raw", "k BIGINT")
    return parsed.select("event_id", F.col("record.k").alias("k"), "corrupt")


@query("as_list", s.with_(s.H_JOBS) + f"""SELECT job_id, {s.uniq('a')} AS skills, {s.uniq('b')} AS title_list FROM (
  SELECT job_id, list_transform(list_concat(must_have_skills, good_to_have_skills), lambda v: {s.skill('v')}) AS a, [{s.skill('title')}] AS b FROM h_jobs)""")
def as_list(spark, sf):
    return views.jobs(spark, sf).select(
        "job_id", tx.normalised(F.concat(tx.empty_if_null("must_have_skills"), tx.empty_if_null("good_to_have_skills"))).alias("skills"),
        tx.normalised(F.array("title")).alias("title_list"),
    )


@query("feedback_redact", r"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN note ELSE
  regexp_replace(regexp_replace(note, '\bcritical missing skills?\b', 'missing required skills', 'gi'), '\bcritical skill gaps?\b', 'skill gaps', 'gi') END AS note FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'Critical missing skills: ' ELSE 'Some CRITICAL skill gap in ' END || o_orderpriority AS note FROM orders)""")
def feedback_redact(spark, sf):
    note = F.concat(
        F.when(F.col("o_totalprice") > 100000, "Critical missing skills: ").otherwise("Some CRITICAL skill gap in "),
        F.col("o_orderpriority"),
    )
    critical = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("sql"))).otherwise(tx.strings([]))
    return table(spark, sf, "orders").select("o_orderkey", tx.redact_critical(note, critical).alias("note"))


@query("half_even", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS points,
  round_even(l_quantity / 8, 2) AS ratio FROM lineitem""")
def half_even(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.half_even(F.col("l_quantity") / 2).cast("bigint").alias("points"),
        tx.half_even(F.col("l_quantity") / 8, 2).alias("ratio"),
    )


@query("validate_job", f"""SELECT p_partkey AS job_id, {s.squash('title')} AS title, {s.uniq('sk')} AS must_have_skills,
  coalesce(try_cast(regexp_extract(years, {s.rx(fv.NUMBER)}, 1) AS DOUBLE), 0.0::DOUBLE) AS min_years_experience,
  CASE WHEN title = '' THEN 'title is empty' ELSE '' END AS reject_reason, 'standard' AS archetype FROM (
  SELECT p_partkey, ' ' || p_brand || '  ' || p_type AS title, p_size || '+ years' AS years,
    list_transform({s.split_list("p_name || ', ' || p_type || ' / ' || p_brand || ';' || upper(p_name)")}, lambda v: {s.skill('v')}) AS sk FROM part)""")
def validate_job(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("job_id"), F.concat(F.lit(" "), F.col("p_brand"), F.lit("  "), F.col("p_type")).alias("title"),
        F.concat("p_name", F.lit(", "), "p_type", F.lit(" / "), "p_brand", F.lit(";"), F.upper("p_name")).alias("must_have_skills"),
        F.concat(F.col("p_size").cast("string"), F.lit("+ years")).alias("min_years_experience"),
    )
    return records.validate_jobs(raw).select(
        "job_id", "title", "must_have_skills", "min_years_experience", "reject_reason", "archetype"
    )


@query("validate_candidate", f"""SELECT c_custkey AS candidate_id, {s.squash('c_name')} AS name,
  regexp_extract(lower({s.squash('mail')}), {s.rx(fv.EMAIL)}) AS email,
  regexp_replace(regexp_replace(regexp_extract({s.squash('tel')}, {s.rx(fv.PHONE)}), '[^0-9+]', '', 'g'), '^\\+\\+', '+') AS phone,
  {s.uniq('sk')} AS skills, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS total_years_experience,
  CASE WHEN c_acctbal < 0 THEN 'total_years_experience is below 0' ELSE '' END AS reject_reason FROM (
  SELECT c_custkey, c_name, c_acctbal, 'Mail: ' || replace(c_name, '#', '.') || '@Example.COM now' AS mail, 'tel ++49 30 ' || (10000000 + c_custkey) AS tel,
    list_transform({s.split_list("c_mktsegment || ', ' || lower(c_mktsegment) || '; c++ / c# | .net'")}, lambda v: {s.skill('v')}) AS sk FROM customer)""")
def validate_candidate(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("Mail: "), F.regexp_replace("c_name", "#", "."), F.lit("@Example.COM now")).alias("email"),
        F.concat(F.lit("tel ++49 30 "), (F.lit(10000000) + F.col("c_custkey")).cast("string")).alias("phone"),
        F.concat("c_mktsegment", F.lit(", "), F.lower("c_mktsegment"), F.lit("; c++ / c# | .net")).alias("skills"),
        F.col("c_acctbal").alias("total_years_experience"),
    )
    return records.validate_candidates(raw).select(
        "candidate_id", "name", "email", "phone", "skills", "total_years_experience", "reject_reason"
    )
