"""Building blocks of the check SQL: the derived tables and the text rules, written for the SQL engine."""

from __future__ import annotations

from matchloom import fixed_values as fv
from matchloom.sources import views

WS = fv.WHITESPACE
LB = fv.LINE_BREAK


def words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def inside(x: str, values) -> str:
    return f"({x} IN (" + ", ".join("'" + v + "'" for v in values) + "))"


def case_map(x: str, mapping: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {rx(WS + '+')}, ' ', 'g'), ' ')"


def skill(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+#./]+', ' ', 'g'), ' .,:;')"


def alias(x: str) -> str:
    return case_map(x, fv.SKILL_ALIASES, x)


def canonical(x: str) -> str:
    s = skill(x)
    return case_map(s, fv.SKILL_ALIASES, s)


def split_list(x: str) -> str:
    return f"string_split_regex(coalesce({x}, ''), {rx(fv.LIST_SPLIT)})"


def lines(x: str) -> str:
    return f"string_split_regex(coalesce({x}, ''), {rx(LB)})"


def uniq(col: str) -> str:
    """Order-preserving distinct of a list column, blanks dropped."""
    return f"list_filter({col}, lambda x, i: x <> '' AND list_position({col}, x) = i)"


def n_words(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def phrases(source: str, key: str, text: str, limit: int, max_tokens: int, canon: bool, name: str = "phrases") -> str:
    fn = canonical if canon else skill
    return (
        f"SELECT {key}, list_filter({uniq('raw')}, lambda x: NOT {inside('x', fv.SCORING_NOISE)} "
        f"AND {n_words('x')} <= {max_tokens})[:{limit}] AS {name} "
        f"FROM (SELECT {key}, list_transform({split_list(text)}, lambda v: {fn('v')}) AS raw FROM {source})"
    )


JOB_ID = "p_brand || '|' || p_type"


def _set(value: str, condition: str) -> str:
    return f"coalesce(list_sort(list(DISTINCT {value}) FILTER ({condition})), [])"


H_JOBS = f"""h_jobs AS (
  SELECT {JOB_ID} AS job_id, {case_map('p_type', views.TITLES, "''")} AS title,
    {_set('p_name', 'p_size >= 40')} AS must_have_skills, {_set('p_name', 'p_size < 10')} AS good_to_have_skills,
    min(p_size) / 10 AS min_years_experience,
    CASE p_type WHEN 'LARGE' THEN ['b.tech computer science', 'phd'] WHEN 'SMALL' THEN ['master'] WHEN 'MEDIUM' THEN ['engineering'] ELSE [] END AS required_education,
    {_set('p_name', 'p_size = 12')} AS required_certifications,
    {_set("string_split(p_name, ' ')[-1]", 'p_size BETWEEN 20 AND 24')} AS domain_keywords,
    {_set("'Own ' || p_name || '; mentor team'", 'p_size BETWEEN 30 AND 31')} AS responsibilities,
    {case_map('p_type', views.ARCHETYPES, "'standard'")} AS archetype
  FROM part GROUP BY p_brand, p_type)"""

H_CANDIDATES = f"""h_bought AS (
  SELECT o_custkey, p_name, l_returnflag, l_quantity, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
h_lists AS (
  SELECT o_custkey, {_set('p_name', 'true')} AS skills, {_set("string_split(p_name, ' ')[-1]", 'true')} AS tools,
    {_set('p_name', "l_returnflag = 'R' AND l_quantity >= 49")} AS certifications,
    {_set("p_name || ' portal, ' || string_split(p_name, ' ')[-1] || ' rollout'", 'l_discount >= 0.1')} AS projects
  FROM h_bought GROUP BY o_custkey),
h_candidates AS (
  SELECT c_custkey AS candidate_id, c_name AS name,
    CASE WHEN c_acctbal >= 500 THEN replace(lower(c_name), '#', '.') || '@example.com' ELSE '' END AS email,
    coalesce(n_name, '') AS location,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'https://linkedin.com/in/' || lower(c_mktsegment) ELSE '' END AS linkedin,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'https://example.org/work' ELSE '' END AS portfolio,
    CASE WHEN c_acctbal >= 1000 THEN lower(c_mktsegment) || ', hot anvil, new ring / cold rods' ELSE '' END AS summary,
    coalesce(skills, []) AS skills, coalesce(tools, []) AS tools, coalesce(certifications, []) AS certifications,
    coalesce(projects, []) AS projects,
    c_nationkey < 20 AS schooled,
    n_name || ' Institute' AS institution,
    CASE WHEN c_nationkey < 8 THEN 'B.Tech' WHEN c_nationkey < 15 THEN 'Master of Science' ELSE 'Diploma' END AS degree,
    CASE WHEN c_nationkey < 8 THEN 'CSE' WHEN c_nationkey < 15 THEN 'Artificial Intelligence' ELSE '' END AS field_of_study,
    round(c_acctbal / 1000, 1) AS stated_years
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN h_lists ON c_custkey = o_custkey
  WHERE c_acctbal >= 0)"""

H_EXPERIENCE = f"""h_order_lines AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, {_set('p_name', 'true')} AS skills_used,
    {_set("CASE l_returnflag WHEN 'R' THEN 'Reduced ' || p_name || ' cost by 15%' WHEN 'A' THEN 'Worked on ' || p_name ELSE 'Built ' || p_name END", 'true')} AS highlights
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
h_experience AS (
  SELECT o_custkey AS candidate_id, o_orderkey AS pos, {case_map('o_orderpriority', views.POSITIONS, "''")} AS title,
    CASE WHEN o_orderstatus = 'P' THEN 'State University' ELSE 'Employer ' || o_orderstatus END AS company,
    strftime(o_orderdate, '%Y-%m') AS start_date, coalesce(strftime(last_ship, '%Y-%m'), '') AS end_date,
    coalesce(skills_used, []) AS skills_used, coalesce(highlights, []) AS highlights
  FROM orders LEFT JOIN h_order_lines ON o_orderkey = l_orderkey)"""

H_APPLICATIONS = f"""h_first AS (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY 1),
h_applications AS (
  SELECT o_orderkey AS application_id, o_custkey AS candidate_id, {JOB_ID} AS job_id,
    CASE o_orderstatus WHEN 'O' THEN 'APPLIED' WHEN 'F' THEN 'CLOSED' ELSE 'REVIEW' END AS status,
    o_orderstatus = 'F' AS processed, o_orderdate AS applied_at
  FROM orders LEFT JOIN h_first ON o_orderkey = l_orderkey LEFT JOIN part ON first_part = p_partkey)"""

H_LOG = """h_log AS (
  SELECT l_orderkey AS application_id, 'SCORE' AS stage,
    CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity < 25 THEN 'failed' ELSE 'FAILED' END WHEN l_quantity < 25 THEN 'DONE' END AS status, l_shipdate AS created_at
  FROM lineitem WHERE l_returnflag = 'R')"""

H_RESUME = """h_resume AS (
  SELECT doc_id, lang, source, CASE lang
    WHEN 'en' THEN 'Alex Moreno' || chr(10) || 'item' || doc_id || '@Example.com | ' || '+1 415 555 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')
      || chr(10) || 'Location: Lyon, France' || chr(10) || 'https://github.com/item' || doc_id || ' https://www.linkedin.com/in/item' || doc_id
      || chr(10) || 'PROFESSIONAL SUMMARY' || chr(10) || string_split(text, chr(10))[1]
      || chr(10) || 'Technical Skills:' || chr(10) || 'Python, SQL / Spark; k8s | data modelling' || chr(10) || 'experience, ' || source
      || chr(10) || 'Tools' || chr(10) || 'Docker, Git' || chr(10) || 'Work Experience' || chr(10) || 'Senior Engineer | Acme Corp | Jan 2018 - Present'
      || chr(10) || 'Built pipelines, cut cost by 20%' || chr(10) || 'Developer at Globex 2015 to 2017' || chr(10) || text
      || chr(10) || 'Education' || chr(10) || 'B.Tech CSE, State Institute, 2014' || chr(10) || 'Diploma | Town College'
      || chr(10) || 'Certifications' || chr(10) || 'Cloud Associate; ' || lang || chr(10) || 'Projects' || chr(10) || '- Search portal'
      || chr(10) || '* search portal' || chr(10) || '- Ranking service' || chr(10) || 'over 6+ years in total, 2.5 yrs abroad' || chr(10)
    WHEN 'de' THEN 'github.com/item' || doc_id || chr(10) || 'www.example.org/item' || doc_id || chr(10) || 'Jean Petit'
      || chr(10) || '+1 415 555 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || chr(10) || 'skills' || chr(10) || 'sql' || chr(10) || text
      || chr(10) || 'Tech stack: Airflow, Kafka' || chr(10) || 'Terraform, Helm' || chr(10) || '3 years of practice' || chr(10)
    WHEN 'es' THEN 'maria lopez garcia' || chr(10) || 'Based in: Madrid' || chr(10) || text
    ELSE text END AS text
  FROM documents)"""

H_JOB_TEXT = """h_job_text AS (
  SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Position: Fullstack Developer ' || item_id || chr(10) || 'The intro needs 3+ years of work'
      || chr(10) || 'Required skills' || chr(10) || 'Python, fullstack; SQL, experience' || chr(10) || text || chr(10) || 'Nice to have'
      || chr(10) || 'React / entry level | Kafka' || chr(10) || 'Responsibilities' || chr(10) || 'Own the roadmap, mentor team' || chr(10) || text
      || chr(10) || 'Qualifications' || chr(10) || 'Bachelor of computer science, 5.5 yrs' || chr(10)
    ELSE CASE WHEN item_id % 3 = 1 THEN 'AI/ML Developer' ELSE 'Full stack engineer' END || chr(10) || replace(text, chr(10), ' ') END AS text
  FROM benchmark)"""

H_MODEL = """h_model AS (
  SELECT event_id, ts, event_type, value, CASE WHEN event_type = 'error' THEN '[ ' || regexp_replace(props, '\\}$', ',}') || ' ]'
    ELSE '```json' || chr(10) || regexp_replace(props, '\\}$', ',}') || chr(10) || '```' END AS raw FROM events)"""

H_GRAPH = """h_graph AS (
  SELECT a.p_name AS term, CASE WHEN a.p_size < 4 THEN 'equivalent' WHEN a.p_size < 26 THEN 'parent' ELSE 'adjacent' END AS relation,
    b.p_name AS related, a.p_partkey AS pos
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
