"""Sections and records out of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx
from matchloom.operators import extract as xt, merge, records, sections as se
from matchloom.plans import sqltext as s
from matchloom.plans.registry import query
from matchloom.sources import views
from matchloom.sources.tables import table

_aliases = {a: m for m, names in fv.SECTION_ALIASES.items() for a in names}
_strip = lambda x: f"regexp_replace({x}, {s.rx('^' + s.WS + '+|' + s.WS + '+$')}, '', 'g')"
_any = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_marker = s.case_map("trim(regexp_replace(lower(line), '[^a-z ]', '', 'g'))", _aliases, "''")
_contact = f"({_any('lower(line)', fv.CONTACT_HINTS)} OR regexp_matches(line, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]+ [A-Z][a-z]+(?:$|[^\\p{{L}}\\p{{N}}_])'))"
_link = _any("lower(line)", fv.LINK_HINTS)
LINES = f"""x_lines AS (SELECT doc_id, i, line, {_marker} AS marker, {_link} AS link, {_contact} AS contact FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform({s.lines('text')}, lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM h_resume)))"""
ANNOTATED = """x_fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CASE WHEN bool_or(contact AND i <= 4) THEN '[CONTACT_INFO]' ELSE '' END AS cur, false AS seen,
    CASE WHEN bool_or(contact AND i <= 4) THEN '[CONTACT_INFO]' END AS mark, CAST(NULL AS VARCHAR) AS body FROM x_lines GROUP BY doc_id
  UNION ALL SELECT doc_id, i, nxt, seen OR marker <> '', CASE WHEN nxt <> cur THEN nxt END, CASE WHEN marker = '' THEN line END FROM (
    SELECT l.doc_id, l.i, f.cur, f.seen, l.marker, l.line, CASE WHEN l.marker <> '' THEN l.marker WHEN l.link AND f.cur <> '[LINKS]' THEN '[LINKS]'
      WHEN NOT f.seen AND f.cur <> '[CONTACT_INFO]' AND l.contact THEN '[CONTACT_INFO]' ELSE f.cur END AS nxt
    FROM x_fold f JOIN x_lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1)),
x_rows AS (SELECT doc_id, i * 2 AS k, mark AS line FROM x_fold WHERE mark IS NOT NULL UNION ALL SELECT doc_id, i * 2 + 1, body FROM x_fold WHERE body IS NOT NULL),
x_parts AS (SELECT doc_id, k, line, coalesce(section, 'CONTACT_INFO') AS section FROM (SELECT *, last_value(CASE WHEN head THEN substring(line, 2, length(line) - 2) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS section
  FROM (SELECT *, starts_with(line, '[') AND ends_with(line, ']') AS head FROM x_rows)) WHERE NOT head),
x_sec AS (SELECT doc_id, section, list(line ORDER BY k) AS lines FROM x_parts GROUP BY 1, 2)"""


def rec(*ctes, select):
    return "WITH RECURSIVE " + ",\n".join([s.H_RESUME, LINES, ANNOTATED, *ctes]) + "\n" + select


def sec(name):
    return f"coalesce((SELECT lines FROM x_sec q WHERE q.doc_id = d.doc_id AND q.section = '{name}'), [])"


def parts(spark, sf):
    return se.with_sections(views.resume_text(spark, sf), "doc_id")


def lines(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", F.posexplode(se.stripped_lines("text")).alias("i", "line"))


@query("section_marker", s.with_(s.H_RESUME, LINES) + "SELECT doc_id, i, marker FROM x_lines")
def section_marker(spark, sf):
    return lines(spark, sf).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), se.section_marker(F.col("line")).alias("marker"))


@query("line_class", s.with_(s.H_RESUME, LINES) + "SELECT doc_id, i, link, contact FROM x_lines")
def line_class(spark, sf):
    return lines(spark, sf).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), se.is_link(F.col("line")).alias("link"), se.is_contact(F.col("line")).alias("contact"))


@query("annotate_sections", rec(select="SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM x_rows GROUP BY doc_id"))
def annotate_sections(spark, sf):
    # a text without any character but white space has no lines; judging the result would make it twice
    some = views.resume_text(spark, sf).where(F.col("text").rlike(f"(?!{fv.WHITESPACE})[\\s\\S]"))
    return some.select("doc_id", F.array_join(se.annotate("text"), "\n").alias("text"))


@query("section_lines", rec(select="SELECT doc_id, section, lines FROM x_sec"))
def section_lines(spark, sf):
    rows = parts(spark, sf).select("doc_id", "parts", F.explode(F.array_distinct(F.transform("parts", lambda r: r["section"]))).alias("section"))
    return rows.select("doc_id", "section", F.transform(F.filter("parts", lambda r: r["section"] == F.col("section")), lambda r: r["line"]).alias("lines"))


_low = "lower(line)"
_head = (f"CASE WHEN contains({_low}, 'required') AND contains({_low}, 'skill') THEN 'required' WHEN {_any(_low, ['preferred', 'nice to have', 'good to have', 'bonus'])} THEN 'preferred' "
         f"WHEN contains({_low}, 'responsibil') THEN 'responsibilities' WHEN {_any(_low, ['education', 'qualification'])} THEN 'education' ELSE '' END")
JD = f"""j_lines AS (SELECT item_id, line, pos, {_head} AS head FROM (SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT item_id, list_filter(list_transform({s.lines('text')}, lambda x: {s.squash('x')}), lambda x: x <> '') AS l FROM h_job_text))),
j_parts AS (SELECT item_id, pos, line, section FROM (SELECT *, last_value(nullif(head, '') IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos) AS section FROM j_lines) WHERE head = '' AND section IS NOT NULL)"""


@query("jd_sections", s.with_(s.H_JOB_TEXT, JD) + "SELECT * FROM j_parts")
def jd_sections(spark, sf):
    rows = views.job_text(spark, sf).select("item_id", F.explode(se.job_sections(tx.clean_lines(tx.lines_of("text")))).alias("r"))
    return rows.select("item_id", F.col("r.pos").cast("long").alias("pos"), "r.line", "r.section")


def _phr(text, limit, tokens):
    raw = f"(SELECT {s.uniq('q')} FROM (SELECT list_transform({s.split_list(text)}, lambda v: {s.skill('v')}) AS q))"
    return f"list_filter({raw}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)} AND {s.n_words('x')} <= {tokens})[:{limit}]"


def _sane(lst, limit):
    alias = "regexp_replace({}, '\\bfullstack\\b', 'full stack', 'g')".format(s.skill("v"))
    return (f"list_filter((SELECT {s.uniq('q')} FROM (SELECT list_transform({lst}, lambda v: {s.squash(alias)}) AS q)), lambda x: NOT {s.inside('x', fv.NON_SKILL_PHRASES + fv.SCORING_NOISE)})[:{limit}]")


_title_rx = s.rx("(?im)^(?:job title|role|position)\\s*:\\s*(.+)$")
_years = lambda x: f"coalesce(list_max(list_transform(regexp_extract_all(lower({x}), {s.rx(fv.YEARS)}, 1), lambda y: y::DOUBLE)), 0.0::DOUBLE)"
JOBREC = f"""j_sec AS (SELECT item_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (section = 'required'), '') AS req, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (section = 'preferred'), '') AS pref,
    coalesce(list(line ORDER BY pos) FILTER (section = 'responsibilities'), []) AS resp FROM j_parts GROUP BY 1),
j_base AS (SELECT t.item_id, text, coalesce(req, '') AS req, coalesce(pref, '') AS pref, coalesce(resp, []) AS resp, s.item_id IS NOT NULL AS sectioned, n, first_line,
    CASE WHEN regexp_matches(text, {_title_rx}) THEN {s.squash(f'regexp_extract(text, {_title_rx}, 1)')} ELSE first_line END AS title
  FROM h_job_text t LEFT JOIN j_sec s USING (item_id) JOIN (SELECT item_id, count(*) AS n, arg_min(line, pos) AS first_line FROM j_lines GROUP BY 1) USING (item_id)),
j_ctx AS (SELECT *, CASE WHEN regexp_matches({s.skill('title')}, '\\b(ai|ml|machine learning|artificial intelligence)\\b') THEN 1 WHEN regexp_matches({s.skill('title')}, '\\b(full stack|fullstack)\\b') THEN 2 ELSE 0 END AS kind, n <= 2 AND NOT sectioned AS short FROM j_base),
j_rec AS (SELECT item_id, title, CASE WHEN len({_phr('req', 16, 5)}) > 0 THEN {_sane(_phr('req', 16, 5), 16)} ELSE {_sane(_phr('text', 12, 5), 16)} END AS must_have_skills,
    {_sane("list_concat(" + _sane(_phr('pref', 14, 5), 14) + ", CASE WHEN short AND kind = 1 THEN ['python', 'deep learning', 'natural language processing'] WHEN short AND kind = 2 THEN ['javascript', 'react', 'node.js'] ELSE [] END)", 14)} AS good_to_have_skills,
    CASE WHEN short AND kind = 1 THEN ['artificial intelligence', 'machine learning'] WHEN short AND kind = 2 THEN ['web development', 'backend api', 'frontend'] ELSE [] END AS domain_keywords,
    {_years('text')} AS min_years_experience, list_filter(list_sort({s.words(fv.KNOWN_EDUCATION)}), lambda e: contains(lower(text), e)) AS required_education, resp[:6] AS responsibilities, short, kind FROM j_ctx)"""


@query("extract_job", s.with_(s.H_JOB_TEXT, JD, JOBREC) + "SELECT item_id, title, must_have_skills, good_to_have_skills, domain_keywords, min_years_experience, required_education, responsibilities FROM j_rec")
def extract_job(spark, sf):
    return xt.job_records(views.job_text(spark, sf))


@query("short_jd_context", s.with_(s.H_JOB_TEXT, JD, JOBREC) + "SELECT item_id, title, CASE kind WHEN 1 THEN ['python', 'deep learning', 'natural language processing'] WHEN 2 THEN ['javascript', 'react', 'node.js'] ELSE [] END AS good_to_have, "
       "CASE kind WHEN 1 THEN ['artificial intelligence', 'machine learning'] WHEN 2 THEN ['web development', 'backend api', 'frontend'] ELSE [] END AS domain_keywords FROM j_rec")
def short_jd_context(spark, sf):
    titles = xt.job_records(views.job_text(spark, sf)).select("item_id", "title")
    return titles.select("item_id", "title", xt.short_context(F.col("title")).alias("x")).select("item_id", "title", "x.*")


def resumes(spark, sf):
    return xt.resumes(views.resume_text(spark, sf))


_email, _phone = s.rx(fv.EMAIL), s.rx(fv.PHONE)
_links = r"regexp_extract_all(text, '(?i)\b(?:https?://|www\.)\S+\b')"


def _orelse(a, b):
    return f"CASE WHEN {a} <> '' THEN {a} ELSE {b} END"


CONTACT = f"""x_contact AS (SELECT doc_id, {_orelse(f'regexp_extract(h, {_email})', f'regexp_extract(text, {_email})')} AS email, {_orelse(f'regexp_extract(h, {_phone})', f'regexp_extract(text, {_phone})')} AS phone,
    coalesce(list_filter({_links}, lambda x: contains(lower(x), 'linkedin'))[1], '') AS linkedin,
    coalesce(list_filter({_links}, lambda x: contains(lower(x), 'github'))[1], list_filter({_links}, lambda x: NOT contains(lower(x), 'linkedin'))[1], '') AS portfolio
  FROM (SELECT doc_id, text, array_to_string({sec('CONTACT_INFO')}[:10], chr(10)) AS h FROM h_resume d))"""


@query("contact_fields", rec(CONTACT, select="SELECT * FROM x_contact"))
def contact_fields(spark, sf):
    return resumes(spark, sf).select("doc_id", "email", "phone", "linkedin", "portfolio")


_all = f"list_transform({s.lines(_strip('text'))}, lambda x: {_strip('x')})"
_ws = lambda x: s.squash(x)
_named = (f"length(x) >= 3 AND NOT contains(x, '@') AND NOT contains(lower(x), 'http') AND NOT contains(lower(x), 'linkedin') AND NOT regexp_matches(x, '^[0-9+()\\-\\s]+$') "
          f"AND regexp_matches({_ws('x')}, '^[\\p{{Lu}}.][^ ]*(?: [\\p{{Lu}}.][^ ]*){{0,4}}$')")


@query("candidate_name", rec(select=f"""SELECT doc_id, coalesce(list_filter(CASE WHEN len(c) > 0 THEN c ELSE a[:10] END, lambda x: {_named})[1],
  list_filter(a[:5], lambda x: x <> '' AND len(string_split({_ws('x')}, ' ')) BETWEEN 2 AND 4 AND NOT contains(x, '@'))[1], '') AS name
  FROM (SELECT doc_id, {sec('CONTACT_INFO')}[:10] AS c, {_all} AS a FROM h_resume d)"""))
def candidate_name(spark, sf):
    return resumes(spark, sf).select("doc_id", "name")


@query("location", s.with_(s.H_RESUME) + f"""SELECT doc_id, CASE WHEN regexp_matches(h, {s.rx(fv.LOCATION_LABEL)}) THEN substring({s.squash(f'regexp_extract(h, {s.rx(fv.LOCATION_LABEL)}, 1)')}, 1, 80)
  ELSE {_strip(f'regexp_extract(h, {s.rx(fv.CITY_REGION)}, 1)')} END AS location FROM (SELECT doc_id, substring(text, 1, 2000) AS h FROM h_resume)""")
def location(spark, sf):
    return resumes(spark, sf).select("doc_id", "location")


SKILLS = f"""x_skills AS (SELECT doc_id, CASE WHEN len(s) >= 5 THEN s ELSE list_concat(s, list_filter(f, lambda x: NOT list_contains(s, x)))[:25] END AS skills
  FROM (SELECT doc_id, {_phr(f"array_to_string({sec('SKILLS')}, chr(10))", 25, 5)} AS s, {_phr('text', 30, 5)} AS f FROM h_resume d))"""


@query("resume_skills", rec(SKILLS, select="SELECT * FROM x_skills"))
def resume_skills(spark, sf):
    return resumes(spark, sf).select("doc_id", "skills")


_hit = _any("lower(x)", fv.TOOL_MARKERS)
TOOLS = f"""x_tools AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE {_phr("chunks", 20, 5)} END AS tools FROM (
  SELECT doc_id, {_phr(f"array_to_string({sec('TOOLS')}, chr(10))", 20, 5)} AS s,
    array_to_string(flatten(list_transform(a, lambda x, i: CASE WHEN {_hit} THEN list_filter([CASE WHEN contains(x, ':') THEN substring(x, strpos(x, ':') + 1) END, a[i + 1]], lambda y: y IS NOT NULL) ELSE [] END)), chr(10)) AS chunks
  FROM (SELECT doc_id, {s.lines(_strip('text'))} AS a FROM h_resume) d))"""


@query("tool_lines", rec(TOOLS, select="SELECT * FROM x_tools"))
def tool_lines(spark, sf):
    return resumes(spark, sf).select("doc_id", "tools")


@query("summary", rec(select=f"""SELECT doc_id, CASE WHEN s <> '' THEN s ELSE coalesce(substring(list_filter(a[2:10], lambda x: length(x) > 50 AND NOT contains(x, '@') AND NOT contains(x, 'http'))[1], 1, 300), '') END AS summary
  FROM (SELECT doc_id, trim(array_to_string({sec('SUMMARY')}[:3], ' ')) AS s, {_all} AS a FROM h_resume d)"""))
def summary(spark, sf):
    return resumes(spark, sf).select("doc_id", "summary")


_dr = s.rx(fv.DATE_RANGE)
EXPERIENCE = f"""x_source AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(e) > 0 THEN e ELSE a END, lambda x: {s.squash('x')}), lambda x: x <> '') AS l FROM (SELECT doc_id, {sec('EXPERIENCE')} AS e, {s.lines(_strip('text'))} AS a FROM h_resume d)),
x_work AS (SELECT *, sum(CASE WHEN head OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS entry FROM (
  SELECT *, d <> '' OR contains(line, '|') OR contains(lower(line), ' at ') AS head FROM (SELECT *, regexp_extract(line, {_dr}) AS d FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x_source)))),
x_body AS (SELECT doc_id, entry, coalesce(list(line ORDER BY i) FILTER (i <> first), []) AS highlights FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, entry) AS first FROM x_work) GROUP BY 1, 2),
x_head AS (SELECT *, list_filter(list_transform(string_split(rest, '|'), lambda p: trim(p)), lambda p: p <> '') AS bits FROM (SELECT *, trim(CASE WHEN d = '' THEN line ELSE replace(line, d, '') END, ' -|,') AS rest FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY i) AS k FROM x_work)) WHERE k = 1),
x_entries AS (SELECT doc_id, CAST(entry AS BIGINT) AS entry, CASE WHEN NOT head THEN line WHEN contains(rest, '|') THEN coalesce(bits[1], rest) WHEN contains(lower(rest), ' at ') THEN trim(regexp_extract(rest, '(?is)^(.*?)\\bat\\b(.*)$', 1)) ELSE rest END AS title,
    CASE WHEN NOT head THEN '' WHEN contains(rest, '|') THEN coalesce(bits[2], '') WHEN contains(lower(rest), ' at ') THEN trim(regexp_extract(rest, '(?is)^(.*?)\\bat\\b(.*)$', 2)) ELSE '' END AS company,
    regexp_extract(d, '(?is)^(.*?)\\s*(?:-|to|\\x{{2013}})\\s*(.*)$', 1) AS start_date, regexp_extract(d, '(?is)^(.*?)\\s*(?:-|to|\\x{{2013}})\\s*(.*)$', 2) AS end_date, highlights,
    list_concat(CASE WHEN head THEN {_phr('rest', 16, 5)} ELSE [] END, flatten(list_transform(highlights, lambda hl: {_phr('hl', 16, 5).replace('lambda x:', 'lambda y:').replace('lambda v:', 'lambda z:')}))) AS skills_used
  FROM x_head JOIN x_body USING (doc_id, entry) WHERE entry <= 10)"""
# phrases of each highlight are computed on unnested rows, since a lambda cannot hold a subquery
EXPERIENCE = EXPERIENCE.replace("flatten(list_transform(highlights, lambda hl: " + _phr('hl', 16, 5).replace('lambda x:', 'lambda y:').replace('lambda v:', 'lambda z:') + "))", "coalesce(more, [])").replace(
    "FROM x_head JOIN x_body USING (doc_id, entry) WHERE entry <= 10",
    f"FROM x_head JOIN x_body USING (doc_id, entry) LEFT JOIN (SELECT doc_id, entry, flatten(list(p ORDER BY n)) AS more FROM (SELECT doc_id, entry, n, {_phr('hl', 16, 5)} AS p FROM (SELECT doc_id, entry, unnest(highlights) AS hl, generate_subscripts(highlights, 1) AS n FROM x_body)) GROUP BY 1, 2) USING (doc_id, entry) WHERE entry <= 10")


@query("experience_islands", rec(EXPERIENCE, select="SELECT * FROM x_entries"))
def experience_islands(spark, sf):
    rows = resumes(spark, sf).select("doc_id", F.posexplode_outer("experience_entries").alias("i", "e")).where("e IS NOT NULL")  # without outer, entries are made twice
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("entry"), "e.title", "e.company", "e.start_date", "e.end_date", "e.highlights", "e.skills_used")


@query("stated_years", s.with_(s.H_RESUME) + f"SELECT doc_id, {_years('text')} AS years FROM h_resume")
def stated_years(spark, sf):
    return views.resume_text(spark, sf).select("doc_id", tx.max_years("text").alias("years"))


EDU = f"""x_edu AS (SELECT doc_id, CAST(i AS BIGINT) AS i, coalesce(p[1], line) AS degree, coalesce(p[2], '') AS institution, regexp_extract(line, '\\b(?:19|20)[0-9]{{2}}\\b') AS graduation_date FROM (
  SELECT doc_id, line, i, list_filter(list_transform(string_split_regex(line, '[|,]'), lambda q: trim(q)), lambda q: q <> '') AS p FROM (SELECT doc_id, unnest(l[:5]) AS line, generate_subscripts(l[:5], 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform({sec('EDUCATION')}, lambda x: {s.squash('x')}), lambda x: x <> '') AS l FROM h_resume d))))"""


@query("education_lines", rec(EDU, select="SELECT * FROM x_edu"))
def education_lines(spark, sf):
    rows = resumes(spark, sf).select("doc_id", F.posexplode_outer("education_entries").alias("i", "e")).where("e IS NOT NULL")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "e.degree", "e.institution", "e.graduation_date")


_proj = s.rx(r"^(?:[\-*\x{2022}]|" + s.WS + ")+")
PROJ = f"""x_proj AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[:5] AS projects FROM (
  SELECT doc_id, list_filter(list_transform({sec('PROJECTS')}, lambda x: {s.squash(f"regexp_replace(x, {_proj}, '')")}), lambda x: x <> '') AS l FROM h_resume d))"""
CONF = """x_conf AS (SELECT doc_id, CASE WHEN email <> '' AND phone <> '' THEN 100 WHEN email <> '' OR phone <> '' THEN 60 ELSE 0 END AS contact, least((len(skills) + len(tools)) * 12, 100) AS skills,
    least(coalesce(ne, 0) * 35, 100) AS experience, least(coalesce(nd, 0) * 50, 100) AS education, least(len(projects) * 25, 100) AS projects
  FROM x_contact JOIN x_skills USING (doc_id) JOIN x_tools USING (doc_id) JOIN x_proj USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS ne FROM x_entries GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nd FROM x_edu GROUP BY 1) USING (doc_id))"""


_joined = f"list_aggregate({sec('CERTIFICATIONS')}, 'string_agg', chr(10))"
CERTS = f"""x_cert_text AS (SELECT doc_id, coalesce({_joined}, '') AS lines FROM h_resume d),
x_cert AS ({s.phrases('x_cert_text', 'doc_id', 'lines', 10, 6, False, 'certifications')})"""


@query("certifications_projects", rec(PROJ, CERTS, select="SELECT doc_id, certifications, projects FROM x_cert JOIN x_proj USING (doc_id)"))
def certifications_projects(spark, sf):
    return resumes(spark, sf).select("doc_id", "certifications", "projects")


@query("extract_confidence", rec(CONTACT, SKILLS, TOOLS, EXPERIENCE, EDU, PROJ, CONF, select="SELECT *, CAST(round_even((20 * contact + 30 * skills + 25 * experience + 15 * education + 10 * projects) / 100, 0) AS INT) AS overall FROM x_conf"))
def extract_confidence(spark, sf):
    return resumes(spark, sf).select("doc_id", "confidence.*")


@query("layout_lines")
def layout_lines(spark, sf):
    return xt.layout_lines(views.words(spark, sf))


@query("merge_extractions", """WITH p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'scored' ELSE '' END AS name, '' AS email, CASE WHEN toxic = 1 THEN ['a'] ELSE [] END AS skills, 0::BIGINT AS size FROM labels)
SELECT d.doc_id, CASE WHEN keep AND p.name <> '' THEN p.name ELSE d.lang END AS name, d.source || '@x.org' AS email, CASE WHEN keep AND len(p.skills) > 0 THEN p.skills ELSE [d.source] END AS skills, d.n_chars AS size,
  CASE WHEN keep THEN 'primary' ELSE 'heuristic' END AS provenance FROM documents d LEFT JOIN (SELECT *, name <> '' OR len(skills) > 0 AS keep FROM p) p USING (doc_id)""")
def merge_extractions(spark, sf):
    labels = table(spark, sf, "labels")
    primary = labels.select(
        "doc_id", F.when(F.col("quality") == 1, "scored").otherwise("").alias("name"), F.lit("").alias("email"),
        F.when(F.col("toxic") == 1, F.array(F.lit("a"))).otherwise(tx.strings([])).alias("skills"), F.lit(0).cast("bigint").alias("size"))
    fallback = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("name"), F.concat("source", F.lit("@x.org")).alias("email"), F.array("source").alias("skills"), F.col("n_chars").alias("size"))
    return records.fill_empty(primary, fallback, "doc_id", ["name", "email", "skills"])


def _ext(x, n):
    return (f"list_filter((SELECT {s.uniq('q')} FROM (SELECT list_transform(regexp_extract_all({x}, '[a-zA-Z][a-zA-Z0-9+#.]{{2,}}'), lambda v: {s.skill('v')}) AS q)), lambda x: NOT {s.inside('x', fv.TERM_STOPWORDS)})[:{n}]")


def _norm(x):
    return f"(SELECT {s.uniq('q')} FROM (SELECT list_transform({x}, lambda v: {s.skill('v')}) AS q))"


@query("merge_job", s.with_(s.H_JOBS, f"""p AS (SELECT job_id, title, must_have_skills AS skills, min_years_experience, array_to_string(responsibilities, ' ') AS description FROM h_jobs),
e AS (SELECT job_id, title, list_concat(must_have_skills, good_to_have_skills) AS must, domain_keywords AS dom, required_education, required_certifications, archetype FROM h_jobs WHERE archetype <> 'product'),
j AS (SELECT p.*, e.job_id IS NOT NULL AS has, coalesce(must, []) AS must, coalesce(dom, []) AS dom, coalesce(e.required_education, []) AS red, coalesce(e.required_certifications, []) AS rce, coalesce(archetype, 'standard') AS arch FROM p LEFT JOIN e USING (job_id)),
k AS (SELECT *, {_norm('skills')} AS m, list_filter({_norm('list_concat(must, dom)')}, lambda x: NOT list_contains({s.split_list("array_to_string(skills, ',')")}, x)) AS inf,
   {_ext("title || ' ' || description || ' ' || array_to_string(skills, ' ')", 12)} AS bw, {_ext("title || ' ' || description", 12)} AS tw FROM j)""")
       + f"""SELECT job_id, title, m AS must_have_skills, inf AS good_to_have_skills, CASE WHEN has THEN {_norm('list_concat(bw, dom, inf, tw)')} ELSE bw END AS domain_keywords,
  {_norm('red')} AS required_education, {_norm('rce')} AS required_certifications, CASE WHEN description <> '' THEN [description] ELSE [] END AS responsibilities, CAST(min_years_experience AS DOUBLE) AS min_years_experience, arch AS archetype FROM k""")
def merge_job(spark, sf):
    j = views.jobs(spark, sf)
    postings = j.select("job_id", "title", F.col("must_have_skills").alias("skills"), "min_years_experience", F.array_join("responsibilities", " ").alias("description"))
    extracted = j.where("archetype <> 'product'").select(
        "job_id", "title", F.concat("must_have_skills", "good_to_have_skills").alias("must_have_skills"), tx.strings([]).alias("good_to_have_skills"),
        "domain_keywords", "required_education", "required_certifications", tx.strings([]).alias("responsibilities"), "archetype")
    return merge.merge_jobs(postings, extracted)


@query("merge_candidate", s.with_(s.H_CANDIDATES) + f"""SELECT candidate_id, CASE WHEN stated_years > 5 THEN 'Parsed ' || candidate_id ELSE name END AS name, email, location,
  CASE WHEN stated_years > 8 THEN '+1' WHEN candidate_id % 2 = 0 THEN 'c' || candidate_id ELSE 'p' || candidate_id END AS phone, certifications, projects,
  CASE WHEN len(skills) > 0 THEN '3' ELSE '2' END || ' model' AS metadata,
  {_norm('list_concat(tools, skills)')} AS skills, greatest(stated_years, CASE WHEN len(certifications) > 2 THEN 7.5 ELSE 0 END)::DOUBLE AS total_years_experience FROM h_candidates""")
def merge_candidate(spark, sf):
    c = views.candidates(spark, sf)
    parsed = c.select(
        "candidate_id", F.when(F.col("stated_years") > 5, F.concat(F.lit("Parsed "), F.col("candidate_id").cast("string"))).otherwise("").alias("name"),
        F.lit("").alias("email"), F.lit("").alias("location"), F.col("tools").alias("skills"),
        F.when(F.size("certifications") > 2, 7.5).otherwise(0.0).alias("computed_years"), F.lit(0.0).alias("stated_years"),
        F.when(F.col("stated_years") > 8, "+1").otherwise("").alias("phone"), "certifications", "projects",
        F.create_map(F.lit("source"), F.lit("model")).alias("metadata"))
    number = F.col("candidate_id").cast("string")
    profile = c.select("candidate_id", "name", "email", "location", "skills", "stated_years",
                       F.when(F.col("candidate_id") % 2 == 0, F.concat(F.lit("c"), number)).alias("contact"), F.concat(F.lit("p"), number).alias("phone"))
    shown = F.concat_ws(" ", F.size("metadata").cast("string"), F.element_at("metadata", F.lit("source")))
    return merge.merge_candidates(profile, parsed).withColumn("metadata", shown)


@query("extract_stats", rec(CONTACT, SKILLS, EXPERIENCE, select="""SELECT lang AS path, count(*) AS n, CAST(sum((email <> '')::INT + (phone <> '')::INT + (linkedin <> '')::INT + (portfolio <> '')::INT) AS BIGINT) AS contact_fields,
  CAST(sum(len(skills)) AS BIGINT) AS skills, CAST(sum(coalesce(ne, 0)) AS BIGINT) AS entries FROM h_resume JOIN x_contact USING (doc_id) JOIN x_skills USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS ne FROM x_entries GROUP BY 1) USING (doc_id) GROUP BY 1"""))
def extract_stats(spark, sf):
    lang = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("path"))
    filled = sum(((F.col(c) != "").cast("int") for c in ["phone", "linkedin", "portfolio"]), (F.col("email") != "").cast("int"))
    return resumes(spark, sf).join(lang, "doc_id").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(filled).alias("contact_fields"), F.sum(F.size("skills")).alias("skills"), F.sum(F.size("experience_entries")).alias("entries"))
