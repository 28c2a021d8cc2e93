"""Matching, scoring, ranking: every key reads one table of scored applications over the whole folder.

Scores use words, the skill graph and term vectors. The plan with sequence ratios has no SQL twin; the same plan without
them is checked key by key, and so is the one by words alone (`score_pairs_lexical`, `lexical_sim`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT as CFG
from matchloom.functions import scores as sc
from matchloom.functions import text as tx
from matchloom.operators import explain, ranking, similarity as sm
from matchloom.operators.vectors import vector_join
from matchloom.plans import scoring, sqltext as s
from matchloom.plans.catalog import tenure as ct
from matchloom.plans.catalog.text import KEYWORDS_SQL
from matchloom.plans.registry import query
from matchloom.session import cut
from matchloom.sources import views
from matchloom.sources.tables import files_state, table

_BUILT: dict = {}
READ = ["customer", "nation", "part", "orders", "lineitem", "embeddings"]


def kept(spark, sf, kind: tuple, make):
    """Results that several keys share are made once per session and state of the files that they were made from."""
    key = (spark.sparkContext.applicationId, sf, kind)
    state = files_state(spark, sf, *READ)
    if key not in _BUILT or _BUILT[key][0] != state:
        _BUILT[key] = state, make()
    return _BUILT[key][1]


def profiles(spark, sf, ratio: bool = False, semantic: bool = True) -> scoring.Profiles:
    """Profile tables; ``semantic``: with the skill graph and the term vectors."""

    def make():
        graph, vectors = (graph_edges(spark, sf), views.term_vectors(spark, sf)) if semantic else (None, None)
        return scoring.build_profiles(
            views.jobs(spark, sf), views.candidates(spark, sf), ct.entries(spark, sf), CFG, ratio, graph, vectors=vectors)

    return kept(spark, sf, (ratio, semantic), make)


def scored(spark, sf, ratio: bool = False, semantic: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Scored applications; of ``columns`` only, if they are given."""
    apps = views.applications(spark, sf).where("job_id IS NOT NULL")
    return scoring.score_pairs(apps, profiles(spark, sf, ratio, semantic), once=True, columns=columns)


# ---- the same in SQL ------------------------------------------------------------------------------------------------

def pairs_sql(name: str, left: str, right: str, floor: float) -> str:
    """Words first, then the flat value of an edge, then the better of words and vectors."""
    def form(v):
        return f"(SELECT term, {s.canonical('term')} AS c FROM {v})"
    return lexical_sql(f"{name}_lex", left, right, floor) + f""",
{name}_graph AS (SELECT DISTINCT a.term AS l, b.term AS r FROM {form(left)} a JOIN g_both g ON a.c = g.l JOIN {form(right)} b ON b.c = g.r),
{name}_cos AS (SELECT * FROM (SELECT a.term AS l, b.term AS r, round(list_dot_product(x.v, y.v), 12) AS cos FROM {form(left)} a JOIN t_units x ON x.term = a.c, {form(right)} b JOIN t_units y ON y.term = b.c
  WHERE a.term <> b.term) WHERE cos >= {floor}),
{name} AS (SELECT l, r, CASE WHEN coalesce(x.sim, 0) >= 0.95 THEN x.sim WHEN g.hit THEN 0.85 ELSE greatest(coalesce(x.sim, 0), coalesce(v.cos, 0)) END::DOUBLE AS sim
  FROM {name}_lex x FULL JOIN (SELECT *, true AS hit FROM {name}_graph) g USING (l, r) FULL JOIN {name}_cos v USING (l, r))"""


def lexical_sql(name: str, left: str, right: str, floor: float) -> str:
    def feat(v):
        return (f"(SELECT term, {s.canonical('term')} AS c, list_distinct(regexp_extract_all({s.canonical('term')}, '[a-z0-9+#./]+')) AS toks, "
                f"list_filter(string_split(replace({s.canonical('term')}, '.', ' '), ' '), lambda x: x <> '') AS parts FROM {v})")
    acr = ("(len(a.parts) = 1 AND length(a.parts[1]) <= 5 AND a.parts[1] = array_to_string(list_transform(b.parts, lambda x: x[1]), '')) OR "
           "(len(b.parts) = 1 AND length(b.parts[1]) <= 5 AND b.parts[1] = array_to_string(list_transform(a.parts, lambda x: x[1]), ''))")
    return f"""{name} AS (SELECT * FROM (SELECT l, r, CASE WHEN lc = rc THEN 1.0::DOUBLE WHEN acr THEN 0.92::DOUBLE ELSE greatest(shared::DOUBLE / (ln + rn - shared),
      CASE WHEN shared < least(ln, rn) THEN 0 WHEN least(ln, rn) >= 2 THEN 0.9 ELSE 0.85 END::DOUBLE) END AS sim
    FROM (SELECT a.term AS l, b.term AS r, a.c AS lc, b.c AS rc, {acr} AS acr, len(list_intersect(a.toks, b.toks)) AS shared, len(a.toks) AS ln, len(b.toks) AS rn
      FROM {feat(left)} a, {feat(right)} b)) WHERE sim >= {floor})"""


def fold_sql(name: str, items: str, keys: str, pairs: str, threshold: float) -> str:
    """items(keys, term, i from 1) -> name(keys, term, i, leader) by greedy leaders."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    fk = ", ".join(f"f.{k}" for k in ks)
    return f"""{name}_near AS MATERIALIZED (SELECT {', '.join('a.' + k for k in ks)}, a.term, a.i, coalesce(list(b.term ORDER BY sim DESC, b.i) FILTER (b.term IS NOT NULL), []) AS near
    FROM {items} a LEFT JOIN (SELECT b.*, l, sim FROM {items} b JOIN {pairs} p ON p.r = b.term AND p.l <> p.r AND sim >= {threshold}) b ON {on} AND b.l = a.term AND b.i < a.i GROUP BY ALL),
  {name}_fold AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS leaders, '' AS term, '' AS leader FROM {items}
    UNION ALL SELECT {fk}, f.i + 1, CASE WHEN list_filter(t.near, lambda x: list_contains(f.leaders, x))[1] IS NULL THEN list_append(f.leaders, t.term) ELSE f.leaders END,
      t.term, coalesce(list_filter(t.near, lambda x: list_contains(f.leaders, x))[1], t.term)
    FROM {name}_fold f JOIN {name}_near t ON {' AND '.join(f't.{k} = f.{k}' for k in ks)} AND t.i = f.i + 1),
  {name} AS (SELECT {keys}, term, i, leader FROM {name}_fold WHERE i > 0)"""


def uniq_terms(raw: str, canon: bool = True) -> str:
    """Inline order-preserving distinct of normalised list elements (evaluated in a one-row subquery)."""
    fn = s.canonical if canon else s.skill
    return f"(SELECT {s.uniq('q')} FROM (SELECT list_transform({raw}, lambda v: {fn('v')}) AS q))"


def phrase_sql(text: str, limit: int, max_tokens: int = 4) -> str:
    return f"list_filter({uniq_terms(s.split_list(text))}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)} AND {s.n_words('x')} <= {max_tokens})[:{limit}]"


def set_sql(raw: str) -> str:
    return f"list_sort(list_filter({uniq_terms(raw)}, lambda x: NOT {s.inside('x', fv.SCORING_NOISE)}))"


def sane_sql(raw: str) -> str:
    return f"list_filter({uniq_terms(raw, False)}, lambda x: NOT {s.inside('x', fv.NON_SKILL_PHRASES + fv.SCORING_NOISE)})"


_budget = "CASE " + " ".join(f"WHEN archetype LIKE '%{k}%' THEN {list(v)}" for k, v in fv.BUDGETS.items()) + f" ELSE {list(fv.DEFAULT_BUDGET)} END"
O_JOBS = f"""o_keywords AS ({KEYWORDS_SQL}),
o_base AS (SELECT j.*, {_budget} AS b, keywords, {sane_sql('must_have_skills')} AS must, {sane_sql('good_to_have_skills')} AS nice,
  {ct.seniority_sql(s.skill("title || ' ' || array_to_string(responsibilities, ' ')"))} AS target_level FROM h_jobs j JOIN o_keywords USING (job_id)),
o_jobs AS (SELECT *, {set_sql('must')} AS required, {set_sql('nice')} AS preferred, {set_sql('required_education')} AS education_ref,
  {set_sql('required_certifications')} AS certificate_ref, {set_sql('list_concat(domain_keywords, must, nice)')} AS domain_own,
  {set_sql(f"list_concat(must, nice, domain_keywords, keywords, {sane_sql(phrase_sql('title', 8))}[:8], {phrase_sql('array_to_string(responsibilities, chr(10))', 20)})")} AS context FROM o_base)"""

O_EVIDENCE = f"""o_rows AS (
  SELECT candidate_id, unnest(list_transform(skills, lambda v: {s.canonical('v')})) AS term, 600000000000::BIGINT AS units, [0, 0, 0, generate_subscripts(skills, 1) - 1]::BIGINT[] AS ord FROM h_candidates
  UNION ALL SELECT candidate_id, unnest(list_transform(tools, lambda v: {s.canonical('v')})), 600000000000, [1, 0, 0, generate_subscripts(tools, 1) - 1] FROM h_candidates
  UNION ALL SELECT candidate_id, unnest(list_transform(certifications, lambda v: {s.canonical('v')})), 600000000000, [2, 0, 0, generate_subscripts(certifications, 1) - 1] FROM h_candidates
  UNION ALL SELECT candidate_id, unnest(list_transform(skills_used, lambda v: {s.canonical('v')})), CAST(round(0.75 * pow(0.85, recency) * 1e12) AS BIGINT), [3, recency, 0, generate_subscripts(skills_used, 1) - 1] FROM h_order
  UNION ALL SELECT candidate_id, unnest(p), CAST(round(0.60 * pow(0.85, recency) * 1e12) AS BIGINT), [3, recency, 1, generate_subscripts(p, 1) - 1]
    FROM (SELECT candidate_id, recency, {phrase_sql('array_to_string(highlights, chr(10))', 12)} AS p FROM h_order)
  UNION ALL SELECT candidate_id, unnest(p), CAST(round(0.50 * pow(0.85, i) * 1e12) AS BIGINT), [4, i, 0, generate_subscripts(p, 1) - 1]
    FROM (SELECT candidate_id, i, {phrase_sql('pr', 8)} AS p FROM (SELECT candidate_id, unnest(projects) AS pr, generate_subscripts(projects, 1) - 1 AS i FROM h_candidates))),
o_evidence AS (SELECT r.candidate_id, term, least(sum(units), 1000000000000)::DOUBLE / 1e12 AS weight, min(ord) AS pos
  FROM o_rows r WHERE term <> '' AND NOT {s.inside('term', fv.SCORING_NOISE)} GROUP BY 1, 2)"""

O_DOMAIN = f"""o_domain AS (SELECT candidate_id, term FROM o_evidence
  UNION SELECT candidate_id, unnest({phrase_sql('title', 5)}) FROM h_jobs_only
  UNION SELECT candidate_id, unnest({phrase_sql('array_to_string(highlights, chr(10))', 10)}) FROM h_jobs_only
  UNION SELECT candidate_id, unnest({phrase_sql('summary', 10)}) FROM h_candidates
  UNION SELECT candidate_id, unnest(p) FROM (SELECT candidate_id, {phrase_sql('pr', 8)} AS p FROM (SELECT candidate_id, unnest(projects) AS pr FROM h_candidates)))"""

_edu_part = lambda v: phrase_sql(v, 12, 8)
O_EDUCATION = f"""o_school AS (SELECT candidate_id, {s.skill('degree')} AS d, {s.skill('field_of_study')} AS f, {s.skill('institution')} AS i,
    {s.skill("degree || ' ' || field_of_study || ' ' || institution")} AS whole FROM h_candidates WHERE schooled),
o_education AS (SELECT candidate_id, {uniq_terms(f'''list_concat({_edu_part('d')}, {_edu_part('f')}, {_edu_part('i')}, CASE WHEN d <> '' AND f <> '' THEN [d || ' ' || f] ELSE [] END,
    {phrase_sql('whole', 12, 10)}, CASE WHEN contains(f, 'cse') THEN ['computer science', 'computer science engineering'] ELSE [] END,
    CASE WHEN list_contains(string_split(f, ' '), 'ai') OR contains(f, 'artificial intelligence') THEN ['artificial intelligence'] ELSE [] END,
    CASE WHEN bach THEN {fv.BACHELOR_TERMS} ELSE [] END, CASE WHEN bach AND f <> '' THEN ['b.tech ' || f, 'bachelor ' || f] ELSE [] END,
    CASE WHEN bach AND contains(f, 'computer science') THEN ['b.tech computer science', 'bachelor computer science'] ELSE [] END,
    CASE WHEN mast THEN {fv.MASTER_TERMS} ELSE [] END, CASE WHEN mast AND f <> '' THEN ['m.tech ' || f, 'master ' || f] ELSE [] END,
    CASE WHEN mast AND contains(f, 'artificial intelligence') THEN ['m.tech artificial intelligence', 'master artificial intelligence'] ELSE [] END)''', False)} AS terms
  FROM (SELECT *, regexp_matches(d, 'b\\.tech|b\\.e|bachelor') AS bach, regexp_matches(d, 'm\\.tech|m\\.e|master|msc|m\\.sc') AS mast FROM o_school))"""

OWN_PAIRS = ("o_own_pairs", "o_own_words", "o_own_words", 0.78)
HIT_PAIRS = ("o_pairs", "o_job_words", "o_cand_words", CFG.floor)
O_CLUSTERS = ",\n".join([
    """o_job_items AS (SELECT job_id, 'required' AS kind, unnest(required) AS term, generate_subscripts(required, 1) AS i FROM o_jobs
  UNION ALL SELECT job_id, 'preferred', unnest(preferred), generate_subscripts(preferred, 1) FROM o_jobs
  UNION ALL SELECT job_id, 'domain', unnest(d), generate_subscripts(d, 1) FROM (SELECT job_id, list_concat(domain_own, list_filter(keywords, lambda k: NOT list_contains(domain_own, k))) AS d FROM o_jobs)),
o_job_words AS (SELECT DISTINCT term FROM (SELECT term FROM o_job_items UNION ALL SELECT unnest(list_concat(context, education_ref, certificate_ref)) FROM o_jobs)),
o_own_words AS (SELECT term FROM o_job_words UNION SELECT term FROM o_domain)""",
    pairs_sql(*OWN_PAIRS),
    fold_sql("o_job_leaders", "o_job_items", "job_id, kind", "o_own_pairs", 0.78),
    "o_skill_items AS (SELECT candidate_id, term, weight, row_number() OVER (PARTITION BY candidate_id ORDER BY pos) AS i FROM o_evidence)",
    fold_sql("o_skill_leaders", "o_skill_items", "candidate_id", "o_own_pairs", 0.78),
    "o_weights AS (SELECT candidate_id, term, leader, weight, max(weight) OVER (PARTITION BY candidate_id, leader) AS cluster_weight FROM o_skill_leaders JOIN o_evidence USING (candidate_id, term))",
    "o_domain_items AS (SELECT candidate_id, term, row_number() OVER (PARTITION BY candidate_id ORDER BY term) AS i FROM o_domain)",
    fold_sql("o_domain_leaders", "o_domain_items", "candidate_id", "o_own_pairs", 0.78),
])

O_HITS = ",\n".join([
    f"""o_terms AS (SELECT candidate_id, 'skill' AS kind, term FROM o_weights UNION ALL SELECT candidate_id, 'domain', term FROM o_domain
  UNION ALL SELECT candidate_id, 'centre', term FROM o_domain_leaders WHERE term = leader
  UNION ALL SELECT candidate_id, 'explicit', unnest({set_sql('list_concat(skills, tools)')}) FROM h_candidates
  UNION ALL SELECT candidate_id, 'certificate', unnest({set_sql('certifications')}) FROM h_candidates
  UNION ALL SELECT candidate_id, 'keyword', unnest({phrase_sql("summary || chr(10) || array_to_string(projects, chr(10))", 20)}) FROM h_candidates
  UNION ALL SELECT candidate_id, 'education', unnest(terms) FROM o_education),
o_cand_words AS (SELECT DISTINCT term FROM o_terms)""",
    pairs_sql(*HIT_PAIRS),
    """o_hits AS (SELECT candidate_id, kind, l AS query, max(sim) AS sim, arg_min(term, [1 - sim, 0]::DOUBLE[]) AS anyterm, list(term ORDER BY sim DESC, term)[1] AS term
  FROM o_terms t JOIN o_pairs p ON p.r = t.term GROUP BY 1, 2, 3),
o_apps AS (SELECT DISTINCT job_id, candidate_id FROM h_applications JOIN h_candidates USING (candidate_id) WHERE job_id IS NOT NULL)""",
])


def coverage_sql(name: str, ref: str, kind: str) -> str:
    return f"""{name} AS (SELECT job_id, a.candidate_id, CASE WHEN count(q) = 0 THEN 1.0 WHEN NOT EXISTS (SELECT 1 FROM o_terms t WHERE t.candidate_id = a.candidate_id AND kind = '{kind}') THEN 0.0
    ELSE sum(CASE WHEN h.sim >= 0.75 THEN 1.0 WHEN h.sim >= 0.6 THEN 0.5 ELSE 0 END) / count(q) END::DOUBLE AS cover
  FROM o_apps a JOIN (SELECT job_id, unnest({ref}) AS q FROM o_jobs UNION ALL SELECT job_id, NULL FROM o_jobs) j USING (job_id)
  LEFT JOIN o_hits h ON h.candidate_id = a.candidate_id AND h.kind = '{kind}' AND h.query = q GROUP BY 1, 2)"""


O_DETAILS = f"""o_required AS (SELECT a.job_id, a.candidate_id, leader AS jd_skill, list(struct_pack(member := m.term, sim := h.sim, term := h.term) ORDER BY h.sim DESC NULLS LAST, m.term)[1] AS best
  FROM o_apps a JOIN o_job_leaders m ON m.job_id = a.job_id AND m.kind = 'required' LEFT JOIN o_hits h ON h.candidate_id = a.candidate_id AND h.kind = 'skill' AND h.query = m.term GROUP BY 1, 2, 3),
o_preferred AS (SELECT a.job_id, a.candidate_id, m.term AS jd_skill, struct_pack(member := m.term, sim := h.sim, term := h.term) AS best
  FROM o_apps a JOIN o_job_leaders m ON m.job_id = a.job_id AND m.kind = 'preferred' AND m.term = m.leader LEFT JOIN o_hits h ON h.candidate_id = a.candidate_id AND h.kind = 'skill' AND h.query = m.term),
o_details AS (SELECT kind, job_id, d.candidate_id, jd_skill, coalesce(best.term, '') AS matched_skill, CASE WHEN best.term IS NULL THEN jd_skill ELSE best.member END AS member,
    coalesce(best.sim, 0) AS raw, round_even(coalesce(best.sim, 0), 3) AS similarity, coalesce(best.sim, 0) >= CASE kind WHEN 'required' THEN 0.88 ELSE 0.75 END AS is_match, coalesce(cluster_weight, 0) AS weight
  FROM (SELECT 'required' AS kind, * FROM o_required UNION ALL SELECT 'preferred', * FROM o_preferred) d LEFT JOIN o_weights w ON w.candidate_id = d.candidate_id AND w.term = best.term),
o_match AS (SELECT job_id, candidate_id, count(jd_skill) FILTER (kind = 'required') AS n_required, count(jd_skill) FILTER (kind = 'preferred') AS n_preferred,
    count(jd_skill) FILTER (kind = 'required' AND is_match) AS n_matched, count(jd_skill) FILTER (kind = 'required' AND similarity < 0.6) AS n_critical,
    coalesce(list(jd_skill ORDER BY jd_skill) FILTER (kind = 'required' AND is_match), []) AS matched, coalesce(list(jd_skill ORDER BY jd_skill) FILTER (kind = 'required' AND NOT is_match), []) AS missing,
    coalesce(list(jd_skill ORDER BY jd_skill) FILTER (kind = 'required' AND similarity < 0.6), []) AS critical,
    coalesce(list(DISTINCT matched_skill) FILTER ((kind = 'required' AND is_match) OR (kind = 'preferred' AND similarity >= 0.88)), []) AS excluded,
    coalesce(sum(weight * CASE WHEN similarity >= 0.75 THEN 1 WHEN similarity >= 0.6 THEN 0.5 ELSE 0 END ORDER BY jd_skill) FILTER (kind = 'required' AND is_match), 0)::DOUBLE AS required_credit,
    coalesce(sum(weight * CASE WHEN similarity >= 0.75 THEN 1 WHEN similarity >= 0.6 THEN 0.5 ELSE 0 END ORDER BY jd_skill) FILTER (kind = 'preferred'), 0)::DOUBLE AS preferred_credit,
    coalesce(sum(round_even(weight, 2) ORDER BY jd_skill) FILTER (kind = 'required' AND is_match), 0)::DOUBLE AS proof
  FROM (SELECT job_id, candidate_id, kind, jd_skill, is_match, similarity, matched_skill, weight FROM o_details UNION ALL SELECT job_id, candidate_id, NULL, NULL, NULL, NULL, NULL, NULL FROM o_apps) GROUP BY 1, 2)"""

O_ADDITIONAL = f"""o_extra AS (SELECT a.job_id, a.candidate_id, t.term, list(p.l ORDER BY sim DESC, p.l)[1] AS query, max(sim) AS sim
  FROM o_apps a JOIN o_match m USING (job_id, candidate_id) JOIN o_terms t ON t.candidate_id = a.candidate_id AND kind = 'explicit' AND NOT list_contains(m.excluded, t.term)
  JOIN o_pairs p ON p.r = t.term AND sim >= 0.6 JOIN o_jobs j ON j.job_id = a.job_id AND list_contains(j.context, p.l)
  WHERE NOT ({s.n_words('t.term')} >= 2 AND {s.inside("string_split(t.term, ' ')[-1]", fv.PROJECT_TAIL_TOKENS)}) GROUP BY 1, 2, 3),
o_additional AS (SELECT job_id, candidate_id, list(term ORDER BY sim DESC, term) AS additional, count(*) AS n_additional FROM o_extra GROUP BY 1, 2),
o_tags AS (SELECT a.job_id, a.candidate_id, list(m.term ORDER BY h.sim DESC, m.term) AS tags, count(*) AS n_tags FROM o_apps a
  JOIN o_job_leaders m ON m.job_id = a.job_id AND m.kind = 'domain' AND m.term = m.leader JOIN o_hits h ON h.candidate_id = a.candidate_id AND h.kind = 'centre' AND h.query = m.term AND h.sim >= 0.6 GROUP BY 1, 2)"""

O_COVER = ",\n".join([
    coverage_sql("o_dom_cover", "list_concat(domain_own, keywords)", "domain"), coverage_sql("o_key_cover", "keywords", "keyword"),
    coverage_sql("o_edu_cover", "education_ref", "education"), coverage_sql("o_cert_cover", "certificate_ref", "certificate"),
])

_imp = " OR ".join(f"regexp_matches(h, {s.rx(p)})" for p in fv.IMPACT)
_first = "rtrim(string_split(lower(trim(h)), ' ')[1], 'ed,.:;')"
_own = "(" + " OR ".join(f"starts_with({_first}, '{v}')" for v in fv.OWNERSHIP_VERBS) + ")"
_con = "(" + " OR ".join(f"starts_with({_first}, '{v}')" for v in fv.CONTRIBUTOR_VERBS) + ")"
O_BULLETS = f"""o_bullets AS (SELECT candidate_id, count(*) AS n_bullets, count(*) FILTER ({_imp}) AS n_quantified, count(*) FILTER ({_own}) AS n_own, count(*) FILTER (NOT {_own} AND {_con}) AS n_contribute
  FROM (SELECT candidate_id, unnest(highlights) AS h FROM h_jobs_only) GROUP BY 1)"""

_p = "CAST(round_even({}, 0) AS INT)".format
_breadth = "least(greatest(n_required / 4.0::DOUBLE, 0.7::DOUBLE), 1.0)"
O_SCORE = f"""o_all AS (SELECT m.*, j.title, j.min_years_experience, j.b, j.target_level, CASE WHEN n_required > 0 THEN n_matched::DOUBLE / n_required ELSE 1.0 END AS match_ratio,
    coalesce(ad.additional, []) AS additional, coalesce(n_additional, 0) AS n_additional, coalesce(tags, []) AS tags, coalesce(n_tags, 0) AS n_tags,
    dc.cover AS domain_alignment, kc.cover AS keyword_ratio, CASE WHEN len(required_education) = 0 AND len(required_certifications) = 0 THEN 1.0
      WHEN len(required_certifications) = 0 THEN ec.cover WHEN len(required_education) = 0 THEN cc.cover ELSE (ec.cover + cc.cover) / 2 END::DOUBLE AS education_fit,
    y.years, coalesce(g.peak_level, 0) AS peak_level, coalesce(g.growth, 0) AS growth, coalesce(it.intern_dominant, false) AS intern_dominant,
    coalesce(n_bullets, 0) AS n_bullets, coalesce(n_quantified, 0) AS n_quantified, CASE WHEN n_own + n_contribute > 0 THEN n_own::DOUBLE / (n_own + n_contribute) ELSE 0.5 END AS ownership,
    coalesce(nc.n, 0) AS n_clusters, c.name, ((c.name <> '')::INT + (c.email <> '')::INT + (c.summary <> '')::INT + (len(c.skills) > 0)::INT + (t.n_entries IS NOT NULL)::INT
      + c.schooled::INT + (c.linkedin <> '' OR c.portfolio <> '')::INT) / 7.0::DOUBLE AS completeness
  FROM o_match m JOIN o_jobs j USING (job_id) JOIN h_candidates c USING (candidate_id) JOIN h_years y USING (candidate_id) LEFT JOIN h_tenure t USING (candidate_id)
  LEFT JOIN h_growth g USING (candidate_id) LEFT JOIN h_intern it USING (candidate_id) LEFT JOIN o_bullets USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, count(*) FILTER (term = leader) AS n FROM o_weights GROUP BY 1) nc USING (candidate_id)
  LEFT JOIN o_additional ad USING (job_id, candidate_id) LEFT JOIN o_tags USING (job_id, candidate_id) JOIN o_dom_cover dc USING (job_id, candidate_id)
  JOIN o_key_cover kc USING (job_id, candidate_id) JOIN o_edu_cover ec USING (job_id, candidate_id) JOIN o_cert_cover cc USING (job_id, candidate_id)),
o_ratio AS (SELECT *, CASE WHEN n_required > 0 AND n_preferred > 0 THEN least((3 * sqrt(required_credit / n_required) * {_breadth} + sqrt(preferred_credit / n_preferred)) / 4, 1.0)
      WHEN n_required > 0 THEN least(sqrt(required_credit / n_required) * {_breadth}, 1.0) WHEN n_preferred > 0 THEN least(sqrt(preferred_credit / n_preferred), 1.0) ELSE 1.0 END AS skill_ratio,
    CASE WHEN min_years_experience > 0 THEN least(greatest(years / min_years_experience, 0), 1.0) ELSE least(greatest(years / 2, 0), 1.0) END AS years_fit,
    CASE WHEN target_level > 0 THEN least(peak_level::DOUBLE / target_level, 1.0) WHEN peak_level > 0 THEN least(peak_level / 4.0, 1.0) ELSE 0.0 END::DOUBLE AS seniority_fit,
    greatest(min_years_experience - years, 0.0) AS years_gap,
    CASE WHEN match_ratio <= 0 THEN 2 WHEN match_ratio < 0.34 THEN 4 WHEN match_ratio < 0.67 THEN 6 ELSE 10 END AS additional_cap,
    CASE WHEN match_ratio <= 0 THEN 1 WHEN match_ratio < 0.34 THEN 2 WHEN match_ratio < 0.67 THEN 3 ELSE 8 END AS domain_cap FROM o_all),
o_parts AS (SELECT *, CASE WHEN n_required > 0 AND match_ratio = 0 THEN least({_p('b[1] * skill_ratio')}, {_p('b[1] * 0.15::DOUBLE')}) WHEN n_required > 0 AND match_ratio < 0.34 THEN least({_p('b[1] * skill_ratio')}, {_p('b[1] * 0.30::DOUBLE')})
      ELSE {_p('b[1] * skill_ratio')} END AS skills_score,
    CASE WHEN years = 0 THEN 0 WHEN intern_dominant AND match_ratio < 0.5 THEN least({_p('b[2] * er')}, {_p('b[2] * 0.25::DOUBLE')}) ELSE {_p('b[2] * er')} END AS experience_score,
    {_p('b[3] * education_fit')} AS education_score, {_p('b[4] * sqrt(keyword_ratio)')} AS keyword_score, {_p('b[5] * completeness')} AS completeness_score,
    CAST(least(n_additional * 2, additional_cap) AS INT) AS additional_bonus, CAST(least(n_tags, domain_cap) AS INT) AS domain_bonus
  FROM (SELECT *, CASE WHEN years < 1 THEN least(e0, 0.35::DOUBLE) ELSE e0 END AS er FROM (SELECT *, least(greatest(0.40::DOUBLE * years_fit + 0.25::DOUBLE * seniority_fit + 0.15::DOUBLE * growth + 0.20::DOUBLE * domain_alignment, 0), 1.0) AS e0 FROM o_ratio))),
o_scored AS (SELECT *, CAST(least(CASE WHEN n_required > 0 AND n_matched = 0 THEN least(base, 40) WHEN n_critical > 0 THEN least(base, 65) ELSE base END + additional_bonus + domain_bonus, 100) AS INT) AS total_score,
    {_p("least(greatest((0.30::DOUBLE * skill_ratio + 0.25::DOUBLE * completeness + 0.15::DOUBLE * least(n_clusters / 12.0::DOUBLE, 1.0) + 0.15::DOUBLE * CASE WHEN n_required = 0 THEN 1.0 ELSE proof / greatest(n_matched, 1) END + 0.10::DOUBLE * least(n_additional / 5.0::DOUBLE, 1.0) + 0.05::DOUBLE * domain_alignment) * 100, 0), 100)")} AS confidence_score,
    {_p("least(least(n_critical * 20, 60) + CASE WHEN n_required > 0 AND n_matched = 0 THEN 40 ELSE 0 END + least(years_gap * 8, 25) + CASE WHEN completeness < 0.5 THEN 15 ELSE 0 END + CASE WHEN domain_alignment < 0.5 THEN 10 ELSE 0 END, 100)")} AS risk_score,
    round_even(match_ratio, 3) AS required_match_ratio, CASE WHEN n_matched > 0 THEN proof / n_matched WHEN n_required = 0 THEN 1.0 ELSE 0.0 END AS proof_ratio
  FROM (SELECT *, skills_score + experience_score + education_score + keyword_score + completeness_score AS base FROM o_parts))"""

TERM_VECTORS = """t_word AS (SELECT word, i, avg(x) AS x FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
  JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) ON vec_id = p_partkey GROUP BY 1, 2),
t_list AS (SELECT word, list(x ORDER BY i) AS v FROM t_word GROUP BY 1),
t_words AS (SELECT word, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM t_list),
t_units AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT word AS term, v FROM t_words
  UNION ALL SELECT n.p_name, list_transform(list_zip(a.v, b.v), lambda z: z[1] + 2 * z[2]) FROM (SELECT DISTINCT p_name FROM part) n
    JOIN t_words a ON a.word = string_split(p_name, ' ')[1] JOIN t_words b ON b.word = string_split(p_name, ' ')[2] WHERE len(string_split(p_name, ' ')) = 2))"""
GRAPH_SQL = f"""g0 AS (SELECT {s.skill('term')} AS term, relation, {s.skill('related')} AS related_term, min(pos) AS pos FROM h_graph GROUP BY 1, 2, 3),
g1 AS (SELECT *, row_number() OVER (PARTITION BY term, relation ORDER BY pos, related_term) AS rn, CASE relation WHEN 'equivalent' THEN 1 WHEN 'parent' THEN 2 ELSE 3 END AS ro FROM g0 WHERE length(related_term) <= 80 AND related_term <> ''),
g2 AS (SELECT term, relation, related_term, ro, rn, row_number() OVER (PARTITION BY term, related_term ORDER BY ro) AS dup FROM g1 WHERE rn <= 8),
g_edges AS (SELECT term, relation, related_term FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ro, rn) AS k FROM g2 WHERE dup = 1 AND related_term <> term) WHERE k <= 15)"""
GRAPH_BOTH = "g_both AS (SELECT term AS l, related_term AS r FROM g_edges UNION SELECT related_term, term FROM g_edges)"
CHAIN = [s.H_JOBS, s.H_CANDIDATES, s.H_EXPERIENCE, s.H_APPLICATIONS, ct.H_ENTRIES, ct.H_YEARS, ct.H_ORDER, ct.H_GROWTH, ct.H_INTERN,
         s.H_GRAPH, GRAPH_SQL, GRAPH_BOTH, TERM_VECTORS, O_JOBS, O_EVIDENCE, O_DOMAIN, O_EDUCATION, O_CLUSTERS, O_HITS, O_DETAILS, O_ADDITIONAL, O_COVER, O_BULLETS, O_SCORE]
#: The blocks in which words alone decide.
LEXICAL = {O_CLUSTERS: O_CLUSTERS.replace(pairs_sql(*OWN_PAIRS), lexical_sql(*OWN_PAIRS)), O_HITS: O_HITS.replace(pairs_sql(*HIT_PAIRS), lexical_sql(*HIT_PAIRS))}


def chain(upto: str, select: str, semantic: bool = True) -> str:
    ctes = []
    for block in CHAIN:
        ctes.append(block if semantic else LEXICAL.get(block, block))
        if block is globals()[upto]:
            break
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# ---- similarity keys -------------------------------------------------------------------------------------------------

@query("lexical_sim", chain("O_HITS", "SELECT l, r, sim FROM o_pairs", semantic=False))
def lexical_sim(spark, sf):
    return sm.pair_table(*profiles(spark, sf).words, CFG.floor, ratio=False).select("l", "r", "sim")


@query("lexical_sim_full")
def lexical_sim_full(spark, sf):
    return sm.pair_table(*profiles(spark, sf).words, CFG.floor, ratio=True)


@query("pair_sim", chain("O_HITS", "SELECT l, r, round(sim, 9) AS sim FROM o_pairs"))
def pair_sim(spark, sf):
    """The pair table that scores are made from: words, graph edges and cosines of all vectors."""
    return profiles(spark, sf).pairs.where(F.col("sim") >= CFG.floor).select("l", "r", F.round("sim", 9).alias("sim"))


@query("vector_pairs", """WITH u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  WHERE sqrt(list_dot_product(e, e)) > 0)
SELECT a.vec_id AS l, b.vec_id AS r, round(list_dot_product(a.u, b.u), 9) AS cos FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.35""")
def vector_pairs(spark, sf):
    """Every pair of embeddings with a cosine of 0.35 or more."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("term"), "embedding")
    found = vector_join(vectors, vectors, 0.35).pairs
    return found.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.round("cos", 9).alias("cos"))


@query("acronym_match", "WITH n AS (SELECT DISTINCT p_name AS term FROM part), w AS (SELECT term FROM n UNION SELECT string_split(term, ' ')[1][1] || string_split(term, ' ')[2][1] FROM n UNION SELECT string_split(term, ' ')[1] FROM n)\n"
       "SELECT a.term AS l, b.term AS r FROM n a, w b WHERE a.term <> b.term AND ((len(string_split(b.term, ' ')) = 1 AND length(b.term) <= 5 AND b.term = array_to_string(list_transform(string_split(a.term, ' '), lambda x: x[1]), '')))")
def acronym_match(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    initials = F.array_join(F.transform(F.split("term", " "), lambda x: F.substring(x, 1, 1)), "")
    words = sm.vocabulary(names, names.select(initials.alias("t")), names.select(F.substring_index("term", " ", 1).alias("t")))
    return sm.acronym_pairs(sm.features(names), sm.features(words))



def graph_edges(spark, sf):
    from matchloom.operators.graph import skill_graph

    return skill_graph(views.graph_source(spark, sf))


@query("skill_graph_edges", s.with_(s.H_GRAPH, GRAPH_SQL) + "SELECT * FROM g_edges")
def skill_graph_edges(spark, sf):
    return graph_edges(spark, sf)


@query("graph_match", s.with_(s.H_GRAPH, GRAPH_SQL) + "SELECT term AS l, related_term AS r FROM g_edges WHERE term <> related_term UNION SELECT related_term, term FROM g_edges WHERE term <> related_term")
def graph_match(spark, sf):
    return sm.graph_pairs(graph_edges(spark, sf))


VEC_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT p.l, p.r, list_dot_product(a.e, b.e) / (CASE WHEN sqrt(list_dot_product(a.e, a.e)) > 0 THEN sqrt(list_dot_product(a.e, a.e)) ELSE 1 END * CASE WHEN sqrt(list_dot_product(b.e, b.e)) > 0 THEN sqrt(list_dot_product(b.e, b.e)) ELSE 1 END) AS cos
  FROM (SELECT DISTINCT l_partkey AS l, l_suppkey AS r FROM lineitem) p JOIN v a ON a.vec_id = p.l JOIN v b ON b.vec_id = p.r)"""


@query("cosine_pairs", s.with_(VEC_SQL) + "SELECT l, r, round(cos, 9) AS cos FROM c")
def cosine_pairs(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("term"), "embedding")
    return sm.cosine(wanted, vectors).select("l", "r", F.round("cos", 9).alias("cos"))


COMPOSITE_SQL = """names AS (SELECT DISTINCT p_name AS term FROM part), w AS (SELECT term FROM names UNION SELECT string_split(term, ' ')[2] FROM names),
nv AS (SELECT p_name AS term, arg_min(embedding, p_partkey) AS embedding FROM part JOIN embeddings ON vec_id = p_partkey GROUP BY 1),
np AS (SELECT DISTINCT a.p_name AS l, b.p_name AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 2 WHERE a.p_name <> b.p_name),
nc AS (SELECT np.l, np.r, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS cos FROM np JOIN (SELECT term, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM nv) a ON a.term = np.l
  JOIN (SELECT term, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM nv) b ON b.term = np.r),
g AS (SELECT term AS l, related_term AS r FROM g_edges WHERE term <> related_term UNION SELECT related_term, term FROM g_edges WHERE term <> related_term)"""


@query("composite_sim", s.with_(s.H_GRAPH, GRAPH_SQL, COMPOSITE_SQL, lexical_sql("lx", "names", "w", 0.0)) + f"""SELECT l, r, round(sim, 9) AS sim FROM (
  SELECT lx.l, lx.r, CASE WHEN lx.sim >= 0.95 THEN lx.sim WHEN g.l IS NOT NULL THEN 0.85 ELSE greatest(CASE WHEN lx.sim >= {CFG.floor} THEN lx.sim ELSE 0 END, coalesce(cos, 0)) END AS sim
  FROM lx LEFT JOIN g USING (l, r) LEFT JOIN nc USING (l, r)) WHERE sim >= {CFG.floor}""")
def composite_sim(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("term")).distinct()
    words = sm.vocabulary(names, names.select(F.substring_index("term", " ", -1).alias("t")))
    vectors = part.join(table(spark, sf, "embeddings"), F.col("p_partkey") == F.col("vec_id")).groupBy(F.col("p_name").alias("term")).agg(
        F.min_by("embedding", "p_partkey").alias("embedding"))
    nxt = part.select((F.col("p_partkey") - 2).alias("k"), F.col("p_name").alias("r"))
    wanted = part.join(nxt, F.col("p_partkey") == F.col("k")).select(F.col("p_name").alias("l"), "r").where("l <> r")
    cos = sm.cosine(wanted, vectors)
    return sm.pair_table(names, words, CFG.floor, ratio=False, graph=graph_edges(spark, sf), cosines=cos).where(
        F.col("sim") >= CFG.floor).select("l", "r", F.round("sim", 9).alias("sim"))


# ---- candidate and job terms ------------------------------------------------------------------------------------------

@query("skill_evidence", chain("O_EVIDENCE", "SELECT candidate_id, term, round(weight, 6) AS weight FROM o_evidence WHERE candidate_id IN (SELECT candidate_id FROM h_candidates)"))
def skill_evidence(spark, sf):
    people = views.candidates(spark, sf).select("candidate_id")
    return profiles(spark, sf).candidates.evidence.join(people, "candidate_id", "left_semi").select(
        "candidate_id", "term", F.round("weight", 6).alias("weight"))


@query("leader_clusters", chain("O_CLUSTERS", "SELECT candidate_id, leader AS canonical, list(term ORDER BY term) AS members FROM o_skill_leaders GROUP BY 1, 2"))
def leader_clusters(spark, sf):
    from matchloom.operators.clustering import clusters

    return clusters(profiles(spark, sf).candidates.evidence, ["candidate_id"])


@query("cluster_evidence", chain("O_CLUSTERS", "SELECT candidate_id, term, leader, round(cluster_weight, 6) AS weight FROM o_weights"))
def cluster_evidence(spark, sf):
    return profiles(spark, sf).candidates.evidence.select("candidate_id", "term", "leader", F.round("cluster_weight", 6).alias("weight"))


def ratio_sql(name: str, left: str, right: str, floor: float) -> str:
    """Ratcliff-Obershelp ratio of the canonical forms: the longest common block (the earliest of equals), then both sides of it."""
    block = ("coalesce(list_max(flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(1, least(length(s) - i + 1, length(t)) + 1), "
             "lambda n: CASE WHEN contains(t, substring(s, i, n)) THEN n * 100000 - i ELSE 0 END)))), 0)")
    found = f"SELECT *, CAST(ceil(v / 100000.0) AS BIGINT) AS n, CAST(ceil(v / 100000.0) AS BIGINT) * 100000 - v AS i FROM (SELECT *, {block} AS v FROM"
    form = lambda v: f"(SELECT term, {s.canonical('term')} AS c FROM {v})"
    return f"""{name}_blocks AS ({found} (SELECT a.term AS l, b.term AS r, length(a.c) + length(b.c) AS chars, a.c AS s, b.c AS t FROM {form(left)} a, {form(right)} b WHERE a.c <> b.c))
  UNION ALL {found} (SELECT l, r, chars, x.s AS s, x.t AS t FROM (SELECT l, r, chars, unnest([struct_pack(s := s[:i - 1], t := t[:j - 1]), struct_pack(s := s[i + n:], t := t[j + n:])]) AS x
    FROM (SELECT *, instr(t, substring(s, i, n)) AS j FROM {name}_blocks WHERE n > 0)) WHERE x.s <> '' AND x.t <> ''))),
{name} AS (SELECT * FROM (SELECT l, r, 2.0::DOUBLE * sum(n)::DOUBLE / any_value(chars) AS ratio FROM {name}_blocks GROUP BY 1, 2) WHERE ratio >= {floor})"""


BEST_SQL = ",\n".join([
    "b_skills AS (SELECT DISTINCT term FROM o_terms WHERE kind = 'skill')", lexical_sql("b_lex", "o_job_words", "b_skills", CFG.floor),
    ratio_sql("b_ratio", "o_job_words", "b_skills", CFG.floor),
    f"""b_pairs AS (SELECT l, r, CASE WHEN lex >= 0.95 THEN lex WHEN hit THEN 0.85 ELSE greatest(lex, cos) END::DOUBLE AS sim
  FROM (SELECT l, r, greatest(coalesce(x.sim, 0), coalesce(ratio, 0)) AS lex, hit, coalesce(cos, 0) AS cos
    FROM b_lex x FULL JOIN b_ratio USING (l, r) FULL JOIN (SELECT *, true AS hit FROM o_pairs_graph) USING (l, r) FULL JOIN o_pairs_cos USING (l, r))),
b_hits AS (SELECT candidate_id, l AS query, max(sim) AS sim, list(term ORDER BY sim DESC, term)[1] AS matched FROM o_terms t JOIN b_pairs p ON p.r = t.term AND t.kind = 'skill' WHERE sim >= {CFG.floor} GROUP BY 1, 2)"""])


@query("best_match", chain("O_HITS", "").rstrip() + ",\n" + BEST_SQL + "\nSELECT candidate_id, query, matched, sim FROM b_hits")
def best_match(spark, sf):
    """The best own skill for every job term by all similarities, sequence ratios included."""
    p = profiles(spark, sf, ratio=True)
    hits = scoring.best_hits(p.skills, p.skill_pairs, CFG.floor, ["skill"]).select("candidate_id", F.explode("skill_best").alias("b"))
    return hits.select("candidate_id", "b.query", F.col("b.term").alias("matched"), "b.sim")


@query("jd_context_terms", s.with_(s.H_JOBS, O_JOBS) + "SELECT job_id, context, domain_own FROM o_jobs")
def jd_context_terms(spark, sf):
    return scoring.job_terms(views.jobs(spark, sf)).select("job_id", "context", "domain_own")


@query("score_budget", s.with_(s.H_JOBS, O_JOBS) + "SELECT job_id, b[1] AS skills, b[2] AS experience, b[3] AS education, b[4] AS keyword, b[5] AS completeness FROM o_jobs")
def score_budget(spark, sf):
    return views.jobs(spark, sf).select("job_id", sc.budgets(F.col("archetype")).alias("b")).select("job_id", "b.*")


# ---- keys of the scored table --------------------------------------------------------------------------------------------

def project(name: str, select: str, columns, semantic: bool = True, needs: list[str] | None = None):
    """Register columns of the scored applications (a function that lists them); ``select`` is the same in SQL, ``needs`` the
    columns that they are made from, if these have other names."""

    @query(name, chain("O_SCORE", f"SELECT job_id, candidate_id, {select} FROM o_scored", semantic))
    def run(spark, sf):
        asked = columns() if needs is None else needs
        return scored(spark, sf, semantic=semantic, columns=["job_id", "candidate_id", *asked]).select("job_id", "candidate_id", *columns())

    return run


def scored_table(spark, sf, ratio: bool = False, semantic: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Written, for keys that read it more than once."""
    return kept(spark, sf, ("scored", ratio, semantic, *(columns or ())), lambda: cut(scored(spark, sf, ratio, semantic, columns)))


def r6(name: str):
    return F.round(name, 6).alias(name)


project("match_skills", "list_filter(matched, lambda x: true) AS matched, missing, critical", lambda: ["matched", "missing", "critical"])
project("skills_score", "round(skill_ratio, 6) AS skill_ratio, skills_score", lambda: [r6("skill_ratio"), "skills_score"], needs=["skill_ratio", "skills_score"])
project("bonus_caps", "additional_cap, domain_cap", lambda: ["additional_cap", "domain_cap"])
project("experience_fit", "round(years_fit, 6) AS years_fit, round(seniority_fit, 6) AS seniority_fit", lambda: [r6("years_fit"), r6("seniority_fit")], needs=["years_fit", "seniority_fit"])
project("experience_score", "experience_score", lambda: ["experience_score"])
project("education_score", "round(education_fit, 6) AS education_fit, education_score", lambda: [r6("education_fit"), "education_score"], needs=["education_fit", "education_score"])
project("keyword_score", "round(keyword_ratio, 6) AS keyword_ratio, keyword_score", lambda: [r6("keyword_ratio"), "keyword_score"], needs=["keyword_ratio", "keyword_score"])
project("completeness", "round(completeness, 6) AS completeness, completeness_score", lambda: [r6("completeness"), "completeness_score"], needs=["completeness", "completeness_score"])
project("total_score", "additional_bonus, domain_bonus, total_score", lambda: ["additional_bonus", "domain_bonus", "total_score"])
project("confidence", "confidence_score", lambda: ["confidence_score"])
project("risk", "risk_score", lambda: ["risk_score"])
project("proof_ratio", "round(proof_ratio, 6) AS proof_ratio", lambda: [r6("proof_ratio")], needs=["proof_ratio"])
project("semantic_coverage", "round(domain_alignment, 6) AS domain, round(keyword_ratio, 6) AS keywords", lambda: [F.round("domain_alignment", 6).alias("domain"), F.round("keyword_ratio", 6).alias("keywords")], needs=["domain_alignment", "keyword_ratio"])
project("domain_alignment", "round(domain_alignment, 6) AS domain_alignment", lambda: [r6("domain_alignment")], needs=["domain_alignment"])
project("additional_skills", "additional", lambda: ["additional"])
project("domain_tags", "tags", lambda: ["tags"])
project("excluded_terms", "list_sort(excluded) AS excluded", lambda: [F.array_sort("excluded").alias("excluded")], needs=["excluded"])
_pct = "CAST(round_even(least(greatest({0} / b[{1}]::DOUBLE, 0), 1.0) * 100, 0) AS INT) AS {2}".format
project("decision", f"{_pct('skills_score', 1, 'skill_percent')}, {_pct('experience_score', 2, 'experience_percent')}, {_pct('education_score', 3, 'education_percent')}, "
        f"{_pct('completeness_score', 5, 'completeness_percent')}, CASE WHEN total_score >= 80 THEN 'SHORTLISTED' ELSE 'REJECTED' END AS decision", lambda: [*[sc.percent(F.col(f"{k}_score"), F.col(f"budget.{k}")).alias(f"{n}_percent") for k, n in [("skills", "skill"), ("experience", "experience"), ("education", "education"), ("completeness", "completeness")]], sc.decision(F.col("total_score")).alias("decision")], needs=["skills_score", "experience_score", "education_score", "completeness_score", "budget", "total_score"])
project("fit_band", "CASE WHEN total_score >= 80 AND risk_score <= 45 THEN 'strong' WHEN total_score >= 60 THEN 'moderate' WHEN total_score >= 40 THEN 'partial' ELSE 'limited' END AS fit_band", lambda: [sc.fit_band(F.col("total_score"), F.col("risk_score")).alias("fit_band")], needs=["total_score", "risk_score"])
_SCORES = ["skills_score", "experience_score", "education_score", "keyword_score", "completeness_score", "total_score", "confidence_score", "risk_score"]
for _name, _semantic in [("score_pairs_semantic", True), ("score_pairs_lexical", False)]:
    project(_name, ", ".join(_SCORES) + ", matched, missing, additional, tags", lambda: [*_SCORES, "matched", "missing", "additional", "tags"], _semantic)

_one = "CAST(round_even({}, 1) AS VARCHAR)".format
STRENGTHS_SQL = f"""list_filter([CASE WHEN n_matched > 0 THEN 'Matched required skills: ' || array_to_string(matched[:5], ', ') END,
  CASE WHEN n_additional > 0 THEN 'Additional relevant skills: ' || array_to_string(additional[:5], ', ') END,
  CASE WHEN n_preferred > 0 AND sqrt(preferred_credit / n_preferred) >= 0.5 THEN 'Good alignment on preferred skills and tooling' END,
  CASE WHEN years_fit >= 1 AND min_years_experience > 0 THEN 'Meets experience threshold with ' || {_one('years')} || ' years' END,
  CASE WHEN domain_alignment >= 0.7 THEN 'Experience shows strong alignment with the role domain' END,
  CASE WHEN n_bullets > 0 AND n_quantified::DOUBLE / n_bullets >= 0.3 THEN 'Strong quantified impact: ' || n_quantified || '/' || n_bullets || ' bullets have measurable outcomes' END,
  CASE WHEN n_bullets > 0 AND ownership >= 0.6 THEN 'High ownership language — candidate demonstrates leadership in execution' END], lambda x: x IS NOT NULL)"""
RISKS_SQL = f"""list_filter([CASE WHEN n_critical > 0 THEN 'Critical skill gaps: ' || array_to_string(critical[:5], ', ') WHEN len(missing) > 0 THEN 'Missing required skills: ' || array_to_string(missing[:5], ', ') END,
  CASE WHEN years_gap > 0 THEN 'Experience gap: requires ' || {_one('min_years_experience')} || ' years, profile shows ' || {_one('years')} END,
  CASE WHEN completeness < 0.5 THEN 'Resume is missing key profile details' END, CASE WHEN domain_alignment < 0.4 THEN 'Domain evidence in experience appears limited' END,
  CASE WHEN n_bullets > 3 AND n_quantified::DOUBLE / n_bullets < 0.1 THEN 'Experience highlights lack quantified outcomes — probe for measurable impact in interview' END,
  CASE WHEN n_bullets > 0 AND ownership <= 0.2 THEN 'Contributor-heavy language — may not have driven outcomes independently' END], lambda x: x IS NOT NULL)"""
project("strengths_risks", f"{STRENGTHS_SQL} AS strengths, {RISKS_SQL} AS risks", lambda: ["strengths", "risks"])
project("feedback", f"name || ' was scored for ' || title || ' with a total score of ' || total_score || '/100. ' || array_to_string(CASE WHEN len(n2) = 0 THEN ['Profile was processed successfully but surfaced limited structured evidence.'] ELSE n2 END, ' ') AS feedback "
        .replace("n2", f"list_concat(({STRENGTHS_SQL})[:2], ({RISKS_SQL})[:2])"), lambda: [explain.recruiter_feedback().alias("feedback")], needs=["name", "title", "total_score", "strengths", "risks"])


O_ANY = ",\n".join([
    "o_asked AS (SELECT DISTINCT term FROM o_job_items WHERE kind <> 'domain'), o_skills AS (SELECT DISTINCT term FROM o_terms WHERE kind = 'skill')",
    lexical_sql("o_some", "o_asked", "o_skills", 1e-9),
    f"""o_some_cos AS (SELECT a.term AS l, b.term AS r, round(list_dot_product(x.v, y.v), 12) AS sim FROM (SELECT term, {s.canonical('term')} AS c FROM o_asked) a JOIN t_units x ON x.term = a.c,
  (SELECT term, {s.canonical('term')} AS c FROM o_skills) b JOIN t_units y ON y.term = b.c),
o_any AS (SELECT candidate_id, l AS query, max(sim) AS sim, list(term ORDER BY sim DESC, term)[1] AS term
  FROM (SELECT l, r, max(sim) AS sim FROM (SELECT * FROM o_some UNION ALL SELECT * FROM o_some_cos WHERE sim > 0) GROUP BY 1, 2) p JOIN o_terms t ON p.r = t.term AND t.kind = 'skill' GROUP BY 1, 2),
o_filled AS (SELECT d.kind, d.job_id, d.candidate_id, d.jd_skill, list(struct_pack(member := m.term, sim := y.sim, term := y.term) ORDER BY y.sim DESC, m.term)[1] AS best
  FROM o_details d JOIN o_job_leaders m ON m.job_id = d.job_id AND m.kind = d.kind AND m.leader = d.jd_skill AND (d.kind = 'required' OR m.term = m.leader)
  JOIN o_any y ON y.candidate_id = d.candidate_id AND y.query = m.term WHERE d.matched_skill = '' GROUP BY 1, 2, 3, 4),
o_whole AS (SELECT d.kind, d.job_id, d.candidate_id, d.jd_skill, coalesce(best.member, d.member) AS member, coalesce(best.term, d.matched_skill) AS matched_skill,
    CASE WHEN best IS NULL THEN d.similarity ELSE round_even(best.sim, 3) END AS similarity, d.is_match, CASE WHEN best IS NULL THEN d.weight ELSE coalesce(w.cluster_weight, 0) END AS weight
  FROM o_details d LEFT JOIN o_filled f USING (kind, job_id, candidate_id, jd_skill) LEFT JOIN o_weights w ON w.candidate_id = d.candidate_id AND w.term = best.term)""",
])


def whole_details(spark, sf) -> DataFrame:
    """Made once for the keys that report details."""
    return kept(spark, sf, ("details",), lambda: cut(scoring.complete_details(scored_table(spark, sf), profiles(spark, sf))))


def detail_rows(name: str, kind: str):
    sql = (f"SELECT job_id, candidate_id, jd_skill, member, matched_skill, similarity, is_match, round(weight, 6) AS weight FROM o_whole WHERE kind = '{kind}'")

    @query(name, chain("O_DETAILS", "").rstrip() + ",\n" + O_ANY + "\n" + sql)
    def run(spark, sf):
        rows = whole_details(spark, sf).select("job_id", "candidate_id", F.explode(f"{kind}_details").alias("d"))
        return rows.select("job_id", "candidate_id", "d.jd_skill", "d.member", "d.matched_skill", "d.similarity", "d.is_match", F.round("d.weight", 6).alias("weight"))

    return run


detail_rows("required_match", "required")
detail_rows("preferred_match", "preferred")


@query("impact_rate", s.with_(s.H_EXPERIENCE, ct.H_ENTRIES, O_BULLETS) + "SELECT candidate_id, n_bullets, n_quantified, round(n_quantified::DOUBLE / n_bullets, 6) AS rate FROM o_bullets")
def impact_rate(spark, sf):
    rows = ct.entries(spark, sf).select("candidate_id", F.explode("highlights").alias("h"))
    return rows.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_bullets"), F.count(F.when(sc.quantified(F.col("h")), 1)).alias("n_quantified")
    ).withColumn("rate", F.round(F.col("n_quantified") / F.col("n_bullets"), 6))


@query("ownership_ratio", s.with_(s.H_EXPERIENCE, ct.H_ENTRIES, O_BULLETS) + "SELECT candidate_id, round(CASE WHEN n_own + n_contribute > 0 THEN n_own::DOUBLE / (n_own + n_contribute) ELSE 0.5 END, 6) AS ownership FROM o_bullets")
def ownership_ratio(spark, sf):
    kind = ct.entries(spark, sf).select("candidate_id", F.explode("highlights").alias("h")).select("candidate_id", sc.ownership_kind(F.col("h")).alias("k"))
    n = kind.groupBy("candidate_id").agg(F.count(F.when(F.col("k") == "own", 1)).alias("o"), F.count(F.when(F.col("k") == "contribute", 1)).alias("c"))
    total = F.col("o") + F.col("c")
    return n.select("candidate_id", F.round(F.when(total > 0, F.col("o") / total).otherwise(0.5), 6).alias("ownership"))


@query("match_details")
def match_details(spark, sf):
    t = whole_details(spark, sf)
    return t.select(
        "job_id", "candidate_id", "required_match_ratio", F.col("n_required").alias("required_required_count"), F.col("n_matched").alias("matched_required_count"),
        F.to_json(F.struct(
            F.col("required_details").alias("required"), F.col("preferred_details").alias("preferred"), "required_clusters", "preferred_clusters",
            F.col("additional_details").alias("additional_relevant"), "domain_detection",
            F.struct("additional_bonus", "domain_bonus", (F.col("n_additional") * 2).alias("additional_raw"), F.col("n_tags").alias("domain_raw")).alias("bonus_scores"),
            F.struct("additional_cap", "domain_cap").alias("applied_bonus_caps"),
            F.struct(tx.half_even(F.col("proof_ratio"), 3).alias("required_proof_ratio"), sc.points(F.col("proof_ratio") * 100).alias("score")).alias("evidence_weighted_confidence"),
        )).alias("details"),
    )


@query("score_pairs")
def score_pairs(spark, sf):
    return scored(spark, sf, True, columns=["job_id", "candidate_id", *_SCORES, "matched", "missing", "critical", "additional", "tags", "strengths", "risks"])


RANKED = ["job_id", "candidate_id", "total_score", "required_match_ratio", "confidence_score", "risk_score"]
RANK_SQL = "SELECT job_id, candidate_id, total_score, row_number() OVER (PARTITION BY job_id ORDER BY total_score DESC, required_match_ratio DESC, confidence_score DESC, risk_score, candidate_id) AS rank FROM o_scored"


@query("rank_results", chain("O_SCORE", RANK_SQL))
def rank_results(spark, sf):
    return ranking.rank_results(scored_table(spark, sf, columns=RANKED)).select("job_id", "candidate_id", "total_score", "rank")


@query("top_k", chain("O_SCORE", f"SELECT * FROM ({RANK_SQL}) WHERE rank <= 5"))
def top_k(spark, sf):
    return ranking.top_k(scored(spark, sf, columns=RANKED)).select("job_id", "candidate_id", "total_score", "rank")
