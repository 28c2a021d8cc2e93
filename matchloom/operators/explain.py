"""Evidence and wording for every scored pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT, MatchConfig
from matchloom.functions import scores as sc
from matchloom.functions import text as tx
from matchloom.operators import similarity as sm
from matchloom.session import cut

MIN_RELEVANCE = 0.25
PAIR = ["job_id", "candidate_id"]


def recruiter_feedback(rationale: Column | None = None) -> Column:
    """The given rationale when there is one (softened without critical gaps), else a headline and first notes."""
    name = F.when(F.col("name") != "", F.col("name")).otherwise("Candidate")
    title = F.when(F.col("title") != "", F.col("title")).otherwise("the role")
    notes = F.concat(F.slice("strengths", 1, 2), F.slice("risks", 1, 2))
    fallback = F.array(F.lit("Profile was processed successfully but surfaced limited structured evidence."))
    made = F.concat(
        name, F.lit(" was scored for "), title, F.lit(" with a total score of "), F.col("total_score").cast("string"), F.lit("/100. "),
        F.array_join(F.when(F.size(notes) == 0, fallback).otherwise(notes), " "),
    )
    if rationale is None:
        return made
    given = tx.strip_space(F.coalesce(rationale, F.lit("")))
    return F.when(given == "", made).otherwise(tx.redact_critical(given, F.col("critical")))


def query_terms() -> Column:
    """What the evidence is searched for: job record lists, then matched and additional skills; first 24."""
    parts = F.concat(
        F.array("title"), "must_have_skills", "good_to_have_skills", "domain_keywords", F.slice("responsibilities", 1, 6),
        "matched", "additional",
    )
    return F.slice(tx.unique_compact(parts), 1, 24)


def snippets(people: DataFrame, entries: DataFrame) -> DataFrame:
    """(candidate_id, ord, source, text): capped pieces of the record; entries are ranked with a per-task limit."""
    def listed(label: str, column: str, cap: int) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(F.slice(column, 1, cap), ", ")))

    def piece(group: int, source: str, text: Column, i=0, j=0) -> Column:
        spot = F.array(F.lit(group), F.lit(i) if isinstance(i, int) else i, F.lit(j) if isinstance(j, int) else j).cast("array<long>")
        return F.struct(spot.alias("ord"), F.lit(source).alias("source"), tx.compact(text).alias("text"))

    projects = F.transform(F.slice("projects", 1, 6), lambda p, i: piece(5, "project", F.concat(F.lit("Project evidence: "), p), i))

    def school(e: Column, i: Column) -> Column:
        words = F.filter(F.array(e["degree"], e["field_of_study"], e["institution"]), lambda x: x != "")
        return piece(6, "education", F.when(F.size(words) > 0, F.concat(F.lit("Education: "), F.array_join(words, " "))), i)

    own = people.select("candidate_id", F.explode(F.concat(
        F.array(
            piece(0, "summary", F.when(F.col("summary") != "", F.concat(F.lit("Summary: "), F.col("summary")))),
            piece(1, "skills", listed("Skills: ", "skills", 25)), piece(2, "tools", listed("Tools: ", "tools", 20)),
            piece(3, "certifications", listed("Certifications: ", "certifications", 10)),
        ), projects, F.transform(F.slice("education", 1, 4), school),
    )).alias("s")).select("candidate_id", "s.*")

    first = Window.partitionBy("candidate_id").orderBy("pos")
    six = entries.withColumn("n", F.row_number().over(first)).where("n <= 6")
    role = F.array_join(F.filter(F.array("title", "company"), lambda x: x != ""), " at ")
    from_entries = six.select("candidate_id", F.explode(F.concat(
        F.array(
            piece(4, "experience_role", F.when(role != "", F.concat(F.lit("Experience role: "), role)), F.col("n"), 0),
            piece(4, "experience_skills", listed("Experience skills: ", "skills_used", 15), F.col("n"), 1),
        ),
        F.transform(F.slice("highlights", 1, 4), lambda h, i: piece(4, "experience_highlight", F.concat(F.lit("Experience evidence: "), h), F.col("n"), i + 2)),
    )).alias("s")).select("candidate_id", "s.*")
    return own.union(from_entries).where("text <> ''")


def search_tokens(c: Column) -> Column:
    found = F.array_distinct(tx.matches(F.lower(c), "[a-z0-9+#./]+"))
    return F.array_except(found, tx.strings(fv.EVIDENCE_STOPWORDS))


def _overlap(q: Column, t: Column) -> Column:
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def snippet_relevance(
    wanted: DataFrame, pieces: DataFrame, ratio: bool = True, similarity: DataFrame | None = None, least: float = MIN_RELEVANCE,
) -> DataFrame:
    """wanted(job_id, candidate_id, queries) with the candidate's pieces: best query and relevance of every piece that
    reaches `least` (above 0).

    A query is searched once per candidate, whichever of the candidate's jobs ask it. Words find a piece through an index of the
    candidate's own tokens (a pair of query and piece comes out of the first token that they share), so pieces without a
    common word are never met. With ``ratio``, pairs whose lengths allow it are also compared by sequence, once per
    distinct query and text. ``similarity`` (l: query, r: text, sim) adds given values, such as the composite similarity of
    embedded queries and texts.
    """
    q = wanted.select(*PAIR, F.posexplode("queries").alias("qi", "query"))
    asked = q.select("candidate_id", "query").distinct()

    def featured(rows: DataFrame, name: str, mark: str) -> DataFrame:
        f = sm.features(rows.select(F.col(name).alias("term")).distinct()).withColumn("search", search_tokens(F.col("term")))
        f = f.select(F.col("term").alias(name), *[F.col(x).alias(f"{mark}_{x}") for x in ("c", "toks", "short", "initials", "search")])
        return rows.join(f, name)

    # Read by several joins, each of which gives far more rows than it reads: written once, and dealt by candidate into a given
    # number of parts, which adaptive execution doesn't merge by their small size.
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qs = cut(featured(asked, "query", "q").withColumn("q_keys", F.array_union("q_toks", "q_search"))).repartition(parts, "candidate_id")
    ts = cut(featured(pieces, "text", "t").withColumn("t_keys", F.array_union("t_toks", "t_search"))).repartition(parts, "candidate_id")
    place = ["candidate_id", "query", "ord", "source", "text"]
    first = F.get(F.array_intersect("q_keys", "t_keys"), F.lit(0)) == F.col("k")
    shared = qs.withColumn("k", F.explode("q_keys")).join(ts.withColumn("k", F.explode("t_keys")), ["candidate_id", "k"]).where(first)
    words = F.greatest(_overlap(F.col("q_search"), F.col("t_search")), sm.token_value(F.col("q_toks"), F.col("t_toks")))
    found = shared.select(*place, F.when(F.col("q_c") == F.col("t_c"), 1.0).otherwise(words).alias("score"))
    flat = [qs.join(ts, (qs["candidate_id"] == ts["candidate_id"]) & (F.col(a) == F.col(b)) & (F.col("q_c") != F.col("t_c"))).select(
        qs["candidate_id"], "query", "ord", "source", "text", F.lit(0.92).alias("score")) for a, b in (("q_short", "t_initials"), ("t_short", "q_initials"))]
    found = found.union(flat[0]).union(flat[1])
    if ratio:
        n, m = F.length("q_c"), F.length("t_c")
        may = (2 * F.least(n, m) / (n + m) >= least - 0.0005) & (F.col("q_c") != F.col("t_c"))  # a ratio is at most this
        open_ = qs.select("candidate_id", "query", "q_c").join(ts.select("candidate_id", "ord", "source", "text", "t_c"), "candidate_id").where(may)
        open_ = cut(open_)
        each = open_.select("q_c", "t_c").distinct().repartition(parts).select("q_c", "t_c", sm.sequence_ratio("q_c", "t_c")["sim"].alias("score"))
        found = found.union(open_.join(each.where(F.col("score") >= least - 0.0005), ["q_c", "t_c"]).select(*place, "score"))
    if similarity is not None:
        given = asked.join(similarity.select(F.col("l").alias("query"), F.col("r").alias("text"), F.col("sim").alias("score")), "query")
        found = found.union(given.join(pieces, ["candidate_id", "text"]).select(*place, "score"))
    scored = found.where(F.col("score") >= least - 0.0005).groupBy(*place).agg(F.max("score").alias("score"))
    best = F.max(F.struct("score", (-F.col("qi")).alias("n"), "query"))
    return (
        q.join(scored, ["candidate_id", "query"]).groupBy(*PAIR, "ord", "source", "text").agg(best.alias("b"))
        .select(*PAIR, "ord", "source", "text", F.col("b.query").alias("matched_query"),
                F.least(tx.half_even(F.col("b.score"), 3), F.lit(1.0)).alias("relevance"))
        .where(F.col("relevance") >= least)
    )


def top_evidence(relevant: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(F.desc("relevance"), "source", "text", "ord")
    return relevant.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def impact_evidence(pieces: DataFrame, n: int = 4) -> DataFrame:
    """The first pieces of each candidate that state a measured effect, whatever the job."""
    rows = pieces.where(F.col("source").isin("experience_highlight", "project") & F.col("text").rlike(fv.EVIDENCE_IMPACT))
    w = Window.partitionBy("candidate_id").orderBy("ord")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).groupBy("candidate_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("impact_evidence"))


def reasoning_context(scored: DataFrame, relevant: DataFrame, pieces: DataFrame) -> DataFrame:
    """Fit band, queries, best evidence, impact evidence (first four) and gap evidence per scored pair."""
    best = top_evidence(relevant).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("place", "source", "text", "matched_query", "relevance"))).alias("retrieved"))
    gaps = F.when(F.size("critical") > 0, F.array(F.concat(F.lit("Critical missing skills: "), F.array_join(F.slice("critical", 1, 6), ", ")))).when(
        F.size("missing") > 0, F.array(F.concat(F.lit("Missing required skills: "), F.array_join(F.slice("missing", 1, 6), ", ")))
    ).otherwise(tx.strings([]))
    more = tx.let(gaps, lambda g: F.slice(tx.distinct_ignoring_case(F.concat(g, tx.unique_compact(F.slice("risks", 1, 3)))), 1, 5))
    empty = F.array().cast("array<struct<place: int, source: string, text: string, matched_query: string, relevance: double>>")
    return scored.join(best, PAIR, "left").join(impact_evidence(pieces), "candidate_id", "left").withColumns({
        "retrieved": F.coalesce("retrieved", empty), "impact_evidence": tx.empty_if_null("impact_evidence"),
        "gap_evidence": more, "fit_band": sc.fit_band(F.col("total_score"), F.col("risk_score")),
    })


def rationale(context: DataFrame) -> DataFrame:
    """Templated rationale, interview focus areas and hidden strengths (at most four each)."""
    def joined(column: str, n: int) -> Column:
        return F.array_join(F.slice(column, 1, n), ", ")

    texts = F.transform("retrieved", lambda e: e["text"])
    primary = tx.sentence_join(F.slice(texts, 1, 3), 2)
    gap = tx.sentence_join(F.col("gap_evidence"), 2)
    name = F.when(F.col("name") != "", F.col("name")).otherwise("Candidate")
    title = F.when(F.col("title") != "", F.col("title")).otherwise("the role")
    has = lambda c: F.size(c) > 0
    parts = F.array_compact(F.array(
        F.concat(name, F.lit(" appears to be a "), F.col("fit_band"), F.lit(" fit for "), title, F.lit(" with a total score of "),
                 F.col("total_score").cast("string"), F.lit("/100")),
        F.when(F.size("retrieved") > 0, F.concat(F.lit("because the strongest evidence shows "), primary, F.lit(".")))
        .when(has("strengths"), F.concat(F.lit("because "), F.get("strengths", F.lit(0)), F.lit(".")))
        .otherwise("based on the available structured resume evidence."),
        F.when(has("matched"), F.concat(F.lit("The profile directly supports "), joined("matched", 6), F.lit("."))),
        F.when(has("additional"), F.concat(F.lit("Adjacent evidence in "), joined("additional", 5), F.lit(" strengthens the match."))),
        F.when(has("gap_evidence"), F.concat(F.lit("However, the interview should verify "), gap, F.lit("."))),
    ))
    focus = F.slice(F.concat(F.array_compact(F.array(
        F.when(has("critical"), F.concat(F.lit("Validate missing critical skills: "), joined("critical", 4))),
        F.when(has("missing"), F.concat(F.lit("Assess must-have skill depth: "), joined("missing", 4))),
        F.when(has("retrieved"), F.concat(F.lit("Probe scale, recency, and ownership behind: "), F.get(texts, F.lit(0)))),
    )), F.slice("risks", 1, 2)), 1, 4)
    adjacent = F.when(has("additional"), F.array(F.concat(F.lit("Adjacent relevant skills: "), joined("additional", 5)))).otherwise(tx.strings([]))
    projects = F.transform(F.filter("retrieved", lambda e: e["source"] == "project"), lambda e: e["text"])
    found = F.concat(F.slice(projects, 1, 2), F.slice("impact_evidence", 1, 2), F.slice("strengths", 1, 3))
    hidden = tx.let(adjacent, lambda a: F.slice(tx.distinct_ignoring_case(F.concat(a, tx.unique_compact(found))), 1, 4))
    if "has_projects" in context.columns:
        practical = F.array(F.lit("Project work indicates practical delivery experience."))
        hidden = tx.let(hidden, lambda h: F.when((F.size(h) == 0) & F.coalesce("has_projects", F.lit(False)), practical).otherwise(h))
    return context.withColumns({
        "fit_rationale": F.array_join(parts, " "), "interview_focus_areas": focus, "hidden_strengths": hidden,
    })


def merge_rationale(template: DataFrame, external: DataFrame) -> DataFrame:
    """Fields of an external answer win where they are present and of the right shape (lists parse as JSON arrays)."""
    def of_list(c: str) -> Column:
        return F.from_json(F.when(F.col(c).rlike(r"^\s*\["), F.col(c)), "array<string>")

    e = external.select(*PAIR, F.col("fit_rationale").alias("x_text"), F.col("interview_focus_areas").alias("x_focus"), F.col("hidden_strengths").alias("x_hidden"))
    return template.join(e, PAIR, "left").withColumns({
        "fit_rationale": F.coalesce("x_text", "fit_rationale"),
        "interview_focus_areas": F.coalesce(of_list("x_focus"), "interview_focus_areas"),
        "hidden_strengths": F.coalesce(of_list("x_hidden"), "hidden_strengths"),
    }).drop("x_text", "x_focus", "x_hidden")
