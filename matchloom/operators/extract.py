"""Structured fields out of résumé and job texts (one row per document, native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import scores as sc
from matchloom.functions import text as tx
from matchloom.operators import sections as se

NEWLINES = "(?d)"  # only \n ends a line


def _first(values: Column, keep) -> Column:
    return F.get(F.filter(values, keep), F.lit(0))


def _or_else(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def contact_fields(parts: Column, text: Column) -> Column:
    header = F.array_join(F.slice(se.section(parts, "CONTACT_INFO"), 1, 10), "\n")

    def links(found: Column) -> Column:
        low = lambda x: F.lower(x)
        return F.struct(
            F.coalesce(_first(found, lambda x: low(x).contains("linkedin")), F.lit("")).alias("linkedin"),
            F.coalesce(
                _first(found, lambda x: low(x).contains("github")), _first(found, lambda x: ~low(x).contains("linkedin")), F.lit("")
            ).alias("portfolio"),
        )

    def pick(h: Column) -> Column:
        return tx.let(tx.let(tx.matches(text, tx.UNICODE + fv.LINK), links), lambda l: F.struct(
            _or_else(tx.first_match(h, fv.EMAIL), tx.first_match(text, fv.EMAIL)).alias("email"),
            _or_else(tx.first_match(h, fv.PHONE), tx.first_match(text, fv.PHONE)).alias("phone"),
            l["linkedin"].alias("linkedin"), l["portfolio"].alias("portfolio")))

    return tx.let(header, pick)


def person_name(parts: Column, all_lines: Column) -> Column:
    """First short capitalised line without contact data, else the first line of two to four words."""

    def named(x: Column) -> Column:
        low = F.lower(x)
        return (
            (F.length(x) >= 3) & ~x.contains("@") & ~low.contains("http") & ~low.contains("linkedin")
            & ~x.rlike(r"^[0-9+()\-\s]+$") & tx.squash(x).rlike(r"^[\p{Lu}.][^ ]*(?: [\p{Lu}.][^ ]*){0,4}$")
        )

    def words(x: Column) -> Column:
        return F.when(x == "", 0).otherwise(F.size(F.split(tx.squash(x), " ")))

    def choose(c: Column) -> Column:
        top = F.transform(F.slice(all_lines, 1, 5), tx.strip_space)
        lines = F.transform(F.when(F.size(c) > 0, c).otherwise(F.slice(all_lines, 1, 10)), tx.strip_space)
        return F.coalesce(
            _first(lines, named), _first(top, lambda x: words(x).between(2, 4) & ~x.contains("@")), F.lit(""))

    return tx.let(F.slice(se.section(parts, "CONTACT_INFO"), 1, 10), choose)


def location(text: Column) -> Column:
    """A labelled line of the head of the résumé (its first 2000 characters, where such a field counts), else 'City, Region'."""
    def pick(head: Column) -> Column:
        label = F.substring(tx.squash(tx.first_match(head, NEWLINES + fv.LOCATION_LABEL, 1)), 1, 80)
        return F.when(head.rlike(NEWLINES + fv.LOCATION_LABEL), label).otherwise(tx.strip_space(tx.first_match(head, fv.CITY_REGION, 1)))

    return tx.let(F.substring(text, 1, 2000), pick)


def resume_skills(parts: Column, text: Column) -> Column:
    """Up to 25 from the skills section; with fewer than five the whole text adds to them."""
    listed = tx.skill_phrases(F.array_join(se.section(parts, "SKILLS"), "\n"), 25)
    return tx.let(listed, lambda s: F.when(F.size(s) < 5, F.slice(F.array_union(s, tx.skill_phrases(text, 30)), 1, 25)).otherwise(s))


def tool_chunks(lines: Column) -> Column:
    """After each line that names tools: what follows its colon, and the line below."""
    hits = F.flatten(F.transform(lines, lambda x, i: F.when(
        tx.let(F.lower(x), lambda low: tx.contains_any(low, fv.TOOL_MARKERS)),
        F.array_compact(F.array(
            F.when(x.contains(":"), F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), F.get(lines, i + 1))),
    ).otherwise(tx.strings([]))))
    return tx.skill_phrases(F.array_join(hits, "\n"), 20)


def tools(parts: Column, all_lines: Column) -> Column:
    listed = tx.skill_phrases(F.array_join(se.section(parts, "TOOLS"), "\n"), 20)
    return tx.let(listed, lambda s: F.when(F.size(s) > 0, s).otherwise(tool_chunks(all_lines)))


def summary(parts: Column, all_lines: Column) -> Column:
    listed = F.trim(F.array_join(F.slice(se.section(parts, "SUMMARY"), 1, 3), " "))
    long_line = _first(
        F.transform(F.slice(all_lines, 2, 9), tx.strip_space),
        lambda x: (F.length(x) > 50) & ~x.contains("@") & ~x.contains("http"))
    return _or_else(listed, F.coalesce(F.substring(long_line, 1, 300), F.lit("")))


def _entry_head(line: Column) -> Column:
    """Title, company, dates and skills of a header line."""

    def build(r: Column) -> Column:
        bits = F.filter(F.transform(F.split(r["rest"], r"\|"), lambda p: F.trim(p)), lambda x: x != "")
        at = r["rest"].rlike(r"(?i) at ")
        before, after = F.regexp_extract(r["rest"], r"(?is)^(.*?)\bat\b(.*)$", 1), F.regexp_extract(r["rest"], r"(?is)^(.*?)\bat\b(.*)$", 2)
        title = F.when(r["rest"].contains("|"), F.coalesce(F.get(bits, F.lit(0)), r["rest"])).when(at, F.trim(before)).otherwise(r["rest"])
        company = F.when(r["rest"].contains("|"), F.coalesce(F.get(bits, F.lit(1)), F.lit(""))).when(at, F.trim(after)).otherwise("")
        sep = r"(?is)^(.*?)" + fv.RANGE_SEPARATOR[4:] + r"(.*)$"
        return F.struct(
            company.alias("company"), title.alias("title"), F.regexp_extract(r["date"], sep, 1).alias("start_date"),
            F.regexp_extract(r["date"], sep, 2).alias("end_date"), tx.skill_phrases(r["rest"]).alias("skills"))

    def rest(date: Column) -> Column:
        without = F.when(date == "", line).otherwise(F.replace(line, date, F.lit("")))
        return tx.let(F.struct(F.btrim(without, F.lit(" -|,")).alias("rest"), date.alias("date")), build)

    return tx.let(tx.first_match(line, fv.DATE_RANGE), rest)


ENTRY = "struct<company: string, title: string, start_date: string, end_date: string, highlights: array<string>, skills_used: array<string>>"


def experience_entries(lines: Column) -> Column:
    """First ten entries: a line with a date range or a delimiter opens one, the lines below belong to it."""

    def run(items: Column) -> Column:
        heads = F.slice(F.filter(F.transform(items, lambda x, i: F.when(x["head"] | (i == 0), i)), lambda i: i.isNotNull()), 1, 11)

        def entry(h: Column, n: Column, all_heads: Column) -> Column:
            end = F.coalesce(F.get(all_heads, n + 1), F.size(items))
            body = F.transform(F.slice(items, h + 2, end - h - 1), lambda x: x["line"])
            line = F.get(items, h)["line"]

            def fill(b: Column) -> Column:
                more = F.flatten(F.transform(b, lambda x: tx.skill_phrases(x)))
                opened = tx.let(_entry_head(line), lambda e: F.struct(
                    e["company"].alias("company"), e["title"].alias("title"), e["start_date"].alias("start_date"),
                    e["end_date"].alias("end_date"), b.alias("highlights"), F.concat(e["skills"], more).alias("skills_used")))
                plain = F.struct(
                    F.lit("").alias("company"), line.alias("title"), F.lit("").alias("start_date"), F.lit("").alias("end_date"),
                    b.alias("highlights"), more.alias("skills_used"))
                return F.when(F.get(items, h)["head"], opened).otherwise(plain)

            return tx.let(body, fill)

        return tx.let(heads, lambda hs: F.slice(F.transform(hs, lambda h, n: entry(h, n, hs)), 1, 10))

    cleaned = tx.clean_lines(lines)
    return tx.let(
        F.transform(cleaned, lambda x: F.struct(
            x.alias("line"), (x.rlike(fv.DATE_RANGE) | x.contains("|") | F.lower(x).contains(" at ")).alias("head"))),
        run,
    )


def education_entries(lines: Column) -> Column:
    def entry(x: Column) -> Column:
        return tx.let(F.filter(F.transform(F.split(x, r"[|,]"), lambda p: F.trim(p)), lambda p: p != ""), lambda parts: F.struct(
            F.coalesce(F.get(parts, F.lit(0)), x).alias("degree"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("institution"),
            tx.first_match(x, r"\b(?:19|20)[0-9]{2}\b").alias("graduation_date")))

    return F.slice(F.transform(tx.clean_lines(lines), entry), 1, 5)


def confidence(email: Column, phone: Column, n_terms: Column, n_entries: Column, n_schools: Column, n_projects: Column) -> Column:
    contact = F.when((email != "") & (phone != ""), 100).when((email != "") | (phone != ""), 60).otherwise(0)
    parts = [contact] + [F.least(n * f, F.lit(100)) for n, f in [(n_terms, 12), (n_entries, 35), (n_schools, 50), (n_projects, 25)]]
    # whole hundredths, so that halves are exact
    overall = F.lit(0)
    for weight, p in zip([20, 30, 25, 15, 10], parts):
        overall = overall + p * weight
    return F.struct(sc.points(overall / 100).alias("overall"), *[p.cast("int").alias(n) for n, p in zip(["contact", "skills", "experience", "education", "projects"], parts)])


def resumes(docs: DataFrame) -> DataFrame:
    """doc_id and every field that can be read off the text."""
    d = se.with_sections(docs, "doc_id")
    p, t, a = F.col("parts"), F.col("text"), F.col("all_lines")
    work = tx.let(experience_entries(se.section(p, "EXPERIENCE")), lambda e: F.when(F.size(e) > 0, e).otherwise(experience_entries(a)))
    return d.select(
        "doc_id", contact_fields(p, t).alias("c"), person_name(p, a).alias("name"), location(t).alias("location"),
        summary(p, a).alias("summary"), resume_skills(p, t).alias("skills"), tools(p, a).alias("tools"),
        work.alias("experience_entries"), tx.max_years(t).alias("total_years_experience"),
        education_entries(se.section(p, "EDUCATION")).alias("education_entries"),
        tx.project_lines(se.section(p, "PROJECTS")).alias("projects"),
        tx.phrases(F.array_join(se.section(p, "CERTIFICATIONS"), "\n"), 10).alias("certifications"),
    ).select("doc_id", "c.*", *["name", "location", "summary", "skills", "tools", "experience_entries", "total_years_experience", "education_entries", "projects", "certifications"]).withColumn(
        "confidence", confidence(
            F.col("email"), F.col("phone"), F.size("skills") + F.size("tools"), F.size("experience_entries"),
            F.size("education_entries"), F.size("projects")))


def short_context(title: Column) -> Column:
    """Preferred skills and domain words of a title-only job."""
    t = tx.skill(title)

    def row(nice, domain) -> Column:
        return F.struct(tx.strings(nice).alias("good_to_have"), tx.strings(domain).alias("domain_keywords"))

    out = None
    for pattern, (nice, domain) in fv.SHORT_JOB_CONTEXT.items():
        out = F.when(t.rlike(pattern), row(nice, domain)) if out is None else out.when(t.rlike(pattern), row(nice, domain))
    return out.otherwise(row([], []))


def job_records(jobs: DataFrame, key: str = "item_id") -> DataFrame:
    """Job fields from job texts."""
    lines = tx.clean_lines(tx.lines_of("text"))
    label = NEWLINES + fv.JOB_TITLE_LABEL
    base = jobs.select(key, "text", lines.alias("lines"))
    base = base.withColumns({
        "title": F.when(F.col("text").rlike(label), tx.squash(tx.first_match(F.col("text"), label, 1))).otherwise(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))),
        "parts": se.job_sections(F.col("lines")),
    })

    def of(name: str) -> Column:
        return se.section(F.col("parts"), name)

    must = tx.let(tx.skill_phrases(F.array_join(of("required"), "\n"), 16), lambda m: F.when(F.size(m) > 0, m).otherwise(tx.skill_phrases("text", 12)))
    nice = tx.sanitise_terms(tx.skill_phrases(F.array_join(of("preferred"), "\n"), 14), 14, renormalise=False)
    step = base.select(
        key, "title", tx.sanitise_terms(must, 16, renormalise=False).alias("must_have_skills"), nice.alias("nice"),
        tx.max_years("text").alias("min_years_experience"),
        F.filter(F.array_sort(tx.strings(fv.KNOWN_EDUCATION)), lambda e: F.lower("text").contains(e)).alias("required_education"),
        F.slice(of("responsibilities"), 1, 6).alias("responsibilities"),
        ((F.size("lines") <= 2) & (F.size("parts") == 0)).alias("short"), short_context(F.col("title")).alias("extra"),
    )
    return step.select(
        key, "title", "must_have_skills",
        F.when(F.col("short"), tx.sanitise_terms(F.concat("nice", "extra.good_to_have"), 14, renormalise=False)).otherwise(F.col("nice")).alias("good_to_have_skills"),
        F.when(F.col("short"), tx.sanitise_terms(F.col("extra.domain_keywords"), 12, renormalise=False)).otherwise(tx.strings([])).alias("domain_keywords"),
        "min_years_experience", "required_education", "responsibilities",
    )


def layout_lines(words: DataFrame) -> DataFrame:
    """Word boxes to text lines per page.

    Only the distinct pixel rows of a page go through the line fold; words are joined back by (page, row), so a page
    is never gathered as a whole.
    """
    good = words.withColumn("text", tx.strip_space(F.col("text"))).where((F.col("text") != "") & (F.col("conf") >= 15))
    per_row = good.groupBy("page_id", "top").agg(F.sum("height").alias("h"), F.count(F.lit(1)).alias("n"))
    pages = per_row.groupBy("page_id").agg(
        F.array_sort(F.collect_list("top")).alias("tops"), F.greatest(F.lit(12), F.floor(F.sum("h") / F.sum("n"))).alias("tol"))

    def step(s: Column, t: Column) -> Column:
        fresh = F.size(s) == 0
        last = F.get(s, F.size(s) - 1)
        return F.when(fresh | (t - last > F.col("tol")), F.concat(s, F.array(t))).otherwise(s)

    starts = pages.select("page_id", "tops", F.aggregate("tops", F.array().cast("array<int>"), step).alias("starts"))
    rows = starts.select("page_id", F.explode("tops").alias("top"), "starts").select(
        "page_id", "top", F.array_max(F.filter("starts", lambda s: s <= F.col("top"))).alias("line_top"))
    placed = good.join(rows, ["page_id", "top"])
    w = Window.partitionBy("page_id", "line_top").orderBy("left", "top", "text")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w)
    spaced = placed.withColumn("k", F.row_number().over(w)).withColumn(
        "piece", F.concat(F.when(gap.isNull(), "").when(gap > 70, "    ").otherwise(" "), F.col("text")))
    return spaced.groupBy("page_id", "line_top").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("line"))
