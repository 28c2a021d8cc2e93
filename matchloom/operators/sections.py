"""Sections of résumés and job texts. A document is one row; all of this happens inside that row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx


def stripped_lines(text: Column | str) -> Column:
    return F.filter(F.transform(tx.lines_of(text), tx.strip_space), lambda x: x != "")


def section_marker(line: Column) -> Column:
    aliases = {a: marker for marker, names in fv.SECTION_ALIASES.items() for a in names}
    plain = F.trim(F.regexp_replace(F.lower(line), "[^abcdefghijklmnopqrstuvwxyz ]++", ""))
    return F.coalesce(F.element_at(tx.literal_map(aliases), plain), F.lit(""))


def is_contact(line: Column) -> Column:
    return tx.let(F.lower(line), lambda low: tx.contains_any(low, fv.CONTACT_HINTS)) | line.rlike(tx.UNICODE + r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")


def is_link(line: Column) -> Column:
    return tx.let(F.lower(line), lambda low: tx.contains_any(low, fv.LINK_HINTS))


def annotate(text: Column | str) -> Column:
    """Lines with a marker line before each section.

    Only headers, links and contact lines can open a section, so the state (the current marker) runs down these alone; the
    lines between two openings are then taken as one piece.
    """

    def run(items: Column) -> Column:
        header = F.filter(F.transform(items, lambda x, i: F.when(x["marker"] != "", i)), lambda i: i.isNotNull())
        return tx.let(F.coalesce(F.get(header, F.lit(0)), F.size(items)), lambda first_header: openings(items, first_header))

    def openings(items: Column, first_header: Column) -> Column:
        """Contact data opens a section before the first header only."""
        plain = lambda x: x["marker"] == ""
        events = F.filter(
            F.transform(items, lambda x, i: F.struct(
                i.alias("i"), x["marker"].alias("marker"), (plain(x) & is_link(x["line"])).alias("link"),
                ((i < first_header) & is_contact(x["line"])).alias("contact"))),
            lambda e: ~plain(e) | e["link"] | e["contact"])

        def step(s: Column, e: Column) -> Column:
            opened = (
                F.when(~plain(e), e["marker"]).when(e["link"] & (s["cur"] != "[LINKS]"), "[LINKS]")
                .when(e["contact"] & (s["cur"] != "[CONTACT_INFO]"), "[CONTACT_INFO]").otherwise(s["cur"])
            )
            return tx.let(opened, lambda o: F.when(o == s["cur"], s).otherwise(F.struct(
                F.concat(s["out"], F.array(F.struct(e["i"].alias("i"), o.alias("marker")))).alias("out"), o.alias("cur"))))

        first = F.when(F.exists(F.slice(items, 1, 4), lambda x: is_contact(x["line"])), "[CONTACT_INFO]").otherwise("")
        start = tx.let(first, lambda o: F.struct(F.array(F.struct(F.lit(0).alias("i"), o.alias("marker"))).alias("out"), o.alias("cur")))
        return tx.let(F.aggregate(events, start, step, lambda s: s["out"]), lambda opens: pieces(items, opens))

    def pieces(items: Column, opens: Column) -> Column:
        def piece(o: Column, n: Column) -> Column:
            below = F.slice(items, o["i"] + 1, F.coalesce(F.get(opens, n + 1)["i"], F.size(items)) - o["i"])
            body = F.transform(F.filter(below, lambda x: x["marker"] == ""), lambda x: x["line"])
            return F.when(o["marker"] == "", body).otherwise(F.concat(F.array(o["marker"]), body))

        return F.flatten(F.transform(opens, piece))

    return tx.let(F.transform(stripped_lines(text), lambda x: F.struct(x.alias("line"), section_marker(x).alias("marker"))), run)


def sectioned(annotated: Column) -> Column:
    """array<struct<section, line>>: every line with the marker above it, CONTACT_INFO before any."""

    def run(a: Column) -> Column:
        def head(x: Column) -> Column:
            return F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]"))

        places = F.filter(F.transform(a, lambda x, i: F.when(head(x), i)), lambda i: i.isNotNull())

        def part(p: Column, k: Column, n: Column) -> Column:
            """The lines between a header (-1: the start of the text) and the next one."""
            name = F.when(k < 0, "CONTACT_INFO").otherwise(F.substring(F.get(a, k), 2, F.length(F.get(a, k)) - 2))
            below = F.slice(a, k + 2, F.coalesce(F.get(p, n + 1), F.size(a)) - k - 1)
            return tx.let(name, lambda s: F.transform(below, lambda x: F.struct(s.alias("section"), x.alias("line"))))

        return tx.let(F.concat(F.array(F.lit(-1)), places), lambda p: F.flatten(F.transform(p, lambda k, n: part(p, k, n))))

    return tx.let(annotated, run)


def section(rows: Column, name: str) -> Column:
    return F.transform(F.filter(rows, lambda r: r["section"] == name), lambda r: r["line"])


def with_sections(docs: DataFrame, *keep: str) -> DataFrame:
    """doc rows plus ``parts`` (sections in order) and ``all_lines`` (raw lines)."""
    whole = tx.strip_space(F.coalesce("text", F.lit("")))
    return docs.select(*keep, "text", sectioned(annotate("text")).alias("parts"), tx.lines_of(whole).alias("all_lines"))


def job_header(line: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(low.contains("required") & low.contains("skill"), "required")
        .when(tx.contains_any(low, ["preferred", "nice to have", "good to have", "bonus"]), "preferred")
        .when(low.contains("responsibil"), "responsibilities")
        .when(low.contains("education") | low.contains("qualification"), "education")
        .otherwise("")
    )


def job_sections(lines: Column) -> Column:
    """array<struct<section, pos, line>> of a job text; lines before the first header and headers are dropped."""

    def run(items: Column) -> Column:
        heads = F.filter(F.transform(items, lambda x, i: F.when(x["head"] != "", i)), lambda i: i.isNotNull())
        return tx.let(heads, lambda h: F.filter(
            F.transform(items, lambda x, i: F.struct(
                F.get(items, F.array_max(F.filter(h, lambda k: k <= i)))["head"].alias("section"),
                i.alias("pos"), x["line"].alias("line"), x["head"].alias("head"))),
            lambda r: (r["head"] == "") & r["section"].isNotNull(),
        ))

    return tx.let(F.transform(lines, lambda x: F.struct(x.alias("line"), job_header(x).alias("head"))), run)
