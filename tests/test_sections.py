"""Sections against a plain loop over the lines, and results that are not made twice."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx
from matchloom.operators import sections as se

ALIASES = {a: marker for marker, names in fv.SECTION_ALIASES.items() for a in names}


def annotated(lines):
    def contact(x):
        return any(h in x.lower() for h in fv.CONTACT_HINTS) or bool(re.search(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", x))

    out, cur, seen = [], "", False
    if any(contact(x) for x in lines[:4]):
        out, cur = ["[CONTACT_INFO]"], "[CONTACT_INFO]"
    for x in lines:
        marker = ALIASES.get(re.sub("[^a-z ]", "", x.lower()).strip(" "), "")
        opened = cur
        if marker:
            opened = marker
        elif any(h in x.lower() for h in fv.LINK_HINTS) and cur != "[LINKS]":
            opened = "[LINKS]"
        elif not seen and cur != "[CONTACT_INFO]" and contact(x):
            opened = "[CONTACT_INFO]"
        if opened != cur:
            out.append(opened)
        cur, seen = opened, seen or bool(marker)
        if not marker:
            out.append(x)
    return out


def parts(lines):
    name, out = "CONTACT_INFO", []
    for x in lines:
        if x.startswith("[") and x.endswith("]"):
            name = x[1:-1]
        else:
            out.append((name, x))
    return out


def test_annotate_and_sections_equal_a_loop(spark):
    random.seed(3)
    kinds = ["Skills", "* EDUCATION *", "Tools:", "[odd] ]", "[]", "plain words", "https://github.com/a", "Jean Petit", "me@x.org", "[own head]", "[", "]"]
    docs = [[random.choice(kinds) for _ in range(n)] for n in range(40)]
    rows = spark.createDataFrame([(i, "\n \n".join(d)) for i, d in enumerate(docs)] + [(40, " \n\t"), (41, None)], "i int, text string")
    got = {r.i: (r.a, [tuple(p) for p in r.p]) for r in rows.select(
        "i", se.annotate("text").alias("a"), se.sectioned(se.annotate("text")).alias("p")).collect()}
    for i, d in enumerate([*docs, [], []]):
        want = annotated(d)
        assert got[i] == (want, parts(want))


@pytest.mark.parametrize("name", ["annotate_sections", "experience_islands", "education_lines"])
def test_no_filter_makes_the_result_a_second_time(spark, name):
    from matchloom.plans.catalog import load

    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("aggregate(") == 1  # the fold over the lines of a text


def test_terms_are_normalised_once_each(spark):
    rows = spark.createDataFrame([(["ML", " React.js ", "k8s", None],)], "v array<string>").select(tx.canonical_each("v").alias("t"))
    assert rows.first().t == ["machine learning", "react.js", "kubernetes", ""]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1
