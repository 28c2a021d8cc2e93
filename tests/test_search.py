"""The search below the floor against all pairs, with words, vectors and ratios, and graph and vectors in whole scores."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from matchloom.operators import search
from matchloom.plans import scoring


def brute(query, terms, ratio, vectors):
    best = (0.0, "")
    for t in sorted(terms):
        a, b = set(query.split()), set(t.split())
        small = min(len(a), len(b))
        sims = [len(a & b) / len(a | b), (0.9 if small > 1 else 0.85) if len(a & b) == small else 0.0]
        if ratio:
            sims.append(SequenceMatcher(None, query, t).ratio())
        if vectors and query in vectors and t in vectors:
            x, y = vectors[query], vectors[t]
            sims.append(round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 12))
        if max(sims) > best[0] + 1e-12:
            best = (max(sims), t)
    return best


@pytest.mark.parametrize("ratio", [False, True])
@pytest.mark.parametrize("with_vectors", [False, True])
def test_best_of_own(spark, ratio, with_vectors):
    r, g = random.Random(3), np.random.default_rng(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(25)]
    terms = sorted({" ".join(r.sample(words, r.randint(1, 3))) for _ in range(60)})
    vectors = {t: g.normal(size=6) for t in terms if r.random() < 0.5} if with_vectors else None
    own = {c: r.sample(terms, 12) for c in range(8)}
    asked = {c: r.sample(terms, 9) for c in range(9)}  # candidate 8 has no terms
    vec = None if vectors is None else spark.createDataFrame([(t, [float(x) for x in v]) for t, v in vectors.items()], "term string, embedding array<double>")
    got = search.best_of_own(
        spark.createDataFrame([(c, q) for c in asked for q in asked[c]] * 2, "candidate_id long, query string"),
        spark.createDataFrame([(c, t) for c in own for t in own[c]], "candidate_id long, term string"), ratio, vec)
    got = {(x.candidate_id, x.query): (round(x.sim, 9), x.term) for x in got.collect()}
    want = {(c, q): brute(q, own.get(c, []), ratio, vectors) for c in asked for q in asked[c]}
    assert got == {k: (round(s, 9), t) for k, (s, t) in want.items() if s > 0}


def tables(spark):
    jobs = spark.createDataFrame(
        [("j", "Engineer", ["nlp", "go programming", "cobol"], ["k8s"], 1.0, [], [], [], [], "standard")],
        "job_id string, title string, must_have_skills array<string>, good_to_have_skills array<string>, min_years_experience double, required_education array<string>, "
        "required_certifications array<string>, domain_keywords array<string>, responsibilities array<string>, archetype string")
    people = spark.createDataFrame(
        [(1, "A", "a@x.io", "", "", "", "", ["natural language processing", "golang", "container orchestration", "coral"], [], [], [], [], 3.0)],
        "candidate_id long, name string, email string, location string, linkedin string, portfolio string, summary string, skills array<string>, tools array<string>, "
        "certifications array<string>, projects array<string>, education array<struct<institution: string, degree: string, field_of_study: string>>, stated_years double")
    entries = spark.createDataFrame(
        [(1, 1, "Engineer", "Acme", "2020-01", "2023-01", ["golang"], ["Built it"], 36, 1.0)],
        "candidate_id long, pos long, title string, company string, start_date string, end_date string, skills_used array<string>, highlights array<string>, "
        "duration_months int, weight double")
    return jobs, people, entries


def test_graph_and_vectors_reach_the_score(spark):
    """An acronym with an edge has the edge's 0.85, below what a required skill needs; a cosine alone can match one; a
    skill that nothing is close to is reported with its best term and changes no score."""
    jobs, people, entries = tables(spark)
    graph = spark.createDataFrame([("nlp", "natural language processing")], "term string, related_term string")
    vectors = spark.createDataFrame(
        [("go programming", [1.0, 0.1]), ("golang", [1.0, 0.0]), ("container orchestration", [0.0, 1.0]), ("cobol", [-0.2, 1.0])], "term string, embedding array<double>")
    apps = spark.createDataFrame([("j", 1)], "job_id string, candidate_id long")

    def details(**given):
        p = scoring.build_profiles(jobs, people, entries, ratio=False, **given)
        scored = scoring.score_pairs(apps, p)
        row, whole = scored.collect()[0], scoring.complete_details(scored, p).collect()[0]
        assert whole.total_score == row.total_score and len(whole.required_details) == len(row.required_details)
        return row, {d.jd_skill: (d.matched_skill, d.similarity, d.is_match) for d in row.required_details}, {d.jd_skill: (d.matched_skill, d.similarity, d.is_match) for d in whole.required_details}

    plain, found, _ = details()
    assert found["nlp"] == ("natural language processing", 0.92, True) and found["go programming"] == ("", 0.0, False)
    semantic, found, whole = details(graph=graph, vectors=vectors)
    assert found["nlp"] == ("natural language processing", 0.85, False)
    assert found["go programming"] == ("golang", 0.995, True)
    assert found["cobol"] == ("container orchestration", 0.981, True)
    assert (plain.matched, semantic.matched) == (["nlp"], ["cobol", "go programming"])
    far = vectors.where("term <> 'cobol'").union(spark.createDataFrame([("cobol", [0.5, 0.1]), ("coral", [-0.1, 1.0])], vectors.schema)).where("term <> 'golang'")
    _, found, whole = details(vectors=far)
    assert found["cobol"] == ("", 0.0, False) and whole["cobol"] == ("container orchestration", 0.196, False)
