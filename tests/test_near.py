"""Clusters and best matches looked up in rows against the joins, and the rows that they no longer form."""

import random

import pytest

from matchloom.operators import clustering as cl, near
from matchloom.plans import scoring


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)]
    sims = [0.6, 0.7, 0.8, 0.8, 0.9]
    pairs = spark.createDataFrame(
        [(a, b, random.choice(sims), random.choice(sims)) for a in words for b in words if a != b and random.random() < 0.3],
        "l string, r string, sim double, back double")
    items = spark.createDataFrame(
        [(c, w, i, random.random()) for c in range(20) for i, w in enumerate(random.sample(words, c))],
        "candidate_id int, term string, pos int, weight double")
    return pairs, items


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_clusters_in_a_row_equal_the_joins(tables):
    pairs, items = tables
    got = cl.leaders(items, pairs, ["candidate_id"], 0.78)
    assert rows(got, *got.columns) == rows(cl.by_joins(items, pairs, ["candidate_id"], 0.78, 20_000), *got.columns)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per pair of terms of a record


@pytest.mark.parametrize("most_pairs, one_row", [(200_000, 20_000), (200_000, 5), (0, 20_000)])
def test_ways_agree_on_weights_and_best_matches(tables, monkeypatch, most_pairs, one_row):
    pairs, items = tables
    want_weight = {}
    leaders = {(r.candidate_id, r.term): r.leader for r in cl.by_joins(items, pairs, ["candidate_id"], 0.78, 20_000).collect()}
    for r in items.collect():
        key = r.candidate_id, leaders[r.candidate_id, r.term]
        want_weight[key] = max(r.weight, want_weight.get(key, 0.0))
    monkeypatch.setattr(near, "MOST_PAIRS", most_pairs)
    led = cl.records(items, pairs, ["candidate_id"], 0.78, one_row, most=("weight", "best")).selectExpr("candidate_id", "inline(members)").collect()
    assert len(led) == len(leaders)
    assert all(r.leader == leaders[r.candidate_id, r.term] and r.best == want_weight[r.candidate_id, r.leader] for r in led)

    arrays = items.groupBy("candidate_id").agg({"term": "collect_list"}).withColumnRenamed("collect_list(term)", "t")
    own = arrays.selectExpr("candidate_id", "t[0] AS x", "t AS skill", *[f"slice(t, 1, 2) AS {k}" for k in [*scoring.KINDS[1:], "explicit"]])
    c = scoring.Candidates(None, None, own)
    got = scoring.best_hits(c, pairs, 0.65).selectExpr("candidate_id", "inline(skill_best)")
    want = scoring.best_matches(c.terms, pairs, 0.65).where("skill IS NOT NULL").selectExpr("candidate_id", "query", "-skill.n AS sim", "skill.term AS term")
    assert rows(got, *got.columns) == rows(want, *got.columns)


def test_a_report_of_vocabularies_makes_nothing_else(spark, monkeypatch):
    from matchloom.operators import evidence as ev
    from matchloom.sources import views
    from matchloom.plans.catalog import tenure as ct

    folder = "/root/testdata/sf0.001"
    made = scoring.build_profiles(views.jobs(spark, folder), views.candidates(spark, folder), ct.entries(spark, folder), ratio=False)
    with monkeypatch.context() as m:
        m.setattr(ev, "skill_evidence", None)
        m.setattr(scoring, "candidate_terms", None)
        m.setattr(scoring, "candidate_profiles", None)
        alone = [rows(w, "term") for w in made.words]
    del made.words
    assert made._domain.count() and "_domain" in made.__dict__
    assert alone == [rows(w, "term") for w in made.words]


def test_mentions_are_in_order_of_source_entry_list_and_place(spark):
    from matchloom.operators import evidence as ev
    from pyspark.sql import functions as F

    places = [(0, 0, 0, 2), (2, 0, 0, 0), (3, 0, 1, 5), (3, 1, 0, 0), (3, 1, 1, 0), (3, 2**31 - 1, 1, 7), (4, 0, 0, 0)]
    got = [spark.range(1).select(ev._order(s, F.lit(p), k, F.lit(i)).alias("o")).first().o for s, p, k, i in places]
    assert got == sorted(set(got))
