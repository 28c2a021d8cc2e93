"""Applications compared in their candidate's row against the joins, and what is not made when it is not asked for."""

import os

import pytest

from matchloom.operators import applied
from matchloom.plans import scoring
from matchloom.plans.catalog import matching as m, tenure as ct
from matchloom.sources import views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def made(spark):
    return scoring.build_profiles(views.jobs(spark, FOLDER), views.candidates(spark, FOLDER), ct.entries(spark, FOLDER), ratio=False)


def test_rows_equal_joins(spark, made):
    apps = views.applications(spark, FOLDER).where("job_id IS NOT NULL")
    got = scoring.score_pairs(apps, made)
    want = scoring.narratives(scoring.score_features(scoring.pair_features(apps, made.jobs, made.people))).drop(*scoring.INPUT_ONLY)
    columns = sorted(set(want.columns) - {"excluded"})
    assert set(want.columns) <= set(got.columns)
    a, b = (sorted((tuple(r) for r in df.selectExpr(*columns, "sort_array(excluded) AS excluded").collect()), key=repr) for df in (got, want))
    assert len(a) and a == b


def test_asked_columns_are_made_alone(spark, made, monkeypatch):
    from matchloom.operators import tenure as tn

    apps = views.applications(spark, FOLDER).where("job_id IS NOT NULL")
    whole = {(r.job_id, r.candidate_id): r.matched for r in scoring.score_pairs(apps, made).select("job_id", "candidate_id", "matched").collect()}
    monkeypatch.setattr(tn, "tenure", None)
    monkeypatch.setattr(scoring.sc, "quantified", None)
    few = scoring.score_pairs(apps, made, columns=["job_id", "candidate_id", "matched"])
    assert {(r.job_id, r.candidate_id): r.matched for r in few.collect()} == whole
    made.__dict__.pop("board")
    monkeypatch.setattr(applied, "MOST_JOB_TERMS", -1)
    assert made.board is None
