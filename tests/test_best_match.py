"""Best matches take every similarity in: a pair that only the sequence ratio finds is matched as well."""

import os
from difflib import SequenceMatcher

import pytest

from matchloom.config import DEFAULT as CFG
from matchloom.operators import similarity as sm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_pairs_by_ratio_are_matched(spark):
    from matchloom.plans.catalog import matching as m

    got = {(r.candidate_id, r.query): r.sim for r in m.best_match(spark, FOLDER).collect()}
    p = m.profiles(spark, FOLDER, ratio=True)
    forms = {r.term: r.c for r in sm.features(p._job_words).select("term", "c").collect()}
    own = {(r.candidate_id, r.term) for r in p.skills.own.selectExpr("candidate_id", "explode(skill) AS term").collect()}
    ratios = {(q, t): SequenceMatcher(None, c, t).ratio() for q, c in forms.items() for t in {t for _, t in own}}
    close = {k for k, v in ratios.items() if v >= CFG.floor}
    assert close and all(got[c, q] >= ratios[q, t] for c, t in own for q in forms if (q, t) in close)


def test_prefixes_of_a_share_that_rounds_up_lose_no_pair(spark):
    left = "x" * 66 + "y" * 117  # of 183 characters 39 in 61 are 117, in floating point a little more
    frame = lambda t: sm.features(spark.createDataFrame([(t,)], "term string"))
    right = "y" * 117
    assert SequenceMatcher(None, left, right).ratio() >= 0.78
    assert sm.candidate_pairs(frame(left), frame(right), 0.78).count() == 1
