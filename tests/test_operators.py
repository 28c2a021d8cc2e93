"""Positions in huge groups, layout, applications, and the stream, on small fixtures."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators import extract as xt, pending as pn, ranking, tenure as tn
from matchloom.streaming import worker


def test_positions_do_not_depend_on_buckets(spark):
    rows = [(1 if i % 3 else 2, i, f"20{10 + i % 7}-0{1 + i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "candidate_id bigint, pos bigint, start_date string")
    small = tn.ordered(df, MatchConfig(rank_bucket=10))
    w = Window.partitionBy("candidate_id").orderBy(tn.start_key(), "pos")
    want = {(r.candidate_id, r.pos): r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    got = {(r.candidate_id, r.pos): r.order_no for r in small.collect()}
    assert got == want
    assert all(r.recency == (sum(1 for k in want if k[0] == r.candidate_id) - r.order_no) for r in small.collect())


def test_progression_across_buckets(spark):
    titles = ["intern", "junior dev", "engineer", "senior engineer", "lead", "gardener", "engineer"]
    rows = [(1, i, t, f"20{10 + i}-01") for i, t in enumerate(titles)] + [(2, 1, "senior", "")]
    df = spark.createDataFrame(rows, "candidate_id bigint, pos bigint, title string, start_date string")
    got = {r.candidate_id: (r.peak_level, round(r.growth, 9)) for r in tn.progression(df, MatchConfig(rank_bucket=1)).collect()}
    # levels 1 2 3 4 5 3: four of five steps do not fall, gain 2 of 5
    assert got == {1: (5, round(0.65 * 4 / 5 + 0.35 * 2 / 5, 9)), 2: (4, 0.88)}


def test_rank_ties(spark):
    rows = [("j", 1, 80, 0.5, 70, 10), ("j", 2, 80, 0.5, 70, 5), ("j", 3, 80, 1.0, 60, 50), ("j", 4, 90, 0.0, 1, 99)]
    df = spark.createDataFrame(rows, "job_id string, candidate_id bigint, total_score int, required_match_ratio double, confidence_score int, risk_score int")
    ranked = {r.candidate_id: r["rank"] for r in ranking.rank_results(df).collect()}
    assert ranked == {4: 1, 3: 2, 2: 3, 1: 4}
    assert sorted(r.candidate_id for r in ranking.top_k(df, 2).collect()) == [3, 4]


def test_layout_matches_a_plain_loop(spark):
    random.seed(3)
    rows = [(p, random.choice("abc"), random.choice([10.0, 50.0]), random.randint(0, 400), random.randint(0, 90), 40, 12) for p in range(6) for _ in range(25)]
    df = spark.createDataFrame(rows, "page_id bigint, text string, conf double, left int, top int, width int, height int")
    got = {(r.page_id, r.line_top): r.line for r in xt.layout_lines(df).collect()}
    for page in range(6):
        words = sorted((w[4], w[3], w[1], w[5]) for w in rows if w[0] == page and w[2] >= 15)
        lines, current, top = [], [], None
        for w in words:
            if top is None or abs(w[0] - top) <= 12:
                current.append(w)
                top = w[0] if top is None else min(top, w[0])
            else:
                lines.append((top, current))
                current, top = [w], w[0]
        lines.append((top, current))
        for line_top, line in lines:
            out, right = "", None
            for t, left, text, width in sorted(line, key=lambda x: (x[1], x[0], x[2])):
                out += ("" if right is None else "    " if left - right > 70 else " ") + text
                right = left + width
            assert got.pop((page, line_top)) == out
    assert not got


APPS = "application_id bigint, candidate_id bigint, job_id string, status string, processed boolean, applied_at timestamp"


def apps(spark):
    rows = [(1, 1, "a", "APPLIED", False), (2, 1, "a", "APPLIED", True), (3, 9, "a", "APPLIED", False), (4, 1, "zz", "APPLIED", False),
            (5, 1, "_a", "APPLIED", False), (6, 1, "a", "CLOSED", False), (7, 1, None, "APPLIED", False), (8, 1, "a", "APPLIED", False), (10, 1, "a", "APPLIED", False)]
    df = spark.createDataFrame(rows, APPS.rsplit(",", 1)[0])
    return df.withColumn("applied_at", F.lit("2024-01-01").cast("timestamp"))


def test_pending_and_resolve(spark):
    log = spark.createDataFrame([(1, "SCORE", "FAILED", 1), (1, "SCORE", "DONE", 2), (8, "SCORE", "DONE", 1), (8, "SCORE", "failed", 2),
                                 (10, "SCORE", None, 1)],
                                "application_id bigint, stage string, status string, created_at int")
    due = pn.pending(apps(spark), log)
    assert sorted(r.application_id for r in due.collect()) == [3, 4, 5, 7, 8]
    jobs = spark.createDataFrame([("a", "_a")], "job_id string, internal_id string")
    people = spark.createDataFrame([(1,)], "candidate_id bigint")
    got = {r.application_id: (r.outcome, r.resolved_job) for r in pn.resolve(due, people, jobs).collect()}
    assert got == {3: ("DELETED", "a"), 4: ("FAILED", None), 5: ("READY", "a"), 7: ("FAILED", None), 8: ("READY", "a")}


def test_rank_with_text_ids_and_nulls(spark):
    rows = [("j", "b", 80, None, 70, 10, ["x"], []), ("j", "a", 80, None, 70, 10, ["x"], ["y"]), ("j", "c", None, 1.0, 70, 10, [], []),
            ("j", "d", 80, 0.7, 70, None, [], []), (None, "e", 10, 0.1, None, 1, [], [])]
    df = spark.createDataFrame(rows, "job_id string, candidate_id string, total_score int, required_match_ratio double, confidence_score int, "
                                     "risk_score int, matched array<string>, missing array<string>")
    ranked = {r.candidate_id: r["rank"] for r in ranking.rank_results(df).collect()}
    assert ranked == {"b": 1, "d": 2, "a": 3, "c": 4, "e": 1}
    assert [r.candidate_id for r in ranking.top_k(df, 2).where("job_id = 'j'").orderBy("rank").collect()] == ["b", "d"]


def one_score(due):
    decision = F.when(F.col("job_id").isNull(), "FAILED").otherwise("REJECTED")
    return due.select("application_id", "candidate_id", "job_id", F.lit(50).alias("score"), decision.alias("decision"))


def test_stream_scores_once(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for _ in range(2):  # the same rows are delivered again, in a second run from the same state
        apps(spark).write.mode("append").parquet(source)
        worker.start(worker.application_stream(spark, source, 1), one_score, log, state).awaitTermination()
    rows = worker.read_log(spark, log).collect()
    assert sorted(r.application_id for r in rows) == [1, 3, 4, 5, 7, 8, 10]
    assert {r.application_id: r.status for r in rows}[7] == "FAILED"  # written like any other, and not tried again
    after = worker.write_back(apps(spark), worker.read_log(spark, log)).collect()
    assert {r.application_id: (r.processed, r.ats_decision) for r in after if r.application_id in (1, 2, 6, 7)} == {
        1: (True, "REJECTED"), 2: (True, None), 6: (False, None), 7: (True, "FAILED")}


def test_stream_takes_late_applications(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for batch in ([(1, "2024-01-10")], [(2, "2023-01-05"), (3, "2024-01-11"), (1, "2024-02-01")]):
        rows = [(i, 1, "a", "APPLIED", False, day) for i, day in batch]
        df = spark.createDataFrame(rows, APPS.replace("timestamp", "string")).withColumn("applied_at", F.col("applied_at").cast("timestamp"))
        df.write.mode("append").parquet(source)
        worker.start(worker.application_stream(spark, source), one_score, log, state).awaitTermination()
    assert sorted(r.application_id for r in worker.read_log(spark, log).collect()) == [1, 2, 3]
