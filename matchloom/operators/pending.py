"""Applications: which are due, what they resolve to, what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import DEFAULT, MatchConfig


def latest_log(log: DataFrame) -> DataFrame:
    """Status of the newest SCORE log per application (combined map-side, so many logs of one application are fine)."""
    return log.where("stage = 'SCORE'").groupBy("application_id").agg(
        F.max_by("status", F.struct("created_at", "status")).alias("log_status"))


def pending(applications: DataFrame, log: DataFrame, status: str = "APPLIED") -> DataFrame:
    """Due: right status, not processed, and no finished SCORE log. Only FAILED, in any case of letters, is unfinished; a
    log without a status is a success."""
    done = latest_log(log).where("upper(coalesce(log_status, '')) <> 'FAILED'").select("application_id")
    due = applications.where((F.col("status") == status) & ~F.coalesce("processed", F.lit(False)))
    return due.join(done, "application_id", "left_anti")


def pending_batch(applications: DataFrame, log: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return pending(applications, log).orderBy("applied_at", "application_id").limit(cfg.batch_size)


def resolve(applications: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome per application instead of exceptions; jobs are found by id or else by their internal id."""
    c = candidates.select(F.col("candidate_id").alias("_c")).withColumn("has_candidate", F.lit(True))
    by_id = jobs.select(F.col("job_id").alias("_j")).withColumn("by_id", F.lit(True))
    by_key = jobs.select(F.col("internal_id").alias("_k"), F.col("job_id").alias("_kj")) if "internal_id" in jobs.columns else None
    out = applications.join(c, applications.candidate_id == c["_c"], "left").join(by_id, applications.job_id == by_id["_j"], "left")
    found = F.when(F.col("by_id"), F.col("job_id"))
    if by_key is not None:
        out = out.join(by_key, out.job_id == by_key["_k"], "left")
        found = F.coalesce(found, F.col("_kj"))
    out = out.withColumn("resolved_job", found)

    def blank(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    reason = (
        F.when(blank("application_id"), "applicationId is required").when(blank("candidate_id"), "candidateId is required")
        .when(blank("job_id"), "jobId is required").when(F.col("has_candidate").isNull(), "candidate not found")
        .when(F.col("resolved_job").isNull(), "job not found").otherwise("")
    )
    return out.withColumn("reason", reason).withColumn(
        "outcome", F.when(F.col("reason") == "", "READY").when(F.col("reason") == "candidate not found", "DELETED").otherwise("FAILED")
    ).drop("_c", "_j", "_k", "_kj", "has_candidate", "by_id")


def split_cache(candidates: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their parsed record, misses that still have to be parsed)."""
    joined = candidates.join(cache.withColumn("_hit", F.lit(True)), "candidate_id", "left")
    hits = joined.where("_hit").drop("_hit").withColumn("resume_source", F.lit("parsedJson"))
    misses = joined.where("_hit IS NULL").select(*candidates.columns).withColumn("resume_source", F.lit("s3"))
    return hits, misses


def outcome_rows(resolved: DataFrame, scores: DataFrame) -> DataFrame:
    """One result row per application: the score where it was scored, 0 with its outcome where not."""
    s = scores.select("job_id", "candidate_id", "total_score", "decision").withColumnRenamed("job_id", "resolved_job")
    joined = resolved.join(s, ["resolved_job", "candidate_id"], "left")
    return joined.select(
        "application_id", "candidate_id", "job_id", F.coalesce("total_score", F.lit(0)).alias("score"),
        F.when((F.col("outcome") == "READY") & F.col("total_score").isNotNull(), F.col("decision"))
        .when(F.col("outcome") == "READY", "FAILED").otherwise(F.col("outcome")).alias("decision"), "reason",
    )


def log_rows(results: DataFrame, created_at, created_by: str = "ats-worker") -> DataFrame:
    """Score log rows; FAILED and DELETED keep their own status, a success has a decision and none."""
    status = F.when(F.col("decision").isin("FAILED", "DELETED"), F.col("decision"))
    return results.select(
        "application_id", "candidate_id", "job_id", F.lit("SCORE").alias("stage"), "score", status.alias("status"), "decision",
        F.lit(created_by).alias("created_by"), created_at.alias("created_at"))


def upsert(applications: DataFrame, results: DataFrame, processed_at) -> DataFrame:
    """New snapshot of the applications: fresh results replace old ones, all else stays. Every outcome marks its
    application as processed, FAILED and DELETED as well, so that nothing is retried for ever."""
    r = results.select("application_id", F.col("score").alias("_s"), F.col("decision").alias("_d"))
    a = applications
    for name, kind in [("ats_score", "int"), ("ats_decision", "string"), ("processed_at", "timestamp")]:
        if name not in a.columns:
            a = a.withColumn(name, F.lit(None).cast(kind))
    hit = F.col("_s").isNotNull()
    return a.join(r, "application_id", "left").withColumns({
        "ats_score": F.coalesce("_s", "ats_score"), "ats_decision": F.coalesce("_d", "ats_decision"),
        "processed": hit | F.coalesce("processed", F.lit(False)),
        "processed_at": F.when(hit, processed_at).otherwise(F.col("processed_at")),
    }).drop("_s", "_d")


def set_status(applications: DataFrame, updates: DataFrame) -> DataFrame:
    """updates(application_id, new_status) applied to the snapshot."""
    return applications.join(updates, "application_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def write_cache(candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """Candidates with freshly parsed records (candidate_id, parsed) stored beside them; others keep what they have."""
    fresh = parsed.select("candidate_id", F.col("parsed").alias("_fresh"))
    stored = candidates if "parsed" in candidates.columns else candidates.withColumn("parsed", F.lit(None).cast(dict(parsed.dtypes)["parsed"]))
    return stored.join(fresh, "candidate_id", "left").withColumn("parsed", F.coalesce("_fresh", "parsed")).drop("_fresh")


def clear_cache(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates without parsed records, one row with the number of records that were there)."""
    count = candidates.agg(F.count("parsed").alias("cleared"))
    return candidates.withColumn("parsed", F.lit(None).cast(dict(candidates.dtypes)["parsed"])), count


def run_metrics(batches: DataFrame) -> DataFrame:
    """batches(processed, failed, seconds) -> totals, requests and average seconds per request (0 without requests)."""
    total = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return batches.agg(
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.round(total, 4).alias("total_seconds"), F.count(F.lit(1)).alias("requests"),
        F.round(total / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("avg_seconds_per_request"))


def batch_summary(results: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    failed, deleted = F.col("decision") == "FAILED", F.col("decision") == "DELETED"
    return results.groupBy().agg(
        F.count(F.lit(1)).alias("found"), n(~failed & ~deleted).alias("processed"), n(failed).alias("failed"), n(deleted).alias("deleted"))


def warnings_rollup(files: DataFrame, group: str, pos: str, segment: int = 4096) -> DataFrame:
    """One row per group: 'file: warning' in input order. Lines are ordered per `segment` input positions by many tasks;
    the last step only strings the segments of a group together."""
    lines = F.transform("warnings", lambda w: F.concat(F.col("file"), F.lit(": "), w))

    def in_order(key: str, value: str):
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]))

    rows = files.where(F.size("warnings") > 0).select(group, F.col(pos).alias("_p"), F.floor(F.col(pos) / segment).alias("_seg"), lines.alias("_w"))
    parts = rows.groupBy(group, "_seg").agg(in_order("_p", "_w").alias("_w"))
    return parts.groupBy(group).agg(in_order("_seg", "_w").alias("warnings"))
