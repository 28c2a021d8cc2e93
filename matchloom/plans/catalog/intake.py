"""Sources, sinks, application handling and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.config import DEFAULT as CFG
from matchloom.functions import scores as sc, text as tx
from matchloom.operators import pending as pn
from matchloom.plans import sqltext as s
from matchloom.plans.catalog import matching as m
from matchloom.plans.registry import query
from matchloom.session import shared_folder
from matchloom.sources import intake, sinks, views
from matchloom.sources.tables import table
from matchloom.streaming import worker


@query("intake_gate", "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported type' WHEN n_chars = 0 THEN 'empty file' WHEN n_chars > 20000 THEN 'too large' ELSE '' END AS reject_reason FROM documents")
def intake_gate(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("cv."), "lang").alias("name"), F.col("n_chars").alias("size"))
    return intake.gate(files, (".en", ".de", ".fr"), 20000).select("doc_id", "reject_reason")


@query("request_limit", "SELECT source, count(*) AS files, CASE WHEN count(*) > 100 THEN 'Maximum 100 resumes are allowed per request' ELSE '' END AS reject_reason FROM documents GROUP BY 1")
def request_limit(spark, sf):
    return intake.gate_requests(table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("name")), "source")


@query("dedupe_files", "SELECT DISTINCT source || '.' || lang AS name, n_chars AS size FROM documents")
def dedupe_files(spark, sf):
    files = table(spark, sf, "documents").select(F.concat_ws(".", "source", "lang").alias("name"), F.col("n_chars").alias("size"))
    return intake.dedupe_files(files)


@query("resume_object_lookup", """SELECT d.doc_id, CASE WHEN lang = 'fr' THEN '' ELSE 'cv/' || d.doc_id END AS storage_key, CASE WHEN lang = 'en' THEN 'resume.pdf' WHEN lang = 'fr' THEN 'resume' ELSE CAST(d.doc_id AS VARCHAR) END AS file_name,
  CASE WHEN lang = 'de' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type, CASE WHEN lang = 'fr' THEN 'FAILED' WHEN l.doc_id IS NULL THEN 'DELETED' ELSE 'FOUND' END AS outcome, CASE WHEN lang <> 'fr' THEN quality END AS quality
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def resume_object_lookup(spark, sf):
    key = F.concat(F.lit("cv/"), F.col("doc_id").cast("string"))
    wanted = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", " ").otherwise(key).alias("storage_key"),
        F.when(F.col("lang") == "en", "resume.pdf").alias("file_name"), F.when(F.col("lang") == "de", "text/plain").otherwise("").alias("mime_type"))
    objects = table(spark, sf, "labels").select(key.alias("storage_key"), "quality")
    return intake.lookup_objects(wanted, objects)


@query("text_route", f"""SELECT doc_id, CASE WHEN length(regexp_replace(text, {s.rx(s.WS + '+')}, '', 'g')) >= 300 THEN 'text' WHEN length(regexp_replace(text, {s.rx('^' + s.WS + '+|' + s.WS + '+$')}, '', 'g')) < 5 THEN 'empty' ELSE 'needs_vision' END AS route FROM documents""")
def text_route(spark, sf):
    return table(spark, sf, "documents").select("doc_id", intake.route(F.col("text")).alias("route"))


@query("page_cap", """SELECT conv_id, turn, text, CASE WHEN n > 5 THEN 'Processed only the first 5 pages out of ' || n ELSE '' END AS warning FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k <= 5""")
def page_cap(spark, sf):
    return intake.cap_pages(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@query("assemble_chunks", f"SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, regexp_replace(text, {s.rx('^' + s.WS + '+|' + s.WS + '+$')}, '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY 1")
def assemble_chunks(spark, sf):
    return intake.assemble(table(spark, sf, "conversations"), "conv_id", "turn", "text")


PENDING = """h_latest AS (SELECT application_id, list(status ORDER BY created_at DESC, status DESC NULLS LAST)[1] AS log_status FROM h_log WHERE stage = 'SCORE' GROUP BY 1),
h_pending AS (SELECT * FROM h_applications WHERE status = 'APPLIED' AND NOT processed AND application_id NOT IN (SELECT application_id FROM h_latest WHERE upper(coalesce(log_status, '')) <> 'FAILED'))"""


@query("pending_apps", s.with_(s.H_APPLICATIONS, s.H_LOG, PENDING) + "SELECT application_id, candidate_id, job_id FROM h_pending")
def pending_apps(spark, sf):
    return pn.pending(views.applications(spark, sf), views.score_log(spark, sf)).select("application_id", "candidate_id", "job_id")


@query("pending_batch", s.with_(s.H_APPLICATIONS, s.H_LOG, PENDING) + "SELECT application_id, candidate_id FROM h_pending ORDER BY applied_at, application_id LIMIT 25")
def pending_batch(spark, sf):
    return pn.pending_batch(views.applications(spark, sf), views.score_log(spark, sf)).select("application_id", "candidate_id")


def resolved(spark, sf):
    """Half of the applications name their job by its internal id."""
    apps = views.applications(spark, sf)
    apps = apps.withColumn("job_id", F.when(F.col("status") == "REVIEW", F.concat(F.lit("_"), "job_id")).otherwise(F.col("job_id")))
    jobs = views.jobs(spark, sf).select("job_id", F.concat(F.lit("_"), "job_id").alias("internal_id"))
    return pn.resolve(apps, views.candidates(spark, sf).select("candidate_id"), jobs)


RESOLVE = """h_resolved AS (SELECT a.application_id, a.candidate_id, j.job_id AS resolved_job, CASE WHEN a.job_id IS NULL THEN 'jobId is required' WHEN c_custkey IS NULL THEN 'candidate not found' WHEN j.job_id IS NULL THEN 'job not found' ELSE '' END AS reason
  FROM h_applications a LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = a.candidate_id LEFT JOIN h_jobs j ON j.job_id = a.job_id)"""
_outcome = "CASE reason WHEN '' THEN 'READY' WHEN 'candidate not found' THEN 'DELETED' ELSE 'FAILED' END"


@query("resolve_apps", s.with_(s.H_JOBS, s.H_APPLICATIONS, RESOLVE) + f"SELECT application_id, candidate_id, resolved_job, reason, {_outcome} AS outcome FROM h_resolved")
def resolve_apps(spark, sf):
    return resolved(spark, sf).select("application_id", "candidate_id", "resolved_job", "reason", "outcome")


@query("cache_split", s.with_(s.H_CANDIDATES) + "SELECT candidate_id, CASE WHEN email <> '' THEN name END AS parsed, CASE WHEN email <> '' THEN 'parsedJson' ELSE 's3' END AS resume_source FROM h_candidates")
def cache_split(spark, sf):
    people = views.candidates(spark, sf)
    cache = people.where("email <> ''").select("candidate_id", F.col("name").alias("parsed"))
    hits, misses = pn.split_cache(people.select("candidate_id"), cache)
    return hits.unionByName(misses, allowMissingColumns=True)


@query("cache_write", s.with_(s.H_CANDIDATES) + "SELECT candidate_id, CASE WHEN email = '' THEN 'new ' || name ELSE name END AS parsed FROM h_candidates")
def cache_write(spark, sf):
    people = views.candidates(spark, sf)
    stored = people.select("candidate_id", F.when(F.col("email") != "", F.col("name")).alias("parsed"))
    fresh = people.where("email = ''").select("candidate_id", F.concat(F.lit("new "), "name").alias("parsed"))
    return pn.write_cache(stored, fresh)


@query("cache_clear", s.with_(s.H_CANDIDATES) + "SELECT count(*) FILTER (email <> '') AS cleared FROM h_candidates")
def cache_clear(spark, sf):
    return pn.clear_cache(views.candidates(spark, sf).select("candidate_id", F.when(F.col("email") != "", F.col("name")).alias("parsed")))[1]


@query("run_metrics", "SELECT CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS processed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, round(sum(value), 4) AS total_seconds, count(*) AS requests, round(sum(value) / count(*), 2) AS avg_seconds_per_request FROM events")
def run_metrics(spark, sf):
    failed = (F.col("event_type") == "error").cast("int")
    return pn.run_metrics(table(spark, sf, "events").select((1 - failed).alias("processed"), failed.alias("failed"), F.col("value").alias("seconds")))


def results(spark, sf):
    scores = m.scored(spark, sf, columns=["job_id", "candidate_id", "total_score"]).select("job_id", "candidate_id", "total_score", sc.decision(F.col("total_score")).alias("decision"))
    return pn.outcome_rows(resolved(spark, sf), scores)


RESULTS = f"""o_results AS (SELECT r.application_id, r.candidate_id, coalesce(total_score, 0) AS score, reason, r.resolved_job,
  CASE WHEN reason <> '' THEN {_outcome} WHEN total_score IS NULL THEN 'FAILED' WHEN total_score >= 80 THEN 'SHORTLISTED' ELSE 'REJECTED' END AS decision
  FROM h_resolved r LEFT JOIN o_scored sc ON sc.job_id = r.resolved_job AND sc.candidate_id = r.candidate_id)"""


def chain(select):
    return m.chain("O_SCORE", "").rstrip() + ",\n" + RESOLVE + ",\n" + RESULTS + "\n" + select


@query("outcomes", chain("SELECT application_id, candidate_id, score, decision, reason FROM o_results"))
def outcomes(spark, sf):
    return results(spark, sf).drop("job_id")


@query("score_log_rows", chain("SELECT application_id, candidate_id, 'SCORE' AS stage, score, CASE WHEN decision IN ('FAILED', 'DELETED') THEN decision END AS status, decision, 'ats-worker' AS created_by FROM o_results"))
def score_log_rows(spark, sf):
    return pn.log_rows(results(spark, sf), F.current_timestamp()).drop("created_at", "job_id")


@query("upsert_results", chain("SELECT application_id, a.status, r.score AS ats_score, r.decision AS ats_decision, true AS processed FROM h_applications a JOIN o_results r USING (application_id)"))
def upsert_results(spark, sf):
    out = pn.upsert(views.applications(spark, sf), results(spark, sf), F.current_timestamp())
    return out.select("application_id", "status", "ats_score", "ats_decision", "processed")


@query("status_update", s.with_(s.H_APPLICATIONS) + "SELECT application_id, CASE WHEN candidate_id < 100 THEN 'SHORTLISTED' ELSE status END AS status FROM h_applications")
def status_update(spark, sf):
    apps = views.applications(spark, sf)
    updates = apps.where("candidate_id < 100").select("application_id", F.lit("SHORTLISTED").alias("new_status"))
    return pn.set_status(apps, updates).select("application_id", "status")


@query("batch_summary", chain("SELECT count(*) AS found, count(*) FILTER (decision NOT IN ('FAILED', 'DELETED')) AS processed, count(*) FILTER (decision = 'FAILED') AS failed, count(*) FILTER (decision = 'DELETED') AS deleted FROM o_results"))
def batch_summary(spark, sf):
    return pn.batch_summary(results(spark, sf))


@query("warnings_rollup", """SELECT source, list(lang || doc_id || ': long text' ORDER BY doc_id) AS warnings FROM documents WHERE n_chars > 2000 GROUP BY 1""")
def warnings_rollup(spark, sf):
    files = table(spark, sf, "documents").select(
        "source", "doc_id", F.concat(F.col("lang"), F.col("doc_id").cast("string")).alias("file"),
        F.when(F.col("n_chars") > 2000, F.array(F.lit("long text"))).otherwise(tx.strings([])).alias("warnings"))
    return pn.warnings_rollup(files, "source", "doc_id")


_EXPORTED = ["job_id", "candidate_id", "total_score", "matched", "missing", "strengths", "risks"]


@query("export_json", m.chain("O_SCORE", f"SELECT job_id, candidate_id, to_json(struct_pack({', '.join(f'{c} := {c}' for c in _EXPORTED)}))::VARCHAR AS json\n"
       f"FROM (SELECT *, {m.STRENGTHS_SQL} AS strengths, {m.RISKS_SQL} AS risks FROM o_scored)"))
def export_json(spark, sf):
    return sinks.as_json(m.scored(spark, sf, columns=_EXPORTED), "job_id", "candidate_id")


def _stream(spark, sf, deliveries: int):
    """Write the applications as files (each ``deliveries`` times), replay them through the stream, return the log.

    Every batch with something due shuffles the profiles of all candidates, so a delivery is a fixed number of files, one
    batch, whatever its size; repeated deliveries are copies of the first one's files.
    """
    base, files = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}", max(1, 8 // deliveries)
    views.applications(spark, sf).repartition(files, "application_id").write.parquet(f"{base}/in/part0")
    for n in range(1, deliveries):
        spark.read.parquet(f"{base}/in/part0").write.parquet(f"{base}/in/part{n}")
    profiles = m.profiles(spark, sf)
    from matchloom.plans import scoring

    def score(due):
        found = pn.resolve(due, profiles.people.select("candidate_id"), profiles.jobs.select("job_id"))
        ready = found.where("outcome = 'READY'").select(F.col("resolved_job").alias("job_id"), "candidate_id")
        totals = scoring.score_pairs(ready, profiles, columns=["job_id", "candidate_id", "total_score"])
        return pn.outcome_rows(found, totals.withColumn("decision", sc.decision(F.col("total_score"))))

    stream = worker.application_stream(spark, f"{base}/in/*", files_per_batch=files)
    worker.start(stream, score, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return worker.read_log(spark, f"{base}/log", worker.RESULT_SCHEMA)


STREAM = """SELECT r.application_id, r.score, r.decision FROM o_results r JOIN h_applications a USING (application_id)
  WHERE a.status = 'APPLIED' AND NOT a.processed"""


@query("stream_score", chain(STREAM))
def stream_score(spark, sf):
    return _stream(spark, sf, 1).select("application_id", "score", "decision")


@query("exactly_once", chain(STREAM.replace("SELECT r.application_id, r.score, r.decision", "SELECT r.application_id, 1::BIGINT AS n")))
def exactly_once(spark, sf):
    return _stream(spark, sf, 2).groupBy("application_id").agg(F.count(F.lit(1)).alias("n"))


@query("ops_counters", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ops_counters(spark, sf):
    return worker.counters(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
