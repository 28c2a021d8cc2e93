"""Table readers. Parquet carries its own schema; JSON sources always get an explicit one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

APPLICATION_SCHEMA = (
    "application_id BIGINT, candidate_id BIGINT, job_id STRING, status STRING, processed BOOLEAN, "
    "applied_at TIMESTAMP"
)
LOG_SCHEMA = (
    "application_id BIGINT, candidate_id BIGINT, job_id STRING, stage STRING, score INT, status STRING, "
    "created_at TIMESTAMP"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def resume_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Stored résumé files: one row per object with its key, length and bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def files_state(spark: SparkSession, folder: str, *names: str) -> tuple:
    """Path, time of change and length of the files of some tables: what a result that was kept was made from. Only the
    listing is read."""
    found = []
    for name in names:
        files = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet").select("path", "modificationTime", "length")
        found += [(r.path, str(r.modificationTime), r.length) for r in files.collect()]
    return tuple(sorted(found))
