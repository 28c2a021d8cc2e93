"""Intake of files: gate, stored objects, routing, page cap and assembly of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.config import DEFAULT
from matchloom.functions import text as tx


def gate(files: DataFrame, extensions=tuple(fv.SUPPORTED_EXTENSIONS), max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """files(name, size) with the reason why a file is not taken ('' when it is); rejects are rows, not errors."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    return files.withColumn("reject_reason", (
        F.when(~ext.isin(list(extensions)), "unsupported type").when(F.coalesce("size", F.lit(0)) == 0, "empty file")
        .when(F.col("size") > max_bytes, "too large").otherwise("")
    ))


def gate_requests(files: DataFrame, request: str, most: int = DEFAULT.max_files) -> DataFrame:
    """One row per request with its number of files and why it is turned down ('' when it is not)."""
    n = files.groupBy(request).agg(F.count("name").alias("files"))
    return n.withColumn("reject_reason", F.when(F.col("files") == 0, "At least one resume is required").when(
        F.col("files") > most, F.lit(f"Maximum {most} resumes are allowed per request")).otherwise(""))


def dedupe_files(files: DataFrame) -> DataFrame:
    """The same name and size is the same file."""
    return files.dropDuplicates(["name", "size"])


def lookup_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted(id, storage_key, file_name, mime_type) with the stored object or the outcome without one."""
    key = F.trim(F.coalesce("storage_key", F.lit("")))
    named = F.coalesce(F.when(F.trim("file_name") != "", F.trim("file_name")), F.when(F.substring_index(key, "/", -1) != "", F.substring_index(key, "/", -1)), F.lit("resume"))
    mime = F.coalesce(F.when(F.trim("mime_type") != "", F.trim("mime_type")), F.lit("application/octet-stream"))
    w = wanted.withColumns({"storage_key": key, "file_name": named, "mime_type": mime})
    o = objects.withColumnRenamed("storage_key", "_key").withColumn("_found", F.lit(True))
    return w.join(o, w.storage_key == o["_key"], "left").withColumn("outcome", (
        F.when(F.col("storage_key") == "", "FAILED").when(F.col("_found").isNull(), "DELETED").otherwise("FOUND")
    )).drop("_key", "_found")


def route(text: Column, min_chars: int = DEFAULT.min_text_chars) -> Column:
    """text, needs_vision or empty by the number of characters."""
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), fv.WHITESPACE + "+", ""))
    short = F.length(tx.strip_space(F.coalesce(text, F.lit("")))) < 5
    return F.when(solid >= min_chars, "text").when(short, "empty").otherwise("needs_vision")


def cap_pages(pages: DataFrame, doc: str, page: str, n: int = DEFAULT.max_pages) -> DataFrame:
    """First n pages per document (each map task keeps n per document) with a warning when there were more."""
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(doc).orderBy(page)
    first = pages.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    note = F.concat(F.lit(f"Processed only the first {n} pages out of "), F.col("_n").cast("string"))
    return first.join(counts, doc).withColumn("warning", F.when(F.col("_n") > n, note).otherwise("")).drop("_k", "_n")


def assemble(chunks: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Non-blank chunks joined by newlines in order: one text per document, as later steps read it."""
    t = tx.strip_space(F.coalesce(text, F.lit("")))
    good = chunks.select(doc, F.col(pos).alias("_p"), t.alias("_t")).where("_t <> ''")
    return good.groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n").alias("text"))
