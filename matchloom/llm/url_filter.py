"""URL rules by a sort-merge range join over reversed hosts, in DataFrame operations only.

A host becomes its labels in reverse order, so the hosts under a rule's host are one interval of keys, and the intervals
of all rules are nested or apart. A sweep over the sorted keys carries the stack of the rules whose intervals are open;
a url takes the longest rule on the stack of its host whose path begins its own. The sweep runs over distinct hosts, in
chunks of one domain that are split further by salts, so neither a frequent host nor a domain of many hosts is one task's
work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import cut

LAST = "\U0010ffff"  # sorts after every character of a host
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "array<struct<length:int,host_length:int,blocks:int,rule:string,path:string,verdict:string>>"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot: the key of a host begins with the keys of all its parents."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def chunk(k: Column) -> Column:
    return F.regexp_extract(k, "^[^.]*\\.(?:[^.]*\\.)?", 0)


def stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: its key, the stack while its interval is the innermost one, and the stack after it closes."""
    clean = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    host = F.translate("host", UPPER, LOWER)
    entry = F.struct(
        (F.length(host) + F.length("path")).alias("length"), F.length(host).alias("host_length"), (F.col("verdict") == "block").cast("int").alias("blocks"),
        F.concat(host, "path").alias("rule"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    nodes = clean.groupBy(key(host).alias("key")).agg(F.collect_set(entry).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "\\.", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    above = nodes.select("key", "own", F.explode(up).alias("parent")).where("parent <> key")
    found = above.join(nodes.select(F.col("key").alias("parent"), F.col("own").alias("theirs")), "parent")
    outer = found.groupBy("key").agg(F.flatten(F.collect_list("theirs")).alias("after"))
    return nodes.join(outer, "key", "left").select(
        "key", F.coalesce("after", F.array().cast(RULE)).alias("after")).join(nodes, "key").select(
        "key", F.concat("own", "after").alias("inside"), "after")


def sweep(hosts: DataFrame, nodes: DataFrame, salts: int) -> DataFrame:
    """(host, stack) of every distinct host: the boundary that precedes it in key order says which rules are open."""
    keyed = hosts.select("host", key(F.col("host")).alias("key")).withColumn("chunk", chunk(F.col("key")))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    # A rule for a whole top-level domain is open from the start of each of its chunks.
    top = nodes.where(F.col("key").rlike("^[^.]*\\.$")).select(F.col("key").alias("first"), F.col("inside").alias("stack"))
    begins = keyed.select("chunk", F.regexp_extract("chunk", "^[^.]*\\.", 0).alias("first")).distinct().join(top, "first", "left").select(
        "chunk", every, F.lit("").alias("key"), F.lit(0).alias("kind"), F.coalesce("stack", F.array().cast(RULE)).alias("stack"))
    deep = nodes.where(~F.col("key").rlike("^[^.]*\\.$")).withColumn("chunk", chunk(F.col("key")))
    opens = deep.select("chunk", every, "key", F.lit(0).alias("kind"), F.col("inside").alias("stack"))
    closes = deep.select("chunk", every, F.concat("key", F.lit(LAST)).alias("key"), F.lit(2).alias("kind"), F.col("after").alias("stack"))
    bounds = begins.union(opens).union(closes).withColumn("host", F.lit(None).cast("string"))
    mine = keyed.select("chunk", "salt", "key", F.lit(1).alias("kind"), F.lit(None).cast(RULE).alias("stack"), "host")
    order = Window.partitionBy("chunk", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return bounds.union(mine).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1").select("host", "stack")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = 16) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule (null where none fits), verdict (then `default`).

    The longest rule (host and path together) wins, then the longer host, then a block over an allow. Rules without a
    host, a path (may be empty) or one of the two verdicts are left out; repeated rules count once; no rules leave the
    default everywhere. A null url, or one without '://', has an empty host and path. Repeated rows and null ids are
    judged as they are; other columns are not read; an empty table gives an empty result.
    """
    host, path = parts(F.col("_url"))
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    found = cut(sweep(urls.select("host").distinct(), stacks(rules), salts).where(F.size("stack") > 0))
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    out = urls.join(found, "host", "left").withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
