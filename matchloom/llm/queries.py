"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import byte_bpe, decontaminate, filter_audit, html_extract, license_scan, merkle, ngram_join, quality, secret_scan, token_counts, token_file, url_filter, warc
from matchloom.sources.tables import table

WORD_BPE, MULTI_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), limit=2048)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
ORACLES["op3_url_filter"] = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
     cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
     m AS (SELECT p.*, rhost || rpath AS rule, rverdict,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
           FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "n_tokens", "chars_per_token", "fallback_share", "token_entropy")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM r
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=1000)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op11_filter_audit"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * upper > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS ord FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT ord, k, substr(ord, k, 1) AS f, substr(ord, 1, k - 1) AS earlier FROM o, range(1, 6) r(k)),
j AS (SELECT *, contains(fails, f) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '.]') AS gone FROM c, s),
r AS (SELECT part, ord AS filter_order, k::INT AS step, f, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
             sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
             sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, of_kind, listed = secret_scan.secrets(table(spark, sf_dir, "documents")), secret_scan.of_kind, secret_scan.listed
    base = of_kind(F.col("spans"), "assign", "access", "hex")
    counts = [F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "novel")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Root of the corpus by a recursive tree per source; only the last bit of the crc32 is needed, bit by bit over the digits.
ORACLES["op13_merkle_manifest"] = """
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, n_chars, text,
             list_reduce(list_concat([4294967295], flatten([[(ascii(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')])),
                         lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)) % 2 = 1 AS tampered FROM documents),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS altered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n AS (SELECT source, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS wide FROM p
      UNION ALL
      SELECT source, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(wide) + 2) // 3 FROM n WHERE wide > 1 GROUP BY source, lvl, pos // 3),
r AS (SELECT source, digest, row_number() OVER (ORDER BY encode(coalesce('=' || source, ''))) - 1 AS pos, lvl AS height FROM n WHERE wide = 1),
o AS (SELECT 0 AS lvl, pos, digest, count(*) OVER () AS wide FROM r
      UNION ALL
      SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(wide) + 2) // 3 FROM o WHERE wide > 1 GROUP BY lvl, pos // 3),
a AS (SELECT source, lvl, pos, lvl AS step, digest FROM n WHERE wide > 1),
w AS (SELECT source, lvl, pos, coalesce(lag(digest, 2) OVER g, '') AS l2, coalesce(lag(digest) OVER g, '') AS l1,
             coalesce(lead(digest) OVER g, '') AS r1, coalesce(lead(digest, 2) OVER g, '') AS r2 FROM a WINDOW g AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos)),
v AS (SELECT lvl, pos, coalesce(lag(digest, 2) OVER g, '') AS l2, coalesce(lag(digest) OVER g, '') AS l1,
             coalesce(lead(digest) OVER g, '') AS r1, coalesce(lead(digest, 2) OVER g, '') AS r2 FROM o WHERE wide > 1 WINDOW g AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
up AS (SELECT p.doc_id, p.leaf, p.altered, p.source, p.pos, 0 AS lvl, p.altered AS acc, '' AS proof, r.height, r.pos AS place, r.digest AS subroot
       FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
       UNION ALL
       SELECT up.doc_id, leaf, altered, up.source, up.pos // 3, up.lvl + 1, sha256(l2 || l1 || acc || r1 || r2), proof || l2 || l1 || r1 || r2, height, place, subroot
       FROM up JOIN w ON up.source IS NOT DISTINCT FROM w.source AND up.lvl = w.lvl AND up.pos = w.pos WHERE up.lvl < height),
top AS (SELECT doc_id, leaf, subroot, place AS pos, 0 AS lvl, acc, proof FROM up WHERE lvl = height
        UNION ALL
        SELECT doc_id, leaf, subroot, top.pos // 3, top.lvl + 1, sha256(l2 || l1 || acc || r1 || r2), proof || l2 || l1 || r1 || r2
        FROM top JOIN v ON top.lvl = v.lvl AND top.pos = v.pos)
SELECT doc_id, leaf, subroot, o.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = o.digest AS verified
FROM top JOIN o ON o.wide = 1 AND top.lvl = o.lvl
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
