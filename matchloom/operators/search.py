"""Best match at any similarity: the closest of a candidate's own terms to a term that nothing close was found for.

The pair tables stop at a floor. For the (candidate, query) pairs that are left, similarity is the best of word overlap,
cosine and, if wanted, sequence ratio; equality, initials, subsets and graph edges all lie above any floor in use.
Only terms of the same candidate are met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import similarity as sm

QUERIES = 256  # queries of one candidate that are searched in one row


def by_words(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(candidate_id, query, term, sim) of all terms that share a token with the query, each pair once."""
    def with_tokens(rows: DataFrame, name: str, mark: str) -> DataFrame:
        f = sm.features(rows.select(F.col(name).alias("term")).distinct()).select(F.col("term").alias(name), F.col("toks").alias(f"{mark}_toks"))
        return rows.join(f, name).withColumn("k", F.explode(f"{mark}_toks"))

    first = F.get(F.array_intersect("q_toks", "t_toks"), F.lit(0)) == F.col("k")
    met = with_tokens(asked, "query", "q").join(with_tokens(own, "term", "t"), ["candidate_id", "k"]).where(first)
    return met.select("candidate_id", "query", "term", sm.token_value(F.col("q_toks"), F.col("t_toks")).alias("sim"))


def by_vectors(asked: DataFrame, own: DataFrame, vectors: DataFrame) -> DataFrame:
    """The same for terms with a vector on both sides; a cosine is worked out once per pair of terms."""
    q = sm.canonical_vectors(sm.features(asked.select(F.col("query").alias("term")).distinct()), vectors)
    t = sm.canonical_vectors(sm.features(own.select("term").distinct()), vectors)
    met = asked.join(q.select(F.col("term").alias("query")), "query").join(own.join(t.select("term"), "term"), "candidate_id")
    cos = sm.cosine(met.select(F.col("query").alias("l"), F.col("term").alias("r")), q.union(t).dropDuplicates(["term"]))
    return met.join(cos.select(F.col("l").alias("query"), F.col("r").alias("term"), F.round("cos", 12).alias("sim")), ["query", "term"]).select(
        "candidate_id", "query", "term", "sim")


def best_ratio(query: str, best: float, term: str, own: list[tuple[str, str, Counter]]) -> tuple[float, str]:
    """Terms in order of their bound (characters in common); stops when the bound falls below the best so far."""
    chars = Counter(query)
    bounds = sorted(((-2 * sum((chars & c).values()) / (len(query) + len(form)), name, form) for name, form, c in own))
    for bound, name, form in bounds:
        if -bound < best or bound == 0:
            break
        sim = SequenceMatcher(None, query, form).ratio()
        if sim > best or (sim == best and name < term):
            best, term = sim, name
    return best, term


def by_ratio(found: DataFrame, own: DataFrame) -> DataFrame:
    """found(candidate_id, query, sim, term) with the sequence ratio taken in; a row holds a candidate's terms and some
    of its queries."""
    forms = lambda rows, name: rows.join(sm.features(rows.select(F.col(name).alias("term")).distinct()).select(F.col("term").alias(name), "c"), name)
    terms = forms(own, "term").groupBy("candidate_id").agg(F.collect_list(F.struct("term", "c")).alias("own"))
    n = F.expr("pmod(xxhash64(query), greatest(1, ceil(count(*) OVER (PARTITION BY candidate_id) / %d)))" % QUERIES)
    asked = forms(found, "query").withColumn("chunk", n).groupBy("candidate_id", "chunk").agg(F.collect_list(F.struct("query", "c", "sim", "term")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"candidate_id": [], "query": [], "sim": [], "term": []}
            for row in batch.to_pylist():
                mine = [(x["term"], x["c"], Counter(x["c"])) for x in row["own"]]
                for q in row["asked"]:
                    best, term = best_ratio(q["c"], q["sim"] or 0.0, q["term"] or "", mine)
                    for name, value in zip(rows, (row["candidate_id"], q["query"], best, term)):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["candidate_id"], batch.schema.field("candidate_id").type), pa.array(rows["query"], pa.string()),
                 pa.array(rows["sim"], pa.float64()), pa.array(rows["term"], pa.string())], names=list(rows))

    kind = dict(found.dtypes)["candidate_id"]
    return asked.join(terms, "candidate_id").mapInArrow(run, f"candidate_id {kind}, query string, sim double, term string")


def best_of_own(asked: DataFrame, own: DataFrame, ratio: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """asked(candidate_id, query), own(candidate_id, term) -> the best term of each query above 0: (candidate_id, query,
    sim, term), the alphabetically first of equals. Queries without any are left out."""
    asked, own = asked.distinct(), own.select("candidate_id", "term").distinct().join(asked.select("candidate_id").distinct(), "candidate_id", "left_semi")
    met = by_words(asked, own)
    if vectors is not None:
        met = met.union(by_vectors(asked, own, vectors))
    best = met.where("sim > 0").groupBy("candidate_id", "query").agg(F.min(F.struct((-F.col("sim")).alias("n"), "term")).alias("b"))
    found = best.select("candidate_id", "query", (-F.col("b.n")).alias("sim"), F.col("b.term").alias("term"))
    if ratio:
        found = by_ratio(asked.join(found, ["candidate_id", "query"], "left"), own)
    return found.where("sim > 0 AND term <> ''")
