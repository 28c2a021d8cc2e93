"""Applications of a candidate compared with their jobs in the candidate's row, by arrays over a batch of candidates.

Where the pair table and the lists of all jobs are small (`MOST_JOB_TERMS`), every task knows them. A candidate then comes
once, with the jobs applied to, and nothing is joined, exploded or regrouped per application; what an application needs of
its job and its candidate is looked up by number. Larger tables are joined (`scoring.pair_features`), with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.functions import text as tx
from matchloom.operators import near

MOST_JOB_TERMS = 300_000  # terms in all lists of all jobs
CELLS = 400_000  # numbers in a table of candidates by terms
NUMBERS = {
    "n_matched": "int", "n_critical": "int", "n_additional": "int", "n_tags": "int", "required_credit": "double", "preferred_credit": "double",
    "proof": "double", "domain_alignment": "double", "keyword_ratio": "double", "education_cover": "double", "certificate_cover": "double",
}
LISTS = {k: "array<string>" for k in ("matched", "missing", "critical", "additional", "tags", "excluded")}
_DETAIL = "array<struct<jd_skill: string, member: string, matched_skill: string, similarity: double, is_match: boolean, weight: double>>"
DETAILS = {
    "required_details": _DETAIL, "preferred_details": _DETAIL,
    "additional_details": "array<struct<n: double, resume_skill: string, jd_context_match: string, similarity: double>>",
    "domain_detection": "array<struct<n: double, jd_domain_tag: string, matched_resume_term: string>>",
}
FEATURES = NUMBERS | LISTS | DETAILS
COVERS = {  # number: (kind of own terms, lists of the job)
    "domain_alignment": ("domain", ("domain_own", "keywords")), "keyword_ratio": ("keyword", ("keywords",)),
    "education_cover": ("education", ("education_ref",)), "certificate_cover": ("certificate", ("certificate_ref",)),
}


@dataclass
class Lists:
    """Lists of whole numbers, one after the other."""

    values: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        return cls(np.array([x for row in lists for x in row], np.int64), np.cumsum([0, *map(len, lists)]))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, place in ``values``) of all items of some lists, list by list."""
        n = self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return at, np.arange(len(at)) + np.repeat(self.ends[rows] - (np.cumsum(n) - n), n)


@dataclass
class Board:
    """The pair table and all jobs by numbers: queries and terms in alphabetical order, similarities from the largest on."""

    cfg: MatchConfig
    job_ids: pa.Array
    jobs: pa.Table
    kinds: dict[str, str]  # types of the columns of jobs
    queries: pa.Array
    terms: pa.Array
    sims: np.ndarray  # one more at the end: nothing found
    shown: np.ndarray  # the same at three digits
    close: Lists  # per term
    close_keys: np.ndarray  # (similarity, term), aligned with close.values
    members: Lists  # required: queries of all clusters of a job
    first: np.ndarray  # per member: does a cluster begin?
    canonical: np.ndarray  # per member: the query that names its cluster
    preferred: Lists
    centres: Lists
    refs: dict[str, Lists]
    context: np.ndarray  # sorted job * terms + term
    context_n: np.ndarray
    context_query: np.ndarray
    context_shown: np.ndarray


def board(jobs: DataFrame, pairs: DataFrame, scalars: list[str], cfg: MatchConfig) -> Board | None:
    """What every task has to know, or nothing if it is too much."""
    names = ["domain_centres", "domain_own", "keywords", "education_ref", "certificate_ref"]
    size = F.size("context_near") + sum((F.size(c) for c in names), F.lit(0))
    for c in ("required_clusters", "preferred_clusters"):
        size = size + F.aggregate(c, F.lit(0), lambda s, x: s + F.size(x["members"]))
    if (jobs.agg(F.sum(F.coalesce(size, F.lit(0)))).first()[0] or 0) > MOST_JOB_TERMS:
        return None
    rows = near.small_rows(pairs.where((F.col("sim") >= cfg.floor) | (F.col("back") >= cfg.floor)).select("l", "r", "sim", tx.half_even(F.col("sim"), 3).alias("shown")))
    if rows is None:
        return None
    order = jobs.orderBy("job_id")
    lists = order.select("job_id", "required_clusters", "preferred_clusters", *names, F.transform_values(
        "context_near", lambda k, v: F.struct(v["n"].alias("n"), v["query"].alias("query"), tx.half_even(-v["n"], 3).alias("shown"))).alias("context_near")).collect()
    given = order.select("job_id", *scalars)
    table = given.toArrow().combine_chunks()
    hits = [(l, r, sim, shown) for l, r, sim, shown in rows if sim >= cfg.floor]
    queries, terms = {h[0] for h in hits}, {r[1] for r in rows}
    for j in lists:
        queries.update(*[getattr(j, n) for n in names], *[c.members for c in [*j.required_clusters, *j.preferred_clusters]])
        queries.update(c.canonical for c in [*j.required_clusters, *j.preferred_clusters])
        queries.update(v.query for v in (j.context_near or {}).values())
        terms.update(j.context_near or {})
    queries, terms = sorted(queries), sorted(terms)
    q, t = ({v: i for i, v in enumerate(x)} for x in (queries, terms))
    shown = {h[2]: h[3] for h in hits}
    sims = sorted(shown, reverse=True)
    rank = {v: i for i, v in enumerate(sims)}
    close: list[list[tuple[int, int]]] = [[] for _ in terms]
    for l, r, sim, _ in hits:
        close[t[r]].append((q[l], rank[sim] * len(terms) + t[r]))
    members = [[(q[m], i == 0, q[c.canonical]) for c in j.required_clusters for i, m in enumerate(c.members)] for j in lists]
    around = sorted((i * len(terms) + t[k], v.n, q[v.query], v.shown) for i, j in enumerate(lists) for k, v in (j.context_near or {}).items())
    by = lambda rows, i, kind: np.array([x[i] for row in rows for x in row], kind)
    refs = {c: Lists.of([[q[x] for n in ref for x in getattr(j, n)] for j in lists]) for c, (_, ref) in COVERS.items()}
    return Board(
        cfg, table.column("job_id").combine_chunks(), table, dict(given.dtypes), pa.array(queries, pa.string()), pa.array(terms, pa.string()),
        np.array([*sims, 0.0]), np.array([*[shown[x] for x in sims], 0.0]), Lists.of([[x[0] for x in row] for row in close]), by(close, 1, np.int64),
        Lists.of([[x[0] for x in row] for row in members]), by(members, 1, bool), by(members, 2, np.int64),
        Lists.of([[q[c.canonical] for c in j.preferred_clusters] for j in lists]), Lists.of([[q[x] for x in j.domain_centres] for j in lists]), refs,
        *[np.array([x[i] for x in around], kind) for i, kind in enumerate([np.int64, float, np.int64, float])])


class Batch:
    """Some candidates, each with own terms per kind and jobs applied to; features are made when they are asked for."""

    def __init__(self, b: Board, batch: pa.RecordBatch):
        self.b, self.batch, self.n = b, batch, batch.num_rows
        self.nt, self.nq, self.none = max(1, len(b.terms)), max(1, len(b.queries)), len(b.sims) - 1
        jobs = batch.column("jobs")
        self.row = np.repeat(np.arange(self.n), self.lengths("jobs"))
        at = pc.index_in(jobs.flatten(), value_set=b.job_ids)
        known = at.is_valid().to_numpy(zero_copy_only=False)  # an application to a job that is not there has no score
        self.row, self.job = self.row[known], at.drop_null().to_numpy().astype(np.int64)
        self.made: dict = {}

    def once(self, name: str, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def lengths(self, name: str) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(self.batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def ids(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, place in the flat list) of the own terms that the pair table knows."""
        at = pc.index_in(self.batch.column(name).flatten(), value_set=self.b.terms)
        place = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        return np.repeat(np.arange(self.n), self.lengths(name))[place], at.drop_null().to_numpy().astype(np.int64), place

    def best(self, kind: str) -> np.ndarray:
        """Per row and query the smallest (similarity, term)."""
        def make():
            row, term, _ = self.ids(kind)
            at, item = self.b.close.take(term)
            out = np.full(self.n * self.nq, self.none * self.nt, np.int64)
            np.minimum.at(out, row[at] * self.nq + self.b.close.values[item], self.b.close_keys[item])
            return out

        return self.once("best " + kind, make)

    def weight(self, name: str) -> np.ndarray:
        def make():
            row, term, place = self.ids("skill")
            out = np.zeros(self.n * self.nt)
            out[row * self.nt + term] = self.batch.column(name).flatten().to_numpy(zero_copy_only=False)[place]
            return out

        return self.once(name, make)

    def found(self, pair: np.ndarray, key: np.ndarray, least: float) -> dict[str, np.ndarray]:
        rank, term = key // self.nt, key % self.nt
        hit, spot = rank < self.none, self.row[pair] * self.nt + term
        return {"pair": pair, "hit": hit, "term": term, "shown": self.b.shown[rank], "match": hit & (self.b.sims[rank] >= least), "spot": spot}

    def required(self) -> dict[str, np.ndarray]:
        def make():
            pair, item = self.b.members.take(self.job)
            if not len(pair):
                return {"canonical": item, "member": item} | self.found(pair, item, 1.0)
            key = self.best("skill")[self.row[pair] * self.nq + self.b.members.values[item]]
            start = np.flatnonzero(self.b.first[item])
            span = int(np.diff([*start, len(item)]).max())
            place = np.arange(len(item)) - np.repeat(start, np.diff([*start, len(item)]))
            chosen = start + np.minimum.reduceat(key // self.nt * span + place, start) % span  # the earliest of equals
            out = self.found(pair[start], key[chosen], self.b.cfg.required)
            canonical = self.b.canonical[item[start]]
            return out | {"canonical": canonical, "member": np.where(out["hit"], self.b.members.values[item[chosen]], canonical)}

        return self.once("required", make)

    def preferred(self) -> dict[str, np.ndarray]:
        def make():
            pair, item = self.b.preferred.take(self.job)
            query = self.b.preferred.values[item]
            out = self.found(pair, self.best("skill")[self.row[pair] * self.nq + query], self.b.cfg.semantic)
            return out | {"canonical": query, "member": query}

        return self.once("preferred", make)

    def of(self, d: dict[str, np.ndarray], name: str) -> np.ndarray:
        return np.where(d["hit"], self.weight(name)[d["spot"]], 0.0)

    def credit(self, shown: np.ndarray) -> np.ndarray:
        return np.where(shown >= self.b.cfg.semantic, 1.0, np.where(shown >= self.b.cfg.partial, 0.5, 0.0))

    def total(self, pair: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(pair, values, len(self.row))  # one after the other, as SQL adds them

    def count(self, pair: np.ndarray) -> np.ndarray:
        return np.bincount(pair, minlength=len(self.row)).astype(np.int32)

    def cover(self, name: str) -> np.ndarray:
        kind, cfg = COVERS[name][0], self.b.cfg
        pair, item = self.b.refs[name].take(self.job)
        rank = self.best(kind)[self.row[pair] * self.nq + self.b.refs[name].values[item]] // self.nt
        share = np.where(self.b.sims >= cfg.semantic, 1.0, np.where(self.b.sims >= cfg.partial, 0.5, 0.0))
        wanted, has = self.count(pair), (self.lengths(kind) > 0)[self.row]
        return np.where(wanted == 0, 1.0, np.where(has, self.total(pair, share[rank]) / np.maximum(wanted, 1), 0.0))

    def excluded(self) -> np.ndarray:
        def make():
            r, p = self.required(), self.preferred()
            strong = p["hit"] & (p["shown"] >= self.b.cfg.required)
            return np.unique(np.concatenate([r["pair"][r["match"]] * self.nt + r["term"][r["match"]], p["pair"][strong] * self.nt + p["term"][strong]]))

        return self.once("excluded", make)

    def additional(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, term, place in the context) of the listed skills close to the job's context, most similar first."""
        def make():
            row, term, _ = self.ids("open_skills")
            pair, item = Lists(term, np.searchsorted(row, np.arange(self.n + 1))).take(self.row)
            term = term[item]
            key = self.job[pair] * self.nt + term
            at = np.searchsorted(self.b.context, key)
            good = at < len(self.b.context)
            good[good] = self.b.context[at[good]] == key[good]
            pair, term, at = pair[good], term[good], at[good]
            free = ~np.isin(pair * self.nt + term, self.excluded())
            pair, term, at = pair[free], term[free], at[free]
            order = np.lexsort((term, self.b.context_n[at], pair))
            return pair[order], term[order], at[order]

        return self.once("additional", make)

    def tags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, query, key) of the domain centres with a close centre of the candidate, most similar first."""
        def make():
            pair, item = self.b.centres.take(self.job)
            query = self.b.centres.values[item]
            key = self.best("centre")[self.row[pair] * self.nq + query]
            good = (key // self.nt < self.none) & (self.b.sims[key // self.nt] >= self.b.cfg.additional)
            pair, query, key = pair[good], query[good], key[good]
            order = np.lexsort((query, key // self.nt, pair))
            return pair[order], query[order], key[order]

        return self.once("tags", make)

    def listed(self, pair: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *self.count(pair)]), pa.int32()), values)

    def queries(self, at: np.ndarray) -> pa.Array:
        return self.b.queries.take(pa.array(at))

    def terms(self, at: np.ndarray, hit: np.ndarray | None = None) -> pa.Array:
        return self.b.terms.take(pa.array(at)) if hit is None else pc.fill_null(self.b.terms.take(pa.array(at, mask=~hit)), "")

    def details(self, d: dict[str, np.ndarray]) -> pa.Array:
        return self.listed(d["pair"], pa.StructArray.from_arrays(
            [self.queries(d["canonical"]), self.queries(d["member"]), self.terms(d["term"], d["hit"]), pa.array(d["shown"]), pa.array(d["match"]), pa.array(self.of(d, "weight"))],
            names=["jd_skill", "member", "matched_skill", "similarity", "is_match", "weight"]))

    def feature(self, name: str) -> pa.Array:
        cfg = self.b.cfg
        if name in COVERS:
            return pa.array(self.cover(name))
        if name in ("n_additional", "additional", "additional_details"):
            pair, term, at = self.additional()
            if name == "n_additional":
                return pa.array(self.count(pair))
            return self.listed(pair, self.terms(term) if name == "additional" else pa.StructArray.from_arrays(
                [pa.array(self.b.context_n[at]), self.terms(term), self.queries(self.b.context_query[at]), pa.array(self.b.context_shown[at])],
                names=["n", "resume_skill", "jd_context_match", "similarity"]))
        if name in ("n_tags", "tags", "domain_detection"):
            pair, query, key = self.tags()
            if name == "n_tags":
                return pa.array(self.count(pair))
            return self.listed(pair, self.queries(query) if name == "tags" else pa.StructArray.from_arrays(
                [pa.array(-self.b.sims[key // self.nt]), self.queries(query), self.terms(key % self.nt)], names=["n", "jd_domain_tag", "matched_resume_term"]))
        if name == "excluded":
            return self.listed(self.excluded() // self.nt, self.terms(self.excluded() % self.nt))
        if name == "preferred_credit":
            p = self.preferred()
            return pa.array(self.total(p["pair"], self.credit(p["shown"]) * self.of(p, "weight")))
        if name == "preferred_details":
            return self.details(self.preferred())
        r = self.required()
        if name == "required_details":
            return self.details(r)
        if name == "required_credit":
            return pa.array(self.total(r["pair"], np.where(r["match"], self.credit(r["shown"]) * self.of(r, "weight"), 0.0)))
        if name == "proof":
            return pa.array(self.total(r["pair"], np.where(r["match"], self.of(r, "shown_weight"), 0.0)))
        which = {"matched": r["match"], "missing": ~r["match"], "critical": r["shown"] < cfg.partial}["matched" if name == "n_matched" else "critical" if name == "n_critical" else name]
        return pa.array(self.count(r["pair"][which])) if name in NUMBERS else self.listed(r["pair"][which], self.queries(r["canonical"][which]))


#: Columns of a candidate's row that features are made from.
OWN = ["jobs", "skill", "weight", "shown_weight", "domain", "centre", "certificate", "keyword", "education", "open_skills"]


def compare(rows: DataFrame, known: Board, of_job: list[str], features: list[str]) -> DataFrame:
    """rows(OWN and other columns), one per candidate -> one row per application: the other columns, those asked of its job,
    and the features."""
    others = [c for c in rows.columns if c not in OWN]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        jobs = {c: b.jobs.column(c).combine_chunks() for c in of_job}
        step = max(1, CELLS // (len(b.terms) + len(b.queries) + 1))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                part = Batch(b, whole.slice(start, step))
                row, job = pa.array(part.row), pa.array(part.job)
                yield pa.RecordBatch.from_arrays(
                    [part.batch.column(c).take(row) for c in others] + [jobs[c].take(job) for c in of_job] + [part.feature(f) for f in features],
                    names=[*others, *of_job, *features])

    kinds = [*[f"`{c}` {kind}" for c, kind in rows.dtypes if c in others], *[f"`{c}` {known.kinds[c]}" for c in of_job], *[f"{f} {FEATURES[f]}" for f in features]]
    return rows.mapInArrow(run, ", ".join(kinds))
