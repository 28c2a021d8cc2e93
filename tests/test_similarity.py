"""Pair tables and clusters against brute force; the pruned joins must lose nothing."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from matchloom.config import DEFAULT
from matchloom.operators import clustering as cl, similarity as sm

WORDS = [
    "python", "java", "javascript", "java script", "machine learning", "ml", "node.js", "nodejs", "react", "react native", "reactjs",
    "deep learning", "tide", "diet", "sql", "postgresql", "mysql", "c", "c++", "natural language processing", "nlp", "spark",
    "apache spark", "a b c d", "a b c e", "aws", "amazon web services",
]
random.seed(7)
WORDS += ["".join(random.choice("abcde ") for _ in range(random.randint(3, 9))).strip() for _ in range(40)]
WORDS = list(dict.fromkeys(re.sub(" +", " ", w) for w in WORDS if w))
ALIASES = {"ml": "machine learning", "nodejs": "node.js", "reactjs": "react"}


def brute(a, b):
    a, b = ALIASES.get(a, a), ALIASES.get(b, b)
    if a == b:
        return 1.0
    pa, pb = a.replace(".", " ").split(), b.replace(".", " ").split()
    for x, y in ((pa, pb), (pb, pa)):
        if len(x) == 1 and len(x[0]) <= 5 and x[0] == "".join(t[0] for t in y):
            return 0.92
    ta, tb = set(re.findall(r"[a-z0-9+#./]+", a)), set(re.findall(r"[a-z0-9+#./]+", b))
    subset = (0.9 if min(len(ta), len(tb)) >= 2 else 0.85) if ta <= tb or tb <= ta else 0.0
    return max(len(ta & tb) / len(ta | tb), subset, SequenceMatcher(None, a, b).ratio())


def vocab(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "term string")


@pytest.mark.parametrize("floor", [0.78, DEFAULT.floor])
def test_pair_table_is_complete_and_exact(spark, floor):
    got = {(r.l, r.r): (r.sim, r.back) for r in sm.pair_table(vocab(spark), vocab(spark), floor).collect()}
    want = {(a, b): (brute(a, b), brute(b, a)) for a in WORDS for b in WORDS}
    want = {k: v for k, v in want.items() if max(v) >= floor}
    assert got.keys() == want.keys()
    for k, v in want.items():
        for g, w in zip(got[k], v):
            assert abs(g - w) < 1e-12 or w < floor  # below the floor only the other direction counted


def test_one_vocabulary_gives_the_same_table(spark):
    one = vocab(spark)
    rows = lambda df: sorted((r.l, r.r, round(r.sim, 12), round(r.back, 12)) for r in df.collect())
    assert rows(sm.pair_table(one, one, 0.7)) == rows(sm.pair_table(one, vocab(spark), 0.7))


def test_ratio_join_compares_few_pairs(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60)]
    phrases = sorted({" ".join(r.sample(words, 3)) for _ in range(900)})
    terms = spark.createDataFrame([(p,) for p in phrases], "term string")
    made = sm.candidate_pairs(sm.features(terms), sm.features(terms), 0.78, same=True).count()
    assert made < 0.1 * len(phrases) * (len(phrases) - 1) / 2


def test_ratio_is_directional(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string").select(sm.sequence_ratio("a", "b").alias("s"))
    assert tuple(df.collect()[0].s) == (0.25, 0.5)


def test_graph_hit_overrides_acronym(spark):
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    edges = spark.createDataFrame([("nlp", "natural language processing")], "term string, related_term string")
    plain = sm.pair_table(one("nlp"), one("natural language processing")).collect()[0].sim
    linked = sm.pair_table(one("nlp"), one("natural language processing"), graph=edges).collect()[0].sim
    assert (plain, linked) == (0.92, 0.85)


@pytest.mark.parametrize("one_row", [20_000, 3])
def test_clusters_match_the_greedy_loop(spark, one_row):
    pairs = sm.pair_table(vocab(spark), vocab(spark), 0.78)
    records = {1: WORDS, 2: WORDS[::-1], 3: sorted(["js", "javascript", "java", "react", "reactjs"])}
    extra = spark.createDataFrame([(w,) for w in records[3]], "term string")
    pairs = pairs.union(sm.pair_table(extra, extra, 0.78)).distinct()
    items = spark.createDataFrame([(k, w, i) for k, ws in records.items() for i, w in enumerate(ws)], "rec int, term string, pos int")
    got = {(r.rec, r.term): r.leader for r in cl.leaders(items, pairs, ["rec"], 0.78, one_row).collect()}
    alias = {**ALIASES, "js": "javascript"}
    for rec, ws in records.items():
        leaders = []
        for w in ws:
            best, score = None, 0.0
            for leader in leaders:
                s = brute(alias.get(w, w), alias.get(leader, leader))
                if s >= 0.78 and s > score:
                    best, score = leader, s
            if best is None:
                leaders.append(w)
            assert got[(rec, w)] == (best or w)


def test_a_record_of_many_terms_is_decided_in_rounds(spark):
    r, n = random.Random(8), 100_000
    edges = {}
    for _ in range(150_000):
        a = r.randrange(n)
        b = min(n - 1, a + 1 + int(r.expovariate(0.001)))
        if a != b:
            edges[b, a] = round(r.uniform(0.7, 1.0), 2)
    near = {}
    for (b, a), sim in edges.items():
        if sim >= 0.78:
            near.setdefault(b, []).append((-sim, a))
    leads, want = [True] * n, {}
    for b in range(n):
        best = min((x for x in near.get(b, []) if leads[x[1]]), default=None)
        if best is not None:
            leads[b], want[b] = False, best[1]
    items = spark.range(n).selectExpr("1 AS rec", "concat('t', id) AS term", "id AS pos")
    pairs = spark.createDataFrame([(f"t{b}", f"t{a}", sim, 0.1) for (b, a), sim in edges.items()], "l string, r string, sim double, back double")
    got = cl.leaders(items, pairs, ["rec"], 0.78).where("leader <> term").collect()
    assert {(x.term, x.leader) for x in got} == {(f"t{b}", f"t{a}") for b, a in want.items()}


def test_no_cartesian_product(spark):
    plan = sm.pair_table(vocab(spark), vocab(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
