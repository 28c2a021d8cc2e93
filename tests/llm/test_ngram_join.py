import random
from collections import Counter, defaultdict

import pytest

from matchloom.llm.ngram_join import JoinConfig, linked_classes, one_of_each

from .fixtures import documents, none

VOCABULARY = [f"w{i}" for i in range(4000)]


def varied(seed=5):
    """Exact and near copies in small and large families, a shared passage, short and empty texts."""
    r = random.Random(seed)
    passage = [r.choice(VOCABULARY) for _ in range(60)]
    texts = ["", " \n", "one", "one", "one two three", "a b c d e", "a b c d e"]
    for family in [1] * 40 + [3] * 10 + [90, 40]:
        base = [r.choice(VOCABULARY) for _ in range(r.randint(30, 200))]
        for _ in range(family):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
            texts.append(" ".join(words))
    for _ in range(90):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(20, 150))]
        at = r.randrange(len(words))
        texts.append(" ".join(words[:at] + passage + words[at:]))
    return texts + [texts[50]] * 3


def brute_force(rows):
    """(class_id, n_links) per row by comparing all n-gram sets that share an n-gram."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j != i)
        for j, n in shared.items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                links[i] += 1
                parent[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(least.get(find(i)), links[i]) for i in range(len(rows))]


@pytest.mark.parametrize("config", [JoinConfig(), JoinConfig(bucket=8, block=16, recall=0.9999)])
def test_against_brute_force(spark, config):
    docs = documents(spark, varied())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute_force(rows))), key=str)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in linked_classes(docs, config).collect()), key=str)
    assert got == want


def hot_passages(seed=9, hot=5, holders=80):
    """Pairs of near copies (Jaccard 0.818) made of two passages that many other texts hold as well, so that every
    n-gram the two share is one of a hot passage, with the same holders in every run."""
    r = random.Random(seed)
    say = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    left, right = [say(98) for _ in range(hot)], [say(90) for _ in range(hot)]
    texts = [" ".join(p + say(106)) for p in left + right for _ in range(holders)]
    texts += [" ".join(a + say(8) + b + say(8)) for a in left for b in right for _ in range(2)]
    return texts


def test_near_copies_of_two_hot_passages(spark):
    texts = hot_passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force(list(enumerate(texts)))
    assert sum(n for _, n in want) == 2 * 25
    found = {r.doc_id: (r.class_id, r.n_links) for r in linked_classes(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_one_of_each(spark):
    docs = documents(spark, varied())
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = brute_force(rows)
    worded = sorted({c for (d, t), (c, _) in zip(rows, classes) if (t or "").split() and c is not None})
    got = [r for r in kept.collect() if (r.text or "").split()]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == worded
    assert sum(r.doc_id is None for r in got) == 1
    assert linked_classes(none(spark)).collect() == [] and one_of_each(none(spark)).collect() == []
