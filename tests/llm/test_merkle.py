"""The manifest against trees built level by level in plain Python, and the layout against its definition."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from matchloom.llm import merkle
from tests.llm.fixtures import none

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at int, n string, grp string, path int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    steps = []
    for level in levels[:-1]:
        run = at // 3 * 3
        steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in groups[s]])
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            steps = siblings(trees[s], at) + siblings(over, number)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            acc = leaf(r, text)
            for left, right in steps:
                acc = h(left, acc, right)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], over[-1][0], h("".join(a + b for a, b in steps)), acc, acc == over[-1][0]))
    return out


def cases():
    rows = [dict(doc_id=i, text=f"line {i}\nend {'é' * (i % 3)}", lang="en" if i % 4 else None, source="hot", n_chars=i) for i in range(130)]
    rows += [dict(doc_id=1000 + i, text="a\nb", lang="de", source=s, n_chars=None) for i, s in enumerate(["é", "z", "Z", "", "hot2"])]
    rows += [dict(doc_id=2000 + i, text=None if i % 2 else "", lang=None, source=None, n_chars=0) for i in range(10)]
    rows += [dict(doc_id=None, text="no id\n", lang=None, source="hot", n_chars=3)] * 2
    rows += [dict(doc_id=7, text="other\ntext", lang="fr", source="hot", n_chars=1), rows[3], rows[3]]
    rows += [dict(doc_id=5000, text="x\n" * 300_000, lang="fr", source="long", n_chars=600_000)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    rows = cases()
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "n", "g", 0) for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest(df, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_small_tables(spark):
    assert merkle.manifest(none(spark)).collect() == []
    one = dict(doc_id=4, text="a\nb", lang="en", source="s", n_chars=3)
    df = spark.createDataFrame([one], "doc_id long, text string, lang string, source string, n_chars long")
    assert list(map(tuple, merkle.manifest(df).collect())) == brute([one])


def test_layout():
    """Every node has a place of its own, and each half-height subtree is stored in one piece."""
    for levels in range(1, 8):
        places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes(levels)))
        assert [int(merkle.address(levels, levels - 1, i)) for i in (0, 3 ** (levels - 1) - 1)] == [int(places[-1][0]), int(places[-1][-1])]
        upper = levels // 2
        if upper:
            assert sorted(np.concatenate(places[:upper]).tolist()) == list(range(merkle.nodes(upper)))
            for tree_at in range(3**upper):
                inside = [places[upper + d][tree_at * 3**d : (tree_at + 1) * 3**d] for d in range(levels - upper)]
                low = merkle.nodes(upper) + tree_at * merkle.nodes(levels - upper)
                assert sorted(np.concatenate(inside).tolist()) == list(range(low, low + merkle.nodes(levels - upper)))
