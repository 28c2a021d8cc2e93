"""The audit against filters applied one after the other in every order, and the ranks against sorted orders."""

import re
from itertools import permutations

import pytest

from matchloom.llm import filter_audit
from tests.llm.fixtures import none

LABELS = "doc_id long, quality int, toxic int, text string, n int"


def fails(text, doc_id, ids_by_text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None, "E": doc_id is not None and any(i < doc_id for i in ids_by_text[text])}


def brute(rows, labels):
    ids = {}
    for doc_id, text, _ in rows:
        ids.setdefault(text or "", set()).update([] if doc_id is None else [doc_id])
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = [(doc_id, fails(text or "", doc_id, ids)) for doc_id, text, lang in rows if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                before, left = left, [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[1][f] for d in docs) - sum(d[1][f] for d in before),
                    sum(d[1][f] and sum(d[1].values()) == 1 for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def cases():
    prose = " ".join(f"word{i}" for i in range(120))
    kinds = [prose, "a b " * 80, "SHOUT " + "LOUD " * 130, "x # y", "", None, " \t\n", "ß x\x1cy " * 60, prose + " $", "A", "word " * 200_000]
    rows = [(i, kinds[i % len(kinds)], ["en", "de", None, ""][i % 4]) for i in range(60)]
    rows += [(None, prose, "en"), (None, prose, "en"), (3, kinds[3], "en"), (3, kinds[3], "en"), (3, "another text", "fr"), (100, "once", "fr")]
    rows += [(200 + i, "same text", "hot") for i in range(300)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 400, 3)] + [(3, 1, 0), (3, None, 1), (None, 1, 1), (5, None, None)]
    return rows, labels


def test_audit(spark):
    rows, labels = cases()
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], "doc_id long, text string, lang string, part string, mask int, digest string, n int, good int")
    got = filter_audit.audit(docs.repartition(7), spark.createDataFrame([(*r, "t", 0) for r in labels], LABELS))
    assert got.columns == [c.split()[0] for c in filter_audit.RESULT.split(", ")]
    rows_out = [tuple(r) for r in got.collect()]
    assert len(rows_out) == len(set(rows_out)) and set(rows_out) == brute(rows, labels)


def test_empty(spark):
    assert filter_audit.audit(none(spark), none(spark, LABELS)).collect() == []
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, none(spark, LABELS)).count() == 600


@pytest.mark.parametrize("size", [1, 3, 5])
def test_ranks(size):
    orders = list(permutations(range(size)))
    assert [filter_audit.lehmer_rank(o, size) for o in orders] == list(range(len(orders)))
    names = "ABCDE"[:size]
    assert [filter_audit.order_of(r, names) for r in range(len(orders))] == sorted("".join(p) for p in permutations(names))
