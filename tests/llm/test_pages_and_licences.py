import os

import numpy as np
import pytest

from matchloom.llm import html_extract as hx
from matchloom.llm import license_scan as ls

from .fixtures import documents, none

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_blocks():
    page = "<title>no</title><p>a&nbsp; b<br>c<p>d &amp; e<ul><li>x<li>y</ul><script>var t='</p>'</script><td>q</td> tail <a href='x>y'>z</a><!-- <p>no -->"
    assert [t for t, _, _ in hx.blocks(page)] == ["a b c", "d & e", "x", "y", "q", "tail z"]
    assert hx.blocks("") == [] and hx.blocks("<p> \n </p><") == [("<", (), 0.0)]
    assert [t for t, _, _ in hx.blocks('<p title="open>text</p>after')][-1].endswith("after")


@pytest.mark.parametrize("inner", [
    "<svg class=i/>", "<iframe src='a>b' />", "<object data=x>", "<video src=x>", "<video-player src=x></video-player>", "<object-card>",
    "<title-bar></title-bar>", "<svg><title>no</title></svg>", "<VIDEO a='>'>no</Video >", "<math/><math>no</math>", "<script>no<svg></script >",
])
def test_raw_elements_end(inner):
    assert [t for t, _, _ in hx.blocks(f"<p>one</p>{inner}<p>two</p><p>three</p>")] == ["one", "two", "three"]


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title"])
def test_raw_elements_to_the_end_of_the_page(name):
    assert [t for t, _, _ in hx.blocks(f"<p>one</p><{name}>no<p>two</p>")] == ["one"]


def test_gradients():
    grammar = hx.Grammar(1)
    made = [grammar.page() for _ in range(3)]
    pages, model = [hx.features(p) for p, _ in made], hx.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    truth = np.zeros((max(len(t) for _, t in made), 3))
    for k, (_, t) in enumerate(made):
        truth[: len(t), k] = t

    def loss():
        x, mask, _ = model.inputs(pages)
        y, _, _ = model.scores(x, mask)
        return float(-((truth * np.log(y) + (1 - truth) * np.log(1 - y)) * mask).sum() / mask.sum())

    found = model.gradients(pages, truth)
    rng = np.random.default_rng(2)
    for name in ("wf", "wb", "cf", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        keep, step = model.p[name][at], 1e-3
        model.p[name][at] = keep + step
        up = loss()
        model.p[name][at] = keep - step
        down = loss()
        model.p[name][at] = keep
        assert found[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_held_out_accuracy():
    model, grammar = hx.trained(), hx.Grammar(12345)
    made = [grammar.page() for _ in range(200)]
    labels = model.label([hx.features(p) for p, _ in made])
    exact = sum(bool((a == t.astype(bool)).all()) for a, (_, t) in zip(labels, made))
    assert exact >= 190


PAGE = """<html><head><title>T</title></head><body><div class="cookie-banner">We use cookies <button>ok</button></div><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="sidebar"><h3>Popular</h3><a href=/x>x</a></div>
<article><h1>River &amp; walk</h1><p>First  paragraph of the story, with some words in it.<p>Second one\nfollows here.</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much, thanks for writing this.</p></div></section>
<form><input><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash", "clash"), (1, "u", PAGE, "", ""), (2, None, None, "", ""), (None, "v", "", "", "")], SCHEMA).repartition(2)
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in hx.main_text(pages).collect()))
    want = "River & walk\n\nFirst paragraph of the story, with some words in it.\n\nSecond one follows here."
    assert got == [(0, "v", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want)), (2, "", "", 0)]
    assert hx.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_articles_of_the_test_pages(spark):
    """These pages keep their article in one element, which gives the wanted text without the labeller."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: "\n\n".join(t for t, path, _ in hx.blocks(r.html) if hx.slot("article") in path) for r in pages.collect()}
    assert {r.page_id: r.text for r in hx.main_text(pages).collect()} == want


def test_licences(spark):
    notices = [(f, t) for f, ts in ls.TEMPLATES.items() for t in ts]
    plain = ["a walk by the river", "the general public reads this version", "all of the reserved seats are free to use", ""]
    texts = [f"{plain[k % 4]}\n{t}\n{plain[(k + 1) % 4]}" for k, (_, t) in enumerate(notices)] + plain
    found = ls.licences(documents(spark, texts)).where("doc_id IS NOT NULL").distinct().collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in found} == {(k, 1, f) for k, (f, _) in enumerate(notices)}
    assert ls.licences(none(spark)).collect() == []


def test_held_out_licences():
    scanner, rng = ls.trained(), np.random.default_rng(77)
    right = total = 0
    for f, texts in ls.TEMPLATES.items():
        for text in texts:
            words = text.split()
            for _ in range(10):
                line = " ".join(w for w in words if rng.random() > 0.05)
                found = scanner.scan(ls.pa.array([line]))
                right, total = right + (bool(found) and found[0][1] == f), total + 1
    assert right / total > 0.93
    prose = [" ".join(rng.choice(ls.PLAIN, 25)) for _ in range(2000)]
    assert len(scanner.scan(ls.pa.array(prose))) <= 4
