"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text, each under its path of open elements. A bidirectional LSTM in numpy reads the
sequence of blocks, each as the sum of learned vectors of its path's tags and class words, a hashed bag of its words and
a few plain figures, so that the label of a block depends on the whole page. The labeller is trained on pages composed
by a layout grammar, which knows the label of each block it writes; no page of the data is needed for it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices, small_batches

PATHS, WORDS, WIDTH, HIDDEN, FIGURES = 1024, 16, 24, 16, 7
BREAKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of its own kind up to the nearest of these.
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|textarea|title)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)
    |<(noscript|template|iframe|svg|math|canvas|object|audio|video)(?=[\s/>])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in "noscript template iframe svg math canvas object audio video".split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|itemprop|aria-label)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")


def slot(token: str) -> int:
    return 1 + zlib.crc32(token.encode()) % (PATHS - 1)


@lru_cache(maxsize=20_000)
def marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Slots of an element: its tag, and the words of the attributes that name its role."""
    out = [slot(tag)]
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append(slot("hidden"))
        elif name == "hidden":
            out.append(slot("hidden"))
        else:
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            out += [slot(w) for w in PART.findall(words) if not w.isdigit()]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, path slots, share of link text) of every leaf block with text, in page order. Character references are
    decoded and white space is one space; comments, scripts, styles and other raw elements hold no text. Only script,
    style, textarea and title run to the end of the page where their end tag is missing; of the others without one, or
    ending in "/>", the tag alone is dropped."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    held: list[str] = []
    linked = links_open = 0
    at = 0
    endless: set[str] = set()  # raw elements that no end tag follows any more

    def path() -> tuple[int, ...]:
        return tuple(dict.fromkeys(s for _, element in stack for s in element))

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((text, path(), min(1.0, linked / max(1, len(text)))))
            held, linked = [], 0

    def close(depth: int) -> None:
        nonlocal links_open
        links_open -= sum(1 for tag, _ in stack[depth:] if tag == "a")
        del stack[depth:]

    while m := TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            linked += len(piece) if links_open else 0
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if page[at - 2] != "/" and name not in endless:
                if over := ENDS[name].search(page, at):
                    at = over.end()
                else:
                    endless.add(name)
            continue
        end, tag, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BREAKS
        if block:
            flush()
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if block:  # a paragraph ends where any block begins, an item where the next one does
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BREAKS:
                    break
            for depth in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
                open_tag = stack[depth][0]
                if open_tag == tag or (tag, open_tag) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                    close(depth)
                    break
                if open_tag in CLOSES[tag]:
                    break
        if tag not in EMPTY:
            stack.append((tag, marks(tag, attributes or "")))
            links_open += tag == "a"
    held.append(page[at:])
    flush()
    return out


def features(page: list[tuple[str, tuple[int, ...], float]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Path slots per block, and a row of hashed words and figures per block."""
    plain = np.zeros((len(page), WORDS + FIGURES), np.float32)
    for k, (text, _, links) in enumerate(page):
        words = text.split()
        for w in words:
            plain[k, zlib.crc32(w.lower().encode()) % WORDS] += 1 / len(words)
        n = len(text)
        plain[k, WORDS:] = (min(1.0, np.log1p(n) / 8), links, n < 25, text[-1] in ".!?…:;\"'", k / len(page), 1 / len(page), text[0].isdigit())
    return [np.array(p or (0,), np.int64) for _, p, _ in page], plain


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = WIDTH + WORDS + FIGURES
        self.p = {"paths": rng.normal(0, 0.1, (PATHS, WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN + n), "bias": np.zeros(1)}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 1 / np.sqrt(n + HIDDEN), (n + HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, pages: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(blocks, pages, width) with the pages' blocks first, the mask, and flat path slots for the gradient."""
        longest = max(len(p[0]) for p in pages)
        x, mask = np.zeros((longest, len(pages), WIDTH + WORDS + FIGURES), np.float32), np.zeros((longest, len(pages)), np.float32)
        for k, (paths, plain) in enumerate(pages):
            n = len(paths)
            flat = np.concatenate(paths)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])[:-1]])
            x[:n, k, :WIDTH] = np.add.reduceat(self.p["paths"][flat], starts, axis=0)
            x[:n, k, WIDTH:] = plain
            mask[:n, k] = 1
        return x, mask, [np.concatenate(p[0]) for p in pages]

    def scan(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; blocks past the end of a page leave its state as it is."""
        w, c = self.p["w" + side], self.p["c" + side]
        steps, n, _ = x.shape
        h, cell = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            joint = np.concatenate([x[t], h], axis=1)
            z = joint @ w + c
            gates = sigmoid(z[:, : 3 * HIDDEN])
            forget, enter, leave = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            fresh = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = forget * cell + enter * fresh
            shown = np.tanh(new)
            tape.append((t, joint, forget, enter, leave, fresh, cell, shown, m))
            cell = m * new + (1 - m) * cell
            h = m * (leave * shown) + (1 - m) * h
            states[t] = h
        return states, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        forward, tape_f = self.scan(x, mask, "f")
        backward, tape_b = self.scan(x, mask, "b")
        seen = np.concatenate([forward, backward, x], axis=2)
        return sigmoid(seen @ self.p["out"] + self.p["bias"]), seen, (tape_f, tape_b)

    def gradients(self, pages, truth: np.ndarray) -> dict[str, np.ndarray]:
        x, mask, flat = self.inputs(pages)
        y, seen, tapes = self.scores(x, mask)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        delta = (y - truth) * mask / mask.sum()
        grad["out"], grad["bias"] = np.einsum("tn,tnd->d", delta, seen), np.array([delta.sum()], np.float32)
        back = delta[:, :, None] * self.p["out"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for side, tape, dh_out in (("f", tapes[0], back[:, :, :HIDDEN]), ("b", tapes[1], back[:, :, HIDDEN : 2 * HIDDEN])):
            w = self.p["w" + side]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, joint, forget, enter, leave, fresh, cell, shown, m in reversed(tape):
                dh = dh + dh_out[t]
                active, rest = dh * m, dh * (1 - m)
                dnew = dc * m + active * leave * (1 - shown**2)
                dz = np.concatenate([dnew * cell * forget * (1 - forget), dnew * fresh * enter * (1 - enter), active * shown * leave * (1 - leave), dnew * enter * (1 - fresh**2)], axis=1)
                grad["w" + side] += joint.T @ dz
                grad["c" + side] += dz.sum(axis=0)
                dj = dz @ w.T
                dx[t] += dj[:, : x.shape[2]]
                dh = dj[:, x.shape[2] :] + rest
                dc = dnew * forget + dc * (1 - m)
        for k, (paths, _) in enumerate(pages):
            np.add.at(grad["paths"], flat[k], np.repeat(dx[: len(paths), k, :WIDTH], [len(p) for p in paths], axis=0))
        return grad

    def fit(self, pages, labels, steps: int, batch: int = 24, rate: float = 0.015, seed: int = 11) -> "Labeller":
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        by_length = np.array([len(p[0]) for p in pages])
        for step in range(1, steps + 1):
            chosen = rng.choice(len(pages), 4 * batch, replace=False)
            chosen = chosen[np.argsort(by_length[chosen])]
            at = rng.integers(0, 4) * batch
            chosen = chosen[at : at + batch]
            truth = np.zeros((by_length[chosen].max(), batch), np.float32)
            for k, i in enumerate(chosen):
                truth[: by_length[i], k] = labels[i]
            now = rate * min(1.0, 3 * (1 - step / steps) + 0.05)
            for k, g in self.gradients([pages[i] for i in chosen], truth).items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[tuple[list[np.ndarray], np.ndarray]], batch: int = 64) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like length run together, so padding stays small."""
        order, out = sorted((k for k, p in enumerate(pages) if p[0]), key=lambda k: len(pages[k][0])), [np.zeros(0, bool)] * len(pages)
        at = 0
        while at < len(order):
            width = max(1, min(batch, 20_000 // len(pages[order[at]][0])))
            part = order[at : at + width]
            x, mask, _ = self.inputs([pages[k] for k in part])
            y, _, _ = self.scores(x, mask)
            for column, k in enumerate(part):
                out[k] = y[: len(pages[k][0]), column] > 0.5
            at += width
        return out


# --- Pages of known labels for training -----------------------------------------------------------------------------

#: Class words of containers, by what they hold.
MAIN_NAMES = "content post entry article story body post-content entry-content article-body main-content text blog-post page-content prose news-article single".split()
CHROME = {
    "nav": "nav menu navbar navigation main-menu top-nav breadcrumb breadcrumbs pagination pager toc links skip-link".split(),
    "header": "header masthead site-header top-bar topbar branding logo banner-top page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal footer-links".split(),
    "aside": "sidebar side-bar aside widget related related-posts recommended trending popular more-stories see-also tags author-bio".split(),
    "ad": "ad ads advert advertisement adverts sponsored sponsor promo promoted banner ad-slot ad-box adsbox".split(),
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal privacy-notice announcement paywall overlay".split(),
    "form": "form search newsletter subscribe signup login contact-form search-form subscription comment-form".split(),
    "comments": "comments comment comment-list discussion responses replies reader-comments reply disqus comments-area user-comments".split(),
    "share": "share social share-buttons sharing follow social-links share-bar".split(),
}
NEUTRAL = "container wrapper row col inner block module section box grid clearfix layout page site wrap flex js-x css-a".split()


class Grammar:
    """Composes pages with a label for each block, without any page of the data."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        pieces = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la qu ción lich ung eau é ü ñ".split()
        self.words = ["".join(self.rng.choice(pieces, self.rng.integers(1, 5))) for _ in range(3000)]

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, low: int, high: int) -> str:
        style = self.rng.random()
        words = [self.pick(self.words) for _ in range(int(self.rng.integers(low, high + 1)))]
        if style < 0.08:
            return " ".join(w.upper() + "!!" for w in words)
        if style < 0.16:
            return " ".join(w + self.pick(["***", "###", "&amp;&amp;", "$$$", "%%%"]) for w in words)
        if style < 0.22:
            return " | ".join(words) + "."
        if style < 0.28:
            words = [words[0]] * len(words)
        text = " ".join(words)
        return text[:1].upper() + text[1:] + self.pick([".", ".", ".", "", "!", "?"])

    def attributes(self, names: list[str], certain: float = 1.0) -> str:
        out = []
        if self.chance(certain):
            out.append(f'{self.pick(["class", "class", "class", "id"])}="{" ".join([self.pick(names)] + [self.pick(NEUTRAL)] * self.chance(0.3))}"')
        elif self.chance(0.4):
            out.append(f'class="{self.pick(NEUTRAL)}"')
        return (" " + " ".join(out)) if out else ""

    def item(self, kind: str) -> str:
        n = (6, 40) if kind in ("comments", "notice", "ad", "aside") and self.chance(0.6) else (1, 5)
        text = self.prose(*n)
        return f'<a href="/{self.pick(self.words)}">{text}</a>' if kind in ("nav", "aside", "share", "footer", "header") and self.chance(0.75) else text

    def chrome(self, kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        semantic = tag != "div" and tag != "section" and self.chance(0.6)
        tag = tag if semantic or tag == "section" and self.chance(0.5) else self.pick(["div", "div", "section"])
        if kind == "aside" and self.chance(0.3):
            tag, semantic = "aside", True
        attributes = self.attributes(CHROME[kind], 0.35 if semantic else 1.0)
        n = int(self.rng.integers(1, 7))
        if kind == "form":
            inner = f"<label>{self.prose(1, 3)}</label><input name=q><button>{self.prose(1, 2)}</button>" + (f"<p>{self.prose(4, 20)}</p>" if self.chance(0.5) else "") + (
                f"<select><option>{self.prose(1, 2)}<option>{self.prose(1, 2)}</select>" if self.chance(0.3) else "")
        elif kind == "comments":
            one = lambda: f'<{t}{self.attributes(CHROME["comments"], 0.6)}>{"<b>" + self.prose(1, 2) + "</b>" if self.chance(0.5) else ""}<p>{self.prose(4, 60)}</p></{t}>'
            t = self.pick(["div", "li", "article", "div"])
            inner = (f"<h{self.pick('234')}>{self.prose(1, 3)}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(n))
            inner = f"<ul>{inner}</ul>" if t == "li" else inner
        elif kind in ("nav", "share", "footer") and self.chance(0.7) or kind == "aside" and self.chance(0.5):
            inner = (f"<h3>{self.prose(1, 3)}</h3>" if kind == "aside" and self.chance(0.6) else "") + "<ul>" + "".join(f"<li>{self.item(kind)}</li>" for _ in range(n)) + "</ul>"
        else:
            inner = "".join(f"<{t}>{self.item(kind)}</{t}>" if t else self.item(kind) + " " for t in [self.pick(["p", "p", "div", "span", "", "h2", "h4"]) for _ in range(min(n, 3))])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def main(self) -> str:
        """Inside of the article; every text is wrapped in \x01 ... \x02, which the labels are read from."""
        mark = lambda low, high: f"\x01{self.prose(low, high)}\x02"
        out = [f"<h1>{mark(2, 14)}</h1>"] if self.chance(0.8) else []
        if self.chance(0.15):
            out = [f"<header>{out[0]}</header>"] if out else out
        for _ in range(int(self.rng.integers(1, 9))):
            kind = self.rng.random()
            if kind < 0.62:
                text = mark(6, 90)
                out.append(f"<p>{'<b>' if self.chance(0.1) else ''}{text}" + self.pick(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.70:
                out.append(f"<h{self.pick('2234')}>{mark(1, 8)}</h2>".replace("</h2>", "</h2>"))
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{mark(1, 25)}</li>" for _ in range(int(self.rng.integers(1, 6)))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<blockquote>{mark(5, 40)}</blockquote>")
            elif kind < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{mark(1, 4)}</td><td>{mark(1, 4)}</td></tr>" for _ in range(int(self.rng.integers(1, 4)))) + "</table>")
            elif kind < 0.90:
                out.append(f"<figure><img src=x><figcaption>{mark(3, 15)}</figcaption></figure>")
            elif kind < 0.93:
                out.append(f"<pre>{mark(3, 30)}</pre>")
            elif kind < 0.97:
                out.append(f"<div>{mark(3, 60)}</div>")
            else:
                out.append(f'<p><a href="/x">{mark(3, 20)}</a> {mark(2, 20)}</p>')
        return "".join(out)

    def page(self) -> tuple[list, np.ndarray]:
        tag = self.pick(["article", "article", "article", "main", "div", "div", "section"])
        parts = [self.main()]
        for kind in ("comments", "share", "ad", "aside", "form", "nav"):  # inside the article, yet not of it
            if self.chance(0.16):
                parts.insert(int(self.rng.integers(0, len(parts) + 1)) if kind != "comments" else len(parts), self.chrome(kind))
        if self.chance(0.3):
            parts.append(self.main())
        body = f"<{tag}{self.attributes(MAIN_NAMES, 0.35 if tag in ('article', 'main') else 1.0)}>{''.join(parts)}</{tag}>"
        if self.chance(0.25):
            body = f"<main>{body}</main>"
        before = [self.chrome(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if self.chance(0.45)]
        after = [self.chrome(k) for k in ("share", "comments", "aside", "form", "ad", "footer", "notice") if self.chance(0.45)]
        self.rng.shuffle(before)
        whole = "".join(before) + body + "".join(after)
        for _ in range(int(self.rng.integers(0, 3))):
            whole = f'<div class="{self.pick(NEUTRAL)}">{whole}</div>'
        found = blocks(f"<html><body>{whole}</body></html>")
        truth = np.array(["\x01" in text for text, _, _ in found], np.float32)
        return [(text.replace("\x01", "").replace("\x02", ""), path, links) for text, path, links in found], truth


@lru_cache(maxsize=1)
def trained(pages: int = 1500, steps: int = 500, seed: int = 5) -> Labeller:
    """The labeller, trained on so many composed pages: a fixed amount of work, whatever the size of the data."""
    grammar = Grammar(seed)
    made = [p for p in (grammar.page() for _ in range(pages)) if p[0]]
    return Labeller().fit([features(p) for p, _ in made], [t for _, t in made], steps)


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, url, text (blocks labelled as main text, joined by two line ends) and n_chars.

    A null or empty html, and a page without main text, give an empty text and 0. Every block of a page is read and
    labelled, whatever its length. A null page_id or url stays null; repeated rows give equal results; other columns are
    not read; an empty table gives an empty result. No shuffle.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, of="html"):
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            kept = model.label([features(p) for p in found])
            text = ["\n\n".join(block[0] for block, k in zip(page, keep) if k) for page, keep in zip(found, kept)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
