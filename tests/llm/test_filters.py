import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers as P
import sentencepiece

from matchloom.llm import decontaminate, quality, url_filter
from matchloom.llm.queries import URL_RULES

from .fixtures import documents, none, odd_texts

PIECES = P.path("piece_bpe_32k.model")


def test_base_counts_of_quality(spark):
    texts = odd_texts() + ["a b c d e f g h " * 5, "x\ny\nx\n\n\nx \n", "one line\none line"]
    docs = documents(spark, texts)
    found = {(r.doc_id, r.n_words): r for r in quality.quality(docs, PIECES).collect()}
    for r in docs.where("doc_id IS NOT NULL").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        got = found[r.doc_id, len(words)]
        assert (got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (
            sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert got.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (got.base_failed and got.kept)
    assert quality.quality(none(spark), PIECES).collect() == []


def test_bands_of_quality(spark):
    r = random.Random(1)
    words = [r.choice(["river", "mountain", "the", "of", "quiet", "morning", "walk", "between", "people"]) + " " for _ in range(900)]
    clean = ["".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(120)]
    loud = ["".join(w.strip().upper() + "!!*** " for w in r.choices(words, k=100)) for _ in range(4)]
    docs = documents(spark, clean + loud).where("doc_id < 10000").dropDuplicates(["doc_id"])
    kept = quality.good_documents(docs, PIECES)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == list(range(120))


def test_leaks(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(2000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(r.randint(12, 40))}?\n{say(r.randint(3, 12))}.") for i in range(60)] + [(None, "no id"), (90, None), (91, " .. "), (92, "tiny one")]
    texts = [say(300) for _ in range(40)]
    for i in range(12):
        texts.append(f"{say(r.randint(0, 200))} {items[i][1].upper() if i % 2 else items[i][1]} {say(r.randint(0, 200))}")
    texts += [f"{say(50)} {items[20][1].split('?')[0]} {say(50)}", items[30][1].split("\n")[1] + " " + say(80)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(40 + i, i) for i in range(12)}  # a question or an answer alone is not enough
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 12
    small = decontaminate.LeakConfig(shard_bytes=500)
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, small).collect()} == found
    assert decontaminate.contaminated(none(spark), bench).collect() == []
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_leaks_of_long_items(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(20_000)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(n)}?\n{say(r.randint(3, 12))}.") for i, n in enumerate([60, 70, 90, 120, 150, 200, 250, 300, 400, 500, 700, 1000])]
    texts = [f"{say(r.randint(0, 300))} {t} {say(r.randint(0, 300))}" for _ in range(3) for _, t in items]
    texts += [f"{say(100)} {t.split('?')[0]} {say(100)}" for _, t in items] + [say(800) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k % len(items)) for k in range(3 * len(items))}  # a question alone is not enough
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()} == want
    assert decontaminate.without_leaks(docs, bench).count() == len(texts) - len(want)


def leaks_by_brute_force(texts, items, c):
    """(text, item) -> score, question and answer overlap, start, in plain Python."""
    cut_words = lambda t: re.findall("[a-z0-9]+", t.lower())
    kinds = {t: cut_words(t) for t in items}
    df = Counter(w for ws in kinds.values() for w in set(ws))
    mean = sum(map(len, kinds.values())) / len(kinds)
    impact = {}
    for t, ws in kinds.items():
        norm = c.k1 * (1 - c.b + c.b * len(ws) / mean)
        raw = {w: math.log(1 + (len(kinds) - df[w] + 0.5) / (df[w] + 0.5)) * n * (c.k1 + 1) / (n + norm) for w, n in Counter(ws).items()}
        best = max(sum(raw[w] for w in set(ws[k : k + c.passage])) for k in range(max(1, len(ws) - c.passage + 1)))
        impact[t] = {w: v / best for w, v in raw.items()}
    half, out = c.passage // 2, {}
    triples = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    for i, text in enumerate(texts):
        words = cut_words(text)
        for t, ws in kinds.items():
            tail = t.rstrip(" .!?\n\t")
            end = max(tail.rfind(x) for x in ".!?\n") + 1
            n = len(cut_words(t[end:])) if end else len(ws) - len(ws) // 2
            least = max(c.words, len(ws) // 3)
            n = min(max(n, 1), len(ws) - least) if len(ws) > least else len(ws)
            question, answer = ws[:-n] if len(ws) > n else ws, set(ws[len(ws) - n :])
            size, found = min(c.words, len(question)), []
            for start in range(0, max(half, len(words) - half) if words else 0, half):
                score = sum(impact[t].get(w, 0) for w in set(words[start : start + c.passage]))
                reach = max(c.passage, len(ws))
                near = words[max(0, start - reach) : start + c.passage + reach]
                asked = triples(question, size)
                q, a = len(asked & triples(near, size)) / len(asked), len(answer & set(near)) / len(answer)
                if score >= c.score and q >= c.question and a >= c.answer:
                    found.append((q + a, score, -start, q, a))
            if found:
                _, score, start, q, a = max(found)
                out[i, t] = (round(score, 6), round(q, 6), round(a, 6), -start)
    return out


def test_leaks_by_brute_force(spark):
    r = random.Random(21)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(3000)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, f"{say(r.randint(6, 90))}? {say(r.randint(1, 9))}.") for i in range(40)]
    named = items + [(100, items[0][1]), (101, items[1][1]), (None, items[1][1]), (None, items[2][1]), items[3], (102, "only a name"), (103, "")]
    named = [x for x in named if x != items[2]]  # its text has no other id than null
    texts = []
    for i, (_, t) in enumerate(items):
        words = t.split()
        lost = {k for k in range(len(words)) if r.random() < (i % 4) / 6}
        texts.append(f"{say(r.randint(0, 150))} {' '.join(w for k, w in enumerate(words) if k not in lost)} {say(r.randint(0, 150))}")
    texts += [say(r.randint(1, 400)) for _ in range(15)] + ["", "w1", say(20_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(named, "item_id long, text string").repartition(3)
    want = {(i, n): v for (i, t), v in leaks_by_brute_force(texts, {t for _, t in named if t}, decontaminate.LeakConfig()).items() for n, u in named if u == t}
    assert {(0, 0), (0, 100), (1, 1), (1, 101), (1, None), (2, None)} <= set(want) and 10 < len({i for i, _ in want}) < len(texts)
    for size in (1 << 20, 900):  # scores do not depend on how the items are dealt
        rows = decontaminate.contaminated(docs, bench, decontaminate.LeakConfig(shard_bytes=size)).collect()
        got = {(x.doc_id, x.item_id): (round(x.score, 6), round(x.question_overlap, 6), round(x.answer_overlap, 6), x.passage_start) for x in rows}
        assert got == want and len(rows) == len(want)
    kept = {x.doc_id for x in decontaminate.without_leaks(docs, bench, decontaminate.LeakConfig(shard_bytes=900)).collect()}
    assert kept == {None, *range(len(texts))} - {i for i, _ in want}


def test_best_passage_of_an_item():
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(n))) for i, n in enumerate([1, 7, 8, 9, 30, 200])]
    index = decontaminate.Index(items, decontaminate.LeakConfig(passage=8))
    for i, text in items:
        words = text.split()
        hashes, _ = decontaminate.words_of(pa.array(words), decontaminate.APART)
        impact = {t: index.impacts[p] for t in range(len(index.terms)) for p in range(index.starts[t], index.starts[t + 1]) if index.items[p] == i}
        terms = index.lookup(hashes).tolist()
        best = max(sum(impact[t] for t in set(terms[k : k + 8])) for k in range(max(1, len(words) - 7)))
        assert abs(best - 1) < 1e-9


def test_block_bounds_lose_no_item():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 30)))) for i in range(80)]
    index = decontaminate.Index(items, decontaminate.LeakConfig(score=0.3))
    texts = pa.array([" ".join(r.choices(vocabulary, k=r.randint(0, 400))) for _ in range(30)])
    hashes, bounds = decontaminate.words_of(pc.utf8_lower(texts), decontaminate.APART)
    got = {(t, s, i) for t, s, i, _ in zip(*(x.tolist() for x in decontaminate.retrieve(hashes, bounds, index)))}
    want = set()
    for t in range(len(bounds) - 1):
        n = bounds[t + 1] - bounds[t]
        for k in range(max(1, -(-(n - 32) // 32)) if n else 0):
            start = bounds[t] + 32 * k
            terms = {x for x in index.lookup(hashes[start : min(start + 64, bounds[t + 1])]).tolist() if x >= 0}
            scores = Counter()
            for x in terms:
                for p in range(index.starts[x], index.starts[x + 1]):
                    scores[index.items[p]] += index.impacts[p]
            want |= {(t, start, i) for i, s in scores.items() if s >= 0.3 - 1e-9}
    assert got == want and want


def test_kept_by_brute_force(spark):
    r = random.Random(12)
    words = ["river", "mountain", "the", "of", "quiet", "morning", "walk", "between", "people", "señor", "mañana", "über", "straße", "цвет", "中文", "x1"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))
    texts = [say(r.randint(15, 400)) for _ in range(150)] + ["QZXK " * r.randint(15, 25) + say(60) for _ in range(6)]
    texts += [" ".join(w for w in r.choices(words, k=12) for _ in range(6)) for _ in range(6)] + [say(20_000), "", "   "]
    texts += [" | ".join("".join(r.choice("aeiouñzqxkj") for _ in range(7)) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, ["en", "de"][i % 2], "clash") for i, t in enumerate(texts)] + [(900, None, "en", ""), (0, texts[0], "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    model, config = sentencepiece.SentencePieceProcessor(model_file=PIECES), quality.QualityConfig()
    seen = []
    for _, text, lang, _ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        ids = [i for w in (text or "").split() for i in model.encode(w)]
        n, counts = len(ids), Counter(ids).values()
        spoken = sum(not (33 <= ord(c) < 127 and not c.isalnum()) for w in found for c in w)
        windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
        twice = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
        entropy = -sum(c / n * math.log2(c / n) for c in counts) / math.log2(n) if n > 1 else 0.0
        seen.append((n, (spoken / n if n else 0.0, sum(map(model.is_byte, ids)) / n if n else 0.0, entropy),
                     (lang, n.bit_length() or 1), len(found) < 20 or 100 * len(twice) > 30 * len(found)))
    rounded = lambda x: math.floor(x * 1000 + 0.5) / 1000
    kept = []
    for n, values, (lang, size), failed in seen:
        off = 0.0
        for k, (value, least, sides) in enumerate(zip(values, config.least_widths, config.spread)):
            peers = [rounded(v[k]) for _, v, (la, sz), f in seen if not f and la == lang and (k < 2 or sz == size)]
            if not failed:
                low, middle, high = np.percentile(peers, [25, 50, 75])
                width = max(sides[int(value >= middle)] * (high - low), least) * (math.sqrt(max(1, 400 / n)) if k < 2 else 1)
                off += ((value - middle) / width) ** 2
        kept.append(not failed and off <= 1)
    got = quality.quality(docs, PIECES).collect()
    key = lambda i, n, c, f, e, b, k: (i, n, round(c, 9), round(f, 9), round(e, 9), b, k)
    assert sorted(key(x.doc_id, x.n_tokens, x.chars_per_token, x.fallback_share, x.token_entropy, x.base_failed, x.kept) for x in got) == sorted(
        key(i, n, *v, f, k) for (i, _, _, _), (n, v, _, f), k in zip(rows, seen, kept))
    assert 0 < sum(kept) < sum(not f for *_, f in seen)
    good = quality.good_documents(docs, PIECES)
    assert good.columns == docs.columns and sorted(x.doc_id for x in good.collect()) == sorted(i for (i, *_), k in zip(rows, kept) if k)


def fitting(host, path, rules):
    found = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[3:] if found else (None, "allow")


def test_url_rules(spark):
    r = random.Random(6)
    labels = ["com", "net", "example", "www", "a", "b-c", "xn--é", "", "😀"]
    rules = URL_RULES + [(".".join(r.choices(labels[:7], k=r.randint(1, 3))), "/" + "/".join(r.choices(["en", "fr", "x"], k=r.randint(0, 2))), r.choice(["allow", "block"])) for _ in range(40)]
    urls = ["http://" + ".".join(r.choices(labels, k=r.randint(1, 4))).upper() + r.choice(["", "/", "/en/", "/en/x?y#z", "/fr", "?q=/en/", "#f", "/x//en/"]) for _ in range(400)]
    urls += [None, "", "example.com/en/", "://", "http:///en/", "ftp://net/es/\nx", "http://a.com:80/en/", "http://example.com./en/", "a://b://net/fr/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], ""), (0, urls[0], "")], "page_id long, url string, host string")
    broken = [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", "maybe"), rules[0]]
    table = spark.createDataFrame(rules + broken, "host string, path string, verdict string")
    got = {(x.page_id, x.host, x.path): (x.rule, x.verdict) for x in url_filter.judged(pages, table, salts=3).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        lowered = [(re.sub("[A-Z]", lambda m: m[0].lower(), h), p, v) for h, p, v in rules]
        assert got[i, host, path] == fitting(host, path, lowered), u
    assert url_filter.judged(pages.limit(0), table).collect() == []
    assert {x.verdict for x in url_filter.judged(pages, table.limit(0)).collect()} == {"allow"}
