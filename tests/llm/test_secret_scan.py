"""Fixed shapes against a scanner without patterns, and keys that only their surroundings give away."""

import random
import string

from matchloom.llm import secret_scan as scan
from tests.llm.fixtures import documents, none, odd_texts

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def lower(c):
    return c.lower() if c in string.ascii_uppercase else c


def assign_at(text, i):
    for word in WORDS:
        if "".join(map(lower, text[i : i + len(word)])) != word:
            continue
        j = i + len(word)
        j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
        while text[j : j + 1] == " ":
            j += 1
        if text[j : j + 1] not in (":", "=") or j >= len(text):
            continue
        j += 1
        while text[j : j + 1] == " ":
            j += 1
        j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
        k = j
        while k < len(text) and text[k] in VALUE:
            k += 1
        if k > j:
            return k, k - j
    return None


def run_at(text, i, head, body):
    if not text.startswith(head, i):
        return None
    k = i + len(head)
    while k < len(text) and text[k] in body:
        k += 1
    return (k, k - i) if k > i + len(head) else None


def brute(text):
    upper, hexes = set(string.ascii_uppercase + string.digits), set("0123456789abcdef")
    kinds = {"assign": (lambda i: assign_at(text, i), 6), "access": (lambda i: run_at(text, i, "AKIA", upper), 20), "hex": (lambda i: run_at(text, i, "", hexes), 24)}
    found = []
    for number, (kind, (at, least)) in enumerate(kinds.items()):
        i = 0
        while i < len(text):
            hit = at(i)
            if hit is None:
                i += 1
                continue
            if hit[1] >= least:
                found.append((i, number, kind, hit[0]))
            i = hit[0]
    return [(kind, i, j) for i, _, kind, j in sorted(found)]


def made_texts(n=400, seed=5):
    r = random.Random(seed)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABCDEF0123456789",
             "0123456789abcdef", "deadbeef", "x", "Z-", "é", "😀", "\n", ".", "a_b=c", "word "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def rows_of(df):
    return [(r.doc_id, [(s.kind, s.start, s.stop) for s in r.spans]) for r in df.collect()]


def test_fixed_shapes(spark):
    texts = made_texts() + odd_texts() + ["token=" + "a" * 300_000, "token" + " " * 100_000 + "=abcdefgh", "f" * 50_000 + "g"]
    docs = documents(spark, texts)
    got = rows_of(scan.secrets(docs))
    want = [(r.doc_id, brute(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    base = [(i, [s for s in spans if s[0] != "novel"]) for i, spans in got]
    assert sorted(map(str, base)) == sorted(map(str, want))
    for _, spans in got:
        assert spans == sorted(spans, key=lambda s: (s[1], scan.KINDS.index(s[0])))


PROSE = "the service reads its settings from the environment when it starts and keeps them until the next release is rolled out. "


def key(r, alphabet=string.ascii_letters + string.digits, n=32):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_novel_keys(spark):
    """Random keys behind sensitive words are found wherever they stand; words, paths, identifiers and dates are not, and
    random keys without such a word are not either."""
    r = random.Random(9)
    leads = ["Authorization: Bearer ", "the passphrase is ", "client key ", "use credential <", "jwt ", "signing key: "]
    secrets = [key(r) for _ in leads] + [key(r, "0123456789ABCDEF", 40) for _ in leads]
    hidden = [PROSE * (i % 3) + leads[i % len(leads)] + s + " and more. " + PROSE * 3 for i, s in enumerate(secrets)]
    twice = PROSE + "bearer " + secrets[0] + " again bearer " + secrets[0] + " " + PROSE
    plain = [PROSE + "the bearer internationalization18n said so", PROSE + "token user_session_identifier2 here", "cookie set on 2024-01-01T00:00:00Z " + PROSE,
             "signature at https://www.example.com/api/v1/users/ " + PROSE, PROSE + "salt and 12 herbs", PROSE + key(r) + " " + PROSE]
    docs = spark.createDataFrame(list(enumerate(hidden + [twice] + plain)), "doc_id long, text string")
    got = {row.doc_id: row.spans for row in scan.secrets(docs).collect()}
    for i, secret in enumerate(secrets):
        assert [(s.kind, s.value) for s in got[i]] == [("novel", secret)], (i, got[i])
        assert hidden[i][got[i][0].start : got[i][0].stop] == secret
    assert [s.value for s in got[len(secrets)]] == [secrets[0]] * 2
    assert all(got[len(secrets) + 1 + i] == [] for i in range(len(plain)))


def test_base_spans_stay(spark):
    text = 'token = "0123456789abcdef0123456789abcdef" bearer ' + key(random.Random(2))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [s[0] for s in rows_of(scan.secrets(docs))[0][1]] == ["assign", "hex", "novel"]


def test_empty(spark):
    assert scan.secrets(none(spark)).collect() == []
