import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from matchloom.llm import byte_bpe, token_counts, token_file

from .fixtures import documents, none, odd_texts

WORD, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORD)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    docs = documents(spark, odd_texts())
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD, 30).where("doc_id IS NOT NULL").collect())
    want = sorted((r.doc_id, len((r.text or "").encode()), len(ids_of(r.text)), len(ids_of(r.text)) > 30) for r in docs.where("doc_id IS NOT NULL").collect())
    assert got == want
    assert token_counts.token_counts(none(spark), WORD).collect() == []


def test_every_prefix():
    counter = token_counts.counter(WORD)
    for text in odd_texts(60, 8)[:60] + ["unbelievable hyperparameters, re-tokenised!!"]:
        counts = counter.prefix_counts(text)
        assert counts == [len(ids_of(text[:n])) for n in range(len(text) + 1)]
        for budget in (0, 3, 10):
            assert counter.fit(text, budget) == max(n for n, c in enumerate(counts) if c <= budget)


def test_prefixes_of_unspaced_texts():
    counter = token_counts.counter(WORD)
    r = random.Random(5)
    groups = ["中文数据処理語", "ประเทศไทย", "한국어각힣", "é́́", "don't'll!'re've", "aé1２½ßİΣς", "<|endoftext|>", "<|start", "\x07\x01", "क्षि", "ÅÅå"]
    for _ in range(250):
        text = "".join(r.choice(g) if r.random() < 0.7 else g for g in r.choices(groups, k=r.randint(1, 14)))
        assert counter.prefix_counts(text) == [len(ids_of(text[:n])) for n in range(len(text) + 1)], text


@pytest.mark.parametrize("text", ["中文数据处理" * 17_000, "ประเทศไทย" * 11_200, "don't" * 20_000, "é́" * 50_000, "pneumono" * 12_500], ids=["cjk", "thai", "apostrophe", "marks", "word"])
def test_budget_of_long_unspaced_texts(text):
    counter = token_counts.counter(WORD)
    started = time.time()
    n = counter.fit(text, 2048)
    assert time.time() - started < 20
    assert len(ids_of(text[:n])) <= 2048 < min(len(ids_of(text[: n + k])) for k in (1, 2, 3, 50)) and len(ids_of(text)) == counter.count(text)


def test_byte_pairs(spark):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, odd_texts())
    coded = byte_bpe.encode_decode(docs, MULTI, P.PATTERN)
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in coded.where("doc_id IS NOT NULL").collect())
    want = []
    for r in docs.where("doc_id IS NOT NULL").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
    assert got == sorted(want)
    assert byte_bpe.encode_decode(none(spark), MULTI, P.PATTERN).collect() == []


def test_perfect_hash_is_minimal():
    keys = [hashlib.md5(str(i).encode()).digest()[: 1 + i % 9] + str(i).encode() for i in range(3000)]
    found = byte_bpe.PerfectHash(keys)
    assert len(found.keys) == len(keys) and [found.find(k) for k in keys] == list(range(3000))
    assert found.find(b"no such key") == -1


@pytest.mark.parametrize("ids", [[5], [1, 1, 1], [49407] * 3000, list(range(2000)), (np.random.default_rng(1).zipf(1.3, 30_000) % 49408).tolist()])
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    block = token_file.encode_block(ids, 49408)
    head = np.frombuffer(block[:16], "<u4")
    assert (token_file.decode_block(head, block[16:]) == ids).all()
    damaged = bytearray(block)
    damaged[-12] ^= 255
    if len(ids) > 100:
        with pytest.raises((ValueError, IndexError)):
            token_file.decode_block(head, bytes(damaged[16:]))


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 1000)
    docs = documents(spark, odd_texts())
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in token_file.token_files(docs, WORD).collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want, start = [], 0
    for r in rows:
        ids = ids_of(r.text) + [2]
        want.append(((r.doc_id is not None, r.doc_id or 0, start), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert token_file.token_files(none(spark), WORD).collect() == []


def test_files_are_read_in_many_tasks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_file.write_ids(docs, WORD, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.count() > 4
    back = token_file.read_ids(files)
    assert back.count() == 3000 and back.selectExpr("spark_partition_id() AS task").distinct().count() == files.count()


def test_new_words_of_many_texts_are_encoded_together():
    """One call of the library for each word was most of the time of op6_token_file."""
    coder = token_file.Encoder(WORD)
    calls = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return self.tokenizer.encode_batch_fast(texts, **more)

    coder.tokenizer, coder.plain = Counted(coder.tokenizer), Counted(coder.plain)
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdeéüß", k=9)) for _ in range(100)) for _ in range(50)]
    end = np.array([2], "<u4").tobytes()
    assert coder.texts(texts, end) == [np.array(ids_of(text) + [2], "<u4").tobytes() for text in texts]
    assert len(calls) <= 2 and sum(calls) < 100


def test_marks_case_and_special_strings():
    coder = token_file.Encoder(WORD)
    r = random.Random(4)
    parts = ["Don't", "x's,", "e.g.", "'S", "'", "!?", "...", "Ab", "É", "ÿ", "ß;", "µ", "ª", "×", "Σ", "ΑΣ", "İ", "ﬁ", "=", "\u0338", "\u0301", "1", "½", "-", "_",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", "<|", "|>", "\x1c", "\x01", "\n", " ", " ", " ", "\u3000", "\x85", "\xa0", "中", "z" * 70, "Q" * 65 + "."]
    texts = ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(6000)]
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        for text, ids in zip(some, coder.texts(some, b"")):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text), text


def test_texts_when_the_memory_of_chunks_is_small():
    coder = token_file.Encoder(WORD)
    coder.memo.bound = 7
    texts = odd_texts(60, 8)
    for _ in range(2):
        assert coder.texts([text or "" for text in texts], b"") == [np.array(ids_of(text), "<u4").tobytes() for text in texts]
