"""Secrets in texts: three fixed shapes, and strings in a sensitive context that their surroundings can't explain.

The method: a candidate is a run of key characters shortly behind a word such as "credential" or "bearer". Its novelty is
the number of bytes by which the compressed surroundings grow when the candidate is put back between them, with a
zstandard compressor primed by a dictionary of code and identifiers. Words and identifiers cost
little; random keys cost about a byte per character and are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import slices, texts

#: Kinds in the order in which spans with one start are listed; the last one is the method's.
KINDS = ("assign", "access", "hex", "novel")
#: Fixed shapes: pattern, group that is measured, least length of it.
SHAPES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),  # runs are maximal, so the bound may stand in the pattern
}
#: Words that make the text behind them sensitive.
SENSITIVE = re.compile(
    "pass(?:word|wd|phrase|code|wort)|pwd|secret|token|credential|bearer|authorization|api[ _-]?key|jwt|hmac|salt|signature|cookie"
    "|(?:access|private|account|encryption|signing|shared|master|session|client|license|ssh)[ _-]?(?:key|id|code)|contraseña|clave|mot de passe|schlüssel", re.I)
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
#: Holds wherever any of the above can match, for a first look by Arrow.
MAY_HOLD = "(?i:pass|pwd|secret|token|credential|bearer|authorization|key|jwt|hmac|salt|signature|cookie|contrase|clave|schl|" \
    "(?:access|private|account|encryption|signing|shared|master|session|client|license|ssh)[ _-]?(?:id|code))|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: What code and its identifiers look like.
CODE = """
import os sys json time re logging requests numpy as np pandas as pd from typing import Optional List Dict Any
def __init__(self, name, value, config=None): return self.config.get("name") raise ValueError("invalid argument")
public static void main(String[] args) { private final String value; this.value = value; System.out.println(); }
const express = require("express"); async function getUser(request, response) { await client.connect(); } module.exports
if __name__ == "__main__": for item in range(len(items)): try: except Exception as error: else: finally: while True: break continue
user username user_id userId email address customer_id account_id session_id request_id client_id tenant_id order_id
password passwd secret secret_key secretKey token access_token accessToken refresh_token auth_token authToken id_token csrf_token
api_key apiKey API_KEY access_key accessKey private_key privateKey public_key publicKey client_secret clientSecret signing_key
encryption_key shared_key master_key session_key ssh_key license_key authorization Authorization: Bearer Basic credentials cookie
example placeholder changeme your_token_here YOUR_API_KEY xxxxxxxx 00000000 12345678 0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ
abcdefghijklmnopqrstuvwxyz http://localhost:8080/ https://www.example.com/api/v1/ application/json text/html utf-8 UTF-8 Content-Type
index.html package.json requirements.txt settings.py config.yaml Dockerfile Makefile README.md src/main/java/com/example/ node_modules
true false null None undefined string integer float double boolean object array default version 1.0.0 2023-01-01 2024-01-01T00:00:00Z
""".encode()
FOUND = "doc_id long, spans array<struct<kind:string,start:int,stop:int,value:string,novelty:double>>"


@dataclass(frozen=True)
class Novelty:
    """reach: how far behind a sensitive word a candidate may begin; around: characters of the surroundings on each side;
    length: least length of a candidate; share: least marginal bytes per character; level: of the compressor."""

    reach: int = 48
    around: int = 400
    length: int = 14
    share: float = 0.85
    level: int = 9


@lru_cache(maxsize=2)
def packer(level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(CODE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, stop: int, how: Novelty) -> float:
    """Bytes per character that text[start:stop] adds to its compressed surroundings, in which no copy of it is left: a key that
    is written twice is as new as one that is written once."""
    value, pack = text[start:stop], packer(how.level).compress
    before, after = (part.replace(value, "").encode() for part in (text[max(0, start - how.around) : start], text[stop : stop + how.around]))
    return (len(pack(before + value.encode() + after)) - len(pack(before + after))) / (stop - start)


def shaped(text: str) -> list[tuple[int, int, int, str, None]]:
    """(start, number of the kind, stop, secret, None) of the fixed shapes: leftmost, without overlaps in a kind."""
    found = []
    for number, kind in enumerate(KINDS[:-1]):
        pattern, group, least = SHAPES[kind]
        found += [(m.start(), number, m.end(), m[group], None) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


def candidates(text: str, how: Novelty) -> set[tuple[int, int]]:
    """Runs that begin within reach of a sensitive word, hold a letter and a digit and are long enough."""
    found = set()
    for word in SENSITIVE.finditer(text):
        for near in RUN.finditer(text, word.end(), min(len(text), word.end() + how.reach)):
            run = RUN.match(text, near.start())
            value = run[0].lstrip("=_-./+~")
            start = run.end() - len(value)
            stop = start + len(value.rstrip("-./_~"))
            if stop - start >= how.length and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
                found.add((start, stop))
    return found


def secrets_in(text: str, how: Novelty) -> list[dict]:
    base = shaped(text)
    taken = sorted((s[0], s[2]) for s in base)
    added, at, reach = [], 0, -1
    for start, stop in sorted(candidates(text, how)):
        while at < len(taken) and taken[at][0] < stop:
            reach, at = max(reach, taken[at][1]), at + 1
        if start < reach:
            continue  # overlaps a span that is there already
        grown = novelty(text, start, stop, how)
        if grown >= how.share:
            added.append((start, len(KINDS) - 1, stop, text[start:stop], grown))
            reach = max(reach, stop)
    return [{"kind": KINDS[k], "start": a, "stop": b, "value": v, "novelty": g} for a, k, b, v, g in sorted(base + added, key=lambda s: s[:2])]


def secrets(docs: DataFrame, how: Novelty = Novelty()) -> DataFrame:
    """doc_id and the spans of secrets of every row: kind, start and stop in code points, the secret itself, and for
    spans of the kind "novel" their marginal bytes per character. Spans are in order of start, then of KINDS.

    A null or empty text has no spans; a null doc_id and repeated rows stay as they are. Spans of different fixed kinds
    may overlap; a novel span overlaps no other. Texts are read whole, one at a time, in time linear in their length; a
    candidate of any length is measured whole. Other columns are not read. An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("novelty", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            may = pc.match_substring_regex(batch.column("text"), MAY_HOLD)
            hits = iter(batch.column("text").filter(may).to_pylist())
            spans = [secrets_in(next(hits), how) if m else [] for m in may.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, schema.field("spans").type)], schema=schema)

    return texts(docs).mapInArrow(run, FOUND)


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
