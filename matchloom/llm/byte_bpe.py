"""Byte-level byte-pair encoding and decoding.

A pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash: as many slots as entries, one
probe and one comparison. Any other is merged with a heap of ranked pairs over linked bytes. Results of recurring
pre-token runs are remembered in a bounded cache.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from matchloom.llm.common import WHITE, Memo, slices, texts

MIX, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = re.compile(f" ?[{LATIN}]+").fullmatch  # one pre-token


class PerfectHash:
    """Hash and displace: buckets of keys, largest first, each get the first displacement that sends all its keys to
    free slots; buckets of one key get a free slot by number, written as a negative displacement."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a hash or a key repeats")
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        slots = np.full(n, -1, np.int64)
        displace = np.zeros(self.buckets, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: bounds[b] - bounds[b + 1]):
            mine = order[bounds[b] : bounds[b + 1]]
            if len(mine) < 2:
                singles += [(b, k) for k in mine]
                continue
            start = 0
            while True:
                at = self._slots(hashes[mine][:, None], tries[None, :] + np.uint64(start))
                ranked = np.sort(at, axis=0)
                good = free[at].all(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0)
                if good.any():
                    t = int(good.argmax())
                    displace[b] = start + t + 1
                    slots[mine] = at[:, t]
                    free[at[:, t]] = False
                    break
                start += 256
        for (b, k), slot in zip(singles, np.flatnonzero(free).tolist()):
            displace[b], slots[k] = -slot - 1, slot
        self.displace = displace.tolist()
        self.keys, self.values = [b""] * n, [0] * n
        for value, slot in enumerate(slots.tolist()):
            self.keys[slot], self.values[slot] = keys[value], value

    def _slots(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ d) * np.uint64(MIX)
        return ((mixed >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """Position of the key in the list the hash was built from, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[(h >> 32) % self.buckets]
        slot = -d - 1 if d < 0 else ((((h ^ d) * MIX) & WORD) >> 20) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class BytePairs:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        entries = list(self.ranks)
        self.ids = [self.ranks[e] for e in entries]
        self.hash = PerfectHash(entries)
        self.bytes_of: list[bytes] = [b""] * (max(self.ids, default=-1) + 1)
        for entry, i in self.ranks.items():
            self.bytes_of[i] = entry
        self.packed_id = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # A run of non-space characters with the space before it splits the same way wherever it stands, and so do the
        # Latin letters at its begin and the marks behind them.
        self.runs = re.compile(f" ?[{LATIN}]+(?=[\\t-\\r -@\\[-`{{-~]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        white = pattern.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(white).findall
        self.packed = Memo(self._run, bound=150_000)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first. ends[i] is where the part that starts at i ends, 0 once it is swallowed."""
        n, ranks = len(piece), self.ranks
        ends, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        wide = n + 1  # a heap entry is one number: rank, start and end of the pair
        heap = [(ranks[piece[i : i + 2]] * wide + i) * wide + i + 2 for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end, i = entry % wide, entry // wide % wide
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                prev[end] = i
                rank = ranks.get(piece[i : ends[end]])
                if rank is not None:
                    heappush(heap, (rank * wide + i) * wide + ends[end])
            before = prev[i]
            if before >= 0:
                rank = ranks.get(piece[before:end])
                if rank is not None:
                    heappush(heap, (rank * wide + before) * wide + end)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def piece(self, piece: bytes) -> list[int]:
        at = self.hash.find(piece)
        return [self.ids[at]] if at >= 0 else self.merge(piece)

    def _run(self, run: str) -> bytes:
        packed = self.packed_id
        pieces = [run] if LETTERS(run) else self.pieces(run)
        return b"".join([packed[i] for p in pieces for i in self.piece(p.encode())])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.runs(text)))

    def decode(self, packed: bytes) -> np.ndarray:
        """The bytes that the ids stand for."""
        ids = np.frombuffer(packed, "<u4")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and decoded, the bytes
    that the ids stand for.

    A null text counts as empty: no ids, no bytes. A null doc_id stays null, repeated rows stay rows, other columns are
    not read, an empty table gives an empty result. No shuffle; a task holds
    256 texts or about a megabyte at a time, or one longer text with some twenty times its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pairs(path, pattern)
        for batch in slices(batches, 256):
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([codec.decode(i).tobytes() for i in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
