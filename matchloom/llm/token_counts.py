"""Token counts by dynamic programming over prefixes.

For every prefix of a word the table keeps the last token of its encoding and the number of tokens. The last token is
the only one that ends there and that byte-pair merging would leave standing next to the last token before it, so one
sweep over the word gives every prefix, and the text never has to be encoded again to answer how many tokens any prefix
has or where a budget cuts it. White space always ends a token here, so counts of words add up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from matchloom.llm.common import WHITE, Memo, slices, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
#: The split pattern of the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PrefixTable:
    """last[j]: last token of the open prefix of j symbols; count[j]: its tokens. `close` ends a word at any prefix."""

    __slots__ = ("symbols", "last", "count")

    def __init__(self, symbols: str, last: list, count: list):
        self.symbols, self.last, self.count = symbols, last, count


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.reach = {"": {}, self.end: {}}  # by the last symbol of a word: symbols of the longest token that ends there
        for token in self.vocab:
            end = self.end if self.end and token.endswith(self.end) and token != self.end else ""
            body = token[: len(token) - len(end)]
            self.reach[end][body[-1:]] = max(self.reach[end].get(body[-1:], 0), len(body))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.made = {a + b: (rank, a, b) for (a, b), rank in self.ranks.items()}  # each token has one last merge
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.pieces = regex.compile(PIECES.replace(r"\s", WHITE)).findall
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
        self.letters = self._byte_letters()
        self.joins: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words = Memo(self._word)
        self.chunks = Memo(self._chunk)
        self.white = re.compile(f"[{WHITE}]+")
        self.separators = re.compile("[\x1c-\x1f]")

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Printable letter of each byte: itself where it is printable Latin-1, else the next free code point from 256."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain merging of the few symbols of two tokens; only asked once per pair of tokens."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _stands(self, token: str) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self._merge(self._symbols(token)) == [token]
        return ok

    def _joins(self, left: str, right: str) -> bool:
        """Whether merging leaves the two tokens side by side. Undoes their merges at the seam, latest first: the seam
        closes if the two symbols that meet there have a merge that comes before the one just undone. Of two equal
        merges the left one comes first."""
        if len(self.joins) > 1_000_000:
            self.joins.clear()
        a, b, before, ok = left, right, 1 << 60, True
        ranks, made = self.ranks, self.made
        while True:
            if ranks.get((a, b), 1 << 60) < before:
                ok = False
                break
            of_a, of_b = made.get(a), made.get(b)
            if of_b is not None and (of_a is None or of_b[0] >= of_a[0]):
                before, b = of_b[0] + 1, of_b[1]
            elif of_a is not None:
                before, a = of_a[0], of_a[2]
            else:
                break
        self.joins[left, right] = ok
        return ok

    def _step(self, table: PrefixTable, j: int, end: str) -> tuple[str | None, int]:
        """Last token and count of the prefix of j symbols, given all shorter open prefixes."""
        symbols, last, count, vocab, known = table.symbols, table.last, table.count, self.vocab, self.joins.get
        longest = self.reach[end].get(symbols[j - 1], 0)
        if j <= longest:
            part = symbols[:j] + end
            if part in vocab and self._stands(part):
                return part, 1
        for i in range(max(1, j - longest), j):
            token = symbols[i:j] + end
            if token in vocab:
                before = last[i]
                ok = known((before, token))
                if ok is None:
                    ok = before is not None and self._joins(before, token)
                if ok:
                    return token, count[i] + 1
        return None, 0

    def table(self, symbols: str) -> PrefixTable:
        table = PrefixTable(symbols, [None], [0])
        add_last, add_count, step = table.last.append, table.count.append, self._step
        for j in range(1, len(symbols)):
            token, n = step(table, j, "")
            add_last(token)
            add_count(n)
        return table

    def close(self, table: PrefixTable, j: int) -> int:
        """Tokens of the word that consists of the first j symbols."""
        return self._step(table, j, self.end)[1]

    def _word(self, symbols: str) -> int:
        return self.close(self.table(symbols), len(symbols))

    def _split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.ascii_pieces(chunk.lower())
        letters = self.letters
        return [p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()]) for p in self.pieces(self.normalize(chunk))]

    def _chunk(self, chunk: str) -> int:
        if self.split_specials is not None and "<|" in chunk:
            parts = self.split_specials.split(chunk)
            if len(parts) > 1:
                return sum(1 if k % 2 else self._plain(part) for k, part in enumerate(parts))
        return self._plain(chunk)

    def _plain(self, chunk: str) -> int:
        words = self.words
        if chunk.isascii() and chunk.isalpha():
            return words[chunk.lower()]
        if chunk.isascii() and not chunk.isprintable():  # control characters are hidden bytes also in ASCII
            letters = self.letters
            return sum(words["".join([letters[b] for b in p.encode()])] for p in self.pieces(self.normalize(chunk)))
        return sum([words[p] for p in self._split(chunk)])

    def _chunks(self, text: str) -> list[str]:
        return [c for c in self.white.split(text) if c] if self.separators.search(text) else text.split()

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.chunks.__getitem__, self._chunks(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every prefix, by code points: item n is the count of text[:n]."""
        out, before, at = [0], 0, 0
        for m in re.finditer(f"[^{WHITE}]+", text):
            out += [before] * (m.start() - at)
            out += [before + n for n in self._inside(m[0])]
            before, at = before + self.chunks[m[0]], m.end()
        return out + [before] * (len(text) - at)

    def _inside(self, chunk: str) -> list[int]:
        """Counts of every prefix of a chunk: up to a special string, through it as far as it is cut, and behind it."""
        found = self.split_specials.finditer(chunk) if self.split_specials is not None and "<|" in chunk else ()
        out, before, at = [], 0, 0
        for m in found:
            out += [before + n for n in self._tables(chunk[at : m.end()])[:-1]]
            before += self._plain(chunk[at : m.start()]) + 1
            out.append(before)
            at = m.end()
        return out + [before + n for n in self._tables(chunk[at:])]

    def _tables(self, chunk: str) -> list[int]:
        """Counts of every prefix of a chunk in which nothing is special, in a time linear in its length.

        The normal form of a prefix is that of its whole segments, which does not change with what follows, and that of a
        rest of a few code points. Pieces that end well before the rest are those of the whole chunk, and the prefix table
        of the piece that the rest falls into answers for the part of it that stands.
        """
        starts = [k for k, c in enumerate(chunk) if not k or not self._composes(c)]
        normal = [self.normalize(chunk[a:z]) for a, z in zip(starts, [*starts[1:], len(chunk)])]
        whole, ends = "".join(normal), [0, *accumulate(map(len, normal))]
        if whole != self.normalize(chunk):  # not known to happen; the plain way is right for every vocabulary
            return [self._plain(chunk[:j]) for j in range(1, len(chunk) + 1)]
        pieces = self.pieces(whole)
        begins = [0, *accumulate(map(len, pieces))]
        totals = [0, *accumulate(self.words[self._bytes(p)] for p in pieces)]
        known: tuple = (-1, None, None)
        out = []
        for j in range(1, len(chunk) + 1):
            segment = bisect_left(starts, j) - 1
            stable, rest = ends[segment], self.normalize(chunk[starts[segment] : j])
            k = max(0, bisect_right(begins, stable - 3) - 1)  # an apostrophe needs three more to be told
            if k >= len(pieces):
                k = len(pieces) - 1
            if begins[k + 1] < stable:
                out.append(totals[k + 1] + self._sum(whole[begins[k + 1] : stable] + rest))
            elif stable - begins[k] <= 3:
                out.append(totals[k] + self._sum(whole[begins[k] : stable] + rest))
            else:
                if known[0] != k:  # symbols up to each code point of the piece, and its table
                    known = (k, [0, *accumulate(len(c.encode()) for c in pieces[k])], self.table(self._bytes(pieces[k])))
                _, symbols, table = known
                first, *others = self.pieces(("x" if pieces[k][-1].isalpha() else "!") + rest)
                n = totals[k] + self._extended(table, symbols[stable - begins[k]], self._bytes(first[1:]))
                out.append(n + sum(self.words[self._bytes(p)] for p in others))
        return out

    def _bytes(self, piece: str) -> str:
        letters = self.letters
        return piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()])

    def _sum(self, normal: str) -> int:
        return sum(self.words[self._bytes(p)] for p in self.pieces(normal))

    def _extended(self, table: PrefixTable, j: int, more: str) -> int:
        """Tokens of the word of the first j symbols of a table and some more."""
        if table.symbols.startswith(more, j):
            return self.close(table, j + len(more))
        longer = PrefixTable(table.symbols[:j] + more, table.last[: j + 1], table.count[: j + 1])
        if len(table.last) <= j:  # the table of a whole word stops before its last symbol
            longer.last, longer.count = table.last[:j], table.count[:j]
        for n in range(len(longer.last), len(longer.symbols)):
            token, count = self._step(longer, n, "")
            longer.last.append(token)
            longer.count.append(count)
        return self.close(longer, len(longer.symbols))

    def _composes(self, c: str) -> bool:
        """Whether a code point may join or move before what stands before it in normal form C."""
        if c.isascii():
            return False
        first = unicodedata.normalize("NFD", c)[0]
        return unicodedata.combining(first) != 0 or "\u1160" <= first <= "\u11ff" or first in second_parts()

    def fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most `budget` tokens."""
        counts = list(accumulate(map(self.chunks.__getitem__, self._chunks(text))))
        if not counts or counts[-1] <= budget:
            return len(text)
        below = sum(1 for _ in filter(lambda n: n <= budget, counts))
        for k, m in enumerate(re.finditer(f"[^{WHITE}]+", text)):
            if k == below:
                before = counts[k - 1] if k else 0
                fitting = [j for j, n in enumerate(self._inside(m[0]), 1) if before + n <= budget]
                return m.start() + (fitting[-1] if fitting else 0)
        return len(text)


@lru_cache(maxsize=1)
def second_parts() -> frozenset[str]:
    """Last code points of all canonical decompositions."""
    parts = (unicodedata.decomposition(chr(c)) for c in range(0xA0, 0x30000))
    return frozenset(chr(int(p.split()[-1], 16)) for p in parts if " " in p and not p.startswith("<"))


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the length in code points of the
    longest prefix within the limit.

    A null text counts as empty: no bytes, no tokens, nothing over. A null doc_id stays null, repeated rows stay rows,
    other columns are not read, an empty table gives an empty result. A very long text costs time and memory in proportion
    to its length, with or without white space; only a run of combining marks costs the square of its own. No shuffle; a
    task holds 512 texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in slices(batches):
            whole = batch.column("text").to_pylist()
            n_tokens = [table.count(t) for t in whole]
            fit = [len(t) if n <= limit else table.fit(t, limit) for t, n in zip(whole, n_tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in whole], pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
