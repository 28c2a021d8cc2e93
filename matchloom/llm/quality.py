"""Quality rules: plain counts of a text, and the fertility of a public vocabulary on it.

A tokeniser that knows a language needs few tokens for it. Characters per token, the share of byte-fallback tokens and the
entropy of the token distribution leave their usual band where a text is shouted, stuffed with symbols or repeats itself.
The bands are those of the whole corpus, per language (or per script where no language is given); those of the entropy,
which falls with the length of a text, also per power of two of the number of tokens. A text that is off in several
measures at once is rejected before it leaves one of the bands: the squares of its distances add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Memo, slices, small_batches
from matchloom.llm.ngram_join import GOLD, SPACES, mix, words_of
from matchloom.session import cut

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "chars_per_token double, fallback_share double, token_entropy double")
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


@dataclass(frozen=True)
class QualityConfig:
    least_words: int = 20
    most_repeated: int = 30  # percent of words in windows that occur twice
    window: int = 8
    #: Half widths of the bands below and above the median, in interquartile ranges, in the order of MEASURES. Varied
    #: wording is no fault, so the entropy has twice the room above.
    spread: tuple[tuple[float, float], ...] = ((6.0, 6.0), (6.0, 6.0), (4.0, 8.0))
    usual_tokens: int = 400  # bands without a length class are wider for shorter texts, by the square root of what they lack
    least_widths: tuple[float, float, float] = (0.1, 0.02, 0.1)  # half widths at least, in the order of MEASURES
    digits: int = 3  # of the measures in the quartiles: exact, the same in every run, and counted over a bounded grid


def bounds_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of texts without nulls."""
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[int(at[0]) : int(at[-1])] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Words per text that lie in a window of so many words that the text holds twice or more."""
    n = np.diff(bounds)
    windows = np.maximum(n - window + 1, 0)
    owner = np.repeat(np.arange(len(n)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[:-1][owner]
    key = np.zeros(len(owner), np.uint64)
    for k in range(window):
        key = key * GOLD + hashes[start + k]
    key = mix(key + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    covered = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(covered, start[twin], 1)
    np.add.at(covered, start[twin] + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return per_text(inside, bounds)


def doubled_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines per text that hold a word and equal an earlier line of the text."""
    newline = np.zeros(256, bool)
    newline[10] = True
    holder = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))
    hashes, bounds = words_of(holder, newline)
    # A line is a run of other bytes than \n; one without a word is dropped by counting its non-space bytes.
    inside = raw != 10
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    starts[first] = inside[first]
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    letters = np.concatenate([[0], np.cumsum(~SPACES[raw], dtype=np.int64)])
    has = letters[np.flatnonzero(ends) + 1] > letters[np.flatnonzero(starts)]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))[has]
    key = mix(hashes[has] + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lines = np.bincount(owner, minlength=len(at) - 1)
    _, where = np.unique(key, return_index=True)
    return lines - np.bincount(owner[where], minlength=len(at) - 1)


class Fertility:
    """Packed ids of whole words in a SentencePiece vocabulary, remembered per word."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.words = Memo(lambda w: np.array(self.model.encode(w, num_threads=1), "<i4").tobytes(), bound=150_000)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<i4")


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy of the ids in bits, over the largest that so many ids can have."""
    if len(ids) < 2:
        return 0.0
    counts = np.bincount(ids)
    counts = counts[counts > 0] / len(ids)
    return float(-(counts * np.log2(counts)).sum() / np.log2(len(ids)))


def measures(column: pa.Array, path: str, config: QualityConfig) -> list[pa.Array]:
    """The FIELDS of an array of texts without nulls."""
    raw, at = bounds_of(column)
    hashes, bounds = words_of(column)
    starts_char = (raw & 0xC0) != 0x80
    word_chars = per_text(starts_char & ~SPACES[raw], at)
    table = fertility(path)
    n_tokens, fallback, spread = [], [], []
    for text in column.to_pylist():
        ids = table.ids(text)
        n_tokens.append(len(ids))
        fallback.append(float(table.is_byte[ids].mean()) if len(ids) else 0.0)
        spread.append(entropy(ids))
    n_tokens = np.array(n_tokens, np.int64)
    ints = [np.diff(bounds), word_chars, per_text(SYMBOLS[raw], at), doubled_lines(raw, at), repeated_words(hashes, bounds, config.window), n_tokens]
    spoken = word_chars - per_text(MARKS[raw], at)  # marks cost tokens and say nothing
    ratio = np.where(n_tokens > 0, spoken / np.maximum(n_tokens, 1), 0.0)
    return [pa.array(x, pa.int64()) for x in ints] + [pa.array(x, pa.float64()) for x in (ratio, fallback, spread)]


def measured(docs: DataFrame, path: str, config: QualityConfig = QualityConfig(), name: str = "_quality") -> DataFrame:
    """`docs` with one more column, a struct of FIELDS and `script`. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text").fill_null("")
            found = measures(column, path, config)
            struct = pa.StructArray.from_arrays(found, names=[f.split()[0] for f in FIELDS.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    fields = ", ".join(f.replace(" ", ": ") for f in FIELDS.split(", "))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return small_batches(docs).mapInArrow(run, f"{columns}, `{name}` struct<{fields}>")


def group_of(text, lang):
    """The language named, else the script of most of the text's letters: one of a few fixed names."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    return F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.when(letters == 0, "none").when(
        F.length(F.regexp_replace(text, "[^\\p{IsLatin}]", "")) * 2 > letters, "Latin").when(
        F.length(F.regexp_replace(text, "[^\\p{IsCyrillic}]", "")) * 2 > letters, "Cyrillic").when(
        F.length(F.regexp_replace(text, "[^\\p{IsArabic}]", "")) * 2 > letters, "Arabic").when(
        F.length(F.regexp_replace(text, "[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]", "")) * 2 > letters, "CJK").otherwise("other"))


def base_failed(q: str, config: QualityConfig):
    words, repeated = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (words < config.least_words) | (100 * repeated > config.most_repeated * words)


def length_class(q: str):
    """Number of binary digits of the number of tokens."""
    return F.length(F.bin(F.col(f"{q}.n_tokens")))


def bands_of(rows: DataFrame, config: QualityConfig, q: str = "_quality", group: str = "_group") -> DataFrame:
    """Quartiles of the measures per group and length class, over all rows that pass the base rules."""
    passed = rows.where(~base_failed(q, config)).select(F.col(group).alias("_band"), length_class(q).alias("_length"), *[
        F.round(f"{q}.{m}", config.digits).alias(m) for m in MEASURES])

    def quartiles(*names: str):
        return [F.percentile(m, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(m) for m in names]

    everywhere = passed.groupBy("_band").agg(*quartiles("chars_per_token", "fallback_share"))
    return cut(passed.groupBy("_band", "_length").agg(*quartiles("token_entropy")).join(everywhere, "_band"))


def judged(rows: DataFrame, bands: DataFrame, config: QualityConfig, q: str = "_quality", group: str = "_group") -> DataFrame:
    """Adds base_failed and kept."""
    joined = rows.join(bands, (F.col(group) == F.col("_band")) & (length_class(q) == F.col("_length")), "left")

    short = F.sqrt(F.greatest(F.lit(1.0), F.lit(config.usual_tokens) / F.greatest(F.col(f"{q}.n_tokens"), F.lit(1))))
    off = F.lit(0.0)
    for m, least, (below, above) in zip(MEASURES, config.least_widths, config.spread):
        low, middle, high = (F.col(m)[k] for k in range(3))
        away = F.col(f"{q}.{m}") - middle
        width = F.greatest(F.when(away < 0, below).otherwise(above) * (high - low), F.lit(least))
        width = width if m == "token_entropy" else width * short
        off = off + F.coalesce(F.pow(away / width, 2), F.lit(0.0))
    kept = ~base_failed(q, config) & (off <= 1.0)
    return joined.withColumn("base_failed", base_failed(q, config)).withColumn("kept", kept).drop("_band", "_length", *MEASURES)


def quality(docs: DataFrame, path: str, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per row of `docs`: doc_id, the FIELDS, base_failed and kept.

    chars_per_token counts code points of words other than ASCII marks. A null text has no words and fails the base
    rules, as an empty one does; a null or blank lang takes the script's band; a text whose group has no row that passes
    the base rules has no band to leave. A very long text is measured whole, in one piece of its task. Repeated rows are judged alike. Other columns are not read. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), group_of(text, F.col("lang")).alias("_group"))
    small = cut(measured(rows, path, config).drop("text"))
    return judged(small, bands_of(small, config), config).select("doc_id", "_quality.*", "base_failed", "kept")


def good_documents(docs: DataFrame, path: str, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of `docs`, with all their columns, that `quality` keeps. Texts are measured twice, for the bands and for the
    verdict, so that no second copy of them has to be stored."""
    marked = docs.withColumn("_group", group_of(F.coalesce(F.col("text"), F.lit("")), F.col("lang")))
    bands = bands_of(measured(marked.select("text", "_group"), path, config), config)
    return judged(measured(marked, path, config), bands, config).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
