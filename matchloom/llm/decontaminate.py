"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

Items are cut into blocks of the index; each posting list keeps the largest impact per block. A passage is first bounded
by the largest impacts of its terms, then per block by the block maxima, and only blocks whose bound reaches the
threshold are scored. All passages of a slice go through each step together. Impacts are divided by the best score that
a passage cut from the item itself can reach, so that one threshold serves items of all lengths. What is retrieved must then show the item's
question (its n-grams) and its answer (its words) near the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import slices, small_batches, texts
from matchloom.llm.ngram_join import GOLD, mix, words_of
from matchloom.session import cut

#: ASCII letters and digits and all bytes above ASCII make words.
APART = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
HITS = "doc_id long, _item long, score double, question_overlap double, answer_overlap double, passage_start long"


@dataclass(frozen=True)
class LeakConfig:
    passage: int = 64  # words of a passage; the next one starts after half of them
    score: float = 0.35  # BM25 of the passage over that of the item's best passage, which is the whole item if it is no longer
    question: float = 0.4  # share of the question's n-grams near the passage
    answer: float = 0.5  # share of the answer's words near the passage
    words: int = 3
    block: int = 16  # items of a block
    k1: float = 1.2
    b: float = 0.75
    shard_bytes: int = 16 << 20  # of item text indexed, and sent to the tasks, at once


@dataclass(frozen=True)
class Statistics:
    """Counts over all test items, as far as the items of one index need them: how many there are, their words, and how
    many of them hold each of the terms."""

    items: int = 0
    words: int = 0
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    frequency: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Index:
    """Items to search, by a number of their text. Without `statistics` they are all items that there are."""

    def __init__(self, items: list[tuple[int, str]], config: LeakConfig, statistics: Statistics | None = None):
        self.config = config
        self.ids = np.array([i for i, _ in items], np.int64)
        lowered = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
        hashes, bounds = words_of(lowered, APART)
        length = np.diff(bounds)
        owner = np.repeat(np.arange(len(items)), length)
        self.terms, term = np.unique(hashes, return_inverse=True)
        n_items, n_terms = len(items), len(self.terms)
        pair, at, tf = np.unique(term * n_items + owner, return_inverse=True, return_counts=True)
        term, item = pair // n_items, pair % n_items
        total = statistics or Statistics(n_items, int(length.sum()), self.terms, np.bincount(term, minlength=n_terms))
        df = total.frequency[np.searchsorted(total.terms, self.terms)]
        idf = np.log(1 + (total.items - df + 0.5) / (df + 0.5))
        norm = config.k1 * (1 - config.b + config.b * length / max(1.0, total.words / max(1, total.items)))
        impact = idf[term] * tf * (config.k1 + 1) / (tf + norm[item])
        own = np.bincount(item, weights=impact, minlength=n_items)
        long = np.flatnonzero(length > config.passage)
        if len(long):
            scores = passage_scores(at, impact, bounds[:-1][owner], config.passage)
            own[long] = [scores[a:z].max() for a, z in zip(bounds[long], bounds[long + 1])]
        impact = impact / own[item]
        self.starts = np.searchsorted(term, np.arange(n_terms + 1))
        self.items, self.impacts = item, impact
        # Block maxima: per term the blocks that it occurs in.
        self.n_blocks = max(1, -(-n_items // config.block))
        key = term * self.n_blocks + item // config.block
        blocks, first = np.unique(key, return_index=True)
        self.block_of = blocks % self.n_blocks
        self.block_max = np.maximum.reduceat(impact, first) if len(key) else impact
        self.block_starts = np.searchsorted(blocks // self.n_blocks, np.arange(n_terms + 1))
        self.largest = np.zeros(n_terms)
        np.maximum.at(self.largest, term, impact)
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.parts = [self._parts(hashes[a:z], t) for a, z, t in zip(bounds[:-1], bounds[1:], lowered.to_pylist())]
        self.reach = np.maximum(length, config.passage).tolist()  # words around a passage that may belong to the item

    def _parts(self, words: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """n-grams of the question and words of the answer: the last sentence or line, or the last half of a single one."""
        tail = text.rstrip(" .!?\n\t")
        cut = max(tail.rfind(c) for c in ".!?\n") + 1
        n = int(words_of(pa.array([text[cut:]]), APART)[1][-1]) if cut else len(words) - len(words) // 2
        least = max(self.config.words, len(words) // 3)  # a question of a word or two would decide nothing
        n = min(max(n, 1), len(words) - least) if len(words) > least else len(words)
        question = words[: len(words) - n] if len(words) > n else words
        size = min(self.config.words, len(question))
        return np.unique(grams(question, size)), np.unique(words[len(words) - n :]), size

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.known[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            same = self.terms[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    out = np.zeros(max(0, len(words) - n + 1) if n else 0, np.uint64)
    for k in range(n):
        out = mix(out * GOLD + words[k : len(words) - n + k + 1])
    return out


def passage_scores(pair: np.ndarray, impact: np.ndarray, begin: np.ndarray, passage: int) -> np.ndarray:
    """Sum of the impacts of the distinct terms of the passage that starts at each word. pair: the (term, item) of every
    word, begin: where its item begins. A word counts in the passages that reach it and hold no earlier one of its kind."""
    n = len(pair)
    order = np.argsort(pair, kind="stable")
    before = np.full(n, -1, np.int64)
    same = pair[order][1:] == pair[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    here = np.arange(n)
    first = np.maximum(np.maximum(before + 1, here - passage + 1), begin)
    change = np.bincount(first, weights=impact[pair], minlength=n + 1) - np.bincount(here + 1, weights=impact[pair], minlength=n + 1)
    return np.cumsum(change)[:n]


def spread(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For posting lists of the keys: (position among keys, position in the lists) of every posting."""
    n = starts[keys + 1] - starts[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + starts[keys][which]


def retrieve(hashes: np.ndarray, bounds: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(text, start word, item, score) of every passage and item that reach the threshold."""
    config, half = index.config, max(1, index.config.passage // 2)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    term = index.lookup(hashes)
    reach = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, index.largest[term] if len(index.largest) else 0.0, 0.0))])
    length = np.diff(bounds)
    count = np.where(length > 0, np.maximum(1, -(-(length - half) // half)), 0)
    text = np.repeat(np.arange(len(length)), count)
    start = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * half
    stop = np.minimum(start + config.passage, bounds[1:][text])
    least = config.score - 1e-9
    keep = reach[stop] - reach[start] >= least  # repeated terms count here, so this is a bound as well
    text, start, stop = text[keep], start[keep], stop[keep]
    if not len(text):
        return none
    which = np.repeat(np.arange(len(text)), stop - start)
    at = np.arange(len(which)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + start[which]
    known = term[at] >= 0
    n_terms = len(index.terms)
    pair = np.unique(which[known] * n_terms + term[at[known]])
    which, terms = pair // n_terms, pair % n_terms
    near, posting = spread(index.block_starts, terms)
    cell = which[near] * index.n_blocks + index.block_of[posting]
    cells, inverse = np.unique(cell, return_inverse=True)
    alive = cells[np.bincount(inverse, weights=index.block_max[posting]) >= least]
    if not len(alive):
        return none
    some = np.isin(which, alive // index.n_blocks)
    which, terms = which[some], terms[some]
    near, posting = spread(index.starts, terms)
    item = index.items[posting]
    live = np.isin(which[near] * index.n_blocks + item // config.block, alive)
    cell = which[near[live]] * len(index.ids) + item[live]
    cells, inverse = np.unique(cell, return_inverse=True)
    score = np.bincount(inverse, weights=index.impacts[posting[live]])
    good = score >= least
    passage, item = cells[good] // len(index.ids), cells[good] % len(index.ids)
    return text[passage], start[passage], item, score[good]


def leaks(column: pa.Array, index: Index) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(text, item) -> best (question overlap, answer overlap, score, start word) of the leaks in an array of texts."""
    config = index.config
    hashes, bounds = words_of(pc.utf8_lower(column), APART)
    found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for text, start, item, score in zip(*(x.tolist() for x in retrieve(hashes, bounds, index))):
        low, high = int(bounds[text]), int(bounds[text + 1])
        reach = index.reach[item]
        near = hashes[max(low, start - reach) : min(high, start + config.passage + reach)]
        question, answer, size = index.parts[item]
        q = float(np.isin(question, grams(near, size)).mean()) if len(question) else 1.0
        a = float(np.isin(answer, near).mean()) if len(answer) else 1.0
        if q >= config.question and a >= config.answer:
            row = (q, a, score, int(start - low))
            best = found.get((text, item))
            if best is None or (row[0] + row[1], score, -row[3]) > (best[0] + best[1], best[2], -best[3]):
                found[text, item] = row
    return found


def numbered(items: DataFrame) -> DataFrame:
    """The distinct texts of the test items that hold a word, each with a number, `_item`, whatever their ids are."""
    some = items.select("text").where("text IS NOT NULL").where(F.lower("text").rlike("[a-z0-9]|[^\\x00-\\x7F]"))
    return cut(some.distinct().withColumn("_item", F.monotonically_increasing_id()))


def shards(clean: DataFrame, config: LeakConfig) -> Iterator[Index]:
    """Indexes of parts of the numbered texts, each of a bounded size. Document frequencies, the number of items and their
    length are counted over all of them, so that scores do not depend on the parts."""
    total = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // config.shard_bytes))
    dealt = clean.withColumn("_shard", F.pmod(F.xxhash64("text"), F.lit(n)))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = words_of(pc.utf8_lower(batch.column("text")), APART)
            shard = batch.column("_shard").to_numpy()
            rows = []
            for k in np.unique(shard).tolist():
                of = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(shard == k)]
                found, df = np.unique(np.concatenate(of), return_counts=True)
                words = int(np.diff(bounds)[shard == k].sum())
                # The row without a term holds the totals.
                rows.append(pa.RecordBatch.from_arrays(
                    [pa.array([k] * (len(found) + 1), pa.int64()), pa.array([None, *found.view(np.int64).tolist()], pa.int64()),
                     pa.array([len(of), *df.tolist()], pa.int64()), pa.array([words, *[0] * len(found)], pa.int64())],
                    names=["_shard", "term", "df", "words"]))
            yield from rows

    counted = dealt.select("text", F.col("_shard").cast("long")).mapInArrow(terms, "_shard long, term long, df long, words long")
    counted = counted.groupBy("_shard", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    everywhere = Window.partitionBy("term")  # at most a row per shard
    counted = cut(counted.select("_shard", "term", F.sum("df").over(everywhere).alias("df"), F.sum("words").over(everywhere).alias("words")))
    for k in range(n):
        rows = dealt.where(F.col("_shard") == k).select("_item", "text").collect()  # at most about shard_bytes
        mine = counted.where(F.col("_shard") == k).toArrow()  # no more terms than the shard's texts have words
        totals, mine = mine.filter(pc.is_null(mine["term"])).to_pylist(), mine.filter(pc.is_valid(mine["term"]))
        terms_of = mine["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms_of)
        known = Statistics(totals[0]["df"], totals[0]["words"], terms_of[order], mine["df"].to_numpy()[order]) if totals else None
        yield Index(sorted((r._item, r.text) for r in rows), config, known)


def contaminated(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score (BM25 over that of the item's best passage), question_overlap,
    answer_overlap, passage_start (in words).

    Texts are compared in lower case by runs of letters and digits. A null or empty text holds nothing; repeated rows of
    documents give repeated results; a null doc_id stays null; other columns are not read; an empty table of documents or
    items gives an empty result. Each text is searched once; a hit is reported for every id that its text has, also the
    null one, and once for repeated rows of one id. Of passages that show an item equally well the one with the highest
    score counts, then the first. A very long text is cut into passages in one task. Documents are not shuffled; hits are
    joined with the ids of the items.
    """
    clean, out = numbered(items), None
    for index in shards(clean, config):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [(k, i, *v) for (k, i), v in sorted(leaks(batch.column("text"), index).items())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([int(index.ids[r[1]]) for r in rows], pa.int64()),
                     pa.array([r[4] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()),
                     pa.array([r[3] for r in rows], pa.float64()), pa.array([r[5] for r in rows], pa.int64())],
                    names=[f.split()[0] for f in HITS.split(", ")],
                )

        found = texts(docs).mapInArrow(run, HITS)
        out = found if out is None else out.union(found)
    ids = cut(items.select(F.col("item_id").cast("long"), "text").distinct().join(clean, "text").select("item_id", "_item"))
    return out.join(ids, "_item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start")


def without_leaks(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no test item is found, whatever the item's id is, also null. Null
    and empty texts stay, repeated rows are judged alike, an empty table of items removes nothing. No shuffle of documents."""
    for index in shards(numbered(items), config):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[sorted({k for k, _ in leaks(batch.column("text").fill_null(""), index)})] = False
                yield batch.filter(pa.array(clean))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
