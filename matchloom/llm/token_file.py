"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

A block is cut into lanes of consecutive ids that are coded in step, so that every operation of the coder is one numpy
operation over all lanes, while all lanes share and train one model. An id is predicted from the two ids before it
(order 2) and from the one before it (order 1); order 0 covers every id by its count. The confidences of the two
predictions select the learned weights that divide the range between them.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from matchloom.llm.common import WHITE, Folder, Memo, open_file, slices, texts
from matchloom.session import cut

MAGIC = b"IDRC0002"
BLOCK, LANE = 1 << 20, 256  # ids of a block, and of a lane
SLOTS, GROWTH, EVERY = 18, 32, 16  # bits of the slots of order 2, weight of one occurrence, steps between updates of order 0
U, H = np.uint64, np.uint32
SETTLED, SMALL, WORD, TOP = U(1 << 48), U(1 << 40), U(16), U(48)
SHARE, COUNT, NEAR = U(16), U(22), U(4)  # bits of the range that weights and counts are scaled to, and of a step of the index
HIGH, LOWER = U(32), U((1 << 32) - 1)


class Model:
    """Predictions and weights of a block, the same in coder and decoder. A prediction is its id * 4 + its confidence. A cell
    is the number of the confidences, of whether the predictions agree, and of what coded the id: 0 order 0, 1 order 1, 2 or
    3 order 2; `start` and `width` say which part of the range is a cell's."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.counts, self.rising = np.ones(alphabet, np.int64), np.arange(alphabet + 1, dtype=np.uint64)
        self.waiting: list[np.ndarray] = []
        self.next1, self.next2 = np.full(alphabet, -4, np.int32), np.full(1 << SLOTS, -4, np.int32)
        self.weights = np.ones((32, 3), np.int64)
        self.before, self.two_before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.scale()

    def scale(self) -> None:
        """Cumulative counts over a total of a power of two, with a width of one at least for every id."""
        total = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(self.counts, out=total[1:])
        room = (1 << int(COUNT)) - self.alphabet
        self.below = (total * (room / total[-1])).astype(np.uint64) + self.rising
        self.parts = (self.below[:-1] << HIGH) | (self.below[1:] - self.below[:-1])  # where an id begins, and its width

    def predict(self, n: int) -> np.ndarray:
        """For the first n lanes: the cell without its last two bits. p2 and p1 are the predicted ids."""
        self.n, self.at1 = n, self.before[:n]
        self.at2 = ((self.two_before[:n].astype(H) * H(0x9E3779B1) + self.at1.astype(H) * H(0x85EBCA77)) >> H(32 - SLOTS)).astype(np.int64)
        self.v1, self.v2 = self.next1[self.at1], self.next2[self.at2]
        self.p1, self.p2 = self.v1 >> 2, self.v2 >> 2
        share = np.zeros((32, 4), np.int64)
        np.cumsum(self.weights, axis=1, out=share[:, 1:])
        share = (share << int(SHARE)) // share[:, 3:]
        self.start = share[:, [2, 1, 0, 0]].astype(np.uint64).ravel()
        self.width = (share[:, [3, 2, 1, 1]] - share[:, [2, 1, 0, 0]]).astype(np.uint64).ravel()
        cell = ((self.v2 & 3) << 5) + ((self.v1 & 3) << 3) + ((self.p1 == self.p2).view(np.int8) << 2)
        return cell.astype(np.int64)

    def learn(self, ids: np.ndarray, cell: np.ndarray) -> None:
        ids4 = (ids.astype(np.int32) << 2) + 1
        for table, at, v in ((self.next1, self.at1, self.v1), (self.next2, self.at2, self.v2)):
            table[at] = ids4 + (np.minimum(v + 1, v | 3) - ids4) * (v >> 2 == ids4 >> 2)  # arithmetic is faster than np.where
        found = np.bincount(cell, minlength=128).reshape(32, 4)
        self.weights += 8 * np.stack([found[:, 2] + found[:, 3], found[:, 1], found[:, 0]], axis=1)
        while (high := self.weights.sum(axis=1) > 1 << 13).any():  # below the share's bits, so that no part vanishes
            self.weights[high] = (self.weights[high] + 1) >> 1
        self.two_before[: self.n] = self.at1
        self.before[: self.n] = ids
        self.waiting.append(ids)
        if len(self.waiting) == EVERY:
            self.counts += GROWTH * np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.scale()
            self.waiting = []


def moved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Lanes whose upper word is to be moved out, as it is settled or the range small. A small range that has no settled
    word is cut at the next boundary."""
    moving = (a ^ (a + r)) < SETTLED
    small = np.flatnonzero((r < SMALL) > moving)
    if len(small):
        r[small] = (~a[small] + U(1)) & (SMALL - U(1))
        moving[small] = True
    return moving


def layout(n: int) -> tuple[np.ndarray, int]:
    """Lengths of the lanes of n ids, longest first, and the number of steps."""
    lanes = max(1, -(-n // LANE))
    lengths = np.full(lanes, n // lanes, np.int64)
    lengths[: n % lanes] += 1
    return lengths, int(lengths[0])


def in_steps(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Which places of a table of lanes by steps hold ids: all but the last ones of shorter lanes."""
    return np.arange(steps) < lengths[:, None]


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    lengths, steps = layout(len(ids))
    lanes = len(lengths)
    table = np.zeros((lanes, steps), np.int64)
    table[in_steps(lengths, steps)] = ids
    table = np.ascontiguousarray(table.T)
    model = Model(alphabet, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    everyone = np.arange(lanes, dtype=np.min_scalar_type(lanes))
    where, words = [], []

    for t in range(steps):
        n = lanes if t < int(lengths[-1]) else int(np.searchsorted(-lengths, -t))
        now = table[t, :n]
        cell = model.predict(n)
        cell += (model.p2 == now).view(np.int8) << 1
        cell += model.p1 == now
        a, r = low[:n], size[:n]
        r >>= SHARE
        a += r * model.start[cell]
        r *= model.width[cell]
        rest = (cell & 3) == 0
        part, place = r >> COUNT, model.parts[now] * rest
        a += part * (place >> HIGH)
        r *= ~rest
        r += part * (place & LOWER)
        moving = moved(a, r)
        lane = np.flatnonzero(moving)
        where.append(everyone[lane])
        words.append((a[lane] >> TOP).astype(np.uint16))
        bits = moving * WORD
        a <<= bits
        r <<= bits
        while len(lane := lane[moved_again(low, size, lane)]):
            where.append(everyone[lane])
            words.append((low[lane] >> TOP).astype(np.uint16))
            low[lane] <<= WORD
            size[lane] <<= WORD
        model.learn(now, cell)
    for k in (48, 32, 16, 0):
        where.append(everyone)
        words.append((low >> U(k)).astype(np.uint16))
    where = np.concatenate(where)
    order = np.argsort(where, kind="stable")
    body = np.bincount(where, minlength=lanes).astype("<u4").tobytes() + np.concatenate(words)[order].astype("<u2").tobytes()
    head = np.array([len(ids), alphabet, len(body), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    return head.tobytes() + body


def moved_again(low: np.ndarray, size: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """The same for some lanes."""
    r = size[lane]
    moving = moved(low[lane], r)
    size[lane] = r
    return moving


def decode_block(head: np.ndarray, body: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if their checksum differs."""
    count, alphabet, _, checksum = head.tolist()
    lengths, steps = layout(count)
    lanes = len(lengths)
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", offset=4 * lanes), np.zeros(8, "<u2")])
    at = np.cumsum(sizes) - sizes
    model, below, index = Model(alphabet, lanes), None, None
    low, size, code = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << WORD) | words.take(at, mode="clip")
        at += 1
    table = np.zeros((steps, lanes), "<u4")

    for t in range(steps):
        n = lanes if t < int(lengths[-1]) else int(np.searchsorted(-lengths, -t))
        cell = model.predict(n)
        a, r, c, place = low[:n], size[:n], code[:n], at[:n]
        r >>= SHARE
        seen = c - a
        is2, is0 = seen < r * model.width[cell + 2], seen >= r * model.start[cell]
        cell += is2.view(np.int8) << 1
        cell += is2 == is0
        a += r * model.start[cell]
        r *= model.width[cell]
        now = (model.p1 + (model.p2 - model.p1) * is2).astype(np.int64)
        rest = np.flatnonzero(is0)
        if model.below is not below:
            below = model.below
            # per value without its last bits, the last id that begins there or before
            index = np.repeat(np.arange(alphabet), np.diff((below + U(15)) >> NEAR).astype(np.int64))
        part = r[rest] >> COUNT
        seen = c[rest] - a[rest]
        value = np.minimum(seen // part, below[-1] - U(1))
        sym = index[(value >> NEAR).view(np.int64)]
        begun = model.parts[sym]
        late = np.flatnonzero((begun >> HIGH) + (begun & LOWER) <= value)
        if len(late):
            sym[late] = np.searchsorted(below, value[late], "right") - 1
            begun[late] = model.parts[sym[late]]
        a[rest] += part * (begun >> HIGH)
        r[rest], now[rest] = part * (begun & LOWER), sym
        moving = moved(a, r)
        bits = moving * WORD
        a <<= bits
        r <<= bits
        c <<= bits
        c |= words.take(place, mode="clip") * moving
        place += moving
        lane = np.flatnonzero(moving)
        while len(lane := lane[moved_again(low, size, lane)]):
            low[lane] <<= WORD
            size[lane] <<= WORD
            code[lane] = (code[lane] << WORD) | words.take(at[lane], mode="clip")
            at[lane] += 1
        table[t, :n] = now
        model.learn(now, cell)
    out = table.T[in_steps(lengths, steps)]
    if zlib.crc32(out.tobytes()) != checksum:
        raise ValueError("a block of token ids is damaged")
    return out


#: Marks behind a Latin letter, which the tokenizer splits there anyway. An apostrophe may begin a piece with letters.
MARKS_BEHIND = re.compile("[!-&(-/:-@[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)[!-&(-/:-@[-`{-~]*(?=[ \\n]|$)")
WORDS = re.compile("[a-zß-öø-ÿ]{1,64}").fullmatch
TOGETHER = 64  # words that the library encodes as one text
CHUNKS, SEPARATORS = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")


class Encoder:
    """Packed ids of whole texts, from the library. White space only separates in this vocabulary, so each chunk between it
    encodes alone. Chunks that are not remembered are encoded together for all texts at hand."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size()
        self.special = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.alphabet, bool)  # ids that end a word, one for each
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.ends[[i for token, i in self.tokenizer.get_vocab(False).items() if token.endswith(suffix)]] = True
        self.plain = Tokenizer.from_file(path)  # for words, which normalising and splitting by pattern leave as they are
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo = Memo(str, bound=700_000)

    def split(self, text: str) -> list[str]:
        """Chunks, with marks split off and in lower case where the tokenizer does the same. A special string in the text
        is found by its case and its marks, so that such a text stays as it is."""
        lower = text.lower()
        if not any(token in lower for token in self.special):
            try:
                text.encode("latin-1")  # beyond these characters Python's lower case may be another
                text = lower
            except UnicodeEncodeError:
                pass
            text = MARKS_BEHIND.sub(r" \g<0>", text)
        return [c for c in CHUNKS.split(text) if c] if SEPARATORS.search(text) else text.split()

    def texts(self, texts: list[str], end: bytes) -> list[bytes]:
        """`end` goes behind each text."""
        known, parts, missing = self.memo.get, [], set()
        for chunks in map(self.split, texts):
            ids = list(map(known, chunks))
            try:
                parts.append(b"".join(ids) + end)
            except TypeError:  # a None is among them
                parts.append((chunks, ids))
                missing.update(compress(chunks, map(is_, ids, repeat(None))))
        made = self.memo.many(missing, self._chunks).get
        return [part if isinstance(part, bytes) else b"".join(map(made, *part)) + end for part in parts]

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        words = list(filter(WORDS, chunks)) if self.ends.any() else []
        made = dict(zip(words, self._words(words)))
        others = [chunk for chunk in chunks if chunk not in made]
        made.update(zip(others, map(packed, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))))
        return map(made.__getitem__, chunks)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Words are encoded as texts of several; each ends at the next id that ends a word."""
        lines = [" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        ids = b"".join(map(packed, self.plain.encode_batch_fast(lines, add_special_tokens=False)))
        stops = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not end each word by one id")
        return (ids[start:stop] for start, stop in zip([0, *stops], stops))


def packed(encoding: Encoding) -> bytes:
    return array("I", encoding.ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order, a file per range of doc_id. Returns the list of files
    (part, path, ids, docs); parts are in order of doc_id."""
    folder = Folder.new(docs, "ids")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        name, sink, held, size, total = None, None, [], 0, 0
        names, lengths = [], []

        def flush(everything: bool) -> None:
            nonlocal held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            stop = len(ids) if everything else len(ids) // BLOCK * BLOCK
            for low in range(0, stop, BLOCK):
                sink.write(encode_block(ids[low : min(low + BLOCK, stop)], coder.alphabet))
            held, size = [ids[stop:].tobytes()], len(ids) - stop

        for batch in slices(batches):
            if sink is None:
                name, sink = folder.create("part.ids")
                sink.write(MAGIC)
            names.append(batch.column("doc_id"))
            for ids in coder.texts(batch.column("text").to_pylist(), end):
                held.append(ids)
                lengths.append(len(ids) // 4)
                size, total = size + lengths[-1], total + lengths[-1]
                if size >= BLOCK:
                    flush(False)
        if sink is None:
            return
        if size:
            flush(True)
        index = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(lengths, pa.int64())], names=["doc_id", "n"])
        buffer = pa.BufferOutputStream()
        with pa.ipc.new_stream(buffer, index.schema) as stream:
            stream.write_batch(index)
        index = zlib.compress(buffer.getvalue().to_pybytes(), 1)
        sink.write(index + np.array([len(index), zlib.crc32(index)], "<u8").tobytes())
        sink.close()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "ids": total, "docs": len(lengths)}])

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part long, path string, ids long, docs long"))


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files listed: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    listed = cut(files.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")))

    def blocks(source, stop: int) -> Iterator[np.ndarray]:
        source.seek(len(MAGIC))
        while source.tell() < stop:
            head = np.frombuffer(source.read(16), "<u4")
            yield decode_block(head, source.read(int(head[2])))

    def one(path: str, base: int) -> pa.RecordBatch:
        with open_file(path) as source:
            if source.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"not a token file: {path}")
            source.seek(source.size() - 16)
            n, checksum = np.frombuffer(source.read(16), "<u8").tolist()
            stop = source.size() - 16 - n
            source.seek(stop)
            index = source.read(n)
            if zlib.crc32(index) != checksum:
                raise ValueError(f"the index of {path} is damaged")
            index = pa.ipc.open_stream(zlib.decompress(index)).read_all().combine_chunks()
            lengths = index.column("n").to_numpy()
            crcs, stream, ids, at = [], blocks(source, stop), np.zeros(0, "<u4"), 0
            for want in lengths.tolist():
                crc = 0
                while want:
                    if at == len(ids):
                        ids, at = next(stream), 0
                    piece = ids[at : at + want]
                    crc = zlib.crc32(piece.tobytes(), crc)
                    at, want = at + len(piece), want - len(piece)
                crcs.append(crc)
        starts = base + np.cumsum(lengths) - lengths
        doc_ids = index.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield one(row["path"], row["base"])

    # A number keeps adaptive execution from merging the few rows of the list, and with them the reading, into one task.
    return listed.repartition(max(1, listed.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes every whole text of `docs`, appends `end_id`, writes the files and reads them back: one row per row of
    `docs` with doc_id, start, n_tokens (with the end id) and ids_crc32.

    A null text counts as empty: the end id alone. Rows with a null doc_id come first; rows that share a doc_id are in
    order of their texts. Other columns are not read. An empty table gives an empty result. A document may span blocks;
    a task holds one block of ids.
    """
    return read_ids(write_ids(docs, path, end_id))
