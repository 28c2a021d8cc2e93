"""Near duplicates by an n-gram Jaccard join on chosen paths.

Every text is the set of its word n-grams. In each run a set picks the members whose shared random number is below
children / size; sets that pick the same member meet in a bucket. Buckets that stay large are split again by the picks of
the next level, small ones are compared member by member. Runs repeat until a pair at the threshold meets in one of them
with the target recall. Buckets still large at the last level are compared block by block, so nothing is given up.

Exact copies collapse to one set first. The first run labels most groups. The large buckets of all runs are compared with
one pivot each: where the members are like the pivot on average, splitting would hardly separate them, so the cores of
such buckets are compared block by block at once. Later runs skip buckets whose sets carry one label or are of one core. Links inside the
classes found are then counted exactly, block against block, without a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from matchloom.llm.common import slices, small_batches
from matchloom.session import cut

GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.995  # of a pair just at the threshold; others, and classes of several links, come out above it
    children: float = 1.5  # expected picks of a set at each level; sets less alike than 1 / children part level by level
    levels: int = 5
    bucket: int = 64  # sets that are compared member by member
    block: int = 256  # sets of a block where large groups are compared
    dense: float = 0.4  # mean similarity to the pivot from which a large bucket is not split but compared

    @property
    def runs(self) -> int:
        """A pair at the threshold shares children * threshold picks at each level at least; that branching process
        survives all levels with probability p, and (1 - p) ** runs must be within the recall missed."""
        p = 1.0
        for _ in range(self.levels):
            p = 1 - math.exp(-self.children * self.threshold * p)
        return max(2, math.ceil(math.log(1 - self.recall) / math.log(1 - p)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
#: Powers of an odd base and of its inverse modulo 2**64, extended as longer buffers come.
BASE = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(base))]), dtype=np.uint64)
    return _POWERS


def words_of(column: pa.Array, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than spaces) of an array of texts, and the bounds of each text."""
    column = column.cast(pa.large_string())
    if not column.null_count == 0:
        column = column.fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    at = at - low
    inside = ~spaces[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTERS[raw] * up[: len(raw)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * GOLD), np.searchsorted(s, at)


def shingles(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of every distinct n-gram in order of text and hash, and the number per text. A text of fewer words
    has one n-gram, all its words; a text without words has none."""
    hashes, bounds = words_of(batch.column("text"))
    n = np.diff(bounds)
    grams = np.maximum(n - words + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), grams)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + bounds[:-1][owner]
    out, stop = np.zeros(len(owner), np.uint64), bounds[1:][owner]
    for k in range(words):
        at = start + k
        there = at < stop
        out[there] = mix(out[there] * np.uint64(31) + hashes[at[there]] + np.uint64(k + 1))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, owner, np.bincount(owner, minlength=len(n)).astype(np.int64)


def signatures(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Per text: key (of the n-gram set), size, set (sorted 32-bit n-gram hashes), first (picks of level 1, with their
    runs) and deeper[run * (levels - 1) + level - 1]."""
    slots, firsts = config.runs * config.levels, config.runs
    seeds = mix(np.arange(1, slots + 1, dtype=np.uint64) * GOLD) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gram, owner, size = shingles(batch, config.words)
            rows = batch.num_rows
            below = (np.minimum(config.children / np.maximum(size, 1), 1.0) * float(1 << 53)).astype(np.uint64)[owner]
            where, token = [], []
            for slot in range(slots):  # level 1 of all runs, then the deeper levels run by run
                picked = np.flatnonzero((mix(gram * seeds[slot]) >> np.uint64(11)) <= below)
                where.append(owner[picked] * slots + slot)
                token.append(gram[picked] ^ seeds[slot])
            where, token = np.concatenate(where), np.concatenate(token)
            order = np.argsort(where, kind="stable")
            where, token = where[order], token[order].view(np.int64)
            row, slot = where // slots, where % slots
            early = slot < firsts
            begins = np.concatenate([[0], np.cumsum(np.bincount(row[early], minlength=rows))]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(slot[early].astype(np.int32)), pa.array(token[early])], names=["run", "path"])
            first = pa.ListArray.from_arrays(pa.array(begins), runs)
            cells = row[~early] * (slots - firsts) + slot[~early] - firsts
            inner = np.concatenate([[0], np.cumsum(np.bincount(cells, minlength=rows * (slots - firsts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(token[~early]))
            deeper = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (slots - firsts)), lists)
            small = (gram >> np.uint64(32)).astype(np.uint32)  # the order stays, as these are the upper bits
            ends = np.cumsum(size)
            sets = [small[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())]
            keys = [xxh3_128_digest(gram[e - n : e].tobytes()) for e, n in zip(ends.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(sets, pa.binary()), first, deeper],
                names=["doc_id", "text_hash", "key", "size", "set", "first", "deeper"],
            )

    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    schema = ("doc_id long, text_hash long, key binary, size long, set binary, first array<struct<run: int, path: long>>, "
              "deeper array<array<long>>")
    return rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, over the tokens that at least two sets hold, a bounded number of columns a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets) if n else np.zeros(0, np.uint32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out, width = np.zeros((n, n), np.float32), 1 + int(column.max(initial=-1))
    for low in range(0, width, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((n, min(4096, width - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by whole numbers: inter / (a + b - inter) >= p / q."""
    t = Fraction(str(threshold))
    size = np.array([len(s) for s in sets], np.int64)
    inter = overlaps(sets)
    out = inter * (t.numerator + t.denominator) >= t.numerator * (size[:, None] + size[None, :])
    np.fill_diagonal(out, False)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns in a partition sorted by them; a run is one bucket or pair of blocks."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def roots(links: np.ndarray) -> list[int]:
    """Smallest index linked to each, through any number of links."""
    root, seen = list(range(len(links))), np.zeros(len(links), bool)
    for i in range(len(links)):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            for j in np.flatnonzero(links[todo.pop()] & ~seen).tolist():
                seen[j], root[j] = True, i
                todo.append(j)
    return root


def dealt(rows: DataFrame) -> DataFrame:
    return rows.select("path", "uid", "set").repartition("path").sortWithinPartitions("path", "uid")


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (path, uid, set): edges (a, b), a > b, from each set of a bucket to the first that it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = set()
        for _, bucket in groups(batches, 1):
            bucket = sorted(set(bucket))
            links = roots(alike([np.frombuffer(p, np.uint32) for _, p in bucket], threshold))
            edges.update((bucket[i][0], bucket[r][0]) for i, r in enumerate(links) if r != i)
        a, b = zip(*sorted(edges)) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt(rows).mapInArrow(run, "a long, b long")


def to_pivot(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (path, uid, set): per member of a bucket its similarity to the bucket's first set, and whether it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, t = None, None, Fraction(str(threshold))
        for batch in batches:
            out = []
            for path, uid, packed in zip(*(c.to_pylist() for c in batch.columns)):
                mine = np.frombuffer(packed, np.uint32)
                if path != now:
                    now, first = path, (uid, mine)
                inter, both = len(np.intersect1d(mine, first[1], assume_unique=True)), len(mine) + len(first[1])
                linked = inter * (t.numerator + t.denominator) >= t.numerator * both and uid != first[0]
                out.append({"path": path, "uid": uid, "pivot": first[0], "linked": linked, "like": inter / (both - inter)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.int64()), ("uid", pa.int64()), ("pivot", pa.int64()),
                                                             ("linked", pa.bool_()), ("like", pa.float64())]))

    return dealt(rows).mapInArrow(run, "path long, uid long, pivot long, linked boolean, like double")


def with_column(rows: DataFrame, signs: DataFrame, name: str) -> DataFrame:
    """Adds a column of the signatures by uid. A bit filter of fixed size (1 MB at most) over the uids wanted keeps most
    of the others out of the shuffle; where it fills up it only lets more through."""
    bit = f"pmod(xxhash64(uid), {FILTER_BITS})"
    word, flag = F.expr(f"cast({bit} div 63 as int)"), F.expr(f"shiftleft(1L, cast({bit} % 63 as int))")
    words = F.broadcast(rows.select(word.alias("word"), flag.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    few = signs.select("uid", name).join(words, word == F.col("word")).where(F.col("bits").bitwiseAND(flag) != 0).select("uid", name)
    return rows.join(few, "uid")


def components(edges: DataFrame) -> DataFrame:
    """(uid, label) of every node of `edges` (a > b): alternating large and small stars until nothing moves."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("uid"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def bucket_sizes(paths: DataFrame, split_above: int | None = None) -> DataFrame:
    """(path, sets) of buckets whose sets carry several labels and are not of one core; of buckets with the very same
    members only one. Buckets of more than `split_above` sets are split by the picks of their run, so of those one per
    run stays: each run is a try of its own."""
    own = F.lit(-1) if split_above is None else F.when(F.col("sets") > split_above, F.col("run")).otherwise(-1)
    out = paths.groupBy("path").agg(
        F.count("*").alias("sets"), F.min("run").alias("run"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("members"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("core").alias("first"), F.max("core").alias("last"),
    ).where("sets > 1 AND low <> high AND first <> last")
    return out.groupBy("sets", "members", own.alias("own")).agg(F.min("path").alias("path")).select("path", "sets")


def blocks(rows: DataFrame, size: str, config: JoinConfig) -> DataFrame:
    """Deals the rows of each group into blocks and repeats a row for every pair of blocks that it belongs to."""
    n = F.ceil(F.col(size) / config.block).cast("int")
    mine = F.pmod(F.xxhash64("uid", F.lit(7)), n).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")


def linked_classes(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the smallest doc_id reached over links), n_links (other rows whose
    n-gram set has the threshold's similarity or more, exact copies included), text_hash, class_uid (a class number that
    holds within this result).

    A null or empty text, or one without words, has no n-grams: it is alone in its class, without links. Texts of fewer
    words than an n-gram have one, so equal short texts are copies. Repeated rows are copies of each other; a null
    doc_id stays null and never becomes a class_id unless a class has no other. Other columns are not read. An empty
    table gives an empty result. N-gram sets are compared as 32-bit hashes, which moves a similarity by less than
    size / 2**32.
    """
    signs = cut(signatures(docs, config))
    some = signs.where("size > 0")
    reps = some.groupBy("key").agg(F.min(F.struct("uid", "first")).alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least_doc"))
    reps = cut(reps.select("key", "rep.*", "copies", "least_doc"))
    picked = cut(reps.select("uid", F.explode("first").alias("x")).select("uid", "x.run", "x.path"))
    met = picked.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")  # most picks are of one set alone
    level_1 = cut(picked.join(met, "path").select("uid", "run", "path"))

    # The first run, and the large buckets of all runs: every set its own label and core.
    alone = F.struct(F.lit(0).cast("long").alias("kind"), F.col("uid").alias("of")).alias("core")
    start = level_1.select("uid", "run", "path", F.col("uid").alias("label"), alone)
    sizes = cut(bucket_sizes(start))
    small = with_column(start.where("run = 0").join(sizes.where(f"sets <= {config.bucket}").select("path"), "path"), signs, "set")
    near = cut(to_pivot(with_column(start.join(sizes.where(f"sets > {config.bucket}").select("path"), "path"), signs, "set"), config.threshold))
    dense = near.groupBy("path").agg(F.avg("like").alias("mean")).where(f"mean >= {config.dense}").select("path")
    # Dense buckets that share sets make one core: all its pairs are compared below, so later runs need none of them.
    core = cut(components(near.where(f"like >= {config.dense / 2}").join(dense, "path").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))))
    core = core.select("uid", F.col("label").alias("path"))
    core_sizes = core.groupBy("path").agg(F.count("*").alias("sets"))
    inner = blocks(with_column(core.join(core_sizes, "path"), signs, "set"), "sets", config).withColumn("path", F.xxhash64("path", "i", "j"))
    edges = cut(compared(small, config.threshold).union(near.where("linked").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))).union(
        compared(inner, config.threshold)))
    labels = components(edges)

    # Later runs, and what is left of the first: only buckets that hold several labels and cores.
    known = level_1.join(labels, "uid", "left").join(core.select("uid", F.col("path").alias("core")), "uid", "left")
    own = F.struct(F.col("core").isNotNull().cast("long").alias("kind"), F.coalesce("core", "uid").alias("of"))
    paths = cut(known.select("uid", "run", "path", F.coalesce("label", "uid").alias("label"), own.alias("core")))
    found = [edges]
    for level in range(1, config.levels + 1):
        sizes = cut(bucket_sizes(paths, config.bucket if level < config.levels else None))
        small = paths.join(sizes.where(f"sets <= {config.bucket}").select("path"), "path")
        if level == 1:
            small = small.where("run > 0")
        found.append(cut(compared(with_column(small, signs, "set"), config.threshold)))
        large = paths.join(sizes.where(f"sets > {config.bucket}"), "path")
        if level == config.levels:
            rest = blocks(with_column(large, signs, "set"), "sets", config)
            found.append(cut(compared(rest.withColumn("path", F.xxhash64("path", "i", "j")), config.threshold)))
            break
        if sizes.where(f"sets > {config.bucket}").isEmpty():
            break
        spread = with_column(large, signs, "deeper").select(
            "uid", "run", "label", "core", "path", F.explode(F.col("deeper")[F.col("run") * (config.levels - 1) + level - 1]).alias("token"))
        paths = cut(spread.select("uid", "run", "label", "core", F.xxhash64("path", "token").alias("path")))
    everything = found[0]
    for more in found[1:]:
        everything = everything.union(more)
    classes = cut(components(everything))

    # Exact links inside the classes, block against block.
    sized = classes.join(classes.groupBy("label").agg(F.count("*").alias("sets")), "label")
    weighted = with_column(sized.join(reps.select("uid", "copies"), "uid"), signs, "set")
    dealt = blocks(weighted, "sets", config).select("label", "i", "j", "mine", "uid", "copies", "set")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, links = [], []
        for (_, i, j), rows in groups(batches, 3):
            rows = list({r[1]: r for r in rows}.values())
            ok = alike([np.frombuffer(r[3], np.uint32) for r in rows], config.threshold)
            side = np.array([r[0] for r in rows])
            if i != j:
                ok &= side[:, None] != side[None, :]
            uids += [r[1] for r in rows]
            links += (ok @ np.array([r[2] for r in rows], np.int64)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(links, pa.int64())], names=["uid", "links"])

    counted = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "uid").mapInArrow(count, "uid long, links long")
    links = counted.groupBy("uid").agg(F.sum("links").alias("links"))
    least = classes.join(reps.select("uid", "least_doc"), "uid").groupBy("label").agg(F.min("least_doc").alias("class_doc"))
    judged = reps.join(classes, "uid", "left").join(least, "label", "left").join(links, "uid", "left").select(
        "key", F.coalesce("class_doc", "least_doc").alias("class_id"), F.coalesce("label", "uid").alias("class_uid"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    judged = cut(judged)
    shared = some.select("doc_id", "text_hash", "key").join(judged, "key")
    alone = signs.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.col("uid").alias("class_uid"))
    return shared.select("doc_id", "class_id", "n_links", "text_hash", "class_uid").union(alone)


def one_of_each(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """The rows of `docs` that stay: of each class the one with the smallest doc_id (null last, then by text hash); of
    rows that repeat it exactly, one. Rows without words are never copies and all stay."""
    found = linked_classes(docs, config)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = found.groupBy("class_uid").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    kept = cut(kept.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.lit(True).alias("_in")).distinct())
    marked = docs.withColumn("_hash_", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = marked["doc_id"].eqNullSafe(kept["_doc"]) & (marked["_hash_"] == kept["_hash"])
    chosen = marked.join(kept, same, "left_semi")
    words = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[ \\t-\\r]", "")) > 0
    return chosen.where(words).dropDuplicates(["doc_id", "_hash_"]).union(chosen.where(~words)).drop("_hash_")
