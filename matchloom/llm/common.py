"""What the operators of this package share: inputs, bounded caches, and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import shared_folder

#: White_Space of the Unicode standard as a character class body. Python's own class adds \x1c-\x1f.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """Has Spark hand rows to Python in batches of at most so many: whole texts and n-gram sets are long, and a batch is
    held on both sides. A setting of the session, which changes no result."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty), plus the columns named. Every other column is pruned at the scan."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


class Memo(dict):
    """make(key) for keys that recur, in two generations of at most `bound` entries; long keys are never kept."""

    def __init__(self, make: Callable, bound: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.bound, self.longest, self.old = make, bound, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: Collection, make_all: Callable[[list], Iterable] | None = None) -> dict:
        """The values of distinct keys. Those not remembered are made by one call for all of them."""
        found = dict(zip(keys, map(self.get, keys)))
        lost = [key for key, value in found.items() if value is None]
        found.update(zip(lost, map(self.old.get, lost)))
        new = [key for key in lost if found[key] is None]
        found.update(zip(new, make_all(new) if make_all else map(self.make, new)))
        for key in lost:
            if len(key) <= self.longest:
                if len(self) >= self.bound:
                    self.old = dict(self)
                    self.clear()
                self[key] = found[key]
        return found


@dataclass(frozen=True)
class Folder:
    """A new folder in the storage that driver and executors share; its files are named by the attempt that wrote them."""

    uri: str

    @staticmethod
    def new(df: DataFrame, kind: str) -> "Folder":
        base = shared_folder(df.sparkSession)
        base = base if "://" in base or base.startswith("file:") else f"file://{base}"
        return Folder(f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}")

    def create(self, name: str) -> tuple[str, "pa.NativeFile"]:
        system, path = open_uri(self.uri)
        system.create_dir(path, recursive=True)
        name = f"{name}-{uuid.uuid4().hex[:12]}"
        return f"{self.uri}/{name}", system.open_output_stream(f"{path}/{name}")


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str) -> "pa.NativeFile":
    system, path = open_uri(uri)
    return system.open_input_file(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 20, of: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most so many rows and about so many bytes of text (one row at least), so that a task
    works on a bounded piece of its input at a time."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(of)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(total, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
