"""WARC archives: a writer of one gzip member per record and a reader that splits archives at any byte.

A reading task gets a byte range. It scans the range for the gzip magic, accepts a candidate only if it decompresses to
the first line of a WARC record, and owns the records that start inside its range, wherever they end. Magic bytes that
occur inside compressed data fail that test, so the ranges can be cut anywhere.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Folder, open_file, slices, small_batches
from matchloom.session import cut

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
CHUNK = 1 << 16
#: Fixed values of the record format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"  # the pages carry no date; a fixed one keeps archives reproducible
RECORDS = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record with its HTTP headers; a revisit carries the headers, the digest and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", RECORD_DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of RECORDS from one decompressed record. The digest of a payload that is present is computed anew and
    has to agree with the header."""
    head, _, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    url, refers_to = fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To")
    if refers_to is None and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "url": url,
        "refers_to": None if refers_to is None else refers_to.strip("<>"), "payload": None if refers_to is not None else payload,
    }


def write_archives(pages: DataFrame, level: int = 6) -> DataFrame:
    """pages (record_id, url, payload, digest, refers_to) into one archive per task in the shared folder. Returns the
    list of archives (path, bytes, records); the archive of an attempt that was lost is in no list."""
    folder = Folder.new(pages, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, n, size = None, None, 0, 0
        for batch in slices(batches, of="payload"):
            for row in batch.to_pylist():
                if sink is None:
                    path, sink = folder.create("part.warc.gz")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(row["record_id"], row["url"], row["payload"], row["digest"], row["refers_to"])) + packer.flush()
                sink.write(member)
                n, size = n + 1, size + len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}])

    return cut(small_batches(pages).select("record_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes long, records long"))


def members(path: str, start: int, stop: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """Decompressed WARC records whose gzip member starts in [start, stop) of the file."""
    with open_file(path) as source:
        size, at, held, base = source.size(), start, b"", start

        def bytes_at(low: int, n: int) -> bytes:
            nonlocal held, base
            if low < base or low + n > base + len(held):
                source.seek(low)
                held, base = source.read(min(max(n, chunk), size - low)), low
            return held[low - base : low - base + n]

        while at < stop:
            window = bytes_at(at, min(chunk, stop - at + len(MAGIC) - 1, size - at))
            hit = window.find(MAGIC)
            if hit < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += hit
            if at >= stop:
                return
            unpack, out, pos, good = zlib.decompressobj(31), [], at, False
            try:
                while not unpack.eof and pos < size:
                    piece = bytes_at(pos, min(chunk, size - pos))
                    out.append(unpack.decompress(piece))
                    pos += len(piece)
                    if not good:
                        seen = b"".join(out)
                        if len(seen) >= len(VERSION):
                            good = seen.startswith(VERSION)
                            if not good:
                                break
            except zlib.error:
                good = False
            if good and unpack.eof:
                yield b"".join(out)
                at = pos - len(unpack.unused_data)
            else:
                at += 1


def read_archives(archives: DataFrame, split: int = 4 << 20, most_tasks: int = 20_000) -> DataFrame:
    """Every record of the archives listed (path, bytes), by byte ranges of `split` dealt evenly over the cluster: a task
    per range, or `most_tasks` tasks. A given number is not merged by adaptive execution, which only sees a short list."""
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split).cast("long"))
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "bytes").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for raw in members(row["path"], row["start"], row["stop"]):
                    rows.append(parsed(raw))
                    held += len(raw)
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(min(int(tasks), most_tasks)).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of `pages` and returns the list of archives.

    Of rows with equal payloads of at least `least_bytes` the one with the largest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses as well. A null html is an empty payload; a null
    page_id is written as an empty id, is never revisited unless all ids of its payload are null, and then all of them
    are responses. A null url leaves the target out; line ends in a url are written, and come back, as %0D and %0A. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digest = F.sha1(payload)
    keyed = pages.select(F.col("page_id").cast("long"), digest.alias("digest"), F.length(payload).alias("bytes"))
    copied = keyed.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("holder"))
    copied = cut(copied.where("n > 1 AND holder IS NOT NULL").select("digest", "holder"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), digest.alias("digest"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    refers_to = F.when(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")), name(F.col("holder")))
    return write_archives(rows.join(copied, "digest", "left").withColumn("record_id", name(F.col("page_id"))).withColumn("refers_to", refers_to))


def round_trip(pages: DataFrame, least_bytes: int = 1000, split: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), url and payload, read back from the
    archives of `archive_pages`. An empty table gives an empty result."""
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    back = read_archives(archive_pages(pages, least_bytes), split)
    return back.withColumn("page_id", number(F.col("record_id"))).withColumn("refers_to", number(F.col("refers_to"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
