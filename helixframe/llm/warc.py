"""WARC archives: one gzip member per record, written and read in sequence.

Writers stream their partition into files of a bounded size in a shared folder
(any file system that ``pyarrow.fs`` resolves); a file appears under its final
name only when it is complete, so a task that is run again does no harm.  The
reader decompresses in small steps, cuts records by their content length and
verifies block and payload digests while the bytes pass by.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import new_path, store

STEP = 1 << 16
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{PAGE_URN}{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n"
    return packer.compress(raw) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Stream:
    """Decompressed bytes of successive gzip members, at most ``STEP`` at a time."""

    def __init__(self, raw):
        self.raw, self.rest, self.buffer, self.member = raw, b"", bytearray(), None

    def fill(self) -> bool:
        """Decompress a step more of the present member; False at its end."""
        while self.member is not None:
            if self.member.eof:
                return False
            if not self.rest:
                self.rest = self.raw.read(STEP)
            out = self.member.decompress(self.rest, STEP)
            if not self.rest and not out:
                raise ValueError("truncated member")
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.buffer += out
            if out:
                return True
        return False

    def begin(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.raw.read(STEP)
        self.member = zlib.decompressobj(31) if self.rest else None
        self.buffer = bytearray()
        return self.member is not None

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                raise ValueError("header without end")
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("block shorter than its content length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(value: str | None) -> int | None:
    return int(value[len(PAGE_URN) + 1 : -1]) if value else None


def read_records(raw, payloads: bool = False) -> Iterator[dict]:
    """Records of an open archive, one gzip member after another.

    ``raw`` needs ``read(n)``.  Memory is bounded by ``STEP`` and the headers,
    unless ``payloads`` asks for the payloads themselves.  A damaged record ends
    the file and is reported as a last row with ``error`` set.
    """
    stream = _Stream(raw)
    try:
        while stream.begin():
            head = _fields(stream.until(b"\r\n\r\n"))
            length = int(head["content-length"])
            block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
            http, seen, http_head = bytearray(), 0, None
            for part in stream.take(length):
                block.update(part)
                if http_head is None:
                    http += part
                    if (at := http.find(b"\r\n\r\n")) < 0:
                        continue
                    http_head, part = _fields(bytes(http[:at])), bytes(http[at + 4 :])
                seen += len(part)
                payload.update(part)
                if payloads:
                    kept.append(part)
            if b"".join(stream.take(4)) != b"\r\n\r\n":
                raise ValueError("record without its end mark")
            if stream.buffer or stream.fill():
                raise ValueError("bytes after the record in its member")
            revisit = head["warc-type"] == "revisit"
            stated = head["warc-payload-digest"].partition(":")[2]
            whole = int((http_head or {}).get("content-length", seen))
            good = base64.b32encode(block.digest()).decode() == head["warc-block-digest"].partition(":")[2]
            if not revisit:
                good = good and whole == seen and base64.b32encode(payload.digest()).decode() == stated
            yield {
                "page_id": _page(head.get("warc-record-id")),
                "url": head.get("warc-target-uri"),
                "payload_bytes": whole,
                "payload_digest": stated,
                "record_type": head["warc-type"],
                "refers_to": _page(head.get("warc-refers-to")),
                "digest_ok": good,
                "payload": b"".join(kept) if payloads and not revisit else None,
                "error": None,
            }
    except (ValueError, KeyError, zlib.error) as e:
        yield {"error": f"{type(e).__name__}: {e}", "digest_ok": False}


RECORD = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
     T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
     T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
     T.StructField("digest_ok", T.BooleanType()), T.StructField("payload", T.BinaryType()),
     T.StructField("error", T.StringType())]
)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into ``path``/*.warc.gz; returns the list of files.

    Of equal payloads (null: empty) of at least ``min_bytes`` bytes, the row
    with the smallest id is a response and the others are revisits of it;
    smaller payloads are all responses.  A row with a null id is always a
    response; rows that repeat both id and payload are alike.  Other columns are
    ignored.

    Only (digest, id) pairs are grouped, with partial sums before the shuffle;
    the payloads move at most once, dealt evenly by id.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"),
    )
    key = F.when(F.length("payload") >= min_bytes, F.sha1("payload"))
    keyed = rows.withColumn("digest", key)
    owners = (
        keyed.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and owner is not null")
        .select("digest", "owner")
    )
    ids = keyed.select("page_id", "digest").filter("page_id is not null and digest is not null").distinct()
    # (id, digest) -> owner for the rows that revisit one, then a join by row key
    revisits = ids.join(owners, "digest").filter("page_id <> owner")
    marked = keyed.join(
        revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "owner"),
        (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")),
        "left",
    ).select("page_id", "url", "payload", "owner")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _file_system(path)
        where.create_dir(base, recursive=True)
        out, size, count, name = None, 0, 0, ""
        done: list[tuple[str, int, int]] = []

        def close():
            out.close()
            where.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((name, count, size))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, owner = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/.{name}", compression=None)
                raw = record(page_id, url, payload, owner)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            ["file", "records", "bytes"],
        )

    files = marked.mapInArrow(write, "file string, records long, bytes long")
    # the list is written once: a file of a task that was run again is not in it
    return store(files.select(F.concat(F.lit(path + "/"), "file").alias("file"), "records", "bytes"), "warc-files")


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives listed in column ``file``, each file by one task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                where, base = _file_system(name)
                rows: list[dict] = []
                with where.open_input_stream(base, compression=None) as raw:
                    for row in read_records(raw, payloads):
                        rows.append(row)
                        if len(rows) >= (64 if payloads else 4096):
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    spark = files.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()))
    return files.select("file").repartition(tasks).mapInPandas(read, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=RECORD.fieldNames())
    for c in ("page_id", "payload_bytes", "refers_to"):
        frame[c] = frame[c].astype("Int64")
    return frame


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back."""
    files = write_archives(pages, new_path(pages.sparkSession, "warc"), min_bytes=min_bytes)
    return read_archives(files).drop("payload")
