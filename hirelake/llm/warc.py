"""WARC archives: one gzip member per record, and a reader that splits files by byte range.

Writer.  A record holds an HTTP response (``response``) or only its headers
(``revisit``, where an equal payload is stored under another id).  Each task
writes one file into a folder of the shared store and reports its name and
size; a file of a task that was lost is never in the report, so never read.

Reader.  Files are cut into byte ranges, one row each.  A task looks for gzip
magic from the start of its range, accepts a candidate only if it inflates to a
whole WARC header with a type, an id and a length, and then follows members to
the end of the range: it owns the records that start inside.  After damage it
looks for the next member.  One record is in memory at a time.

A member that does not inflate, breaks off, or whose digest or length is not as
its header says, is a row too: ``record_type`` is ``damaged``, ``error`` says why,
``file`` and ``position`` where; so are bytes after a record that begin no record.
``read_stored`` compares what is read with what was written and fails on any
difference.  A payload stored without compression that holds whole members can
still be taken for records by a range that starts inside it; text in UTF-8
cannot hold the magic.

Defined cases: null payloads and urls are empty; payloads under ``MIN_REVISIT``
bytes are always responses; of equal payloads the largest id is the response,
and rows that repeat it are responses too; null ids are written with an empty
id and read as null; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import column, shared_dir, total, whole, written

MIN_REVISIT = 1000
SPLIT_BYTES = 4 << 20
#: Bytes of a candidate that are inflated at a time while its header is looked for.
PROBE, BUFFER, LEVEL = 512, 1 << 18, 4
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_type string, id string, refers_to string, url string, payload_digest string, payload_bytes bigint, payload binary, "
          "file string, position bigint, error string")
DAMAGED = "damaged"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to): ``refers_to`` is set where an equal payload is stored elsewhere."""
    rows = pages.select(column(id_col).alias("id"), whole("url").alias("url"), whole(payload_col).cast("binary").alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "strong": F.unhex(F.sha2("payload", 256))})
    keys = rows.where(F.octet_length("payload") >= least).groupBy("digest", "strong").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("c"))
    keys = written(keys.where("c > 1").select("digest", "strong", "first"), "warc-equal")
    return rows.join(keys, ["digest", "strong"], "left").select(
        "id", "url", "payload", "digest", F.when(F.col("first") != F.coalesce("id", F.lit(-1)), F.col("first")).alias("refers_to"))


def record_bytes(kind: str, ident: str, url: str, payload: bytes, digest: str, refers_to: str) -> bytes:
    """A record as WARC/1.1 text; the digest is bare hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{ident}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
              ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; the payload's size comes from the HTTP header, so revisits have it too."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = _header(head)
    if len(rest) < int(field["content-length"]):
        raise ValueError("a block is shorter than its header says")
    http, _, payload = rest[:int(field["content-length"])].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    ident = lambda name: field.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    kind, digest = field["warc-type"], field.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if found != digest or size != len(payload):
            raise ValueError(f"payload of record {ident('warc-record-id')} is damaged")
    return {"record_type": kind, "id": ident("warc-record-id"), "refers_to": ident("warc-refers-to"), "url": field.get("warc-target-uri", ""),
            "payload_digest": digest, "payload_bytes": size, "payload": payload}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as of :func:`plan_records`) as .warc.gz files; returns (file, bytes, records), kept as a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, count = None, 0
        for batch in batches:
            for i, u, p, d, r in zip(*(batch.column(c).to_pylist() for c in range(5))):
                out = out or fs.open_output_stream(name, compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                kind = "response" if r is None else "revisit"
                raw = record_bytes(kind, "" if i is None else str(i), u, p, d, "" if r is None else str(r))
                out.write(packer.compress(raw) + packer.flush())
                count += 1
        if out:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([fs.get_file_info(name).size], pa.int64()), pa.array([count], pa.int64())], names=["file", "bytes", "records"])

    return written(records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file string, bytes bigint, records bigint"), "warc-files")


class _Source:
    """Bytes of an open file from a position on, with a small read-ahead."""

    def __init__(self, f: pa.NativeFile, size: int) -> None:
        self.f, self.size, self.at, self.held = f, size, 0, b""

    def read(self, position: int, n: int) -> bytes:
        lo = position - self.at
        if lo < 0 or lo + n > len(self.held):
            self.f.seek(position)
            self.at, self.held, lo = position, self.f.read(max(n, BUFFER)), 0
        return self.held[lo:lo + n]


def _header(raw: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; an error if it is none, or lacks its type, id or length."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not field.get("warc-type") or not field.get("warc-record-id") or not field.get("content-length", "").isdecimal():
        raise ValueError("header without type, id or length")
    return field


def _is_record(src: _Source, at: int) -> bool:
    """Whether a gzip member at this position inflates to a whole WARC header."""
    opened, head = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in head:
            block = src.read(at, min(PROBE, src.size - at))
            if not block or opened.eof:
                return False
            head += opened.decompress(block)
            at += len(block)
            if head[:7] != b"WARC/1."[:len(head)]:
                return False
        _header(head.partition(b"\r\n\r\n")[0])
        return True
    except (zlib.error, ValueError):
        return False


def _next_record(src: _Source, at: int, end: int) -> int | None:
    """First record that starts in [at, end)."""
    while at < end:
        block = src.read(at, min(BUFFER, end - at + len(MAGIC) - 1, src.size - at))
        hit = block.find(MAGIC)
        while hit >= 0 and at + hit < end:
            if _is_record(src, at + hit):
                return at + hit
            hit = block.find(MAGIC, hit + 1)
        at += max(1, len(block) - len(MAGIC) + 1)
    return None


def _member(src: _Source, at: int) -> tuple[bytes, int]:
    """Inflated member and the position after it."""
    opened, out = zlib.decompressobj(31), []
    while not opened.eof:
        block = src.read(at, min(BUFFER, src.size - at))
        if not block:
            raise ValueError("a member is cut off")
        out.append(opened.decompress(block))
        at += len(block) - len(opened.unused_data)
    return b"".join(out), at


def records_in(path: str, fs: pafs.FileSystem, begin: int, end: int, damage: bool = False) -> Iterator[dict]:
    """Records that start in the byte range, in order; with ``damage`` also a row per damaged place."""

    def broken(at: int, why: Exception | str) -> Iterator[dict]:
        if damage:
            yield {**dict.fromkeys(f.split()[0] for f in RECORD.split(", ")), "record_type": DAMAGED, "file": path, "position": at, "error": str(why)}

    with fs.open_input_file(path) as f:
        src = _Source(f, f.size())
        at = _next_record(src, begin, min(end, src.size))
        while at is not None:
            try:
                raw, after = _member(src, at)
                yield {**parse_record(raw), "file": path, "position": at, "error": None}
            except (zlib.error, ValueError) as why:
                yield from broken(at, why)
                after = _next_record(src, at + 1, min(end, src.size))
                if after is None:
                    return
            at = after if after < end and after < src.size else None
            if at is not None and not _is_record(src, at):
                yield from broken(at, "no record begins here")
                at = _next_record(src, at, min(end, src.size))


def read_archives(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records and damaged places of the files (file, bytes): see ``RECORD``.  Without ``payloads`` that column is null; digests are checked all the same."""
    ranges = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    splits = files.where("bytes > 0").select("file", ranges.alias("begin"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = splits.repartition(n, "file", "begin")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = pa.schema([(n_, pa.int64() if n_ in ("payload_bytes", "position") else pa.binary() if n_ == "payload" else pa.string()) for n_ in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(folder)
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for record in records_in(path, fs, begin, begin + split_bytes, damage=True):
                    size += 500 + (len(record["payload"] or b"") if payloads else 0)
                    held.append(record if payloads else {**record, "payload": None})
                    if size > BUFFER * 16:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    return splits.mapInArrow(read, RECORD)


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of all .warc.gz files in a folder; names only pass through the driver."""
    fs, path = _store(folder)
    found = [(i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".warc.gz")]
    return spark.createDataFrame(found, "file string, bytes bigint")


def store_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Write all pages to a fresh folder of the shared store; its files and its name."""
    folder = shared_dir(pages.sparkSession, "warc")
    return write_archives(plan_records(pages, id_col, payload_col), folder), folder


def read_stored(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records, without payloads, of files that :func:`write_archives` reported, kept as a table; an error if any is damaged, missing or too many."""
    back = written(read_archives(files, folder, split_bytes, payloads=False), "warc-read")
    stored = total(files, F.coalesce(F.sum("records"), F.lit(0)))[0]
    bad, found = total(back, F.count_if(F.col("record_type") == DAMAGED), F.count_if(F.col("record_type") != DAMAGED))
    if bad or found != stored:
        raise RuntimeError(f"{stored} records were written, {found} read, {bad} places are damaged")
    return back


def id_of(c: Column) -> Column:
    return F.when(c != "", c).cast("bigint")
