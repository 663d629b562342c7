"""WARC archives: write pages as records, read archives back sequentially.

Writing: the payload digest and the answer "which record has this payload
already" come from DataFrame functions; the hot payloads (over 1/1000 of all
rows) are looked up by broadcast. Each task then writes its rows to archives
of its own in the shared folder, one gzip member per record, under a
temporary name that is moved into place when the archive is whole, so a
retried or speculative task replaces equal bytes. A manifest row per archive
is written as a table.

Reading: one task per archive. ``records`` feeds chunks to an incremental
zlib decompressor, one member at a time; the header block ends at the empty
line, the content is framed by Content-Length, and block and payload digests
are verified. Nothing larger than a record is held.

Defined results: NULL html counts as empty; a NULL url leaves out the target
URI; control characters, spaces and non-ASCII characters of a URL are
percent-encoded in its header. Of equal payloads the row with the largest
page_id is the response (all rows of that id, if it repeats); if all page_ids
are NULL, all are responses. Extra columns are ignored; an empty table gives
no rows. A damaged record raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, only_ids, run_dir, slices, without_ids

VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"   # fixed, so that a rerun writes equal bytes
MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 256 << 20       # an archive is closed beyond this size
MAX_READERS = 100_000       # tasks that read archives, at most
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_folder(folder: str):
    """(file system, path) of a folder URI or a plain path."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


# --- records ----------------------------------------------------------------

def _record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def make_record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One record as one gzip member: a response, or a revisit of ``refers_to``."""
    payload_digest = sha1_base32(payload)
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream, size: int = READ_BYTES):
    """Decompressed chunks of a gzip stream: (chunk, whether a member ends)."""
    data = stream.read(size)
    while data:
        machine = zlib.decompressobj(31)
        while True:
            out = machine.decompress(data, size)
            if machine.eof:
                data = machine.unused_data
                yield out, True
                break
            yield out, False
            data = machine.unconsumed_tail or stream.read(size)
            if not data and not out:
                raise WarcError("a gzip member ends early")
        data = data or stream.read(size)


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in
            (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def records(stream):
    """(headers, HTTP headers, payload) of every record, digests verified."""
    held = bytearray()
    head, end = None, 0
    for chunk, over in members(stream):
        held += chunk
        if head is None and (at := held.find(b"\r\n\r\n")) >= 0:
            if not held.startswith(b"WARC/1."):
                raise WarcError("no WARC version line")
            head = _fields(bytes(held[:at]))
            del held[:at + 4]
            end = int(head["content-length"])
        if not over:
            continue
        if head is None or len(held) != end + 4 or held[end:] != b"\r\n\r\n":
            raise WarcError("the content does not have the length its header gives")
        block = bytes(held[:end])
        if head.get("warc-block-digest", "") not in ("", f"sha1:{sha1_base32(block)}"):
            raise WarcError(f"block digest of {head.get('warc-record-id')}")
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            at = block.find(b"\r\n\r\n")
            http, payload = _fields(block[:at]), block[at + 4:]
        if head.get("warc-type") != "revisit" and "warc-payload-digest" in head \
                and head["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}":
            raise WarcError(f"payload digest of {head.get('warc-record-id')}")
        yield head, http, payload
        held.clear()
        head = None
    if head is not None or held:
        raise WarcError("a record ends early")


# --- Spark ------------------------------------------------------------------

def plan_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """page_id, url, payload and the page_id each row refers to (or NULL)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("payload_key"))
    firsts = cut(digests.groupBy("payload_key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")),
                 "warc-payloads")
    # Only payloads that occur again need a lookup; the other rows stay in place.
    again = firsts.where((F.col("n") > 1) & F.col("first_id").isNotNull())
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = rows.withColumn("payload_key", F.sha2(F.col("html").cast("binary"), 256)).withColumn(
        "key_hash", F.xxhash64("payload_key"))
    ids = cut(again.select(F.xxhash64("payload_key").alias("key_hash")).distinct(), "warc-again")
    repeated = join_hot(only_ids(keyed, ids, "key_hash"), again, "payload_key", "n", total).select(
        "page_id", "url", "html",
        F.when((F.octet_length("html") >= min_revisit_bytes)
               & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    single = without_ids(keyed, ids, "key_hash").select(
        "page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    return single.unionByName(repeated)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) rows; the manifest is read back."""

    def run(batches):
        task = TaskContext.get()
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        part, sink, temp, n, size = 0, None, None, 0, 0

        def close():
            sink.close()
            path = f"{root}/pages-{task.partitionId():06d}-{part:04d}.warc.gz"
            store.move(temp, path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in batches:
            for columns in slices(batch, ["page_id", "url", "html", "refers_to"], 256):
                for page_id, url, html, refers_to in zip(*columns):
                    if sink is None:
                        temp = f"{root}/.{uuid.uuid4().hex}.tmp"
                        sink, n, size = store.open_output_stream(temp, compression=None), 0, 0
                    record = make_record(page_id, url, html.encode(), refers_to)
                    sink.write(record)
                    n, size = n + 1, size + len(record)
                    if size >= archive_bytes:
                        yield close()
                        part, sink = part + 1, None
        if sink is not None:
            yield close()

    return cut(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Parsed records of the archives that the manifest lists."""

    def run(batches):
        store, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for head, http, payload in records(stream):
                        rows.append(_row(head, http, payload))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # An archive has a bounded size and is a task's work: as many tasks as archives,
    # a fixed number, since the bytes of their paths say nothing about them.
    n = min(MAX_READERS, max(1, manifest.count()))
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(run, SCHEMA)


def _page_id(uri: str | None):
    tail = (uri or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail not in ("", "null") else None


def _row(head, http, payload):
    revisit = head["warc-type"] == "revisit"
    size = int(http["content-length"]) if revisit else len(payload)
    return (_page_id(head["warc-record-id"]), size, head["warc-payload-digest"].partition(":")[2],
            head["warc-type"], _page_id(head.get("warc-refers-to")))


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder, then read them back."""
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    manifest = write_archives(plan_revisits(pages, min_revisit_bytes), folder)
    return read_archives(spark, manifest, folder)
