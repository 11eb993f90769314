"""WARC archives: one gzip member a record, written and read back sequentially.

The reader inflates with an incremental zlib object, a fixed amount of input at a time.
Where a member ends, the next begins; header lines are read up to the blank line,
``Content-Length`` frames the block, and the block and payload digests are recomputed and
compared. Only one record is in memory at any time.

Archives go to the cluster's shared folder through ``pyarrow.fs`` (local, HDFS or object
store paths alike), one file a task attempt; the manifest holds the files of the attempts
that counted, so a repeated task leaves an orphan but no wrong record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, spread

MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 18


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _header_value(text: str) -> str:
    """One header line's worth: control characters would break the framing."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member. A revisit has no payload but keeps its digest and length."""
    block = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: text/html",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class WarcError(ValueError):
    pass


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a binary stream; raises WarcError on broken framing or digests."""
    left = b""
    while True:
        if not left:
            left = stream.read(_PIECE)
            if not left:
                return
        member, raw = zlib.decompressobj(31), bytearray()
        headers, start, need = None, 0, None
        while not member.eof:
            if not left:
                left = stream.read(_PIECE)
                if not left:
                    raise WarcError("the archive ends inside a member")
            try:
                raw += member.decompress(left)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            left = member.unused_data if member.eof else b""
            if headers is None and (end := raw.find(b"\r\n\r\n")) >= 0:
                version, *fields = bytes(raw[:end]).decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise WarcError("a record does not begin with its version")
                headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
                start = end + 4
                if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
                    raise WarcError("a record states neither its length nor its type")
                need = start + int(headers["content-length"])
            if need is not None and len(raw) > need + 4:
                raise WarcError("a record is longer than its Content-Length")
        if headers is None or len(raw) != need + 4 or raw[need:] != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        block = bytes(raw[start:need])
        if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
            raise WarcError("the block does not match its digest")
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest", _sha1(block)) != _sha1(block):
            raise WarcError("the payload does not match its digest")
        yield headers, block


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` as archives under ``folder`` and returns the manifest (path, records, bytes).

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the
    largest id are responses, all others revisit it. A null html is an empty payload, a null
    url an empty one; a null id is a response unless an equal payload has an id.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    keyed = rows.withColumn("sha", F.sha1("body")).withColumn("n", F.octet_length("body"))
    twins = keyed.where(F.col("n") >= min_revisit_bytes).groupBy("sha", "n").agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1 and top is not null").select("sha", "n", "top")
    small = F.col("n") < min_revisit_bytes  # match nothing, so they stay where they are
    met = keyed.where(~small).join(twins, ["sha", "n"], "left").select("id", "url", "body", F.when(~F.col("top").eqNullSafe(F.col("id")), F.col("top")).alias("refers_to"))
    ready = met.unionByName(keyed.where(small).select("id", "url", "body", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = pafs.FileSystem.from_uri(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        count = size = 0
        out = None
        for b in batches:
            for k in range(b.num_rows):
                page, url, body, refers = (b.column(c)[k].as_py() for c in range(4))
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                raw = record_bytes(page, url, body, refers)
                out.write(raw)
                count, size = count + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return cut(ready.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream):
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                        rows.append((int(page) if page else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], int(refers) if refers else None, block))
                        held += len(block)
                        if held > 8_000_000 or len(rows) >= 2000:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count())
    return manifest.select("path").repartition(min(tasks, 10_000)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads the records back; one row per page."""
    folder = shared_dir(pages.sparkSession)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(spread(pages), f"{folder}/tallyforge/warc-{uuid.uuid4().hex}", **columns))
