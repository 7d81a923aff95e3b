"""WARC archives: a writer and a splittable reader.

The writer stores one gzip member for each record, so any byte range of an
archive can be read alone. A reading task gets a byte range, scans it for
the gzip magic, and validates each candidate by inflating it and parsing
the record header found there; magic bytes inside compressed data fail
that test. A task owns the records whose member starts inside its range
and reads past the range's end to finish the last one.

Archives are opened in the tasks with ``pyarrow.fs`` under the URI of the
shared folder. Only files listed in the manifest are read; the manifest is
a table that Spark commits, so files of lost or repeated task attempts are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revledger.llm.common import BROADCAST_IDS, new_folder, only, prepare, saved

#: fixed by the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: fixed by the gzip format: magic and deflate method
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
#: bytes of a range at most and at least, and of the ranges of one task
SPLIT_BYTES, LEAST_SPLIT, TASK_BYTES = 4 << 20, 256 << 10, 128 << 20
FILE_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes, payload_bytes: int, payload_digest: str,
                 refers_to) -> bytes:
    """One record. A revisit carries the HTTP header of its capture and no
    payload; that header's Content-Length is the full payload's."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload_bytes}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """(fields by lower-case name, offset of the block), or None if ``data``
    does not begin with a whole record header."""
    if not data.startswith(b"WARC/"):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode(
            "utf-8", "surrogatepass")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


class Range:
    """A byte range of an open file, read forward in pieces and kept only
    from the position still needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, b""

    def fill(self, upto: int) -> None:
        at = self.base + len(self.data)
        if upto > at and at < self.size:
            self.file.seek(at)
            self.data += self.file.read(min(max(READ, upto - at), self.size - at))

    def find(self, what: bytes, begin: int, stop: int) -> int:
        """Position in [begin, stop) where ``what`` starts, or -1."""
        at = begin
        while at < stop:
            self.fill(at + READ)
            i = self.data.find(what, at - self.base)
            if i >= 0:
                return self.base + i if self.base + i < stop else -1
            reach = self.base + len(self.data)
            if reach >= self.size:
                return -1
            at = max(at, reach - len(what) + 1)
            self.drop(at)
        return -1

    def drop(self, before: int) -> None:
        if before - self.base > READ:
            self.data, self.base = self.data[before - self.base:], before

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """(content, end) of the gzip member at ``at``, or None when the bytes
        there are no member that holds a record. The header is decoded from
        the first piece, so a false magic is given up early."""
        z = zlib.decompressobj(wbits=31)
        parts, checked, pos = [], False, at
        try:
            while not z.eof:
                self.fill(pos + READ)
                chunk = self.data[pos - self.base: pos - self.base + READ]
                if not chunk:
                    return None
                parts.append(z.decompress(chunk))
                pos += len(chunk) - len(z.unused_data)
                if not checked and sum(map(len, parts)) >= 16:
                    if not b"".join(parts).startswith(b"WARC/"):
                        return None
                    checked = True
        except zlib.error:
            return None
        return b"".join(parts), pos


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, block) of each record whose member starts in
    [start, end)."""
    r, at = Range(file, start, size), start
    while (at := r.find(MAGIC, at, end)) >= 0:
        member = r.inflate(at)
        parsed = member and parse_header(member[0])
        if not parsed:
            at += 1
            continue
        fields, body = parsed
        block = member[0][body: body + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            at += 1
            continue
        yield at, fields, block
        at = member[1]
        r.drop(at)


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """(payload, Content-Length of the HTTP header or None)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return payload, int(value)
    return payload, None


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html",
                  broadcast_digests: int = BROADCAST_IDS) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to) for every row.

    Of the rows whose payload has ``min_bytes`` at least, those with equal
    payloads refer to the smallest page_id among them; null means response.
    Only digests that occur more than once join back, and their smallest id
    is a partial aggregate: one payload may be a third of all rows. They are
    broadcast, so that no payload is shuffled; if there are too many of them,
    the most frequent are, and the rest have few rows each."""
    base = only(pages, page_id=id_col, url=url_col, payload=payload_col)
    p = F.coalesce(F.col("payload"), F.lit(""))
    base = base.select("page_id", "url", F.encode(p, "utf-8").alias("payload")).withColumn(
        "payload_bytes", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    repeated = saved(base.filter(F.col("payload_bytes") >= min_bytes)
                     .groupBy(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_len"))
                     .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                     .filter((F.col("_n") > 1) & F.col("_first").isNotNull()), "warc-repeated")
    n, rows = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()

    def joined_with(left: DataFrame, digests: DataFrame) -> DataFrame:
        return left.join(digests.drop("_n"), (left["sha1"] == digests["_sha1"])
                         & (left["payload_bytes"] == digests["_len"]), "left").drop("_sha1", "_len")

    if n <= broadcast_digests:
        joined = joined_with(base, F.broadcast(repeated))
    else:
        # more than this many rows have at most broadcast_digests digests
        often = F.col("_n") > rows // broadcast_digests
        joined = joined_with(base, F.broadcast(repeated.filter(often))).withColumnRenamed("_first", "_first1")
        joined = joined_with(joined, repeated.filter(~often))
        joined = joined.withColumn("_first", F.coalesce("_first1", "_first")).drop("_first1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "sha1",
                         refers.alias("refers_to"))


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of :func:`with_revisits` as archives under ``folder``
    and return their manifest (path, bytes, n_records). Each task writes its
    own files of about ``file_bytes``, one gzip member a record."""
    prepare(records.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, count = None, None, 0, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, count = fs.open_output_stream(
                        f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = build_record(row["page_id"], row["url"], row["payload"],
                                   row["payload_bytes"],
                                   base64.b32encode(bytes.fromhex(row["sha1"])).decode(),
                                   row["refers_to"])
                member = z.compress(raw) + z.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "n_records": count}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "n_records": count}])

    return saved(records.mapInArrow(run, "path string, bytes long, n_records long"), "warc-manifest")


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, listed by Spark without
    reading them; for archives that have no manifest."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
            .option("recursiveFileLookup", "true").load(folder)
            .select("path", F.col("length").alias("bytes")))


def read_warc(files: DataFrame, split_bytes: int | None = None, keep_payload: bool = True) -> DataFrame:
    """All records of the archives in ``files`` (path, bytes): path, offset,
    page_id, url, record_type, refers_to, payload (empty for revisits, null
    unless ``keep_payload``), payload_bytes, payload_digest, digest_ok.

    For a response, length and digest are taken from the payload that was
    read, and ``digest_ok`` compares the digest with the header's. For a
    revisit they are its headers'. No files give no records."""
    spark = files.sparkSession
    prepare(spark)
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    wave = 3 * spark.sparkContext.defaultParallelism
    if split_bytes is None:
        # as Spark sizes the splits of its own readers: every core has some
        split_bytes = int(min(SPLIT_BYTES, max(LEAST_SPLIT, total // wave)))
    ranges = files.select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)),
        F.lit(split_bytes).cast("long"))).alias("start"))
    # a given number of partitions: ranges are tiny rows, which adaptive
    # execution would otherwise gather in one
    ranges = ranges.repartition(max(1, int(min(-(-total // split_bytes), max(wave, total // TASK_BYTES)))))
    kinds = [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()),
             ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
    schema = pa.schema(kinds)

    def page_of(urn: str | None):
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for part in b.to_pylist():
                fs, path = pafs.FileSystem.from_uri(part["path"])
                with fs.open_input_file(path) as f:
                    for at, h, block in read_range(f, part["bytes"], part["start"],
                                                   min(part["bytes"], part["start"] + split_bytes)):
                        payload, length = http_payload(block)
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        revisit = h["warc-type"] == "revisit"
                        own = told if revisit else digest(payload)
                        rows.append({
                            "path": part["path"], "offset": at,
                            "page_id": page_of(h.get("warc-record-id")),
                            "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
                            "refers_to": page_of(h.get("warc-refers-to")) if revisit else None,
                            "payload": payload if keep_payload else None,
                            "payload_bytes": length if revisit else len(payload),
                            "payload_digest": own, "digest_ok": own == told})
                        held += len(payload) + 200
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.mapInArrow(run, "path string, offset long, page_id long, url string, "
                             "record_type string, refers_to long, payload binary, "
                             "payload_bytes long, payload_digest string, digest_ok boolean")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in a new folder of
    the shared checkpoint folder and read every record back.

    A null html is an empty payload; a null url leaves the target out; rows
    with a null page_id are written too and read back with a null id. Equal
    rows (same page_id, same html) are all responses if theirs is the
    smallest id. An empty table gives no archive and no row."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(with_revisits(pages, min_bytes), folder), keep_payload=False)
