"""WARC archives, index first: records are written with an index of their byte ranges, and read by it.

``write_archives`` stores every page as a WARC/1.1 record, each a gzip member of its own. Of pages
with equal payloads (compared by SHA-256) the one of the largest page_id is a response, the others
are revisits that refer to it and hold no payload. Each record's file, offset, length, URL and
payload digest are written to the index table. ``read_records`` takes any selection of the index:
its rows are dealt out in order of (file, offset), neighbouring ranges are joined into one read as
long as the gap is small, and the records are cut out of what was read, parsed and verified.

Payloads never meet in one place: digests decide on a narrow table, and only pages whose payload
occurs more than once are shuffled with their text. A task writes files of its own, of about
``ROLL`` bytes each; a task that is run again writes new files, and the index names only files
of tasks that ended. Files go to the shared folder through the file system that its URL names
(local, HDFS, S3 and others).

Null html is an empty payload; bytes that are no UTF-8 are kept (in a url they become U+FFFD). A null page_id is smaller than any
other and stays null. Rows of equal page_id and payload are records of their own: one is the
response (of the greatest url). A null url is stored as ``urn:page:<page_id>``; blanks and control characters
in a url are percent-encoded in the archive, the index keeps the url itself. With ``least`` bytes as
bound, smaller payloads are responses all. An empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import flagged, shared_dir, stored

ROLL = 1 << 28
#: Ranges this close are read together, in reads of at most so many bytes (or one record).
GAP, READ = 1 << 16, 1 << 23
END = b"\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    """A response is named by its page and payload, a revisit by its row as well."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if copy is None else f':{copy}'}>"


def page_of(identifier: str) -> int | None:
    page = identifier.removeprefix("<urn:page:").split(":", 1)[0]
    return int(page) if page else None


def target(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One gzip member."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", date), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogateescape")) + packer.compress(block) + packer.compress(END) + packer.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END


def opened(record_bytes: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a gzip member."""
    plain = zlib.decompress(record_bytes, 31)
    cut = plain.index(END)
    first, *lines = plain[:cut].decode("utf-8", "surrogateescape").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if first != "WARC/1.1" or plain[cut + 4 + size :] != END:
        raise ValueError("no WARC record")
    return headers, plain[cut + 4 : cut + 4 + size]


class Writer:
    """Files of one task below ``folder``, one after the other."""

    def __init__(self, folder: str, date: str) -> None:
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.date, self.stream = folder, date, None
        self.system.create_dir(self.path)

    def add(self, data: bytes) -> tuple[str, int]:
        """File and offset of what was written."""
        if self.stream is not None and self.at + len(data) > ROLL:
            self.close()
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.system.open_output_stream(posixpath.join(self.path, self.name), compression=None)
            self.put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.date))
        offset = self.at
        self.put(data)
        return f"{self.folder}/{self.name}", offset

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def decided(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, payload of every response, revisits).

    Digests decide: the narrow table of rows is written once, which also numbers them.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8(F.col("url").cast("string")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    # the url last: nothing before it can hold a colon
    row_key = F.sha2(F.concat(F.sha2("payload", 256), F.lit(":"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("u"), "url"), F.lit(""))), 256)
    keyed = given.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), row_key.alias("row_key"))
    narrow = keyed.select("page_id", "url", "payload_bytes", F.sha2("payload", 256).alias("payload_key"), F.sha1("payload").alias("sha1"), "row_key")
    narrow = stored(narrow.where(F.col("payload_bytes") >= least).withColumn("number", F.monotonically_increasing_id()), "warc-rows")
    best = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u"), "number")).alias("best")
    repeated = narrow.groupBy("payload_key").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").select("payload_key", F.col("best.page_id").alias("refers_to"), F.col("best.number").alias("response"))
    copies = stored(narrow.join(repeated, "payload_key"), "warc-copies")
    revisits = copies.where("number != response").select("page_id", "url", "payload_bytes", "sha1", "number", "refers_to")
    wanted = copies.groupBy("row_key").agg(F.max(F.col("number") == F.col("response")).alias("is response"))
    marked = flagged(keyed.withColumn("row hash", F.xxhash64("row_key")), "row hash", wanted.select(F.xxhash64("row_key").alias("row hash")), "row hash", "maybe copy")
    maybe = F.col("maybe copy") & (F.col("payload_bytes") >= least)
    alone = marked.where(~maybe).select("page_id", "url", "payload")
    # rows of one key are alike, and one of them at most is the response
    met = marked.where(maybe).groupBy("row_key").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload"))).join(wanted, "row_key", "left")
    return alone.unionByName(met.where(F.coalesce("is response", F.lit(True))).select("page_id", "url", "payload")), revisits


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: datetime | None = None) -> DataFrame:
    """The index of the archives that now hold all pages (page_id, url, html)."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}" if folder is None else folder.rstrip("/")
    stamp = (date or datetime(1970, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    responses, revisits = decided(pages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, stamp)
        for batch in batches:
            rows = []
            for page_id, url, payload, size, sha1, number, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is not None:
                    kind, digest, block, size = "response", base32_sha1(payload), http_head(len(payload)) + payload, len(payload)
                    headers = [("WARC-Record-ID", record_id(page_id, digest))]
                else:
                    kind, digest, block = "revisit", base64.b32encode(bytes.fromhex(sha1)).decode(), http_head(size)
                    headers = [("WARC-Record-ID", record_id(page_id, digest, number)), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                headers += [("WARC-Target-URI", target(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response")]
                data = record(kind, headers, block, stamp)
                file, offset = writer.add(data)
                rows.append((file, offset, len(data), page_id, url, digest, size, kind, refers_to))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)
        writer.close()

    none = F.lit(None)
    full = responses.select("page_id", "url", "payload", none.cast("long").alias("payload_bytes"), none.cast("string").alias("sha1"), none.cast("long").alias("number"), none.cast("long").alias("refers_to"))
    bare = revisits.select("page_id", "url", none.cast("binary").alias("payload"), "payload_bytes", "sha1", "number", "refers_to")
    return stored(full.unionByName(bare).mapInArrow(run, INDEX), "warc-index")


def joined_ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, begin, end, row numbers) of the reads for sorted (file, offset, length) rows."""
    own: list[int] = []
    file, begin, end = "", 0, 0
    for k, (name, offset, length) in enumerate(rows):
        if own and (name != file or offset - end > GAP or offset + length - begin > READ):
            yield file, begin, end, own
            own = []
        if not own:
            file, begin, end = name, offset, offset
        own.append(k)
        end = max(end, offset + length)
    if own:
        yield file, begin, end, own


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to and, if asked, payload.

    All is taken from the archives. A response's payload is hashed anew; a record whose digests or
    length are wrong stops the job. A revisit has no payload; its size is the one its HTTP head states.
    """
    columns = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads

    def parsed(data: bytes) -> tuple:
        headers, block = opened(data)
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        head, _, payload = block.partition(END)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        kind = headers["WARC-Type"]
        if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"] or kind == "response" and (base32_sha1(payload) != digest or size != len(payload)):
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
        return page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, size, digest, refers_to, payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple] = {}
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
        names = [x.split()[0] for x in columns.split(", ")]
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            for file, begin, end, own in joined_ranges(zip(files, offsets, lengths, strict=True)):
                folder, name = file.rsplit("/", 1)
                if folder not in systems:
                    systems[folder] = fs.FileSystem.from_uri(folder)
                system, path = systems[folder]
                with system.open_input_file(posixpath.join(path, name)) as source:
                    data = source.read_at(end - begin, begin)
                rows = [parsed(data[offsets[k] - begin : offsets[k] - begin + lengths[k]]) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: 6 + payloads], types, strict=True)], names=names)

    ranges = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, columns)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """The contract's columns of every page, as read back from the archives."""
    found = read_records(write_archives(pages, least=least), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of ``archive``: base 32 takes five bits at a time out of two hexadecimal digits.
ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS largest FROM p
  WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, r))
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex || '0', (5 * i // 4)::INTEGER + 1, 2))::INTEGER >> (3 - (5 * i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first_r THEN largest END AS refers_to
FROM d
"""
