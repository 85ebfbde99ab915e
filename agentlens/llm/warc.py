"""WARC archives as a PySpark Python data source, ``warc``.

Files are ``.warc.gz`` with one gzip member a record (as the format's annex on compression asks) or plain ``.warc``. The
writer adds the annex's ``sl`` field to each member: the member's length, so that a reader can step over a record without
inflating it. The reader plans partitions of whole files packed to ``partition_bytes``, takes predicates on record type and headers,
inflates a record's head first, and inflates the rest only if the record passes and its payload is asked for. Members
without ``sl`` (other writers) are inflated to find their end, plain records are stepped over by Content-Length. A file
is one task's work because gzip members carry no marks to start from; the writer starts a new file at ``file_bytes``.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from agentlens.llm.common import met, new_path, table, with_bit, written

READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
WRITE_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"
HEAD_BYTES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member with the ``sl`` field: length of the member, length of the record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """The bytes of one record; a revisit has no payload, only the HTTP head."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"].encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under ``_unfinished``; the driver moves the files of the attempts that count, and only those."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes, self.job = int(options.get("file_bytes", 256 << 20)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/_unfinished", recursive=True)
        files, out, held = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or held >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{root}/_unfinished/{files[-1]}", compression=None), 0
                made = member(record(row, self.date))
                out.write(made)
                held += len(made)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{root}/_unfinished/{f}", f"{root}/{f}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/_unfinished/{f}")


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def parsed(head: bytes) -> tuple[dict[str, str], int]:
    """Lower-cased header names with values, and where the block starts; ({}, -1) if the head is not all there."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def columns(h: dict[str, str]) -> dict:
    number = lambda k: int(h[k]) if h.get(k, "").isdigit() or h.get(k, "")[1:].isdigit() and h[k][0] == "-" else None
    digest = h.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        d = digest[5:]
        digest = base64.b32decode(d).hex() if len(d) == 32 else d.lower()
    return {
        "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_digest": digest or None, "payload_bytes": number("x-payload-length"),
    }


def payload_of(block: bytes, h: dict[str, str]) -> bytes:
    """The block without its HTTP head, if it has one."""
    if h.get("content-type", "").startswith("application/http"):
        return block[block.find(b"\r\n\r\n") + 4 :]
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names, self.schema = options["path"], schema.names, schema
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.equal: dict[str, set] = {}
        self.starts: dict[str, str] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in (None, "payload"):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif isinstance(f, StringStartsWith) and column not in self.starts:
                self.starts[column] = f.value
            elif isinstance(f, IsNotNull) and column in self.equal:
                continue
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=False)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        parts, held = [Files([])], 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if parts[-1].files and held + f.size > self.partition_bytes:
                parts, held = [*parts, Files([])], 0
            parts[-1].files.append(f.path)
            held += f.size
        return parts

    def wanted(self, c: dict) -> bool:
        return all(c[k] in v for k, v in self.equal.items()) and all((c[k] or "").startswith(v) for k, v in self.starts.items())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, (fs, _) = to_arrow_schema(self.schema), _filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for c in (self.gzipped if path.endswith(".gz") else self.plain)(f):
                    rows.append(c)
                    held += len(c.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def gzipped(self, f) -> Iterator[dict]:
        want, size, at = "payload" in self.names, f.size(), 0
        buffered, base = b"", 0

        def get(start: int, n: int) -> bytes:
            nonlocal buffered, base
            if start < base or start + n > base + len(buffered):
                f.seek(start)
                base, buffered = start, f.read(max(n, 1 << 20))
            return buffered[start - base : start - base + n]

        while at < size:
            first = get(at, HEAD_BYTES)
            if first[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at {at}")
            sl = struct.unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else None
            inflate, read = zlib.decompressobj(31), len(first)
            data = inflate.decompress(first, HEAD_BYTES)
            h, start = parsed(data)
            # A head longer than usual, or a member of another writer, whose end is found by inflating all of it.
            c = columns(h) if start >= 0 else None
            if c is None or sl is None or want and self.wanted(c):
                if sl is not None:
                    data, end = zlib.decompress(get(at, sl), 31), at + sl
                else:
                    parts = [data]
                    while not inflate.eof:
                        feed = inflate.unconsumed_tail or get(at + read, 1 << 16)
                        if not inflate.unconsumed_tail:
                            if not feed:
                                raise ValueError(f"the gzip member at {at} has no end")
                            read += len(feed)
                        parts.append(inflate.decompress(feed, 1 << 20))
                    data, end = b"".join(parts), at + read - len(inflate.unused_data)
                h, start = parsed(data)
                c = columns(h)
                block = data[start : start + int(h.get("content-length", 0))]
                c["payload"] = payload_of(block, h)
            else:
                end = at + sl
            at = end
            if self.wanted(c):
                yield {k: c[k] for k in self.names}

    def plain(self, f) -> Iterator[dict]:
        size, at = f.size(), 0
        while at < size:
            n, start = HEAD_BYTES, -1
            while start < 0:
                f.seek(at)
                head = f.read(n)
                h, start = parsed(head)
                if start < 0 and len(head) < n:
                    raise ValueError(f"the record at {at} has no end of headers")
                n *= 4
            c, length = columns(h), int(h.get("content-length", 0))
            if self.wanted(c):
                if "payload" in self.names:
                    f.seek(at + start)
                    c["payload"] = payload_of(f.read(length), h)
                yield {k: c[k] for k in self.names}
            at += start + length + 4


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """WRITE_SCHEMA's columns for each row of ``pages``. Of equal payloads of at least ``min_bytes`` bytes the largest
    page_id is the response (each row that has it) and the others, null ids too, revisit it; shorter payloads and groups
    without any id are all responses. A null html is an empty payload."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("payload"))
    own = own.select("*", F.sha1(F.col("payload").cast("binary")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    of = ["page_id", "url", "payload_digest", "payload_bytes"]
    narrow = written(own.select(*of), "digests")
    heads = written(narrow.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND head IS NOT NULL"), "heads")
    shared = written(heads.select(F.xxhash64("payload_digest").alias("h")), "shared")
    marked = lambda rows: with_bit(rows.withColumn("_h", F.xxhash64("payload_digest")), shared, "_h")
    # What each row with a shared digest is, found without its payload.
    kinds = written(met(marked(narrow).filter("_bit").select(*of), heads, ["payload_digest"], "n", ["page_id"]).select(*of, F.col("met.head").alias("head")), "kinds")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    key = F.xxhash64("payload_digest", "page_id")
    full = written(kinds.filter(~revisit).select(F.col("payload_digest").alias("_d"), F.col("page_id").alias("_p"), key.alias("_k")).distinct(), "responses")
    # The payloads of revisits stay where they are read, those of responses that share none too.
    both = marked(own).drop("_h")
    few = with_bit(both.filter("_bit").drop("_bit").withColumn("_k", key), full.select("_k"), "_k").filter("_bit").drop("_bit", "_k")
    few = few.join(full, (F.col("payload_digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left_semi")
    response = lambda rows: rows.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_digest", "payload_bytes", "payload")
    again = kinds.filter(revisit).select("page_id", "url", F.lit("revisit").alias("record_type"), F.col("head").alias("refers_to"), "payload_digest", "payload_bytes", F.lit("").alias("payload"))
    return response(both.filter("NOT _bit")).unionByName(response(few)).unionByName(again)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; without ``payload`` no payload is inflated."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader if payload else reader.schema(READ_SCHEMA.removesuffix(", payload binary"))).load(path)


def op1(spark, sf_dir: str) -> DataFrame:
    """Responses are measured by the payload that is read back, revisits by their headers."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    full = read_warc(spark, path).filter("record_type = 'response'")
    full = full.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.unionByName(again)


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest
"""
