"""WARC archives with segmented records, written and reassembled.

Archives are WARC/1.1: a warcinfo record, then a record for each page, every one a
gzip member of its own. Records longer than SEGMENT bytes are written as a first
segment and continuation records. Reading parses every archive by itself, groups
the segments by the identifier of their origin, orders them by number, verifies
the total length, and decodes the chunked transfer framing of the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stage

#: Most bytes of a record's block, bytes of a chunk, records in an archive beside its warcinfo, bytes of blocks in an Arrow batch.
SEGMENT, CHUNK, RECORDS, BATCH = 16 << 10, 4 << 10, 512, 4 << 20
#: The table that lists a folder's archives; bytes of archives that a task reads.
MANIFEST, TASK = "_manifest", 64 << 20
#: Compression level of a record; when records without a date of their own are dated.
LEVEL, DATE = 6, "2024-01-01T00:00:00Z"
EOL, END = b"\r\n", "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SPACE = uuid.UUID(int=0x6C61726B73707572)


def digest_of(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    h = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%X\r\n%s\r\n" % (len(p), p) for p in [*parts, b""])


def unchunked(data: bytes) -> bytes | None:
    """The payload of chunked framing; null if the framing is broken. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = data.find(EOL, at)
        if line < 0:
            return None
        try:
            n = int(data[at:line].partition(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        at = line + 2 + n
        if n < 0 or data[at : at + 2] != EOL:
            return None
        out.append(data[line + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response; null if it is broken."""
    head, found, body = block.partition(END.encode())
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _record(kind: str, own_id: str, date: str, block: bytes, *more: tuple[str, object]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *more, ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode(errors="replace") + EOL + block


def info_record(date: str, name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: larkspur\r\nformat: WARC File Format 1.1\r\n"
    return _record("warcinfo", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>", date, block, ("Content-Type", "application/warc-fields"))


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, segment: int, date: str = DATE) -> Iterator[bytes]:
    """The records of one page, without the empty lines behind each."""
    own = record_id(page_id, digest)
    target = "".join((url or "").split()) or None
    http = ("Content-Type", "application/http; msgtype=response")
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), http]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", own, date, _HTTP + EOL, *fields, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(first, digest)))
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", own, date, block, *fields)
        return
    yield _record("response", own, date, parts[0], *fields, ("WARC-Segment-Number", 1))
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        ident = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{own}/{n}')}>"
        yield _record("continuation", ident, date, part, ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], heavy: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH bytes in the column ``heavy``."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds)], names)

    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"") + 64
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    """The path and its file system, as Spark sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _location(spark: SparkSession, path: str) -> str:
    """The folder's address for the executors."""
    at, fs = _hadoop(spark, path)
    return re.sub("^file:/*", "file:///", fs.makeQualified(at).toUri().toString()).rstrip("/")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment: int = SEGMENT, date_col: str | None = None) -> None:
    """Writes a record per row as gzip-compressed WARC archives into a new folder.

    Of equal payloads of at least ``least`` bytes, the one with the largest id is
    a response and the others revisit it. A null text has an empty payload; null
    ids are never the largest. Repeated rows with the largest id are all
    responses with one record id. Archives hold a warcinfo record and RECORDS
    others at most, and are named ``.warc.gz``. ``date_col`` has the records' times;
    without it, and where it is null, they are dated DATE. A URL loses its white
    space; an empty table gives no archives; other columns are not read. A very
    long text is held by its task as a whole, with its segments.

    Tasks write their archives under the names that these keep, each attempt
    under names of its own. The folder's table MANIFEST lists the archives of the
    attempts that count, and appears at once when all are done: without it the
    folder is not read, and what a lost attempt left is not listed in it. The
    folder's file system must be one that ``pyarrow.fs`` knows.
    """
    spark = pages.sparkSession
    where = _location(spark, path)
    FileSystem.from_uri(where)  # an unknown one fails here, not in the tasks
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(date, F.lit(DATE)).alias("date"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", digest_of(F.col("payload")))
    seen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    dealt = rows.join(seen, "digest", "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "first", revisit.alias("revisit"), "date")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(where)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0

        def put(record: bytes) -> int:
            return out.write(gzip.compress(record + END.encode(), LEVEL, mtime=0))

        for b in batches:
            for p, u, x, d, f, v, t in zip(*(c.to_pylist() for c in b.columns)):
                for record in records_of(p, u, x or b"", d, f, v, segment, t):
                    if out is None:
                        name, records = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz", 0
                        fs.create_dir(root)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        size = put(info_record(t, f"{where}/{name}"))
                    size += put(record)
                    records += 1
                    if records == RECORDS:
                        out.close()
                        done.append((name, records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["name", "records", "bytes"])

    begun, folder = _hadoop(spark, f"{path}/{MANIFEST}/_BEGUN")
    folder.create(begun, False).close()  # fails where there are archives already
    dealt.mapInArrow(write, "name string, records long, bytes long").write.mode("append").parquet(f"{path}/{MANIFEST}")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; archives may be compressed, in any number of members."""
    buffer, rest = bytearray(), data
    packed = data[:2] == b"\x1f\x8b"
    more = zlib.decompressobj(31) if packed else None

    def fill(n: int) -> bool:
        nonlocal rest, more
        while len(buffer) < n and rest:
            if more is None:
                buffer.extend(rest)
                rest = b""
                break
            buffer.extend(more.decompress(rest, 1 << 20))
            rest = more.unconsumed_tail
            if more.eof:
                rest, more = more.unused_data, zlib.decompressobj(31)
        return len(buffer) >= n

    while fill(1):
        want = 4096
        while (end := buffer.find(END.encode())) < 0 and fill(want):
            want += 4096
        if end < 0:
            return
        lines = buffer[:end].decode(errors="replace").strip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", 0))
        fill(end + 4 + n + 4)
        yield fields, bytes(buffer[end + 4 : end + 4 + n])
        del buffer[: end + 4 + n + 4]


_FIELDS = ["record_id", "kind", "page_id", "origin", "segment", "total", "digest", "refers_to", "payload_bytes", "block"]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record: record_id, kind, page_id, origin (of its segments, its own id for a first one), segment, total, digest, refers_to, payload_bytes, block.

    payload_bytes is set for responses in one piece whose framing and digest are
    right. Without ``blocks`` only segments keep their block. Archives with
    records that are cut off give what is whole before that. warcinfo records
    have rows too. In a folder of ``write_archives`` the archives listed in its
    manifest are read, and one whose manifest is not finished is refused; in other
    folders, all files named ``.gz``.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "record_id string, kind string, page_id long, origin string, segment int, total long, digest string, refers_to string, payload_bytes long, block binary"

    def rows(data: bytes) -> Iterator[tuple]:
        number = lambda x: int(x) if x else None
        for f, block in parse_archive(data):
            digest, segment, size = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(f.get("warc-segment-number")), None
            if f.get("warc-type") == "response" and segment is None:
                payload = payload_of(block)
                size = len(payload) if payload is not None and base32_sha1(payload) == digest else None
            kept = block if blocks or segment is not None else None
            yield f.get("warc-record-id"), f.get("warc-type"), number(f.get("x-page-id")), f.get("warc-segment-origin-id") or f.get("warc-record-id"), segment, number(f.get("warc-segment-total-length")), digest, f.get("warc-refers-to"), size, kept

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _batches(rows(data.as_py()), _FIELDS, kinds, 9)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(where)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as archive:
                    yield from _batches(rows(archive.read()), _FIELDS, kinds, 9)

    at, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
        return files.mapInArrow(parse, schema)
    if not fs.exists(_hadoop(spark, f"{path}/{MANIFEST}/_SUCCESS")[0]):
        raise FileNotFoundError(f"the archives in {path} were not written to the end")
    where = _location(spark, path)
    listed = spark.read.schema("name string, records long, bytes long").parquet(f"{path}/{MANIFEST}")
    size = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK))
    return listed.select("name").repartition(tasks).mapInArrow(fetch, schema)


def responses(records: DataFrame) -> DataFrame:
    """One row per response record: record_id, page_id, digest, payload.

    Whole records are decoded where they were read; only segments are grouped,
    by the identifier of their origin. Segments that miss a number, whose length
    differs from the total, or whose framing or digest is broken have a null
    payload. A record that occurs several times occurs as often in the result.
    """

    @F.arrow_udf("binary")
    def decode(blocks: pa.Array) -> pa.Array:
        return pa.array([payload_of(x.as_py()) for x in blocks], pa.binary())

    whole = records.where("kind = 'response' AND segment IS NULL").select("record_id", "page_id", "digest", decode("block").alias("payload"))
    both = whole.union(_joined(records))
    return both.withColumn("payload", F.when(digest_of(F.col("payload")) == F.col("digest"), F.col("payload")))


def _joined(records: DataFrame) -> DataFrame:
    """record_id, page_id, digest and payload of the responses in segments."""

    @F.arrow_udf("binary")
    def join_segments(parts: pa.Array) -> pa.Array:
        out = []
        for own in parts:
            found, total = {}, None
            for p in own.as_py():
                found[p["segment"]] = p["block"]
                total = p["total"] if p["total"] is not None else total
            block = b"".join(found[n] for n in sorted(found))
            whole = sorted(found) == list(range(1, len(found) + 1)) and len(block) == total
            out.append(payload_of(block) if whole else None)
        return pa.array(out, pa.binary())

    # equal segments of repeated rows become one where they are read, so an origin gathers the segments of one record
    parts = records.where("segment IS NOT NULL AND kind IN ('response', 'continuation')").groupBy("origin", "segment")
    parts = parts.agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.max("block").alias("block"), F.count("*").alias("n"))
    grouped = parts.groupBy("origin").agg(
        F.collect_list(F.struct("segment", "total", "block")).alias("parts"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.coalesce(F.max(F.when(F.col("segment") == 1, F.col("n"))), F.lit(0)).alias("times")
    )
    joined = grouped.select(F.col("origin").alias("record_id"), "page_id", "digest", join_segments("parts").alias("payload"), "times")
    return joined.withColumn("_", F.explode(F.sequence(F.lit(1), F.greatest(F.col("times"), F.lit(1))))).drop("times", "_")


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back once: page_id, payload_bytes, payload_digest, record_type, refers_to, broken.

    ``broken`` tells where a payload could not be put together again, or the
    response that a revisit refers to was not read whole: payload_bytes, and then
    refers_to, are null. Null ids and texts, repeated rows, very long texts and empty tables are as
    ``write_archives`` says; columns of other names are not read, whatever they are.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, least=least, segment=segment)
    return restored(stage(read_archives(spark, path, blocks=False), "records"))


def restored(records: DataFrame) -> DataFrame:
    """What ``round_trip`` returns, from the records read."""
    segments = _joined(records)
    whole = records.where("kind = 'response' AND segment IS NULL").select("record_id", "page_id", "digest", "payload_bytes")
    found = whole.union(segments.select("record_id", "page_id", "digest", F.when(digest_of(F.col("payload")) == F.col("digest"), F.octet_length("payload").cast("long"))))
    found = stage(found, "responses")
    origin = found.where("payload_bytes IS NOT NULL").groupBy("record_id").agg(F.first("page_id").alias("to"), F.first("payload_bytes").alias("payload_bytes"))
    seen = records.where("kind = 'revisit'").select("page_id", "refers_to", "digest").join(origin.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    out = lambda rows, kind, to: rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(kind).alias("record_type"), to.alias("refers_to"), F.col("payload_bytes").isNull().alias("broken"))
    return out(found, "response", F.lit(None).cast("long")).union(out(seen, "revisit", F.col("to")))
