"""WARC archives: records in segments, written by Spark, read back, reassembled and decoded.

A response's block is an HTTP response with chunked transfer framing. Blocks longer than `segment_bytes` go on in continuation
records, which name the first record, their number and, in the last one, the total length; Spark may put them in any file. Reading
groups the segments by that origin, orders them by number, verifies that none lacks and that the lengths add up, takes the chunks
out of their framing, and takes payload, length and digest from what it decoded; a revisit's are those of the response it names.
Files may be plain or gzipped, one member a record or many. A record that cannot be read, a segment that is missing, a length or
digest that differs from the header's, a revisit without its response: each is a row with its `problem`, and the rest of the file
is read on from the next record's start.

A null payload is empty, a null URI has no header, a null id stays null and takes no part in revisits. Payloads of at least
`revisit_bytes` that equal the payload of a smaller id become revisits of the smallest. Repeated rows are written and read each. Further
columns are ignored; no pages make no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordovar.llm.common import SLICE_BYTES, drop_path, joined_hot, lean, small_batches, stored

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
REVISIT_BYTES = 100
FILE_RECORDS = 2048
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, origin string, number int, total long, page_id long, type string, digest string, payload_length long, refers_to long, refers_id string, block binary, problem string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(at, end)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("a chunk has no size")
        n = int(size, 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n" or len(body) < at + n:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response, out of its transfer framing if it has one."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the response has no end of its header")
    framed = re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", block[:end])
    return dechunked(block[end + 4 :]) if framed else block[end + 4 :]


def _values(column: pa.Array) -> Iterator[object]:
    """One at a time: a list of all would lie in memory beside the column."""
    return (x.as_py() for x in column)


def _uuid(*of: object) -> str:
    h = hashlib.md5("|".join(map(str, of)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, ident: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record up to, not including, the last line end."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", "2024-01-01T00:00:00Z"), *((k, v) for k, v in headers if v is not None), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """All records of one page; first: the page whose response this one revisits."""
    ident = _uuid(page_id, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload))]
    if first is not None:
        return [record("revisit", ident, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uuid(first, digest)), ("X-Refers-To-Page-ID", first), ("Content-Type", "application/http;msgtype=response")], HEAD)]
    block = HEAD + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record("response", ident, [*common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(record("continuation", _uuid(page_id, digest, k), [("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes gzipped WARC files of at most FILE_RECORDS records under path, wherever Spark can write."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where((F.octet_length("payload") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts, path_of_firsts = stored(pages.sparkSession, firsts, "firsts")
    told = joined_hot(rows, firsts, "digest", pages.count(), "page_id", keep=True).withColumn("first", F.when(F.col("first") < F.col("page_id"), F.col("first")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(_values(b.column(c)) for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(records_of(row[0], row[1], row[2].encode(), row[3], row[4], segment_bytes), pa.binary())], ["record"])

    small_batches(pages.sparkSession)
    told.select("page_id", "url", "payload", "digest", "first").mapInArrow(lean(kernel), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    drop_path(pages.sparkSession, path_of_firsts)


def members(raw: bytes) -> tuple[bytes, str | None]:
    """The content of a plain or gzipped file, all members one after the other, and what stopped the reading, if anything did."""
    if raw[:2] != b"\x1f\x8b":
        return raw, None
    out, rest = [], raw
    while rest:
        if rest[:2] != b"\x1f\x8b":
            return b"".join(out), None if not rest.strip(b"\0") else "what follows a gzip member is none"
        machine = zlib.decompressobj(31)
        try:
            out.append(machine.decompress(rest))
        except zlib.error as e:
            # what came out before the damage counts: a whole member is lost only if it can't be read at all
            return b"".join([*out, _until_damage(rest)]), f"gzip: {e}"
        if not machine.eof:
            return b"".join(out), "gzip: the last member is not whole"
        rest = machine.unused_data
    return b"".join(out), None


def _until_damage(rest: bytes, step: int = 4096) -> bytes:
    machine, out = zlib.decompressobj(31), []
    try:
        for i in range(0, len(rest), step):
            out.append(machine.decompress(rest[i : i + step]))
    except zlib.error:
        pass
    return b"".join(out)


_START = re.compile(rb"WARC/[0-9.]+\r?\n")


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers with lower-case names, block, problem) of each record; after a record that is damaged, from the next record's start on."""
    at = 0
    while at < len(raw):
        found = _START.match(raw, at)
        if found is None:
            ahead = _START.search(raw, at)
            stop = ahead.start() if ahead else len(raw)
            if raw[at:stop].strip():
                yield {}, raw[at:stop], f"no record starts at byte {at}"
            at = stop
            continue
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        if end < 0 or not size.isdecimal():
            problem, body, stop = "a record has no length", found.end(), None
        else:
            body = end + 4
            stop = body + int(size)
            problem = None if raw[stop : stop + 4] == b"\r\n\r\n" or len(raw) - 2 <= stop <= len(raw) else "a record does not end where its length says"
        if problem:
            ahead = _START.search(raw, body)
            stop = ahead.start() if ahead else len(raw)
            yield head, raw[body:stop], problem
        else:
            yield head, raw[body:stop], None
        at = stop
        while raw[at : at + 2] == b"\r\n":
            at += 2


def _whole(v: str | None) -> int | None:
    return int(v) if v is not None and re.fullmatch(r"-?\d{1,18}", v) else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records (RECORDS) of the archives under path, *.warc and *.gz. Of a damaged file, the row of what can't be read has a problem."""

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def batch(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in _values(b.column("content")):
                raw, broken = members(content)
                got, size = [], 0
                for h, block, problem in parse(raw):
                    digest = h.get("warc-payload-digest")
                    ident = h.get("warc-record-id", _uuid("nameless", hashlib.sha256(block).hexdigest()))
                    got.append((ident, h.get("warc-segment-origin-id", ident), _whole(h.get("warc-segment-number")), _whole(h.get("warc-segment-total-length")), _whole(h.get("x-page-id")), h.get("warc-type", "unknown"), digest and digest.partition(":")[2], _whole(h.get("x-payload-length")), _whole(h.get("x-refers-to-page-id")), h.get("warc-refers-to"), block, problem))
                    size += len(block)
                    if size > SLICE_BYTES:
                        yield batch(got)
                        got, size = [], 0
                if broken:
                    lost = _uuid("broken", hashlib.sha256(content).hexdigest())
                    got.append((lost, lost, None, None, None, "unknown", None, None, None, None, b"", broken))
                yield batch(got)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,gz}").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(lean(kernel), RECORDS)


def reassembled(records: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, digest, payload_length, refers_to, payload, problem) of each response and revisit, and of what could not
    be read. Digest and length are those of the decoded payload; a revisit has no payload of its own, and its digest and length are
    checked against the response that it names by resolved(). payloads: False leaves them null in the result."""
    kept = ["record_id", "page_id", "type", "digest", "payload_length", "refers_to", "refers_id", "problem"]
    alone = records.where("number is null").select(*kept, F.array(F.struct(F.lit(1).alias("number"), "block", "total")).alias("parts"))
    first = F.col("type") != "continuation"
    of = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    # equal rows of the source make equal records: each part once, and as many results as there are first parts
    groups = records.where("number is not null").groupBy("origin").agg(of("page_id"), F.coalesce(of("type"), F.lit("response")).alias("type"), of("digest"), of("payload_length"), of("refers_to"), of("refers_id"), F.max("problem").alias("problem"), F.array_sort(F.collect_set(F.struct("number", "block", "total"))).alias("parts"), F.greatest(F.lit(1), F.sum(first.cast("int"))).alias("copies"))
    many = groups.select(F.col("origin").alias("record_id"), *kept[1:], "parts", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).drop("col")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, digest, length, parts, problem in zip(*(_values(b.column(c)) for c in ("type", "digest", "payload_length", "parts", "problem")), strict=True):
                payload = None
                block = b"".join(p["block"] for p in parts)
                total = parts[-1]["total"]
                try:
                    if problem is not None:
                        pass
                    elif [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or (len(parts) > 1 and total is None):
                        problem = "a segment is missing"
                    elif total is not None and total != len(block):
                        problem = "the segments do not add up to the total length"
                    elif kind == "response":
                        payload = decoded(block)
                        own = hashlib.sha256(payload).hexdigest()
                        if (digest is not None and own != digest) or (length is not None and len(payload) != length):
                            problem = "the payload is not the one that was written"
                        digest, length = own, len(payload)
                except ValueError as e:
                    problem = str(e)
                out.append((digest, length, payload if payloads else None, problem))
            keep = ["record_id", "page_id", "type", "refers_to", "refers_id"]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], [*keep, "digest", "payload_length", "payload", "problem"])

    small_batches(records.sparkSession)
    done = alone.unionByName(many).mapInArrow(lean(kernel), "record_id string, page_id long, type string, refers_to long, refers_id string, digest string, payload_length long, payload binary, problem string")
    return done.where("type in ('response', 'revisit') or problem is not null").withColumnRenamed("type", "record_type")


def resolved(pages: DataFrame) -> DataFrame:
    """reassembled()'s rows without record ids and payloads: revisits whose response is absent, or has another digest or length, get a
    problem. pages is read several times and should be stored."""
    spark = pages.sparkSession
    answer, again = F.col("record_type") == "response", F.col("record_type") == "revisit"
    said = pages.where(answer | again).select(F.when(answer, F.col("record_id")).otherwise(F.coalesce("refers_id", "record_id")).alias("refers_id"), "record_type", "digest", "payload_length")
    told = said.groupBy("refers_id").agg(F.max(F.when(answer, F.struct("digest", "payload_length"))).alias("told"), F.sum(again.cast("long")).alias("c")).where("c > 0")
    told, path = stored(spark, told, "told")
    bare = pages.drop("payload")
    named = joined_hot(bare.where(again).withColumn("refers_id", F.coalesce("refers_id", "record_id")), told, "refers_id", pages.count(), "record_id")
    lacking = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("told").isNull(), "the response it names is missing").when((F.col("told.digest") != F.col("digest")) | (F.col("told.payload_length") != F.col("payload_length")), "the response it names has another payload")
    return named.withColumn("problem", lacking).drop("told").unionByName(bare.where(~again)).drop("refers_id", "record_id")
