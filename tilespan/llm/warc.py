"""WARC archives with a two-level capture index.

Captures are range-sorted by key: the URL with its host reversed (com,example)/path), then page. Every task writes its range
as a WARC file (one gzip member a record) and its captures' index lines, in key order, as a file of compressed blocks of LINES
lines. The block directory keeps each block's first key, file, offset and length. A lookup finds its range by binary search
over the ranges' first keys, its block by binary search over that range's directory, reads the block's byte range, finds its
lines by binary search, and reads the records' byte ranges. Lookups are sorted too, so that reads go forward, and dealt to tasks
by the archive bytes that the directory states.

A capture's payload is shuffled once: the rows that say which captures are revisits go to the same ranges and stand before them.

Of captures with equal payloads of at least LEAST bytes that of the smallest page_id is a response, the others are revisits of
it; smaller ones are all responses. The archives lie in the shared folder and are reached by pyarrow's file systems. A
retried task writes files of new names; only those that its rows name are ever read.

Defined cases. Null html: an empty payload. Null or odd url: whatever key the rules give, "" too. Null page_id: last among equal
keys, never the page that others revisit. Repeated rows: a record for each; rows of the smallest page_id are all responses.
Very long payloads: whole. Empty table: no archives, no rows. Extra columns: ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, new_path, ship

LEAST, LINES, DATE = 100, 512, "2024-01-01T00:00:00Z"
#: Lookups in one request, and archive bytes that a task of lookups reads.
ASKED, READ_BYTES = 1024, 8 << 20


def url_key(url: Column) -> Column:
    """The URL without scheme, user and fragment, its host in lower case with labels reversed: com,example,www)/path?query."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_replace(authority, r"^[\s\S]*@", ""))
    port = F.regexp_extract(host, r":([0-9]+)$", 1)
    name = F.array_join(F.reverse(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")), ",")
    key = F.concat(name, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.lit(")"), F.when(tail.startswith("/"), "").otherwise("/"), tail)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def order(key: bytes, page: int | None) -> tuple:
    return key, page is None, page or 0


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{first}>"]
    body = http if first is not None else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[str, str, int, int | None, bytes]:
    """record type, payload digest, payload length, page referred to, payload; the digest of a response is held against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    to = re.search(r"<urn:x-page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return kind, digest, size, int(to[1]) if to else None, payload


def _member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def captures(pages: DataFrame) -> DataFrame:
    """key, page_id, url, payload and digest of every capture."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("key", url_key(F.col("url"))).withColumn("digest", F.sha2("payload", 256))


def revisits(rows: DataFrame) -> DataFrame:
    """key, page_id, digest of the captures (key, page_id, digest, size) that revisit another, with that one as first."""
    long = rows.where(F.col("size") >= LEAST).select("key", "page_id", "digest")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    return long.join(firsts, "digest").where("page_id is null or page_id > first").select("key", "page_id", "digest", "first").distinct()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and index blocks; returns the block directory (range, first_key, first_page, file, offset, length, and the bytes of its records in the archive)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def save(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        archive = lines = None
        at = spot = begun = 0
        now, known = None, {}
        held: list[tuple[bytes, int | None, bytes]] = []

        def block():
            nonlocal spot, begun
            data = zlib.compress(b"\n".join(x[2] for x in held), 6)
            lines.write(data)
            row = (name, held[0][0].decode(), held[0][1], f"{name}.cdx", spot, len(data), at - begun)
            spot, begun = spot + len(data), at
            held.clear()
            return row

        def out(rows):
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["range", "first_key", "first_page", "file", "offset", "length", "bytes"])

        for batch in batches:
            for key, page, mark, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, page) != now:
                    now, known = (key, page), {}
                if mark == 0:
                    known[digest] = first
                    continue
                if archive is None:
                    archive, lines = system.open_output_stream(f"{root}/{name}.warc.gz", compression=None), system.open_output_stream(f"{root}/{name}.cdx", compression=None)
                data = _member(record(page, url, payload, digest, known.get(digest)))
                archive.write(data)
                held.append((key.encode(), page, f"{key} {'-' if page is None else page} {name}.warc.gz {at} {len(data)}".encode()))
                at += len(data)
                if len(held) == LINES:
                    yield out([block()])
        if held:
            yield out([block()])
        for f in (archive, lines):
            if f is not None:
                f.close()

    bounded_batches(pages.sparkSession)
    rows = captures(pages)
    known = materialise(rows.select("key", "page_id", "digest", F.octet_length("payload").alias("size")), "digests")
    marks = revisits(known).select("key", "page_id", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    both = marks.union(rows.select("key", "page_id", F.lit(1), "url", "payload", "digest", F.lit(None).cast("bigint")))
    place = [F.col("key"), F.col("page_id").asc_nulls_last()]
    rows = both.repartitionByRange(*place).sortWithinPartitions(*place, "mark")
    made = rows.mapInArrow(save, "range string, first_key string, first_page long, file string, offset long, length long, bytes long")
    return materialise(made.withColumn("folder", F.lit(folder)), "directory")


def lookup(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every capture of the wanted (key, page_id), read from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spark = directory.sparkSession
    heads = directory.groupBy("folder", "range").agg(F.min(F.struct("first_key", F.col("first_page").isNull().alias("none"), F.coalesce("first_page", F.lit(0)).alias("page"))).alias("h"))
    ranges = sorted(((r.h.first_key.encode(), r.h.none, r.h.page), r.range) for r in heads.select("range", "h").collect())
    starts, names = [r[0] for r in ranges], [r[1] for r in ranges]

    def pack(batches):
        for batch in batches:
            out, at = [], 0
            keys, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            where = [max(0, bisect.bisect_right(starts, order(k.encode(), p)) - 1) for k, p in zip(keys, pages, strict=True)]
            for k in range(1, len(keys) + 1):
                if k == len(keys) or where[k] != where[at] or k - at == ASKED:
                    if names:
                        out.append((names[where[at]], keys[at:k], pages[at:k]))
                    at = k
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["range", "keys", "pages"])

    def read(batches):
        kept: dict[str, object] = {}

        def bytes_of(folder, file, offset, length):
            path = f"{folder}/{file}"
            if path not in kept:
                while len(kept) > 16:
                    kept.pop(next(iter(kept))).close()
                system, root = file_system(folder)
                kept[path] = system.open_input_file(f"{root}/{file}")
            return kept[path].read_at(length, offset)

        def lines_of(folder, file, offset, length):
            parts = [line.split(b" ") for line in zlib.decompress(bytes_of(folder, file, offset, length)).split(b"\n")]
            return [order(p[0], None if p[1] == b"-" else int(p[1])) for p in parts], parts

        for batch in batches:
            for folder, entries, keys, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                firsts = [order(e["first_key"].encode(), e["first_page"]) for e in entries]
                now, table, rows = -1, ([], []), []
                for key, page in zip(keys, pages, strict=True):
                    asked = order(key.encode(), page)
                    k = max(0, bisect.bisect_left(firsts, asked) - 1)
                    while k < len(entries) and firsts[k] <= asked:
                        if k != now:
                            now, table = k, lines_of(folder, entries[k]["file"], entries[k]["offset"], entries[k]["length"])
                        low, high = bisect.bisect_left(table[0], asked), bisect.bisect_right(table[0], asked)
                        for part in table[1][low:high]:
                            raw = bytes_of(folder, part[2].decode(), int(part[3]), int(part[4]))
                            kind, digest, size, to, payload = parse(zlib.decompress(raw, 31))
                            rows.append((page, size, digest, kind, to, payload))
                        k += 1
                    if len(rows) >= 200:
                        yield result(rows)
                        rows = []
                if rows:
                    yield result(rows)
        for f in kept.values():
            f.close()

    def result(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    bounded_batches(spark)
    sorted_ = wanted.select("key", "page_id").distinct().repartitionByRange("key", F.col("page_id").asc_nulls_last()).sortWithinPartitions("key", F.col("page_id").asc_nulls_last())
    packed = sorted_.mapInArrow(pack, "range string, keys array<string>, pages array<long>")
    blocks = directory.groupBy("range", "folder").agg(F.sort_array(F.collect_list(F.struct("offset", "first_key", "first_page", "file", "length"))).alias("entries"))
    tasks = max(1, -(-(directory.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES))
    met = packed.join(blocks, "range").select("folder", "entries", "keys", "pages").repartition(tasks)
    return met.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("bigint").alias("page_id"))
    return lookup(write(pages), wanted).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM f
"""
ship(__name__)
