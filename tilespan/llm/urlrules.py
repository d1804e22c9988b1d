"""URL filters over a sorted digest array.

Rules (host, path, verdict) of any number are deduplicated, digested to 64 bits (XXH64 of host and path) and sorted by Spark in
ranges. Each range is a segment file: its digests in rising order, the offsets of its strings, and the strings themselves. A
task maps the segments it meets into memory, so that the system loads and drops pages as probes need them. A URL's probes are
all domains its host lies in, each with all prefixes of its path that are as long as some rule's path; they are found together
by binary search in the mapped digests, and every hit is held against the stored string, so colliding digests are harmless.

A rule fits its host and all subdomains, if the URL's path starts with the rule's. The longest rule (host and path together, in
bytes; of equal ones that with the longer host) decides, and without one the URL is allowed.

Segments lie in the shared folder. On a file system they are mapped where they are; from another store a worker copies a
segment it meets to an unnamed file of its own first, which the system frees with the process. The index as a whole may
be no larger than MOST_BYTES, or lookups raise, as that much disk is all that an executor can come to need.

Defined cases. Null url, or one without ://: empty host and path, no rule, allowed. Null page_id: kept as null. Repeated rows: each answered.
Very long URLs: whole. Empty table: no rows; no rules: all allowed. Rules that can fit no URL (a null part, an empty host, a host with / ? or #, a
path that is neither empty nor begins with /, or holds ? or #) are left out. Equal rules of two verdicts: block. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cached, materialise, new_path, ship
from .warc import file_system

#: Rules in a segment, bytes of an index that lookups accept, bits of a digest, and the verdict without a rule.
SEGMENT, MOST_BYTES, BITS, DEFAULT = 1 << 20, 64 << 30, 64, "allow"
#: The rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands after the first ://."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What stands between the host and ? # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def digests(keys: list[bytes]) -> np.ndarray:
    """Signed digests of keys, as F.xxhash64 gives them, cut to BITS."""
    found = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)
    return (found & np.uint64((1 << BITS) - 1)).view(np.int64)


def build(rules: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the segments of rules (host, path, verdict); returns a row for each: folder, file, first and last digest, rules, bytes, and the path lengths that occur."""
    folder = folder or new_path(rules.sparkSession, "rules")
    schema = "folder string, file string, first long, last long, rules long, bytes long, lengths array<int>"

    def save(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        keys, offsets, strings, lengths = [], [0], bytearray(), set()

        def segment():
            name = f"{uuid.uuid4().hex}.seg"
            array = np.array(keys, "<i8")
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(np.array([len(keys)], "<i8").tobytes() + array.tobytes() + np.array(offsets, "<i8").tobytes() + bytes(strings))
            row = (folder, name, keys[0], keys[-1], len(keys), 8 * (2 * len(keys) + 2) + len(strings), sorted(lengths))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["folder", "file", "first", "last", "rules", "bytes", "lengths"])

        for batch in batches:
            for digest, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(keys) >= SEGMENT and digest != keys[-1]:
                    yield segment()
                    keys, offsets, strings, lengths = [], [0], bytearray(), set()
                strings += f"{verdict}\t{host}{path}".encode()
                keys.append(digest)
                offsets.append(len(strings))
                lengths.add(len(path.encode()))
        if keys:
            yield segment()

    clean = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host rlike '^[^/?#]+$' and (path = '' or path rlike '^/[^?#]*$') and verdict in ('allow', 'block')")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.xxhash64(F.concat("host", "path")).bitwiseAND(F.lit(-1 if BITS == 64 else (1 << BITS) - 1))
    sorted_ = one.select(digest.alias("digest"), "host", "path", "verdict").repartitionByRange("digest").sortWithinPartitions("digest", "host", "path")
    bounded_batches(rules.sparkSession)
    return materialise(sorted_.mapInArrow(save, schema), "segments")


def mapped(folder: str, file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, offsets and string bytes of a segment, as views of mapped memory; kept for the life of the worker."""

    def load():
        from pyarrow import fs

        system, root = file_system(folder)
        if isinstance(system, fs.LocalFileSystem):
            raw = np.memmap(f"{root}/{file}", np.uint8, "r")
        else:
            with system.open_input_stream(f"{root}/{file}", compression=None) as source, tempfile.TemporaryFile() as own:
                while piece := source.read(1 << 22):
                    own.write(piece)
                own.flush()
                raw = np.memmap(own, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        return raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : 16 + 16 * n].view("<i8"), raw[16 + 16 * n :]

    return cached(f"rules {folder}/{file}", load)


def candidates(host: bytes, path: bytes, lengths: list[int]) -> list[tuple[bytes, int]]:
    """The rules that would fit, longest first, as (host and path, length of the host)."""
    domains, at = [host], host.find(b".")
    while at >= 0:
        domains.append(host[at + 1 :])
        at = host.find(b".", at + 1)
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return sorted(((d + p, len(d)) for d in domains if d for p in prefixes), key=lambda x: (-len(x[0]), -x[1]))


def judged(hosts: list[bytes], paths: list[bytes], segments: list[tuple], lengths: list[int]) -> list[tuple[str | None, str]]:
    """rule and verdict of every URL. segments: (first, last, folder, file) in rising order."""
    tried, owner = [], []
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        own = candidates(host, path, lengths)
        tried += [c for c, _ in own]
        owner += [k] * len(own)
    out = [(None, DEFAULT)] * len(hosts)
    asked = digests(tried)
    order = np.argsort(asked, kind="stable")
    ranked, hits = asked[order], []
    for first, last, folder, file in segments:
        low, high = np.searchsorted(ranked, first, "left"), np.searchsorted(ranked, last, "right")
        if low == high:
            continue
        keys, offsets, strings = mapped(folder, file)
        place = np.searchsorted(keys, ranked[low:high], "left")
        for k in np.flatnonzero(keys[place] == ranked[low:high]):
            at, probe = int(place[k]), int(order[low + k])
            while at < len(keys) and keys[at] == ranked[low + k]:
                verdict, _, key = strings[offsets[at] : offsets[at + 1]].tobytes().partition(b"\t")
                if key == tried[probe]:
                    hits.append((probe, verdict.decode()))
                at += 1
    for probe, verdict in sorted(hits, reverse=True):  # the first probe of a URL is its longest, and is written last
        out[owner[probe]] = (tried[probe].decode(), verdict)
    return out


def judge(pages: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every url, by the segments of build()."""
    rows = index.select("first", "last", "folder", "file", "bytes").orderBy("first").collect()  # one for each SEGMENT rules or task
    if sum(r.bytes for r in rows) > MOST_BYTES:
        raise ValueError(f"the index has {sum(r.bytes for r in rows)} bytes, more than {MOST_BYTES}")
    segments = [(r.first, r["last"], r.folder, r.file) for r in rows]
    lengths = sorted(r[0] for r in index.select(F.explode("lengths")).distinct().collect())  # no more than the longest path has bytes

    def answer(parts):
        for batch in parts:
            hosts, paths = batch.column(1), batch.column(2)
            found = judged(hosts.cast(pa.binary()).to_pylist(), paths.cast(pa.binary()).to_pylist(), segments, lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    bounded_batches(pages.sparkSession)
    asked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return asked.mapInArrow(answer, "page_id long, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), build(spark.createDataFrame(RULES, "host string, path string, verdict string")))


ORACLE = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
  row_number() OVER () AS row FROM r)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, length(h) DESC) = 1
"""
ship(__name__)
