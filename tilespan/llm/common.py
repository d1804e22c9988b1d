"""What the operators of this subpackage share: shared storage, code shipping, and word tables in numpy."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_U = np.uint64


def ship(name: str) -> None:
    """Send this module's functions to executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilespan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tilespan-{uuid.uuid4().hex}-{label}"


def byte_size(text: str) -> int:
    """Bytes of a size setting such as 64MB, 2m or 4096."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)(?:i?b)?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Arrow batches of this many bytes at most, so that a task's Python memory doesn't follow the length of texts. The setting is
    read when a query runs, after its operator has returned, so it stays; a lower one is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if byte_size(spark.conf.get(key)) > size:
        spark.conf.set(key, f"{size}b")


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and lets the shuffle files of the write go at once."""
    spark, flag = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = new_path(spark, label), spark.conf.get(flag, "false")
    spark.conf.set(flag, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(flag, before)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: Sequence, label: str, rows_each: int = 1 << 17) -> DataFrame:
    """df laid out in a total order, written: _part, the range a row is in, and _at, which rises in a range. Ranges take rows_each rows
    each about, however equal the first columns of the order are, as long as the last ones tell rows apart."""
    parts = -(-df.count() // rows_each) or 1
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialise(laid, label).withColumn("_part", F.shiftright("_at", 33))


def named(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text and the columns of chosen for every doc_id of chosen (a bounded table, one row for each) that docs has, written: of several rows of a doc_id the text of least hash, so that there are no more rows than chosen has."""
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return materialise(found.join(F.broadcast(chosen), "doc_id").drop("doc_id"), "labelled")


def cached(key: str, make: Callable[[], object]) -> object:
    """A value kept for the life of this Python worker; functions shipped by value have no module of their own to keep it in."""
    import pyspark

    kept = pyspark.__dict__.setdefault("_tilespan_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte of every word in a byte array."""
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(a) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(a) and not space[-1]:
        edge = np.concatenate((edge, [len(a)]))
    return edge[0::2], edge[1::2]


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of every word's bytes; hashes of two seeds are independent.

    Words of up to LONG_WORD bytes take eight bytes at a time through a bijective scrambling, side by side, so that words of
    one length up to eight bytes never meet; longer ones take XXH3. Made piece by piece, in memory of a few times piece words.
    """
    out = np.empty(len(starts), np.uint64)
    held = np.zeros(len(a) + 8, np.uint8)
    held[: len(a)] = a
    eight = np.ndarray((len(a) + 1,), "<u8", held, strides=(1,))
    key = mix64(np.array([seed], np.uint64) + _U(_BASE))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    begin = mix64((np.arange(LONG_WORD + 1, dtype=np.uint64) + _U(1)) * key)
    for low in range(0, len(starts), piece):
        s, size = starts[low : low + piece], ends[low : low + piece] - starts[low : low + piece]
        h = mix64(begin[np.minimum(size, LONG_WORD)] ^ (eight[s] & mask[np.minimum(size, 8)]))
        more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            left = size[more] - at
            h[more] = mix64((h[more] + key) * _U(0xD1342543DE82EF95) ^ (eight[s[more] + at] & mask[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
        for k in np.flatnonzero(size > LONG_WORD):
            h[k] = xxhash.xxh3_64_intdigest(a[s[k] : s[k] + size[k]], seed)
        out[low : low + piece] = h
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of size words (none if there are fewer), from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, seed + size, np.uint64)
    for j in range(size):
        acc ^= acc >> _U(32)
        acc *= _U(0xD1342543DE82EF95)
        acc += words[j : j + n]
    return mix64(acc)


def batches(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes together, one text at least."""
    low = held = 0
    for k, t in enumerate(texts):
        if k > low and held + len(t) > limit:
            yield low, k
            low, held = k, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the joined texts, the words' starts and ends there, and each text's first word (one more entry than texts)."""
    a = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_bounds(a)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    return a, starts, ends, np.searchsorted(starts, offsets, "left")


ship(__name__)
