"""A packed exchange of hashed keys between document blocks and hash buckets.

Exploding every n-gram of a corpus into rows costs three times what its hash does. Here documents lie in blocks of a few
megabytes. A block sends each hash bucket one row: its distinct keys of that bucket, sorted, and a value for each. A
bucket holds the whole corpus's entries for its keys, so it can sum or compare them, and answers each block with one value
for each key in the order asked. Keys are distinct in a block, so a key that a third of all documents hold reaches its
bucket once from each block, and buckets stay even by the hash. Blocks and buckets stand for the same bytes of text, which grow
with the square root of the corpus so that a packet keeps about PACKET keys, up to MOST_BYTES, what a task can hold in memory;
beyond (0.5 TB) packets get smaller instead. Shuffles take a partition for each block, so that a task's share doesn't grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, ship, word_bounds

#: Text in a block or bucket, from and to; keys in a packet between one block and one bucket; partitions of a shuffle, at most.
LEAST_BYTES, MOST_BYTES, PACKET, MOST_PARTS = 4 << 20, 16 << 20, 200, 20_000
#: Row groups of 16 MB. Parquet looks at a group's size after 100 rows at first, and with rows of megabytes a task's 100 rows, which writer and reader hold whole, are hundreds of MB: it looks at each row here.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def grain(total: int) -> int:
    """Bytes of text to a block or bucket of a corpus of this size; some two keys stand for six bytes."""
    return int(min(MOST_BYTES, max(LEAST_BYTES, (3 * PACKET * total) ** 0.5)))


@dataclass(frozen=True)
class Plan:
    """Bits of the bucket number, words of all blocks, and partitions of a shuffle."""

    bits: int
    words: int
    parts: int


def make_blocks(docs: DataFrame, size: int | None = None) -> DataFrame:
    """A written table of blocks: block, ids (doc_id of each document), texts (UTF-8; null: empty), n_bytes, n_words. A longer document is a block alone."""
    size = size or grain(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def pack(batches):
        ids, texts, held = [], [], 0

        def out():
            words = sum(len(word_bounds(np.frombuffer(t, np.uint8))[0]) for t in texts)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.array([held]), pa.array([words])], names=["ids", "texts", "n_bytes", "n_words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if ids and held + len(text) > size:
                    yield out()
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if ids:
            yield out()

    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(pack, "ids array<long>, texts array<binary>, n_bytes long, n_words long")
    return materialise(rows.withColumn("block", F.monotonically_increasing_id()), "blocks", **ROW_GROUPS)


def plan_for(blocks: DataFrame, least: int = 10) -> Plan:
    total, words, n = blocks.agg(F.sum("n_bytes"), F.sum("n_words"), F.count("*")).first()
    buckets = max(1, (total or 0) / grain(total or 0))
    return Plan(max(least, int(np.ceil(np.log2(buckets)))), int(words or 0), min(MOST_PARTS, max(n, blocks.sparkSession.sparkContext.defaultParallelism)))


def shrink(values: np.ndarray) -> bytes:
    """Non-negative integers in the least of 1, 2, 4 or 8 bytes each."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def grow(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps in the least number of bytes, byte by byte, so that the high ones, mostly alike, compress well; the second halves of wide keys follow as they are."""
    head = keys if keys.ndim == 1 else keys[:, 0]
    steps = np.diff(head, prepend=head[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return head[:1].astype("<u8").tobytes() + bytes([width]) + planes.tobytes() + (b"" if keys.ndim == 1 else keys[:, 1].astype("<u8").tobytes())


def unpack_keys(data: bytes, n: int, wide: bool) -> np.ndarray:
    width = data[8]
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(width, n).T
    head = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.frombuffer(data, "<u8", 1)
    return np.stack([head, np.frombuffer(data, "<u8", n, 9 + n * width)], 1) if wide else head


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of shape (n,) or (n, 2): an order that sorts them, and where each distinct one starts in it."""
    order = np.argsort(keys if keys.ndim == 1 else keys[:, 0])
    ranked = keys[order]
    new = ranked[1:] != ranked[:-1]
    if keys.ndim == 2:
        if (new[:, 1] & ~new[:, 0]).any():  # first halves alike, second ones not
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            ranked = keys[order]
            new = ranked[1:] != ranked[:-1]
        new = new.any(1)
    return order, np.concatenate(([0], np.flatnonzero(new) + 1)) if len(keys) else np.zeros(0, np.int64)


def ask(blocks: DataFrame, request: Callable, answer: Callable, plan: Plan, wide: bool = False, answers: DataFrame | None = None) -> DataFrame:
    """The written answers of a round, a row for each block: block, parts (bucket, data).

    request(ids, texts, earlier) gives a block's sorted distinct keys and non-negative values; earlier holds the answers of
    the rounds before, one array each. answer(keys, values) gets all entries of a bucket (keys of shape (n, 2) if wide) and
    returns a non-negative value for each.
    """

    bits = plan.bits

    def send(batches):
        for block, ids, texts, *earlier in each_block(batches):
            keys, values = request(ids, texts, earlier)
            head = keys[:, 0] if wide else keys
            edge = np.searchsorted(head >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(edge[1:] > edge[:-1])
            rows = [(int(b), block, pack_keys(keys[edge[b] : edge[b + 1]]), shrink(values[edge[b] : edge[b + 1]]), int(edge[b + 1] - edge[b])) for b in some]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["bucket", "block", "keys", "data", "n"])

    def meet(table: pa.Table) -> pa.Table:
        raws, datas = table.column("keys").to_pylist(), table.column("data").to_pylist()
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([unpack_keys(r, n, wide) for r, n in zip(raws, sizes, strict=True)])
        values = np.concatenate([grow(d, n) for d, n in zip(datas, sizes, strict=True)])
        del raws, datas
        out = np.split(answer(keys, values), np.cumsum(sizes)[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array([shrink(x) for x in out], pa.binary()), "n": pa.array(sizes, pa.int32())})

    bounded_batches(blocks.sparkSession)
    sent = joined(blocks, answers, plan).mapInArrow(send, "bucket int, block long, keys binary, data binary, n int")
    answered = sent.repartition(plan.parts, "bucket").groupBy("bucket").applyInArrow(meet, "block long, bucket int, data binary, n int")
    packed = answered.repartition(plan.parts, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "data", "n"))).alias("parts"))
    return materialise(packed, "answers", **ROW_GROUPS)


def joined(blocks: DataFrame, answers: DataFrame | list[DataFrame] | None, plan: Plan) -> DataFrame:
    """Blocks with the answers of earlier rounds; a block that asked nothing has none."""
    out = blocks.select("block", "ids", "texts")
    answers = [answers] if isinstance(answers, DataFrame) else answers or []
    if answers:
        out = out.repartition(plan.parts, "block")
    for k, a in enumerate(answers):
        out = out.join(a.withColumnRenamed("parts", f"parts{k}").repartition(plan.parts, "block"), "block", "left")
    return out


def each_block(batches):
    """block, ids, texts, and one array of answers for each earlier round, of every row."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block, ids, texts, *earlier = row
            yield block, ids, texts, *(np.concatenate([np.zeros(0, np.int64), *(grow(p["data"], p["n"]) for p in parts or [])]) for parts in earlier)


ship(__name__)
