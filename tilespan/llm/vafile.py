"""Exact top-k search with vector-approximation files.

Vectors become integers, floor(256 x) for each component; equal vectors are one entry with its k + 1 smallest ids, which
is all that a top-k with ties to smaller ids can ever return, for an entry holds the asking id once at most. Entries lie in blocks. A block is a vector-approximation
file: a grid of CELLS cells over each dimension's range in the block, the cell of each component as one byte, and the
exact vectors. Queries come in blocks too. Where a query block meets a data block, the scan of the cells gives every entry
a lower and an upper bound of its inner product with the query; exact vectors are then read in the order of falling upper
bound (rising lower bound of distance), a few at a time, until the k-th best exact score exceeds every bound left. The
best of the blocks, k + 1 a query at most from each, are merged by a ranking that Spark limits before the shuffle.

Whole numbers are kept as doubles, which hold floor(256 x) of any double, and scores are exact whatever their size. A score of the result that
passes 64 bits is an error; one that passes them elsewhere only loses or wins its place.

Defined cases. Null vectors, vectors with a null or non-finite component (or one whose 256-fold no double holds): no part.
Null id: no part. Repeated rows of one id and vector: one candidate, and one answer for each as a query; one id with
other vectors: each its own, never a candidate of its own id. Different dimensions: only vectors of a query's own dimension are its candidates. Empty
vectors: score 0 with each other. Fewer than k candidates: all. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise, ship

TOP, EVERY, CELLS, LIMIT = 5, 50, 64, (1 << 63) - 1
#: Entries of a data block, queries of a query block, groups of data blocks that each query block is sent to, exact vectors read at a time.
BLOCK, QUERIES, GROUPS, READ = 8192, 1024, 64, 16


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and raw (doubles of whole numbers, little-endian) of every vector that takes part. floor(256 * x) of a double is a double, whatever its size."""

    def answer(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat, sizes = lists.flatten(), pa.compute.list_value_length(lists)
            values = np.floor(256 * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)) + 0.0  # no negative zero
            ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            takes = np.flatnonzero((bad[ends] == bad[starts]) & ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False))
            raws = [values[starts[k] : ends[k]].astype("<f8").tobytes() for k in takes]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(takes)), pa.array(raws, pa.binary())], names=["vec_id", "raw"])

    bounded_batches(vectors.sparkSession)
    return vectors.selectExpr("cast(vec_id as bigint) vec_id", "embedding").mapInArrow(answer, "vec_id long, raw binary")


def index(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Blocks (block, dim, size, low, width, cells, exact, ids): low and width give the grid, ids the k + 1 smallest ids of each entry."""
    first = Window.partitionBy("raw").orderBy("vec_id")
    entries = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = entries.coalesce(max(1, rows.count() // BLOCK))  # full blocks: each answers every query, so small ones cost rows

    def build(batches):
        def block(dim, raws, ids):
            x = np.frombuffer(b"".join(raws), "<f8").reshape(len(raws), dim)
            low, high = (x.min(0), x.max(0)) if dim else (np.zeros(0),) * 2
            width = np.maximum(1, np.ceil(high / CELLS - low / CELLS + 1 / CELLS))
            cells = np.minimum(CELLS - 1, np.floor((x / 2 - low / 2) / (width / 2))).astype(np.uint8)  # halves, as differences may pass a double
            small = bool(np.abs(x).max(initial=0) < 1 << 15)
            flat = np.concatenate([np.array([len(i), *i], "<i8") for i in ids])
            return (dim, len(raws), low.astype("<f8").tobytes(), width.astype("<f8").tobytes(), cells.tobytes(), small, x.astype("<i2" if small else "<f8").tobytes(), flat.tobytes())

        def out(made):
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
            names = ["dim", "size", "low", "width", "cells", "small", "exact", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for raw, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(len(raw) // 8, ([], []))
                own[0].append(raw)
                own[1].append(ids)
                if len(own[0]) == BLOCK:
                    yield out([block(len(raw) // 8, *held.pop(len(raw) // 8))])
        for dim, own in sorted(held.items()):
            yield out([block(dim, *own)])

    return entries.mapInArrow(build, "dim int, size int, low binary, width binary, cells binary, small boolean, exact binary, ids binary").withColumn("block", F.monotonically_increasing_id())


def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in 64 bits where no sum can pass them, else as Python's whole numbers."""
    if len(q) * float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2.0**62:
        return rows.astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q]
    out = np.empty(len(rows), object)
    out[:] = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in rows]
    return out


def best_of(q: np.ndarray, low, width, cells, exact, top: int, without=None):
    """For each query row the top entries (positions and scores) of one approximation file, ties kept to the last place. without: for
    each row the entries (positions) that are no candidates. Bounds beyond a double's range are no bounds."""
    reach = (width - 1) / 2
    with np.errstate(over="ignore", invalid="ignore"):
        centre = low + reach + cells * width
        middle, spread = q @ centre.T, np.abs(q) @ reach
        slack = 1e-9 * (np.abs(q) @ np.abs(centre).max(0, initial=0) + spread) + 1e-6 if centre.size else np.full(len(q), 1e-6)
        wild = ~np.isfinite(middle) | ~np.isfinite(spread + slack)[:, None]
        over = np.where(wild, np.finfo(float).max, middle + (spread + slack)[:, None])
        under = np.where(wild, -np.finfo(float).max, middle - (spread + slack)[:, None])
    out = []
    for row in range(len(q)):
        upper, floor = over[row], under[row]
        least, barred = -np.inf, () if without is None else without[row]
        if len(barred):
            upper, floor = upper.copy(), floor.copy()
            upper[barred] = floor[barred] = -np.inf
        if len(upper) - len(barred) > top:
            least = np.partition(floor, len(upper) - top)[len(upper) - top]
        likely = np.flatnonzero((upper >= least) & (upper > -np.inf))
        likely = likely[np.argsort(-upper[likely], kind="stable")]
        seen, kth = np.zeros(0, np.int64), -np.inf
        for at in range(0, len(likely), READ):
            part = likely[at : at + READ]
            if upper[part[0]] < kth:
                break
            seen = np.concatenate((seen, scores(exact[part], q[row])))
            if len(seen) >= top:
                kth = np.sort(seen)[len(seen) - top]
        read = likely[: len(seen)]
        keep = seen >= kth if len(seen) > top else np.ones(len(seen), bool)
        out.append((read[keep], seen[keep]))
    return out


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """For each vector whose id is divisible by every: query_id, rank, vec_id, score of its best other vectors. An id with one vector of a dimension takes one place at most, so vectors are asked for once with one place more, whoever asks; an id with several asks for itself (asker) and leaves its own out."""
    rows = materialise(quantised(vectors), "vectors")
    blocks = materialise(index(rows, top), "vafile")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("bytes", F.length("raw"))
    several = asked.distinct().groupBy("vec_id", "bytes").count().where("count > 1").select("vec_id", "bytes", F.lit(True).alias("several"))
    asked = materialise(asked.join(several, ["vec_id", "bytes"], "left").select("vec_id", "raw", F.when(F.col("several"), F.col("vec_id")).alias("asker")), "asked")
    units = asked.select("raw", "asker").distinct()
    n_blocks, n_queries = blocks.count(), units.count()
    parts, groups = max(1, -(-n_queries // QUERIES)), max(1, min(GROUPS, n_blocks))
    distinct = units.withColumn("part", F.pmod(F.xxhash64("raw", "asker"), F.lit(parts)))
    packed = distinct.groupBy("part").agg(F.collect_list(F.struct("raw", "asker")).alias("raws")).select("part", "raws", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    dealt = blocks.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def answer(batches):
        for batch in batches:
            for raws, dim, size, low, width, cells, small, exact, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(r["raw"], r["asker"]) for r in raws if len(r["raw"]) == 8 * dim]
                rows = []
                low, width = np.frombuffer(low, "<f8"), np.frombuffer(width, "<f8")
                cells, exact = np.frombuffer(cells, np.uint8).reshape(size, dim), np.frombuffer(exact, "<i2" if small else "<f8").reshape(size, dim)
                flat, entry, at = np.frombuffer(ids, "<i8").tolist(), [], 0
                for _ in range(size):
                    entry.append(flat[at + 1 : at + 1 + flat[at]])
                    at += 1 + flat[at]
                alone = {asker: [] for _, asker in own}  # the entries that hold no other id
                for f, held in enumerate(entry):
                    if len(held) == 1 and held[0] in alone:
                        alone[held[0]].append(f)
                for k in range(0, len(own), 128):
                    some = own[k : k + 128]
                    q = np.frombuffer(b"".join(raw for raw, _ in some), "<f8").reshape(-1, dim) if dim else np.zeros((len(some), 0))
                    for (raw, asker), (found, score) in zip(some, best_of(q, low, width, cells, exact, top + 1, [alone[asker] for _, asker in some]), strict=True):
                        pairs = sorted((-int(s), i) for f, s in zip(found, score, strict=True) for i in entry[f] if i != asker)[: top + 1]
                        rows += [(raw, asker, i, max(-LIMIT, min(LIMIT, -s)), abs(s) > LIMIT) for s, i in pairs]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["raw", "asker", "vec_id", "score", "beyond"])

    bounded_batches(vectors.sparkSession)
    met = dealt.join(packed, ["part", "group"]).select("raws", "dim", "size", "low", "width", "cells", "small", "exact", "ids")
    found = materialise(met.mapInArrow(answer, "raw binary, asker long, vec_id long, score long, beyond boolean"), "found")
    order = Window.partitionBy("raw", "asker").orderBy(F.col("score").desc(), "vec_id")
    merged = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1).groupBy("raw", F.col("asker").alias("for")).agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "beyond"))).alias("best"))
    bounded_batches(vectors.sparkSession)
    merged = merged.withColumnRenamed("raw", "of")
    joined = asked.select(F.col("vec_id").alias("query_id"), "raw", "asker").join(merged, (F.col("raw") == F.col("of")) & F.col("asker").eqNullSafe(F.col("for")))
    others = joined.select("query_id", F.slice(F.filter("best", lambda b: b.vec_id != F.col("query_id")), 1, top).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", F.when(F.col("b.beyond"), F.raise_error("a score passes 64 bits")).otherwise(F.col("b.score")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ship(__name__)
