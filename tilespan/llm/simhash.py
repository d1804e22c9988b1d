"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two of them at most RADIUS = 3 bits apart are linked.
Each distinct fingerprint emits every variant within half the radius, that is of at most one flipped bit, and variants
are shuffled: equal variants meet. One flip from either side bridges two differing bits. For the odd third bit the
fingerprint is viewed in VIEWS ways, each leaving out one block of bits: whatever the differing bits are, some block holds
one of them, and without that block two remain at most. So no link is missed. Fingerprints that meet are verified by
their full distance. Only distinct fingerprints are compared; each task emits no more links than join its fingerprints
into components, and components of the whole come from star contraction.

Defined cases. Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Null doc_id: kept; component_id is the least doc_id that is not null, or null. Repeated rows:
each answered. Very long texts: whole. Empty table: no rows. Extra columns: ignored by classes(), kept by deduplicate().
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise, named, ship
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of which one task makes the variants.
SPREAD = 1 << 13
#: The blocks of bits that the views leave out.
VIEWS = ((0, 21), (21, 42), (42, 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    bounds = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with one more column, the fingerprint as a signed long; text must be a column."""
    place = docs.columns.index("text")

    def answer(batches):
        for batch in batches:
            found = [fingerprint(t or b"") for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*batch.schema.names, name])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(answer, _plus(docs.schema, name))


def _plus(schema, name):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([*schema.fields, StructField(name, LongType())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """Every fingerprint's variants (view, key, fp): in each view the kept bits as they are, and with any one of them flipped."""
    parts = []
    for view, (low, high) in enumerate(VIEWS):
        kept = [b for b in range(64) if not low <= b < high]
        base = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in kept))))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)).cast("long") for b in kept])
        parts.append(F.transform(flips, _flip(base, view)))
    return fps.select("fp", F.explode(F.concat(*parts)).alias("v")).select("v.view", "v.key", "fp")


def _flip(base, view):
    return lambda bit: F.struct(F.lit(view).cast("byte").alias("view"), base.bitwiseXOR(bit).alias("key"))


def links_of(group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a group into its components: a search that only ever compares what is found with what is not."""
    out, rest = [], group
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(x), int(y)) for y in found]
                frontier += list(found)
    return out


class Forest:
    """Union-find that says whether a link joined anything new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (u, v) between distinct fingerprints (of a table fp), enough to join every component."""

    def meet(batches):
        forest = Forest()
        held = (np.zeros(0, np.int64),) * 3

        def joined(view, key, fp):
            edge = np.flatnonzero((view[1:] != view[:-1]) | (key[1:] != key[:-1])) + 1
            start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
            size = stop - start
            two = start[size == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            more = (links_of(fp[i:j], radius) for i, j in zip(start[size > 2].tolist(), stop[size > 2].tolist(), strict=True))
            return [(x, y) for x, y in chain(zip(fp[close].tolist(), fp[close + 1].tolist(), strict=True), chain.from_iterable(more)) if forest.join(x, y)]

        for batch in chain(batches, [None]):
            if batch is None:
                rows, held = held, None
            else:
                rows = [np.concatenate((h, batch.column(k).to_numpy().astype(np.int64))) for k, h in enumerate(held)]
                view, key, _ = rows
                if not len(key):
                    continue
                cut = len(key) - 1
                changed = np.flatnonzero((view[1:] != view[:-1]) | (key[1:] != key[:-1]))
                cut = int(changed[-1]) + 1 if len(changed) else 0
                rows, held = [r[:cut] for r in rows], [r[cut:] for r in rows]
            if len(rows[1]):
                out = joined(rows[0], rows[1], rows[2].view(np.uint64))
                u, v = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    bounded_batches(fps.sparkSession)
    parts = min(20_000, fps.count() // SPREAD + 1)  # each fingerprint makes over a hundred rows, so few of them go to a task
    dealt = variants(fps.repartition(parts, "fp")).repartition("view", "key").sortWithinPartitions("view", "key", "fp")
    return dealt.mapInArrow(meet, "u long, v long")


def classes_of(prints: DataFrame) -> DataFrame:
    """For a table doc_id, fp: every distinct fp with component_id (the least doc_id reachable) and root (the fp that names the component)."""
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = components(links(least.select("fp")))
    rooted = least.join(tree, least.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialise(with_fingerprints(docs.selectExpr("cast(doc_id as bigint) doc_id", "text")).select("doc_id", "fp"), "prints")
    found = classes_of(prints).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of least doc_id (nulls last), then of least fingerprint and text."""
    names = {c: ("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)}  # by place, so that no name can clash
    carried = materialise(with_fingerprints(docs.select(*[named(c).alias(n) for c, n in names.items()]), "__fp"), "carried")
    prints = carried.select(F.col(names["doc_id"]).alias("doc_id"), F.col("__fp").alias("fp"))
    found = classes_of(prints)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "fp")).alias("b")).select("b.no_id", "b.least", "b.fp")
    carried = carried.withColumn("__no_id", F.col(names["doc_id"]).isNull()).withColumn("__id", F.coalesce(F.col(names["doc_id"]), F.lit(0)))
    best = best.select(F.col("fp").alias("__fp"), F.col("no_id").alias("__no_id"), F.coalesce("least", F.lit(0)).alias("__id"))
    keys = ["__fp", "__no_id", "__id"]
    first = carried.join(best, keys).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("text"))).where("__n = 1")
    return first.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ship(__name__)
