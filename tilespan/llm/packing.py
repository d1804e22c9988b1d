"""Packing documents into fixed windows by non-negative least squares over a length histogram.

Documents are cut at every full window; the histogram counts the remainders in bins of GRAIN tokens. All combinations of
two or three bins that fill a window are columns of a matrix; NNLS finds how often to use each so that the counts come
out, the repeats are rounded down to what the counts allow, and a greedy pass over the combinations uses what is left.
Pieces that no combination takes are laid end to end and cut at window boundaries, so that they leave no padding.

Documents keep their order: that of their files' names and of the rows in a file, or as they come where they are from no file.
The repeats of each combination are dealt to WAVES waves, a bin's pieces go to its slots in order, and sequences are numbered
wave by wave, so that what stands early in a curriculum stands in early sequences. The histogram, the repeats and the slot
table have some hundred thousand entries whatever the corpus; ranks within bins and places of the rest come from sorted ranges
that each count on from those before, so no group is gathered in one task.

Defined cases. Null or empty text: the end token alone. Null doc_id: kept. Repeated rows: documents of their own, each
with its own pieces. Very long texts: whole, as many windows as they fill. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cached, materialise, ranged, ship

SEQUENCE, GRAIN, END = 2048, 8, 1
#: Waves that the sequences are dealt to.
WAVES = 64
#: Pieces to cut of which the numbers are sent to every task (24 bytes each); more are joined by a shuffle.
FEW = 100_000


def encoder(vocabulary: str, ranks: str):
    """text -> ids as numpy uint32. The ranks hold the same vocabulary for a faster library; a text that it can't take, or that names the special token, goes to the first."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    exact: list = []  # loaded when first needed
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|" not in text:
            try:
                return np.array(fast.encode_ordinary(text), np.uint32)
            except BaseException as trouble:  # the library's panics, which it exports no class for, are no Exceptions
                if type(trouble).__name__ != "PanicException":
                    raise
        if not exact:
            exact.append(Tokenizer.from_file(vocabulary))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def paths() -> tuple[str, str]:
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, tokenizer: tuple[str, str] | None = None, window: int = SEQUENCE) -> DataFrame:
    """Every document's tokens cut at full windows: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian 32-bit), and the file and the split of it that the document is from."""
    tokenizer = tokenizer or paths()

    def answer(batches):
        encode = cached(f"tokenizer {tokenizer}", lambda: encoder(*tokenizer))
        for batch in batches:
            (doc, file, split), rows = (batch.column(c).to_pylist() for c in (0, 2, 3)), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                raw = ids.tobytes()
                for start in range(0, len(ids), window):
                    part = raw[4 * start : 4 * (start + window)]
                    rows.append((doc[k], start, len(part) // 4, zlib.crc32(part), len(ids), part, file[k], split[k]))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.binary(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "file", "split"])

    bounded_batches(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "input_file_name() file", "input_file_block_start() split")
    return texts.mapInArrow(answer, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, file string, split long")


def combinations(units: int) -> np.ndarray:
    """All ways to fill units with two or three parts, as rows of three parts in falling order (0: none)."""
    out = [(a, units - a, 0) for a in range((units + 1) // 2, units)]
    for a in range((units + 2) // 3, units - 1):
        rest = units - a
        out += [(a, b, rest - b) for b in range((rest + 1) // 2, min(a, rest - 1) + 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative x with least |a x - b|: the active-set method on the normal equations of the used columns."""
    right = a.T @ b
    x, used = np.zeros(a.shape[1]), []
    tolerance = 1e-7 * max(1.0, np.abs(right).max(initial=0.0))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a[:, used] @ x[used]) if used else right.copy()
        slope[used] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= tolerance:
            break
        used.append(k)
        while used:
            own = a[:, used]
            solved = np.linalg.solve(own.T @ own + 1e-8 * np.eye(len(used)), right[used])
            if solved.min() > 0:
                x[:] = 0
                x[used] = solved
                break
            now = x[used]
            bad = solved <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - solved[bad], 1e-300))
            now = now + step * (solved - now)
            x[:] = 0
            x[used] = np.where(now > 1e-12, now, 0)
            used = [u for u, v in zip(used, now, strict=True) if v > 1e-12]
    return x


def plan(counts: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Which combinations to use and how often, for counts of pieces by bin (index 1 to units - 1)."""
    every = combinations(units)
    left = counts.astype(np.int64).copy()
    open_ = every[(left[every] > 0)[:, :2].all(1) & ((every[:, 2] == 0) | (left[every[:, 2]] > 0))]
    chosen: dict[tuple[int, ...], int] = {}
    if not len(open_):
        return []

    def use(parts, most):
        parts = tuple(int(p) for p in parts if p)
        n = min(most, *(int(left[p]) // parts.count(p) for p in set(parts)))
        if n > 0:
            for p in parts:
                left[p] -= n
            chosen[parts] = chosen.get(parts, 0) + n

    a = np.zeros((units, len(open_)))
    for j in range(3):
        np.add.at(a, (open_[:, j], np.arange(len(open_))), 1.0)
    a[0] = 0
    scale = max(1.0, left.max())
    x = nnls(a, left[:units] / scale) * scale
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        use(open_[k], int(round(x[k])))
    for parts in open_:
        use(parts, int(left.max()))
    return list(chosen.items())


def in_waves(chosen: list[tuple[tuple[int, ...], int]], waves: int) -> list[tuple[int, tuple[int, ...], int]]:
    """(wave, combination, repeats): every combination's repeats dealt evenly to the waves, wave by wave."""
    done = lambda n, w: (2 * n * w + waves) // (2 * waves)
    return [(w, parts, m) for w in range(waves) for parts, n in chosen if (m := done(n, w + 1) - done(n, w))]


def pack(docs: DataFrame, tokenizer: tuple[str, str] | None = None, window: int = SEQUENCE, grain: int = GRAIN, waves: int = WAVES) -> tuple[DataFrame, DataFrame]:
    """The piece table with a place for every piece (doc_id, start, length, ids_crc32, doc_tokens, uid, sequence_id, offset, and skip, the ids of the piece before it), and the pieces with their ids by uid."""
    units = window // grain
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"]
    cut = materialise(pieces(docs, tokenizer, window).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    tight = F.col("length") > (units - 1) * grain  # a window of its own
    rows = cut.select(*names, "file", "split", F.when(tight, units).otherwise(F.expr(f"(length + {grain - 1}) div {grain}")).cast("int").alias("bin"))
    laid = ranged(rows, ["bin", "file", "split", "uid"], "laid").drop("file", "split")
    ranges = laid.groupBy("bin", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("bin").orderBy("_part")  # a row for each range that a bin reaches into
    ranges = materialise(ranges.select("bin", "_part", (F.sum("n").over(before) - F.col("n") - F.col("_first")).alias("_shift"), "n"), "ranges")
    ranked = laid.join(ranges.drop("n"), ["bin", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift"))
    counts = np.zeros(units + 1, np.int64)
    for r in ranges.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    chosen = [*plan(counts[:units], units), ((units,), int(counts[units]))]

    slots: dict[int, list] = {}
    sequences, ends = 0, [0] * waves
    for w, parts, n in in_waves(chosen, waves):
        for p in sorted(set(parts)):
            slots.setdefault(p, []).append((n * parts.count(p), parts.count(p), sequences, parts.index(p)))
        sequences += n
        ends[w] = sequences
    ends = np.maximum.accumulate(ends).tolist()
    tables = {p: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for p, s in slots.items()}

    def place(batches):
        for batch in batches:
            bins, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bin", "rank"))
            seq, slot = np.full(len(bins), -1), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                if b in tables:
                    own = np.flatnonzero(bins == b)
                    size, times, base, first = tables[b]
                    high = np.cumsum(size)
                    at = np.searchsorted(high, rank[own], "right")
                    in_ = at < len(high)
                    own_in, at = own[in_], at[in_]
                    inner = rank[own_in] - (high - size)[at]
                    seq[own_in] = base[at] + inner // times[at]
                    slot[own_in] = first[at] + inner % times[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(seq), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    bounded_batches(docs.sparkSession)
    placed = ranked.select(*names, "bin", "rank").mapInArrow(place, ", ".join(f"{n} long" for n in (*names, "sequence_id", "slot")))
    placed = materialise(placed, "placed")

    # what no combination took, end to end in the documents' order
    loose = placed.where("sequence_id < 0").drop("sequence_id", "slot").join(cut.select("uid", "file", "split"), "uid") if int(counts.sum()) > sum(n * len(p) for p, n in chosen) else None
    if loose is None:
        rest, windows = None, 0
    else:
        loose = ranged(loose, ["file", "split", "uid"], "loose").drop("file", "split")
        sums = loose.groupBy("_part").agg(F.sum("length").alias("size"))
        sums = materialise(sums.select("_part", "size", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("before")), "sums")  # a row for each range
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        rest = loose.withColumn("at", F.sum("length").over(within) - F.col("length")).join(sums.drop("size"), "_part").withColumn("at", F.col("at") + F.col("before"))
        windows = -(-int(sums.agg(F.sum("size")).first()[0]) // window)
    loose_ends = [windows * (w + 1) // waves for w in range(waves)]

    def numbered(own, ends, others):
        """A sequence's number among all, from its number among its kind: that many more as the waves before hold of the other kind."""
        wave = sum((own >= F.lit(e)).cast("int") for e in ends[:-1]) if waves > 1 else F.lit(0)
        return own + F.element_at(F.array(*map(F.lit, others)), wave + 1).cast("bigint")

    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    combined = placed.where("sequence_id >= 0").withColumn("offset", F.sum("length").over(in_order) - F.col("length"))
    out = combined.select(*names, numbered(F.col("sequence_id"), ends, [0, *loose_ends[:-1]]).alias("sequence_id"), "offset", F.lit(0).cast("bigint").alias("skip"))
    if rest is None:
        return out, cut
    rest = materialise(rest.withColumn("room", window - F.col("at") % window).withColumn("base", F.expr(f"at div {window}")).select(*names, "at", "room", "base"), "loose")
    of_rest = lambda base: numbered(base, loose_ends, ends)
    uncut = rest.where("length <= room").select(*names, of_rest(F.col("base")).alias("sequence_id"), (F.col("at") % window).alias("offset"), F.lit(0).cast("bigint").alias("skip"))
    split = rest.where("length > room").select("uid", "room", of_rest(F.col("base")).alias("base"), of_rest(F.col("base") + 1).alias("next"))
    split = cut.join(F.broadcast(split) if split.count() <= FEW else split, "uid")

    def halve(batches):
        for batch in batches:
            rows = []
            for doc, start, length, tokens, uid, room, base, after, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, tail = ids[: 4 * room], ids[4 * room :]
                rows.append((doc, start, room, zlib.crc32(head), tokens, uid, base, window - room, 0))
                rows.append((doc, start + room, length - room, zlib.crc32(tail), tokens, uid, after, 0, room))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*names, "sequence_id", "offset", "skip"])

    halves = split.select("doc_id", "start", "length", "doc_tokens", "uid", "room", "base", "next", "ids").mapInArrow(halve, ", ".join(f"{n} long" for n in (*names, "sequence_id", "offset", "skip")))
    return out.union(uncut).union(halves), cut


def placements(docs: DataFrame, **options) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, **options)[0].select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, window: int = SEQUENCE, pad: int = 0, **options) -> DataFrame:
    """The packed sequences: sequence_id, ids (array of window entries, padded at the end; as they are at a power of two), n_used."""
    places, cut = pack(docs, window=window, **options)
    parts = places.select("sequence_id", "offset", "uid", "skip", F.col("length").alias("n")).join(cut.select("uid", "ids"), "uid")
    parts = parts.select("sequence_id", "offset", "n", F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * n as int))").alias("raw"))
    grouped = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "raw"))).alias("parts"), F.sum("n").alias("n_used"))

    def lay(batches):
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(chain(p["raw"] for p in own)), "<u4").astype(np.int32)
                out.append(ids if len(ids) & (len(ids) - 1) == 0 else np.pad(ids, (0, window - len(ids)), constant_values=pad))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), batch.column(2)], names=["sequence_id", "ids", "n_used"])

    bounded_batches(docs.sparkSession)
    return grouped.mapInArrow(lay, "sequence_id long, ids array<int>, n_used long")


def query(spark, sf_dir: str) -> DataFrame:
    return placements(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ship(__name__)
