"""Toxicity by maximum-scoring segments: a linear scan over token log-odds finds every significant toxic passage.

Token log-odds come from document frequencies in toxic and other labelled documents under an informative Dirichlet
prior (the tokens' overall frequencies); only tokens whose log-odds and z-score are high enough score above zero, all others cost a
little. All maximal scoring segments of a text are found in one pass; a passage is significant by the extreme-value
law of the best segment of clean labelled texts of its length (1 - exp(-K n exp(-lambda S))); the passages' evidence
goes through a logistic curve fitted on labelled documents that the log-odds have not seen.

Learning uses rows with crc32(doc_id as text) mod 5 other than 0 only, SAMPLE of them at most (smallest hash first), and all
tokens of these that toxic ones favour, so no table outgrows that sample. The log-odds and contexts count texts of the same tokens and label once, however many copies
there are. A score depends on the text alone.

Defined cases. Null or empty text: the score of no evidence. Null doc_id: kept as null, held out. Repeated rows: each
answered alike. Very long texts: whole, in bounded pieces. Empty table: no rows. No labels of one class: no tokens
score, and every score is the share of toxic labels, 0 without any. A doc_id with several labels is toxic if one says so; one on
several rows of documents is learnt from one of them, the text of least hash. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, labelled_texts, materialise, mix64, ship, word_hashes, word_table

#: Labelled documents used to fit, least z-score and least log-odds of a scoring token, cost of any other token, p-value of a significant passage.
SAMPLE, LEAST_Z, LEAST_ODDS, DRIFT, SIGNIFICANT = 30_000, 2.5, 2.0, 0.15, 0.01
#: A token must stand between different neighbours in so large a share of its toxic documents, else it belongs to copies of one text.
CONTEXTS = 0.25
#: The Dirichlet prior weighs one document for this many labelled ones.
PRIOR = 16
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&"
_FOLD = bytes(32 if chr(c) in _MARKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(texts: list[bytes]):
    """Token hashes, byte bounds and each text's first token, of texts in lower case (A-Z) with punctuation as blanks."""
    a, s, e, first = word_table([t.translate(_FOLD) for t in texts])
    return word_hashes(a, s, e), s, e, first


def folded(text):
    """A column's texts as their tokens with single blanks between: equal for texts of the same tokens."""
    upper = "".join(map(chr, range(65, 91)))
    return F.trim(F.regexp_replace(F.translate(text, upper + _MARKS, upper.lower() + " " * len(_MARKS)), r"[\x09-\x0D ]+", " "))


def segments(scores: list[float], places: list[int], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), places ascending, each place between them costing drift. One pass over a stack of candidates, each with the running total before and after it."""
    found: list[tuple[float, float, int, int]] = []
    links: list[int] = []
    total, before = 0.0, None
    for score, place in zip(scores, places, strict=True):
        if before is not None:
            total -= drift * (place - before - 1)
        before = place
        low, total = total, total + score
        first, k = place, len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= low:
                k = links[k]
            if k < 0 or found[k][1] >= total:
                break
            low, first = found[k][0], found[k][2]
            del found[k:], links[k:]
            k = len(found) - 1
        found.append((low, total, first, place))
        links.append(k)
    return [(f, p, high - low) for low, high, f, p in found]


class Model:
    """Token scores, the extreme-value law of clean texts, and the logistic curve."""

    def __init__(self, hashes=None, scores=None, rate=1.0, level=1e-3, curve=(0.0, 0.0, 0.0)):
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.scores = np.zeros(0) if scores is None else scores
        self.rate, self.level, self.curve = rate, level, curve

    def passages(self, texts: list[bytes]):
        """For each text its token count and maximal segments as (first token, last token, score), and the byte bounds of its tokens."""
        for low, high in batches(texts):
            h, s, e, first = tokens(texts[low:high])
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            hit = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, np.int64)
            value = self.scores[at[hit]] if len(hit) else np.zeros(0)
            bound = np.searchsorted(hit, first)
            offset = 0
            for k in range(high - low):
                i, j = bound[k], bound[k + 1]
                found = segments(value[i:j].tolist(), (hit[i:j] - first[k]).tolist()) if j > i else []
                yield int(first[k + 1] - first[k]), found, s[first[k] : first[k + 1]] - offset, e[first[k] : first[k + 1]] - offset
                offset += len(texts[low + k]) + 1

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-min(700.0, self.level * max(n, 1) * math.exp(-min(700.0, self.rate * score))))

    def evidence(self, n: int, found: list) -> tuple[float, float]:
        """Of the best passage, its surprise; of all significant ones, the surprise together (both in logs, bounded)."""
        each = [-math.log10(max(self.p_value(score, n), 1e-12)) for _, _, score in found]
        limit = -math.log10(SIGNIFICANT)
        return max(each, default=0.0), math.log1p(sum(x for x in each if x >= limit))

    def probability(self, n: int, found: list) -> float:
        best, total = self.evidence(n, found)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * total))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton steps, each halved until the loss falls."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.array([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(h, x.T @ (y - p) - penalty * w), 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.withColumn("second", F.expr("pmod(xxhash64(doc_id, 7), 3) = 0"))
    rows = labelled_texts(docs, chosen)

    def count(parts):
        for batch in parts:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            y, out = batch.column(1).to_numpy(), []
            for low, high in batches(texts):
                h, _, _, first = tokens(texts[low:high])
                out += [(np.unique(h[first[k] : first[k + 1]]), y[low + k]) for k in range(high - low)]
            for label in (0, 1):
                own = [h for h, v in out if v == label]
                h, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), label)), pa.array(n)], names=["h", "y", "n"])

    sizes = {(r.second, r.y): r["count"] for r in rows.groupBy("second", "y").count().collect()}
    learnt = materialise(rows.where("not second").select(folded("text").alias("text"), "y").distinct(), "texts")
    once = {r.y: r["count"] for r in learnt.groupBy("y").count().collect()}
    toxic, clean = once.get(1, 0), once.get(0, 0)
    if not toxic or not clean:
        share = sum(v for (_, y), v in sizes.items() if y) / max(1, sum(sizes.values()))
        return Model(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    strength = (toxic + clean) / PRIOR
    seen = learnt.mapInArrow(count, "h long, y long, n long").groupBy("h").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    prior = (F.col("a") + F.col("b")) * (strength / (toxic + clean))
    odds = F.log((F.col("a") + prior) / (toxic + strength - F.col("a") - prior)) - F.log((F.col("b") + prior) / (clean + strength - F.col("b") - prior))
    seen = seen.where("a > 1").withColumn("s", odds).withColumn("z", F.col("s") / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior)))
    kept = seen.where((F.col("z") >= LEAST_Z) & (F.col("s") >= LEAST_ODDS)).select("h", "s", "a").toPandas()
    h = kept.h.to_numpy().view(np.uint64)
    order = np.argsort(h)
    table, needed = h[order], kept.a.to_numpy()[order] * CONTEXTS

    def contexts(parts):
        for batch in parts:
            texts = [t or b"" for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True) if y == 1]
            pairs = [np.zeros((0, 2), np.uint64)]
            for low, high in batches(texts):
                own = tokens(texts[low:high])[0]
                if len(own) and len(table):
                    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
                    hit = np.flatnonzero(table[at] == own)
                    around = np.concatenate(([0], own, [0])).astype(np.uint64)
                    pairs.append(np.stack([own[hit], mix64(around[hit] * np.uint64(31) + around[hit + 2])], 1))
            found = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["h", "context"])

    places = learnt.mapInArrow(contexts, "h long, context long").groupBy("h").agg(F.count_distinct("context").alias("n")).toPandas()
    distinct = dict(zip(places.h.to_numpy().view(np.uint64).tolist(), places.n.tolist(), strict=True))
    good = np.array([distinct.get(x, 0) >= max(2, n) for x, n in zip(table.tolist(), needed.tolist(), strict=True)], bool)
    model = Model(table[good], kept.s.to_numpy()[order][good])

    def best(parts):
        for batch in parts:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            out = [(n, [f[2] for f in found]) for n, found, _, _ in model.passages(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([f for _, f in out], pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["n", "found", "y"])

    seen = rows.where("second").mapInArrow(best, "n long, found array<double>, y long").toPandas()
    return calibrate(model, seen.n.tolist(), [[(0, 0, s) for s in f] for f in seen.found], seen.y.to_numpy().astype(float))


def calibrate(model: Model, sizes: list[int], found: list, y: np.ndarray) -> Model:
    """The extreme-value law from the segments of clean texts, then the curve. Clean segments beyond score s come at level * exp(-rate * s) a token: rate by the median excess over the least token score, which a few mislabelled texts don't move, level by their number and one more."""
    clean = np.flatnonzero(y == 0)
    each = np.array([s for k in clean for _, _, s in found[k]])
    over = float(np.median(each)) - LEAST_ODDS if len(each) else 0.7
    model.rate = math.log(2) / max(over, 0.35)
    model.level = (len(each) + 1) / (sum(sizes[k] for k in clean) + 1) * math.exp(model.rate * LEAST_ODDS)
    if 0 < y.sum() < len(y):
        x = np.array([model.evidence(n, f) for n, f in zip(sizes, found, strict=True)])
        model.curve = tuple(float(v) for v in logistic(x, y, ridge=0.1))
    elif len(y):
        model.curve = (-1.0, 1.0, 1.0) if not y.sum() else (1.0, 0.0, 0.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of significant passages of every document."""

    def answer(parts):
        for batch in parts:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            out = []
            for n, found, _, _ in model.passages(texts):
                p = model.probability(n, found)
                out.append((p, int(p >= 0.5), sum(model.p_value(s, n) <= SIGNIFICANT for _, _, s in found)))
            p, y, k = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array(y, pa.int32()), pa.array(k, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "crc32(coalesce(cast(doc_id as string), '')) % 5 = 0 held_out", "text")
    return rows.mapInArrow(answer, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant toxic passage: doc_id, start and end (code points), score, p_value, passage."""

    def answer(parts):
        for batch in parts:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for doc, text, (n, found, s, e) in zip(batch.column(0).to_pylist(), texts, model.passages(texts), strict=True):
                for i, j, value in found:
                    if (p := model.p_value(value, n)) <= SIGNIFICANT:
                        start, passage = len(text[: s[i]].decode()), text[s[i] : e[j]].decode()
                        rows.append((doc, start, start + len(passage), value, p, passage))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "end", "score", "p_value", "passage"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(answer, "doc_id long, start long, end long, score double, p_value double, passage string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ship(__name__)
