"""Quality rules: base rules on every text, and gradient-boosted trees over document statistics with monotonic constraints.

The trees are fitted on a bounded sample of labelled documents (SAMPLE rows at most, those of smallest hash), flattened
into numpy node arrays, and score all documents batch by batch. Constrained features can only lower (or raise) the
verdict as they grow: repeated words, repeated lines and symbols never make a document better.

Defined cases. Null or empty text: zero words, so base_failed. Null doc_id: kept as null. Repeated rows: each answered.
Very long texts: whole, in pieces of bounded memory. Empty documents: no rows. No labels, or labels of one class only:
no trees, and the verdict is that of the base rules. Ties of a score with the threshold keep the document. A doc_id with several
labels has the lowest; one on several rows of documents is learnt from one of them, the text of least hash. Extra columns,
whatever their names: ignored, and kept by filtered().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, labelled_texts, ship, window_hashes, word_hashes, word_table

#: Labelled rows used to fit, at most; words in a repeated window; base limits; the score below which the trees reject.
SAMPLE, WINDOW, LEAST_WORDS, MOST_REPEATED, THRESHOLD = 20_000, 5, 10, 20, 0.5
#: The features, each with its monotonic direction for quality (0: free).
FEATURES = (
    ("log_words", 0), ("mean_word_chars", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_word_share", -1), ("upper_share", -1),
    ("digit_share", -1), ("bare_symbol_word_share", -1), ("exclamations_per_word", -1), ("distinct_word_share", 1), ("words_per_line", 0), ("stop_share", 1),
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False
#: Frequent short words of four languages.
_STOP = b"the of and to in a is that it for on with as was be by are de la le et les des en un une que el los las del y se der die und den das von zu ist mit du pour dans qui au sur par con para por ein im auf".split()


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features, a row for each text."""
    base, feats = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)))
    one = [np.frombuffer(w, np.uint8) for w in _STOP]
    stops = np.sort(np.array([word_hashes(a, np.array([0]), np.array([len(a)]))[0] for a in one]))
    for low, high in batches(texts):
        part = texts[low:high]
        a, s, e, first = word_table(part)
        n = np.diff(first)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))[:-1]

        def per_text(flag, a=a, offsets=offsets, part=part):
            total = np.concatenate(([0], np.cumsum(flag)))
            return total[[o + len(t) for o, t in zip(offsets, part, strict=True)]] - total[offsets]

        def per_word(flag, s=s, e=e):
            total = np.concatenate(([0], np.cumsum(flag)))
            return total[e] - total[s]

        def summed(values, first=first):
            total = np.concatenate(([0], np.cumsum(values)))
            return total[first[1:]] - total[first[:-1]]

        h = word_hashes(a, s, e)
        chars = summed(per_word(_LEAD[a]))
        symbols = per_text(_SYMBOL[a])
        bare = summed(per_word(_LETTER[a] | _DIGIT[a]) == 0)
        stop = summed(stops[np.minimum(np.searchsorted(stops, h), len(stops) - 1)] == h) if len(h) else n
        repeat, distinct, dup, lines = (np.zeros(len(part), np.int64) for _ in range(4))
        for k in range(len(part)):
            if n[k]:
                own = h[first[k] : first[k + 1]]
                distinct[k] = len(np.unique(own))
                repeat[k] = repeated_words(own)
                lines[k], dup[k] = duplicate_lines(part[k])
        base[low:high] = np.stack([n, chars, symbols, dup, repeat], 1)
        w = np.maximum(n, 1)
        letters = np.maximum(per_text(_LETTER[a]), 1)
        feats[low:high] = np.stack(
            [np.log1p(n), chars / w, symbols / w, dup / np.maximum(lines, 1), repeat / w, per_text(_UPPER[a]) / letters, per_text(_DIGIT[a]) / letters, bare / w, per_text(a == 33) / w, distinct / w, n / np.maximum(lines, 1), stop / w], 1
        )
    return base, feats


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """Words that stand in windows of this size found twice or more."""
    found = window_hashes(words, size)
    if not len(found):
        return 0
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


class Trees:
    """Boosted trees as node arrays, a row for each tree: feature (-1: leaf), threshold, left, right, value."""

    def __init__(self, feature, threshold, left, right, value, start):
        self.feature, self.threshold, self.left, self.right, self.value, self.start = feature, threshold, left, right, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(f, 0)] <= self.threshold[t][node]
                node = np.where(inner, np.where(goes, self.left[t][node], self.right[t][node]), node)
            total += self.value[t][node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, directions, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Histogram gradient boosting for log loss. A constrained split is taken only if its child values are ordered, and bounds at the middle keep later splits ordered too."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    z, trees, size = np.full(len(y), start), [], 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        stack = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while stack:
            node, rows, low, high = stack.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[node] = np.clip(-total_g / (total_h + ridge), low, high)
            best = None
            if 2 * node + 2 < size and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    code = coded[rows, j]
                    gl = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * vl + (hl + ridge) / 2 * vl**2) - (gr * vr + (hr + ridge) / 2 * vr**2)
                    bad = (nl < least) | (len(rows) - nl < least)
                    if directions[j]:
                        bad |= directions[j] * (vr - vl) < 0
                    gain[bad] = -np.inf
                    k = int(np.argmax(gain))
                    if np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-12):
                        best = (gain[k], j, k, vl[k], vr[k])
            before = -(total_g * value[node] + (total_h + ridge) / 2 * value[node] ** 2)
            if best and best[0] > before + 1e-6:
                _, j, k, vl, vr = best
                feature[node], threshold[node] = j, cuts[j][k]
                goes = coded[rows, j] <= k
                bounds = ((low, high), (low, high))
                if directions[j]:
                    mid = (vl + vr) / 2
                    bounds = ((low, mid), (mid, high)) if directions[j] > 0 else ((mid, high), (low, mid))
                stack += [(2 * node + 1, rows[goes], *bounds[0]), (2 * node + 2, rows[~goes], *bounds[1])]
            else:
                z[rows] += rate * value[node]
        trees.append((feature, threshold, rate * value))
    nodes = np.arange(size)
    each = len(trees)
    return Trees(
        np.array([t[0] for t in trees]), np.array([t[1] for t in trees]), np.tile(2 * nodes + 1, (each, 1)), np.tile(2 * nodes + 2, (each, 1)), np.array([t[2] for t in trees]), start
    )


def encoded(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on the labelled documents of smallest hash, sample rows at most; None if they hold one class only."""

    def describe(parts):
        for batch in parts:
            _, feats = statistics(encoded(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(feats), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    bounded_batches(docs.sparkSession)
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = labelled_texts(docs, chosen).select("text", "y").mapInArrow(describe, "x array<double>, y int").toPandas()
    if rows.y.nunique() < 2:
        return None
    x, y = np.array(rows.x.tolist()), rows.y.to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return boost(x[order], y[order], [d for _, d in FEATURES])


def verdicts(base: np.ndarray, feats: np.ndarray, trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
    score = trees.score(feats) if trees is not None and len(feats) else np.where(failed, 0.0, 1.0)
    return failed, score, ~failed & (score >= THRESHOLD)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts, base verdict, score and final verdict of every document."""
    trees = train(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def answer(parts):
        for batch in parts:
            base, feats = statistics(encoded(batch.column(1)))
            failed, score, kept = verdicts(base, feats, trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(score), pa.array(kept)], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(answer, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones."""
    trees, place = train(docs, labels), docs.columns.index("text")

    def answer(parts):
        for batch in parts:
            _, _, kept = verdicts(*statistics(encoded(batch.column(place))), trees)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(answer, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ship(__name__)
