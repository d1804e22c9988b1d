"""Language-model scores by stupid backoff over the corpus's own n-gram counts, leaving each document's own counts out.

Counts of all 1- to 3-grams of all documents lie in tables partitioned by hash; every block's n-grams meet them there through
the packed exchange, and the scores are summed per document. For a word with its two predecessors in the document
(fewer at its start), with c the counts of the corpus less those of the document itself and N its words less the document's:
c(uvw) / c(uv) if c(uvw) > 0; else 0.4 c(vw) / c(v) if c(vw) > 0; else 0.16 c(w) / N if c(w) > 0; else 0.064 / (N + 1).
At a document's start the longest n-gram is the one that fits, with factor 1.

Defined cases. Null or empty text: no words, log_score 0, mean null. Null doc_id: kept. Repeated rows: documents of their own,
so each sees the other's counts. Very long texts: whole. Empty table: no rows. One document alone: every word unseen. Extra
columns, whatever their names: ignored. N-grams are told apart by 64-bit hashes: among n distinct ones some n * n / 2**65 pairs are
counted as one (none to be expected below a billion).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ask, distinct, each_block, joined, make_blocks, plan_for
from .common import bounded_batches, mix64, ship, window_hashes, word_hashes, word_table

ORDER, BACKOFF = 3, 0.4


class Grams:
    """The n-grams of one block: hashes by order, and where each starts."""

    def __init__(self, texts):
        a, s, e, self.first = word_table(texts)
        self.words = word_hashes(a, s, e)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def places(self, n: int) -> np.ndarray:
        at = np.arange(max(0, len(self.words) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]]

    def keys(self, n: int) -> np.ndarray:
        return window_hashes(self.words, n, 1000 * n)[self.places(n)]

    def asked(self, orders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of these orders, their counts in the block, and which one each n-gram is, order by order."""
        keys = np.concatenate([self.keys(n) for n in orders]) if len(self.words) else np.zeros(0, np.uint64)
        order, start = distinct(keys)
        size = np.diff(np.append(start, len(keys)))
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(start)), size)
        return keys[order][start], size, which

    def own(self, n: int) -> np.ndarray:
        """How often each n-gram stands in its own document."""
        keys = mix64(self.keys(n) ^ mix64(self.doc[self.places(n)].astype(np.uint64) + np.uint64(1)))
        order, start = distinct(keys)
        size = np.diff(np.append(start, len(keys)))
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(size, size)
        return out


def summed(keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Every entry's total over all entries of its key."""
    order, start = distinct(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(value[order], start), np.diff(np.append(start, len(keys))))
    return out


def scores(grams: Grams, counts: list[np.ndarray], total: int) -> np.ndarray:
    """The log score of every word of a block, from the corpus's count of every n-gram, by order."""
    n_words = np.diff(grams.first)
    rest = (total - n_words)[grams.doc] if len(grams.doc) else np.zeros(0)
    left = [np.zeros(len(grams.words)) for _ in counts]  # at the place of an n-gram's last word
    ahead = [np.zeros(len(grams.words)) for _ in counts]  # at its first
    for n, c in enumerate(counts, 1):
        at, less = grams.places(n), c - grams.own(n)
        left[n - 1][at + n - 1] = less
        ahead[n - 1][at] = less
    place = np.arange(len(grams.words)) - grams.first[:-1][grams.doc] if len(grams.doc) else np.zeros(0, np.int64)
    out = np.full(len(grams.words), np.nan)
    for n in range(len(counts), 0, -1):
        longest = np.minimum(place + 1, len(counts))
        factor = BACKOFF ** np.maximum(longest - n, 0)
        base = rest if n == 1 else np.concatenate((np.zeros(n - 1), ahead[n - 2][: len(place) - n + 1]))[: len(place)]
        use = np.isnan(out) & (place >= n - 1) & (left[n - 1] > 0)
        out[use] = np.log(factor[use] * left[n - 1][use] / base[use])
    never = np.isnan(out)
    longest = np.minimum(place + 1, len(counts))
    out[never] = np.log(BACKOFF ** longest[never] / (rest[never] + 1))
    return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (sum over the words, natural logarithm) and mean_log_score of every document."""
    blocks = make_blocks(docs)
    plan = plan_for(blocks)
    rounds = [tuple(range(1, order)), (order,)] if order > 1 else [(1,)]

    def requested(orders):
        return lambda ids, texts, before: Grams(texts).asked(orders)[:2]

    answers = [ask(blocks, requested(orders), summed, plan) for orders in rounds]

    def finish(batches):
        for _, ids, texts, *before in each_block(batches):
            grams, counts = Grams(texts), []
            for orders, reply in zip(rounds, before, strict=True):
                each = reply[grams.asked(orders)[2]] if len(reply) else np.zeros(0, np.int64)
                counts += np.split(each, np.cumsum([len(grams.places(n)) for n in orders])[:-1])
            n = np.diff(grams.first)
            value = np.zeros(len(n))
            if n.any():
                value[n > 0] = np.add.reduceat(scores(grams, counts, plan.words), grams.first[:-1][n > 0])
            mean = [v / k if k else None for v, k in zip(value.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(value), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    bounded_batches(docs.sparkSession)
    return joined(blocks, answers, plan).mapInArrow(finish, "doc_id long, n_words long, log_score double, mean_log_score double")


def query(spark, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.round("mean_log_score", 5).alias("mean_log_score"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
t AS (
  SELECT r, p, w, lag(w) OVER (PARTITION BY r ORDER BY p) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY p) AS u FROM w),
n AS (SELECT count(*) AS total FROM t),
o AS (SELECT r, count(*) AS own FROM t GROUP BY r),
a AS (SELECT w, count(*) AS c FROM t GROUP BY w), ad AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w), bd AS (SELECT r, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY r, v, w),
c AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w), cd AS (SELECT r, u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY r, u, v, w),
s AS (
  SELECT t.r, least(t.p, 3) AS longest, total - own AS rest,
    c.c - cd.c AS c3, buv.c - bduv.c AS c2u, b.c - bd.c AS c2, av.c - adv.c AS c1v, a.c - ad.c AS c1
  FROM t JOIN o ON t.r = o.r CROSS JOIN n
  JOIN a ON t.w = a.w JOIN ad ON t.r = ad.r AND t.w = ad.w
  LEFT JOIN a av ON t.v = av.w LEFT JOIN ad adv ON t.r = adv.r AND t.v = adv.w
  LEFT JOIN b ON t.v = b.v AND t.w = b.w LEFT JOIN bd ON t.r = bd.r AND t.v = bd.v AND t.w = bd.w
  LEFT JOIN b buv ON t.u = buv.v AND t.v = buv.w LEFT JOIN bd bduv ON t.r = bduv.r AND t.u = bduv.v AND t.v = bduv.w
  LEFT JOIN c ON t.u = c.u AND t.v = c.v AND t.w = c.w LEFT JOIN cd ON t.r = cd.r AND t.u = cd.u AND t.v = cd.v AND t.w = cd.w),
l AS (
  SELECT r, ln(CASE WHEN c3 > 0 THEN c3 / c2u::DOUBLE WHEN c2 > 0 THEN 0.4 ** (longest - 2) * c2 / c1v::DOUBLE
    WHEN c1 > 0 THEN 0.4 ** (longest - 1) * c1 / rest::DOUBLE ELSE 0.4 ** longest / (rest + 1)::DOUBLE END) AS x FROM s)
SELECT doc_id, len(words)::BIGINT AS n_words, round(sum(x) / nullif(len(words), 0), 5) AS mean_log_score
FROM d LEFT JOIN l ON d.r = l.r GROUP BY d.r, doc_id, words
"""
ship(__name__)
