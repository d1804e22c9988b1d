"""Substring deduplication by level-wise doubling of repeated windows.

Levels are window lengths, each about twice the one before, up to the wanted length (13 words: 7, then 13). At the first
level only one window in each wanted stretch need be looked at: that of least hash (winnowing), which two documents that
share the stretch both choose. Windows repeated at one length alone are extended to the next: a longer window stays a
candidate if both halves, or its chosen first-level window, stand in another document too. At the last level a bucket
tells each candidate whether a document of smaller doc_id starts the same window (128 bits there: two hashes of all words
under two seeds, so words that met in one would differ in the other). No pairs are made, and a passage that a third of all documents hold is one key a block.

Defined cases. Null or empty text: no words. Null doc_id: after all others; such documents are no earlier than each other.
Rows of one doc_id: neither is earlier than the other. Fewer words than a window: nothing removed. Very long texts: whole.
Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ask, distinct, each_block, joined, make_blocks, plan_for
from .common import bounded_batches, ship, window_hashes, word_hashes, word_table

WINDOW, SHORTEST = 13, 8
LAST = (1 << 63) - 1


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """The candidate windows of one block, level by level."""

    def __init__(self, ids, texts, lengths):
        self.lengths, self.texts = lengths, texts
        self.bytes, self.starts, self.ends, self.first = word_table(texts)
        self.words = word_hashes(self.bytes, self.starts, self.ends)
        self.rank = np.array([LAST if i is None else i for i in ids], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.at = self.whole(lengths[min(1, len(lengths) - 1)])
        self.chosen = self.at
        if len(lengths) > 1:
            h, span = window_hashes(self.words, lengths[0]), lengths[1] - lengths[0] + 1
            best, least = self.at.copy(), h[self.at]
            for j in range(1, span):
                other = h[self.at + j]
                less = other < least
                best[less], least[less] = self.at[less] + j, other[less]
            self.chosen = best
        self.step = 0

    def whole(self, size: int) -> np.ndarray:
        """Starts of the windows of a length that lie in one document."""
        at = np.arange(max(0, len(self.words) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]]

    def keys(self) -> np.ndarray:
        """Hashes of the windows asked about at this level, one for each place."""
        size = self.lengths[self.step]
        if self.step == len(self.lengths) - 1:
            other = word_hashes(self.bytes, self.starts, self.ends, 1)
            return np.stack([window_hashes(self.words, size)[self.places()], window_hashes(other, size, 77)[self.places()]], 1)
        return window_hashes(self.words, size)[self.places()]

    def places(self) -> np.ndarray:
        return self.picked if self.step == 0 and len(self.lengths) > 1 else self.at

    @property
    def picked(self) -> np.ndarray:
        """The distinct windows chosen at the first level."""
        flag = np.zeros(len(self.words), bool)
        flag[self.chosen] = True
        return np.flatnonzero(flag)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys; for each whether several documents hold it, or at the last level the least doc_id; and each place's key."""
        keys, docs = self.keys(), self.doc[self.places()]
        order, start = distinct(keys)
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
        if not len(start):
            return keys, np.zeros(0, np.int64), which
        value = self.rank[docs[order]]
        low = np.minimum.reduceat(value, start)
        if self.step < len(self.lengths) - 1:
            held = docs[order]
            low = (np.minimum.reduceat(held, start) != np.maximum.reduceat(held, start)).astype(np.int64)
        return keys[order][start], low, which

    def learn(self, reply: np.ndarray) -> None:
        """Keeps the places whose windows repeat, and extends them to the next length."""
        _, _, which = self.asked()
        good = reply[which] > 0 if len(reply) else np.zeros(len(which), bool)
        flag = np.zeros(len(self.words) + 1, bool)
        flag[self.places()[good]] = True
        if self.step == 0 and len(self.lengths) > 1:
            self.at = self.at[flag[self.chosen]]
        else:
            longer, shorter = self.lengths[self.step + 1], self.lengths[self.step]
            at = self.whole(longer)
            self.at = at[flag[at] & flag[at + longer - shorter]]
        self.step += 1

    def removed(self, reply: np.ndarray) -> np.ndarray:
        """Which words are covered by a window that starts in a document of smaller doc_id too."""
        _, low, which = self.asked()
        size = self.lengths[-1]
        step = np.zeros(len(self.words) + 1, np.int64)
        if len(which):
            earlier = (reply[which] > 0) | (low[which] < self.rank[self.doc[self.at]])
            at = self.at[earlier]
            np.add.at(step, at, 1)
            np.add.at(step, at + size, -1)
        return np.cumsum(step)[:-1] > 0


def _signed(values: np.ndarray) -> np.ndarray:
    """Ids as non-negative numbers of the same order."""
    return (values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.uint64)


def repeated(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """1 for entries whose key has another entry, or several documents in one."""
    order, start = distinct(keys)
    size = np.diff(np.append(start, len(keys)))
    many = (size > 1) | (np.add.reduceat(several[order], start) > 0)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(many, size)
    return out


def earlier(keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for entries whose key has an entry of smaller value."""
    order, start = distinct(keys)
    value = value.view(np.uint64)
    size = np.diff(np.append(start, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(value[order], start), size) < value[order]
    return out


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) of every document."""
    lengths = levels(window)
    blocks = make_blocks(docs)
    plan = plan_for(blocks)
    answers: list[DataFrame] = []

    def at_level(ids, texts, before):
        own = Windows(ids, texts, lengths)
        for reply in before:
            own.learn(reply)
        return own

    for step in range(len(lengths)):
        last = step == len(lengths) - 1

        def request(ids, texts, before, last=last):
            keys, value, _ = at_level(ids, texts, before).asked()
            return keys, _signed(value) if last else value

        answers.append(ask(blocks, request, earlier if last else repeated, plan, wide=last, answers=list(answers)))

    def finish(batches):
        for _, ids, texts, *before in each_block(batches):
            own = at_level(ids, texts, before[:-1])
            gone, rows = own.removed(before[-1]), []
            for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                flag = gone[own.first[k] : own.first[k + 1]]
                words = text.split()
                kept = b" ".join(w for w, f in zip(words, flag.tolist(), strict=True) if not f) if flag.any() else b" ".join(words)
                rows.append((doc, len(flag), int(flag.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    bounded_batches(docs.sparkSession)
    return joined(blocks, answers, plan).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT DISTINCT g.doc_id, g.i + o AS p FROM g JOIN m ON g.k = m.k AND m.first < g.doc_id, (SELECT unnest(range(0, 13)) AS o)),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (
  SELECT x.doc_id, count(*) AS n_words, count(r.p) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE r.p IS NULL), '') AS kept
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
ship(__name__)
