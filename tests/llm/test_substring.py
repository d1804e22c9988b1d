"""Passage removal against brute force."""

import hashlib
import re

from tilespan.llm import substring

from .cases import frame, row
from .test_common import turned

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(substring.LAST if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for rank, words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(rank, first.get(key, rank))
    out = []
    for (rank, words), r in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < rank:
                gone.update(range(i, i + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = frame(spark).repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    for window in (13, 8, 30):
        got = substring.dedup(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_small_blocks(spark, monkeypatch):
    from tilespan.llm import blocks

    docs = frame(spark)
    rows = [tuple(r) for r in docs.collect()]
    monkeypatch.setattr(blocks, "grain", lambda total: 1 << 12)
    made = blocks.make_blocks
    monkeypatch.setattr(substring, "make_blocks", lambda d: made(d, 2000))
    got = substring.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 13)


def test_empty(spark):
    assert substring.dedup(frame(spark, [])).count() == 0


def test_long_words_that_differ(spark):
    for n in (10, 16):
        a, b = turned(n)
        head = " ".join(f"w{k}" for k in range(12))
        got = substring.dedup(frame(spark, [row(1, f"{head} {a}"), row(2, f"{head} {b}"), row(3, f"{head} {b}")])).collect()
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def test_levels():
    assert substring.levels(13) == [7, 13] and substring.levels(8) == [8] and substring.levels(50) == [7, 13, 25, 50]
