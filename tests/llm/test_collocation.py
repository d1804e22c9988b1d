"""Phrase collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tilespan.llm import collocation

from .cases import EXTRA, frame

WORDS = re.compile(r"[^\x20\x09]+")


def brute(rows, max_n=5, least=100, share=100, top=2000):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = WORDS.findall(piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) >= 2 and a >= least}
        hidden = set()
        for p, a in some.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and p[i:j] in some and 100 * a >= share * some[p[i:j]]:
                        hidden.add(p[i:j])
        scored = []
        for p, a in some.items():
            if p not in hidden:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows_of(seed, n=300):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "漢字", "a-b", "\x1c", "x\xa0y", "new", "york", "City", "in", "'s", "long" * 30]
    fixed = ["new york city", "in the city of", "of the of the of the", "漢字 é 漢字 é"]
    out = []
    for k in range(n):
        words = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "? "]) for w in words)
        out.append((k, text, r.choice(["en", "de", None, "und"]), "s", 1, *EXTRA))
    return out + [(None, None, "en", "s", 1, *EXTRA), (1, "", "xx", "s", 1, *EXTRA), (2, " . ", "yy", "s", 1, *EXTRA), (3, "one", "zz", "s", 1, *EXTRA)]


@pytest.mark.parametrize(("max_n", "least", "share", "top"), [(5, 20, 100, 2000), (3, 5, 60, 7), (2, 1, 100, 2000)])
def test_brute_force(spark, max_n, least, share, top):
    rows = rows_of(max_n)
    got = sorted(tuple(r) for r in collocation.collocations(frame(spark, rows), max_n, least, share, top).collect())
    assert got == brute(rows, max_n, least, share, top) and got


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocation, "BLOCK", 50)
    monkeypatch.setattr(collocation, "CHUNK", 400)
    rows = rows_of(11, 60)
    got = sorted(tuple(r) for r in collocation.collocations(frame(spark, rows), 4, 3).collect())
    assert got == brute(rows, 4, 3) and got


def test_filter_that_holds_everything(spark, monkeypatch):
    """A filter as full as can be only lets more rows through."""
    monkeypatch.setattr(collocation, "MOST_BITS", 64)
    rows = rows_of(12, 80)
    assert sorted(tuple(r) for r in collocation.collocations(frame(spark, rows), 4, 4).collect()) == brute(rows, 4, 4)


def test_exact_beyond_64_bits(spark):
    """Products of counts pass 64 bits: 1000 * a * n with a and n in the billions."""
    a, n, low = 4_000_000_019, 9_000_000_000_013, 4_000_000_037
    got = spark.range(1).selectExpr(f"cast(1000 as decimal(4,0)) * cast(cast({a}L as decimal(19,0)) * cast({n}L as decimal(19,0)) as decimal(34,0)) div (cast({low}L as decimal(19,0)) * cast({low}L as decimal(19,0))) s").first()[0]
    assert got == 1000 * a * n // (low * low)


def test_empty(spark):
    assert collocation.collocations(frame(spark, [])).count() == 0
    assert collocation.collocations(frame(spark, [(1, None, None, "s", 1, *EXTRA)])).count() == 0


def test_filter_has_no_false_negative():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    words = np.zeros(256, np.uint64)
    for place in collocation.probes(hashes, 64 * 256):
        np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    assert collocation.held(words, hashes).all()
    assert collocation.held(words, hashes ^ np.uint64(12345)).mean() < 0.1
