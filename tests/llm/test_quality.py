"""Base rules against brute force, constraints of the trees, and accuracy on held-out labels."""

import re

import numpy as np
import pytest

from tilespan.llm import quality

from .cases import frame
from .test_common import turned

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, at = WORD.findall(text), {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_base(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in docs.collect()]
    got = quality.assess(docs, labels).collect()
    want = sorted(((r[0], *brute(r[1] or "")) for r in rows), key=str)
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=str) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_odd_texts():
    texts = ["a b c d e a b c d e", "x\nx\n\nx \n", "é|漢 字#", "# * $ % & | < >", "\x00 \x1c\x85 b", "w " * 100_000]
    base, feats = quality.statistics([t.encode() for t in texts])
    assert base.tolist() == [brute(t) for t in texts] and np.isfinite(feats).all()


def test_filter_follows_the_verdict(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.filtered(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == quality.assess(docs, labels).where("kept").count() > 0
    assert quality.assess(frame(spark, []), labels).count() == 0 == quality.filtered(frame(spark, []), labels).count()


def test_constraints_hold():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.3 * r.random(3000)) > 0.8).astype(float)
    trees = quality.boost(x, y, [1, 0, -1], depth=4)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85
    for j, direction in ((0, 1), (2, -1)):
        z = np.repeat(r.random((50, 3)), 40, 0)
        z[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (direction * np.diff(trees.score(z).reshape(50, 40), axis=1)).min() >= -1e-12


@pytest.mark.parametrize("classes", [0, 1])
def test_one_class(spark, classes):
    labels = spark.createDataFrame([(3, classes, 0), (6, classes, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(frame(spark), labels) is None


def test_held_out():
    """Junk against prose, on documents that the trees have not seen."""
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(800)]

    def text(bad):
        own = list(r.choice(words, 60))
        if bad:
            own = [w + "%%%" for w in own] if r.random() < 0.5 else [own[0]] * 60
        return " ".join(own).encode()

    y = (r.random(1200) < 0.8).astype(float)
    x = quality.statistics([text(not v) for v in y])[1]
    trees = quality.boost(x[:800], y[:800], [d for _, d in quality.FEATURES])
    assert ((trees.score(x[800:]) >= 0.5) == y[800:]).mean() > 0.98


def test_long_words_that_differ_repeat_nothing():
    a, b = turned(10)
    base, _ = quality.statistics([f"p q r s {a} x1 x2 x3 x4 x5 p q r s {b}".encode(), f"p q r s {a} x1 x2 x3 x4 x5 p q r s {a}".encode()])
    assert base[:, 4].tolist() == [0, 10]
