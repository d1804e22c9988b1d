"""Segments against all intervals, and accuracy on held-out labels."""

import random
import zlib

from tilespan.llm import toxicity

from .cases import EXTRA, frame


def plain_segments(scores, places, drift):
    """Maximal segments by definition: the best interval, then the same left and right of it."""
    if not scores:
        return []
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j] - (drift * (places[j] - places[j - 1] - 1) if j > i else 0)
            if best is None or total > best[0] + 1e-12:
                best = (total, i, j)
    total, i, j = best
    return plain_segments(scores[:i], places[:i], drift) + [(places[i], places[j], total)] + plain_segments(scores[j + 1 :], places[j + 1 :], drift)


def test_segments():
    r = random.Random(3)
    for _ in range(400):
        places = sorted(r.sample(range(200), r.randint(0, 25)))
        scores = [r.uniform(0.1, 5) for _ in places]
        got, want = toxicity.segments(scores, places, 0.31), plain_segments(scores, places, 0.31)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def corpus(n=900):
    r = random.Random(1)
    words, bad = [f"word{k}" for k in range(500)], ["scum", "vermin", "filth", "maggot"]
    docs, labels = [], []
    for k in range(n):
        own = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 6)):
                own.insert(r.randint(0, len(own)), r.choice(bad).title() + ",")
        docs.append((k, " ".join(own), "en", "s", 0, *EXTRA))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out(spark):
    rows, labels = corpus()
    odd = [(9001, None, None, None, None, *EXTRA), (9002, "", "en", "s", 0, *EXTRA), (None, "scum scum filth", "en", "s", 0, *EXTRA), (9003, "word1 " * 30_000, "en", "s", 0, *EXTRA), (9004, "Scum! Vermin. word1", "en", "s", 0, *EXTRA)]
    docs = frame(spark, rows + odd + odd[:1])
    table = spark.createDataFrame(labels + [(None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 6
    truth = {k: t for k, _, t in labels}
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode() if g.doc_id is not None else b"") % 5 == 0)
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5)
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.97
    by = {g.doc_id: g for g in got}
    assert by[9004].predicted == 1 and by[None].predicted == 1 and by[9001].score == by[9002].score < 0.5 and by[9003].predicted == 0
    spans = toxicity.passages(docs, model).where("doc_id = 9004").collect()
    text = "Scum! Vermin. word1"
    assert spans and all(text[s.start : s.end] == s.passage for s in spans)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_copies_weigh_once(spark):
    """A large group of copies of one toxic text, some in other case and punctuation, removes no word that other toxic texts hold."""
    rows, labels = corpus()
    text = "scum vermin filth maggot " + " ".join(f"copied{k}" for k in range(30))
    copies = [(10_000 + k, text if k % 2 else f" {text.upper()} !\n", "en", "s", 0, *EXTRA) for k in range(3000)]
    table = spark.createDataFrame(labels + [(c[0], 1, 1) for c in copies], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows + copies), table)
    alone = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    words = set(toxicity.tokens([b"scum vermin filth maggot"])[0].tolist())
    assert words <= set(alone.hashes.tolist()) and words <= set(model.hashes.tolist())
    assert not set(toxicity.tokens([b" ".join(b"copied%d" % k for k in range(30))])[0].tolist()) & set(model.hashes.tolist())


def test_folded_has_the_same_tokens(spark):
    texts = [" A, b\t\x0bC!\r\n", "", None, "\u00c9 \u00a0x\u2003Y's {z}", "...", "a b  c"]
    got = [r.f for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", toxicity.folded("t").alias("f")).orderBy("k").collect()]
    own = lambda t: toxicity.tokens([(t or "").encode()])[0].tolist()
    assert [own(g) for g in got] == [own(t) for t in texts] and got[0] == got[5] == "a b c"


def test_labels_decide_nothing_at_scoring(spark):
    """The same text has the same score whatever its id, source or language."""
    rows, labels = corpus(300)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    twins = [(k, rows[5][1], lang, src, k, *EXTRA) for k, (lang, src) in enumerate([("en", "a"), ("fr", None), (None, "b")])]
    assert len({g.score for g in toxicity.score(frame(spark, twins), model).collect()}) == 1


def test_one_class(spark):
    rows, labels = corpus(60)
    for value in (0, 1):
        table = spark.createDataFrame([(k, 1, value) for k, _, _ in labels], "doc_id long, quality int, toxic int")
        got = {g.predicted for g in toxicity.score(frame(spark, rows), toxicity.train(frame(spark, rows), table)).collect()}
        assert got == {value}
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {g.predicted for g in toxicity.score(frame(spark, rows), toxicity.train(frame(spark, rows), nothing)).collect()} == {0}
