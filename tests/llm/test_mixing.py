"""The mix against an iterative statement of its targets, and its rows against its own decisions."""

import re

from pyspark.sql import functions as F

from tilespan.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, target double, n_chars long"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(target[s] for s in stopped)
        share = sum(weight[s] for s in free)
        over = []
        for s in free:
            target[s] = rest * weight[s] / share
            if target[s] > most * sizes[s] + 1e-9:
                over.append(s)
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            stopped.add(s)


def rows():
    out = []
    for k in range(300):
        source = None if k % 17 == 0 else f"s{k % 5}" if k % 3 else "s0"
        text = None if k % 41 == 0 else " ".join(f"w{j}" for j in range((k * 7) % 60)) + ("\n\t " if k % 2 else "")
        out.append((None if k == 5 else k, text, source, "x", 1.0, 0))
    out += [(7, "a b c", "s1", "x", 1.0, 0)] * 3 + [(900, "one " * 5000, "s4", "x", 1.0, 0), (901, "é z \x0b\x1c", "tiny", "x", 1.0, 0)]
    return out


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    expect = brute_targets(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted((sizes[s], round(t, 6)) for s, t in expect.items()) == sorted(by_size)
    for (_, target), taken in by_size.items():
        assert abs(sum(taken) - target) <= 1


def test_rows_follow_the_decisions(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    decided = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed_rows(docs)
    assert mixed.schema == docs.schema
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == decided


def test_positions_invert_demand():
    for schedule in mixing.SCHEDULES:
        parts = mixing.segments(schedule)
        assert abs(parts[-1][4] - 1) < 1e-12
        for t0, w0, slope, low, high in parts:
            t1 = t0 + ((w0 * w0 + 2 * slope * (high - low)) ** 0.5 - w0) / slope if slope else t0 + (high - low) / w0
            assert abs(low + w0 * (t1 - t0) + slope * (t1 - t0) ** 2 / 2 - high) < 1e-12


def test_positions_follow_the_schedules(spark):
    """Up to any position, a source's words due by then are its schedule's integral there, to a document's size."""
    got = [r for r in mixing.mix(spark.createDataFrame(rows(), SCHEMA)).collect() if r.taken]
    curves = (lambda t: 1.5 * t - t * t / 2, lambda t: t, lambda t: t / 2 if t < 0.5 else 0.25 + (t - 0.5) / 2 + 2 * (t - 0.5) ** 2)
    names = sorted({s for _, _, s, *_ in rows()}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(WORD.findall(r[1] or "")) for r in rows() if r[2] == s) for s in names}
    for k, s in enumerate(names):
        own = [r for r in got if r.source_size == sizes[s]]
        for r in own:
            assert len(r.positions) == r.passes + (r.rest > 0) and r.positions == sorted(r.positions) and r.first_position == r.positions[0]
        for at in (0.1, 0.3, 0.5, 0.9):
            due = sum((p < at) * (r.rest if i == r.passes else r.size) for r in own for i, p in enumerate(r.positions))
            assert abs(due - curves[k % 3](at) * sum(r.taken for r in own)) <= max(r.size for r in own)


def test_reruns_take_the_same_texts(spark):
    """Documents of one id and size, but not one text."""
    docs = spark.createDataFrame([(1, f"a{k} b c d e f g", "s" if k % 2 else "t", "", 0.0, 0) for k in range(80)], SCHEMA)
    first, second = (sorted(map(str, mixing.mixed_rows(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == second


def test_one_key_in_several_ranges(spark, monkeypatch):
    """Equal rows share the sum of their words over any number of ranges."""
    made = mixing.ranged
    monkeypatch.setattr(mixing, "ranged", lambda df, order, label: made(df, order, label, 7))
    docs = spark.createDataFrame([(None, "a b c", "s", "", 0.0, 0)] * 90 + [(k, "a b c d", "t", "", 0.0, 0) for k in range(10)], SCHEMA)
    got = mixing.mix(docs).collect()
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_names_with_backticks(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5)], "doc_id long, text string, source string, `a``b.c` int")
    assert mixing.mixed_rows(docs).first()["a`b.c"] == 5


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([(1, "", "a", "", 0.0, 0), (2, None, None, "", 0.0, 0)], SCHEMA)).count() == 0
