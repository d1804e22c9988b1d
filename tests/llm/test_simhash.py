"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from tilespan.llm import graph, simhash

from .cases import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, roots=False):
    """For (doc_id, fp) rows the least doc_id reachable over links of at most three bits; roots: which component instead."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                group[root(i)] = root(j)
    if roots:
        return [root(i) for i in range(len(prints))]
    least = {}
    for i, (doc, _) in enumerate(prints):
        ids = [x for x in (doc, least.get(root(i))) if x is not None]
        least[root(i)] = min(ids, default=None)
    return [least[root(i)] for i in range(len(prints))]


def test_documents(spark):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.collect()]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.classes(docs).collect()), key=str) == want


def test_every_distance_links(spark):
    """Random fingerprints with neighbours at every distance up to six, in every block of bits, and chains of them."""
    r = random.Random(5)
    found = {0, 7, 1 << 63, (1 << 64) - 1, (1 << 64) - 8}
    for _ in range(150):
        x = r.getrandbits(64)
        found.add(x)
        for d in range(1, 7):
            y = x
            for b in r.sample(range(64), d):
                y ^= 1 << b
            found.add(y)
    for _ in range(4):  # dense clusters
        x = r.getrandbits(64)
        for _ in range(120):
            y = x
            for b in r.sample(range(64), r.randint(0, 5)):
                y ^= 1 << b
            found.add(y)
    prints = sorted(found)
    rows = [(k, simhash.signed(f)) for k, f in enumerate(prints)]
    got = simhash.classes_of(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    want = dict(zip([f for _, f in rows], plain_components(list(enumerate(prints))), strict=True))
    assert {g.fp: g.component_id for g in got} == want


def test_deduplicate(spark):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.collect()]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    kept = simhash.deduplicate(docs)
    assert kept.schema == docs.schema
    got = [tuple(r) for r in kept.collect()]
    groups = {}
    for r, c, g in zip(rows, plain_components(prints), plain_components(prints, True), strict=True):
        groups.setdefault((g, c), []).append(r)  # two texts may share a doc_id
    assert sorted((r[0] for r in got), key=str) == sorted((c for _, c in groups), key=str)
    assert all(g in rows for g in got) and len(got) == len(groups)
    assert simhash.deduplicate(frame(spark, [])).count() == 0 == simhash.classes(frame(spark, [])).count()


def test_column_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, 5, "a b c", 6, 7), (2, 5, "a b c", 6, 7), (3, 5, None, 6, 7)], "doc_id long, c0 int, text string, __fp int, c1 int")
    kept = simhash.deduplicate(docs)
    assert kept.schema == docs.schema and sorted(tuple(r) for r in kept.collect()) == [(1, 5, "a b c", 6, 7), (3, 5, None, 6, 7)]


def test_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (7000, 6999)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, **{1000 + k: 1000 for k in range(1, 200)}, 7000: 6999}


def test_group_search():
    r = np.random.default_rng(2)
    group = r.integers(0, 2**12, 300, dtype=np.uint64)
    group = np.unique(group)
    forest = simhash.Forest()
    for x, y in simhash.links_of(group):
        assert (x ^ y).bit_count() <= 3
        forest.join(x, y)
    plain = plain_components(list(enumerate(map(int, group))))
    assert len({forest.root(int(x)) for x in group}) == len(set(plain))
