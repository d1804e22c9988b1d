"""Word tables, hashes, packed keys, and functions that travel without their package."""

import os
import random
import re
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from tilespan.llm import blocks, common, graph, lm, substring

from .cases import frame, row

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_word_table():
    r = random.Random(0)
    texts = ["".join(r.choice("ab \t\n\x0b\x0c\r\x1c\xa0é") for _ in range(r.randint(0, 60))).encode() for _ in range(200)] + [b"", b" ", b"x"]
    a, s, e, first = common.word_table(texts)
    found = [[a[s[k] : e[k]].tobytes() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert found == [WORD.findall(t) for t in texts] and first[-1] == len(s)


def test_hashes_depend_on_words_alone():
    words = [f"w{k}".encode() for k in range(3000)] + [b"x" * 5000, b"\x00", b"\x00\x00"]
    a, s, e, _ = common.word_table([b" ".join(words)])
    whole = common.word_hashes(a, s, e)
    assert len(np.unique(whole)) == len(words)
    b, s2, e2, _ = common.word_table([b"\n".join(reversed(words))])
    for piece in (1, 100, 1 << 21):
        assert (common.word_hashes(b, s2, e2, piece=piece)[::-1] == whole).all()
    assert len(common.window_hashes(whole, 5)) == len(words) - 4 and not len(common.window_hashes(whole[:3], 5))


def turned(n):
    """The two words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 agree for any base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_that_differ_have_hashes_that_differ():
    words = [w.encode() for n in range(3, 18) for w in turned(n)]
    words += [b"x" * n + c + b"y" * n for n in (32, 512, 50_000) for c in (b"p", b"q")]
    words += [b"a" * n for n in (1, 7, 8, 9, 63, 64, 65, 66, 1024, 100_000)]
    a, s, e, _ = common.word_table([b" ".join(words)])
    first, second = common.word_hashes(a, s, e), common.word_hashes(a, s, e, 1)
    assert len(np.unique(first)) == len(np.unique(second)) == len(words)
    assert not (first == second).any()


def test_short_words_never_meet():
    r = np.random.default_rng(1)
    words = {bytes(w[w > 32]) for w in r.integers(0, 255, (200_000, 9), np.uint8)} - {b""}
    a, s, e, _ = common.word_table([b" ".join(sorted(words))])
    assert len(np.unique(common.word_hashes(a, s, e))) == len(words)


def test_sizes():
    assert [common.byte_size(x) for x in ("64MB", "2m", "4096", "1g", "3kb", "512b", "-1")] == [64 << 20, 2 << 20, 4096, 1 << 30, 3 << 10, 512, -1]


def test_blocks_grow_with_the_root_of_the_corpus():
    assert blocks.grain(0) == blocks.grain(10**9) == blocks.LEAST_BYTES
    assert blocks.grain(10**11) == int((600 * 10**11) ** 0.5) and blocks.grain(10**14) == blocks.MOST_BYTES


def test_keys_round_trip():
    r = np.random.default_rng(0)
    for n in (1, 2, 1000):
        keys = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (blocks.unpack_keys(blocks.pack_keys(keys), n, False) == keys).all()
        wide = np.stack([keys, r.integers(0, 1 << 63, n).astype(np.uint64)], 1)
        assert (blocks.unpack_keys(blocks.pack_keys(wide), n, True) == wide).all()
    for values in ([0, 255], [256], [1 << 20], [1 << 40, 0]):
        assert blocks.grow(blocks.shrink(np.array(values)), len(values)).tolist() == values


def test_wide_keys_with_equal_first_halves():
    keys = np.array([[5, 2], [5, 1], [5, 2], [4, 9]], np.uint64)
    order, start = blocks.distinct(keys)
    assert keys[order][start].tolist() == [[4, 9], [5, 1], [5, 2]]
    assert substring.earlier(keys, np.array([3, 1, 2, 7])).tolist() == [1, 0, 0, 0]


def test_functions_travel_alone(tmp_path):
    """Executors need not have the package."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps((lm.Grams, substring.Windows)))
    code = "import sys; from pyspark import cloudpickle; g, w = cloudpickle.load(open('f', 'rb')); print(len(g([b'a b c', b'a b']).asked((1, 2, 3))[0]), len(w([1, 2], [b'a ' * 20, b'a ' * 30], [7, 13]).asked()[0]), 'tilespan' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.stdout.split() == ["6", "1", "False"], got.stderr


def test_components_of_long_paths(spark):
    """Paths whose ids lie in an order that merges slowly, a cycle, loops and repeated edges."""
    r = random.Random(5)
    place = list(range(600))
    r.shuffle(place)
    edges = [(place[k], place[k + 1]) for k in range(299)] + [(place[k], place[k + 1]) for k in range(300, 599)] + [(place[599], place[300])]
    edges += [(1000 + k, 1001 + k) for k in range(500)] + [(7000, 7000)] + [(8001, 8000), (8000, 8001)] * 5
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    want = {}
    for own in (place[:300], place[300:], range(1000, 1501), (8000, 8001)):
        want |= {v: min(own) for v in own if v != min(own)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_text_for_each_label(spark):
    docs = frame(spark, [row(1, f"text {k % 5000}") for k in range(50_000)] + [row(2, None), row(3, "c")])
    chosen = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, y int")
    got = common.labelled_texts(docs, chosen).collect()
    assert sorted(x.y for x in got) == [0, 1] and {x.text for x in got if x.y} == {None}
    assert {x.text for x in got} == {x.text for x in common.labelled_texts(docs.repartition(7), chosen).collect()}
