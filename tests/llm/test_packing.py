"""Packing: every id once, gapless, little padding."""

import zlib

import numpy as np

from tilespan.llm import packing

from .cases import EXTRA, frame, row


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.paths()[0])
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def check(rows, got, window):
    """Rows of one doc_id and text are documents of their own, so their pieces are counted."""
    want = {}
    for r, ids in zip(rows, tokens([r[1] for r in rows]), strict=True):
        want.setdefault((r[0], len(ids)), []).append(ids)
    used, parts = {}, {}
    for g in got:
        used.setdefault(g.sequence_id, []).append((g.offset, g.length))
        parts.setdefault((g.doc_id, g.doc_tokens), []).append((g.start, g.length, g.ids_crc32))
    assert set(parts) == set(want)
    for key, docs in want.items():
        assert sum(n for _, n, _ in parts[key]) == sum(map(len, docs))
        for start, n, crc in parts[key]:
            assert any(zlib.crc32(d[start : start + n].tobytes()) == crc for d in docs)
    total = padding = 0
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= window
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else window - at)
    return padding / max(1, total + padding)


def test_documents(spark):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.collect()]
    for window, grain in ((2048, 8), (256, 8)):
        got = packing.placements(docs, window=window, grain=grain).collect()
        assert check(rows, got, window) < 0.05


def test_one_length(spark):
    """A histogram that no combination can fill leaves its pieces to cutting."""
    rows = [row(k, "a b c d e f g h i j " * 120) for k in range(60)]
    got = packing.placements(frame(spark, rows)).collect()
    assert check(rows, got, 2048) < 0.05


def test_empty_and_special(spark):
    assert packing.placements(frame(spark, [])).count() == 0
    rows = [row(1, "x <|endoftext|> y"), row(2, None), (None, "z", None, None, None, *EXTRA)]
    check(rows, packing.placements(frame(spark, rows)).collect(), 2048)


def test_sequences(spark):
    docs = frame(spark)
    got = packing.sequences(docs).collect()
    places = packing.placements(docs).collect()
    assert sum(r.n_used for r in got) == sum(p.length for p in places)
    assert all(len(r.ids) in (2048, r.n_used) for r in got)


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (20, 60)).astype(float)
    truth = np.where(rng.random(60) < 0.2, rng.random(60), 0)
    x = packing.nnls(a, a @ truth)
    assert x.min() >= 0 and np.abs(a @ x - a @ truth).max() < 1e-3
    b = rng.random(20)
    x = packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert slope.min() > -1e-5 and abs(slope @ x) < 1e-5


def test_combinations():
    got = {tuple(sorted(int(v) for v in r if v)) for r in packing.combinations(24)}
    want = {tuple(sorted((a, b))) for a in range(1, 24) for b in range(1, 24) if a + b == 24}
    want |= {tuple(sorted((a, b, 24 - a - b))) for a in range(1, 23) for b in range(1, 23) if 24 - a - b > 0}
    assert got == want


def test_two_tokenizers_agree():
    """The faster library gives the ids of the one that the contract names, on odd characters, blanks, marks and case."""
    import random

    r = random.Random(4)
    ids, encode = tokens, packing.encoder(*packing.paths())
    pools = ["abc XYZ'sdtlm 019", " \t\n\r\x0b\x0c\x85\xa0\u2003\u3000", "éüßñ\u0301\u200d\u00ad", "漢字かな\u0e01\u0e33\u0905", "\U0001f600\U0001f468\u200d\U0001f469\ufe0f", "\x00\x01\x1f\x7f\ufffe", ".,;:!?-_#*$%&|<>()"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|>", "a<|", "x" * 5000, " " * 5000, "1" * 3000]
    for text, want in zip(texts, ids(texts), strict=True):
        assert encode(text).tolist() == want[:-1].tolist(), text


def test_other_trouble_is_raised():
    encode = packing.encoder(*packing.paths())
    for wrong in (5, None):
        try:
            encode(wrong)
        except TypeError:
            continue
        raise AssertionError


def test_waves():
    got = packing.in_waves([((3, 5), 7), ((8,), 2)], 4)
    assert [w for w, _, _ in got] == sorted(w for w, _, _ in got)
    assert sum(n for _, p, n in got if p == (3, 5)) == 7 and sum(n for _, p, n in got if p == (8,)) == 2


def test_sequences_keep_the_documents_order(spark, tmp_path):
    """Read back from sorted files, early documents stand in early sequences."""
    import random

    r = random.Random(1)
    rows = [row(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 2500)))) for k in range(1500)]
    frame(spark, rows).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    got = packing.placements(spark.read.parquet(f"{tmp_path}/docs"), grain=128).collect()
    assert check(rows, got, 2048) < 0.1
    last = max(g.sequence_id for g in got)
    assert {g.sequence_id for g in got} == set(range(last + 1))
    off = [abs(g.sequence_id / last - g.doc_id / len(rows)) for g in got]
    assert sorted(off)[len(off) // 2] < 0.05 and sorted(off)[9 * len(off) // 10] < 0.15
