"""Fill-in-the-middle: units by the event scan against the plain pattern, cuts against a brute-force rule, exact way back."""

import hashlib
import random
import re

import pytest

from tilespan.llm import infill

from .cases import EXTRA, frame, row

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(5)
    letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "é", "漢", "\U0001f600", "<", "P", ">", "S", "\x1c", "\x85", "\xa0", "\u2003", "\x00"]
    return ["", " ", "a", " a", "a ", "<P>", "<P", "<<S>>", "x <M>", "\xa0", "<S\n>"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(400)]


def test_units_by_events():
    for text in odd_texts():
        spaces, marks = infill.events(text)
        ends, at = [], 0
        for u in UNIT.findall(text):
            at += len(u)
            ends.append(at)
        assert infill.unit_ends(spaces, len(text)).tolist() == ends
        assert [text[int(p) - 2 : int(p) + 1] for p, _ in marks] == re.findall("<[PSM]>", text)


def test_cuts_and_way_back():
    forms = set()
    for k, text in enumerate(odd_texts() * 3):
        found = infill.infilled(text, k)
        assert found == expected(k, text)
        assert infill.rebuilt(found[4], found[1]) == text
        forms.add(found[1])
    assert forms == {"plain", "spm", "psm"}


def test_parameters():
    text = "one two three four"
    assert infill.infilled(text, 3, rate=0)[1] == "plain"
    assert {infill.infilled(text, k, rate=100, suffix_first=0)[1] for k in range(50)} == {"psm"}
    assert {infill.infilled(text, k, rate=100, suffix_first=100)[1] for k in range(50)} == {"spm"}
    assert len({infill.infilled(text, k, seed=7, rate=100)[4] for k in range(50)}) > 5
    with pytest.raises(ValueError):
        infill.rebuilt("<P>a<M>b<S>c", "psm")


def test_whole_table(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = infill.restore(infill.transform(docs)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted(((d, *expected(d, t)) for d, t in rows), key=key)
    assert sorted(((r.doc_id, r.restored) for r in out), key=key) == sorted(((d, t or "") for d, t in rows), key=key)


def test_empty_table_and_long_text(spark):
    assert infill.restore(infill.transform(frame(spark, []))).count() == 0
    text = "wörter \U0001f600 und\n" * 200_000
    got = infill.restore(infill.transform(frame(spark, [(k, text, "en", "s", 1, *EXTRA) for k in range(8)] + [row(9, "x")]))).collect()
    assert all(r.restored == text and r.n == 600_001 for r in got if r.doc_id < 9) and len(got) == 9
