"""Base spans against plain regular expressions, the estimation, and redaction."""

import hashlib
import random
import re

import numpy as np

from tilespan.llm import pii

from .cases import EXTRA, frame, row

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1]]
        return 16 <= len(digits) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in PLAIN[kind].finditer(text) if passes(kind, m[0])]


def test_base_spans():
    r = random.Random(1)
    for k in range(8000):
        text = "".join(r.choice("0123456789..--@@ab +( )é\n" + "0123456789" * (3 * (k % 3 == 0))) for _ in range(r.randint(0, 80)))
        assert sorted(pii.scan(text)[0]) == brute(text)
    for text in ("4111 1111-1111 1111 x", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (555) 010-2030.", "x@@y.z", "a@b", "١٢٣٤@x.y", "001.02.3.255 256.1.1.1"):
        assert sorted(pii.scan(text)[0]) == brute(text)


def test_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, "+1" * 200_000):
        pii.decide(text, pii.fit(np.zeros(0, int), np.zeros(0, int)))


def planted():
    card = "4111 1111 1111 1111"
    out = [row(k, f"Call me on phone: +1 (555) 010-{2000 + k} or mail jo.{k}@mail.example.com now, card {card}, host 10.0.{k}.7.") for k in range(40)]
    out += [row(100 + k, f"phone: (555) 310-{2000 + k} please call. email: jo (at) mail (dot) com") for k in range(12)]
    out += [row(200 + k, f"version 300.2.{k}.9 of part 1234 5678 9012 {3000 + k} here") for k in range(30)]
    return out + [row(300, None), row(301, ""), row(None, "é a@b.co"), (302, "plain words only", None, None, None, *EXTRA), row(303, "1.2.3.4"), row(303, "1.2.3.4")]


def test_find(spark):
    rows = planted()
    docs = frame(spark, rows)
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    by = {(g.doc_id, g.base_sha256): g for g in got}
    for r in rows:
        base = brute(r[1] or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        g = by[r[0], hashlib.sha256(text.encode()).hexdigest()]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        spans = [x for x in g.spans.split(",") if x]
        assert {x for x in text.split(",") if x} <= set(spans) and len(spans) == len(base) + g.n_added
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
        if r[0] is not None and 200 <= r[0] < 300 or r[0] == 302:
            assert not g.n_added  # failed matches are not brought back
        if r[0] is not None and 100 <= r[0] < 200:
            assert "phone:" in g.spans
    assert pii.find(frame(spark, [])).count() == 0


def test_redact(spark):
    rows = planted()
    docs = frame(spark, rows)
    clean = pii.redact(docs)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    got = {r.doc_id: r for r in clean.collect()}
    assert got[3].text == "Call me on phone: [PHONE] or mail [EMAIL] now, card [CARD], host [IP]." and got[3].n_chars == len(got[3].text)
    assert got[302].text == "plain words only" and got[300].text is None
    assert pii.redact(frame(spark, [])).count() == 0


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known reliabilities: posteriors of the fitted classifier follow the hidden truth."""
    r = np.random.default_rng(0)
    code, truth = [], []
    for _ in range(4000):
        t = r.random() < 0.4
        vote = [1 if t and r.random() < 0.8 else 0, (1 if (t == (r.random() < 0.95)) else -1), (1 if (t == (r.random() < 0.8)) else -1), 1 if t and r.random() < 0.5 else 0, (1 if t or r.random() < 0.6 else -1), 0]
        code.append(pii.pattern(3, (*vote, 1)))
        truth.append(t)
    codes, counts = np.unique(code, return_counts=True)
    w = pii.fit(codes, counts)
    p = pii.features(np.array(code)) @ w >= 0
    assert (p == np.array(truth)).mean() > 0.93


def test_patterns_round_trip():
    for kind in range(4):
        for v in ((1, -1, 0, 1, -1, 0, 3), (0, 1, 1, -1, 1, -1, 0)):
            k, votes, bucket = pii.unpack(np.array([pii.pattern(kind, v)]))
            assert (k[0], *votes[0], bucket[0]) == (kind, *v)
