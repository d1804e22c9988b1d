"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation
estimates how reliable they are, and a logistic span classifier trained on its posteriors decides which further spans to add.

Base spans (email, ip, card, phone, by fixed patterns and checks) always stay. Further candidates are looser forms:
e-mail addresses spelled with (at) and (dot), IPv6, national phone numbers, 15-digit and dotted cards. All candidates of
all texts, base and failed ones too, enter a histogram of vote patterns whose size the number of patterns bounds (a few
thousand rows whatever the corpus); only that histogram reaches the driver, for the EM and the classifier.

Defined cases. Null or empty text: no spans. Null doc_id: kept as null. Repeated rows: each answered. Very long texts:
scanned whole, every pattern in linear time. Empty table: no rows. Further columns of the input are ignored by find()
and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, ship

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = re.compile(r"[(\[{<\x20]dot[)\]}>\x20]", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|<at>|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}){1,4}", re.I)
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_OTHER_CARD = re.compile(r"(?<![0-9.])(?:3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}|[0-9]{4}([./])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9.]?[0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
#: Top-level domains, cue words before personal data of each kind, and cue words before other numbers.
_TLD = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at be us ca au jp in br mx pl se no dk fi pt ie nz za app dev".split())
_FOR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|contacto|correo|courriel|kontakt|write|reach)\b", re.I),
    "ip": re.compile(r"\b(ip|address|host|server|client|login|logged|adresse|direccion|from)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|payment|paid)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|telefono|appelez|llame|anruf)\b", re.I),
}
_AGAINST = re.compile(r"(\b(version|release|isbn|issn|sku|part|order|invoice|model|serial|section|chapter|ticket|ref|doi|build|patent)\b|#)\W{0,3}\w{0,3}\W{0,2}$", re.I)
#: Characters of context before a span, EM rounds, and the score from which a candidate is added.
CONTEXT, ROUNDS, ACCEPT = 40, 50, 0.5
N_VOTES, BUCKETS = 6, 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(span: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in span.split("."))


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, so in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((low, end))
        at = text.find("@", max(at + 1, end))
    return out


def scan(text: str) -> tuple[list, list]:
    """Base spans (kind, start, end) by kind and start; and the other candidates, failed base matches with them, as (kind, start, end, failed)."""
    base, other = [], []
    if "@" in text:
        base += [(0, s, e) for s, e in emails(text)]
    if "." in text:
        for m in _QUAD.finditer(text):
            good = _octets(m[0])
            (base if good else other).append((1, m.start(), m.end(), *[True] * (not good)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19:
            good = luhn(d)
            (base if good else other).append((2, m.start(), m.end(), *[True] * (not good)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            good = 8 <= len(_digits(m[0])) <= 15
            (base if good else other).append((3, m.start(), m.end(), *[True] * (not good)))
    loose = []
    if _DOT.search(text):
        loose += [(0, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if text.count(":") >= 7:
        loose += [(1, m.start(), m.end()) for m in _SIX.finditer(text)]
    loose += [(2, m.start(), m.end()) for m in _OTHER_CARD.finditer(text)]
    loose += [(3, m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    if loose:
        taken = sorted((b[1], b[2]) for b in base)
        starts = [t[0] for t in taken]
        reach = np.maximum.accumulate([t[1] for t in taken]) if taken else []
        end = 0
        for kind, s, e in sorted(loose, key=lambda x: (x[1], -x[2])):
            k = int(np.searchsorted(starts, e)) if taken else 0
            if s >= end and not (k and reach[k - 1] > s):
                other.append((kind, s, e, False))
                end = e
    return base, other


def votes(text: str, kind: int, s: int, e: int, is_base: bool) -> tuple[int, ...]:
    """The labelers' votes on a span: 1 for personal data, -1 against, 0 none; then a bucket of its length."""
    span, name, before = text[s:e], KINDS[kind], text[max(0, s - CONTEXT) : s]
    digits = _digits(span)
    if name == "email":
        check = -1 if ".." in span else 1
        known = 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].lower() in _TLD else 0
    elif name == "ip":
        check = 1 if ":" in span or _octets(span) else -1
        known = 0 if ":" in span else -1 if span.split(".")[0].lstrip("0") in ("", "127", "255") else 1
    elif name == "card":
        check = 1 if luhn(digits) else -1
        known = 1 if digits[0] in "3456" else -1
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        known = 1 if span[0] == "+" and digits[0] != "0" or span[0] != "+" and digits[0] in "23456789" else -1
    cue = 1 if _FOR[name].search(before) else 0
    against = -1 if _AGAINST.search(before) else 0
    edge = -1 if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) else 1
    dummy = -1 if digits and len(digits) > 7 and len(set(digits)) == 1 else 0
    return (1 if is_base else 0, check, known, cue + against, edge, dummy, min(BUCKETS - 1, (e - s) // 10))


def pattern(kind: int, v: tuple[int, ...]) -> int:
    """One number for a kind and its votes."""
    code = kind
    for x in v[:N_VOTES]:
        code = code * 3 + x + 1
    return code * BUCKETS + v[N_VOTES]


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and length buckets of patterns."""
    code, bucket = np.divmod(np.asarray(code, np.int64), BUCKETS)
    vote = np.empty((len(code), N_VOTES), np.int64)
    for k in range(N_VOTES - 1, -1, -1):
        code, x = np.divmod(code, 3)
        vote[:, k] = x - 1
    return code, vote, bucket


def features(code: np.ndarray) -> np.ndarray:
    kind, vote, bucket = unpack(code)
    return np.hstack([np.eye(len(KINDS))[kind], (vote == 1).astype(float), (vote == -1).astype(float), np.eye(BUCKETS)[bucket]])


def fit(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Classifier weights from the pattern histogram: EM over labelers with abstention and a prior for each kind, then logistic regression on the posteriors."""
    x = features(code) if len(code) else np.zeros((0, len(KINDS) + 2 * N_VOTES + BUCKETS))
    weights = np.zeros(x.shape[1])
    if not len(code):
        weights[: len(KINDS)] = -1.0
        return weights
    kind, vote, _ = unpack(code)
    n = count.astype(float)
    score = vote.sum(1)
    p = 1 / (1 + np.exp(-1.0 * (score - 1.5)))
    for _ in range(ROUNDS):
        prior = np.array([((n * p)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        like = np.zeros((len(code), 2))
        for j in range(N_VOTES):
            for c, q in enumerate((1 - p, p)):
                table = np.array([(n * q)[vote[:, j] == v].sum() + (2.0 if v == (1 if c else -1) else 1.0) for v in (-1, 0, 1)])
                like[:, c] += np.log(table / table.sum())[vote[:, j] + 1]
        z = np.log(prior / (1 - prior))[kind] + like[:, 1] - like[:, 0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    size = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (size * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.eye(x.shape[1])
        weights = weights + np.linalg.solve(h, x.T @ (size * (p - q)) - weights)
    return weights


def histogram(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each vote pattern stands in the whole corpus."""

    def count(batches):
        for batch in batches:
            seen: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    base, other = scan(text)
                    seen.update(pattern(k, votes(text, k, s, e, True)) for k, s, e in base)
                    seen.update(pattern(k, votes(text, k, s, e, False)) for k, s, e, _ in other)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    bounded_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").sum("n").collect()
    rows = sorted((r[0], r[1]) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def train(docs: DataFrame) -> np.ndarray:
    return fit(*histogram(docs))


def decide(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and the spans that the classifier adds, as (kind, start, end)."""
    base, other = scan(text)
    added = []
    tried = [(k, s, e, votes(text, k, s, e, False)) for k, s, e, failed in other if not failed]
    if tried:
        z = features(np.array([pattern(k, v) for k, _, _, v in tried])) @ weights
        added = [(k, s, e) for (k, s, e, v), x in zip(tried, z, strict=True) if 1 / (1 + np.exp(-x)) >= ACCEPT and v[1] >= 0]
    return base, added


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The spans of every text: doc_id, counts and digest of the base spans, all spans as a string, and how many the classifier added."""
    weights = train(docs) if weights is None else weights

    def answer(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = decide(text or "", weights)
                n = Counter(b[0] for b in base)
                rows.append((*[n[k] for k in range(len(KINDS))], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(answer, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs with every span, base or added, replaced by its kind in brackets; overlapping spans count as one, named by the first."""
    weights = train(docs) if weights is None else weights
    place, schema = docs.columns.index("text"), docs.schema
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text):
        base, added = decide(text, weights) if text else ([], [])
        out, at = [], 0
        for kind, s, e in sorted(base + added, key=lambda x: (x[1], x[2])):
            if s >= at:
                out += [text[at:s], f"[{KINDS[kind].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def answer(batches):
        for batch in batches:
            cols = list(batch.columns)
            old = cols[place].to_pylist()
            new = [clean(t) for t in old]
            cols[place] = pa.array(new, batch.schema.field(place).type)
            if length is not None:
                kept = cols[length].to_pylist()
                cols[length] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(answer, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ship(__name__)
