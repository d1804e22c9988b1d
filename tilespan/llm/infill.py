"""Fill-in-the-middle transformation by an event scan.

A unit is a run of whitespace with the word after it; whitespace at the end of a text is a unit of its own. One Aho-Corasick
automaton finds, in a single pass over the code points, the six ASCII characters that change a character's class (whitespace)
and the sentinels. A gap between two neighbouring whitespace events is a word if it is not empty, so the unit count is the
number of such gaps and the k-th unit ends where the k-th gap does: no unit is ever cut out, only the two chosen ranks are
looked up among the gaps. The sentinel events decide whether a text may be transformed, and lead the way back.

Two documents of one doc_id are cut by the same draws. A retried task gives the same rows, as all draws are digests of doc_id.

Defined cases. Null or empty text: plain, no units, an empty output. Text of whitespace alone: one unit. Null doc_id: kept as null, drawn
as an empty string. Texts that hold a sentinel: plain. Repeated rows: each answered, alike. Very long texts: whole, some 16 bytes of
memory for each whitespace character. Empty table: no rows. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cached, ship

SPACES, PREFIX, SUFFIX, MIDDLE = "\x20\x09\x0a\x0b\x0c\x0d", "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and per cent of those with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80


def _automaton():
    found = ahocorasick.Automaton()
    for c in SPACES:
        found.add_word(c, 0)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE), 1):
        found.add_word(mark, k)
    found.make_automaton()
    return found


def events(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of whitespace, and (position of the last character, which) of the sentinels, in order."""
    scan = cached("infill automaton", _automaton).iter(text)
    found = np.fromiter(chain.from_iterable(scan), np.int64).reshape(-1, 2)
    marks = found[:, 1] > 0
    return found[~marks, 0], found[marks]


def unit_ends(spaces: np.ndarray, size: int) -> np.ndarray:
    """Where each unit ends, from the whitespace of a text of this size."""
    edges = np.concatenate(([-1], spaces, [size]))
    ends = edges[1:][np.diff(edges) > 1]
    return np.append(ends, size) if len(spaces) and spaces[-1] == size - 1 else ends


def draws(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def infilled(text: str, doc_id, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    spaces, marks = events(text)
    ends = unit_ends(spaces, len(text))
    n, h = len(ends), draws(doc_id, seed)
    if not text or len(marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def rebuilt(output: str, form: str) -> str:
    """The text that an output of this form was made of; anything but its three sentinels in order is an error."""
    if form == "plain":
        return output
    _, marks = events(output)
    if marks[:, 1].tolist() != ([1, 2, 3] if form == "psm" else [2, 1, 3]):
        raise ValueError(f"the sentinels are not those of {form}")
    (_, one, two), last = (int(x) + 1 for x in marks[:, 0]), len(output)
    first, second, third = output[len(PREFIX) : one - len(PREFIX)], output[one : two - len(MIDDLE)], output[two:last]
    return first + third + second if form == "psm" else second + third + first


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output of every text."""

    def answer(parts):
        for batch in parts:
            rows = [infilled(t or "", d, seed, rate, suffix_first) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(answer, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows of transform() with restored, the text rebuilt from output and form alone."""
    names = rows.columns
    output, form = names.index("output"), names.index("form")

    def answer(parts):
        for batch in parts:
            back = [rebuilt(o, f) for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*names, "restored"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(answer, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", restored string")


def query(spark, sf_dir: str) -> DataFrame:
    back = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
ship(__name__)
