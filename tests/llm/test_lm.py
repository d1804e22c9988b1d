"""Stupid backoff against brute force."""

import math
import re
from collections import Counter

from tilespan.llm import lm

from .cases import frame, row
from .test_common import turned

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, order=3):
    docs = [WORD.findall(r[1] or "") for r in rows]
    grams = [[Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for n in range(1, order + 1)] for d in docs]
    all_ = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    total = sum(map(len, docs))
    out = []
    for r, d, own in zip(rows, docs, grams, strict=True):
        score = 0.0
        for i in range(len(d)):
            longest = min(i + 1, order)
            for n in range(longest, 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                c = all_[n - 1][g] - own[n - 1][g]
                if c > 0:
                    base = total - len(d) if n == 1 else all_[n - 2][g[:-1]] - own[n - 2][g[:-1]]
                    score += math.log(0.4 ** (longest - n) * c / base)
                    break
            else:
                score += math.log(0.4**longest / (total - len(d) + 1))
        out.append((r[0], len(d), round(score, 4)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = frame(spark).repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    for order in (3, 2, 1):
        got = lm.score(docs, order).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 4)) for r in got), key=str) == brute(rows, order)
        assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_empty_and_alone(spark):
    assert lm.score(frame(spark, [])).count() == 0
    got = lm.score(frame(spark, [row(12, "word")])).collect()
    assert got[0].log_score == math.log(0.4)


def test_long_words_that_differ(spark):
    a, b = turned(10)
    got = lm.score(frame(spark, [row(1, a), row(2, b), row(3, "third")])).collect()
    assert {round(r.log_score, 3) for r in got} == {round(math.log(0.4 / 3), 3)}


def test_rows_of_blocks_lie_in_small_row_groups(spark):
    """Writer and reader hold a row group whole; a task writes many blocks of megabytes."""
    import random

    import pyarrow.parquet as pq

    from tilespan.llm.blocks import make_blocks

    draw = random.Random(1)
    rows = [(k, draw.randbytes(1 << 20).hex()) for k in range(30)]
    blocks = make_blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 2 << 20)
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(k) for m in metas for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30
    assert max(g.total_byte_size for g in groups) < 40 << 20  # uncompressed
