"""Phrase collocations: n-grams exploded into rows, hash-aggregated per language, joined to the counts of their parts.

Lengths are counted one after another. A phrase is exploded only if both phrases that lack its first or its last word are
frequent, as no other can be a candidate, part of a candidate, or the extension that hides one: the rows left out change
nothing. What is frequent, executors learn from a Bloom filter of at most 2^28 bits (32 MB, whatever the corpus); its false
positives cost rows, which the exact counts then drop. A task counts the phrases of some 16 MB of text before it writes rows
(equal by 128-bit hashes), and Spark sums the rows by language and phrase.

A candidate is then cut after each of its words, both parts get their counts by joins, and each cut its score in Decimal, whole
and exact. Candidates go by an anti-join with their one-word extensions: counts only fall as a phrase grows, so if a longer
phrase hides one, the extensions between them do too. Ranks are taken by language from the best of each of SPREAD parts.

Defined cases. Null or empty text: no words. Null lang: und, together with a language of that name. Null doc_id: counted as any.
Repeated rows: each counted. Very long texts: whole, in blocks of BLOCK bytes that end where a piece does, so that memory follows the longest
piece. Empty table: no rows. Ties of score and count: by phrase, in byte order. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise, mix64, ship, window_hashes, word_bounds, word_hashes, word_table
from .quality import encoded

MAX_N, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bits of the filter for each frequent phrase, and in all; those set for one; bytes of text counted together and of a long text's block; parts of a language; words of the corpus for each task that sums phrases.
BITS, MOST_BITS, PROBES, CHUNK, BLOCK, SPREAD, WORDS = 16, 1 << 28, 3, 16 << 20, 4 << 20, 64, 1 << 20
NO_LANG, STOP = "und", b".,;:!?\x0a\x0b\x0c\x0d"
#: Lower case, a line feed for each character that ends a piece, a space for a tab.
_FOLD = bytes(10 if k in STOP else 32 if k == 9 else k + 32 if 65 <= k <= 90 else k for k in range(256))


def blocks(text: bytes) -> Iterator[bytes]:
    """A text, folded, in runs of whole pieces."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b"\n", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The PROBES places that each hash sets among bits (a power of two)."""
    return [((hashes >> np.uint64(32)) * np.uint64(k) + hashes) & np.uint64(bits - 1) for k in range(PROBES)]


def held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter, an array of 64-bit words, may hold."""
    out = np.ones(len(hashes), bool)
    for place in probes(hashes, 64 * len(words)):
        out &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def tagged(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of phrases, told apart by language."""
    return mix64(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def counted(texts: list[bytes], lang: str, length: int, frequent: np.ndarray | None) -> tuple[list[bytes], list[int]]:
    """The phrases of this length in folded texts, with counts; of several words those only whose parts the filter may hold.
    A phrase may come twice."""
    joined = b"\n".join(texts)
    if length == 1:
        found = Counter(joined.split())
        return list(found), list(found.values())
    a = np.frombuffer(joined, np.uint8)
    starts, ends = word_bounds(a)
    if len(starts) < length:
        return [], []
    words = word_hashes(a, starts, ends)
    alive = held(frequent, tagged(window_hashes(words, length - 1), lang))
    piece = np.searchsorted(np.flatnonzero(a == 10), starts)
    at = np.flatnonzero(alive[:-1] & alive[1:] & (piece[: 1 - length] == piece[length - 1 :]))
    one, two = window_hashes(words, length)[at], window_hashes(word_hashes(a, starts, ends, 1), length, 1)[at]
    order = np.argsort(one)
    new = np.flatnonzero(np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))) if len(at) else at
    first = at[order[new]]
    low, high = starts[first], ends[first + length - 1]
    phrases = [b" ".join(joined[s:e].split()) for s, e in zip(low.tolist(), high.tolist(), strict=True)]
    return phrases, np.diff(np.append(new, len(at))).tolist()


def exploded(docs: DataFrame, length: int, frequent) -> DataFrame:
    """lang, phrase, f: phrases of this length, counted by chunks of text; for single words also each language's sum, its phrase null. frequent: the broadcast filter."""

    def run(parts):
        texts, size = defaultdict(list), 0

        def rows():
            for lang, own in texts.items():
                phrases, counts = counted(own, lang, length, None if frequent is None else frequent.value)
                if length == 1:
                    phrases, counts = [*phrases, None], [*counts, sum(counts)]
                for k in range(0, len(phrases), 1 << 15):
                    found = pa.array(phrases[k : k + (1 << 15)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), found, pa.array(counts[k : k + (1 << 15)], pa.int64())], names=["lang", "phrase", "f"])

        for batch in parts:
            for lang, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                for block in blocks(text):
                    texts[lang].append(block)
                    size += len(block)
                    if size >= CHUNK:
                        yield from rows()
                        texts, size = defaultdict(list), 0
        yield from rows()

    return docs.select(F.coalesce("lang", F.lit(NO_LANG)), "text").where("text <> ''").mapInArrow(run, "lang string, phrase string, f long")


def bloom(phrases: DataFrame, length: int):
    """A broadcast filter of phrases (lang, phrase) of this length, made where they lie: the driver gets its words only."""
    spark, n = phrases.sparkSession, phrases.count()
    bits = min(MOST_BITS, max(64, 1 << (BITS * n - 1).bit_length()))

    def places(parts):
        for batch in parts:
            a, starts, ends, first = word_table(encoded(batch.column(1)))
            hashes = window_hashes(word_hashes(a, starts, ends), length)[first[:-1]]
            langs = batch.column(0).to_pylist()
            own = [tagged(hashes[[x == lang for x in langs]], lang) for lang in set(langs)]
            place = np.concatenate([p for h in own for p in probes(h, bits)]) if own else hashes
            word, value = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
            order = np.argsort(word, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(word[order]) > 0)) if len(word) else np.zeros(0, np.int64)
            joined = np.bitwise_or.reduceat(value[order], head) if len(head) else value
            yield pa.RecordBatch.from_arrays([pa.array(word[order][head].view(np.int64)), pa.array(joined.view(np.int64))], names=["word", "value"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f of every phrase of up to max_n words found least times in its language; phrase is null where f is the number of all the language's words."""
    spark, key = docs.sparkSession, "spark.sql.shuffle.partitions"
    bounded_batches(spark)
    levels, frequent, before = [], None, spark.conf.get(key)
    tasks = int(before)
    for n in range(1, max_n + 1):
        summed = exploded(docs, n, frequent).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        spark.conf.set(key, tasks)
        try:
            levels.append(materialise(summed.where((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", F.lit(n).alias("words"), "phrase", "f"), f"grams{n}"))
        finally:
            spark.conf.set(key, before)
        some = levels[-1].where("phrase is not null")
        if n == max_n or some.isEmpty():
            break
        if n == 1:  # longer phrases are summed by tasks of one size; AQE joins small ones
            tasks = max(tasks, min(20_000, levels[0].where("phrase is null").agg(F.sum("f")).first()[0] // WORDS))
        frequent = bloom(some, n)
    return reduce(DataFrame.union, levels)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words or more, by their lowest-scoring cut. share:
    the per cent of a phrase's count that an extension needs to hide it."""
    counts = phrase_counts(docs, max_n, least)
    totals = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    counts = counts.where("phrase is not null")
    found = counts.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    longer = found.where(F.size("w") >= 3).select("lang", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("inner"), "a")
    hides = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("_most"))
    kept = found.join(hides.withColumnRenamed("lang", "_lang").withColumnRenamed("phrase", "_phrase"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("_most") * 100 >= F.col("a") * share), "left_anti")

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")).cast("decimal(34,0)"), "_low": exact("l") * exact("r")}).withColumn("score", F.expr("_up div _low"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    near = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(k)) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 100),
h AS (SELECT lang, array_to_string(w[s:e], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, k, s, unnest(range(s + 1, k + 1)) AS e FROM (SELECT *, unnest(range(1, k)) AS s FROM c)) WHERE e - s + 1 < k GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN t USING (lang)
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
  LEFT JOIN h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.most IS NULL OR 100 * h.most < 100 * c.a),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
"""
ship(__name__)
