"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]. Its integral, scaled to the source's target, is the
source's cumulative token demand. The source's documents stand in a fixed hashed order; the k-th pass over a document
whose words begin at offset c of that stream is due when cumulative demand reaches c, so the inverse of the demand
curve gives its training position, and a range sort by position lays the corpus out.

The hashed order goes by doc_id and text, so a rerun takes the same texts; it is cut into ranges of equally many rows, also
within one source, doc_id or text, and each range counts on from those before. Sources are sorted in one task, a row for each:
they may number some millions, not more.

Defined cases. Null text: size 0. Null source: a source of its own, last. Null doc_id: a document like any other.
Repeated rows: documents of their own. Empty table: no rows. The boundary document of a source gives its first words
only, so that the source's taken words equal its target to the nearest word. A document of which nothing is taken has no
position. Input columns may have any names: they travel in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise, named, ranged

#: Weights by source in code-point order, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Weight schedules as (time, weight) corners, repeating over the sources: fading, constant, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """The demand curve of a schedule: (t0, weight there, slope, share before, share after) for each segment, shares from 0 to 1."""
    pieces = [(t0, w0, t1, w1, (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False) if t1 > t0]
    total, done, out = sum(p[4] for p in pieces), 0.0, []
    for t0, w0, t1, w1, area in pieces:
        if area > 0:
            out.append((t0, w0 / total, (w1 - w0) / (t1 - t0) / total, done, done + area / total))
            done += area / total
    return out


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source's cumulative demand reaches this share of its target."""
    found = None
    for t0, w0, slope, low, high in reversed(segments(schedule)):
        gone = share - F.lit(low)
        here = F.lit(t0) + (gone / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * gone)) - F.lit(w0)) / F.lit(slope))
        found = here if found is None else F.when(share < F.lit(high), here).otherwise(found)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), found))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """A row for each source (of a table source, source_size): rank, weight, target. Targets are level * weight, stopped at most * size, with the level at which they sum to all sizes."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - (F.sum("cap").over(order) - F.col("cap"))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    levelled = ranked.withColumn("level", level).withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
    return levelled.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))


def _timer(schedule):
    return lambda share: position(share, schedule)


def placements(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, schedules: Sequence = SCHEDULES) -> DataFrame:
    """A row for each document: row (struct of the kept columns), size, source_size, target, taken, passes (whole passes), rest (words of a last, partial pass), positions (one for each pass), first_position."""
    source, heavy = ["name", "unnamed"], "text" in keep
    digest = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = docs.select(
        F.struct(*map(named, keep)).alias("row"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"),
        word_count(F.col("text")).alias("size"), digest.alias("order"), F.monotonically_increasing_id().alias("uid"),
    )
    sized = materialise(sized, "sized")
    laid = ranged(sized.drop("row") if heavy else sized, [*source, "order", "uid"], "laid").drop("order")
    ranges = laid.groupBy(*source, "_part").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy(*source).agg(F.sum("range_size").alias("source_size"))
    found = targets(sizes.select(*source, "source_size", F.when(~F.col("unnamed"), F.col("name")).alias("source")), weights, most)
    found = found.select(*source, "source_size", "target", "rank", F.round("target").cast("bigint").alias("total"))
    before = Window.partitionBy(*source).orderBy("_part")
    ranges = ranges.select(*source, "_part", (F.sum("range_size").over(before) - F.col("range_size")).alias("before")).join(found, source)
    within = Window.partitionBy(*source, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("within", F.sum("size").over(within) - F.col("size")).join(ranges, [*source, "_part"])
    placed = placed.withColumn("offset", F.col("before") + F.col("within"))
    placed = placed.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("total div source_size")).otherwise(0))
    rest = F.col("total") - F.col("passes") * F.col("source_size") - F.col("offset")
    placed = placed.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    starts = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)), lambda k: (k * F.col("source_size") + F.col("offset")) / F.col("total")))
    which = F.col("rank") % len(schedules)
    times = F.coalesce(*[F.when(which == (k + 1) % len(schedules), F.transform(starts, _timer(s))) for k, s in enumerate(schedules)])
    if heavy:
        placed = placed.join(sized.select("uid", "row"), "uid")  # long texts are shuffled here only
    return placed.select("row", "size", "source_size", "target", "taken", "passes", "rest", times.alias("positions"), F.element_at(times, 1).alias("first_position"))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """placements(), range-sorted by first training position."""
    order = F.col("first_position").asc_nulls_last(), F.col("row").getField(keep[0])
    return placements(docs, keep, **options).repartitionByRange(*order).sortWithinPartitions(*order)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, n at least 1."""
    blank = r"[\x20\x09-\x0D]"
    pieces = F.split(text, f"(?<=[^\\x20\\x09-\\x0D])(?={blank})")
    return F.concat_ws("", F.slice(pieces, F.lit(1), n.cast("int")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every pass over every document as a row with the columns of docs, in order of training position; the last, partial pass keeps the first words of its text only."""
    mixed = placements(docs, keep=docs.columns, **options)  # texts are ranged once, by the positions of their passes
    passes = mixed.where("taken > 0").select("row", "passes", "rest", F.posexplode("positions").alias("pass", "position"))
    partial = F.col("pass") >= F.col("passes")
    cut = F.col("row").withField("text", F.when(partial, first_words(F.col("row.text"), F.col("rest"))).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        cut = F.when(partial, cut.withField("n_chars", F.length(cut.getField("text")).cast(docs.schema["n_chars"].dataType))).otherwise(F.col("row"))
    return passes.repartitionByRange("position").sortWithinPartitions("position").select(cut.alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    due = F.concat_ws(",", F.transform("positions", lambda p: F.floor(p * 1e9).cast("string")))
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken", "first_position", due.alias("positions"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS o
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank, (3 * source_size)::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER (ORDER BY cap / w, rank) - cap))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
found AS (
  SELECT source, source_size, rank, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 0) * w) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, f.rank, round(f.target)::BIGINT AS total,
    CASE WHEN f.source_size > 0 THEN round(f.target)::BIGINT // f.source_size ELSE 0 END AS passes,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN found f ON s.source IS NOT DISTINCT FROM f.source),
counted AS (SELECT *, greatest(0, least(size, total - passes * source_size - before)) AS rest FROM placed),
due AS (
  SELECT *, passes * size + rest AS taken,
    CASE WHEN passes * size + rest > 0 THEN [(k * source_size + before) / total::DOUBLE for k in range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)] END AS shares
  FROM counted),
-- the demand curves: weight 1.5 - t, integral 1.5 t - t * t / 2; weight 1; weight 0.5 up to 0.5, then 0.5 + 4 (t - 0.5)
timed AS (
  SELECT *, CASE rank % 3
    WHEN 1 THEN [(sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + -2.0::DOUBLE * s)) - 1.5::DOUBLE) / -1.0::DOUBLE for s in shares]
    WHEN 2 THEN [s / 1.0::DOUBLE for s in shares]
    ELSE [CASE WHEN s < 0.25::DOUBLE THEN s / 0.5::DOUBLE
      ELSE 0.5::DOUBLE + (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 8.0::DOUBLE * (s - 0.25::DOUBLE))) - 0.5::DOUBLE) / 4.0::DOUBLE END for s in shares] END AS raw
  FROM due),
bounded AS (SELECT *, [least(1.0::DOUBLE, greatest(0.0::DOUBLE, p)) for p in raw] AS times FROM timed)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, times[1] AS first_position,
  coalesce(array_to_string([floor(p * 1e9::DOUBLE)::BIGINT for p in times], ','), '') AS positions
FROM bounded
"""
