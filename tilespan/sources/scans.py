"""Scans over many files: discovery by name, rows of chosen reads with files pruned before they are read, wide matrices by their headers, clusterings with sidecars; and a sink that counts what it writes and takes its place only if all holds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import files

#: Buckets that reads are hashed to in an index of files: a file is read for a wanted read only if it holds one of the same bucket.
BUCKETS = 1 << 24


def discover(spark: SparkSession, folder: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """path, length and the named groups of the pattern of every file under folder whose path fits it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").where(F.col("path").rlike(pattern))
    return found.select("path", "length", *files.named_parts(F.col("path"), pattern, list(names)))


def index_reads(spark: SparkSession, found: DataFrame, index: str) -> None:
    """Writes beside discovered BED files which buckets of reads each holds (key, bucket), in order of bucket; key is plain() of its path."""
    paths = [r.path for r in found.select("path").collect()]  # a list of files, which the reader needs anyway
    rows = files.parse_bed(files.numbered_lines(spark, paths)).where("problem is null")
    held = rows.select(plain(F.col("ord.file")).alias("key"), bucket("seq_id").alias("bucket")).distinct()
    held.repartitionByRange("bucket").sortWithinPartitions("bucket").write.parquet(index)


def plain(path: Column) -> Column:
    """A path as both the list of files and the rows read give it, with one slash after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def rows_of(spark: SparkSession, found: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted reads (seq_id) in discovered files, with the columns that discovery gave; seq_id, start, end, feature.

    The index names the files that can hold a wanted read; only these are read. What a shared bucket lets in, a semi join drops.
    """
    asked = wanted.select(bucket("seq_id").alias("bucket")).distinct()
    hits = spark.read.parquet(index).join(asked, "bucket", "left_semi").select("key")
    own = [c for c in found.columns if c not in ("path", "length")]
    chosen = found.withColumn("key", plain(F.col("path"))).join(hits, "key", "left_semi").select("key", "path", *own).collect()  # a list of files
    side = spark.createDataFrame(chosen, "key string, path string" + "".join(f", `{c}` {t}" for c, t in found.dtypes if c in own)).drop("path")
    if not chosen:
        return side.crossJoin(wanted.limit(0).select("seq_id", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("feature"))).select("seq_id", "start", "end", "feature", *own)
    rows = files.parse_bed(files.numbered_lines(spark, sorted(r.path for r in chosen))).where("problem is null").withColumn("key", plain(F.col("ord.file")))
    return rows.join(wanted.select("seq_id").distinct(), "seq_id", "left_semi").join(side, "key").select("seq_id", "start", "end", "feature", *own)


#: The metrics in headers of an annotation matrix.
METRIC = "frac|bp|dmax|dmin|dmedian|dfirst|dlast|dterminal|dterminal_min|max_block_bp|readpct|bppct"
HEADER = rf"^(?P<feature_set>.+?)_{{1,2}}(?P<metric>{METRIC})__(?P<feature>.+)$"


def read_matrix(spark: SparkSession, path: str, key: str = "seq_id", pattern: str = HEADER) -> DataFrame:
    """A wide TSV as a long table: key, feature_set, metric, feature, value of every value but 0 and blanks. Headers give the three
    names by the pattern; other columns are no metrics. A matrix without one is an error, as is a missing key column or a header that stands twice."""
    rows = files.read_table(spark, path, [key])
    named = {c: m for c in rows.columns if (m := re.match(pattern, c))}
    if not named:
        raise ValueError(f"{path} has no column of a metric")
    if len({m.groups() for m in named.values()}) < len(named):
        raise ValueError(f"{path} has two columns of one metric")
    cells = F.array(*[F.struct(*[F.lit(m[g]).alias(g) for g in ("feature_set", "metric", "feature")], F.expr(f"`{c}`").try_cast("double").alias("value")) for c, m in named.items()])
    return rows.select(F.col(key), F.explode(F.filter(cells, lambda x: x["value"] != 0)).alias("_c")).select(key, "_c.*")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """feature_set, feature, threshold; the last row of a label wins. featureset is taken for feature_set."""
    rows = files.read_table(spark, path, ["feature", "threshold"]).withColumn("ord", files.placed())
    if "featureset" in rows.columns:
        rows = rows.withColumnRenamed("featureset", "feature_set")
    return rows.groupBy("feature_set", "feature").agg(F.max_by(F.col("threshold").cast("double"), "ord").alias("threshold"))


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_clustering(spark: SparkSession, assignments: str, suffix: str = ".sequence_assignments.tsv") -> DataFrame:
    """The rows of an assignments table (read or sequence, cluster) with what its sidecars say, where they exist: enrichment of the cluster analysis
    (else unknown) and cluster_name of the annotations (else, and for blanks, (unlabeled)). The last row of a cluster wins."""
    rows = spark.read.csv(assignments, sep="\t", header=True)
    if "read" not in rows.columns and "sequence" in rows.columns:
        rows = rows.withColumnRenamed("sequence", "read")
    for kind, column, missing in ((".cluster_analysis.tsv", "enrichment", "unknown"), (".cluster_annotations.tsv", "cluster_name", "(unlabeled)")):
        path = assignments[: -len(suffix)] + kind if assignments.endswith(suffix) else None
        if path and there(spark, path):
            side = files.read_table(spark, path, ["cluster_id"])
            if column in side.columns:
                last = side.withColumn("ord", files.placed()).groupBy(F.col("cluster_id").alias("cluster")).agg(F.max_by(column, "ord").alias(column))
                rows = rows.join(last, "cluster", "left")
        shown = F.col(column) if column in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(column, F.coalesce(F.when(F.trim(shown) != "", shown), F.lit(missing)))
    return rows


def analysed(stats: DataFrame, most_q: float | None = None, enrichments: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Clusters of an analysis table (cluster_id, q_value, enrichment): those with q_value of most_q at most and one of the enrichments, by enrichment,
    q_value and cluster_id, with place; top keeps the first of each enrichment."""
    kept = stats.withColumn("q_value", F.col("q_value").cast("double"))
    if most_q is not None:
        kept = kept.where(F.col("q_value") <= most_q)
    if enrichments is not None:
        kept = kept.where(F.col("enrichment").isin(*enrichments))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("enrichment").orderBy("q_value", "cluster_id")))
    return kept if top is None else kept.where(F.col("place") <= top)


def write_counted(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None], counts: dict[str, Column], refuse: dict[str, Column] | None = None) -> dict:
    """Writes rows by write(rows, folder) into a folder beside path, counts them on the way, and only then puts the folder in path's place; returns the
    counts. refuse: conditions that no row may meet; if one does, nothing changes at path and a ValueError says how many. write lays nothing
    out anew: a shuffle behind the count could read its input twice, and count it twice."""
    spark, seen = rows.sparkSession, Observation()
    refuse = refuse or {}
    tests = {f"_bad{k}": F.count_if(c) for k, c in enumerate(refuse.values())}
    stage, old = (f"{path}.{w}-{uuid.uuid4().hex}" for w in ("staged", "old"))
    write(rows.observe(seen, *[c.alias(n) for n, c in (counts | tests).items()]), stage)
    found = seen.get
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    system = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    wrong = {name: found[f"_bad{k}"] for k, name in enumerate(refuse) if found[f"_bad{k}"]}
    if wrong:
        system.delete(jvm(stage), True)
        raise ValueError(f"{path} not written: " + ", ".join(f"{n} rows {name}" for name, n in wrong.items()))
    replaced = system.exists(jvm(path)) and system.rename(jvm(path), jvm(old))
    if not system.rename(jvm(stage), jvm(path)):
        if replaced:
            system.rename(jvm(old), jvm(path))
        raise OSError(f"{stage} could not be put in place of {path}")
    if replaced:
        system.delete(jvm(old), True)
    return {n: found[n] for n in counts}


def write_tiling(rows: DataFrame, path: str, compression: str = "none") -> dict:
    """write_counted() of annotation BED: rows, bases and sequences' ends are counted; a gap, an overlap or an empty row refuses the whole."""
    w = Window.partitionBy("seq_id").orderBy("start", "end")
    before = F.lag("end").over(w)
    marked = rows.withColumn("_kind", F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") > before, "gap").when(F.col("start") < before, "overlap")).withColumn("_first", before.isNull())
    counts = {"rows": F.count(F.lit(1)), "bases": F.sum(F.col("end") - F.col("start")), "sequences": F.count_if(F.col("_first"))}
    refuse = {f"with {k}": F.col("_kind") == k for k in ("empty", "gap", "overlap")}
    keys = [c for c in ("seq_ord", "seq_id", "start") if c in rows.columns]
    laid = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return write_counted(laid, path, lambda r, p: r.select(files.bed_line().alias("value")).write.option("compression", compression).text(p), counts, refuse)
