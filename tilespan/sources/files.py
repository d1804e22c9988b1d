"""File sources and sinks: annotation BED, hierarchy, palette, weights and cluster tables, read lists and markers.

BED is read as text, so that longer rows are legal and errors carry line numbers; order is kept in an explicit column. Writers
give one folder that appears only when the job commits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.storage import tasks


def placed() -> Column:
    """A row's place: files by name, then the split of the file, then the row. Readers take files by size, so row numbers alone follow no order."""
    return F.struct(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("split"), F.monotonically_increasing_id().alias("row"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line (its text), ord (its place)."""
    return spark.read.text(path).select(F.col("value").alias("line"), placed().alias("ord"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """Rows of annotation BED with a problem column: null, fields (under four), coordinate (no integer) or empty (end <= start). Blank lines and comments go."""
    kept = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    f = F.split("line", "\t")
    start, end = F.get(f, F.lit(1)).try_cast("bigint"), F.get(f, F.lit(2)).try_cast("bigint")
    problem = F.when(F.size(f) < 4, "fields").when(start.isNull() | end.isNull(), "coordinate").when(end <= start, "empty")
    return kept.select(F.get(f, F.lit(0)).alias("seq_id"), start.alias("start"), end.alias("end"), F.get(f, F.lit(3)).alias("feature"), "ord", problem.alias("problem"))


#: Lines of a split that a piece takes at most, as a power of two.
PIECE_BITS = 16


def runs_of(rows: DataFrame, n: int | None = None) -> DataFrame:
    """seq_id, part, first, last, head, tail: unbroken runs of one sequence in the order of ord within each piece of a split of a file,
    and whether a run opens or closes its piece. Pieces are ranked without gaps, and dealt to n tasks, so that no task holds a large split."""
    placed = rows.select("seq_id", "ord", F.struct("ord.file", "ord.split", F.shiftright("ord.row", PIECE_BITS).alias("piece")).alias("_p")).repartition(n or tasks(rows), "_p")
    w = Window.partitionBy("_p").orderBy("ord")
    marked = placed.withColumn("_new", F.when(F.lag("seq_id").over(w) == F.col("seq_id"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("_p", "_run", "seq_id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    every = Window.partitionBy("_p")
    found = found.withColumn("head", F.col("first") == F.min("first").over(every)).withColumn("tail", F.col("last") == F.max("last").over(every))
    ranks = placed.select("_p").distinct().withColumn("part", F.row_number().over(Window.orderBy("_p")))  # one row a piece
    return found.join(ranks, "_p").select("seq_id", "part", "first", "last", "head", "tail")


def tiling_problems(rows: DataFrame) -> DataFrame:
    """Every breach of the tiling rule: scattered (a sequence's rows are not together), gap, overlap, or a row's own problem.

    No window spans the whole file: runs are found piece by piece, and a sequence is together if each of its runs
    opens the piece after the one that its run before closed. Rows, and before a torn one a mark, are dealt by sequence to tasks of
    so many rows, as places take far more memory than bytes of a shuffle tell. Counts rows first.
    """
    n, by_seq = tasks(rows), Window.partitionBy("seq_id").orderBy("first")
    back = lambda c: F.lag(c).over(by_seq)
    joined = F.col("head") & back("tail") & (F.col("part") == back("part") + 1)
    torn = runs_of(rows, n).withColumn("_torn", back("part").isNotNull() & ~F.coalesce(joined, F.lit(False))).where("_torn").select("seq_id", F.col("first").alias("ord"), F.lit(True).alias("_mark"))
    marked = rows.withColumn("_mark", F.lit(False)).unionByName(torn, allowMissingColumns=True).repartition(n, "seq_id")
    w = Window.partitionBy("seq_id").orderBy("ord", F.desc("_mark"))
    checked = marked.withColumn("_torn", F.coalesce(F.lag("_mark").over(w), F.lit(False))).withColumn("_before", F.when(F.col("_torn"), F.lag("end", 2).over(w)).otherwise(F.lag("end").over(w))).where("not _mark")
    kind = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_torn"), "scattered").when(F.col("start") > F.col("_before"), "gap").when(F.col("start") < F.col("_before"), "overlap")
    return checked.withColumn("kind", kind).where("kind is not null").select("seq_id", "start", "end", "feature", "ord", "kind")


def broken_tiles(rows: DataFrame) -> DataFrame:
    """Gaps, overlaps and empty rows of a table that has no file order: each sequence by start, one pass by sequence."""
    w = Window.partitionBy("seq_id").orderBy("start", "end")
    before = F.lag("end").over(w)
    kind = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") > before, "gap").when(F.col("start") < before, "overlap")
    return rows.withColumn("kind", kind).where("kind is not null")


def read_bed(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """seq_id, start, end, feature, ord; with validate the job fails on the first breach."""
    rows = parse_bed(numbered_lines(spark, path))
    if validate:
        wrong = tiling_problems(rows).orderBy("ord").limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0].kind} at row {wrong[0].ord.row} of {wrong[0].ord.file}: {wrong[0].seq_id} {wrong[0].start} {wrong[0].end}")
    return rows.where("problem is null").drop("problem")


def read_samples(spark: SparkSession, specs: list[str]) -> DataFrame:
    """SAMPLE:PATH files in one table with a sample column; without a sample, the file's stem names it. No tiling check."""
    out = None
    for spec in specs:
        name, _, path = spec.partition(":") if ":" in spec and not spec.startswith("/") else ("", "", spec)
        name = name or path.rsplit("/", 1)[-1].split(".")[0]
        rows = parse_bed(numbered_lines(spark, path)).where("problem is null").withColumn("sample", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def pool(rows: DataFrame, separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """Samples in one table with namespaced sequence ids, and the list of reads with their samples."""
    named = rows.withColumn("seq_id", F.concat_ws(separator, "sample", "seq_id"))
    return named, named.select(F.col("seq_id").alias("read_id"), "sample").distinct()


def read_table(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A TSV with header; a missing column is an error."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    rows = read_table(spark, path, ["feature_set", "child", "parent"]).select("feature_set", "child", "parent")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no edges")
    return rows


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ["feature_set", "feature", "color"]).withColumn("ord", placed())


def collapse_palette(palette: DataFrame) -> DataFrame:
    """One colour a feature: that of the last row."""
    return palette.groupBy("feature").agg(F.max_by("color", "ord").alias("color"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """The largest weight of every feature name over the featuresets."""
    return read_table(spark, path, ["feature_set", "feature", "weight"]).groupBy("feature").agg(F.max(F.col("weight").cast("double")).alias("weight"))


def last_assignment(rows: DataFrame) -> DataFrame:
    """read_id and cluster_id of a layout table, its last row winning."""
    return rows.groupBy("read_id").agg(F.max_by("cluster_id", "ord").alias("cluster_id"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return last_assignment(read_table(spark, path, ["read_id", "cluster_id"]).withColumn("ord", placed()))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ["cluster_id", "size", "width"]).select("cluster_id", F.col("size").cast("bigint"), F.col("width").cast("bigint"))


def read_consensus(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ["cluster_id", "start", "end", "feature"]).select("cluster_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "feature")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of reads with metadata. A first field read, read_id or sequence makes the first line a header; else columns are read_id, c1, c2 ... Empty values are null."""
    head = spark.read.text(path).first()
    names = (head[0] if head else "read_id").split("\t")
    headed = names[0].lower() in ("read", "read_id", "sequence")
    rows = spark.read.csv(path, sep="\t", header=headed, emptyValue="", nullValue="")
    return rows.toDF(*(["read_id"] + (names[1:] if headed else [f"c{k}" for k in range(1, len(rows.columns))])))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """read_id, start, end of a headerless or headed file; rows without integers go."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(f, F.lit(0)).alias("read_id"), F.get(f, F.lit(1)).try_cast("int").alias("start"), F.get(f, F.lit(2)).try_cast("int").alias("end"))
    return rows.where("start is not null and end is not null")


def group_map(rows: DataFrame, column: str) -> DataFrame:
    """read_id and group of a read list, blanks dropped, the last row winning."""
    return rows.where(F.trim(F.col(column)) != "").groupBy("read_id").agg(F.max_by(F.col(column), "ord").alias("group"))


def named_parts(file: Column, pattern: str, names: list[str]) -> list[Column]:
    """Columns from the groups of a file-name pattern (featureset, sample, partition keys)."""
    return [F.regexp_extract(file, pattern, k + 1).alias(n) for k, n in enumerate(names)]


def bed_line() -> Column:
    return F.concat_ws("\t", "seq_id", "start", "end", "feature")


def write_bed(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Annotation BED, in order of sequence place and start."""
    keys = [c for c in ("seq_ord", "seq_id", "start") if c in rows.columns]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(bed_line().alias("value")).write.option("compression", compression).text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """TSV with header; doubles in their shortest form, infinite effects as inf and -inf."""
    shown = [F.when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise(F.col(c).cast("string")).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]
    rows.select(*shown).write.csv(path, sep="\t", header=True, emptyValue="")


def four_digits(value: Column) -> Column:
    """A number with four significant digits, in the shorter of the plain and the exponent form; -inf as such."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else "-inf" if v == float("-inf") else f"{v:.4g}")

    return shown(value.cast("double"))


def write_enrichment(rows: DataFrame, path: str) -> None:
    """Wide enrichment as TSV: shares and effects with four digits, others as they are."""
    write_tsv(rows.select(*[four_digits(F.col(f"`{c}`")).alias(c) if c.startswith(("frac_", "log2fc_")) else F.col(f"`{c}`") for c in rows.columns]), path)


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Wide enrichment read back; an effect that is no number is -inf."""
    rows = read_table(spark, path, ["cluster_id", "n_total"])
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(float("-inf"))) if c.startswith("log2fc_") else F.col(f"`{c}`").try_cast("double") if c.startswith("frac_") else F.col(f"`{c}`").cast("bigint") if c.startswith("n_") else F.col(f"`{c}`")
    return rows.select(*[number(c).alias(c) for c in rows.columns])


def read_loose(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (seq_id, start, end, feature, chromosome where a fifth field stands, length) of BED without any check between them, and by file the rows kept and the
    malformed lines (fields, coordinates) that were left out. Empty rows are kept, blank lines and comments are neither."""
    lines = numbered_lines(spark, path)
    rows = parse_bed(lines).join(lines.select("ord", F.get(F.split("line", "\t"), F.lit(4)).alias("chromosome")), "ord").withColumn("malformed", F.coalesce(F.col("problem").isin("fields", "coordinate"), F.lit(False)))
    told = rows.groupBy(F.col("ord.file").alias("file")).agg(F.count_if(~F.col("malformed")).alias("rows"), F.count_if("malformed").alias("malformed"))
    return rows.where("not malformed").select("seq_id", "start", "end", "feature", "chromosome", (F.col("end") - F.col("start")).alias("length")), told


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """read_id, approach of a headerless list of two fields; a read that stands twice is an error that names some."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(f, F.lit(0)).alias("read_id"), F.get(f, F.lit(1)).alias("approach"))
    if twice := [r.read_id for r in rows.groupBy("read_id").count().where("count > 1").orderBy("read_id").limit(5).collect()]:
        raise ValueError(f"{path} names reads twice: {', '.join(twice)}")
    return rows
