"""Pruned scans, matrices by headers, clusterings with sidecars, and the sink that takes its place only if all holds."""

import random

import pytest
from pyspark.sql import functions as F

from tilespan.operators import measures
from tilespan.sources import files, scans

BED = "seq_id string, start long, end long, feature string"


def reads(n=200):
    r = random.Random(1)
    return [(f"r{k:04}", 10 * j, 10 * j + 10, r.choice("abc")) for k in range(n) for j in range(r.randint(1, 5))]


def stored(spark, tmp_path, rows):
    for name in ("one", "two"):
        spark.createDataFrame(rows, BED).repartitionByRange(8, "seq_id").select(files.bed_line().alias("value")).write.text(f"{tmp_path}/s.{name}.beds")
    found = scans.discover(spark, str(tmp_path), r"/([a-z]+)\.([a-z]+)\.beds/part-", ["sample", "featureset"])
    scans.index_reads(spark, found, f"{tmp_path}/index")
    return found


def test_only_files_that_hold_the_reads_are_read(spark, tmp_path):
    rows = reads()
    found = stored(spark, tmp_path, rows)
    assert found.count() == 16 and {(x["sample"], x.featureset) for x in found.collect()} == {("s", "one"), ("s", "two")}
    wanted = spark.createDataFrame([("r0003",), ("r0004",), ("r0150",), ("none",), ("r0003",)], "seq_id string")
    got = scans.rows_of(spark, found, f"{tmp_path}/index", wanted)
    want = sorted((*x, fs) for x in rows if x[0] in ("r0003", "r0004", "r0150") for fs in ("one", "two"))
    assert sorted((x.seq_id, x.start, x.end, x.feature, x.featureset) for x in got.collect()) == want
    read = [f for f in got.inputFiles() if ".beds/" in f]
    assert 2 <= len(set(read)) <= 4  # two ranges of each featureset at most
    assert scans.rows_of(spark, found, f"{tmp_path}/index", wanted.where("seq_id = 'none'")).count() == 0


def test_shared_buckets_drop_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "BUCKETS", 2)
    rows = reads(30)
    found = stored(spark, tmp_path, rows)
    got = scans.rows_of(spark, found, f"{tmp_path}/index", spark.createDataFrame([("r0007",)], "seq_id string"))
    assert sorted((x.seq_id, x.start) for x in got.collect()) == sorted((x[0], x[1]) for x in rows if x[0] == "r0007" for _ in range(2))


def test_matrix_by_headers(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "a_b__frac__x:y", 0.5), ("u1", "a_b__dterminal_min__z", 0.25), ("u2", "a_b__frac__x:y", 0.0), ("u2", "q__bp__x", 7.0)], "seq_id string, name string, value double")
    files.write_tsv(measures.wide_matrix(rows).withColumn("note", F.lit("n")), f"{tmp_path}/m")
    got = sorted(tuple(x) for x in scans.read_matrix(spark, f"{tmp_path}/m").collect())
    assert got == [("u1", "a_b", "dterminal_min", "z", 0.25), ("u1", "a_b", "frac", "x:y", 0.5), ("u2", "q", "bp", "x", 7.0)]
    (tmp_path / "old.tsv").write_text("sequence\tregion_frac__arm\tregion_max_block_bp__a_b\tlen\nr1\t0.5\t\t9\nr2\tx\t12\t9\n")
    assert sorted(tuple(x) for x in scans.read_matrix(spark, f"{tmp_path}/old.tsv", "sequence").collect()) == [("r1", "region", "frac", "arm", 0.5), ("r2", "region", "max_block_bp", "a_b", 12.0)]
    (tmp_path / "none.tsv").write_text("sequence\tlen\nr1\t9\n")
    (tmp_path / "twice.tsv").write_text("sequence\tq_bp__a\tq__bp__a\nr1\t9\t9\n")
    for name in ("none", "twice"):
        with pytest.raises(ValueError):
            scans.read_matrix(spark, f"{tmp_path}/{name}.tsv", "sequence")


def test_metrics_and_matrix_take_tasks_by_their_rows(spark, monkeypatch):
    """AQE would join small partitions of bytes; densities, metrics and the matrix name their tasks instead, and give the same values."""
    from tilespan.operators import storage

    long = spark.createDataFrame([("x", *r) for r in reads(40)], f"feature_set string, {BED}")
    values = lambda df: sorted(tuple(r) for r in df.collect())
    plain = values(measures.long_metrics(long, 20)), values(measures.wide_matrix(measures.long_metrics(long, 20)))
    monkeypatch.setattr(storage, "EACH", 10)
    n = -(-long.count() // 10)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        assert measures.window_densities(long, 20, ["feature_set", "seq_id"]).rdd.getNumPartitions() % n == 0
        metrics = measures.long_metrics(long, 20)
        assert metrics.rdd.getNumPartitions() % n == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = measures.wide_matrix(metrics)
    assert wide.rdd.getNumPartitions() == -(-metrics.count() // 10)
    assert (values(metrics), values(wide)) == plain


def test_clusterings_with_and_without_sidecars(spark, tmp_path):
    (tmp_path / "x.sequence_assignments.tsv").write_text("sequence\tcluster\nr1\t1\nr2\t2\nr3\t3\n")
    path = f"{tmp_path}/x.sequence_assignments.tsv"
    assert {(x.read, x.enrichment, x.cluster_name) for x in scans.read_clustering(spark, path).collect()} == {(r, "unknown", "(unlabeled)") for r in ("r1", "r2", "r3")}
    (tmp_path / "x.cluster_analysis.tsv").write_text("cluster_id\tenrichment\n1\tALT\n1\tTEL\n2\tALT\n")
    (tmp_path / "x.cluster_annotations.tsv").write_text("cluster_id\tcluster_name\n1\tECTR\n2\t\n")
    got = {(x.read, x.enrichment, x.cluster_name) for x in scans.read_clustering(spark, path).collect()}
    assert got == {("r1", "TEL", "ECTR"), ("r2", "ALT", "(unlabeled)"), ("r3", "unknown", "(unlabeled)")}


def test_analysed(spark):
    rows = spark.createDataFrame([("1", "0.1", "a"), ("2", "0.01", "a"), ("3", "0.01", "b"), ("4", "0.5", "a"), ("5", "0.001", "c"), ("6", None, "a")], "cluster_id string, q_value string, enrichment string")
    assert sorted((x.cluster_id, x.place) for x in scans.analysed(rows, 0.2, ["a", "b"], 1).collect()) == [("2", 1), ("3", 1)]
    assert scans.analysed(rows).count() == 6


def test_a_refused_write_changes_nothing(spark, tmp_path):
    good = spark.createDataFrame([("q", 0, 5, "a"), ("q", 5, 9, "b"), ("p", 3, 4, "a")], BED)
    path = f"{tmp_path}/out.bed"
    assert scans.write_tiling(good, path) == {"rows": 3, "bases": 10, "sequences": 2}
    before = sorted(r.value for r in spark.read.text(path).collect())
    for bad in ([("q", 6, 9, "gap")], [("q", 4, 9, "overlap")], [("z", 4, 4, "empty")]):
        with pytest.raises(ValueError, match="not written"):
            scans.write_tiling(spark.createDataFrame([("q", 0, 5, "a"), *bad], BED), path)
        assert sorted(r.value for r in spark.read.text(path).collect()) == before
    assert scans.write_tiling(good.limit(0), path)["rows"] == 0 and spark.read.text(path).count() == 0
    assert [p.name for p in tmp_path.iterdir() if "staged" in p.name or ".old" in p.name] == []


def test_thresholds(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("featureset\tfeature\tthreshold\nr\ta\t0.1\nr\ta\t0.2\ns\ta\t0.3\n")
    assert {(x.feature_set, x.feature): x.threshold for x in scans.read_thresholds(spark, f"{tmp_path}/t.tsv").collect()} == {("r", "a"): 0.2, ("s", "a"): 0.3}
