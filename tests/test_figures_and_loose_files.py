"""Legend order, group labels, strategies, loose files and four digits."""

import pytest
from pyspark.sql import functions as F

from tilespan.operators import choose, clusters, figures
from tilespan.sources import files


def test_legend_order(spark):
    tree = [("chromosome", "chr1", 3), ("chromosome", "chr10", 1), ("chromosome", "chr2", 2), ("chromosome", "chrX", 4), ("chromosome", "sex", 0), ("region", "arm", 6), ("region", "aSat", 5), ("repeat", "arm", 7), ("repeat", "LINE", 8)]
    used = ["chr10", "chr2", "chr1:aSat", "chrX", "sex", "arm", "LINE", "novel", "odd", "chr2", "categorized"]
    got = figures.legend_order(spark.createDataFrame([(x,) for x in used], "feature string"), spark.createDataFrame(tree, "feature_set string, child string, ord int"))
    assert [r.feature for r in got.orderBy("place").collect()] == ["chr2", "chr10", "chrX", "sex", "chr1:aSat", "arm", "LINE", "categorized", "odd", "novel"]


def test_labels_of_groups(spark):
    rows = spark.createDataFrame([("r1", "s", "A", "x", 1), ("r2", "s", "B", None, 2), ("r3", "t", "A", "y", 3), ("r4", "t", None, None, 4)], "read_id string, sample string, `group` string, subgroup string, ord int")
    parts = figures.grouping(rows.where("`group` is not null"), "group", "subgroup")
    got = {r.read_id: (r.label, r.boundary) for r in figures.relabelled(rows, parts).collect()}
    assert got == {"r1": ("A — x", False), "r3": ("A — y", True), "r2": ("B", False), "r4": ("t", False)}
    assert figures.column_specs(["a", "b:Shown", "c:"]) == [("a", "a"), ("b", "Shown"), ("c", "c")]


def test_strategies(spark):
    rows = [("c", "best", 17000, 0.5, 0.9), ("c", "long", 30000, 1.0, 0.1), ("c", "next", 12000, 1.0, 0.2), ("c", "short", 500, 0.1, 0.3), ("c", "bare", 16500, 0.0, 0.4), ("d", "p", 9, 0.0, 0.2), ("d", "q", 8, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "cluster_id string, read_id string, read_length long, share double, centroid_distance double").withColumn("feature_score", F.col("share")).withColumn("sample", F.lit("s"))
    chosen = lambda how: [(r.cluster_id, r.read_id) for r in choose.by_strategy(df, 2, how).orderBy("cluster_id", "rank").collect()]
    assert chosen("feature-match") == [("c", "best"), ("c", "next"), ("d", "q")]
    assert chosen("longest") == [("c", "long"), ("c", "best"), ("d", "p"), ("d", "q")]
    assert chosen("centroid") == [("c", "long"), ("c", "next"), ("d", "q"), ("d", "p")]
    assert chosen("by-sample") == chosen("centroid") and chosen("balanced")[0] == ("c", "long")
    with pytest.raises(ValueError):
        choose.by_strategy(df, 2, "other")


def test_loose_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("r1\t0\t5\tx\tchr1\nr1\t9\t4\ty\nshort\t1\nr2\tz\t4\tx\n\n# no row\n")
    rows, told = files.read_loose(spark, f"{tmp_path}/a.bed")
    assert sorted((r.seq_id, r.start, r.chromosome, r.length) for r in rows.collect()) == [("r1", 0, "chr1", 5), ("r1", 9, None, -5)]
    assert [(r["rows"], r.malformed) for r in told.collect()] == [(2, 2)]
    (tmp_path / "names").write_text("r1\tone\nr2\ttwo\n\n")
    assert sorted(map(tuple, files.read_names(spark, f"{tmp_path}/names").collect())) == [("r1", "one"), ("r2", "two")]
    (tmp_path / "twice").write_text("r1\tone\nr2\ttwo\nr1\tone\n")
    with pytest.raises(ValueError, match="r1"):
        files.read_names(spark, f"{tmp_path}/twice")


def test_four_digits(spark, tmp_path):
    values = [0.0, 1.0, 0.123456, 12345.678, 1e-7, -3.5, float("-inf"), None, 0.00012344]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(files.four_digits(F.col("v"))).collect()]
    assert got == ["0", "1", "0.1235", "1.235e+04", "1e-07", "-3.5", "-inf", None, "0.0001234"]
    (tmp_path / "e.tsv").write_text("cluster_id\tn_total\tn_a\tfrac_a\tlog2fc_a\ttop_group\nc1\t3\t2\t0.6667\t-inf\ta\nc2\t1\t0\t0\todd\tb\n")
    assert [tuple(r) for r in files.read_enrichment(spark, f"{tmp_path}/e.tsv").orderBy("cluster_id").collect()] == [("c1", 3, 2, 0.6667, float("-inf"), "a"), ("c2", 1, 0, 0.0, float("-inf"), "b")]


def test_shares_of_top_labels_are_rounded_as_printf_does(spark):
    """Halves that are exact go to even; those that only look like halves in decimal go where their binary value lies."""
    rows = spark.createDataFrame([(f"s{k}", f, bp) for k, n in enumerate((5, 15, 7, 245)) for f, bp in (("a", n), ("b", 2000 - n))], "seq_id string, feature string, bp long")
    got = {r.seq_id: r.top for r in clusters.top_labels(rows, ["seq_id"]).collect()}
    for k, n in enumerate((5, 15, 7, 245)):
        assert got[f"s{k}"] == "b(%.1f%%), a(%.1f%%)" % (100 * (2000 - n) / 2000, 100 * n / 2000)


def test_major_chromosomes_without_a_list_take_every_first_layer(spark):
    rows = spark.createDataFrame([("c", 0, 60, "error:x"), ("c", 60, 100, "view:y")], "cluster_id string, start long, end long, feature string")
    assert [r.chromosomes for r in figures.major_chromosomes(rows, least=0.2).collect()] == ["error+view"]
    assert [r.chromosomes for r in figures.major_chromosomes(rows, ["view"], 0.2).collect()] == ["view"]


def test_tasks_follow_the_rows_dealt(spark):
    from tilespan.operators.storage import dealt

    rows = spark.range(100).withColumnRenamed("id", "k")
    assert dealt(rows, "k", each=5).rdd.getNumPartitions() == 20
    assert dealt(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_structures_of_one_group_meet_in_parts(spark):
    from tilespan.operators import legacy

    names = [f"{'ab' * (k % 3)}{k}" for k in range(12)]
    found = spark.createDataFrame([("g", n) for n in names] + [("h", "x"), ("h", "y"), ("i", "z")], "grp string, structure string")
    want = {("g", a, b) for a in names for b in names if a < b} | {("h", "x", "y")}
    for block in (3, 256):
        got = legacy.structure_distances(found, "grp", block).collect()
        assert len(got) == len(want) and {(r.grp, r.a, r.b) for r in got} == want
    assert {(r.a, r.b): r.distance for r in got}["x", "y"] == 1


def test_edit_distances_of_many_pairs(spark):
    """Texts of none, one and several words of 64 places, and code points beyond 16 bits."""
    import random

    import numpy as np

    from tilespan.operators import legacy

    r = random.Random(1)
    for letters, top in (("ABCDE", 12), ("AB\U0001f600é", 9), ("ABC", 200)):
        texts = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, top))) for _ in range(16)} | {"", "A" * 64, "B" * 65})
        pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
        want = spark.createDataFrame([(texts[i], texts[j]) for i, j in pairs], "a string, b string").selectExpr("levenshtein(a, b)").collect()
        for batch in (7, 8192):
            assert legacy.edit_distances(texts, *np.array(pairs).T, batch).tolist() == [x[0] for x in want]
