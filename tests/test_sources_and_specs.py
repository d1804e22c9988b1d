"""Files, checks, resolution specs, statistics, streaming and the command line."""

import math
import random

import numpy as np
import pytest

import __spark_entry__
from tilespan import cli
from tilespan.functions import hierarchy as H
from tilespan.functions import resolve as R
from tilespan.operators import colocalization, legacy
from tilespan.operators.overlay import checked_overlay
from tilespan.sources import files
from tilespan.streaming import sequences

BED = "seq_id string, start long, end long, feature string"


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("text, kind", [("a\t0\t5\n", "fields"), ("a\tx\t5\tf\n", "coordinate"), ("a\t5\t5\tf\n", "empty"), ("a\t0\t5\tf\na\t6\t9\tf\n", "gap"), ("a\t0\t5\tf\na\t4\t9\tf\n", "overlap"), ("a\t0\t5\tf\nb\t0\t5\tf\na\t5\t9\tf\n", "scattered")])
def test_bad_bed(spark, tmp_path, text, kind):
    with pytest.raises(ValueError, match=kind):
        files.read_bed(spark, write(tmp_path / "x.bed", text))


def test_good_bed_round_trip(spark, tmp_path):
    rows = files.read_bed(spark, write(tmp_path / "x.bed", "# c\n\nr/1\t3\t5\tf\textra\nr/1\t5\t9\tg\nq\t0\t1\tf\n"))
    assert [tuple(r)[:4] for r in rows.orderBy("ord").collect()] == [("r/1", 3, 5, "f"), ("r/1", 5, 9, "g"), ("q", 0, 1, "f")]
    files.write_bed(rows.drop("ord"), str(tmp_path / "out"), "gzip")
    assert files.read_bed(spark, str(tmp_path / "out"), validate=False).count() == 3


def test_runs_over_splits(spark):
    """A sequence may go on over the edge of a split or a file, also past empty ones, but not come back after another."""
    rows = [("a", 0, 1, ("p0", 0, 7)), ("b", 0, 1, ("p0", 0, 8)), ("b", 1, 2, ("p0", 64, 2)), ("b", 2, 3, ("p2", 0, 1)), ("c", 0, 1, ("p2", 0, 2)), ("d", 0, 1, ("p3", 0, 0)), ("c", 1, 2, ("p4", 0, 0))]
    df = spark.createDataFrame([(q, s, e, "f", o, None) for q, s, e, o in rows], "seq_id string, start long, end long, feature string, ord struct<file:string,split:long,row:long>, problem string")
    assert [(r.seq_id, r.ord.file, r.kind) for r in files.tiling_problems(df).collect()] == [("c", "p4", "scattered")]


def test_a_tiling_check_takes_tasks_and_pieces_by_its_rows(spark, monkeypatch):
    """Sequences of 3, 5 and 7 lines over the edges of pieces of 8, one of them torn, one with a gap; the tasks are as many as the rows ask for."""
    from tilespan.operators import storage

    monkeypatch.setattr(storage, "EACH", 5)
    monkeypatch.setattr(files, "PIECE_BITS", 3)
    names = [n for k in range(8) for n in [f"a{k}"] * 3 + [f"b{k}"] * 5 + [f"c{k}"] * 7]
    at, rows = {}, []
    for k, n in enumerate([*names, "b2", "b2", "c7"]):
        j = at[n] = at.get(n, -1) + 1
        rows.append((n, 10 * j + (n == "a5" and j == 1), 10 * j + 10, "f", ("p", 0, k), None))
    df = spark.createDataFrame(rows, "seq_id string, start long, end long, feature string, ord struct<file:string,split:long,row:long>, problem string")
    got = files.tiling_problems(df)
    assert got.rdd.getNumPartitions() == -(-len(rows) // 5)
    assert sorted((r.seq_id, r.ord.row, r.kind) for r in got.collect()) == [("a5", names.index("a5") + 1, "gap"), ("b2", 120, "scattered"), ("c7", 122, "scattered")]
    assert files.runs_of(df).select("part").distinct().count() == -(-len(rows) // 8)


def test_tables(spark, tmp_path):
    palette = files.read_palette(spark, write(tmp_path / "c.tsv", "feature_set\tfeature\tcolor\na\tx\t#1\nb\tx\t#2\n"))
    assert files.collapse_palette(palette).first().color == "#2"
    listed = files.read_list(spark, write(tmp_path / "r.tsv", "read_id\tsample\nx\ts1\ny\t\n"))
    assert [tuple(r) for r in listed.orderBy("read_id").collect()] == [("x", "s1"), ("y", None)]
    assert files.read_list(spark, write(tmp_path / "n.tsv", "x\ts1\n")).columns == ["read_id", "c1"]
    assert files.read_markers(spark, write(tmp_path / "m.tsv", "read\tstart\tend\nx\t1\t2\n")).count() == 1
    with pytest.raises(ValueError):
        files.read_hierarchy(spark, write(tmp_path / "h.tsv", "feature_set\tchild\n"))


SPEC = {"precedence": ["p", "q"], "rules": [{"when": {"p": ["x"], "q": "@k"}, "emit": "composite"}, {"when": {"q": ["z"]}, "emit": {"literal": "L"}}, {"when": {"p": ["y"]}, "emit": {"composite": "all", "sep": ":"}}]}


def test_resolution(spark):
    spec = R.load(SPEC, {("q", "k"): {"u", "v"}, ("q", "z"): {"z"}, ("p", "x"): {"x"}, ("p", "y"): {"y"}})
    rows = spark.createDataFrame([("x", "u"), ("x", "w"), ("m", "z"), ("y", "w"), ("y", "z")], "p string, q string")
    assert [r[0] for r in rows.select(spec.column()).collect()] == ["x_u", "x", "L", "y:w", "L"]
    everything = R.load({"precedence": ["p", "q"], "rules": [{"emit": "q"}]})
    assert [r[0] for r in rows.select(everything.column()).collect()] == ["u", "w", "z", "w", "z"]


@pytest.mark.parametrize("bad", [{"precedence": []}, {"precedence": ["p", "p"]}, {"precedence": ["p"], "rules": [{"when": {"r": ["x"]}, "emit": "p"}]}, {"precedence": ["p", "q"], "rules": [{"when": {"q": ["x"], "p": ["y"]}, "emit": "p"}]}, {"precedence": ["p"], "rules": [{"emit": "z"}]}, {"precedence": ["p"], "rules": [{"when": {"p": "@none"}, "emit": "p"}]}])
def test_bad_specs(bad):
    with pytest.raises(R.SpecError):
        R.load(bad)


def test_separators(spark):
    """Composites that name no separator."""
    rows = spark.createDataFrame([("x", "u")], "p string, q string")
    one = lambda emit, when=None: rows.select(R.load({"precedence": ["p", "q"], "rules": [{"when": when or {}, "emit": emit}]}).column()).first()[0]
    assert (one({"composite": "all"}), one({"composite": ["q", "p"]}), one({"composite": "all", "sep": "+"})) == ("x:u", "u:x", "x+u")
    assert one("composite", {"p": ["x"], "q": ["u"]}) == one({"composite": "when"}, {"p": ["x"], "q": ["u"]}) == "x_u"


def test_specs_are_held_against_the_trees(tmp_path):
    classes = {("p", "x"): {"x"}, ("q", "k"): {"k", "u"}, ("q", "u"): {"u"}}
    good = {"name": "n", "precedence": ["p", "q"], "rules": [{"when": {"p": "x", "q": ["u", "@k"]}, "emit": "q"}]}
    assert R.load(good, classes).rules[0].when["q"] == {"k", "u"}
    for bad in ({**good, "extra": 1}, {**good, "precedence": ["p", "z"]}, {**good, "rules": [{"when": {"p": "misspelt"}, "emit": "p"}]}, {**good, "rules": [{"emit": {"composite": "all", "other": 1}}]}, {**good, "rules": [{"emit": {"sep": ":"}}]}, {**good, "rules": [{"emit": "composite"}]}, []):
        with pytest.raises(R.SpecError):
            R.load(bad, classes)
    path = tmp_path / "spec.yaml"
    path.write_text("precedence: [p]\n")
    with pytest.raises(R.SpecError):
        R.load_yaml(str(path))


def test_closure_of_long_chains_and_cycles(spark):
    for n in (41, 200):
        edges = spark.createDataFrame([("r", f"n{k}", f"n{k + 1}") for k in range(n - 1)], "feature_set string, child string, parent string")
        closed = H.closure(edges)
        assert closed.count() == n * (n + 1) // 2 and H.depths(closed).agg({"depth": "max"}).first()[0] == n - 1
    for cycle in ([("r", "a", "b"), ("r", "b", "a")], [("r", "a", "a")], [("r", "x", "a"), ("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a")]):
        with pytest.raises(ValueError, match="cycle"):
            H.closure(spark.createDataFrame(cycle, "feature_set string, child string, parent string"))


def test_genome_roles_without_optional_nodes(spark):
    nodes = [("region", "ct", "centromeric"), ("region", "centromeric", "top"), ("region", "arm", "top"), ("subtelomeric", "ITS", "telomere_like"), ("subtelomeric", "TAR1", "telomere_like"), ("subtelomeric", "canonical_telomere", "top"), ("subtelomeric", "noncanonical_telomere", "telomere_like"), ("chromosome", "chr1", "autosome")]
    roles = H.Roles(spark.createDataFrame(nodes, "feature_set string, child string, parent string"), H.GENOME_ROLES, H.GENOME_MINUS, H.GENOME_OPTIONAL)
    assert roles["acrocentric"] == roles["interspersed"] == frozenset() and roles["chromosome"] == {"chr1"}
    assert roles["filler"] - roles["structureless"] == roles["telomere"] == {"canonical_telomere", "noncanonical_telomere"}
    with pytest.raises(KeyError):
        H.Roles(spark.createDataFrame(nodes[1:], "feature_set string, child string, parent string"), H.GENOME_ROLES, H.GENOME_MINUS, H.GENOME_OPTIONAL)


def test_two_groups_of_several(spark):
    rows = [("c1", "x")] * 6 + [("c1", "y")] * 3 + [("c1", "z")] * 2 + [("c2", "z")] * 9 + [("c2", "y")] * 9 + [("c3", "x")] * 2
    got = {r.cluster_id: r for r in legacy.fisher_two_group(spark.createDataFrame(rows, "cluster_id string, group string"), "x").collect()}
    assert (got["c1"].treatment, got["c1"].control_in, got["c1"].treatment_in) == ("y", 6, 3) and abs(got["c1"].p_value - legacy.fisher_p(6, 3, 2, 9)) < 1e-12
    assert (got["c2"].treatment, got["c2"].control_in, got["c2"].treatment_in) == ("y", 0, 9)
    assert got["c3"].treatment == "x"
    one = legacy.fisher_two_group(spark.createDataFrame([("c", "x")], "cluster_id string, group string"), "x").first()
    assert one.p_value == 1.0 and one.enrichment == "mixed"


def test_wide_enrichment(spark):
    from tilespan.operators import clusters

    reads = spark.createDataFrame([(f"r{k}", "c1" if k < 6 else "c2") for k in range(10)], "read_id string, cluster_id string")
    groups = spark.createDataFrame([(f"r{k}", "A" if k < 5 else "B") for k in range(10)], "read_id string, group string")
    got = clusters.wide_enrichment(clusters.enrichment(reads, groups))
    assert got.columns == ["cluster_id", "n_total", "n_A", "n_B", "frac_A", "frac_B", "log2fc_A", "log2fc_B", "top_group", "private", "enriched"]
    assert [(r.cluster_id, r.n_A, r.n_B, r.log2fc_A == float("-inf"), r.private) for r in got.collect()] == [("c2", 0, 4, True, 1), ("c1", 5, 1, False, 0)]


def test_by_sample_takes_any_id(spark):
    from tilespan.operators import choose

    rows = [("c", f"read-{k}", "ABBBCCCCCC"[k % 10], float(k)) for k in range(40)]
    got = choose.by_sample(spark.createDataFrame(rows, "cluster_id string, read_id string, sample string, centroid_distance double"), 10).collect()
    assert sorted(r.sample for r in got) == list("ABBBCCCCCC") and sorted(r.rank for r in got) == list(range(1, 11))


def test_interesting_reads(spark):
    from tilespan.operators import assembly

    strings = spark.createDataFrame([("a", [("chr1:arm", 5000), ("chr1:aSat", 10)], 0), ("b", [("arm", 5), ("aSat", 2000)], 0)], "read_id string, segs array<struct<feature:string,len:long>>, bp long")
    assert [r.read_id for r in assembly.interesting(strings, {"arm"}, 2000).collect()] == ["b"] and assembly.interesting(strings, {"arm"}, 0).count() == 2


def test_presets_load():
    classes = {(fs, x): {x} for fs, labels in {"region": ["ct", "rDNA"], "repeat": ["nonrepeat", "rRNA"], "subtelomeric": ["canonical_telomere", "noncanonical_telomere", "telomere_like", "ITS", "TAR1"], "chromosome": ["chr1"], "acrocentric": ["DJ", "PHR", "rDNA", "SST1", "PJ", "array", "acrocentric"]}.items() for x in labels}
    classes[("region", "arm")] = {"arm", "p_arm", "q_arm"}
    assert [R.preset(n, classes).precedence[0] for n in R.preset_names()] == ["chromosome", "chromosome", "region", "acrocentric", "region"]


def test_overlay_checks(spark):
    a = spark.createDataFrame([("x", 0, 5, "f")], BED)
    with pytest.raises(R.SpecError):
        checked_overlay({"p": a}, R.composite(["p", "q"]))
    with pytest.raises(ValueError, match="span"):
        checked_overlay({"p": a, "q": spark.createDataFrame([("x", 0, 6, "f")], BED)}, R.composite(["p", "q"]))
    edges = spark.createDataFrame([("p", "g", "top"), ("q", "f", "top")], "feature_set string, child string, parent string")
    with pytest.raises(ValueError, match="no label f"):
        checked_overlay({"p": a, "q": a}, R.composite(["p", "q"]), edges)


def test_roles(spark):
    edges = spark.createDataFrame([("r", "sat", "top"), ("r", "ct", "sat"), ("r", "a", "sat")], "feature_set string, child string, parent string")
    roles = H.Roles(edges, {"ct": [("r", "ct", True)], "sat": [("r", "sat", True)]}, {"sat": ("ct",)})
    assert roles["sat"] == {"sat", "a"} and H.leaves(edges).count() == 2
    with pytest.raises(KeyError):
        H.Roles(edges, {"x": [("r", "none", True)]})


def test_statistics(spark):
    assert abs(legacy.fisher_p(3, 1, 1, 3) - 0.48571428571) < 1e-9 and abs(legacy.fisher_p(3, 1, 1, 3, True) - 0.24285714286) < 1e-9
    for x in (0.1, 1.0, 3.84, 20.0):
        assert abs(legacy.chi2_tail(x, 1) - math.erfc(math.sqrt(x / 2))) < 1e-12
        assert abs(legacy.chi2_tail(x, 2) - math.exp(-x / 2)) < 1e-12
    p = [0.01, 0.04, 0.03, 0.5]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(p)], "k int, p_value double")
    got = [r.q_value for r in colocalization.adjusted(rows, order=["k"]).orderBy("k").collect()]
    assert np.allclose(got, [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_adjusted_in_blocks_of_ranks(spark):
    r = random.Random(3)
    for dependent in (False, True):
        p = [None if k % 17 == 0 else round(r.random() ** 3, 3) for k in range(300)]
        some = sorted(x for x in p if x is not None)
        n, scale = len(some), sum(1 / i for i in range(1, len(some) + 1)) if dependent else 1.0
        want = {x: min(1.0, min(some[j] * n * scale / (j + 1) for j in range(some.index(x), n))) for x in set(some)}
        rows = spark.createDataFrame(list(enumerate(p)), "k int, p_value double")
        got = colocalization.adjusted(rows, order=["k"], dependent=dependent, block=16).collect()
        assert len(got) == 300 and all((x.q_value is None) if x.p_value is None else abs(x.q_value - want[x.p_value]) < 1e-9 for x in got)
    assert abs(colocalization.harmonic(1 << 21) - sum(1 / i for i in range(1, (1 << 21) + 1))) < 1e-9
    assert colocalization.adjusted(rows.limit(0), order=["k"]).count() == 0


def test_linkage_and_quality():
    x = np.array([[0, 0], [0, 1], [5, 5], [5, 6], [20, 0]], float)
    for method in ("ward", "average", "complete", "single"):
        merges = legacy.linkage(legacy.pair_distance(x), method)
        assert legacy.cut_tree(merges, 5, 3).tolist() == [1, 1, 2, 2, 3] and sorted(legacy.leaf_order(merges, 5)) == list(range(5))
    q = legacy.quality(x, np.array([1, 1, 2, 2, 3]))
    assert q["silhouette"] > 0.4 and q["davies_bouldin"] < 0.5 and q["calinski_harabasz"] > 20
    u, s, v = legacy.svd(x, 2)
    assert np.allclose(u @ v, x) and abs(legacy.loading_importance(v, s).sum() - 1) < 1e-9
    assert legacy.knee([0, 8, 9, 9.5, 10]) == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", f"s{k}", 0, 10 + k, "a") for k in range(6)], sequences.SCHEMA)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sequences.read_sequences(spark, str(tmp_path / "in"), 1)
    sequences.per_batch(stream, lambda b: b.groupBy("seq_id").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_command_line(spark, tmp_path):
    h = write(tmp_path / "h.tsv", "feature_set\tchild\tparent\nq\tx\ttop\nq\ty\ttop\nr\tu\ttop\nr\tv\ttop\n")
    q = write(tmp_path / "q.bed", "".join(f"s{k}\t0\t40\tx\ns{k}\t40\t90\ty\n" for k in range(4)))
    r = write(tmp_path / "r.bed", "".join(f"s{k}\t0\t{30 + k}\tu\ns{k}\t{30 + k}\t90\tv\n" for k in range(4)))
    out = lambda n: str(tmp_path / n)
    cli.main(["overlay-annotations", f"q={q}", f"r={r}", "--hierarchy", h, "--output", out("over")])
    assert spark.read.text(out("over")).count() == 12
    cli.main(["bin-annotations", q, "--hierarchy", h, "--feature-set", "q", "--output", out("bin"), "--window", "11"])
    cli.main(["build-feature-matrix", f"q={q}", f"r={r}", "--output", out("matrix"), "--window", "20"])
    assert spark.read.csv(out("matrix"), sep="\t", header=True).count() == 4
    cli.main(["genome-weights", f"q={q}", "--output", out("weights")])
    cli.main(["pool-samples", f"A:{q}", f"B:{r}", "--output", out("pool"), "--read-list", out("reads")])
    assert spark.read.csv(out("reads"), sep="\t", header=True).count() == 8
    cli.main(["detect-rearrangements", "--experiment", q, "--control", r, "--output", out("calls")])
    assert len(spark.read.csv(out("calls"), sep="\t", header=True).columns) >= 17


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
