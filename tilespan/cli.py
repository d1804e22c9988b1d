"""Command line: one command for each analysis, files in and files out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import hierarchy as H
from .functions import resolve as R
from .operators import assembly, binning, clusters, colocalization, measures
from .operators.overlay import checked_overlay
from .sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("tilespan").getOrCreate()


def named(specs: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for spec in specs:
        name, equals, path = spec.partition("=")
        if not equals or name in out:
            raise SystemExit(f"FEATURESET=PATH, each once: {spec}")
        out[name] = path
    return out


def tracks(spark, specs):
    return {n: files.read_bed(spark, p) for n, p in named(specs).items()}


def long_table(found):
    out = None
    for name, rows in found.items():
        own = rows.select(F.lit(name).alias("feature_set"), "seq_id", "start", "end", "feature")
        out = own if out is None else out.union(own)
    return out


def genome_roles(spark, path):
    return H.Roles(files.read_hierarchy(spark, path), H.GENOME_ROLES, H.GENOME_MINUS, H.GENOME_OPTIONAL)


def bin_annotations(a, spark):
    edges = files.read_hierarchy(spark, a.hierarchy).where(F.col("feature_set") == a.feature_set)
    rows = binning.bin_annotations(files.read_bed(spark, a.bed), edges, a.window, a.step, majority=a.majority, scope=a.scope, novel_min=a.novel_min)
    files.write_bed(rows, a.output, a.compression)


def overlay_annotations(a, spark):
    found, edges = tracks(spark, a.bed), files.read_hierarchy(spark, a.hierarchy)
    classes: dict = {}
    for r in H.closure(edges).collect():
        classes.setdefault((r.feature_set, r.ancestor), set()).add(r.node)
    if a.preset and a.spec:
        raise SystemExit("either --preset or --spec")
    spec = R.preset(a.preset, classes) if a.preset else R.load_yaml(a.spec, classes) if a.spec else R.composite(tuple(found), a.separator)
    files.write_bed(checked_overlay(found, spec, edges), a.output, a.compression)


def build_feature_matrix(a, spark):
    rows, crossings = long_table(tracks(spark, a.bed)), None
    if a.interspersion:
        if not a.hierarchy:
            raise SystemExit("--interspersion needs --hierarchy")
        own, roles = files.read_bed(spark, a.interspersion), genome_roles(spark, a.hierarchy)
        crossings = measures.interspersion(own, measures.category(F.col("feature"), roles), measures.CROSSINGS)
    metrics = measures.long_metrics(rows, a.window, a.gap_tol, crossings=crossings)
    files.write_tsv(measures.wide_matrix(metrics).orderBy("seq_id"), a.output)
    files.write_tsv(measures.adaptive_thresholds(measures.feature_fraction(rows), a.factor, a.least, a.most), a.output + ".thresholds")


def detect_rearrangements(a, spark):
    def sample(path):
        rows = files.read_bed(spark, path)
        return colocalization.support(colocalization.min_gaps(rows, a.min_occurrence), colocalization.read_spans(rows), a.windows, a.boundaries)

    calls = colocalization.detect(sample(a.experiment), sample(a.control), sample(a.reference) if a.reference else None, a.windows, a.min_support, a.min_log2, a.fdr)
    files.write_tsv(calls.select(*colocalization.CALL), a.output)


def genome_weights(a, spark):
    files.write_tsv(measures.genome_weights(long_table(tracks(spark, a.bed))).orderBy("feature_set", F.desc("weight"), "feature"), a.output)


def pool_samples(a, spark):
    rows, reads = files.pool(files.read_samples(spark, a.bed), a.separator)
    files.write_bed(rows, a.output)
    files.write_tsv(reads, a.read_list)


def cluster(a, spark):
    rows, roles = files.read_bed(spark, a.bed), genome_roles(spark, a.hierarchy)
    strings = assembly.interesting(assembly.label_strings(rows, a.min_length, a.min_occurrence), roles["filler"], a.min_interesting)
    rows = rows.join(strings.select(F.col("read_id").alias("seq_id")), "seq_id", "left_semi")
    filler = roles["filler"]
    weight = None  # of a label vocabulary
    if a.weights or a.weight_method == "genome-freq":
        if not a.weights:
            raise SystemExit("--weight-method genome-freq needs --weights")
        weight = {r.feature: r.weight for r in files.read_weights(spark, a.weights).collect()}
    elif a.weight_method == "repeat-mask":
        weight = dict.fromkeys(roles["masked"], 0.0)
    elif a.weight_method == "idf":
        weight = {r.feature: r.weight for r in measures.document_weights(rows, a.weight_floor).collect()}
    scorer = assembly.Scorer([roles["satellite"], roles["arm"], roles["ct"], roles["telomere"] | roles["its_tar1"]], a.match, a.partial, a.mismatch, a.cross, weight)
    gates = assembly.Gates(a.gap, a.min_overlap, a.min_identity, a.min_jaccard, a.distinctive_weight, filler, a.transition)
    edges = assembly.cut(assembly.blocked_overlaps(rows, strings, scorer, gates, a.block))
    groups = assembly.communities(edges).select(F.col("node").alias("read_id"), F.col("label").alias("group")) if a.communities else assembly.components(edges).select(F.col("node").alias("read_id"), F.col("root").alias("group"))
    members = assembly.clusters(strings, groups, assembly.orientation_conflicts(edges))
    backbone = assembly.Backbone(filler, roles["structureless"], roles["telomere"], roles["acrocentric"])
    placed = assembly.cut(assembly.layout(members, strings, scorer, backbone, a.gap, edges))
    voted = assembly.cut(assembly.consensus(placed))
    shape = voted.groupBy("cluster_id").agg(F.count("*").alias("consensus_segments"), F.max("end").alias("width"))
    heads = members.where("rank = 1").join(shape, "cluster_id", "left")
    files.write_tsv(heads.select("cluster_id", "size", "seed", "consensus_segments", "width", F.col("conflict").alias("orientation_conflict")).orderBy(F.desc("size"), "seed"), a.output)
    files.write_tsv(voted.orderBy("cluster_id", "start"), a.output + ".consensus")
    files.write_tsv(placed.orderBy("cluster_id", "read_id", "start"), a.output + ".layout")


def test_enrichment(a, spark):
    groups = files.group_map(files.read_list(spark, a.read_list).withColumn("ord", files.placed()), a.group_col)
    found = clusters.enrichment(files.read_layout(spark, a.layout), groups, a.min_log2, a.min_size)
    files.write_tsv(clusters.wide_enrichment(found), a.output)


def cluster_annotate(a, spark):
    files.write_tsv(clusters.labels(files.read_clusters(spark, a.clusters), files.read_consensus(spark, a.consensus), genome_roles(spark, a.hierarchy), a.min_size, a.end, a.satellite, a.alt), a.output)


def select_representatives(a, spark):
    files.write_tsv(clusters.catalogue(files.read_clusters(spark, a.clusters), files.read_consensus(spark, a.consensus), a.min_size), a.output)


def compare_clusterings(a, spark):
    pairs = clusters.overlap_pairs(files.read_layout(spark, a.first), files.read_layout(spark, a.second))
    files.write_tsv(pairs.orderBy(F.desc("n_shared"), "cluster_a", "cluster_b"), a.output)
    r = clusters.agreement(pairs).first()
    print(f"reads {r.n}  ARI {r.ari:.4f} ({r.level})  NMI {r.nmi:.4f}")


def version(a, spark):
    print(__version__)


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tilespan", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(f, *arguments):
        sub = commands.add_parser(f.__name__.replace("_", "-"))
        sub.set_defaults(run=f)
        for names, options in arguments:
            sub.add_argument(*names.split(), **options)

    def opt(name, default=None, kind=None, **more):
        return f"--{name}", {"default": default, "type": kind or (type(default) if default is not None else str), **more}

    def need(name, **more):
        return f"--{name}", {"required": True, **more}

    beds = ("bed", {"nargs": "+", "metavar": "FEATURESET=PATH"})
    command(bin_annotations, ("bed", {}), need("hierarchy"), need("feature-set"), need("output"), opt("window", 101), opt("step", 1), opt("majority", 0.5), opt("scope", "node", choices=["node", "window"]), opt("novel-min", 0.5), opt("compression", "none"))
    command(overlay_annotations, beds, need("hierarchy"), need("output"), opt("preset", choices=R.preset_names()), opt("spec"), opt("separator", ":"), opt("compression", "none"))
    command(build_feature_matrix, beds, need("output"), opt("interspersion"), opt("hierarchy"), opt("window", 1000), opt("gap-tol", 100), opt("factor", 3.0), opt("least", 0.001), opt("most", 0.05))
    command(detect_rearrangements, need("experiment"), need("control"), opt("reference"), need("output"), opt("windows", [0, 1000, 10000, 50000], numbers), opt("boundaries", [], numbers), opt("min-occurrence", 0), opt("min-support", 3), opt("min-log2", 1.0), opt("fdr", 0.05))
    command(genome_weights, beds, need("output"))
    command(pool_samples, ("bed", {"nargs": "+", "metavar": "SAMPLE:PATH"}), need("output"), need("read-list"), opt("separator", "|"))
    command(cluster, ("bed", {}), need("hierarchy"), need("output"), opt("weights"), opt("weight-method", "repeat-mask", choices=["none", "repeat-mask", "idf", "genome-freq"]), opt("weight-floor", 0.1), opt("min-length", 0), opt("min-occurrence", 0), opt("min-interesting", 2000.0), opt("gap", 0.1), opt("match", 1.0), opt("partial", 0.5), opt("mismatch", -1.0), opt("cross", -2.0), opt("min-overlap", 1000.0), opt("min-identity", 0.9), opt("min-jaccard", 0.0), opt("distinctive-weight", 0.15), opt("block", 0),
            ("--transition", {"action": argparse.BooleanOptionalAction, "default": True}), ("--communities", {"action": argparse.BooleanOptionalAction, "default": True}))
    command(test_enrichment, need("layout"), need("read-list"), need("output"), opt("group-col", "sample"), opt("min-log2", 1.0), opt("min-size", 2))
    command(cluster_annotate, need("clusters"), need("consensus"), need("hierarchy"), need("output"), opt("min-size", 2), opt("end", 0.15), opt("satellite", 0.8), opt("alt", 6000))
    command(select_representatives, need("clusters"), need("consensus"), need("output"), opt("min-size", 2))
    command(compare_clusterings, ("first", {}), ("second", {}), need("output"))
    command(version)
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(a, None if a.command == "version" else session())


if __name__ == "__main__":
    main(sys.argv[1:])
