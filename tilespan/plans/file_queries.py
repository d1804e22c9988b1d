"""Queries over files that they write themselves: sources, sinks, palettes, lists, presets and the roles of the genome tree."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hierarchy as H
from ..functions import resolve as R
from ..operators import assembly, clusters, figures, legacy, measures
from ..operators.overlay import overlay
from ..operators.storage import cut, folder
from ..sources import files
from ..sources.binding import EV, HT, LONG, events, hier_tables, table, track, tracks_long
from .catalogue import query
from .legacy_queries import MAPPED, TRACKS_SQL, mapped

#: The label trees of the genome, as parent: children.
GENOME = {
    "acrocentric": {"categorized": "acrocentric nonacrocentric", "acrocentric": "array SST1 PHR", "array": "DJ PJ rDNA"},
    "chromosome": {
        "categorized": "autosome sex", "autosome": "acrocentric metacentric submetacentric", "acrocentric": "chr13 chr14 chr15 chr21 chr22", "metacentric": "chr1 chr3 chr16 chr19 chr20",
        "submetacentric": "chr2 chr4 chr5 chr6 chr7 chr8 chr9 chr10 chr11 chr12 chr17 chr18", "sex": "chrX chrY",
    },
    "gene": {"categorized": "exon intron intergenic"},
    "region": {"categorized": "centromeric rDNA arm", "centromeric": "aSat bSat cenSat ct gSat HSat", "aSat": "alpha_hor mon", "alpha_hor": "active_hor dhor hor mixedAlpha", "HSat": "HSat1 HSat2 HSat3", "HSat1": "HSat1A HSat1B", "arm": "p_arm q_arm"},
    "repeat": {
        "categorized": "repeat nonrepeat", "repeat": "Interspersed_Repeat Satellite Noninterspersed", "Interspersed_Repeat": "RNA Transposable_Element Unknown", "RNA": "rRNA scRNA snRNA srpRNA tRNA",
        "Transposable_Element": "Class_I_Retrotransposition Class_II_DNA_Transposition", "Class_I_Retrotransposition": "LINE LINE-dependent_Retroposon LTR", "LINE-dependent_Retroposon": "Retroposon SINE",
        "Class_II_DNA_Transposition": "DNA RC", "Noninterspersed": "Low_complexity Simple_repeat",
    },
    "subtelomeric": {"categorized": "canonical_telomere telomere_like nonsubtelomeric", "telomere_like": "ITS noncanonical_telomere TAR1"},
}
GENOME_EDGES = [(fs, child, parent) for fs, tree in GENOME.items() for parent, children in tree.items() for child in children.split()]
TREE = "ge(feature_set, child, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in GENOME_EDGES) + ")"
SCHEMA = "feature_set string, child string, parent string"


def place(spark, label: str) -> str:
    return f"{folder(spark)}/tilespan-{uuid.uuid4().hex}-{label}"


def stored(spark, rows, label: str):
    """rows written as a TSV with header, and its path."""
    path = place(spark, label)
    files.write_tsv(rows, path)
    return path


def genome(spark):
    return spark.createDataFrame(GENOME_EDGES, SCHEMA)


@query(f'WITH {EV} SELECT seq_id, "start", "end", type AS feature FROM ev')
def bed_round_trip(spark, sf):
    """Annotation BED, gzipped, written in order and read back with the tiling check over its lines."""
    path = place(spark, "bed")
    files.write_bed(track(events(spark, sf), "type"), path, "gzip")
    return files.read_bed(spark, path).drop("ord")


BROKEN = """x AS (SELECT *, event_id % 40 AS k FROM ev),
 b AS (SELECT *, CASE WHEN k = 3 THEN "start" + 1 WHEN k = 4 THEN "start" - 1 ELSE "start" END AS s, lag(CASE WHEN k <> 2 THEN "end" END) OVER (PARTITION BY seq_id ORDER BY "start") AS before FROM x),
 y AS (SELECT CASE WHEN k = 1 THEN 'fields' WHEN k = 2 THEN 'coordinate' WHEN "end" <= s THEN 'empty' WHEN before IS NOT NULL AND s > before THEN 'gap' WHEN before IS NOT NULL AND s < before THEN 'overlap' END AS kind, "end" FROM b)"""


@query(f"""WITH {EV}, {BROKEN} SELECT kind, count(*) AS n, sum("end")::BIGINT AS ends FROM y WHERE kind IS NOT NULL AND kind <> 'coordinate' GROUP BY kind
 UNION ALL SELECT kind, count(*), NULL FROM y WHERE kind = 'coordinate' GROUP BY kind""")
def bed_problems(spark, sf):
    """Every kind of broken line found in a file: missing fields, coordinates that are no integers, empty rows, gaps and overlaps."""
    ev, k = track(events(spark, sf).withColumn("feature", F.col("event_id")), "event_id"), F.col("feature") % 40
    start = F.when(k == 3, F.col("start") + 1).when(k == 4, F.col("start") - 1).otherwise(F.col("start"))
    lines = ev.select("seq_id", F.col("start").alias("place"), F.when(k == 1, F.concat_ws("\t", "seq_id", start, "end")).when(k == 2, F.concat_ws("\t", "seq_id", start, F.lit("x"), F.lit("f"))).otherwise(F.concat_ws("\t", "seq_id", start, "end", F.lit("f"))).alias("value"))
    path = place(spark, "lines")
    lines.repartitionByRange("seq_id", "place").sortWithinPartitions("seq_id", "place").select("value").write.text(path)
    found = files.tiling_problems(files.parse_bed(files.numbered_lines(spark, path)))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("end").alias("ends"))


@query(f"WITH {HT} SELECT feature_set, child, parent FROM ht")
def hierarchy_tsv(spark, sf):
    return files.read_hierarchy(spark, stored(spark, hier_tables(spark, sf), "tree"))


PALETTE = "p AS (SELECT n_regionkey::VARCHAR AS feature_set, 'f_' || (n_nationkey % 7) AS feature, '#' || lpad(n_nationkey::VARCHAR, 6, '0') AS color, n_nationkey AS o FROM nation)"


def palette(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("feature_set"), F.concat(F.lit("f_"), (F.col("n_nationkey") % 7).cast("string")).alias("feature"), F.concat(F.lit("#"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("color"), "n_nationkey")
    return files.read_palette(spark, stored(spark, rows.coalesce(1).sortWithinPartitions("n_nationkey").drop("n_nationkey"), "palette"))


@query(f"WITH {PALETTE} SELECT feature, arg_max(color, o) AS color FROM p GROUP BY feature")
def palette_last_wins(spark, sf):
    return files.collapse_palette(palette(spark, sf))


@query(f"""WITH {PALETTE}, u AS (SELECT DISTINCT 'f_' || (c_custkey % 5) AS feature FROM customer), s AS (SELECT replace(p.feature, '_', ' ') AS label, arg_min(color, o) AS color, min(o) AS o FROM p JOIN u ON u.feature = p.feature GROUP BY ALL)
 SELECT row_number() OVER (ORDER BY o, label)::INTEGER AS place, label, color FROM s""")
def legend_in_use(spark, sf):
    return figures.legend(table(spark, sf, "customer").select(F.concat(F.lit("f_"), (F.col("c_custkey") % 5).cast("string")).alias("feature")), palette(spark, sf))


@query(f"""WITH {EV}, {LONG}, b AS (SELECT feature_set, feature, sum("end" - "start") AS bp FROM ann GROUP BY ALL), f AS (SELECT *, bp / sum(bp) OVER (PARTITION BY feature_set) AS f FROM b), w AS (SELECT left(feature, 1) AS feature, -ln(f) / max(-ln(f)) OVER () AS w FROM f)
 SELECT feature, round(max(w), 6) AS weight FROM w GROUP BY feature""")
def weights_tsv(spark, sf):
    """The largest weight of each name, names of several featuresets made equal."""
    rows = measures.genome_weights(tracks_long(events(spark, sf))).withColumn("feature", F.left("feature", F.lit(1)))
    return files.read_weights(spark, stored(spark, rows, "weights")).withColumn("weight", F.round("weight", 6))


@query("SELECT o_custkey::VARCHAR AS read_id, arg_max(o_orderstatus, o_orderkey) AS cluster_id FROM orders GROUP BY o_custkey")
def layout_last_assignment(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("read_id"), F.col("o_orderstatus").alias("cluster_id"), "o_orderkey")
    return files.read_layout(spark, stored(spark, rows.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey"), "layout"))


CONSENSUS = 'c AS (SELECT seq_id AS cluster_id, "start", "end", type AS feature FROM ev), k AS (SELECT seq_id AS cluster_id, count(*) AS size, max("end")::BIGINT AS width FROM ev GROUP BY seq_id)'


@query(f"""WITH {EV}, {CONSENSUS}, l AS (SELECT *, CASE WHEN lag(feature) OVER (PARTITION BY cluster_id ORDER BY "start") = feature THEN 0 ELSE 1 END AS new FROM c)
 SELECT k.cluster_id, size, width, n_segments, consensus_signature FROM k JOIN (SELECT cluster_id, count(*) AS n_segments, string_agg(feature, ' > ' ORDER BY "start") FILTER (WHERE new = 1) AS consensus_signature FROM l GROUP BY cluster_id) s ON s.cluster_id = k.cluster_id""")
def clusters_and_consensus_tsv(spark, sf):
    rows = track(events(spark, sf), "type").withColumnRenamed("seq_id", "cluster_id")
    shape = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.max("end").alias("width"))
    got = clusters.catalogue(files.read_clusters(spark, stored(spark, shape, "clusters")), files.read_consensus(spark, stored(spark, rows, "consensus")), 1)
    return got.select("cluster_id", "size", "width", "n_segments", "consensus_signature")


@query("""WITH o AS (SELECT o_orderkey, o_custkey::VARCHAR AS read_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS g FROM orders)
 SELECT read_id, arg_max(g, o_orderkey) AS "group" FROM o WHERE g IS NOT NULL GROUP BY read_id""")
def read_list_groups(spark, sf):
    """A list of reads with header: blank groups go, the last row of a read wins."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("read_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("sample"), "o_orderkey")
    got = files.read_list(spark, stored(spark, rows.repartitionByRange(2, "o_orderkey").sortWithinPartitions("o_orderkey"), "reads"))
    return files.group_map(got.withColumn("ord", files.placed()), "sample")


@query("""SELECT o_orderkey::VARCHAR AS read_id, o_custkey::INTEGER AS "start", (o_custkey + 10)::INTEGER AS "end" FROM orders WHERE o_orderkey % 5 <> 0""")
def markers_file(spark, sf):
    """Markers: rows without integer places go."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.concat_ws("\t", k, F.when(k % 5 == 0, "none").otherwise(F.col("o_custkey").cast("string")), F.col("o_custkey") + 10).alias("value"))
    path = place(spark, "markers")
    rows.write.text(path)
    return files.read_markers(spark, path)


@query(f"""WITH {EV}, p AS (SELECT 's' || (event_id % 2) AS sample, 's' || (event_id % 2) || '|' || seq_id AS seq_id, "start", "end", type AS feature FROM ev) SELECT sample, count(*) AS n, count(DISTINCT seq_id) AS reads, sum("end" - "start")::BIGINT AS bp FROM p GROUP BY sample""")
def pooled_files(spark, sf):
    """Two files of one sample each, pooled with namespaced ids; no tiling check."""
    specs = []
    for k in (0, 1):
        path = f"{place(spark, 'pool')}/s{k}.bed"
        files.write_bed(track(events(spark, sf).where(F.col("event_id") % 2 == k), "type"), path)
        specs.append(f"s{k}:{path}")
    rows, reads = files.pool(files.read_samples(spark, specs))
    got = rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"))
    return got.join(reads.groupBy("sample").agg(F.count("*").alias("reads")), "sample")


ROLES = [*H.GENOME_ROLES]


@query(f"""WITH RECURSIVE {EV}, {TREE}, u AS (SELECT feature_set, child AS node, parent AS top FROM ge UNION SELECT ge.feature_set, ge.child, u.top FROM ge JOIN u ON u.feature_set = ge.feature_set AND u.node = ge.parent),
 d AS (SELECT * FROM u UNION SELECT feature_set, child, child FROM ge), n AS (SELECT 'canonical' AS role, 'canonical_telomere' AS label UNION SELECT 'noncanonical', 'noncanonical_telomere' UNION SELECT 'its_tar1', unnest(['ITS', 'TAR1']) UNION SELECT 'ct', 'ct'
  UNION SELECT 'arm', node FROM d WHERE feature_set = 'region' AND top = 'arm' UNION SELECT 'satellite', node FROM d WHERE feature_set = 'region' AND top = 'centromeric' AND node <> 'ct'
  UNION SELECT 'acrocentric', node FROM u WHERE feature_set = 'chromosome' AND top = 'acrocentric' UNION SELECT 'chromosome', child FROM ge WHERE feature_set = 'chromosome' AND child NOT IN (SELECT parent FROM ge WHERE feature_set = 'chromosome')
  UNION SELECT 'interspersed', node FROM d WHERE feature_set = 'repeat' AND top = 'Interspersed_Repeat'),
 t AS (SELECT 'telomere' AS role, label FROM n WHERE role IN ('canonical', 'noncanonical')),
 s AS (SELECT 'structureless' AS role, label FROM n WHERE role IN ('arm', 'ct') UNION SELECT 'structureless', unnest(['telomere_like', 'nonsubtelomeric', 'nonrepeat', 'novel', 'categorized'])),
 a AS (SELECT * FROM n UNION SELECT * FROM t UNION SELECT * FROM s UNION SELECT 'filler', label FROM s UNION SELECT 'filler', label FROM t UNION SELECT 'masked', label FROM n WHERE role = 'interspersed' UNION SELECT 'masked', 'nonrepeat'),
 {MAPPED}, b AS (SELECT feature, sum("end" - "start")::BIGINT AS bp FROM (SELECT s AS feature, "start", "end" FROM tr UNION ALL SELECT r, "start", "end" FROM tr UNION ALL SELECT p, "start", "end" FROM tr) GROUP BY feature)
 SELECT role, label, bp FROM a JOIN b ON b.feature = a.label""")
def genome_roles(spark, sf):
    """The bases of every label in every class role it plays, by the genome tree read from a file."""
    roles = H.Roles(files.read_hierarchy(spark, stored(spark, genome(spark), "tree")), H.GENOME_ROLES, H.GENOME_MINUS, H.GENOME_OPTIONAL)
    held = F.array_compact(F.array(*[F.when(roles.members(name, F.col("feature")), name) for name in ROLES]))
    s, r, p = mapped(spark, sf)
    bases = s.union(r).union(p).groupBy("feature").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    return bases.select(F.explode(held).alias("role"), F.col("feature").alias("label"), "bp")


CATEGORY = """CASE WHEN a IN ('centromeric', 'aSat', 'alpha_hor', 'active_hor', 'dhor', 'hor', 'mixedAlpha', 'mon', 'bSat', 'cenSat', 'gSat', 'HSat', 'HSat1', 'HSat1A', 'HSat1B', 'HSat2', 'HSat3') THEN 'satellite'
 WHEN b = 'canonical_telomere' THEN 'canonical' WHEN b = 'noncanonical_telomere' THEN 'noncanonical' WHEN b IN ('ITS', 'TAR1') THEN 'ITS_TAR1' WHEN a = 'canonical_telomere' THEN 'canonical' WHEN a = 'noncanonical_telomere' THEN 'noncanonical'
 WHEN a IN ('ITS', 'TAR1') THEN 'ITS_TAR1' WHEN a = 'ct' THEN 'ct' WHEN a IN ('arm', 'p_arm', 'q_arm') THEN 'arm' ELSE 'other' END"""


@query(f"""WITH {EV}, {MAPPED}, x AS (SELECT r AS a, '' AS b, r AS feature, "end" - "start" AS n FROM tr UNION ALL SELECT s, '', s, "end" - "start" FROM tr UNION ALL SELECT r, s, r || ':' || s, "end" - "start" FROM tr UNION ALL SELECT s, r, s || ':' || r, "end" - "start" FROM tr)
 SELECT feature, {CATEGORY} AS category, count(*) AS segments, sum(n)::BIGINT AS bp FROM x GROUP BY ALL""")
def label_categories(spark, sf):
    """The interspersion category of every segment of one or two layers, by label."""
    roles = H.Roles(genome(spark), H.GENOME_ROLES, H.GENOME_MINUS, H.GENOME_OPTIONAL)
    s, r, _ = mapped(spark, sf)
    place = ["seq_id", "start", "end"]
    both = r.withColumnRenamed("feature", "r").join(s.withColumnRenamed("feature", "s"), place)
    labels = both.select(*place, F.explode(F.array("r", "s", F.concat_ws(":", "r", "s"), F.concat_ws(":", "s", "r"))).alias("feature"))
    counted = labels.groupBy("feature").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).alias("bp"))
    return counted.withColumn("category", measures.category(F.col("feature"), roles))


def tracks_for(spark, sf, names):
    """The mapped tracks under the names of the genome's featuresets."""
    subtelomeric, region, repeat = mapped(spark, sf)
    return {n: t for n, t in {"region": region, "repeat": repeat, "subtelomeric": subtelomeric}.items() if n in names}


def preset_rows(spark, sf, name):
    spec = R.preset(name, H.classes_of(GENOME_EDGES))
    return overlay(tracks_for(spark, sf, spec.precedence), spec)


def flat(case: str) -> str:
    """The overlay of tracks that share their rows: equal neighbours made one."""
    return TRACKS_SQL + f""", r AS (SELECT seq_id, "start", "end", {case} AS feature FROM t),
 g AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(feature) OVER (PARTITION BY seq_id ORDER BY "start") = feature THEN 0 ELSE 1 END AS new FROM r))
 SELECT seq_id, min("start")::BIGINT AS "start", max("end")::BIGINT AS "end", feature FROM g GROUP BY seq_id, run, feature"""


@query(flat("CASE WHEN s <> 'nonsubtelomeric' THEN s WHEN r = 'arm' THEN p WHEN r = 'ct' AND p = 'nonrepeat' THEN 'ct' WHEN r = 'ct' THEN p WHEN r = 'rDNA' AND p = 'rRNA' THEN p ELSE r END"))
def preset_priority(spark, sf):
    return preset_rows(spark, sf, "priority")


@query(flat("CASE WHEN s <> 'nonsubtelomeric' THEN s ELSE r END"))
def preset_telomere_satellite(spark, sf):
    return preset_rows(spark, sf, "telomere-satellite")


YAML = """name: no separators
precedence: [region, repeat, subtelomeric]
rules:
  - when: {region: '@arm', repeat: [nonrepeat]}
    emit: composite
  - when: {region: ct}
    emit: {composite: all}
  - when: {subtelomeric: ITS}
    emit: {composite: [subtelomeric, region]}
  - when: {subtelomeric: TAR1}
    emit: {literal: end}
"""


@query(flat("CASE WHEN r = 'arm' AND p = 'nonrepeat' THEN r || '_' || p WHEN r = 'ct' THEN r || ':' || p || ':' || s WHEN s = 'ITS' THEN s || ':' || r WHEN s = 'TAR1' THEN 'end' ELSE r END"))
def spec_from_yaml(spark, sf):
    """A spec file whose composites name no separator."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # the driver alone reads it
        f.write(YAML)
        f.flush()
        spec = R.load_yaml(f.name, H.classes_of(GENOME_EDGES))
    return overlay(tracks_for(spark, sf, spec.precedence), spec)


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS i FROM customer GROUP BY ALL), a AS (SELECT c_nationkey, sum(i) AS a FROM n GROUP BY ALL), b AS (SELECT c_mktsegment, sum(i) AS b FROM n GROUP BY ALL),
 x AS (SELECT n.*, a, b - i AS j, (SELECT count(*) FROM customer) - a AS r FROM n JOIN a ON a.c_nationkey = n.c_nationkey JOIN b ON b.c_mktsegment = n.c_mktsegment), o AS (SELECT *, ((i + 0.5) * (r - j + 0.5)) / ((a - i + 0.5) * (j + 0.5)) AS o FROM x)
 SELECT c_nationkey, c_mktsegment, CASE WHEN o >= 1.5 THEN 'enriched' WHEN o <= 1 / 1.5 THEN 'depleted' ELSE 'mixed' END AS label FROM o""")
def odds_check(spark, sf):
    """Each nation's customers of each segment, against those of all other nations."""
    n = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("i"))
    n = n.withColumn("a", F.sum("i").over(Window.partitionBy("c_nationkey"))).withColumn("b", F.sum("i").over(Window.partitionBy("c_mktsegment")))
    x = n.crossJoin(n.agg(F.sum("i").alias("all")))  # one row
    return x.select("c_nationkey", "c_mktsegment", legacy.odds_check(F.col("i"), F.col("a"), F.col("b") - F.col("i"), F.col("all") - F.col("a")).alias("label"))


@query("SELECT o_orderdate AS day, round(avg(n) OVER (ORDER BY o_orderdate ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 9) AS smooth FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY o_orderdate)")
def rolling_mean(spark, sf):
    """Orders a day, over a month around it."""
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return legacy.rolling_mean(days, "day", "n", 15).select("day", F.round("smooth", 9).alias("smooth"))


@query(f"""WITH {EV}, s AS (SELECT seq_id AS read_id, sum("end" - "start")::BIGINT AS bp, sum("end" - "start") FILTER (WHERE type NOT IN ('view', 'error')) AS i FROM ev GROUP BY seq_id) SELECT read_id, bp FROM s WHERE i >= 800""")
def interesting_reads(spark, sf):
    """Reads with 800 bases at least of labels that are no filler."""
    return assembly.interesting(assembly.label_strings(track(events(spark, sf), "type")), {"view", "error"}, 800).select("read_id", "bp")


@query("""WITH m AS (SELECT o_orderpriority AS c, c_mktsegment AS g FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT g, count(*) AS t FROM m GROUP BY g), k AS (SELECT c, count(*) AS k FROM m GROUP BY c),
 e AS (SELECT k.c, t.g, k, coalesce(n, 0) AS n, coalesce(n, 0) / t AS f FROM k CROSS JOIN t LEFT JOIN (SELECT c, g, count(*) AS n FROM m GROUP BY ALL) x ON x.c = k.c AND x.g = t.g),
 l AS (SELECT *, CASE WHEN n > 0 THEN ln(f / (k / (SELECT count(*) FROM m))) / ln(2) ELSE '-inf'::DOUBLE END AS e FROM e)
 SELECT c AS cluster_id, max(k) AS n_total, max(n) FILTER (WHERE g = 'BUILDING') AS "n_BUILDING", round(max(f) FILTER (WHERE g = 'BUILDING'), 9) AS "frac_BUILDING", round(max(e) FILTER (WHERE g = 'BUILDING'), 9) AS "log2fc_BUILDING",
  arg_max(g, (e, -ascii(g))) AS top_group, (count(*) FILTER (WHERE n > 0) = 1)::INTEGER AS private, (max(k) >= 2 AND max(e) >= 0.01)::INTEGER AS enriched FROM l GROUP BY c""")
def enrichment_wide(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("cluster_id"), F.col("c_mktsegment").alias("group"))
    got = clusters.wide_enrichment(clusters.enrichment(m.select("read_id", "cluster_id"), m.select("read_id", "group"), 0.01))
    return got.select("cluster_id", "n_total", "n_BUILDING", *[F.round(f"{c}_BUILDING", 9).alias(f"{c}_BUILDING") for c in ("frac", "log2fc")], "top_group", "private", "enriched")


@query("SELECT o_orderpriority AS cluster_a, c_mktsegment AS cluster_b, count(*) AS n_shared FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def overlap_pairs(spark, sf):
    m = cut(table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("read_id"), "o_orderpriority", "c_mktsegment"))
    return clusters.overlap_pairs(m.select("read_id", F.col("o_orderpriority").alias("cluster_id")), m.select("read_id", F.col("c_mktsegment").alias("cluster_id")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'HeLa' ELSE 'U2OS' END AS sample, CASE WHEN p_size % 3 = 0 THEN 'region' ELSE 'repeat' END AS featureset FROM part")
def file_name_parts(spark, sf):
    """Sample and featureset from file names."""
    name = F.concat(F.lit("/data/"), F.when(F.col("p_size") % 2 == 0, "HeLa").otherwise("U2OS"), F.lit("."), F.when(F.col("p_size") % 3 == 0, "region").otherwise("repeat"), F.lit(".features.bed.gz"))
    return table(spark, sf, "part").select("p_partkey", *files.named_parts(name, r"([^/.]+)\.([a-z]+)\.features\.bed(?:\.gz)?$", ["sample", "featureset"]))

