"""Annotation views over the star-schema tables, so that every operator runs on them.

ann_events: a sequence for each user, tiled by the user's events in time order, floor(value) + 1 long each, with three
labelings of the same tiling (event type, band of props.k, five-day period). ann_orders: a sequence for each order, tiled by its
lines, quantity long each. hier_geo and hier_events: label trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRACKS = ("type", "band", "period")
#: A tree over event types and one over bands, as (feature_set, child, parent).
EVENT_EDGES = [
    ("type", "browse", "categorized"), ("type", "commit", "categorized"), ("type", "look", "browse"), ("type", "view", "look"), ("type", "click", "look"),
    ("type", "purchase", "commit"), ("type", "signup", "commit"), ("type", "error", "categorized"),
    ("band", "low", "categorized"), ("band", "lo", "low"), ("band", "mid", "low"), ("band", "hi", "categorized"),
    *[("period", f"d{k}", "early" if k < 3 else "late") for k in range(7)], ("period", "early", "categorized"), ("period", "late", "categorized"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, start, end, type, band, period, event_id: one row an event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("seq_id"), "ts", "event_id", (F.floor("value") + 1).cast("bigint").alias("len"),
        F.col("event_type").alias("type"), F.when(k < 33, "lo").when(k < 66, "mid").otherwise("hi").alias("band"),
        F.concat(F.lit("d"), F.expr("(day(ts) - 1) div 5").cast("string")).alias("period"),
    )
    so_far = Window.partitionBy("seq_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("len").over(so_far)).withColumn("start", F.col("end") - F.col("len")).select("seq_id", "start", "end", *TRACKS, "event_id")


def track(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("seq_id", "start", "end", F.col(name).alias("feature"))


def tracks_long(rows: DataFrame) -> DataFrame:
    """All tracks in one long table (feature_set, seq_id, start, end, feature)."""
    return rows.select("seq_id", "start", "end", *TRACKS).unpivot(["seq_id", "start", "end"], list(TRACKS), "feature_set", "feature").select("feature_set", "seq_id", "start", "end", "feature")


def orders_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id (order), start, end, feature (nation of the supplier), returnflag: one row a line, in the order of all its columns."""
    lines = table(spark, sf_dir, "lineitem")
    so_far = Window.partitionBy("l_orderkey").orderBy(*[c for c in lines.columns if c != "l_orderkey"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("len", F.col("l_quantity").cast("bigint")).withColumn("end", F.sum("len").over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rows.join(names, "l_suppkey").select(F.col("l_orderkey").cast("string").alias("seq_id"), "start", "end", F.col("n_name").alias("feature"), F.col("l_returnflag").alias("returnflag"))


def hier_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_EDGES, "feature_set string, child string, parent string")


def hier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    low = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.lit("geo").alias("feature_set"), F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return low.union(region.select(F.lit("geo"), "r_name", F.lit("categorized")))


def hier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees: parts by brand and type, and suppliers by nation and region."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    kind = F.concat_ws("/", "p_brand", "p_type")
    parts = part.select(name("p", "p_partkey"), kind).union(part.select(kind, "p_brand").distinct()).union(part.select("p_brand", F.lit("categorized")).distinct()).toDF("child", "parent")
    met = supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("geo").alias("feature_set"), name("s", "s_suppkey").alias("child"), F.col("n_name").alias("parent"))
    return parts.select(F.lit("part").alias("feature_set"), "child", "parent").union(met).union(hier_geo(spark, sf_dir))


#: The same views for DuckDB.
HT = """ht AS (SELECT 'part' AS feature_set, 'p' || p_partkey AS child, p_brand || '/' || p_type AS parent FROM part UNION SELECT 'part', p_brand || '/' || p_type, p_brand FROM part UNION SELECT 'part', p_brand, 'categorized' FROM part
  UNION SELECT 'geo', 's' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'geo', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'geo', r_name, 'categorized' FROM region)"""
EV = """ev AS (
  SELECT seq_id, (sum(len) OVER w - len)::BIGINT AS "start", (sum(len) OVER w)::BIGINT AS "end", type, band, period, event_id
  FROM (SELECT 'u' || user_id AS seq_id, ts, event_id, floor(value)::BIGINT + 1 AS len, event_type AS type,
      CASE WHEN k < 33 THEN 'lo' WHEN k < 66 THEN 'mid' ELSE 'hi' END AS band, 'd' || ((day(ts) - 1) // 5) AS period
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events))
  WINDOW w AS (PARTITION BY seq_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
LONG = """ann AS (
  SELECT 'type' AS feature_set, seq_id, "start", "end", type AS feature FROM ev UNION ALL
  SELECT 'band', seq_id, "start", "end", band FROM ev UNION ALL SELECT 'period', seq_id, "start", "end", period FROM ev)"""
OT = """ot AS (
  SELECT l_orderkey::VARCHAR AS seq_id, (sum(l_quantity::BIGINT) OVER w - l_quantity::BIGINT)::BIGINT AS "start", (sum(l_quantity::BIGINT) OVER w)::BIGINT AS "end", n_name AS feature, l_returnflag AS returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING))"""
EDGES = "edges(feature_set, child, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EVENT_EDGES) + ")"


def runs_sql(source: str, name: str, keys: str = "seq_id") -> str:
    """A view of source with equal labels that touch or overlap made one."""
    return f"""{name} AS (
  SELECT {keys}, min("start") AS "start", max("end") AS "end", feature FROM (
    SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN lag(feature) OVER o = feature AND "start" <= lag("end") OVER o THEN 0 ELSE 1 END AS new
      FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY "start", "end")))
  GROUP BY {keys}, feature, run)"""
