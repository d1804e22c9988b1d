"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.storage import folder
from ..sources.binding import table
from ..sources.scans import there
from ..streaming import sequences
from .catalogue import query


def finished(stream, keys):
    """The last update of every key of a running aggregate over all files there are: each batch is written as files, and the latest of a key read back."""
    spark, path = stream.sparkSession, f"{folder(stream.sparkSession)}/tilespan-{uuid.uuid4().hex}-stream"

    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    running = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    own = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{path}/out") if there(spark, f"{path}/out") else spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "_batch").alias("_l")).select(*keys, "_l.*")


@query("""SELECT date_trunc('hour', ts) AS "start", date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def stream_event_windows(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    got = finished(sequences.event_counts(stream), ["start", "end", "event_type"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("value", 4).alias("value"))
