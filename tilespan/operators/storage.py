"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(session: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only on a local master where none is set, as in tests, one of our own."""
    context = session.sparkContext
    found = context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilespan-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df, in folder()."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in folder(), read back: for tables that several jobs read, packed and without a second pass over what makes them."""
    path = f"{folder(df.sparkSession)}/tilespan-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as spark.sql.shuffle.partitions says. For work that costs more than its bytes tell: a number that is named keeps AQE from joining the tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task that dealt() makes, about.
EACH = 1 << 16


def tasks(df: DataFrame, each: int | None = None) -> int:
    """Tasks of about each (EACH) rows that df takes, no fewer than spread() takes. Counts df."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (each or EACH)))


def dealt(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """df dealt by keys to tasks of about so many rows, so that what a task holds doesn't grow with df; no fewer tasks than spread() takes. Counts df first."""
    return df.repartition(tasks(df, each), *keys)
