"""Session settings and table access shared by every plan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

#: Settings for a local session; a cluster's own spark-defaults take their place.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in {**LOCAL, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Timestamps without a zone are read as UTC instants, which watermarks and casts need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)}
    return df.select([F.col(c).cast("timestamp").alias(c) if c in naive else F.col(c) for c in df.columns]) if naive else df
