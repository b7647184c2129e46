"""Writers: exports, snapshots and replacing rows of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.rows import upsert


def flat_for_csv(df: DataFrame) -> DataFrame:
    """df with lists joined by semicolons and every other nested value as JSON."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array<") and "struct" not in kind:
            out.append(F.concat_ws(";", F.col(name).cast("array<string>")).alias(name))
        elif kind.startswith(("array", "map", "struct")):
            out.append(F.to_json(name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; nulls are empty, quotes are doubled."""
    flat_for_csv(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


#: Times in ISO form; nulls are written.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "false"}


def _json_ready(df: DataFrame) -> list[Column]:
    return [F.col(f"`{n}`").cast("double").alias(n) if k.startswith("decimal") else F.col(f"`{n}`") for n, k in df.dtypes]


def json_rows(df: DataFrame, name: str = "j") -> DataFrame:
    """df's rows as one column of JSON, as export_json writes them."""
    return df.select(F.to_json(F.struct(*_json_ready(df)), JSON_OPTIONS).alias(name))


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines; decimals as numbers, times in ISO form."""
    df.select(*_json_ready(df)).write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Rows of the partitions that df has are replaced, others stay; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stamped(df: DataFrame, at: Column) -> DataFrame:
    """df with the time that it was backed up at, and its day."""
    return df.withColumn("backed_up_at", at.cast("timestamp")).withColumn("backup_day", F.to_date("backed_up_at"))


def snapshot(df: DataFrame, path: str, at: Column) -> None:
    """Appends all rows with the time they were backed up at, by day."""
    stamped(df, at).write.mode("append").partitionBy("backup_day").parquet(path)


def refresh_view(df: DataFrame, view: str, folder: str) -> str:
    """Writes df as a new table beneath folder and points the view at it; returns the table's path.

    A query that has begun on the view reads on from the table before, which is left in place: delete it when its readers are done. A
    failed write leaves the view as it was.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{path}`")
    return path


def upsert_view(new: DataFrame, view: str, folder: str, keys: Sequence[str], insert_only: bool = False, order: Sequence[Column] = ()) -> str:
    """Puts rows in by key into what the view shows, and refreshes it; a view that is not there yet is made."""
    spark = new.sparkSession
    old = spark.table(view) if spark.catalog.tableExists(view) else new.limit(0)
    return refresh_view(upsert(old, new, keys, insert_only, order), view, folder)


def empty_like(df: DataFrame, **more: str) -> DataFrame:
    """A table of df's columns, and more of given types, without rows."""
    out = df.limit(0)
    return out.withColumns({k: F.lit(None).cast(t) for k, t in more.items()})


def bulk_apply(ids: DataFrame, values: Sequence[Mapping[str, object]], existing: DataFrame, key: str, unique: Sequence[str]) -> DataFrame:
    """Every given row for every id; raises ValueError before anything is written if one exists by (key, unique). The values are a request's few rows."""
    spark = ids.sparkSession
    rows = ids.select(key).crossJoin(F.broadcast(spark.createDataFrame([dict(v) for v in values])))
    if rows.join(existing, [key, *unique], "left_semi").limit(1).count():
        raise ValueError("some rows exist already")
    return rows


def bulk_replace(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing without the rows of new's keys, and new."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
