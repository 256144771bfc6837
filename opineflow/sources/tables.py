"""Readers with pruned columns over the lakehouse's Parquet tables, and ledger files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def json_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; torn lines are kept in ``_corrupt_record`` rather than failing the read."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def daily_partitions(spark: SparkSession, path: str, schema: str, start: str, end: str) -> DataFrame:
    """A hive-partitioned daily table (date=YYYYMMDD) between two days; partitions outside are never listed."""
    df = spark.read.schema(f"{schema}, date string").parquet(path)
    return df.where((df["date"] >= start) & (df["date"] <= end))


def action_files(spark: SparkSession, folder: str, action: str, key: str) -> DataFrame:
    """Actions of all JSON files below a folder, in both layouts: one action a file (*.action.json) or a list under ``actions`` (*_actions.json).

    ``action`` is the schema of one, so nothing is inferred; torn files and entries without a ``key`` are left out."""
    files = spark.read.schema(f"{action}, actions array<struct<{action}>>, _corrupt_record string")
    files = files.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.action.json,*_actions.json}").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    own = [f.name for f in files.schema["actions"].dataType.elementType.fields]
    each = F.when(F.col("actions").isNotNull(), F.col("actions")).otherwise(F.array(F.struct(*own)))
    return files.where("_corrupt_record is null").select(F.inline(each)).where(F.col(key).isNotNull())
