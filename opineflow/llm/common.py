"""What the corpus operators share: shared scratch tables, document columns, 128-bit text keys.

Row identity: a document is its ``(doc_id, text)``.  Rows that repeat both are the same document
and get the same decision unless an operator's docstring says otherwise.  A null text counts as
empty, a null doc_id is kept and sorts after every other id.
"""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:').rstrip('/')}/.scratch"
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once all that reads them has been written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def collect_by_arrow(df: DataFrame) -> pd.DataFrame:
    """A bounded table, to the driver as Arrow batches: as rows the driver's JVM would hold it unpacked and pickled beside what the tasks sent."""
    key, conf = "spark.sql.execution.arrow.pyspark.enabled", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return df.toPandas()
    finally:
        conf.set(key, before)


_CACHES: dict[str, dict] = {}


def worker_cache(operator: str, cache: dict) -> dict:
    """``cache``, which the operator keeps in a Python worker from task to task, until another one's turn (``turn_to``)."""
    _CACHES[operator] = cache
    return cache


def turn_to(operator: str) -> None:
    """Empty the other operators' caches and return what Arrow holds of earlier batches.

    Spark hands a Python worker from stage to stage, so they would add up beside the JVM, each within its own bound."""
    for other, cache in _CACHES.items():
        if other != operator:
            cache.clear()
    pa.default_memory_pool().release_unused()


#: A group of over 1 / HOT_SHARE of all rows and over HOT_ROWS rows is hot; there are fewer than HOT_SHARE of these, whatever the data.
HOT_SHARE, HOT_ROWS = 1024, 500_000


def join_groups(rows: DataFrame, groups: DataFrame, row_key: str, group_key: str, size: str = "n") -> DataFrame:
    """Inner join of ``rows`` to one row a group, ``size`` being its rows; both are written tables.

    Hot groups, fewer than HOT_SHARE, are broadcast, so that their rows stay where they are; only the others are shuffled.
    Where there are none it is one join, whose larger partitions AQE may split."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max((total or 0) // HOT_SHARE, HOT_ROWS)
    same = F.col(row_key) == F.col(group_key)
    if (most or 0) <= least:
        return rows.join(groups, same)
    hot = F.broadcast(groups.where(F.col(size) > least))
    rest = rows.join(hot.select(F.col(group_key).alias("__hot")), F.col(row_key) == F.col("__hot"), "left_anti")
    return rows.join(hot, same).unionByName(rest.join(groups.where(F.col(size) <= least), same))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, so that clashing extra columns do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def key128(*cols: Column) -> Column:
    """16 bytes of SHA-256: unlike a 64-bit hash, safe as an identity among 10^12 texts."""
    return F.unhex(F.substring(F.sha2(F.concat(*cols) if len(cols) > 1 else cols[0], 256), 1, 32))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
