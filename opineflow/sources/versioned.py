"""Tables whose writes are whole or not at all: new files beside the old ones, then one small list of what counts, put in place by a rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTable:
    """A Parquet table in ``folder``, partitioned by one column of text, days or numbers.

    Every write makes a run of its own, ``folder/run=<id>/<by>=<value>/``.  ``folder/current.json`` lists, per partition, the runs that make it up;
    it is replaced in one rename, so readers see all of a write or nothing, and a write that dies leaves files that nothing lists.  The
    list grows with the partitions, a few dozen bytes each, not with the rows.  One writer at a time; a null partition value is not allowed."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, by: str):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def current(self) -> dict[str, list[str]]:
        """Partition -> its runs; empty before the first write."""
        path = self._path("current.json")
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/current.json").collect()))

    def _publish(self, listed: dict[str, list[str]]) -> None:
        new = self._path(f".new-{uuid.uuid4().hex}")
        out = new.getFileSystem(self._conf).create(new)
        out.write(bytearray(json.dumps(listed, ensure_ascii=False).encode()))
        out.close()
        fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        fc.rename(new, self._path("current.json"), how)

    def _stage(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write a run; the partitions it holds, taken from the folders it made."""
        run = uuid.uuid4().hex
        rows.select([F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("__part", F.col(self.by).cast("string")).write.partitionBy("__part").parquet(f"{self.folder}/run={run}")
        path = self._path(f"run={run}")
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in path.getFileSystem(self._conf).listStatus(path) if s.isDirectory()]
        return run, [unescape(n.removeprefix("__part=")) for n in names]

    def replace(self, rows: DataFrame) -> list[str]:
        """Put ``rows`` in place of all partitions that they hold; the same rows again change nothing that a reader sees."""
        run, held = self._stage(rows)
        self._publish({**self.current(), **{p: [run] for p in held}})
        return sorted(held)

    def append(self, rows: DataFrame) -> list[str]:
        run, held = self._stage(rows)
        listed = self.current()
        self._publish({**listed, **{p: [*listed.get(p, []), run] for p in held}})
        return sorted(held)

    def read(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The table as it is now, or some of its partitions: only their folders are opened."""
        escape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        listed = self.current()
        paths = [f"{self.folder}/run={run}/__part={escape(p)}" for p in (listed if parts is None else parts) for run in listed.get(p, [])]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _holding(self, keys: DataFrame, key: str) -> list[str]:
        """The partitions in which any of the keys stands."""
        wanted = keys.select(F.col(key).alias("__k")).distinct()
        met = self.read().join(wanted, F.col(key) == F.col("__k"), "left_semi")
        return [r[0] for r in met.select(F.col(self.by).cast("string")).distinct().collect()]  # names of partitions

    def patch(self, changes: DataFrame, key: str) -> list[str]:
        """Give rows the values of the columns of ``changes`` beside ``key``, one row a key; unknown keys change nothing.

        Only the partitions that hold a changed row are written anew, and read up to the list's rename as they were."""
        columns = [c for c in changes.columns if c != key]
        if self.by in columns:
            raise ValueError(f"{self.by} is the partition: a row doesn't move by a patch")
        parts = self._holding(changes, key)
        if parts:
            new = changes.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
            rows = self.read(parts).join(new, F.col(key) == F.col("__k"), "left")
            self.replace(rows.select([F.when(F.col("__hit"), F.col(f"__{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in columns else F.col(f.name) for f in self.schema]))
        return sorted(parts)

    def delete(self, keys: DataFrame, key: str) -> list[str]:
        """Take the rows of the keys out; a partition without rows is listed no more."""
        parts = self._holding(keys, key)
        if parts:
            gone = keys.select(F.col(key).alias("__k")).distinct()
            run, held = self._stage(self.read(parts).join(gone, F.col(key) == F.col("__k"), "left_anti"))
            self._publish({**{p: runs for p, runs in self.current().items() if p not in parts}, **{p: [run] for p in held}})
        return sorted(parts)


OBJECTS = "digest string, content binary, bucket string"


def object_store(spark: SparkSession, folder: str) -> VersionedTable:
    """A store of contents by their SHA-256, partitioned by its first two digits."""
    return VersionedTable(spark, folder, OBJECTS, "bucket")


def put_objects(store: VersionedTable, contents: DataFrame, content: str) -> int:
    """Add the contents that the store doesn't hold yet, each once; how many these were.  Null is no content."""
    new = contents.select(F.col(content).cast("binary").alias("content")).where("content is not null")
    new = new.withColumn("digest", F.sha2("content", 256)).groupBy("digest").agg(F.first("content").alias("content")).withColumn("bucket", F.substring("digest", 1, 2))
    have = store.read().select(F.col("digest").alias("__d"))
    before = store.read().count()
    store.append(new.join(have, F.col("digest") == F.col("__d"), "left_anti"))
    return store.read().count() - before


def get_objects(store: VersionedTable, digests: DataFrame, digest: str) -> DataFrame:
    """Per wanted digest: content and ``state``: ok, missing, or corrupt where the content no longer has that digest."""
    wanted = digests.select(F.col(digest).alias("wanted")).distinct()
    met = wanted.join(store.read(), F.col("wanted") == F.col("digest"), "left")
    state: Column = F.when(F.col("digest").isNull(), "missing").when(F.sha2("content", 256) == F.col("digest"), "ok").otherwise("corrupt")
    return met.select(F.col("wanted").alias("digest"), F.when(state == "ok", F.col("content")).alias("content"), state.alias("state"))


def write_snapshot(table: VersionedTable, rows: DataFrame, day: str, day_col: str = "snapshot_date") -> None:
    """A day's snapshot in place of that day's last one, by rename; other days stay as they are, and an empty one takes the day away."""
    if rows.isEmpty():
        listed = table.current()
        listed.pop(day, None)
        table._publish(listed)
    else:
        table.replace(rows.withColumn(day_col, F.lit(day).cast(table.schema[day_col].dataType)))


def snapshot_strictly_before(table: VersionedTable, day: str) -> DataFrame:
    """The latest snapshot before a day (days as yyyy-MM-dd, so their names are in order); no other is opened."""
    earlier = [d for d in table.current() if d < day]
    return table.read([max(earlier)] if earlier else [])
