"""Incremental variants: a Parquet folder of events as a stream, run until it is drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and values per window and type.  In append mode a window is written once the watermark has passed it; in complete mode all are kept."""
    e = events.withColumn("at", F.to_timestamp_ltz("ts") if dict(events.dtypes)["ts"] == "string" else F.col("ts").cast("timestamp"))
    w = e.withWatermark("at", watermark).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """Folders for a stream's rows and its checkpoint, below the one that executors share."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    at = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"
    return f"{at}/rows", f"{at}/checkpoint"


def live_latest(actions: DataFrame) -> DataFrame:
    """The latest stance of each creator and ticker, kept up to date: state is one row a key."""
    last = F.max_by(F.struct("action_id", "direction", "clock"), F.struct("clock", "action_id"))
    return actions.groupBy("creator_id", "ticker").agg(last.alias("s")).select("creator_id", "ticker", "s.*")


def first_arrivals(events: DataFrame, keys: list[str], at: str, watermark: str) -> DataFrame:
    """Events whose keys have not come before within the watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def drain_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run over all data there is; each complete result replaces the one in ``folder``, written by the executors."""
    query = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder)).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def drain_appended(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run over all data there is, appending to ``folder``."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


_SYNCED = "chat string, id string, at timestamp, text string, status string"


def chat_sync(messages: DataFrame) -> DataFrame:
    """Messages (chat, id, at, text) with ``status`` against each chat's frontier: new, repeated or late.

    A chat's state is its frontier, the time of its newest message so far, and the ids met at that very time.  A message after the
    frontier is new, one at it is new unless its id is among these, one before it is late: it came after the chat was synced past it.
    Ids repeat within a batch too.  State is one row a chat, kept by the checkpoint, so a restarted stream goes on where it stood.
    Messages without chat, id or time can't be placed and are left out.  A batch's ids of one chat are in one task's memory at a time:
    ``maxFilesPerTrigger`` of the source bounds them."""
    from collections.abc import Iterator

    import pandas as pd

    def sync(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frontier, at_frontier = state.get if state.exists else (None, [])
        newest, met, seen = frontier, set(at_frontier), set()
        for rows in batches:
            if not len(rows):
                continue
            status = []
            for i, t in zip(rows["id"], rows["at"].dt.as_unit("us").astype("int64"), strict=True):
                if frontier is not None and t < frontier:
                    status.append("late")
                elif (t, i) in seen or t == frontier and i in at_frontier:
                    status.append("repeated")
                else:
                    status.append("new")
                    seen.add((t, i))
                if newest is None or t > newest:
                    newest, met = int(t), set()
                if t == newest:
                    met.add(i)
            yield rows[["chat", "id", "at", "text"]].assign(status=status)
        state.update((newest, sorted(met)))

    placed = messages.select("chat", F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), "text").where("chat is not null and id is not null and at is not null")
    return placed.groupBy("chat").applyInPandasWithState(sync, _SYNCED, "frontier long, ids array<string>", "append", "NoTimeout")
