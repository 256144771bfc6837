"""Exact dedup by content sort: sampled splitters, external sort, full comparison of neighbours.

The sort key is (leading characters, SHA-256, length, id) of the normalised text.  The leading
characters and the digest bound what the splitter sample holds, however long the texts are, and the
length and id let the splitters cut through a hot group, so no task gets a whole group of copies.
Runs that touch the edge of a partition are stitched by at most two summary rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

SPACE = r"[\x20\x09-\x0D]+"
_OUT = "doc_id long, rid long, keep_chars long, keep_id long, keep_rid long, run_size long, text_sha256 string, head boolean, edge boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the one before; emit a run once it has ended."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("run_size", pa.int64()), ("text_sha256", pa.string()), ("head", pa.bool_()), ("edge", pa.bool_())])

    def closed(rows: pa.Table, new: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        of = np.repeat(starts, sizes)
        edge = np.zeros(len(new), bool)
        if first:
            edge[: sizes[0]] = True
        if last:
            edge[starts[-1] :] = True
        lead = rows.take(pa.array(of))
        columns = [rows["doc_id"], rows["rid"], lead["n_chars"], lead["doc_id"], lead["rid"], pa.array(np.repeat(sizes, sizes)), rows["sha"], pa.array(new), pa.array(edge)]
        return pa.table(columns, schema=schema).combine_chunks().to_batches()[0]

    held: list[pa.Table] = []  # the open run, without its texts
    before, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        same = np.empty(batch.num_rows, bool)
        same[0] = before is not None and norm[0].as_py() == before
        same[1:] = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        before = norm[-1].as_py()
        rows = pa.table({k: batch.column(k) for k in ("doc_id", "rid", "n_chars", "sha")})
        starts = np.flatnonzero(~same)
        if not len(starts):
            held.append(rows)
            continue
        cut = int(starts[-1])
        done, new = pa.concat_tables([*held, rows.slice(0, cut)]), np.concatenate([np.zeros(sum(map(len, held)), bool), ~same[:cut]])
        if len(new):
            new[0] = True
            yield closed(done, new, first, False)
            first = False
        held = [rows.slice(cut)]
    if held:
        done = pa.concat_tables(held)
        new = np.zeros(len(done), bool)
        new[0] = True
        yield closed(done, new, first, True)


def content_sort_dedup(docs: DataFrame, partitions: int | None = None, lead_chars: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of texts that are equal once white space is deleted, the row with the most code points in the
    original stays, then the smallest doc_id (null last).  Of fully repeated rows exactly one stays.
    Empty and null texts form one group.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), F.char_length("text").cast("long").alias("n_chars"), F.regexp_replace("text", SPACE, "").alias("norm"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    order = [F.substring("norm", 1, lead_chars), F.col("sha"), F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")]
    runs = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "rid", "n_chars", "norm", "sha")
    runs = materialize(runs.mapInArrow(_runs, _OUT), "content-sort")
    # at most two edge runs a partition: this side is bounded by the number of partitions, whatever the data
    best = F.min(F.struct((-F.col("keep_chars")).alias("less"), F.col("keep_id").isNull().alias("no_id"), F.col("keep_id").alias("id"), F.col("keep_rid").alias("rid"))).alias("best")
    edges = runs.where("edge and head").groupBy(F.col("text_sha256").alias("edge_sha")).agg(best, F.sum("run_size").alias("total"))
    met = F.col("edge_sha").isNotNull()
    return runs.join(F.broadcast(edges), F.col("edge") & (F.col("text_sha256") == F.col("edge_sha")), "left").select(
        "doc_id",
        F.when(met, F.col("best.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(met, F.col("total")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("rid") == F.when(met, F.col("best.rid")).otherwise(F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )
