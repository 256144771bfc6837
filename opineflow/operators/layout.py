"""Regions of scanned pages from the boxes of their cells: rows, tables, titles and text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What share of a height cells of one row may lie apart, of how many heights a gap parts blocks, and a title's height.
ROW_SHARE, BLOCK_GAP, TITLE_HEIGHT, TITLE_CHARS = 0.6, 1.7, 1.3, 40


def cell_rows(cells: DataFrame, row_share: float = ROW_SHARE) -> DataFrame:
    """The cells' columns with cy (middle), h (height, 1 at least) and row_no, a number per page of the row each belongs to.

    From the top, a cell joins the first row whose mean middle is within ``row_share`` of the greater height, else begins one.
    Cells pass in order, a batch at a time; of the page at hand only its rows' means are kept."""
    s = cells.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})
    s = s.repartition("page_id").sortWithinPartitions("page_id", "cy", "place", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rows = (), []  # rows: mean middle, mean height, cells
        for batch in batches:
            numbers = []
            for p, cy, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "cy", "h")), strict=True):
                if p != page:
                    page, rows = p, []
                near = (i for i, (y, tall, _) in enumerate(rows) if abs(cy - y) <= row_share * max(h, tall))
                at = next(near, len(rows))
                y, tall, n = rows[at] if at < len(rows) else (0.0, 0.0, 0)
                rows[at : at + 1] = [((y * n + cy) / (n + 1), (tall * n + h) / (n + 1), n + 1)]
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "row_no"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields)
    return s.mapInArrow(number, f"{types}, row_no int")


def layout_regions(cells: DataFrame) -> DataFrame:
    """Per page its regions from the top: page_id, region, type (table, title or text), text, x0, y0, x1, y1, rows and cells.

    ``cells``: page_id, place (order of reading, for ties), text, x0, y0, x1, y1.  Cells without text or a box do not count, boxes
    are held at 0.  Two or more rows in turn with several cells are a table, in markdown, its first row the header; other rows part where
    their middles are over 1.7 median heights apart; a row of one short cell, much taller than the page's, that stands alone is a title."""
    held = [F.greatest(F.lit(0.0), F.col(c).cast("double")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    boxed = " and ".join(f"{c} is not null" for c in ("x0", "y0", "x1", "y1"))
    c = cell_rows(cells.where(f"text <> '' and {boxed}").select("page_id", "place", "text", *held))
    heights = c.groupBy(F.col("page_id").alias("of")).agg(F.median("h").alias("median"))
    rows = c.groupBy("page_id", "row_no").agg(
        F.avg("cy").alias("cy"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("x0", "place", "text"))), lambda x: x["text"]).alias("texts"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    rows = rows.join(heights, F.col("page_id").eqNullSafe(F.col("of"))).drop("of")
    down = Window.partitionBy("page_id").orderBy("cy", "row_no")
    many = F.col("n") >= 2
    rows = rows.withColumns({"table": many & (F.coalesce(F.lag(many).over(down), F.lit(False)) | F.coalesce(F.lead(many).over(down), F.lit(False))), "at": F.row_number().over(down)})
    apart = ~F.col("table") & (F.col("cy") - F.lag("cy").over(down) > BLOCK_GAP * F.col("median"))
    begins = F.coalesce((F.col("table") != F.lag("table").over(down)) | apart, F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("region", F.sum("begins").over(down).cast("int"))
    regions = rows.groupBy("page_id", "region").agg(
        F.first("table").alias("table"), F.first("median").alias("median"), F.transform(F.array_sort(F.collect_list(F.struct("at", "texts"))), lambda x: x["texts"]).alias("grid"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("rows"), F.sum("n").alias("cells"),
    )
    wide = F.array_max(F.transform("grid", F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.col("wide") - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform("grid", line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("wide")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.expr("slice(lines, 2, size(lines))")), "\n")
    plain = F.array_join(F.transform("grid", lambda r: F.array_join(r, " ")), "\n")
    title = (F.col("cells") == 1) & (F.char_length(plain) <= TITLE_CHARS) & (F.col("y1") - F.col("y0") >= TITLE_HEIGHT * F.col("median"))
    regions = regions.withColumn("wide", wide).withColumn("lines", lines)
    return regions.select("page_id", "region", F.when(F.col("table"), "table").when(title, "title").otherwise("text").alias("type"), F.when(F.col("table"), table).otherwise(plain).alias("text"), "x0", "y0", "x1", "y1", "rows", "cells")
