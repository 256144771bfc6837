"""Market tables in hive partitions: daily bars and factors by date, calendars by exchange, the stock list."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators.tickers import is_json_object


def parse_day(value: str | None) -> str | None:
    """20240131 or 2024-01-31 as 20240131; null and empty stay null, anything else is an error."""
    if value is None or not str(value).strip():
        return None
    text = str(value).strip()
    if not re.fullmatch(r"\d{8}|\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"no day: {value!r}")
    return text.replace("-", "")


def parse_fields(fields: str | Sequence[str] | None, known: Sequence[str]) -> list[str]:
    """Comma-joined or listed field names in their order; none means all; an unknown one is an error."""
    names = [f.strip() for f in (fields.split(",") if isinstance(fields, str) else fields or []) if f.strip()]
    if unknown := [f for f in names if f not in known]:
        raise ValueError(f"unknown fields: {unknown}")
    return names or list(known)


def parse_open(value: object) -> bool | None:
    """1, "1", true and their opposites; null stays null."""
    if value is None or value == "":
        return None
    if str(value).lower() not in ("0", "1", "true", "false"):
        raise ValueError(f"no is_open: {value!r}")
    return str(value).lower() in ("1", "true")


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write hive partitions; those that the rows have are replaced, others stay.

    Rows of a partition meet in one file each, however many tasks they come from."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def daily(spark: SparkSession, path: str, schema: str, fields: str | Sequence[str] | None = None, tickers: str | None = None, trade_date: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A table in ``date=YYYYMMDD`` partitions by tickers (comma-joined) and day or range, in the order of ticker and date.

    A day and a range exclude each other, an end before the start is an error.  Only partitions asked for are listed,
    and only the fields asked for are read."""
    one, low, high = parse_day(trade_date), parse_day(start), parse_day(end)
    if one and (low or high):
        raise ValueError("a day or a range, not both")
    if low and high and high < low:
        raise ValueError("end before start")
    df = spark.read.schema(f"{schema}, date string").parquet(path)
    names = parse_fields(fields, df.columns)
    for bound in ([F.col("date") == one] if one else []) + ([F.col("date") >= low] if low else []) + ([F.col("date") <= high] if high else []):
        df = df.where(bound)
    if tickers:
        df = df.where(F.col("ticker").isin([t.strip() for t in tickers.split(",") if t.strip()]))
    return df.orderBy("ticker", "date").select(names)


def stock_list(stocks: DataFrame, fields: str | Sequence[str] | None = None, list_status: str | None = "L", **equal: str | None) -> DataFrame:
    """The stock list where all given columns have the given values; listed ones unless said otherwise."""
    for column, value in {"list_status": list_status, **equal}.items():
        if value is not None:
            stocks = stocks.where(F.col(column) == value)
    return stocks.orderBy("ticker").select(parse_fields(fields, stocks.columns))


def calendar(spark: SparkSession, path: str, exchange: str = "SSE", start: str | None = None, end: str | None = None, is_open: object = None) -> DataFrame:
    """Days (YYYYMMDD) of one exchange's partition, of a range, open or not."""
    df = spark.read.schema("cal_date string, is_open boolean, exchange string").parquet(path).where(F.col("exchange") == exchange)
    if low := parse_day(start):
        df = df.where(F.col("cal_date") >= low)
    if high := parse_day(end):
        df = df.where(F.col("cal_date") <= high)
    if (wanted := parse_open(is_open)) is not None:
        df = df.where(F.col("is_open") == wanted)
    return df.orderBy("cal_date")


def days_to_sync(calendar: DataFrame, have: DataFrame, frontier: str | None = None) -> DataFrame:
    """Open days after the last day synced that have no partition yet: cal_date, in order."""
    wanted = calendar.where("is_open")
    if last := parse_day(frontier):
        wanted = wanted.where(F.col("cal_date") > last)
    return wanted.join(have.select(F.col("date").alias("__have")).distinct(), F.col("cal_date") == F.col("__have"), "left_anti").select("cal_date").orderBy("cal_date")


def table_readiness(daily: DataFrame, least_days: int) -> DataFrame:
    """Per ticker: days, first and last day, and whether there are enough of them."""
    return daily.groupBy("ticker").agg(F.count_distinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), (F.count_distinct("date") >= least_days).alias("ready"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``good``: whether a line is one object and nothing else; blank lines are no lines, bad ones have no row."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("good", is_json_object(F.col("value")))
    return lines.select("value", "good", F.when(F.col("good"), F.from_json("value", schema)).alias("row"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def csv_prices(spark: SparkSession, path: str) -> DataFrame:
    """ticker (as text, leading zeros kept), date, close."""
    return spark.read.schema("ticker string, date date, close double").option("header", True).csv(path)
