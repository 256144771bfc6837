"""Market partitions: coercion, errors, pruning and replacement; cycles; hot tickers."""

import time

import pytest
from pyspark.sql import functions as F

from opineflow.operators import catalog, market, tickers
from opineflow.sources import market as ms

SCHEMA = "ticker string, close double"


def test_days_fields_and_flags():
    assert ms.parse_day("2024-01-31") == ms.parse_day(" 20240131 ") == "20240131" and ms.parse_day("") is None
    assert ms.parse_fields("b, a", ["a", "b"]) == ["b", "a"] and ms.parse_fields(None, ["a"]) == ["a"]
    assert (ms.parse_open("1"), ms.parse_open(False), ms.parse_open(None)) == (True, False, None)
    for wrong in (lambda: ms.parse_day("2024/01/31"), lambda: ms.parse_fields("c", ["a"]), lambda: ms.parse_open("yes")):
        with pytest.raises(ValueError):
            wrong()


def test_partitions_are_pruned_and_replaced(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = [(t, float(k), f"202401{k:02d}") for k in range(1, 11) for t in ("A", "B")]
    ms.write_partitions(spark.createDataFrame(rows, "ticker string, close double, date string"), path, "date")
    ms.write_partitions(spark.createDataFrame([("A", 99.0, "20240103")], "ticker string, close double, date string"), path, "date")
    got = ms.daily(spark, path, SCHEMA, "date,close", "A,B", start="2024-01-02", end="20240104")
    assert [tuple(r) for r in got.collect()] == [("20240102", 2.0), ("20240103", 99.0), ("20240104", 4.0), ("20240102", 2.0), ("20240104", 4.0)]
    assert "PartitionFilters: [isnotnull(date" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for wrong in ({"trade_date": "20240102", "start": "20240101"}, {"start": "20240105", "end": "20240101"}, {"fields": "open"}):
        with pytest.raises(ValueError):
            ms.daily(spark, path, SCHEMA, **wrong)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")], "parent string, child string")
    got = {tuple(r) for r in catalog.lineage_closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd"}


def test_asof_is_linear_in_a_tickers_rows(spark):
    def seconds(n):
        actions = spark.range(n).select(F.lit("T").alias("ticker"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("clock"), F.col("id").alias("action_id"))
        bars = spark.range(400).select(F.lit("T").alias("ticker"), F.date_add(F.lit("2023-10-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
        began = time.perf_counter()
        assert market.asof_bars(actions, bars).where("next_date < last_date").count() == 0
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 3 * max(seconds(20_000), 0.5)


def test_ticker_dialects(spark):
    cases = {"700.HK": "0700.HK", "00700.hk": "00700.HK", "600519.SS": "600519.SH", "300750": "300750.SZ", "aapl.OQ": "AAPL", "MSFT": "MSFT", "MC.FP": "MC.PA", "005930.KS": "005930.KS", "600519.L": None, "1234": None, "830799": None, "A B": None, "": None, "TOOLONG.N": None}
    df = spark.createDataFrame(list(cases), "string").select("value", tickers.normalized(F.col("value"))["symbol"].alias("symbol"))
    assert {r.value: r.symbol for r in df.collect()} == cases
    pairs = spark.createDataFrame([("601899", "601899.SH", True), ("000001.SH", "000001.SZ", False), ("0700.HK", "700", True), ("$tsla", "TSLA", True), ("", "", False)], "a string, b string, same boolean")
    assert pairs.where(tickers.tickers_match(F.col("a"), F.col("b")) != F.col("same")).count() == 0
