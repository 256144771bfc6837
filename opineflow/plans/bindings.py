"""Actions, bars, trades and the like as views over the star and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opineflow.sources.tables import table

_DIRECTIONS = {"purchase": "bullish", "error": "bearish", "view": "neutral", "click": "watchlist", "signup": "risk_warning"}
_STATUSES = ["pending", "verified", "failed", "under_review"]


def actions(spark: SparkSession, root: str) -> DataFrame:
    return actions_of(table(spark, root, "events", "event_id", "ts", "user_id", "event_type"))


def actions_of(e: DataFrame) -> DataFrame:
    direction = F.create_map(*[F.lit(x) for kv in _DIRECTIONS.items() for x in kv])
    status = F.array(*[F.lit(s) for s in _STATUSES])
    return e.select(
        F.col("event_id").alias("action_id"),
        F.concat(F.lit("kol_"), (F.col("user_id") % 7).cast("string")).alias("creator_id"),
        F.concat(F.lit("T"), (F.col("event_id") % 11).cast("string")).alias("ticker"),
        direction[F.col("event_type")].alias("direction"),
        F.col("ts").alias("clock"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("user_id") % 4 == 0, "short_term").when(F.col("user_id") % 4 == 1, "medium_term").when(F.col("user_id") % 4 == 2, "long_term").alias("time_horizon"),
        F.element_at(status, (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
    )


def bars(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events", "event_id", "ts", "value")
    return e.groupBy(F.concat(F.lit("T"), (F.col("event_id") % 11).cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date")).agg(
        F.max_by("value", "event_id").alias("close"), F.max("value").alias("high"), F.min("value").alias("low")
    )


def daily(spark: SparkSession, root: str) -> DataFrame:
    """Bars with an open and the close of the bar before."""
    first = table(spark, root, "events", "event_id", "ts", "value").groupBy(F.concat(F.lit("T"), (F.col("event_id") % 11).cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date")).agg(F.min_by("value", "event_id").alias("open"))
    rows = bars(spark, root).join(first, ["ticker", "date"])
    return rows.withColumn("pre_close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))


def adj_factors(daily: DataFrame) -> DataFrame:
    """Factors with gaps: every third day of the month has none."""
    day = F.dayofmonth("date")
    return daily.where(day % 3 != 0).select("ticker", "date", (1 + (day % 5) / F.lit(10.0)).alias("adj_factor"))


def trades(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 50).alias("kol"), F.col("l_partkey").alias("ticker"), "l_orderkey", "l_linenumber",
        (F.col("l_tax") - F.col("l_discount")).alias("return_pct"), F.col("l_quantity").alias("holding_days"),
        (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("net_pnl"),
        F.col("o_orderdate").alias("entry"), F.col("l_shipdate").alias("exit"),
    )


#: The same views for DuckDB.
VIEWS_SQL = """actions as (select event_id as action_id, 'kol_' || (user_id % 7) as creator_id, 'T' || (event_id % 11) as ticker,
    case event_type when 'purchase' then 'bullish' when 'error' then 'bearish' when 'view' then 'neutral' when 'click' then 'watchlist' when 'signup' then 'risk_warning' end as direction,
    ts as clock, (event_id % 100) / 100.0::double as confidence, case user_id % 4 when 0 then 'short_term' when 1 then 'medium_term' when 2 then 'long_term' end as time_horizon,
    case event_id % 4 when 0 then 'pending' when 1 then 'verified' when 2 then 'failed' else 'under_review' end as status from events),
  bars as (select 'T' || (event_id % 11) as ticker, cast(ts as date) as date, arg_max(value, event_id) as close, max(value) as high, min(value) as low from events group by all),
  trades as (select o_custkey % 50 as kol, l_partkey as ticker, l_orderkey, l_linenumber, l_tax - l_discount as return_pct, l_quantity as holding_days,
    l_extendedprice * (l_tax - l_discount) as net_pnl, o_orderdate as entry, l_shipdate as exit from lineitem join orders on l_orderkey = o_orderkey)"""
