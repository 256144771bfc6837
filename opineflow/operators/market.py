"""Adjusted bars, as-of joins and trading calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjusted_bars(daily: DataFrame, factors: DataFrame, how: str = "qfq") -> DataFrame:
    """Prices times the factor (hfq), or relative to the last factor of the queried range (qfq: of its last day, the last ticker's);
    gaps are filled from the next factor, and days after the last one are dropped.  Prices are rounded to cents, half to even
    on the scaled double; change and pct_chg are taken of rounded prices."""
    # newest first, so that the next factor is the last one met: a running frame
    newest = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    j = daily.join(factors, ["ticker", "date"], "left").withColumn("factor", F.last("adj_factor", ignorenulls=True).over(newest)).where("factor is not null")
    scale = F.col("factor")
    if how == "qfq":
        # the last row that stays has a factor of its own, as a later one would be a later row: no window is needed for it
        own = factors.where("adj_factor is not null").join(daily.select("ticker", "date"), ["ticker", "date"], "left_semi")
        j = j.crossJoin(F.broadcast(own.agg(F.max_by("adj_factor", F.struct("date", "ticker")).alias("base"))))  # one row
        scale = scale / F.col("base")
    cents = lambda c: F.rint(c * 100) / 100
    j = j.withColumn("scale", scale).select("ticker", "date", *[cents(F.col(c) * F.col("scale")).alias(c) for c in ("open", "high", "low", "close", "pre_close")])
    j = j.withColumn("change", cents(F.col("close") - F.col("pre_close")))
    return j.withColumn("pct_chg", cents(F.try_divide("change", "pre_close") * 100))


def asof_bars(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Each action with the last bar on or before its day and the first on or after it.

    Both tables are sorted together once per ticker and month and carried along; what a month lacks comes from the
    months beside it, of which there is one row each, so a ticker that most actions are about is many tasks."""
    a = actions.select("ticker", F.col("clock").cast("date").alias("date"), F.lit(1).alias("side"), "action_id", F.lit(None).cast("struct<date:date,close:double>").alias("bar"))
    b = bars.select("ticker", "date", F.lit(0).alias("side"), F.lit(None).cast("long").alias("action_id"), F.struct("date", "close").alias("bar"))
    both = a.unionByName(b).withColumn("month", F.trunc("date", "MM"))
    edges = both.groupBy("ticker", "month").agg(F.min("bar").alias("first"), F.max("bar").alias("last"))
    earlier = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("ticker").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("ticker", "month", F.last("last", ignorenulls=True).over(earlier).alias("before"), F.last("first", ignorenulls=True).over(later).alias("after"))
    back = Window.partitionBy("ticker", "month").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("ticker", "month").orderBy(F.desc("date"), "side").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("last", F.last("bar", ignorenulls=True).over(back)).withColumn("next", F.last("bar", ignorenulls=True).over(ahead)).where("side = 1")
    j = j.join(edges, ["ticker", "month"]).withColumns({"last": F.coalesce("last", "before"), "next": F.coalesce("next", "after")})
    return j.select("action_id", F.col("last.date").alias("last_date"), F.col("last.close").alias("last_close"), F.col("next.date").alias("next_date"), F.col("next.close").alias("next_close"))


def trading_calendar(first, last, spark) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.withColumn("is_open", F.weekday("date") < 5)


def calendar_of(rows: DataFrame, at: str) -> DataFrame:
    """The days on which something happened, open on weekdays."""
    return rows.select(F.col(at).cast("date").alias("date")).distinct().withColumn("is_open", F.weekday("date") < 5)


def neighbour_days(calendar: DataFrame) -> DataFrame:
    """For each day the trading days before and after it, and the running count of trading days.  A calendar is small."""
    order = Window.orderBy("date")
    open_day = F.when(F.col("is_open"), F.col("date"))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    return calendar.select("date", "is_open", F.last(open_day, ignorenulls=True).over(back).alias("prev_day"), F.last(open_day, ignorenulls=True).over(ahead).alias("next_day"), F.count_if("is_open").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("open_days"))


# Opening, last close and the market's name; between them a lunch break counts as regular time.
SESSIONS = (("HK", "09:30", "16:00"), ("CN", "09:30", "15:00"), ("US", "09:30", "16:00"))


def session_timing(events: DataFrame, calendar: DataFrame, delay: int = 5) -> DataFrame:
    """(event_id, market, local): the session and when one can act: at once after the delay, at the day's or the next trading day's opening."""
    s = events.join(neighbour_days(calendar).select("date", "is_open", "next_day"), F.col("local").cast("date") == F.col("date"), "left")
    of = lambda i: F.create_map(*[F.lit(x) for row in SESSIONS for x in (row[0], row[i])])[F.col("market")]
    clock = F.date_format("local", "HH:mm:ss.SSSSSS")
    first, last = F.concat(of(1), F.lit(":00.000000")), F.concat(of(2), F.lit(":00.000000"))
    s = s.withColumn("session", F.when(first.isNull(), "unknown").when(~F.coalesce("is_open", F.lit(False)), "non_trading_day").when(clock < first, "pre_market").when(clock <= last, "regular").otherwise("after_close"))
    opening = lambda day: F.to_timestamp_ntz(F.concat_ws(" ", F.col(day).cast("string"), first), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    later = F.col("local") + F.make_dt_interval(mins=F.lit(delay))
    at = F.when(F.col("session").isin("regular", "unknown"), later).when(F.col("session") == "pre_market", opening("date")).otherwise(opening("next_day"))
    return s.select("event_id", "market", "session", at.alias("executable_at"))


def daily_scan(daily: DataFrame, tickers: list[str], start: str, end: str) -> DataFrame:
    """Bars of some tickers between two days, both included, given as 20240131 or 2024-01-31; an end before the start is an error."""
    low, high = start.replace("-", ""), end.replace("-", "")
    if high < low:
        raise ValueError("end before start")
    return daily.where(F.col("ticker").isin(tickers) & F.col("date").between(F.to_date(F.lit(low), "yyyyMMdd"), F.to_date(F.lit(high), "yyyyMMdd")))


def anchor_windows(actions: DataFrame, bars: DataFrame, reach: int) -> DataFrame:
    """Bars within ``reach`` trading days of each action's last bar (its ticker's first bar, if that is later): an equi-join, no range join."""
    numbered = bars.select("ticker", "date", "close", F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("no"))
    anchors = asof_bars(actions, bars).select(F.col("action_id").alias("__a"), "last_date")
    a = actions.select("action_id", "ticker").join(anchors, F.col("action_id") == F.col("__a"))
    places = numbered.select(F.col("ticker").alias("__t"), F.col("date").alias("__d"), "no")
    a = a.join(places, (F.col("ticker") == F.col("__t")) & (F.col("last_date") == F.col("__d")), "left").select("action_id", "ticker", F.coalesce("no", F.lit(1)).alias("at"))
    a = a.select("action_id", "ticker", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("no"))
    return a.join(numbered, ["ticker", "no"]).groupBy("action_id").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("close").alias("high"), F.min("close").alias("low"))
