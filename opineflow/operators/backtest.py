"""Per-action backtest, settlement, credibility, portfolio metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, round-trip cost, holding days per horizon.
STOP, TARGET, COST = -0.10, 0.20, 0.003
WINDOW_DAYS = {"intraday": 30, "short_term": 30, "medium_term": 90, "long_term": 180}
DEFAULT_DAYS = 180


def per_action_backtest(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of following each action: exit_reason or skip, return_pct net of cost, holding_days, max_drawdown.

    A ticker's closes form one short sorted array (its trading days), so no action is joined to every later bar.  Actions on one
    ticker and day with the same sign and window share their outcome, so each such case is worked out once, however many they are.
    On one bar a stop comes before a target, a target before the deadline.
    """
    days = F.create_map(*[F.lit(x) for kv in WINDOW_DAYS.items() for x in kv])
    sign = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction").isin("bearish", "risk_warning"), -1.0)
    series = bars.where("close > 0").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("series"))
    a = actions.select("action_id", "creator_id", "ticker", "direction", "clock", "status", F.col("clock").cast("date").alias("day"), sign.alias("sign"), F.coalesce(days[F.coalesce("time_horizon", F.lit(""))], F.lit(DEFAULT_DAYS)).alias("days"))
    cases = a.where("sign is not null").select("ticker", "day", "sign", "days").distinct()
    c = cases.join(series, "ticker", "left").withColumn("path", F.expr("filter(series, b -> b.date >= day)"))
    c = c.withColumn("entry", F.expr("try_element_at(path, 1)")).withColumn("scan", F.expr("slice(path, 2, greatest(size(path) - 1, 0))"))
    gross = "(sign * (b.close / entry.close - 1))"
    c = c.withColumn("hit", F.expr(f"try_element_at(filter(scan, b -> {gross} <= {STOP}D or {gross} >= {TARGET}D or b.date >= date_add(entry.date, days)), 1)"))
    c = c.withColumn("exit", F.expr("coalesce(hit, try_element_at(scan, -1))")).withColumn("gross", F.expr("sign * (exit.close / entry.close - 1)"))
    c = c.withColumn("low", F.expr(f"array_min(transform(filter(scan, b -> b.date <= exit.date), b -> {gross}))"))
    skip = F.when(F.col("series").isNull(), "no_price_data").when(F.col("entry").isNull(), "no_entry_bar").when(F.size("scan") == 0, "insufficient_bars")
    reason = F.when(F.col("gross") <= STOP, "stop_loss").when(F.col("gross") >= TARGET, "target_reached").when(F.col("hit").isNotNull(), "time_exit").otherwise("end_of_period")
    ok = skip.isNull()
    c = c.select(
        F.col("ticker").alias("__ticker"), F.col("day").alias("__day"), F.col("sign").alias("__sign"), F.col("days").alias("__days"), skip.alias("skip"), F.when(ok, reason).alias("exit_reason"),
        F.when(ok, F.col("entry.date")).alias("entry_date"), F.when(ok, F.col("exit.date")).alias("exit_date"),
        F.when(ok, F.round(F.col("gross") - COST, 4)).alias("return_pct"), F.when(ok, F.datediff("exit.date", "entry.date")).alias("holding_days"),
        F.when(ok, F.round(F.least(F.lit(0.0), F.col("low")), 4)).alias("max_drawdown"),
    )
    same = F.col("ticker").eqNullSafe(F.col("__ticker")) & F.col("day").eqNullSafe(F.col("__day")) & (F.col("sign") == F.col("__sign")) & (F.col("days") == F.col("__days"))
    return a.join(c, same, "left").select(
        "action_id", "creator_id", "ticker", "direction", "clock", "status", F.when(F.col("sign").isNull(), "non_directional").otherwise(F.col("skip")).alias("skip"),
        "exit_reason", "entry_date", "exit_date", "return_pct", "holding_days", "max_drawdown",
    )


def settle(results: DataFrame) -> DataFrame:
    """action_id, old and new status: a terminal exit verifies a positive return and fails any other; reviews and settled ones stay."""
    terminal = F.col("exit_reason").isin("stop_loss", "target_reached", "time_exit")
    new = F.when(F.col("status") != "pending", F.col("status")).when(terminal & (F.col("return_pct") > 0), "verified").when(terminal, "failed").otherwise("pending")
    return results.select("action_id", F.col("status").alias("old_status"), new.alias("new_status"))


def settle_report(results: DataFrame) -> DataFrame:
    return settle(results).groupBy("old_status", "new_status").agg(F.count("*").alias("n"))


def credibility(results: DataFrame) -> DataFrame:
    """Per creator: settled, wins and the shrunk score clamp(round(40 + 55 (w + 2) / (n + 4)), 0, 99); creators without any have (0, 0)."""
    settled = F.col("return_pct").isNotNull() & (F.col("holding_days") > 0)
    each = results.groupBy("creator_id").agg(F.count_if(settled).alias("settled"), F.count_if(settled & (F.col("return_pct") > 0)).alias("wins"))
    score = F.bround(40 + 55 * (F.col("wins") + 2) / (F.col("settled") + 4))
    return each.withColumn("credibility", F.greatest(F.lit(0), F.least(F.lit(99), score.cast("int"))))


def daily_totals(trades: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """Per creator and exit day: pnl in cents and the running total value; summed as whole hundredths of a cent, so in any order."""
    days = trades.groupBy("kol", F.col("exit").cast("date").alias("day")).agg((F.rint(F.sum(F.rint(F.col("net_pnl") * 10_000).cast("long")) / 100) / 100).alias("pnl"))
    order = Window.partitionBy("kol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("total", start + F.sum(F.rint(F.col("pnl") * 100).cast("long")).over(order) / 100)


def drawdown(totals: DataFrame) -> DataFrame:
    """Per creator: deepest drawdown from the running peak, and the longest run of days below it."""
    order = Window.partitionBy("kol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    t = totals.withColumn("peak", F.max("total").over(order)).withColumn("dd", F.when(F.col("peak") > 0, 1 - F.col("total") / F.col("peak")).otherwise(0.0))
    t = t.withColumn("island", F.sum(F.when(F.col("dd") > 0, 0).otherwise(1)).over(order))
    runs = t.groupBy("kol", "island").agg(F.max("dd").alias("dd"), F.count_if(F.col("dd") > 0).alias("run"))
    return runs.groupBy("kol").agg(F.round(F.max("dd"), 6).alias("max_drawdown"), F.max("run").alias("longest_run"))


def consecutive_losses(trades: DataFrame) -> DataFrame:
    """Per creator the longest run of losses (net_pnl below 0; a null ends it), by exit; trades without one come first.

    Runs are counted within a month; months meet by one row each, so that a long history is many tasks."""
    # all that tells rows apart: ties would make the runs depend on row order
    order = Window.partitionBy("kol", "month").orderBy("exit", "l_orderkey", "l_linenumber", "ticker", "holding_days", "net_pnl", "return_pct").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("month", F.trunc("exit", "MM"))
    t = t.withColumn("island", F.sum(F.when(F.col("net_pnl") < 0, 0).otherwise(1)).over(order))
    runs = t.groupBy("kol", "month", "island").agg(F.count_if(F.col("net_pnl") < 0).alias("run"))
    m = runs.groupBy("kol", "month").agg(F.max("run").alias("most"), F.coalesce(F.max(F.when(F.col("island") == 0, F.col("run"))), F.lit(0)).alias("head"), F.max_by("run", "island").alias("tail"), (F.max("island") > 0).cast("int").alias("broken"))
    months = Window.partitionBy("kol").orderBy("month")
    m = m.withColumn("chain", F.sum("broken").over(months))
    # a month of losses only lengthens the run that the months before it ended with
    m = m.withColumn("open", F.sum("tail").over(Window.partitionBy("kol", "chain").orderBy("month")))
    m = m.withColumn("joint", F.col("head") + F.coalesce(F.lag("open").over(months), F.lit(0)))
    return m.groupBy("kol").agg(F.max(F.greatest("most", "open", "joint")).alias("max_losses"))


def backtest_metrics(totals: DataFrame) -> DataFrame:
    """Per creator: volatility, Sharpe, value at risk and expected shortfall of daily returns (pnl over the day's own total)."""
    r = totals.withColumn("r", F.col("pnl") / F.col("total"))
    q = r.groupBy("kol").agg(F.percentile("r", F.lit(0.05)).alias("var"))
    j = r.join(q, "kol")
    m = j.groupBy("kol").agg(F.count("*").alias("days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("es"))
    year = F.sqrt(F.lit(252.0))
    return m.select("kol", "days", F.round(F.col("sd") * year, 6).alias("volatility"), F.round(F.try_divide("mean", "sd") * year, 4).alias("sharpe"), F.round("var", 6).alias("value_at_risk"), F.round("es", 6).alias("expected_shortfall"))


def trade_attribution(trades: DataFrame) -> DataFrame:
    """Per creator: trades, win rate, profit factor (null without losses), mean win, loss and holding time."""
    won, lost = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    gain, loss = F.sum(F.when(won, F.col("net_pnl")).otherwise(0.0)), F.sum(F.when(lost, -F.col("net_pnl")).otherwise(0.0))
    return trades.groupBy("kol").agg(
        F.count("*").alias("n"), F.round(F.count_if(won) / F.count("*"), 4).alias("win_rate"), F.round(F.try_divide(gain, loss), 4).alias("profit_factor"),
        F.round(F.avg(F.when(won, F.col("net_pnl"))), 2).alias("avg_win"), F.round(F.avg(F.when(lost, F.col("net_pnl"))), 2).alias("avg_loss"),
        F.round(F.avg("holding_days"), 2).alias("avg_days"),
    )


def equity_snapshots(curve: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """An equity curve (kol, day, total) with its running peak and the day's gain; the first day counts from ``start``."""
    order = Window.partitionBy("kol").orderBy("day")
    gain = F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(start))
    return curve.select("kol", "day", "total", F.max("total").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), (F.rint(gain * 100) / 100).alias("pnl"))
