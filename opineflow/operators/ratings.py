"""Creator ratings, rankings and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opineflow.operators.scorers import turns


def accuracy_rating(views: DataFrame) -> DataFrame:
    """Of validated views (kol, direction, right_7d, right_30d, excess): weighted accuracy within 0 and 100, and stars.

    A right call is worth 100, its excess return up to 20 either way, being right after 30 days 10; directional views weigh half as much again."""
    weight = F.when(F.col("direction").isin("bullish", "bearish"), 1.5).otherwise(1.0)
    points = F.col("right_7d").cast("int") * 100 + F.coalesce("right_30d", F.lit(False)).cast("int") * 10 + F.greatest(F.lit(-20.0), F.least(F.lit(20.0), 2 * F.coalesce("excess", F.lit(0.0))))
    each = views.where("right_7d is not null").groupBy("kol").agg(F.count("*").alias("views"), (F.sum(points * weight) / F.sum(weight)).alias("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), "raw"))
    stars = F.when(score >= 90, 5).when(score >= 75, 4).when(score >= 60, 3).when(score >= 40, 2).otherwise(1)
    return each.select("kol", "views", F.round(score, 3).alias("accuracy"), stars.alias("stars"))


def backtest_rating(attribution: DataFrame, metrics: DataFrame) -> DataFrame:
    """0.6 of five times the win rate and 0.4 of the Sharpe ratio around 2.5, held within 0 and 5."""
    m = metrics.select(F.col("kol").alias("__k"), "sharpe")
    around = F.greatest(F.lit(0.0), F.least(F.lit(5.0), 2.5 + F.coalesce("sharpe", F.lit(0.0))))
    return attribution.join(m, F.col("kol") == F.col("__k"), "left").select("kol", F.round(3 * F.col("win_rate") + 0.4 * around, 3).alias("rating"))


def rank_strategies(trades: DataFrame, capital: float) -> DataFrame:
    """Strategies by total return; ranks are made of one row a strategy."""
    each = trades.groupBy("kol").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl") / capital, 6).alias("total_return"))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_return"), "kol"))).withColumn("best", F.col("rank") == 1)


def sign_alternation(trades: DataFrame, *order: str) -> DataFrame:
    """Share of neighbouring returns with opposite signs, per creator (null of a single one); null returns do not count.

    ``order``, a date first, must tell all rows of a creator apart."""
    t = turns(trades.where("return_pct is not null"), ["kol"], "return_pct", order[0], list(order[1:]), lambda a, b: (a * b < 0).cast("int"))
    return t.select("kol", F.round(F.try_divide("cost", F.col("n") - 1), 4).alias("alternation"))


def budget_breaker(events: DataFrame, budget: int) -> DataFrame:
    """Per type: items done until their cents reach the budget, and the item that trips the breaker.

    Days are summed first; only the day on which a type's budget runs out is put in order, one a type."""
    e = events.select("event_id", "event_type", "ts", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    upto = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = e.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    days = days.withColumns({"spent": F.sum("cents").over(upto), "seen": F.sum("n").over(upto)})
    total = days.groupBy("event_type").agg(F.sum("n").alias("all"), F.min_by(F.struct("day", (F.col("spent") - F.col("cents")).alias("before"), (F.col("seen") - F.col("n")).alias("done_before")), F.when(F.col("spent") >= budget, F.col("day"))).alias("last"))
    last = total.select("event_type", "last.*").where("day is not null")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    on_day = e.join(F.broadcast(last), ["event_type", "day"]).withColumn("spent", F.col("before") + F.sum("cents").over(order))
    over = F.col("spent") >= budget
    trip = on_day.groupBy("event_type").agg((F.first("done_before") + F.count_if(~over) + 1).alias("tripped_at"), F.min_by("event_id", F.when(over, F.struct("ts", "event_id"))).alias("tripped_by"))
    return total.join(trip, "event_type", "left").select("event_type", F.coalesce("tripped_at", "all").alias("done"), "tripped_by")


def group_rates(rows: DataFrame, by: str, **flags: str) -> DataFrame:
    """Per group the share of rows of which each flag expression holds (null flags left out; null without any)."""
    shares = [F.round(F.try_divide(F.count_if(F.expr(e)), F.count(F.expr(e))), 4).alias(name) for name, e in flags.items()]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *shares)
