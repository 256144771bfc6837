"""Banded creator scores of settled actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a score must exceed for 5, 4, 3 and 2, and the weights of the whole.
ACCURACY = (0.70, 0.60, 0.50, 0.40)
LEAD_DAYS = (5, 3, 1, 0)
RETURN_PCT = (30, 15, 5, 0)
CONSISTENCY = (0.85, 0.70, 0.55, 0.40)
WEIGHTS = {"accuracy": 0.30, "timeliness": 0.20, "return_score": 0.30, "consistency": 0.20}
FULL_SAMPLE = 30


def _band(value: Column, borders: tuple) -> Column:
    """5 to 1 by the borders; 3 where there is no value."""
    band = F.when(value.isNull(), 3.0)
    for score, border in zip((5.0, 4.0, 3.0, 2.0), borders):
        band = band.when(value > border, score)
    return band.otherwise(1.0)


def creator_bands(actions: DataFrame) -> DataFrame:
    """Per creator: four scores of 1 to 5, their weighted whole, confidence and the number of actions.

    ``actions`` has creator_id, ticker, direction, clock, action_id, return_pct and holding_days; a missing return counts as 0,
    a missing holding as 10 days.  Turns are counted along one creator's actions on one ticker; all else is summed before the shuffle."""
    a = actions.select("creator_id", "ticker", "direction", "clock", "action_id", F.coalesce("return_pct", F.lit(0.0)).alias("r"), F.coalesce("holding_days", F.lit(10)).alias("days"))
    order = Window.partitionBy("creator_id", "ticker").orderBy("clock", "action_id")
    before = F.lag(F.struct("direction")).over(order)
    a = a.withColumn("turned", before.isNotNull() & ~before["direction"].eqNullSafe(F.col("direction")))
    each = a.groupBy("creator_id", "ticker").agg(
        F.count("*").alias("n"), F.count_if("turned").alias("turns"), F.count_if(F.col("r") > 0).alias("right"),
        F.sum(F.greatest(F.lit(0), 10 - F.col("days"))).alias("lead"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"),
    )
    steady = F.when(F.col("n") > 1, 1 - F.col("turns") / (F.col("n") - 1))
    k = each.groupBy("creator_id").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("lead").alias("lead"), F.sum("r").alias("r"), F.sum("rr").alias("rr"), F.avg(steady).alias("steady"))
    mean = F.col("r") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("rr") / F.col("n") - mean * mean))
    varies = F.when(F.abs(mean) > 0.01, spread / F.abs(mean)).otherwise(10.0)
    bonus = F.when(F.col("n") < 2, 0.0).when(varies < 1, 0.2).when(varies < 2, 0.1).otherwise(0.0)
    steady = F.when(F.col("n") >= 3, F.least(F.lit(1.0), F.col("steady") + bonus))
    s = k.select(
        "creator_id", _band(F.col("right") / F.col("n"), ACCURACY).alias("accuracy"), _band(F.col("lead") / F.col("n"), LEAD_DAYS).alias("timeliness"),
        _band(mean * 100, RETURN_PCT).alias("return_score"), _band(steady, CONSISTENCY).alias("consistency"), "n",
    )
    whole = sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return s.select("creator_id", *WEIGHTS, F.round(whole, 2).alias("overall"), F.round(F.least(F.lit(1.0), F.col("n") / FULL_SAMPLE), 4).alias("confidence"), "n")
