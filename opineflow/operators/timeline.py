"""Timelines, stances, episodes and flips over a table of dated actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The direction domain.
DIRECTIONS = ("bullish", "bearish", "neutral", "watchlist", "risk_warning")


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def timeline_summary(actions: DataFrame) -> DataFrame:
    """Per creator: direction counts, sorted distinct tickers, clock range, mean confidence, settled counts."""
    return actions.groupBy("creator_id").agg(
        F.count("*").alias("total"), *[_count_if(F.col("direction") == d, f"n_{d}") for d in DIRECTIONS],
        F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"),
        F.min("clock").alias("first_at"), F.max("clock").alias("last_at"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        _count_if(F.col("status") == "verified", "verified"), _count_if(F.col("status") == "pending", "pending"),
    )


def timeline_page(actions: DataFrame, creator_id: str, directions: list[str], least_confidence: float, limit: int, offset: int = 0) -> DataFrame:
    """A page of a creator's filtered timeline, newest first (ties: larger id first)."""
    found = actions.where((F.col("creator_id") == creator_id) & F.col("direction").isin(directions) & (F.col("confidence") >= least_confidence))
    return found.orderBy(F.desc("clock"), F.desc("action_id")).offset(offset).limit(limit)


def top_per_creator(actions: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("creator_id").orderBy(F.desc("clock"), F.desc("action_id"))
    return actions.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def distinct_values(actions: DataFrame, column: str) -> DataFrame:
    return actions.where(F.col(column).isNotNull()).select(column).distinct()


def opinion_stats(actions: DataFrame, by: str) -> DataFrame:
    """Buckets of one dimension: rows, mean confidence, success rate of those settled (null if none)."""
    won, lost = F.count_if(F.col("status") == "verified"), F.count_if(F.col("status") == "failed")
    return actions.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.try_divide(won, won + lost), 4).alias("success_rate"))


def top_values(actions: DataFrame, by: str, k: int) -> DataFrame:
    return opinion_stats(actions, by).orderBy(F.desc("n"), by).limit(k)


def latest_stance(actions: DataFrame, stance_key: str = "ticker") -> DataFrame:
    """The last action of each creator and stance slot; partial maxima are taken before the shuffle."""
    last = F.max_by(F.struct("action_id", "direction", "clock"), F.struct("clock", "action_id"))
    return actions.groupBy("creator_id", stance_key).agg(last.alias("s")).select("creator_id", stance_key, "s.*")


def _with_turns(actions: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy("creator_id", key).orderBy("clock", "action_id")
    before = F.lag("direction").over(order)
    return actions.withColumn("before", before).withColumn("turn", F.when(before.isNull() | (before != F.col("direction")), 1).otherwise(0))


def stance_episodes(actions: DataFrame, key: str = "ticker") -> DataFrame:
    """Runs of one direction: anchor action, range, restatements, and whether the run still stands."""
    order = Window.partitionBy("creator_id", key).orderBy("clock", "action_id")
    runs = _with_turns(actions, key).withColumn("episode", F.sum("turn").over(order).cast("int"))
    runs = runs.groupBy("creator_id", key, "episode").agg(
        F.min_by("direction", F.struct("clock", "action_id")).alias("direction"), F.min_by("action_id", F.struct("clock", "action_id")).alias("anchor_id"),
        F.min("clock").alias("opened_at"), F.max("clock").alias("last_at"), (F.count("*") - 1).alias("restatements"),
    )
    last = F.max("episode").over(Window.partitionBy("creator_id", key))
    return runs.withColumn("standing", F.col("episode") == last)


def stance_flips(actions: DataFrame, key: str = "ticker") -> DataFrame:
    """Consecutive actions on a ticker whose direction differs."""
    return _with_turns(actions, key).where("before is not null and turn = 1").select("creator_id", key, "action_id", "clock", F.col("before").alias("from_direction"), F.col("direction").alias("to_direction"))


def stance_diff(actions: DataFrame, cut) -> DataFrame:
    """Changes of the latest stances before and after a moment: flips, and new calls of creators known before."""
    cut = F.lit(cut).cast("timestamp_ntz")
    old = latest_stance(actions.where(F.col("clock") < cut)).select("creator_id", "ticker", F.col("direction").alias("old_direction"))
    new = latest_stance(actions).select("creator_id", "ticker", "action_id", F.col("direction").alias("new_direction"))
    known = old.select("creator_id").distinct()
    both = new.join(known, "creator_id", "left_semi").join(old, ["creator_id", "ticker"], "left")
    kind = F.when(F.col("old_direction").isNull(), "new_call").when(F.col("old_direction") != F.col("new_direction"), "flip")
    return both.withColumn("change", kind).where("change is not null")


def shared_tickers(actions: DataFrame) -> DataFrame:
    """Pairs of creators: tickers both cover, and the share of those on which their latest directions agree."""
    # creators per ticker are few by nature; latest stances bound the join to creators squared per ticker
    s = latest_stance(actions).select("creator_id", "ticker", "direction")
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.creator_id") < F.col("b.creator_id")))
    same = F.count_if(F.col("a.direction") == F.col("b.direction"))
    return pairs.groupBy(F.col("a.creator_id").alias("left_id"), F.col("b.creator_id").alias("right_id")).agg(F.count("*").alias("shared"), F.round(same / F.count("*"), 4).alias("overlap"))


def consistency(actions: DataFrame) -> DataFrame:
    """100 x the mean over tickers of 1 - weighted turn rate; bull to bear weighs 1, to or from neutral 0.3."""
    views = actions.where(F.col("direction").isin("bullish", "bearish", "neutral"))
    t = _with_turns(views, "ticker")
    weight = F.when(F.col("before").isNull() | (F.col("before") == F.col("direction")), 0.0).when((F.col("before") == "neutral") | (F.col("direction") == "neutral"), 0.3).otherwise(1.0)
    each = t.groupBy("creator_id", "ticker").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).where("n >= 2")
    each = each.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("w") / (F.col("n") - 1)))
    return each.groupBy("creator_id").agg(F.round(100 * F.avg("score"), 2).alias("consistency"))


def action_meta(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count("*").alias("total"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("creator_id").alias("creators"), F.min("clock").alias("first_at"), F.max("clock").alias("last_at"))


def direction_cosine(actions: DataFrame) -> DataFrame:
    """Cosine of two creators' latest directions (1 and -1) over all tickers; pairs that share a directional ticker."""
    sign = F.when(F.col("direction") == "bullish", 1).when(F.col("direction").isin("bearish", "risk_warning"), -1)
    v = latest_stance(actions).select("creator_id", "ticker", sign.alias("s")).where("s is not null")
    size = v.groupBy("creator_id").agg(F.count("*").alias("n"))
    x, y = v.select(F.col("creator_id").alias("left_id"), "ticker", F.col("s").alias("a")), v.select(F.col("creator_id").alias("right_id"), "ticker", F.col("s").alias("b"))
    dot = x.join(y, "ticker").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    l, r = size.select(F.col("creator_id").alias("left_id"), F.col("n").alias("nl")), size.select(F.col("creator_id").alias("right_id"), F.col("n").alias("nr"))
    return dot.join(l, "left_id").join(r, "right_id").select("left_id", "right_id", F.round(F.col("dot") / F.sqrt(F.col("nl") * F.col("nr")), 6).alias("cosine"))
