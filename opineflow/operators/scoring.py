"""Scores, bands, alerts and training exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perf_alerts(samples: DataFrame, operation: str, value: str, warn: float, critical: float) -> DataFrame:
    """Samples over budget per operation and level."""
    level = F.when(F.col(value) > critical, "critical").when(F.col(value) > warn, "warning").otherwise("ok")
    return samples.groupBy(operation, level.alias("level")).agg(F.count("*").alias("n"))


def failure_rate(events: DataFrame, threshold: float) -> DataFrame:
    """Daily share of failures and whether it is over the threshold."""
    rate = F.count_if(F.col("event_type") == "error") / F.count("*")
    return events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(rate, 4).alias("rate"), (rate > threshold).alias("alert"))


def sizing_bands(actions: DataFrame) -> DataFrame:
    """Position size by conviction: under .35 small, under .70 medium, else large; only directional views are sized."""
    directional = F.col("direction").isin("bullish", "bearish")
    band = F.when(~directional, "none").when(F.col("confidence") < 0.35, "small").when(F.col("confidence") < 0.70, "medium").otherwise("large")
    tier = F.when(F.col("time_horizon") == "short_term", 30).when(F.col("time_horizon") == "medium_term", 90).otherwise(180)
    return actions.groupBy("direction", band.alias("size_band"), tier.alias("window_days")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def sentiment_fusion(events: DataFrame) -> DataFrame:
    """Per user and day: weighted mean of the sources present, classed at +-0.15."""
    sources = {"purchase": 0.4, "view": 0.2, "click": 0.4}
    scaled = F.least(F.lit(1.0), F.col("value") / 250) * 2 - 1
    each = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*[F.avg(F.when(F.col("event_type") == s, scaled)).alias(s) for s in sources])
    total = sum((F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0) for s, w in sources.items()), F.lit(0.0))
    mean = sum((F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in sources.items()), F.lit(0.0))
    score = F.round(F.try_divide(mean, F.when(total > 0, total)), 6)
    each = each.select("user_id", "day", score.alias("score")).where("score is not null")
    return each.withColumn("class", F.when(F.col("score") > 0.15, "bullish").when(F.col("score") < -0.15, "bearish").otherwise("neutral"))


def quality_gate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Gate decision from readability, completeness and labels: reject, review or pass."""
    d = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    complete = F.least(F.lit(1.0), F.char_length("text") / 1000)
    score = F.round(0.5 * complete + 0.5 * F.coalesce(F.col("quality"), F.lit(0)), 4)
    gate = F.when(F.col("toxic") == 1, "reject").when(score < 0.3, "reject").when(score < 0.7, "review").otherwise("pass")
    return d.select("doc_id", score.alias("score"), gate.alias("gate"))


def feedback(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(labels, "doc_id").select("doc_id", "lang", (1 + F.col("doc_id") % 5).cast("int").alias("rating"), F.col("quality").cast("int").alias("ticker_correct"), (1 - F.col("toxic")).cast("int").alias("direction_correct"))


def rlhf_stats(rows: DataFrame, spark) -> DataFrame:
    """A row per rating 1..5, empty ones too: items, accuracies, share usable for preference pairs."""
    scale = spark.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    each = rows.groupBy("rating").agg(F.count("*").alias("n"), F.round(F.avg("ticker_correct"), 4).alias("ticker_accuracy"), F.round(F.avg("direction_correct"), 4).alias("direction_accuracy"), F.count_if((F.col("rating") >= 4) | (F.col("rating") <= 2)).alias("dpo_ready"))
    return scale.join(each, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"), "ticker_accuracy", "direction_accuracy", F.coalesce("dpo_ready", F.lit(0)).alias("dpo_ready"))


def preference_pairs(rows: DataFrame, least_margin: int = 2) -> DataFrame:
    """Best and worst item of each language, where the best leads by the margin."""
    best, worst = F.max(F.struct("rating", (-F.col("doc_id")).alias("k"))).alias("b"), F.min(F.struct("rating", "doc_id")).alias("w")
    p = rows.groupBy("lang").agg(best, worst)
    return p.select("lang", (-F.col("b.k")).alias("chosen"), F.col("w.doc_id").alias("rejected"), (F.col("b.rating") - F.col("w.rating")).alias("margin")).where(F.col("margin") >= least_margin)
