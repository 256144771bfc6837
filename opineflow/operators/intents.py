"""Intents: duplicates, contradictions, votes over runs, rule tables, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET = ["content_id", "target"]


def merge_intents(intents: DataFrame) -> DataFrame:
    """One intent per content, target, direction and delta: evidence united, highest conviction and confidence, first known horizon."""
    known = F.when(F.col("horizon").isNotNull(), F.col("intent_id"))
    return intents.groupBy(*TARGET, "direction", "delta").agg(
        F.min("intent_id").alias("intent_id"), F.array_join(F.array_sort(F.collect_set("span")).cast("array<string>"), ",").alias("spans"),
        F.max("conviction").alias("conviction"), F.max("confidence").alias("confidence"), F.min_by("horizon", known).alias("horizon"),
    )


def collapse_contradictions(intents: DataFrame) -> DataFrame:
    """Where a target has several directions only its strongest intent stays (conviction, confidence, first id), flagged."""
    whole = Window.partitionBy(*TARGET)
    strongest = whole.orderBy(F.desc("conviction"), F.desc("confidence"), "intent_id")
    clash = F.min("direction").over(whole) != F.max("direction").over(whole)
    ranked = intents.select(*TARGET, "intent_id", "direction", clash.alias("collapsed"), F.count("*").over(whole).alias("n"), F.row_number().over(strongest).alias("place"))
    return ranked.where(~F.col("collapsed") | (F.col("place") == 1)).drop("place")


def consensus(intents: DataFrame, runs: int) -> DataFrame:
    """Directions that most runs found; a target with bullish and bearish votes needs all runs to agree."""
    votes = intents.groupBy(*TARGET, "direction").agg(F.count_distinct("run").alias("votes"), F.max(F.struct("confidence", "conviction", "intent_id")).alias("best"))
    opposed = F.count_if(F.col("direction").isin("bullish", "bearish")).over(Window.partitionBy(*TARGET)) == 2
    needed = F.when(opposed, runs).otherwise(runs // 2 + 1)
    return votes.withColumn("needed", needed).where("votes >= needed").select(*TARGET, "direction", "votes", "best.intent_id", "best.confidence")


def first_of_duplicates(actions: DataFrame) -> DataFrame:
    """Actions of one creator, ticker, direction and day are the same: the first stays; counted before the shuffle."""
    return actions.groupBy("creator_id", "ticker", "direction", F.col("clock").cast("date").alias("day")).agg(F.min("action_id").alias("action_id"), F.count("*").alias("copies"))


def apply_rules(rows: DataFrame, rules: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """``rows`` with ``value`` of the most specific rule: each level names the keys that must match, a rule's other keys being null."""
    keys = sorted({k for level in levels for k in level})
    for i, level in enumerate(levels):
        fits = rules.where(" and ".join(f"{k} is {'not ' if k in level else ''}null" for k in keys))
        side = fits.groupBy(*[F.col(k).alias(f"__{k}") for k in level]).agg(F.min(value).alias(f"__{value}{i}"))
        rows = rows.join(side, [F.col(k) == F.col(f"__{k}") for k in level], "left").drop(*[f"__{k}" for k in level])
    found = [f"__{value}{i}" for i in range(len(levels))]
    return rows.withColumn(value, F.coalesce(*found)).drop(*found)


def broken_traces(actions: DataFrame, spans: DataFrame, intents: DataFrame, policies: DataFrame) -> DataFrame:
    """Per break code the actions whose intent, policy or any evidence span can't be found.

    actions (action_id, intent_id), spans (action_id, span_id, policy_id), intents (intent_id), policies (policy_id)."""
    known = policies.select(F.col("policy_id").alias("__p"), F.lit(True).alias("__ok"))
    whole = spans.join(known, F.col("policy_id") == F.col("__p"), "left").groupBy(F.col("action_id").alias("__a")).agg(F.every(F.coalesce("__ok", F.lit(False))).alias("resolved"))
    found = intents.select(F.col("intent_id").alias("__i"), F.lit(True).alias("has_intent"))
    checked = actions.join(found, F.col("intent_id") == F.col("__i"), "left").join(whole, F.col("action_id") == F.col("__a"), "left")
    code = F.when(F.col("has_intent").isNull(), "intent_missing").when(F.col("resolved").isNull(), "no_evidence").when(~F.col("resolved"), "span_unresolved").otherwise("ok")
    return checked.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
