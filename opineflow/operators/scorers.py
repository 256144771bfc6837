"""Scores of creators, quality cards and crowd sentiment, by fixed weights and borders."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the five scores of trades and opinions, and the names of the whole.
SCORE_WEIGHTS = {"accuracy": 0.30, "timeliness": 0.15, "return_score": 0.30, "consistency": 0.15, "depth": 0.10}
RECENT_DAYS = 90
GRADES = ((4.5, "excellent"), (3.5, "good"), (2.5, "average"), (1.5, "below_average"))
# Weights of the five scores of views, what a whole must reach for its stars, words of risk.
RATING_WEIGHTS = {"accuracy": 0.35, "stop_loss_quality": 0.25, "consistency": 0.20, "market_sensitivity": 0.10, "risk_awareness": 0.10}
STARS = ((90, 5, "gold"), (75, 4, "silver"), (60, 3, "bronze"), (40, 2, "none"))
RISK_WORDS = ("risk", "caution", "volatile", "uncertain", "stop loss", "position size")
# The dimensions of a quality card, and weights of the crowd's sources.
CARD = ("readability", "semantic_completeness", "financial_relevance", "entity_resolution", "temporal_resolution", "evidence_traceability")
SOURCES = {"reddit": 0.25, "twitter": 0.25, "news": 0.35, "polymarket": 0.15}


def _bands(value: Column, steps: tuple, rest: float, reaches: bool = False) -> Column:
    """The score of the first border that ``value`` exceeds (or reaches)."""
    out = None
    for border, score in steps:
        hit = value >= border if reaches else value > border
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(rest)


def _held(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def turns(rows: DataFrame, keys: list[str], value: str, at: str, ties: list[str], cost) -> DataFrame:
    """Per key: rows as n, and the cost of all neighbouring values, ``cost(before, now)`` an integer column.

    Rows are put in order within a month; months meet by one row each, so that a long history is many tasks."""
    order = Window.partitionBy(*keys, "__month").orderBy(at, *ties)
    place = F.struct(F.col(at).isNotNull(), at, *ties)  # rows without a time come first, as in the window
    r = rows.withColumn("__month", F.trunc(at, "MM")).withColumn("__seen", F.lag(F.struct(value)).over(order))
    r = r.withColumn("__cost", F.when(F.col("__seen").isNotNull(), cost(F.col("__seen")[value], F.col(value))).otherwise(0))
    months = r.groupBy(*keys, "__month").agg(F.count("*").alias("n"), F.sum("__cost").alias("cost"), F.min_by(F.struct(value), place).alias("first"), F.max_by(F.struct(value), place).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("__month"))
    months = months.withColumn("before", before)
    joint = F.when(F.col("before").isNotNull(), cost(F.col("before")[value], F.col("first")[value])).otherwise(0)
    return months.withColumn("joint", joint).groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("cost") + F.sum("joint")).alias("cost"))


def creator_scores(trades: DataFrame, opinions: DataFrame, now: dt.datetime, at: str = "clock", ties: tuple[str, ...] = ("trade_id",), weights: dict[str, float] = SCORE_WEIGHTS, recent_days: int = RECENT_DAYS) -> DataFrame:
    """Per creator of either table: five scores within 0 and 5, their weighted whole, its grade and the number of trades.

    ``trades``: creator_id, return_pct (null: 0), holding_days (null: 10), ``at`` and ``ties``, which tell a creator's rows apart.
    ``opinions``: creator_id, clock (null: not recent), confidence (null: a half), rationale (null or empty: none); may be empty.
    Without trades four scores are 2.5; a null creator is one of its own.  Weights are scaled to one."""
    t = trades.select("creator_id", at, *ties, F.coalesce("return_pct", F.lit(0.0)).alias("r"), F.coalesce(F.col("holding_days").cast("double"), F.lit(10.0)).alias("days"))
    t = t.withColumn("up", F.col("r") > 0)
    swaps = turns(t, ["creator_id"], "up", at, list(ties), lambda a, b: (a != b).cast("int"))
    sums = t.groupBy("creator_id").agg(F.count_if("up").alias("wins"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("spread"), (F.min("r") == F.max("r")).alias("flat"), F.avg("days").alias("days"))
    o = opinions.select("creator_id", (F.col("clock") > F.lit(now - dt.timedelta(days=recent_days))).alias("recent"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), (F.coalesce(F.col("rationale"), F.lit("")) != "").alias("reasoned"))
    o = o.groupBy(F.col("creator_id").alias("by")).agg(F.count("*").alias("said"), F.count_if("recent").alias("fresh"), F.avg("confidence").alias("confidence"), F.count_if("reasoned").alias("reasoned"))
    k = sums.join(swaps.withColumnRenamed("creator_id", "same"), F.col("creator_id").eqNullSafe(F.col("same"))).drop("same")
    k = k.join(o, F.col("creator_id").eqNullSafe(F.col("by")), "full").withColumn("creator_id", F.coalesce("creator_id", "by"))
    n, mean, days = F.col("n"), F.col("mean"), F.col("days")
    spread = F.when(F.col("flat"), 0.0).otherwise(F.col("spread"))
    timely = F.when(days <= 5, 5.0).when(days <= 15, 5.0 - (days - 5) * 0.2).otherwise(F.greatest(F.lit(1.0), 3.0 - (days - 15) * 0.1))
    timely = timely * F.coalesce(0.7 + 0.3 * F.col("fresh") / F.col("said"), F.lit(1.0))
    sharpe = F.coalesce(F.try_divide(mean, spread), F.lit(0.0))
    gain = _bands(mean * 100, ((10, 5.0), (5, 4.0), (0, 3.0), (-5, 2.0)), 1.0)
    gain = F.when(sharpe > 2, F.least(F.lit(5.0), gain + 0.5)).when(sharpe < 0, F.greatest(F.lit(1.0), gain - 0.5)).otherwise(gain)
    varies = F.when(F.abs(mean) > 0.01, spread / F.abs(mean)).otherwise(10.0)
    steady = F.when(varies < 1, 5.0).when(varies < 2, 4.0).when(varies < 3, 3.0).when(varies < 5, 2.0).otherwise(1.0)
    steady = F.when(F.col("cost") / (n - 1) > 0.8, F.greatest(F.lit(1.0), steady - 1)).otherwise(steady)
    depth = F.when(F.col("said").isNull(), _bands(n, ((50, 5.0), (20, 4.0), (10, 3.0)), 2.0, reaches=True))
    depth = depth.otherwise(F.least(F.lit(5.0), F.col("confidence") * 5 + F.col("reasoned") / F.col("said") * 0.5))
    traded = lambda score, least=1: F.when(n >= least, score).otherwise(2.5)
    scores = {"accuracy": traded(F.col("wins") / n * 5), "timeliness": traded(timely), "return_score": traded(gain), "consistency": traded(steady, 3), "depth": depth}
    k = k.select("creator_id", *[c.alias(name) for name, c in scores.items()], F.coalesce("n", F.lit(0)).alias("n"))
    overall = sum((F.col(name) * (w / sum(weights.values())) for name, w in weights.items()), F.lit(0.0))
    k = k.withColumn("whole", overall)
    return k.select("creator_id", *[F.round(c, 4).alias(c) for c in scores], F.round("whole", 4).alias("overall"), _bands(F.round("whole", 9), GRADES, "poor", reaches=True).alias("grade"), "n")


def creator_ratings(views: DataFrame, triggers: DataFrame, validations: DataFrame) -> DataFrame:
    """Per creator with views: five scores within 0 and 100, their whole, stars, medal and counts.

    ``views``: kol, view_id, ticker, direction, view_date, rationale; ``triggers``: view_id, trigger (a view's conditions);
    ``validations``: view_id, validation_id, right_7d, right_30d, return_7d, excess (null: 0).  Directions come from the views;
    validations without right_7d count nowhere but in the stop losses, where a view's first validation does.  Nulls in texts are empty."""
    words = lambda c: F.lower(F.coalesce(c, F.lit("")))
    stops = triggers.where(words(F.col("trigger")).rlike("stop|loss")).select(F.col("view_id").alias("stop_view")).distinct()
    v = views.select("kol", "view_id", "ticker", F.coalesce("direction", F.lit("neutral")).alias("direction"), "view_date", words(F.col("rationale")).rlike("|".join(RISK_WORDS)).alias("risky"))
    v = v.join(stops, F.col("view_id") == F.col("stop_view"), "left").withColumn("stop", F.col("stop_view").isNotNull()).drop("stop_view")
    r7, right = F.coalesce("return_7d", F.lit(0.0)), F.col("right_7d")
    directed = F.col("direction").isin("bullish", "bearish")
    checks = validations.select(F.col("view_id").alias("of"), "validation_id", "right_7d", "right_30d", r7.alias("return_7d"), F.coalesce("excess", F.lit(0.0)).alias("excess"))
    points = right.cast("int") * 100 + F.coalesce("right_30d", F.lit(False)).cast("int") * 10 + _held(2 * F.col("excess"), -20, 20)
    weight = F.when(directed, 1.5).otherwise(1.0)
    early = F.when((F.col("direction") == "bullish") & (F.col("return_7d") > 5), 2).when((F.col("direction") == "bearish") & (F.col("return_7d") < -5), 2).when((F.col("direction") == "neutral") & (F.abs("return_7d") < 3), 1).otherwise(0)
    checked = checks.where("right_7d is not null").join(v.select("kol", "view_id", "direction"), F.col("of") == F.col("view_id"))
    checked = checked.groupBy(F.col("kol").alias("k1")).agg(F.count("*").alias("validated"), (F.sum(points * weight) / F.sum(weight)).alias("points"), F.sum(early).alias("early"))
    first = checks.groupBy("of").agg(F.min_by("return_7d", "validation_id").alias("first_7d"))
    timely = v.where("stop").join(first, F.col("of") == F.col("view_id")).where("first_7d < -5").groupBy(F.col("kol").alias("k2")).agg(F.count("*").alias("timely"))
    named = v.where("ticker is not null and ticker <> ''")
    # tenths: between bullish and bearish 10, from or to neutral 3
    opposed = lambda a, b: ((a == "bullish") & (b == "bearish")) | ((a == "bearish") & (b == "bullish"))
    cost = lambda a, b: F.when(opposed(a, b), 10).when((a != b) & ((a == "neutral") | (b == "neutral")), 3).otherwise(0)
    each = turns(named, ["kol", "ticker"], "direction", "view_date", ["view_id"], cost)
    each = each.groupBy(F.col("kol").alias("k3")).agg(F.avg(F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - F.col("cost") / 10 / (F.col("n") - 1)))).alias("steady"))
    warned = F.col("direction") == "risk_warning"
    k = v.groupBy("kol").agg(F.count("*").alias("views"), F.count_if("stop").alias("stops"), F.count_if(warned).alias("warnings"), F.count_if(warned | F.col("risky") | F.col("stop")).alias("aware"))
    for more, key in ((checked, "k1"), (timely, "k2"), (each, "k3")):
        k = k.join(more, F.col("kol").eqNullSafe(F.col(key)), "left")
    n, zero = F.col("views"), lambda c: F.coalesce(F.col(c), F.lit(0))
    stop_score = F.when(F.col("stops") == 0, F.least(F.lit(50.0), F.col("warnings") * 5.0)).otherwise(F.least(F.lit(40.0), F.col("stops") / n * 100) + zero("timely") / F.col("stops") * 60)
    scores = {
        "accuracy": F.coalesce(_held(F.col("points"), 0, 100), F.lit(0.0)), "stop_loss_quality": F.least(F.lit(100.0), stop_score),
        "consistency": F.when(F.col("k3").isNull(), 50.0).otherwise(F.coalesce(F.col("steady") * 100, F.lit(100.0))),
        "market_sensitivity": F.coalesce(_held(F.col("early") / 2 / F.col("validated") * 150, 0, 100), F.lit(50.0)),
        "risk_awareness": F.least(F.lit(100.0), F.col("aware") / n * 80 + F.least(F.lit(20), F.col("warnings") * 5)),
    }
    k = k.select("kol", "views", zero("validated").alias("validated"), *[c.alias(name) for name, c in scores.items()])
    k = k.withColumn("whole", F.round(sum((F.col(name) * w for name, w in RATING_WEIGHTS.items()), F.lit(0.0)), 9))
    stars = lambda i, rest: _bands(F.col("whole"), tuple((s[0], s[i]) for s in STARS), rest, reaches=True)
    return k.select("kol", "views", "validated", *[F.round(c, 3).alias(c) for c in scores], F.round("whole", 2).alias("total"), stars(1, 1).alias("stars"), stars(2, "none").alias("medal"))


@dataclass(frozen=True)
class GatePolicy:
    """Borders of the gate."""

    passes: float = 0.75
    reviews: float = 0.45
    financial: float = 0.6
    evidence: float = 0.6
    reject_financial: float = 0.3
    critical: float = 0.3
    warn: float = 0.5


POLICIES = {"default": GatePolicy(), "strict": GatePolicy(0.85, 0.55, 0.7, 0.7, 0.35, 0.4, 0.6), "lenient": GatePolicy(0.65, 0.35, 0.5, 0.5, 0.25, 0.25, 0.4)}


def gate_decisions(cards: DataFrame, policy: GatePolicy = POLICIES["default"]) -> DataFrame:
    """The cards' columns with score, gate (pass, review, reject), reasons, next_step, critical and weakest.

    A card has the six dimensions of ``CARD``, within 0 and 1.  A card with a null has no score: it is for review, its reason ``incomplete``."""
    d = {name: F.col(name) for name in CARD}
    score = F.rint(sum(d.values(), F.lit(0.0)) / len(CARD) * 100) / 100
    below = {name: d[name] < policy.critical for name in CARD[:3]}
    critical = sum((b.cast("int") for b in below.values()), F.lit(0))
    reason = lambda name, kind: F.lit(f"{name}:{kind}")
    reasons = [F.when(below[name], reason(name, "critical")) for name in CARD[:2]]
    reasons.append(F.when(below[CARD[2]], reason(CARD[2], "critical")).when(d[CARD[2]] < policy.financial, reason(CARD[2], "pass")))
    reasons += [F.when(d[name] < policy.warn, reason(name, "warning")) for name in CARD[3:5]]
    reasons.append(F.when(d[CARD[5]] < policy.warn, reason(CARD[5], "warning")).when(d[CARD[5]] < policy.evidence, reason(CARD[5], "pass")))
    c = cards.withColumns({"score": score, "critical": critical, "reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull())})
    rejected = (F.col("score") < policy.reviews) & (d[CARD[2]] < policy.reject_financial)
    passed = (F.col("score") >= policy.passes) & (d[CARD[2]] >= policy.financial) & (d[CARD[5]] >= policy.evidence) & (F.col("critical") == 0)
    gate = F.when(rejected, "reject").when(passed, "pass").otherwise("review")
    least = F.least(*d.values())
    weakest = F.coalesce(*[F.when(d[name] == least, name) for name in CARD])
    c = c.withColumns({"gate": gate, "weakest": F.when(F.col("score").isNotNull(), weakest)})
    why = F.when(F.col("score").isNull(), F.array(F.lit("incomplete"))).when(F.col("gate") == "pass", F.array().cast("array<string>")).when(F.size("reasons") > 0, F.col("reasons"))
    why = why.when(F.col("gate") == "reject", F.array(F.lit("low_score_and_relevance"))).otherwise(F.array(F.lit("below_pass")))
    step = F.when(F.col("gate") == "reject", "drop").when(F.col("gate") == "pass", "extract_intent").when((d[CARD[0]] < policy.warn) | (F.col("critical") > 0), "reprocess_source").otherwise("manual_review")
    return c.withColumns({"reasons": why, "next_step": step})


def crowd_sentiment(snapshots: DataFrame, weights: dict[str, float] = SOURCES, extreme: float = 0.7, speed: float = 0.3) -> DataFrame:
    """The snapshots' columns with score, class, extreme, contrarian and data_quality.

    Sources reddit, twitter and news are within 0 and 1 (centred) or -1 and 1 (held there), polymarket is a probability; null ones have
    no weight, and without any the score is 0.  ``velocity`` (null: 0) tells how fast the mood turns."""
    centred = lambda c: F.when(F.col(c).between(0, 1), (F.col(c) - 0.5) * 2).otherwise(_held(F.col(c), -1, 1))
    parts = {c: (F.col(c) - 0.5) * 2 if c == "polymarket" else centred(c) for c in weights}
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    mean = sum((F.coalesce(parts[c] * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    sources = sum((F.col(c).isNotNull().cast("int") for c in weights), F.lit(0))
    s = snapshots.withColumn("score", F.round(F.coalesce(F.try_divide(mean, total), F.lit(0.0)), 9))
    score, velocity = F.col("score"), F.coalesce("velocity", F.lit(0.0))
    return s.withColumns({
        "class": F.when(score > 0.15, "bullish").when(score < -0.15, "bearish").otherwise("neutral"), "extreme": F.abs(score) > extreme,
        "contrarian": ((score > extreme) & (velocity > speed)) | ((score < -extreme) & (velocity < -speed)),
        "data_quality": F.when(sources >= 3, "complete").when(sources > 0, "partial").otherwise("unavailable"),
    })


def direction_adjustments(views: DataFrame, extreme: float = 0.7, concern: float = 0.3) -> DataFrame:
    """Views (direction beside the columns of ``crowd_sentiment``) with confidence_modifier and reason.

    A view with an extreme crowd loses 0.2, against one gains 0.1, against a mild one loses 0.1; other directions and views without data keep theirs."""
    side = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0)
    along = side * F.col("score")
    reason = F.when(F.col("data_quality") == "unavailable", "no_data").when(along > extreme, "with_extreme_crowd").when(along < -extreme, "against_extreme_crowd").when(along < -concern, "against_crowd")
    reason = reason.when((F.col("direction") == "neutral") & F.col("extreme"), "extreme_crowd").otherwise("")
    v = views.withColumn("reason", reason)
    return v.withColumn("confidence_modifier", F.when(F.col("reason") == "with_extreme_crowd", -0.2).when(F.col("reason") == "against_extreme_crowd", 0.1).when(F.col("reason") == "against_crowd", -0.1).otherwise(0.0))
