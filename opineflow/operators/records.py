"""Action records: scans, projections, validation, feeds, samples, and creators' records over stance episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest_stance, stance_episodes

# Days of a timeline's range; names that are no creator; action types of directional backtest records.
RANGES = {"1W": 7, "1M": 30, "3M": 90, "1Y": 365, "ALL": 730}
NOBODY = ("", "unknown", "none")
RECORD_TYPES = {"long": "long", "short": "short", "add": "long", "reduce": "close_long", "close_long": "close_long", "close_short": "close_short", "buy_call": "buy_call", "buy_put": "buy_put", "buy_and_hold": "long"}


def first_wins(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, one a key, of the first table that has it; of one table's the least row.  Merged before the shuffle."""
    rest = [c for c in tiers[0].columns if c != key]
    both = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(n)) for n, t in enumerate(tiers)])
    return both.groupBy(key).agg(F.min(F.struct("tier", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest], F.col("r.tier").alias("tier"))


def attributed(actions: DataFrame) -> DataFrame:
    """Actions of a known creator, whose name is trimmed."""
    name = F.trim(F.coalesce("creator_id", F.lit("")))
    return actions.withColumn("creator_id", name).where(~F.lower("creator_id").isin(*NOBODY))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows with the number of all of them, which is counted apart, not over a window of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def index_query(actions: DataFrame, creator_id: str | None = None, ticker: str | None = None, direction: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Actions where all that is given holds; tickers compare in upper, directions in lower case, both bounds are included."""
    for column, value in (("creator_id", creator_id), ("ticker", ticker and ticker.upper()), ("direction", direction and direction.lower()), ("status", status)):
        if value is not None:
            actions = actions.where(F.col(column) == value)
    if since is not None:
        actions = actions.where(F.col("clock") >= F.lit(since).cast("timestamp_ntz"))
    return actions if until is None else actions.where(F.col("clock") <= F.lit(until).cast("timestamp_ntz"))


def timeline_range(actions: DataFrame, now: str, span: str = "ALL", tickers: list[str] | None = None, directions: list[str] | None = None, creators: list[str] | None = None, least_confidence: float | None = None) -> DataFrame:
    """Actions of the last days before ``now``; a ticker may be given as written or normalized, a null confidence fails a least one."""
    clock, end = F.col("clock"), F.lit(now).cast("timestamp_ntz")
    found = actions.where((clock <= end) & (clock >= end - F.make_dt_interval(days=F.lit(RANGES[span]))))
    if tickers:
        found = found.where(F.col("ticker").isin(tickers) | F.col("ticker_normalized").isin(tickers))
    for column, values in (("direction", directions), ("creator_id", creators)):
        if values:
            found = found.where(F.col(column).isin(values))
    return found if least_confidence is None else found.where(F.coalesce(F.col("confidence") >= least_confidence, F.lit(False)))


def pending_review(actions: DataFrame, needs_review: Column, limit: int) -> DataFrame:
    """Of the newest ``limit`` pending actions those that need a review: the limit comes first."""
    return actions.where("status = 'pending'").orderBy(F.desc("clock"), F.desc("action_id")).limit(limit).where(needs_review)


def opinions(actions: DataFrame) -> DataFrame:
    """Actions as opinions of a timeline: confidence rounded, risk warnings as bearish, watch lists as neutral, reviews as pending."""
    direction = F.when(F.col("direction").isin("bearish", "risk_warning"), "bearish").when(F.col("direction") == "bullish", "bullish").otherwise("neutral")
    status = F.when(F.col("status").isin("verified", "failed"), F.col("status")).otherwise("pending")
    return actions.select(F.col("action_id").alias("id"), "clock", F.upper("ticker").alias("ticker"), direction.alias("direction"), F.round("confidence", 2).alias("confidence"), status.alias("verification"), F.col("creator_id").alias("author"))


def backtest_records(actions: DataFrame) -> DataFrame:
    """Bullish and bearish actions of a type that a backtest knows."""
    kind = F.create_map(*[F.lit(x) for kv in RECORD_TYPES.items() for x in kv])[F.col("action_type")]
    return actions.where(F.col("direction").isin("bullish", "bearish")).select("action_id", "creator_id", "ticker", "direction", kind.alias("record_type"), "clock").where("record_type is not null")


def action_errors(actions: DataFrame) -> DataFrame:
    """action_id and what an action lacks to be canonical, in a fixed order; none: an empty list."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [(blank("intent_id"), "missing intent_id"), (blank("policy_id"), "missing policy_id"), (F.coalesce(F.size("evidence_span_ids") < 1, F.lit(True)), "missing or empty evidence_span_ids"), (F.col("executable_at").isNull(), "missing execution_timing.action_executable_at")]
    return actions.select("action_id", F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda e: e.isNotNull()).alias("errors"))


def settled_record(actions: DataFrame, results: DataFrame) -> DataFrame:
    """Per known creator: stance episodes settled and won, by what became of an episode's first action; a view restated counts once.

    ``results`` has action_id, return_pct and holding_days; creators without any settled episode have 0 and 0."""
    known = attributed(actions)
    anchors = stance_episodes(known).select("creator_id", F.col("anchor_id").alias("action_id"))
    done = anchors.join(results.select("action_id", "return_pct", "holding_days"), "action_id").where("return_pct is not null and holding_days > 0")
    record = done.groupBy("creator_id").agg(F.count("*").alias("settled"), F.count_if(F.col("return_pct") > 0).alias("wins"))
    score = F.bround(40 + 55 * (F.col("wins") + 2) / (F.col("settled") + 4))
    all_ = known.select("creator_id").distinct().join(record, "creator_id", "left").select("creator_id", F.coalesce("settled", F.lit(0)).alias("settled"), F.coalesce("wins", F.lit(0)).alias("wins"))
    return all_.withColumn("credibility", F.greatest(F.lit(0), F.least(F.lit(99), score.cast("int"))))


def snapshot_before(actions: DataFrame, day: str, credibility: DataFrame) -> DataFrame:
    """The latest stances strictly before a day, with their creators' credibility (null: none known)."""
    before = actions.where(F.col("clock") < F.lit(day).cast("timestamp_ntz"))
    return latest_stance(before).join(credibility.select(F.trim("creator_id").alias("creator_id"), "credibility"), "creator_id", "left")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots: flips; new calls of creators who were there before; score changes of unchanged stances."""
    was = old.select("creator_id", "ticker", F.col("direction").alias("old_direction"), F.col("credibility").alias("old_score"))
    both = new.join(old.select("creator_id").distinct(), "creator_id", "left_semi").join(was, ["creator_id", "ticker"], "left")
    change = F.when(F.col("old_direction").isNull(), "new_call").when(F.col("old_direction") != F.col("direction"), "flip").when(~F.col("old_score").eqNullSafe(F.col("credibility")), "score_change")
    return both.select("creator_id", "ticker", "old_direction", F.col("direction").alias("new_direction"), "old_score", F.col("credibility").alias("new_score"), change.alias("change")).where("change is not null")


def trading_style(actions: DataFrame, least: int = 5, majority: float = 0.6) -> DataFrame:
    """Per creator: directional and short-side actions, margin mentions, and the entry style: one vote an episode, by its first entry
    with a style; under ``least`` votes unknown, without a majority mixed."""
    order = Window.partitionBy("creator_id", "ticker").orderBy("clock", "action_id")
    turn = F.when(F.lag("direction").over(order) == F.col("direction"), 0).otherwise(1)
    a = actions.withColumn("turn", turn).withColumn("episode", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    vote = F.min_by("entry_style", F.when(F.col("is_entry") & F.col("entry_style").isNotNull(), F.struct("clock", "action_id")))
    each = a.groupBy("creator_id", "ticker", "episode").agg(F.count_if(F.col("direction").isin("bullish", "bearish")).alias("directional"), F.count_if(F.col("direction") == "bearish").alias("short_side"), F.count_if("margin").alias("margin_mentions"), vote.alias("vote"))
    per = each.groupBy("creator_id").agg(F.sum("directional").alias("directional"), F.sum("short_side").alias("short_side"), F.sum("margin_mentions").alias("margin_mentions"), F.count_if(F.col("vote") == "left_side").alias("left_votes"), F.count_if(F.col("vote") == "right_side").alias("right_votes"))
    votes = F.col("left_votes") + F.col("right_votes")
    style = F.when(votes < least, "unknown").when(F.col("left_votes") / votes >= majority, "left_side").when(F.col("right_votes") / votes >= majority, "right_side").otherwise("mixed")
    return per.withColumn("entry_style", style)


def direction_steadiness(actions: DataFrame) -> DataFrame:
    """Per creator the mean over tickers of 1 - changes / (views - 1), and its band of 1 to 5; 3 without a ticker of two views."""
    order = Window.partitionBy("creator_id", "ticker").orderBy("clock", "action_id")
    a = actions.withColumn("changed", (F.lag("direction").over(order) != F.col("direction")).cast("int"))
    each = a.groupBy("creator_id", "ticker").agg(F.count("*").alias("n"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    mean = F.avg(F.when(F.col("n") > 1, 1 - F.col("changes") / (F.col("n") - 1)))
    per = each.groupBy("creator_id").agg(F.round(mean, 6).alias("steadiness"))
    s = F.col("steadiness")
    return per.withColumn("band", F.when(s.isNull(), 3).when(s > 0.85, 5).when(s > 0.70, 4).when(s > 0.55, 3).when(s > 0.40, 2).otherwise(1))


def around(items: DataFrame, group: str, position: str, located: Column, before: int, after: int) -> DataFrame:
    """Items at most so many places before and after each located one of their group, with the distance: an equi-join on places."""
    numbered = items.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(position)))
    at = numbered.where(located).select(group, F.col(position).alias("located_at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("distance"), F.col("place").alias("p"))
    at = at.select(group, "located_at", "distance", (F.col("p") + F.col("distance")).alias("place"))
    return at.join(numbered, [group, "place"]).drop("place")


def even_sample(snapshots: DataFrame, group: str, position: str, most: int = 30) -> DataFrame:
    """Every n // most-th row of a group, of these the last ``most``."""
    order, whole = Window.partitionBy(group).orderBy(position), Window.partitionBy(group)
    s = snapshots.withColumn("no", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    s = s.where(F.col("no") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    return s.withColumn("from_end", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(position)))).where(F.col("from_end") <= most).drop("no", "n", "from_end")


def leaders(scores: DataFrame, by: str, least_views: int, limit: int) -> DataFrame:
    """The best creators of one dimension with enough views; ties by name."""
    return scores.where(F.col("views") >= least_views).orderBy(F.desc(by), "creator_id").limit(limit)


def focus_areas(actions: DataFrame, limit: int = 5) -> DataFrame:
    """Each creator's most frequent tickers, ties by name."""
    each = actions.groupBy("creator_id", "ticker").agg(F.count("*").alias("n"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("creator_id").orderBy(F.desc("n"), "ticker"))).where(F.col("rank") <= limit)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of the least hash of seed and key: the same ones in every run."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(h, key).limit(n)


def capped_select(rows: DataFrame, group: str, order: str, per_group: int, limit: int) -> DataFrame:
    """The first rows in order, at most ``per_group`` of a group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_group).orderBy(order).limit(limit).drop("nth")


def change_feed(history: DataFrame, snapshots: DataFrame, limit: int) -> DataFrame:
    """Events of both feeds, one an id (history's first), newest first."""
    return first_wins([history, snapshots], "event_id").orderBy(F.desc("at"), "event_id").limit(limit)


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping and touching spans (start, end) of a key as one, with how many it holds.

    A span without an end is a point; one without a start has no place and is left out, as are those that end before they start."""
    spans = spans.withColumn("end", F.coalesce("end", "start")).where(F.col("start") <= F.col("end"))
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(order), F.lit(True)).cast("int"))
    s = s.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("island")


def preference_errors(rows: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """id and what is wrong with a preference row: no prompt, equal answers, a prompt seen before (by its hash), an evaluation id."""
    digest = F.sha2(F.regexp_replace(F.lower(F.trim("prompt")), r"\s+", " "), 256)
    first = rows.groupBy(digest.alias("digest")).agg(F.min("id").alias("first_id"))
    r = rows.withColumn("digest", digest).join(first, "digest").join(eval_ids.select(F.col("id").alias("eval_id")).distinct(), F.col("id") == F.col("eval_id"), "left")
    checks = [(F.trim("prompt") == "", "empty_prompt"), (F.col("chosen") == F.col("rejected"), "same_answers"), (F.col("id") != F.col("first_id"), "duplicate_prompt"), (F.col("eval_id").isNotNull(), "eval_leak")]
    return r.select("id", F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda e: e.isNotNull()), ",").alias("errors"))


def needs_reprocess(existing: DataFrame, prompt_version: str, config_hash: str) -> DataFrame:
    """content_id and why it is to be processed again: never done, failed, another prompt or another configuration."""
    why = F.when(F.col("status").isNull(), "never").when(F.col("status") == "failed", "failed").when(~F.col("prompt_version").eqNullSafe(F.lit(prompt_version)), "prompt").when(~F.col("config_hash").eqNullSafe(F.lit(config_hash)), "config")
    return existing.select("content_id", why.alias("why")).where("why is not null")


def last_samples(samples: DataFrame, operation: str, at: str, key: str, n: int) -> DataFrame:
    """Mean of each operation's last ``n`` samples."""
    w = Window.partitionBy(operation).orderBy(F.desc(at), F.desc(key))
    kept = samples.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return kept.groupBy(operation).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
