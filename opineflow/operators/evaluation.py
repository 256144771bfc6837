"""Scores of extractions, price checks, full backtest metrics, annotation and model reports, catalog joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tickers import number_in_text, ticker_in_text

# Weights, conviction ceilings and ticker words of reward scoring.
WEIGHTS = {"grounding": 0.5, "calibration": 0.4, "abstention": 0.1}
CEILINGS = {"full": 0.8, "ticker": 0.6, "none": 0.45, "abstain": 0.3}
SENTINELS = ("UNRESOLVED", "UNSPECIFIED", "UNSP", "N/A", "NA")


def reward_scores(rows: DataFrame) -> DataFrame:
    """Reward of each extraction (id, ticker, direction, prices, conviction, rationale) against its evidence, within 0 and 1.

    Structure is a gate: without a ticker or a known direction the reward is 0.  Bullish and bearish ones commit themselves:
    they are weighed by grounding and calibration, the others by calibration and abstention."""
    r = rows.withColumn("ok", (F.trim(F.coalesce("ticker", F.lit(""))) != "") & F.coalesce(F.col("direction").isin("bullish", "bearish", "neutral", "watchlist", "risk_warning"), F.lit(False)))
    r = r.withColumn("committal", F.col("direction").isin("bullish", "bearish"))
    named = (F.upper(F.trim("ticker")) == "NONE") | ticker_in_text(F.col("ticker"), F.col("evidence"))
    priced = F.forall(F.coalesce("prices", F.array().cast("array<double>")), lambda p: number_in_text(p, F.coalesce("evidence", F.lit(""))))
    r = r.withColumn("grounding", F.when(named, 0.7).otherwise(0.0) + F.when(priced, 0.3).otherwise(0.0))
    ceiling = F.when(~F.col("committal"), CEILINGS["abstain"]).when(F.col("grounding") >= 0.99, CEILINGS["full"]).when(F.col("grounding") >= 0.7, CEILINGS["ticker"]).otherwise(CEILINGS["none"])
    over = F.col("conviction") - ceiling
    r = r.withColumn("calibration", F.when(F.col("conviction").isNull(), 0.0).when(over <= 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - over)))
    w = WEIGHTS
    mean = F.when(F.col("committal"), (w["grounding"] * F.col("grounding") + w["calibration"] * F.col("calibration")) / (w["grounding"] + w["calibration"])).otherwise((w["calibration"] * F.col("calibration") + w["abstention"]) / (w["calibration"] + w["abstention"]))
    penalty = F.when(F.col("committal") & F.upper(F.trim("ticker")).isin(*SENTINELS), 0.5).otherwise(0.0) + F.when(F.trim(F.coalesce("rationale", F.lit(""))) == "", 0.2).otherwise(0.0)
    reward = F.when(~F.col("ok"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - penalty)))
    return r.select("id", "committal", F.round("grounding", 4).alias("grounding"), F.round("calibration", 4).alias("calibration"), F.round(reward, 6).alias("reward"))


def reference_match(rows: DataFrame) -> DataFrame:
    """id and the best of its gold records' scores: a point each for the direction, the ticker and whether it commits itself."""
    commits = lambda c: F.coalesce(F.col(c).isin("bullish", "bearish"), F.lit(False))
    plain = lambda c: F.ltrim(F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit("$"))
    score = F.col("direction").eqNullSafe(F.col("gold_direction")).cast("int") + (plain("ticker") == plain("gold_ticker")).cast("int") + (commits("direction") == commits("gold_direction")).cast("int")
    return rows.groupBy("id").agg(F.max(score).alias("score"))


def price_checks(rows: DataFrame) -> DataFrame:
    """Where a price stands within its year's range, and what is odd about target prices, in a fixed order."""
    span = F.col("high_52wk") - F.col("low_52wk")
    at = F.when(span > 0, (F.col("price") - F.col("low_52wk")) / span)
    long, short = F.col("action_type").isin("long", "buy_call"), F.col("action_type").isin("short", "buy_put")
    checks = [
        (F.col("target_low") >= F.col("target_high"), "inverted_range"), (long & (F.col("target_low") <= F.col("price")), "long_target_below_price"),
        (short & (F.col("target_high") >= F.col("price")), "short_target_above_price"), (F.col("target_high") > 1.5 * F.col("high_52wk"), "far_above_range"), (F.col("target_low") < 0.5 * F.col("low_52wk"), "far_below_range"),
    ]
    place = F.when(at < 0.1, "near_52wk_low").when(at > 0.9, "near_52wk_high").when(at.isNotNull(), "in_range")
    return rows.select("id", place.alias("position"), F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda e: e.isNotNull()), ",").alias("warnings"))


def full_metrics(totals: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """Per creator of daily totals: total and annualized return (as it is under 365 days), volatility, Sharpe, Sortino and Calmar ratios, drawdown.

    The first day has no return; downside deviation is that of the negative returns, or the volatility where there are under two."""
    order = Window.partitionBy("kol").orderBy("day")
    t = totals.withColumns({"peak": F.max("total").over(order.rowsBetween(Window.unboundedPreceding, 0)), "first": F.row_number().over(order) == 1})
    r = F.when(~F.col("first"), F.col("pnl") / F.col("total"))
    each = t.groupBy("kol").agg(F.datediff(F.max("day"), F.min("day")).alias("days"), (F.max_by("total", "day") / start - 1).alias("total_return"), F.stddev_samp(r).alias("sd"), F.count_if(r < 0).alias("n_down"), F.stddev_samp(F.when(r < 0, r)).alias("down"), F.max(1 - F.col("total") / F.col("peak")).alias("max_drawdown"))
    year = F.sqrt(F.lit(252.0))
    each = each.withColumn("annualized", F.when(F.col("days") >= 365, F.pow(1 + F.col("total_return"), F.lit(1.0) / (F.col("days") / 365.25)) - 1).otherwise(F.col("total_return"))).withColumn("volatility", F.coalesce(F.col("sd") * year, F.lit(0.0)))
    each = each.withColumn("downside", F.when(F.col("n_down") > 1, F.col("down") * year).otherwise(F.col("volatility")))
    ratio = lambda c: F.round(F.when(F.col(c) > 0, F.col("annualized") / F.col(c)).otherwise(0.0), 4)
    return each.select("kol", "days", F.round("total_return", 6).alias("total_return"), F.round("annualized", 6).alias("annualized"), F.round("volatility", 6).alias("volatility"), ratio("volatility").alias("sharpe"), ratio("downside").alias("sortino"), ratio("max_drawdown").alias("calmar"), F.round("max_drawdown", 6).alias("max_drawdown"))


def annotation_quality(sources: DataFrame, annotations: DataFrame, training: DataFrame) -> DataFrame:
    """One row: source items, annotated ones, annotations without a source, incomplete ones, and those that training has too."""
    key = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    j = sources.join(annotations.withColumnRenamed("id", "annotated"), F.col("id") == F.col("annotated"), "full").join(key(training, "id", "trained"), F.col("annotated") == F.col("trained"), "left")
    return j.agg(F.count("id").alias("sources"), F.count_if(F.col("id").isNotNull() & F.col("annotated").isNotNull()).alias("done"), F.count_if(F.col("id").isNull()).alias("dangling"), F.count_if(F.col("annotated").isNotNull() & F.col("label").isNull()).alias("incomplete"), F.count_if(F.col("trained").isNotNull()).alias("overlap"))


def model_report(runs: DataFrame) -> DataFrame:
    """Per model: runs, mean latency, share grounded, share of contents whose first two repeats are equal (of those with two)."""
    first = runs.withColumn("nth", F.row_number().over(Window.partitionBy("model", "content_id").orderBy("repeat"))).where("nth <= 2")
    same = first.groupBy("model", "content_id").agg((F.min("answer") == F.max("answer")).alias("same"), F.count("*").alias("n")).where("n = 2")
    steady = same.groupBy("model").agg(F.round(F.count_if("same") / F.count("*"), 4).alias("determinism"))
    each = runs.groupBy("model").agg(F.count("*").alias("runs"), F.round(F.avg("latency"), 3).alias("latency"), F.round(F.count_if("grounded") / F.count("*"), 4).alias("grounded"))
    return each.join(steady, "model", "left")


def number_recall(texts: DataFrame) -> DataFrame:
    """id, gold numbers, and those of them that the text has: thousands' commas go, accounting brackets are a minus."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?"), F.lit(0)), lambda x: F.concat(F.when(F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")")), F.lit("-")).otherwise(""), F.regexp_replace(x, "[(),]", "")))
    return texts.select("id", F.size(F.array_distinct("gold")).alias("gold"), F.size(F.array_intersect(F.array_distinct("gold"), found)).alias("found"))


def confidence_buckets(proposals: DataFrame) -> DataFrame:
    """Proposals and the share accepted per bucket of confidence."""
    bucket = F.when(F.col("confidence").isNull(), "none").when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return proposals.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count_if("accepted") / F.count("*"), 4).alias("precision"))


def asset_index(contents: DataFrame, stages: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """The asset index anew: a row per content and stage that is ready or partial, with its source and group where known."""
    ready = stages.where(F.col("status").isin("ready", "partial"))
    return contents.join(ready, "content_id").join(sources, "source_id", "left").join(groups, "group_id", "left").select("content_id", "stage", "status", "title", "source_name", "group_name")


def missing_keys(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per named check (child, key, parent, key): children whose key no parent has; a null key has none."""
    out = None
    for name, (child, key, parent, parent_key) in checks.items():
        rows = child.join(parent.select(F.col(parent_key).alias("__parent")).distinct(), F.col(key) == F.col("__parent"), "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("check"), "missing")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_bundles(actions: DataFrame, intents: DataFrame, spans: DataFrame) -> DataFrame:
    """Each action with its intent, where there is one, and its spans in order."""
    listed = spans.groupBy("action_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "policy_id"))), lambda x: F.concat_ws(":", x["span_id"], x["policy_id"])), ",").alias("spans"))
    return actions.join(intents, "intent_id", "left").join(listed, "action_id", "left").select("action_id", "intent_id", "intent", F.coalesce("spans", F.lit("")).alias("spans"))


def sector_proxy(views: DataFrame, proxies: DataFrame) -> DataFrame:
    """A sector's proxy fund in its market, else the sector's default one (a null market)."""
    own = proxies.where("market is not null").select(F.col("sector").alias("s1"), F.col("market").alias("m1"), F.col("symbol").alias("own"))
    default = proxies.where("market is null").select(F.col("sector").alias("s2"), F.col("symbol").alias("default"))
    return views.join(own, (F.col("sector") == F.col("s1")) & (F.col("market") == F.col("m1")), "left").join(default, F.col("sector") == F.col("s2"), "left").select("id", "sector", "market", F.coalesce("own", "default").alias("symbol"))


def account_identity(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Posts with the creator to whom the platform's account belongs; profiles list their accounts."""
    accounts = profiles.select("creator_id", F.explode("accounts").alias("a")).select("creator_id", F.col("a.platform").alias("p"), F.lower("a.account").alias("who"))
    one = accounts.groupBy("p", "who").agg(F.min("creator_id").alias("creator_id"))
    return posts.join(one, (F.col("platform") == F.col("p")) & (F.lower("account") == F.col("who")), "left").select("post_id", "creator_id")


def first_validations(views: DataFrame, validations: DataFrame) -> DataFrame:
    """Views with a stop loss and their first validation: whether it was hit, and counts a creator."""
    first = validations.groupBy("view_id").agg(F.min_by("hit", F.struct("at", "validation_id")).alias("hit"))
    j = views.where("stop_loss is not null").join(first, "view_id", "left")
    return j.groupBy("kol").agg(F.count("*").alias("views"), F.count("hit").alias("validated"), F.count_if("hit").alias("hits"))


def price_route(ticker: Column) -> Column:
    """The provider of a ticker's prices by its form."""
    t = F.upper(F.trim(ticker))
    return F.when(t.endswith(".HK"), "hk").when(t.rlike(r"\.(SH|SZ|SS)$|^[0-9]{6}$"), "cn").when(t.rlike("^(BTC|ETH|SOL|DOGE)([-/]?USDT?)?$"), "crypto").otherwise("us")


def price_routes(rows: DataFrame, ticker: str) -> DataFrame:
    return rows.withColumn("provider", price_route(F.col(ticker)))


def subtitle_segments(files: DataFrame) -> DataFrame:
    """Segments of SRT subtitles (id, content): n, start and end in seconds, text in one line."""
    stamp = r"([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"
    blocks = files.select("id", F.posexplode(F.filter(F.split(F.replace("content", F.lit("\r"), F.lit("")), r"\n\s*\n"), lambda b: b.rlike(f"{stamp} *--> *{stamp}"))).alias("n", "block"))
    part = lambda g: F.regexp_extract("block", f"{stamp} *--> *{stamp}", g).cast("double")
    seconds = lambda g: part(g) * 3600 + part(g + 1) * 60 + part(g + 2) + part(g + 3) / 1000
    text = F.trim(F.regexp_replace(F.regexp_replace("block", rf"^[\s\S]*?{stamp} *--> *{stamp}[^\n]*", ""), r"\s+", " "))
    return blocks.select("id", "n", F.round(seconds(1), 3).alias("start"), F.round(seconds(5), 3).alias("end"), text.alias("text")).where("text != ''")


def chat_messages(exports: DataFrame) -> DataFrame:
    """Messages of chat exports (id, content): each begins with a line ``### name time``; with its offsets, end exclusive."""
    head = r"(?m)^### (.+?) ([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})$"
    parts = F.split("content", r"(?m)(?=^### .+? [0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$)", -1)
    step = lambda acc, p: F.struct((acc["at"] + F.char_length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(p)).alias("end"), p.alias("part")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:string>>").alias("out"))
    rows = exports.select("id", F.explode(F.aggregate(parts, zero, step, lambda acc: acc["out"])).alias("m")).select("id", "m.*").where(F.regexp_like("part", F.lit(head)))
    return rows.select("id", "start", "end", F.regexp_extract("part", head, 1).alias("name"), F.regexp_extract("part", head, 2).alias("sent_at"), F.btrim(F.regexp_replace("part", head + r"\n?", ""), F.lit(" \r\n\t")).alias("body"))


def exact_percentiles(samples: DataFrame, operation: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), slices: int = 64) -> DataFrame:
    """Exact linear percentiles per operation: approximate borders cut each operation into slices, slices are counted,
    and only those that hold a wanted rank are put in order, each for itself."""
    s = samples.where(F.col(value).isNotNull()).select(F.col(operation).alias("op"), F.col(value).alias("v"))
    cuts = s.groupBy("op").agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 10_000).alias("cuts"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    s = s.join(cuts.select("op", "cuts"), "op").select("op", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("slice"))
    counts = s.groupBy("op", "slice").agg(F.count("*").alias("in_slice"))
    counts = counts.withColumn("before", F.sum("in_slice").over(Window.partitionBy("op").orderBy("slice")) - F.col("in_slice"))
    wanted = cuts.select("op", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("n") - 1)).alias("rank")) for q in shares])).alias("w")).select("op", "w.*")
    wanted = wanted.select("op", "q", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("at"))
    place = wanted.join(counts, "op").where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("in_slice"))).select("op", "q", "rank", "at", "slice", "before")
    needed = s.join(place.select("op", "slice", "before").distinct(), ["op", "slice"])
    numbered = needed.select("op", "v", (F.col("before") + F.row_number().over(Window.partitionBy("op", "slice").orderBy("v")) - 1).alias("at"))
    found = numbered.join(place.select("op", "q", "rank", "at"), ["op", "at"])
    weight = F.when(F.col("at") == F.floor("rank"), 1 - (F.col("rank") - F.floor("rank"))).otherwise(F.col("rank") - F.floor("rank"))
    out = found.groupBy("op").agg(*[F.round(F.sum(F.when(F.col("q") == q, F.col("v") * weight)), 4).alias(f"p{int(q * 100)}") for q in shares])
    return cuts.drop("cuts").withColumn("mean", F.round("mean", 4)).join(out, "op").withColumnRenamed("op", operation)
