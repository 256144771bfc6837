"""From intents to actions: evidence that grounds them, the gates an action must pass with the first reason against it, brokers' reports as intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opineflow.operators import tickers as tk

# Hints of a policy and the actions they become; the last three are opinions, not trades.
TRADES = {"open_position": "long", "add_position": "add", "close_position": "close_long", "reduce_position": "reduce", "hold_position": "hold"}
OPINIONS = {"watch_only": "watch", "watch_or_no_trade": "watch", "avoid_or_watch_risk": "watch"}
SIZES = {"small": 0.05, "medium": 0.10, "large": 0.20}
INSTRUMENTS = {"stock": "stock", "etf": "etf", "index": "index_future", "crypto": "crypto", "company": "stock"}
DIRECTIONS = ("bullish", "bearish", "neutral", "watchlist", "risk_warning")
TRADABLE = r"^([0-9]{4,6}\.(HK|SH|SZ)|[A-Z]{1,5})$"
NOT_RATED = ("not rated", "nr", "no rating", "unrated")
SENTENCE_END, SENTENCE_REACH, SNIPPETS = "。！？；\n", 120, 3


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that holds a span: to the nearest sentence ends, 120 characters a side at most, without blanks at its ends.

    Null or crossed offsets are brought within the text."""
    n = F.char_length(text)
    s = F.greatest(F.lit(0), F.least(F.coalesce(start, F.lit(0)), n))
    e = F.greatest(s, F.least(F.coalesce(end, s), n))
    low = F.greatest(F.lit(0), s - SENTENCE_REACH)
    before = F.regexp_extract(F.substring(text, low + 1, s - low), f"[^{SENTENCE_END}]*\\z", 0)
    after = F.regexp_extract(F.substring(text, e + 1, F.lit(SENTENCE_REACH)), f"^[^{SENTENCE_END}]*[{SENTENCE_END}]?", 0)
    return F.regexp_replace(F.concat(before, F.substring(text, s + 1, e - s), after), r"^\s+|\s+$", "")


def sentence_windows(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """spans (content_id, span_id, block_id, start, end, text) with ``snippet``: the sentence around them in their block, else their own
    text; blanks single, without bars and hyphens at the ends."""
    b = blocks.select(F.col("content_id").alias("__c"), F.col("block_id").alias("__b"), F.col("text").alias("__t"))
    met = spans.join(b, (F.col("content_id") == F.col("__c")) & (F.col("block_id") == F.col("__b")), "left")
    own = F.nullif(sentence_around(F.col("__t"), F.col("start"), F.col("end")), F.lit(""))
    plain = F.regexp_replace(F.coalesce(own, "text", F.lit("")), r"\s+", " ")
    return met.select(*spans.columns, F.regexp_replace(plain, "^[|\\- ]+|[|\\- ]+$", "").alias("snippet"))


def _ordered(pairs: Column, value: str) -> Column:
    """The distinct values of collected structs by their order."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda p: p[value]))


def grounded(intents: DataFrame, anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """``intents`` (content_id, intent_id, symbol, block_ids) with ``evidence_ids`` and ``grounded_by``: symbol, block or null.

    anchors (content_id, place, symbol, span_ids), spans (content_id, span_id, block_id).  The spans of the content's anchors of that
    symbol ground an intent, first seen first; where there are none of these among the content's spans, all spans of its blocks do.
    Both ways are equi-joins on exploded keys; lists are of one content's spans."""
    known = spans.select(F.col("content_id").alias("__c"), F.col("span_id").alias("__s")).distinct()
    own = anchors.select("content_id", "symbol", "place", F.posexplode("span_ids").alias("pos", "span_id")).where("coalesce(symbol, '') <> ''")
    own = own.join(known, (F.col("content_id") == F.col("__c")) & (F.col("span_id") == F.col("__s")), "left_semi")
    by_symbol = own.groupBy(F.col("content_id").alias("__c1"), F.col("symbol").alias("__k1")).agg(_ordered(F.collect_list(F.struct("place", "pos", "span_id")), "span_id").alias("__by_symbol"))
    needed = intents.select("content_id", "intent_id", F.posexplode(F.array_distinct("block_ids")).alias("pos", "block"))
    at = spans.select(F.col("content_id").alias("__c"), F.col("block_id").alias("__b"), F.col("span_id").alias("span_id"))
    met = needed.join(at, (F.col("content_id") == F.col("__c")) & (F.col("block") == F.col("__b")))
    by_block = met.groupBy(F.col("intent_id").alias("__i")).agg(_ordered(F.collect_list(F.struct("pos", "span_id")), "span_id").alias("__by_block"))
    rows = intents.join(by_symbol, (F.col("content_id") == F.col("__c1")) & (F.col("symbol") == F.col("__k1")), "left").join(by_block, F.col("intent_id") == F.col("__i"), "left")
    by = F.when(F.col("__by_symbol").isNotNull(), "symbol").when(F.col("__by_block").isNotNull(), "block")
    return rows.select(*intents.columns, F.coalesce("__by_symbol", "__by_block", F.array().cast("array<string>")).alias("evidence_ids"), by.alias("grounded_by"))


def lineage_matches(reports: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per report (report_id, content_id, target, segments) the block_ids and span_ids of the anchors that name its target; empty lists without any.

    anchors (content_id, place, symbol, span_id, occurrences array of block_id and span_id).  An anchor matches if its symbol is the
    target, or if both are among the report's spellings.  So the symbols a report may meet are its target, and all its spellings if the
    target is one of them: these are exploded and joined, in place of a test of every report against every anchor of its content."""
    spelled = F.coalesce("segments", F.array().cast("array<string>"))
    wanted = F.when(F.array_contains(spelled, F.col("target")), F.array_distinct(F.concat(F.array("target"), spelled))).otherwise(F.array("target"))
    keys = reports.where("coalesce(target, '') <> ''").select("report_id", F.col("content_id").alias("__c"), F.explode(wanted).alias("__k"))
    found = anchors.withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''")
    met = keys.join(found, (F.col("__c") == F.col("content_id")) & (F.col("__k") == F.col("symbol")))
    listed = F.coalesce("occurrences", F.array().cast("array<struct<block_id:string,span_id:string>>"))
    every = F.concat(F.transform(listed, lambda o: F.struct(o.block_id.alias("block_id"), o.span_id.alias("span_id"))), F.array(F.struct(F.lit(None).cast("string").alias("block_id"), F.col("span_id").alias("span_id"))))
    each = met.select("report_id", "place", F.posexplode(every).alias("pos", "o")).select("report_id", "place", "pos", "o.*")
    lists = each.groupBy(F.col("report_id").alias("__r")).agg(
        _ordered(F.collect_list(F.when(F.col("block_id") != "", F.struct("place", "pos", "block_id"))), "block_id").alias("block_ids"),
        _ordered(F.collect_list(F.when(F.col("span_id") != "", F.struct("place", "pos", "span_id"))), "span_id").alias("span_ids"),
    )
    none = F.array().cast("array<string>")
    return reports.join(lists, F.col("report_id") == F.col("__r"), "left").select(*reports.columns, F.coalesce("block_ids", none).alias("block_ids"), F.coalesce("span_ids", none).alias("span_ids"))


def tradable(symbol: Column) -> Column:
    """A code of a Chinese or Hong Kong share with its suffix, or one to five capitals; null and empty are none."""
    return F.coalesce(symbol.rlike(TRADABLE), F.lit(False))


def compose_actions(mapped: DataFrame, intents: DataFrame, proxies: DataFrame, anchors: DataFrame, spans: DataFrame, blocks: DataFrame, instruments: tuple[str, ...] = ()) -> DataFrame:
    """One row a mapped intent: an action, or the first ``reason`` why there is none.

    mapped (policy_id, intent_id, hint, sizing, holding, review), intents (intent_id, content_id, target, target_type, symbol, market,
    direction, block_ids), proxies (sector, market, symbol, name; a null market is the sector's default).  In order: a hint that is
    neither trade nor opinion, an unknown intent, no target at all, a sector without a proxy, a name without a symbol, a symbol that is
    neither of ``instruments`` nor shaped like one, no evidence in a content that has spans.  Contents without any span pass without
    evidence.  Sectors trade through their proxy.  Accepted and rejected rows together are the input's, row by row."""
    hints = {**TRADES, **OPINIONS}
    action = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])[F.coalesce("hint", F.lit(""))]
    known = intents.select(F.col("intent_id").alias("__id"), "content_id", "target", "target_type", "symbol", "market", "direction", "block_ids")
    rows = mapped.join(known, F.col("intent_id") == F.col("__id"), "left")
    own = proxies.where("market is not null").select(F.col("sector").alias("__s1"), F.col("market").alias("__m1"), F.struct("symbol", "market", "name").alias("__own"))
    default = proxies.where("market is null").select(F.col("sector").alias("__s2"), F.struct("symbol", F.lit("CN").alias("market"), "name").alias("__default"))
    sector = F.when(F.col("target_type") == "sector", F.col("symbol"))
    rows = rows.withColumn("__sector", sector).join(own, (F.col("__sector") == F.col("__s1")) & (F.col("market") == F.col("__m1")), "left").join(default, F.col("__sector") == F.col("__s2"), "left")
    rows = rows.withColumn("proxy", F.coalesce("__own", "__default"))
    evidence = grounded(intents.select("content_id", "intent_id", "symbol", "block_ids"), anchors, spans).select(F.col("intent_id").alias("__e"), "evidence_ids", "grounded_by")
    anchored = spans.select(F.col("content_id").alias("__a")).distinct()
    rows = rows.join(evidence, F.col("intent_id") == F.col("__e"), "left").join(anchored, F.col("content_id") == F.col("__a"), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    is_sector = F.coalesce(F.col("target_type") == "sector", F.lit(False))
    reason = (
        F.when(action.isNull(), "non_executable_action_hint").when(F.col("__id").isNull(), "intent_not_found").when(blank("symbol") & blank("target"), "no_ticker_symbol")
        .when(is_sector & F.col("proxy").isNull(), "sector_proxy_not_configured").when(blank("symbol"), "unresolved_target_symbol")
        .when(~is_sector & ~(tradable(F.col("symbol")) | F.col("symbol").isin(*instruments)), "pseudo_ticker_symbol").when(F.col("__a").isNotNull() & (F.size("evidence_ids") == 0), "evidence_not_grounded")
    )
    rows = rows.withColumn("reason", reason)
    snippets = _snippets(rows.where("reason is null"), sentence_windows(spans, blocks))
    rows = rows.join(snippets, F.col("policy_id") == F.col("__p"), "left")
    ok = F.col("reason").isNull()
    keep = lambda c: F.when(ok, c)
    stance = F.when(F.col("hint").isin("close_position", "reduce_position"), "bearish").when(F.col("hint") == "hold_position", "neutral").when(F.col("direction").isin(*DIRECTIONS), F.col("direction")).otherwise("neutral")
    size = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])[F.coalesce("sizing", F.lit(""))]
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in INSTRUMENTS.items() for x in kv])[F.coalesce("target_type", F.lit(""))], F.lit("unspecified"))
    return rows.select(
        "policy_id", "intent_id", "hint", "reason", keep(F.coalesce("proxy.symbol", "symbol")).alias("ticker"), keep(F.coalesce("proxy.market", "market", F.lit("CN"))).alias("market"),
        keep(F.when(F.col("proxy").isNotNull(), "etf").otherwise(kind)).alias("instrument"), keep(action).alias("action"), keep(stance).alias("direction"), keep(size).alias("position_pct"), keep(F.col("holding")).alias("time_horizon"),
        keep(F.when(F.col("hint").isin(*OPINIONS), "opinion").otherwise("trade")).alias("tier"), keep(F.col("review")).alias("review"), keep(F.col("evidence_ids")).alias("evidence_ids"), keep(F.col("grounded_by")).alias("grounded_by"), keep(F.coalesce("evidence_text", F.lit(""))).alias("evidence_text"),
    )


def _snippets(accepted: DataFrame, windows: DataFrame) -> DataFrame:
    """Per policy the first distinct sentences of its evidence, joined by bars."""
    each = accepted.select(F.col("policy_id").alias("__p"), "content_id", F.posexplode("evidence_ids").alias("pos", "span"))
    w = windows.select(F.col("content_id").alias("__c"), F.col("span_id").alias("__s"), "snippet").where("snippet <> ''")
    met = each.join(w, (F.col("content_id") == F.col("__c")) & (F.col("span") == F.col("__s"))).groupBy("__p", "snippet").agg(F.min("pos").alias("pos"))
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("__p").orderBy("pos"))).where(F.col("nth") <= SNIPPETS)
    return first.groupBy("__p").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "snippet"))), lambda x: x.snippet), " | "), 1, 500).alias("evidence_text"))


def report_segments(stock_code: Column, ticker: Column) -> Column:
    """All spellings of a report's security: its code, then the parts of its ticker between slashes; upper case, each once."""
    parts = F.transform(F.split(F.coalesce(ticker, F.lit("")), "/"), lambda p: F.upper(F.trim(p)))
    every = F.concat(F.array(F.upper(F.trim(F.coalesce(stock_code, F.lit(""))))), parts)
    return F.array_distinct(F.filter(every, lambda p: p != ""))


def report_target(stock_code: Column, ticker: Column) -> Column:
    """The code; without one the last spelling with a venue's suffix, else the first; null if there is none."""
    code, parts = F.nullif(F.upper(F.trim(F.coalesce(stock_code, F.lit("")))), F.lit("")), report_segments(F.lit(None), ticker)
    suffixed = F.filter(parts, lambda p: F.contains(p, F.lit(".")))
    return F.coalesce(code, F.when(F.size(suffixed) > 0, F.element_at(suffixed, -1)), F.get(parts, F.lit(0)))


def report_intents(reports: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row a broker's report: a recommendation, or ``skip``, the reason why there is none.

    reports (report_id, content_id, stock_code, ticker, company, rating, rating_prior, rating_action, target_price, currency,
    horizon_months, day).  Skipped are reports without a rating, with one that says there is none, with an unknown one, and without a
    security.  A recommendation commits no position; its conviction is a constant of the rating's word, its currency that of the
    security's market where the report states none."""
    token, symbol = tk.rating_token(F.col("rating")), report_target(F.col("stock_code"), F.col("ticker"))
    direction = tk.rating_direction(F.col("rating"))
    skip = F.when(token.isNull(), "no_rating").when(token.isin(*NOT_RATED), "not_rated").when(direction.isNull(), "unmapped_rating").when(symbol.isNull(), "no_ticker")
    rows = reports.withColumns({"target": symbol, "segments": report_segments(F.col("stock_code"), F.col("ticker")), "skip": skip})
    rows = lineage_matches(rows, anchors)
    digest = F.sha1(F.concat_ws("|", F.coalesce("content_id", "report_id", F.lit("")), "target", "rating", F.coalesce(F.col("day").cast("string"), F.lit(""))).cast("binary"))
    ok = F.col("skip").isNull()
    keep = lambda c, name: F.when(ok, c).alias(name)
    horizon = F.when(F.col("horizon_months").isNull(), "long_term").otherwise(tk.horizon_of_months(F.col("horizon_months")))
    priced = F.col("target_price").isNotNull()
    return rows.select(
        "report_id", "skip", keep(F.concat(F.lit("bri_"), F.substring(digest, 1, 24)), "intent_id"), keep(F.col("target"), "symbol"), keep(F.coalesce(F.nullif(F.trim("company"), F.lit("")), "target"), "target"),
        keep(tk.market_of(F.col("target")), "market"), keep(direction, "direction"), keep(F.coalesce(tk.rating_conviction(F.col("rating")), F.lit(0.4)), "conviction"), keep(F.coalesce("rating_action", F.lit("unknown")), "rating_action"),
        keep(tk.rating_direction(F.col("rating_prior")), "prior_direction"), keep(F.col("target_price"), "target_price"), keep(F.when(priced, F.coalesce("currency", tk.currency_of(F.col("target")))), "currency"),
        keep(priced & F.col("currency").isNull(), "currency_inferred"), keep(horizon, "horizon"), keep(F.col("block_ids"), "block_ids"), keep(F.col("span_ids"), "span_ids"),
    )
