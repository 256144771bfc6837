"""Intents by rules: sections under headings, their target, stance and evidence; and a check of intents that a model proposed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opineflow.operators.anchoring import alias_hits

# The words of stances, actions, cautions, watch lists and horizons.
BULLISH = ("看好", "受益", "机会", "加仓", "抄底", "持有", "买入", "增持", "推荐", "优质", "低估", "值得", "翻倍", "扭亏为盈", "性价比", "入场", "埋伏", "买不了吃亏")
BEARISH = ("看空", "减仓", "退出", "不及预期", "风险", "回避", "卖出", "清仓", "减持", "高估", "谨慎", "亏损", "走弱", "落后", "透支", "回落", "下跌", "卖就卖")
BEARISH_STANCE = ("看空", "减仓", "清仓", "卖出", "减持", "退出", "回避", "走弱", "回落", "下跌", "落后", "不及预期", "卖就卖")
CAUTION = ("风险", "谨慎", "高估", "透支")
ACTIONS = ("加仓", "抄底", "买入", "卖出", "减仓", "清仓", "退出", "增持", "减持", "建仓", "入场")
ADDING = ("加仓", "抄底", "买入", "增持", "建仓", "入场")
HOLDING = ("持有", "继续拿", "拿着", "不动", "继续持有")
WATCHING = ("看好", "关注", "观察", "留意", "值得", "埋伏")
MONITORING = ("观察", "左侧", "右侧", "破位", "周线", "溢价", "转折价", "盯", "跟踪")
STANCES = ("看好", "看空")
ALLOCATION = ("仓位配置", "账户配置", "资产配置")
ALLOCATION_SPLIT = r"[0-9]+\s*(?:成|%|％)?\s*(?:进攻|防守|现金)"
RISK_NOTES = ("风险高于价值", "回落的风险", "透支")
HOLD_AND_ADD = ("加仓", "买入", "增持", "入场")
RELATIVE_TIMES = ("上周", "这周", "下周", "上个月", "下个月", "短期")
HORIZONS = (("short_term", ("短期", "日内", "短线")), ("long_term", ("长期", "年度")), ("medium_term", ("2026年", "全年", "季度")))
SKIPPED = (r"^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日\s+[0-9]{1,2}:[0-9]{2}$", r"^>\s*\*")
# Which kind of target goes before which, and what an intent calls it.
PRIORITY = {"ticker": 0, "etf": 0, "crypto": 1, "commodity": 1, "sector": 2, "index": 3, "macro": 4}
TARGET_TYPES = {"ticker": "stock", "index": "index", "crypto": "crypto", "sector": "sector"}
#: A registry's entry: name, symbol, market, kind.
Entry = tuple[str, str, str, str]


def _hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words stand in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def _has(text: Column, words: Sequence[str]) -> Column:
    return _hits(text, words) > 0


def skipped(text: Column, more: Sequence[str] = ()) -> Column:
    """Blocks that say nothing: under four characters, a question of one line, time stamps, quoted marks, and patterns of the caller's own."""
    def silent(t: Column) -> Column:
        out = (F.char_length(t) < 4) | (t.rlike(r"^Q[:：]\s*") & ~F.contains(t, F.lit("\n")))
        for pattern in (*SKIPPED, *more):
            out = out | t.rlike(pattern)
        return out

    # within an array, as a filter works out anew each expression that stands in it more than once
    return F.coalesce(F.exists(F.array(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))), silent), F.lit(True))


def in_sections(blocks: DataFrame) -> DataFrame:
    """``blocks`` (content_id, block_id, order_index, block_type, text) with ``section``, ``heading`` and ``is_heading``.

    A heading of level two or deeper opens a section, which reaches to the next one: the last heading is carried forward over the blocks
    of a content.  What stands before the first heading has no section and goes; a content without such headings has a section a block."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    opens = (F.col("block_type") == "heading") & text.rlike(r"^#{2,}\s+")
    whole = Window.partitionBy("content_id")
    so_far = whole.orderBy("order_index", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("is_heading", F.coalesce(opens, F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    at = F.when(F.col("is_heading"), F.col("order_index"))
    rows = rows.withColumn("heading", F.last(F.when(F.col("is_heading"), text), ignorenulls=True).over(so_far)).withColumn("section", F.last(at, ignorenulls=True).over(so_far))
    none = ~F.max("is_heading").over(whole)
    return rows.withColumn("section", F.when(none, F.col("order_index")).otherwise(F.col("section"))).where("section is not null")


def direction(text: Column) -> Column:
    """bullish, bearish, mixed, neutral for caution alone, null for nothing; caution weighs against a bullish word."""
    return _leaning(_hits(text, BULLISH), _hits(text, BEARISH_STANCE), _hits(text, CAUTION))


def _leaning(up: Column, bearish: Column, caution: Column) -> Column:
    down = bearish + F.when(up > 0, caution).otherwise(0)
    return F.when(up > down, "bullish").when(down > up, "bearish").when(up > 0, "mixed").when(caution > 0, "neutral")


def actionability(text: Column) -> Column:
    """struct(actionability, delta): the first word of action that stands in the text decides, in the list's order."""
    pair = lambda kind, delta: F.struct(F.lit(kind).alias("actionability"), F.lit(delta).alias("delta"))
    out = None
    for word in ACTIONS:
        value = pair("explicit_action", "add" if word in ADDING else "reduce")
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    out = out.when(_has(text, HOLDING), pair("explicit_action", "hold"))
    for word in WATCHING:
        out = out.when(F.contains(text, F.lit(word)), pair("opinion" if word == "看好" else "watch", "none"))
    return out.when(_has(text, ("卖就卖", "该卖")), pair("opinion", "exit")).otherwise(pair("opinion", "none"))


def section_kind(text: Column) -> Column:
    """monitoring or allocation where a section is a watch list or a plan of positions and holds no action or stance; else null."""
    marks = lambda c: F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))) / len(c))
    monitored = _hits(text, MONITORING) + F.when((marks("[]") >= 2) | (marks("□") >= 2), 2).otherwise(0)
    allocated = (F.regexp_count(text, F.lit(ALLOCATION_SPLIT)) >= 2) | _has(text, ALLOCATION)
    return F.when(_has(text, ACTIONS) | _has(text, STANCES), None).when(allocated, "allocation").when(monitored >= 2, "monitoring")


def _targets(sections: DataFrame, registry: Sequence[Entry]) -> DataFrame:
    """The target of each section (content_id, section, heading, text): the heading's own name, a name in it, or one in the text.

    Of several names the more tradable kind goes first, then the longer name, then the registry's order."""
    order = sorted(range(len(registry)), key=lambda i: (PRIORITY.get(registry[i][3], 5), -len(registry[i][0])))
    rank = F.create_map(*[F.lit(x) for place, i in enumerate(order) for x in (registry[i][0], place)])
    entries = F.create_map(*[c for name, symbol, market, kind in registry for c in (F.lit(name), F.struct(F.lit(symbol).alias("symbol"), F.lit(market).alias("market"), F.lit(TARGET_TYPES.get(kind, "stock")).alias("type")))])
    title = F.regexp_replace(F.regexp_replace(F.coalesce("heading", F.lit("")), r"^#{1,6}\s+", ""), r"^\s+|\s+$", "")
    places = sections.select("content_id", "section", title.alias("title"), F.explode(F.array(F.struct(F.lit(1).alias("place"), title.alias("words")), F.struct(F.lit(2).alias("place"), F.col("text").alias("words")))).alias("p"))
    places = places.select("content_id", "section", "title", "p.place", "p.words")
    hits = alias_hits(places, ["content_id", "section", "title", "place"], "words", [e[0] for e in registry], border="none")
    exact = (F.col("place") == 1) & (F.col("title") == F.col("alias"))
    best = F.min_by("alias", F.struct(F.when(exact, 0).otherwise(F.col("place")), rank[F.col("alias")])).alias("name")
    return hits.groupBy("content_id", "section").agg(best).select(F.col("content_id").alias("__c"), F.col("section").alias("__s"), "name", entries[F.col("name")].alias("entry"))


def rule_intents(blocks: DataFrame, registry: Sequence[Entry], more_skipped: Sequence[str] = (), anchors: DataFrame | None = None) -> DataFrame:
    """One row an intent: content_id, section, target and its type, symbol and market, direction, actionability, delta, conviction,
    confidence, horizon, flags, block_ids and evidence (block_id, start, end, text) in order.

    A section with a stance and at least one word of it in some block is an intent.  Sections that only watch or allocate are neutral
    and flagged.  ``anchors`` (content_id, place, name, symbol, market, type) give a content's first anchor to sections without a
    target.  Null texts are empty and say nothing; a registry is a curated list.  A content's blocks meet in one window, sections in one
    group: both are bounded by a document, not by the corpus."""
    rows = in_sections(blocks).where(~F.col("is_heading")).where(~skipped(F.col("text"), more_skipped))
    words = alias_hits(rows, ["content_id", "section", "order_index", "block_id"], "text", [*BULLISH, *BEARISH], border="none")
    spans = words.groupBy("content_id", "section").agg(F.sort_array(F.collect_list(F.struct("order_index", "block_id", "start", "end", F.col("alias").alias("text")))).alias("spans"))
    # the text is made by the aggregate itself: above it, the filter on stances would join the parts anew for every word it looks for
    parts = F.array_sort(F.collect_list(F.struct("order_index", "block_id", "text")))
    whole = rows.groupBy("content_id", "section").agg(F.first("heading", ignorenulls=True).alias("heading"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    found = _targets(whole, registry)
    s = whole.join(spans, ["content_id", "section"]).join(found, F.col("content_id").eqNullSafe(F.col("__c")) & (F.col("section") == F.col("__s")), "left").drop("__c", "__s")
    if anchors is not None:
        first = anchors.groupBy(F.col("content_id").alias("__a")).agg(F.min_by(F.struct("name", "symbol", "market", "type"), "place").alias("anchor"))
        s = s.join(first, F.col("content_id") == F.col("__a"), "left").drop("__a")
    else:
        s = s.withColumn("anchor", F.lit(None).cast("struct<name:string,symbol:string,market:string,type:string>"))
    # exploded, so that each word is looked for once: what a filter or several columns read would be worked out anew for each
    text = F.col("text")
    counts = {"up": BULLISH, "against": BEARISH_STANCE, "caution": CAUTION, "bearish": BEARISH}
    said = F.struct(section_kind(text).alias("kind"), actionability(text).alias("acts"), *[_hits(text, words).alias(c) for c, words in counts.items()])
    s = s.withColumn("said", F.explode(F.array(said))).select("*", "said.*").drop("said")
    stance = F.when(F.col("kind").isNotNull(), "neutral").otherwise(_leaning(F.col("up"), F.col("against"), F.col("caution")))
    s = s.withColumn("stance", stance).where("stance is not null")
    s = s.select(
        "content_id", "section", F.coalesce("name", "anchor.name", F.lit("unknown")).alias("target"),
        F.coalesce(F.col("entry.type"), F.when(F.col("name").isNull(), F.col("anchor.type")), F.lit("unknown")).alias("target_type"),
        F.when(F.col("name").isNotNull(), F.col("entry.symbol")).otherwise(F.col("anchor.symbol")).alias("symbol"), F.when(F.col("name").isNotNull(), F.col("entry.market")).otherwise(F.col("anchor.market")).alias("market"),
        F.col("stance").alias("direction"), F.when(F.col("kind").isNotNull(), "watch").otherwise(F.col("acts.actionability")).alias("actionability"), F.when(F.col("kind").isNotNull(), "none").otherwise(F.col("acts.delta")).alias("delta"),
        "kind", "text", "spans", (F.col("up") + F.col("bearish")).alias("signals"),
    )
    flags = [
        (F.col("kind") == "monitoring", "nondirectional_monitoring"), (F.col("kind") == "allocation", "nondirectional_allocation"), (F.col("target") == "unknown", "unknown_target"), (_has(text, RISK_NOTES), "risk_warning"),
        (_has(text, ("等跌到", "以下再")), "wait_for_better_entry"), (F.contains(text, F.lit("修复空间")) & F.contains(text, F.lit("有限")), "limited_upside"),
        (_has(text, HOLDING) & _has(text, HOLD_AND_ADD), "hold_and_add_compound"), (_has(text, RELATIVE_TIMES), "relative_time_unresolved"),
    ]
    signals = F.col("signals")
    horizon = None
    for name, terms in HORIZONS:
        horizon = F.when(_has(text, terms), name) if horizon is None else horizon.when(_has(text, terms), name)
    s = s.withColumn("flags", F.filter(F.array(*[F.when(c, F.lit(f)) for c, f in flags]), lambda f: f.isNotNull()))
    sure = F.when(F.coalesce("symbol", F.lit("")) != "", 0.85).when(F.col("target_type").isin("sector", "index"), 0.75).otherwise(0.7)
    return s.select(
        "content_id", "section", "target", "target_type", "symbol", "market", "direction", "actionability", "delta", F.when(signals >= 5, 0.75).when(signals >= 3, 0.65).otherwise(0.55).alias("conviction"),
        F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.95), sure - 0.05 * F.size("flags"))), 3).alias("confidence"), horizon.otherwise("unknown").alias("horizon"), "flags",
        F.array_distinct(F.col("spans.block_id")).alias("block_ids"), F.transform("spans", lambda x: F.struct(x.block_id.alias("block_id"), x.start.alias("start"), x["end"].alias("end"), x.text.alias("text"))).alias("evidence"),
    )


def checked_intents(intents: DataFrame, spans: DataFrame, anchors: DataFrame) -> DataFrame:
    """``intents`` with ``rejected``, the first reason against a row, null for those that stay, whose symbol becomes their anchor's.

    intents (content_id, intent_id, direction, target, symbol, market, target_type), spans (intent_id, span_type, text), anchors
    (content_id, place, symbol, names, market, type).  An intent needs a quotation that stands in a block word for word
    (``intent_keyword``), whose words don't lean the other way, and a target that its content's anchors know: by symbol, or by a name
    that holds the target or stands in it, the first anchor by place.  Contents without anchors are not held to the last."""
    quoted = spans.where("span_type = 'intent_keyword'").groupBy(F.col("intent_id").alias("__i")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("quote"))
    known = anchors.groupBy(F.col("content_id").alias("__c")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "names", "market", "type"))).alias("anchors"))
    rows = intents.join(quoted, F.col("intent_id") == F.col("__i"), "left").join(known, F.col("content_id") == F.col("__c"), "left")
    by_symbol = F.filter("anchors", lambda a: a.symbol == F.col("symbol"))
    named = lambda n: (n != "") & (F.contains(F.col("target"), n) | F.contains(n, F.col("target")))
    by_name = F.filter("anchors", lambda a: F.coalesce(F.exists(a.names, lambda n: F.coalesce(named(n), F.lit(False))), F.lit(False)))
    match = F.when(F.coalesce("symbol", F.lit("")) != "", F.get(by_symbol, F.lit(0)))
    match = F.coalesce(match, F.when(F.coalesce("target", F.lit("")) != "", F.get(by_name, F.lit(0))))
    up, down = _hits(F.col("quote"), BULLISH), _hits(F.col("quote"), BEARISH)
    against = ((F.col("direction") == "bullish") & (down > up)) | ((F.col("direction") == "bearish") & (up > down))
    rows = rows.withColumn("match", match)
    why = F.when(F.col("quote").isNull(), "evidence_not_verbatim").when(against, "direction_conflicts_evidence").when(F.col("anchors").isNotNull() & F.col("match").isNull(), "target_not_anchored")
    moved = F.col("match").isNotNull() & ~F.col("symbol").eqNullSafe(F.col("match.symbol"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in TARGET_TYPES.items() for x in pair])[F.coalesce("match.type", F.lit(""))], F.col("target_type"))
    fixed = {"symbol": F.when(moved, F.col("match.symbol")).otherwise(F.col("symbol")), "market": F.when(moved, F.coalesce(F.when(F.col("match.market") != "", F.col("match.market")), "market")).otherwise(F.col("market")), "target_type": F.when(moved, kind).otherwise(F.col("target_type"))}
    rows = rows.withColumn("rejected", why)
    keep = F.col("rejected").isNull()
    return rows.select(*[F.when(keep, fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in intents.columns], "rejected")
