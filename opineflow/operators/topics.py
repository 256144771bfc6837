"""Topics of contents: rules and a content's own anchors assign blocks, neighbours of one topic become one, long contents split by topic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opineflow.operators.anchoring import alias_hits

# Kind of an anchor -> type of its topic and how sure the rule is; other kinds are single stocks at 0.9.
ANCHOR_TOPICS = {"stock": ("single_stock", 0.95), "etf": ("single_stock", 0.95), "crypto": ("single_stock", 0.95), "index": ("market_commentary", 0.8), "sector": ("industry", 0.72)}
LEAST_BLOCKS, LEAST_CHARS, MOST_GROUPS = 8, 2400, 12
REST = "未分组"


@dataclass(frozen=True)
class TopicRule:
    key: str
    title: str
    type: str
    keywords: tuple[str, ...]
    entities: tuple[str, ...]
    confidence: float
    flags: tuple[str, ...] = ()


def anchor_rules(entries: Sequence[tuple[str, str, str, Sequence[str]]]) -> list[TopicRule]:
    """A rule an entry of a registry (symbol, raw text, kind, aliases): its aliases, raw text and symbol of two characters and more."""
    out, seen = [], set()
    for symbol, raw, kind, aliases in entries:
        words = tuple(dict.fromkeys(w for w in (*aliases, raw, symbol) if w and len(w) >= 2))
        if symbol and words and symbol not in seen:
            seen.add(symbol)
            topic, confidence = ANCHOR_TOPICS.get(kind, ("single_stock", 0.9))
            out.append(TopicRule(f"anchor:{symbol}", raw or symbol, topic, words, (symbol,), confidence))
    return out


def _table(blocks: DataFrame, rules: Sequence[TopicRule]) -> DataFrame:
    """The rules by key, in their order."""
    rows = [(r.key, i, r.title, r.type, r.entities[0] if r.entities else r.title or r.key, r.confidence, list(r.flags)) for i, r in enumerate(rules)]
    return blocks.sparkSession.createDataFrame(rows, "topic_key string, rule int, title string, topic_type string, identity string, confidence double, rule_flags array<string>")


def assign_topics(blocks: DataFrame, rules: Sequence[TopicRule], own: Sequence[TopicRule] = (), anchors: DataFrame | None = None) -> DataFrame:
    """``blocks`` (content_id, block_id, order_index, text) with topic_key, rule, title, topic_type, identity, confidence, rule_flags; null without a topic.

    Of the rules whose words stand in a block the surest wins, then the earlier one.  Words compare in lower case, Latin ones with no
    letter beside them, others anywhere.  ``own`` rules, made of a registry by ``anchor_rules``, hold only in contents whose ``anchors``
    (content_id, symbol) have that symbol.  All words go into one automaton, so a block is read once however many rules there are."""
    every = list({r.key: r for r in (*rules, *own)}.values())
    uses: dict[str, list[str]] = {}
    for r in every:
        for word in r.keywords:
            uses.setdefault(word.lower(), []).append(r.key)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("topic_key", "string"), ("rule", "int"), ("title", "string"), ("topic_type", "string"), ("identity", "string"), ("confidence", "double"), ("rule_flags", "array<string>"))]
    if not uses:
        return blocks.select("*", *empty)
    hits = alias_hits(blocks, ["content_id", "block_id"], "text", list(uses), border="letters", fold=True).select("content_id", "block_id", "alias").distinct()
    known = F.create_map(*[c for word, keys in uses.items() for c in (F.lit(word), F.array(*map(F.lit, keys)))])
    hits = hits.select("content_id", "block_id", F.explode(known[F.col("alias")]).alias("topic_key"))
    bound = [r.key for r in own]
    if bound:
        there = anchors.select(F.col("content_id").alias("__c"), F.concat(F.lit("anchor:"), F.col("symbol")).alias("__k")).distinct()
        held = hits.where(F.col("topic_key").isin(bound)).join(there, (F.col("content_id") == F.col("__c")) & (F.col("topic_key") == F.col("__k")), "left_semi")
        hits = hits.where(~F.col("topic_key").isin(bound)).unionByName(held)
    hits = hits.join(_table(blocks, every), "topic_key")
    best = F.max_by(F.struct("topic_key", "rule", "title", "topic_type", "identity", "confidence", "rule_flags"), F.struct(F.col("confidence"), -F.col("rule"))).alias("best")
    best = hits.groupBy(F.col("content_id").alias("__c"), F.col("block_id").alias("__b")).agg(best)
    out = blocks.join(best, F.col("content_id").eqNullSafe(F.col("__c")) & F.col("block_id").eqNullSafe(F.col("__b")), "left")
    return out.select(*blocks.columns, "best.*")


def topic_blocks(assigned: DataFrame) -> DataFrame:
    """Neighbouring blocks of one topic as one: content_id, run, topic_key, title, topic_type, identity, confidence, start_index, end_index,
    block_ids, raw_text, flags.  A block of another topic or of none ends a run; a run of one block is flagged."""
    order = Window.partitionBy("content_id").orderBy("order_index", "block_id")
    rows = assigned.withColumn("index", (F.row_number().over(order) - 1).cast("int"))
    rows = rows.withColumn("fresh", (F.col("topic_key").isNotNull() & ~F.lag("topic_key").over(order).eqNullSafe(F.col("topic_key"))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order).cast("int")).where("topic_key is not null")
    found = F.array_sort(F.collect_list(F.struct("index", "block_id", F.coalesce("text", F.lit("")).alias("text")))).alias("b")
    runs = rows.groupBy("content_id", "run", "topic_key", "title", "topic_type", "identity", "confidence", "rule_flags").agg(found)
    single = F.when(F.size("b") == 1, F.array(F.lit("single_block_topic"))).otherwise(F.array().cast("array<string>"))
    return runs.select(
        "content_id", "run", "topic_key", "title", "topic_type", "identity", "confidence", F.col("b")[0]["index"].alias("start_index"), F.element_at("b", -1)["index"].alias("end_index"),
        F.col("b.block_id").alias("block_ids"), F.array_join(F.col("b.text"), "\n\n").alias("raw_text"), F.concat("rule_flags", single).alias("flags"),
    )


def split_by_topic(assigned: DataFrame, least_blocks: int = LEAST_BLOCKS, least_chars: int = LEAST_CHARS, most_groups: int = MOST_GROUPS, force: bool = False) -> DataFrame:
    """Where each block of a long content goes: content_id, block_id, part, label.  Contents that stay whole have part 0 and no label.

    Split are contents of at least ``least_blocks`` blocks with text or ``least_chars`` characters (or all, with ``force``) that hold two
    runs of topics or more.  Runs of one identity are one part, in order of appearance; the ``most_groups`` with most blocks stay parts,
    and all other blocks, those without a topic too, are a last part of their own, so that no block is lost."""
    order = Window.partitionBy("content_id").orderBy("order_index", "block_id")
    whole = Window.partitionBy("content_id")
    filled = F.count_if(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "").over(whole)
    chars = F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(whole)
    fresh = F.col("topic_key").isNotNull() & ~F.lag("topic_key").over(order).eqNullSafe(F.col("topic_key"))
    rows = assigned.withColumn("__fresh", fresh).withColumn("__long", F.lit(force) | (filled >= least_blocks) | (chars >= least_chars))
    rows = rows.withColumn("__split", F.col("__long") & (F.count_if("__fresh").over(whole) >= 2))
    groups = rows.where("__split and topic_key is not null").groupBy("content_id", "identity").agg(F.count("*").alias("n"), F.min(F.struct("order_index", "block_id")).alias("first"), F.min_by("title", F.struct("order_index", "block_id")).alias("label"))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("content_id").orderBy(F.desc("n"), "first"))).where(F.col("place") <= most_groups)
    groups = groups.withColumn("part", F.row_number().over(Window.partitionBy("content_id").orderBy("first")).cast("int"))
    groups = groups.select(F.col("content_id").alias("__c"), F.col("identity").alias("__i"), "part", "label")
    out = rows.join(groups, F.col("content_id").eqNullSafe(F.col("__c")) & (F.col("identity") == F.col("__i")), "left")
    last = F.coalesce(F.max("part").over(whole), F.lit(0)) + 1
    part = F.when(~F.col("__split"), 0).otherwise(F.coalesce("part", last)).cast("int")
    label = F.when(F.col("__split"), F.coalesce("label", F.lit(REST)))
    return out.select("content_id", "block_id", part.alias("part"), label.alias("label"))
