"""Names that the registry may lack: candidates in blocks without anchors, their support, and examples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of candidates, the cues of company names, terms of money and of other matters, words cut out of names.
UPPER = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,4}(?:\.[A-Z]{1,4})?(?![A-Za-z0-9])"
CHINESE = "[一-鿿]{2,8}"
CUES = ("出行", "科技", "集团", "股份", "控股", "汽车", "能源", "药业", "电子", "半导体", "机器人", "银行", "证券", "保险", "光伏", "电池", "雷达", "芯片", "聚创")
SUFFIX_CUES = ("出行", "科技", "集团", "股份", "控股", "汽车", "能源", "药业", "电子", "银行", "证券", "保险", "聚创")
FILLERS = ("这个", "那个", "我们", "他们", "一个", "没有", "什么", "因为", "所以", "但是", "如果", "就是", "可以", "不是", "现在", "今天", "明天", "昨天")
MONEY = ("目标价", "上市", "订单", "收入", "利润", "估值", "股价", "市值", "涨", "跌", "买", "卖", "仓", "持有", "港股", "美股", "A股", "公司", "财报", "业绩", "行业")
ELSEWHERE = ("冲突", "战争", "地缘", "美伊", "政策", "关税", "通胀", "降息", "非农", "会议", "教程", "工具")
LOW_RATE, THIN, A_BLOCK, RADIUS = 0.2, 40, 5, 32


@dataclass(frozen=True)
class Noise:
    """What is no name, by the curator's lists: tokens, whole phrases, beginnings, parts and ends."""

    tokens: tuple[str, ...] = ()
    phrases: tuple[str, ...] = CUES
    prefixes: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


def _any(hits: list[Column]) -> Column:
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def _has(text: Column, words: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in words])


def trimmed_name(raw: Column) -> Column:
    """A Chinese phrase without filler words, up to the end of its last company word."""
    name = raw
    for word in FILLERS:
        name = F.replace(name, F.lit(word), F.lit(""))
    ends = [F.when(F.contains(name, F.lit(c)), F.char_length(name) - F.instr(F.reverse(name), c[::-1]) + 1).otherwise(0) for c in SUFFIX_CUES]
    end = F.greatest(*ends)
    return F.when(end > 0, F.substring(name, F.lit(1), end)).otherwise(name)


def scan_reasons(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks without a span in contents that lack anchors, with ``reason``: zero_anchor or low_hit_rate.

    blocks (content_id, block_id, text), spans (content_id, block_id).  Contents without any span are scanned unless they are empty, of
    under 40 characters, or of other matters; contents of which under a fifth of the blocks have spans only in blocks that speak of money."""
    hit = spans.select(F.col("content_id").alias("__c"), F.col("block_id").alias("__b")).distinct()
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = blocks.join(hit, (F.col("content_id") == F.col("__c")) & (F.col("block_id") == F.col("__b")), "left").withColumn("__hit", F.col("__b").isNotNull())
    per = rows.groupBy(F.col("content_id").alias("__of")).agg(F.count("*").alias("n"), F.count_if("__hit").alias("hits"), F.sum(F.char_length(text)).alias("chars"), F.max(_has(F.col("text"), ELSEWHERE)).alias("elsewhere"))
    per = per.withColumn("why", F.when(F.col("hits") == 0, F.when((F.col("chars") >= THIN) & ~F.coalesce("elsewhere", F.lit(False)), "zero_anchor")).when(F.col("hits") / F.col("n") < LOW_RATE, "low_hit_rate")).where("why is not null")
    rows = rows.where(~F.col("__hit")).join(per, F.col("content_id") == F.col("__of"))
    return rows.where((F.col("why") == "zero_anchor") | _has(F.col("text"), MONEY)).select("content_id", "block_id", "text", F.col("why").alias("reason"))


def gap_candidates(blocks: DataFrame, spans: DataFrame, noise: Noise = Noise(), a_block: int = A_BLOCK) -> DataFrame:
    """One row a candidate and block: content_id, block_id, alias, kind, score, reason, snippet.

    Tokens of two to five capitals and digits go first, then Chinese phrases with a company word, each once a block and ``a_block`` at
    most, as they stand.  Null texts have none.  All work is within a row after the blocks have met their spans."""
    rows = scan_reasons(blocks, spans)
    noisy = lambda t: t.isin(*noise.tokens) | t.startswith("CAGR") | t.rlike("^[A-Z][0-9]$")
    upper = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(UPPER), F.lit(0))), lambda t: ~noisy(t))
    names = F.transform(F.regexp_extract_all("text", F.lit(CHINESE), F.lit(0)), trimmed_name)

    def named(n: Column) -> Column:
        bad = n.isin(*noise.phrases) | _any([n.startswith(p) for p in noise.prefixes]) | _any([n.endswith(s) for s in noise.suffixes]) | _has(n, noise.parts)
        return (F.char_length(n) >= 2) & ~bad & _has(n, CUES)

    cn = F.filter(F.array_distinct(names), named)
    kinds = lambda values, kind: F.transform(values, lambda a: F.struct(a.alias("alias"), F.lit(kind).alias("kind")))
    rows = rows.withColumn("found", F.slice(F.concat(kinds(upper, "upper_token"), kinds(cn, "cn_phrase")), 1, a_block))
    rows = rows.select("content_id", "block_id", "text", "reason", F.explode("found").alias("f")).select("content_id", "block_id", "f.alias", "f.kind", "reason", "text")
    n = F.char_length("alias")
    token = F.least(F.lit(0.8), 0.58 + F.when(F.contains("alias", F.lit(".")), 0.12).otherwise(0) + F.when(F.rlike("alias", F.lit("[0-9]")), 0.08).otherwise(0))
    phrase = F.lit(0.8) + F.when(n <= 4, 0.05).otherwise(0) - F.when(n > 6, 0.05).otherwise(0)
    place = F.instr(F.col("text"), F.col("alias"))
    low = F.greatest(F.lit(0), place - 1 - RADIUS)
    snippet = F.when(place == 0, F.substring("text", 1, 2 * RADIUS)).otherwise(F.substring(F.col("text"), low + 1, place - 1 - low + n + RADIUS))
    return rows.select("content_id", "block_id", "alias", "kind", F.round(F.when(F.col("kind") == "upper_token", token).otherwise(phrase), 2).alias("score"), "reason", F.regexp_replace(snippet, r"^\s+|\s+$", "").alias("snippet"))


def gap_support(candidates: DataFrame, registry: DataFrame, examples: int = 3) -> DataFrame:
    """Candidates that no alias of the registry covers: alias, kind, score, blocks, contents, and the first ``examples`` of them.

    registry (alias).  Counts are summed before the shuffle; examples are the least blocks, and Spark drops all beyond that number in
    each task before the shuffle, so a candidate of a third of all blocks sends but a few rows of each task."""
    known = registry.select(F.col("alias").alias("__a")).distinct()
    new = candidates.join(known, F.lower("alias") == F.lower("__a"), "left_anti")
    # a content is counted at its first block, after its blocks have been summed: no list of contents is kept
    per = new.groupBy("alias", "kind", "content_id").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    counts = per.groupBy("alias", "kind").agg(F.max("score").alias("score"), F.sum("n").alias("blocks"), F.count("*").alias("contents"))
    nth = F.row_number().over(Window.partitionBy("alias", "kind").orderBy("content_id", "block_id"))
    first = new.select("alias", "kind", "content_id", "block_id", "reason", "snippet").withColumn("nth", nth).where(F.col("nth") <= examples)
    lists = first.groupBy(F.col("alias").alias("__n"), F.col("kind").alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content_id", "block_id", "reason", "snippet"))), lambda x: F.struct(x.content_id.alias("content_id"), x.block_id.alias("block_id"), x.reason.alias("reason"), x.snippet.alias("snippet"))).alias("examples"))
    return counts.join(lists, (F.col("alias") == F.col("__n")) & (F.col("kind") == F.col("__k"))).drop("__n", "__k")
