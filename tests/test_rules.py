"""Sections, stances and evidence of rule intents, the check of proposed ones, topics and their parts on hand-made contents."""

import re

import pytest
from pyspark.sql import functions as F

from opineflow.operators import intent_rules as ir
from opineflow.operators import topics as tp

REGISTRY = [("宁德时代", "300750.SZ", "CN", "ticker"), ("上证", "000001.SH", "CN", "index"), ("光模块", "", "CN", "sector"), ("腾讯", "0700.HK", "HK", "ticker"), ("腾讯控股", "0700.HK", "HK", "ticker")]
BLOCKS = "content_id string, block_id string, order_index int, block_type string, text string, section string, heading int"


def blocks(spark, **contents):
    rows = [(c, f"{c}{i}", i, "heading" if (t or "").startswith("#") else "paragraph", t, "clash", 0) for c, texts in contents.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCKS).drop("section", "heading").repartition(3)


def test_rule_intents(spark):
    contents = {
        "a": ["看好宁德时代，加仓", "没有观点", None, ""],  # no heading: a section a block
        "b": ["看好上证", "## 光模块", "业绩受益", "看空后市", "# 一级标题", "买入一些", "### 上证与腾讯控股", "> * 引用 买入", "Q: 买入?", "2026年7月1日 10:30", "清仓离场"],
        "c": ["SP风险变高"], "d": ["观察 左侧 破位 风险"], "e": ["观察 左侧 减仓"], "f": ["60进攻+20防守+20现金，低估"], "g": ["看好但注意风险"], "h": ["分配利润，现金流改善，受益"],
        "i": ["持有持有"], "j": ["买不了吃亏，短线"], "k": ["    "],
    }
    got = {(r.content_id, r.section): r for r in ir.rule_intents(blocks(spark, **contents), REGISTRY).collect()}
    assert set(got) == {("a", 0), ("b", 1), ("b", 6), ("c", 0), ("d", 0), ("e", 0), ("f", 0), ("g", 0), ("h", 0), ("i", 0), ("j", 0)}
    a, b1, b6 = got["a", 0], got["b", 1], got["b", 6]
    assert (a.target, a.symbol, a.target_type, a.direction, a.actionability, a.delta, a.confidence, a.block_ids) == ("宁德时代", "300750.SZ", "stock", "bullish", "explicit_action", "add", 0.85, ["a0"])
    assert [(e.block_id, e.start, e.end, e.text) for e in a.evidence] == [("a0", 0, 2, "看好"), ("a0", 7, 9, "加仓")]
    assert (b1.target, b1.symbol, b1.direction, b1.block_ids, b1.confidence) == ("光模块", "", "bullish", ["b2", "b3", "b5"], 0.75)
    assert (b6.target, b6.direction, b6.delta, b6.block_ids) == ("腾讯控股", "bearish", "reduce", ["b10"])
    assert (got["c", 0].direction, got["c", 0].target, got["c", 0].flags) == ("neutral", "unknown", ["unknown_target"])
    assert (got["d", 0].direction, got["d", 0].actionability, got["d", 0].flags) == ("neutral", "watch", ["nondirectional_monitoring", "unknown_target"])
    assert got["e", 0].direction == "bearish" and got["f", 0].flags[0] == "nondirectional_allocation" and got["g", 0].direction == "mixed" and got["h", 0].direction == "bullish"
    assert [e.start for e in got["i", 0].evidence] == [0, 2] and got["i", 0].delta == "hold" and got["j", 0].horizon == "short_term"


def test_rule_intents_fall_back_on_anchors(spark):
    anchors = spark.createDataFrame([("a", 2, "后", "X", "US", "stock"), ("a", 1, "先", "Y", "HK", "sector")], "content_id string, place int, name string, symbol string, market string, type string")
    got = ir.rule_intents(blocks(spark, a=["看好它的"], b=["看好它的"]), REGISTRY, anchors=anchors).collect()
    assert {(r.content_id, r.target, r.symbol, r.target_type, r.market) for r in got} == {("a", "先", "Y", "sector", "HK"), ("b", "unknown", None, "unknown", None)}
    assert ir.rule_intents(blocks(spark, a=["看好它的"]).limit(0), REGISTRY).count() == 0


def test_checked_intents(spark):
    intents = [("c", "1", "bullish", "腾讯", "0700.HK"), ("c", "2", "bullish", "腾讯", "0700.HK"), ("c", "3", "bullish", "腾讯控股有限公司", "MADEUP"), ("c", "4", "bearish", "别的", "NONE"), ("d", "5", "bearish", "别的", "NONE"), ("c", "6", "bullish", None, None), ("c", "7", "neutral", "腾讯", None)]
    spans = [("1", "intent_keyword", "看好"), ("2", "block_level", "看好"), ("3", "intent_keyword", "看好"), ("4", "intent_keyword", "卖出"), ("5", "intent_keyword", "卖出"), ("6", "intent_keyword", "看好 走弱 回落"), ("7", "intent_keyword", "x")]
    anchors = [("c", 1, "0700.HK", ["腾讯", None], "HK", "ticker"), ("c", 2, None, None, None, None)]
    got = ir.checked_intents(
        spark.createDataFrame([(*r, "US", "sector") for r in intents], "content_id string, intent_id string, direction string, target string, symbol string, market string, target_type string"),
        spark.createDataFrame(spans, "intent_id string, span_type string, text string"),
        spark.createDataFrame(anchors, "content_id string, place int, symbol string, names array<string>, market string, type string"),
    ).collect()
    by = {r.intent_id: (r.rejected, r.symbol, r.market, r.target_type) for r in got}
    assert by == {
        "1": (None, "0700.HK", "US", "sector"), "2": ("evidence_not_verbatim", "0700.HK", "US", "sector"), "3": (None, "0700.HK", "HK", "stock"), "4": ("target_not_anchored", "NONE", "US", "sector"),
        "5": (None, "NONE", "US", "sector"), "6": ("direction_conflicts_evidence", None, "US", "sector"), "7": (None, "0700.HK", "HK", "stock"),
    }


RULES = [tp.TopicRule("pop", "Pop", "single_stock", ("POP MART", "泡泡"), ("P",), 0.9), tp.TopicRule("wide", "Wide", "industry", ("理想", "pop"), ("W",), 0.9, ("short_keyword",)), tp.TopicRule("low", "Low", "industry", ("泡泡", "x1"), (), 0.5)]


def test_topics(spark):
    texts = ["Pop Mart rises", "泡泡 again", "popcorn", "POP", "理想", "x1", "TENCENT", "腾讯", None, "x1"]
    rows = blocks(spark, a=texts, b=["tencent"]).drop("block_type")
    own = tp.anchor_rules([("0700.HK", "腾讯", "stock", ["Tencent", "t"]), ("0700.HK", "again", "stock", []), ("", "none", "stock", [])])
    assert [(r.key, r.keywords, r.confidence) for r in own] == [("anchor:0700.HK", ("Tencent", "腾讯", "0700.HK"), 0.95)]
    anchors = spark.createDataFrame([("a", "0700.HK"), ("a", "0700.HK")], "content_id string, symbol string")
    assigned = tp.assign_topics(rows, RULES, own, anchors)
    by = {r.block_id: r.topic_key for r in assigned.collect()}
    assert by == {"a0": "pop", "a1": "pop", "a2": None, "a3": "wide", "a4": "wide", "a5": "low", "a6": "anchor:0700.HK", "a7": "anchor:0700.HK", "a8": None, "a9": "low", "b0": None}
    runs = {r.run: (r.topic_key, r.start_index, r.end_index, r.block_ids, r.flags) for r in tp.topic_blocks(assigned).collect()}
    assert runs == {1: ("pop", 0, 1, ["a0", "a1"], []), 2: ("wide", 3, 4, ["a3", "a4"], ["short_keyword"]), 3: ("low", 5, 5, ["a5"], ["single_block_topic"]), 4: ("anchor:0700.HK", 6, 7, ["a6", "a7"], []), 5: ("low", 9, 9, ["a9"], ["single_block_topic"])}
    parts = {r.block_id: (r.part, r.label) for r in tp.split_by_topic(assigned, most_groups=3).collect()}
    assert parts == {"a0": (1, "Pop"), "a1": (1, "Pop"), "a2": (4, tp.REST), "a3": (2, "Wide"), "a4": (2, "Wide"), "a5": (3, "Low"), "a9": (3, "Low"), "a6": (4, tp.REST), "a7": (4, tp.REST), "a8": (4, tp.REST), "b0": (0, None)}
    assert {r.part for r in tp.split_by_topic(assigned, least_blocks=99).collect()} == {0}
    assert {r.part for r in tp.split_by_topic(assigned, least_blocks=99, force=True).where("content_id = 'a'").collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("rules", [[], RULES])
def test_no_blocks(spark, rules):
    assert tp.split_by_topic(tp.assign_topics(blocks(spark, a=["x"]).limit(0).drop("block_type"), rules)).count() == 0


def test_emotions(spark):
    from opineflow.operators import emotion as em

    lexicon = [("看好", "bullish"), ("担心", "fear"), ("惊喜", "surprise"), ("happy", "joy"), ("Loss", "sadness")]
    texts = ["非常看好", "不看好", "非常非常担心 看好", "未来看好", "无论担心", "没惊喜", "Very HAPPY, never a loss", "", None, "x", "看好 不看好", "不" + "x" * 10 + "担心", "happy 担心"]
    docs = spark.createDataFrame([(1, "\n".join(t or "" for t in texts)), (None, None), (3, " \n ")], "doc_id int, text string")
    rows = em.paragraphs(docs)
    kept = [t for t in texts if t]
    assert [r.text for r in rows.orderBy("pos").collect()] == kept
    got = {kept[r.pos]: (r.emotion, r.score, r.intensity, r.words) for r in em.paragraph_emotions(rows, lexicon).collect()}
    assert got == {
        "非常看好": ("bullish", 1.0, 0.3, 1), "不看好": ("bearish", -1.0, 0.2, 1), "非常非常担心 看好": ("bullish", 0.0, 0.6, 2), "未来看好": ("bullish", 1.0, 0.2, 1), "无论担心": ("fear", -1.0, 0.2, 1), "没惊喜": ("neutral", 0.0, 0.2, 1),
        "Very HAPPY, never a loss": ("joy", 1.0, 0.5, 2), "x": ("neutral", 0.0, 0.0, 0), "看好 不看好": ("bullish", 1.0, 0.2, 1), "不" + "x" * 10 + "担心": ("fear", -1.0, 0.2, 1), "happy 担心": ("fear", 0.0, 0.4, 2),
    }
    assert {r.emotion for r in em.paragraph_emotions(rows, []).collect()} == {"neutral"}


def test_texts_of_sections_are_joined_once(spark):
    got = ir.rule_intents(blocks(spark, a=["看好腾讯", "卖出"]), REGISTRY)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(transform(array_sort(collect_list(") == 2  # the targets' and the intents' own, whatever words are looked for
    assert not re.search(r"contains\(array_join", plan) and not re.search(r"Filter [^\n]*看空", plan)  # each word is looked for once
    texts = ["看好", "看好了吧", " Q: 买入? ", "Q: 买入?\n看好", "  2026年1月2日 10:30 ", None, "> * 看好", "　看好了吧"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ir.skipped(F.col("t")).alias("s"), ir.skipped(F.col("t"), ["吧$"]).alias("more")).orderBy("i").collect()
    assert [r.s for r in rows] == [True, False, True, False, True, True, True, False] and rows[1].more and rows[7].more
