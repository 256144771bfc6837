"""Grounding, lineage, composition with reasons, reports as intents, sentences around spans, gap candidates."""

from collections import Counter

from pyspark.sql import functions as F

from opineflow.operators import composition as cp
from opineflow.operators import gaps

INTENTS = "intent_id string, content_id string, target string, target_type string, symbol string, market string, direction string, block_ids array<string>"
MAPPED = "policy_id string, intent_id string, hint string, sizing string, holding string, review boolean, reason string"


def tables(spark):
    anchors = spark.createDataFrame([("c", 2, "TSLA", ["s3", "s1", "gone"]), ("c", 1, "TSLA", ["s1"]), ("c", 3, "EMPTY", ["gone"]), ("c", 4, None, ["s2"])], "content_id string, place int, symbol string, span_ids array<string>")
    spans = spark.createDataFrame([("c", "s1", "b1", 0, 2, "特斯"), ("c", "s2", "b2", 5, 7, "x"), ("c", "s3", "b1", 6, 8, "y"), ("d", "s9", "b9", None, None, " own ")], "content_id string, span_id string, block_id string, start int, end int, text string")
    blocks = spark.createDataFrame([("c", "b1", "特斯拉涨。买入它吧！后来"), ("c", "b2", "a\nb c| d\ne")], "content_id string, block_id string, text string")
    return anchors, spans, blocks


def test_sentences(spark):
    _, spans, blocks = tables(spark)
    got = {r.span_id: r.snippet for r in cp.sentence_windows(spans, blocks).collect()}
    assert got == {"s1": "特斯拉涨。", "s2": "b c| d", "s3": "买入它吧！", "s9": "own"}
    long = spark.createDataFrame([("x" * 500 + "。" + "y" * 300, 400, 402)], "t string, s int, e int")
    assert long.select(cp.sentence_around(F.col("t"), F.col("s"), F.col("e"))).first()[0] == "x" * 220 + "。"


def test_grounding(spark):
    anchors, spans, _ = tables(spark)
    rows = [("1", "c", "TSLA", ["b2"]), ("2", "c", "EMPTY", ["b2", "b1", "b2"]), ("3", "c", None, ["b1"]), ("4", "c", "NONE", []), ("5", "e", "TSLA", None)]
    got = {r.intent_id: (r.evidence_ids, r.grounded_by) for r in cp.grounded(spark.createDataFrame(rows, "intent_id string, content_id string, symbol string, block_ids array<string>"), anchors, spans).collect()}
    assert got == {"1": (["s1", "s3"], "symbol"), "2": (["s2", "s1", "s3"], "block"), "3": (["s1", "s3"], "block"), "4": ([], None), "5": ([], None)}


def test_lineage(spark):
    anchors = spark.createDataFrame([("c", 1, " 0700.hk", "s0", [("b1", "s1"), ("b1", "s2")]), ("c", 2, "TCEHY", None, [("b2", None)]), ("d", 1, "TCEHY", "s8", None)], "content_id string, place int, symbol string, span_id string, occurrences array<struct<block_id:string,span_id:string>>")
    reports = [("r1", "c", "0700.HK", ["0700.HK", "TCEHY"]), ("r2", "c", "0700.HK", ["TCEHY"]), ("r3", "c", None, ["TCEHY"]), ("r4", "d", "TCEHY", None), ("r5", "e", "TCEHY", [])]
    got = {r.report_id: (r.block_ids, r.span_ids) for r in cp.lineage_matches(spark.createDataFrame(reports, "report_id string, content_id string, target string, segments array<string>"), anchors).collect()}
    assert got == {"r1": (["b1", "b2"], ["s1", "s2", "s0"]), "r2": (["b1"], ["s1", "s2", "s0"]), "r3": ([], []), "r4": ([], ["s8"]), "r5": ([], [])}


def test_composition(spark):
    anchors, spans, blocks = tables(spark)
    intents = spark.createDataFrame([
        ("ok", "c", "特斯拉", "stock", "TSLA", "US", "mixed", ["b1"]), ("sector", "c", "光模块", "sector", "OPT", "CN", "bullish", ["b1"]), ("default", "c", "储能", "sector", "ES", "HK", "bearish", ["b2"]), ("lost", "c", "x", "sector", "NOPE", "CN", "bullish", ["b1"]),
        ("none", "c", "", "stock", None, None, "bullish", []), ("name", "c", "特斯拉", "stock", None, None, "bullish", ["b1"]), ("pseudo", "c", "x", "stock", "MADEUP_1", None, "bullish", ["b1"]), ("ground", "c", "x", "stock", "AAPL", None, "bullish", []), ("bare", "z", "x", "company", "AAPL", None, "bullish", []),
        ("listed", "c", "x", "index", "000001.SH2", "CN", "bullish", ["b2"]),
    ], INTENTS)
    proxies = spark.createDataFrame([("OPT", "CN", "515880.SH", "通信"), ("ES", None, "159566.SZ", "储能")], "sector string, market string, symbol string, name string")
    hints = [("ok", "open_position"), ("ok", "reduce_position"), ("ok", "hold_position"), ("ok", "sell_all"), ("ok", None), ("sector", "watch_only"), ("default", "add_position"), ("gone", "add_position"), *((i, "add_position") for i in ("lost", "none", "name", "pseudo", "ground", "bare", "listed"))]
    mapped = spark.createDataFrame([(f"p{k}", i, h, "small" if k else "none", "short_term", k % 2 == 0, "clash") for k, (i, h) in enumerate(hints)], MAPPED).drop("reason")
    got = cp.compose_actions(mapped, intents, proxies, anchors, spans, blocks, ("000001.SH2",)).collect()
    assert len(got) == len(hints)
    by = {r.policy_id: r for r in got}
    assert [by[f"p{k}"].reason for k in range(len(hints))] == [None, None, None, "non_executable_action_hint", "non_executable_action_hint", None, None, "intent_not_found", "sector_proxy_not_configured", "no_ticker_symbol", "unresolved_target_symbol", "pseudo_ticker_symbol", "evidence_not_grounded", None, None]
    assert [(by[p].direction, by[p].action, by[p].position_pct) for p in ("p0", "p1", "p2")] == [("neutral", "long", None), ("bearish", "reduce", 0.05), ("neutral", "hold", 0.05)]
    assert (by["p5"].ticker, by["p5"].market, by["p5"].instrument, by["p5"].tier, by["p5"].evidence_ids) == ("515880.SH", "CN", "etf", "opinion", ["s1", "s3"])
    assert (by["p6"].ticker, by["p6"].direction, by["p6"].tier) == ("159566.SZ", "bearish", "trade")
    assert by["p0"].evidence_text == "特斯拉涨。 | 买入它吧！" and (by["p13"].evidence_ids, by["p13"].market, by["p13"].evidence_text) == ([], "CN", "")
    assert by["p7"].ticker is None and by["p7"].evidence_ids is None


def test_reports(spark):
    rows = [("1", "Buy", "700 ", "x/0700.HK", None), ("2", None, "A", None, None), ("3", " ", "A", None, None), ("4", "Not-Rated", "A", None, None), ("5", "superb", "A", None, None), ("6", "hold", None, " / ", 2.0), ("7", "Underweight", "", "TCEHY/0700.HK", 6.0), ("8", "Neutral", None, "b/a", 7.0)]
    reports = spark.createDataFrame([(i, f"c{i}", c, t, " Co ", r, "sell", None, 10.0 if i == "7" else None, None, m, "2026-01-01") for i, r, c, t, m in rows], "report_id string, content_id string, stock_code string, ticker string, company string, rating string, rating_prior string, rating_action string, target_price double, currency string, horizon_months double, day string")
    anchors = spark.createDataFrame([("c7", 1, "TCEHY", "s", None)], "content_id string, place int, symbol string, span_id string, occurrences array<struct<block_id:string,span_id:string>>")
    by = {r.report_id: r for r in cp.report_intents(reports, anchors).collect()}
    assert {i: r.skip for i, r in by.items()} == {"1": None, "2": "no_rating", "3": "no_rating", "4": "not_rated", "5": "unmapped_rating", "6": "no_ticker", "7": None, "8": None}
    assert (by["1"].symbol, by["1"].direction, by["1"].conviction, by["1"].horizon, by["1"].prior_direction, by["1"].target) == ("700", "bullish", 0.7, "long_term", "bearish", "Co")
    assert (by["7"].symbol, by["7"].currency, by["7"].currency_inferred, by["7"].span_ids, by["7"].horizon, by["7"].market) == ("0700.HK", "HKD", True, ["s"], "medium_term", "HK")
    assert by["8"].symbol == "B" and by["2"].intent_id is None


def test_gaps(spark):
    long = "这段文字没有锚点而且足够长长长长长长长长长长长长长长长长长长长长长长长长长长长长"
    rows = [("a", "a1", f"{long} 曹操出行很好, NVDA AB.CD K5 CAGR5 XNVDA Nvda NVDA"), ("a", "a2", "曹操出行"), ("b", "b1", "短 NVDA"), ("c", "c1", f"{long} 关税 NVDA"), ("d", "d1", "有锚"), *(("d", f"d{k}", f"公司 ZZ{k}Z" if k % 2 else "QQQQ") for k in range(2, 9)), ("e", "e1", None)]
    blocks, spans = spark.createDataFrame(rows, "content_id string, block_id string, text string"), spark.createDataFrame([("d", "d1"), ("d", "d1")], "content_id string, block_id string")
    got = gaps.gap_candidates(blocks, spans).collect()
    assert Counter((r.block_id, r.alias, r.kind, r.score, r.reason) for r in got) == Counter([
        ("a1", "NVDA", "upper_token", 0.58, "zero_anchor"), ("a1", "AB.CD", "upper_token", 0.7, "zero_anchor"), ("a1", "XNVDA", "upper_token", 0.58, "zero_anchor"), ("a1", "曹操出行", "cn_phrase", 0.85, "zero_anchor"), ("a2", "曹操出行", "cn_phrase", 0.85, "zero_anchor"),
        *((f"d{k}", f"ZZ{k}Z", "upper_token", 0.66, "low_hit_rate") for k in (3, 5, 7)),
    ])
    support = gaps.gap_support(gaps.gap_candidates(blocks, spans), spark.createDataFrame([("nvda",)], "alias string"), examples=1).collect()
    assert {(r.alias, r.blocks, r.contents) for r in support} == {("AB.CD", 1, 1), ("XNVDA", 1, 1), ("曹操出行", 2, 1), ("ZZ3Z", 1, 1), ("ZZ5Z", 1, 1), ("ZZ7Z", 1, 1)}
    assert all(len(r.examples) == 1 for r in support)


def test_hot_candidate(spark):
    """A candidate in every block: counts are right and no more than the wanted examples of each task are shuffled."""
    blocks = spark.range(4000, numPartitions=8).selectExpr("cast(id % 900 as string) as content_id", "cast(id as string) as block_id", "concat('HOTT and more text that is of some length ', id) as text")
    empty = spark.createDataFrame([], "content_id string, block_id string")
    out = gaps.gap_support(gaps.gap_candidates(blocks, empty), spark.createDataFrame([], "alias string"))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    (row,) = out.collect()
    assert (row.alias, row.blocks, row.contents, len(row.examples)) == ("HOTT", 4000, 900, 3)
    assert [e.block_id for e in row.examples] == ["0", "1800", "2700"]
