"""Small cases of intents, rules, traces, timing and upserts, worked out by hand."""

import datetime as dt

from opineflow.operators import catalog as ct
from opineflow.operators import intents as it
from opineflow.operators import market as mk
from opineflow.operators import passages as ps

INTENT = "content_id long, target string, run int, intent_id long, span long, direction string, delta string, conviction double, confidence double, horizon string"


def intents(spark, rows):
    return spark.createDataFrame([(1, "T", run, i, i, direction, "add", 0.5, confidence, None) for run, i, direction, confidence in rows], INTENT)


def test_majority_and_contested_targets(spark):
    won = it.consensus(intents(spark, [(0, 1, "neutral", 0.1), (1, 2, "neutral", 0.9), (2, 3, "bullish", 1.0)]), 3).collect()
    assert [(r.direction, r.votes, r.intent_id) for r in won] == [("neutral", 2, 2)]
    assert it.consensus(intents(spark, [(0, 1, "bullish", 0.1), (1, 2, "bullish", 0.9), (2, 3, "bearish", 1.0)]), 3).count() == 0
    assert it.consensus(intents(spark, []), 3).count() == 0


def test_contradiction_keeps_the_strongest_and_ties_go_to_the_first(spark):
    kept = it.collapse_contradictions(intents(spark, [(0, 2, "bullish", 0.5), (0, 1, "bearish", 0.5)])).collect()
    assert [(r.intent_id, r.collapsed) for r in kept] == [(1, True)]


def test_most_specific_rule_wins(spark):
    rules = spark.createDataFrame([("a", "x", "both"), ("a", None, "one")], "k string, l string, v string")
    rows = spark.createDataFrame([("a", "x"), ("a", None), (None, "x")], "k string, l string")
    assert {(r.k, r.l, r.v) for r in it.apply_rules(rows, rules, [["k", "l"], ["k"]], "v").collect()} == {("a", "x", "both"), ("a", None, "one"), (None, "x", None)}


def test_trace_breaks(spark):
    actions = spark.createDataFrame([(1, 1), (2, 9), (3, 1), (4, 1)], "action_id long, intent_id long")
    spans = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, 5), (3, 2, 6)], "action_id long, span_id long, policy_id long")
    out = it.broken_traces(actions, spans, spark.createDataFrame([(1,)], "intent_id long"), spark.createDataFrame([(5,)], "policy_id long"))
    assert {(r.code, r.n) for r in out.collect()} == {("ok", 1), ("intent_missing", 1), ("span_unresolved", 1), ("no_evidence", 1)}


def test_sessions(spark):
    at = lambda *x: dt.datetime(2026, 4, *x)
    rows = [(1, "HK", at(24, 17, 0)), (2, "HK", at(24, 12, 30)), (3, "US", at(24, 8, 0)), (4, "CN", at(25, 10, 0)), (5, "CN", at(24, 15, 0))]
    events = spark.createDataFrame(rows, "event_id long, market string, local timestamp_ntz")
    got = {r.event_id: (r.session, r.executable_at) for r in mk.session_timing(events, mk.trading_calendar("2026-04-20", "2026-04-30", spark)).collect()}
    assert got == {1: ("after_close", at(27, 9, 30)), 2: ("regular", at(24, 12, 35)), 3: ("pre_market", at(24, 9, 30)), 4: ("non_trading_day", at(27, 9, 30)), 5: ("regular", at(24, 15, 5))}


def test_upsert_prefers_the_update_of_equal_versions(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, v int, x string")
    news = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, None)], "k long, v int, x string")
    assert {tuple(r) for r in ct.upsert(base, news, "k", "v").collect()} == {(1, 1, "c"), (2, 5, "b"), (3, 1, None)}


def test_markdown(spark):
    page = '<style>x</style><h1>A</h1><p>b <b>c</b><br><a class="k" href="/d">e</a> &amp;lt;</p>'
    out = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(ps.rewrite(ps.F.col("h"), ps.MARKDOWN_STEPS).alias("m")).collect()
    assert [r.m for r in out] == ["# A\n\nb **c**\n[e](/d) &lt;", None, ""]
