"""Scores, ratings, gates and crowd sentiment on hand-made rows; turns across months against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opineflow.operators import backtest as bt
from opineflow.operators import scorers as so

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
TRADES = "creator_id string, trade_id int, clock timestamp, return_pct double, holding_days int, n long, by string, overall double"
OPINIONS = "creator_id string, clock timestamp, confidence double, rationale string, said string"


def day(i):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=i)


def test_turns_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), day(rng.randrange(400)) if rng.random() < 0.95 else None, i) for i in range(400)]
    got = so.turns(spark.createDataFrame(rows, "k string, v string, at timestamp, id int").repartition(5), ["k"], "v", "at", ["id"], lambda a, b: (~a.eqNullSafe(b)).cast("int"))
    got = {r.k: (r.n, r.cost) for r in got.collect()}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or NOW, r[3]))
        assert got[k] == (len(mine), sum(p[1] != q[1] for p, q in zip(mine, mine[1:])))


def test_creator_scores(spark):
    rows = [("win", i, day(10 * i), 0.2, 3) for i in range(12)] + [("swing", i, day(20 * i), 0.3 if i % 2 else -0.2, 25) for i in range(10)]
    rows += [("one", 1, None, None, None), (None, 1, day(1), 0.01, 60), (None, 1, day(1), 0.01, 60)]
    said = [("win", NOW - dt.timedelta(days=5), 0.9, "why"), ("win", NOW - dt.timedelta(days=90), None, ""), ("talk", None, 1.0, "why")]
    trades = spark.createDataFrame([(*r, 7, "clash", 1.0) for r in rows], TRADES)
    got = {r.creator_id: tuple(r)[1:] for r in so.creator_scores(trades, spark.createDataFrame([(*r, "clash") for r in said], OPINIONS), NOW).collect()}
    assert got["win"] == (5.0, 4.25, 5.0, 5.0, 3.75, 4.7625, "excellent", 12)
    assert got["swing"] == (2.5, 2.0, 3.0, 1.0, 3.0, round(0.75 + 0.3 + 0.9 + 0.15 + 0.3, 4), "below_average", 10)
    assert got["one"][:5] == (0.0, 4.0, 2.0, 2.5, 2.0) and got[None][:5] == (5.0, 1.0, 3.0, 2.5, 2.0)
    assert got["talk"] == (2.5, 2.5, 2.5, 2.5, 5.0, 2.75, "average", 0)
    none = so.creator_scores(trades.limit(0), spark.createDataFrame([], OPINIONS), NOW)
    assert none.count() == 0


VIEWS = "kol string, view_id int, ticker string, direction string, view_date timestamp, rationale string, points int"
CHECKS = "view_id int, validation_id int, right_7d boolean, right_30d boolean, return_7d double, excess double, kol string"


def test_creator_ratings(spark):
    views = [("a", 1, "T", "bullish", day(1), None), ("a", 2, "T", "bearish", day(40), "so VOLATILE"), ("a", 3, "T", "neutral", day(41), ""), ("a", 4, None, "risk_warning", None, None), ("b", 5, "", "risk_warning", day(1), "x"), ("c", 6, "T", "bullish", day(1), None), (None, 7, "T", None, day(1), None)]
    checks = [(1, 2, True, True, 9.0, 30.0), (1, 1, False, None, -6.0, None), (3, 1, True, None, 1.0, -1.0), (2, 1, None, True, -9.0, 1.0)]
    triggers = [(1, "STOP at 5"), (1, "take loss"), (2, None), (6, "target")]
    got = so.creator_ratings(spark.createDataFrame([(*v, 0) for v in views], VIEWS), spark.createDataFrame(triggers, "view_id int, trigger string"), spark.createDataFrame([(*c, "clash") for c in checks], CHECKS))
    got = {r.kol: r for r in got.collect()}
    a = got["a"]
    # weights 1.5, 1.5, 1: (100 + 10 + 20), 0, (100 - 2)
    assert (a.views, a.validated, a.accuracy) == (4, 3, round((130 * 1.5 + 98) / 4, 3))
    assert a.stop_loss_quality == 85.0  # a quarter of the views, the first validation fell by 6
    assert a.consistency == 35.0 and a.market_sensitivity == 75.0 and a.risk_awareness == 65.0
    total = 0.35 * a.accuracy + 0.25 * 85 + 0.2 * 35 + 7.5 + 6.5
    assert a.total == pytest.approx(total, abs=0.01) and (a.stars, a.medal) == (3, "bronze")
    b, c = got["b"], got["c"]
    assert (b.accuracy, b.stop_loss_quality, b.consistency, b.market_sensitivity, b.risk_awareness) == (0.0, 5.0, 50.0, 50.0, 85.0)
    assert (c.stop_loss_quality, c.consistency, c.risk_awareness, c.stars) == (0.0, 100.0, 0.0, 1) and got[None].views == 1


def test_gate_decisions(spark):
    cards = [("pass", 0.9, 0.85, 0.95, 0.8, 0.7, 0.85), ("reject", 0.3, 0.3, 0.1, 0.1, 0.1, 0.1), ("reject2", 0.9, 0.9, 0.29, 0.1, 0.1, 0.1), ("blur", 0.2, 0.9, 0.9, 0.9, 0.9, 0.9), ("trace", 0.9, 0.9, 0.9, 0.9, 0.9, 0.55), ("mid", 0.6, 0.6, 0.6, 0.6, 0.6, 0.6), ("null", None, 0.9, 0.9, 0.9, 0.9, 0.9)]
    cards = spark.createDataFrame([(*c, "clash") for c in cards], "id string, " + ", ".join(f"{c} double" for c in so.CARD) + ", other string")
    got = {r.id: (r.score, r.gate, r.reasons, r.next_step, r.critical, r.weakest) for r in so.gate_decisions(cards).collect()}
    assert got["pass"] == (0.84, "pass", [], "extract_intent", 0, "temporal_resolution")
    assert got["reject"][:2] == (0.17, "reject") and got["reject"][3:] == ("drop", 1, "financial_relevance")
    assert got["reject2"][:2] == (0.4, "reject")
    assert got["blur"][1:] == ("review", ["readability:critical"], "reprocess_source", 1, "readability")
    assert got["trace"][1:] == ("review", ["evidence_traceability:pass"], "manual_review", 0, "evidence_traceability")
    assert got["mid"][1:4] == ("review", ["below_pass"], "manual_review")
    assert got["null"][:4] == (None, "review", ["incomplete"], "manual_review")
    strict = {r.id: r.gate for r in so.gate_decisions(cards, so.POLICIES["strict"]).collect()}
    assert strict["pass"] == "review"


def test_crowd_and_adjustments(spark):
    rows = [(1, "bullish", 0.95, 1.0, 0.9, None, 0.4), (2, "bullish", -0.9, -2.0, None, None, -0.5), (3, "bearish", 0.7, None, None, 0.7, None), (4, "neutral", None, None, None, None, 1.0), (5, "neutral", 1.0, 1.0, 1.0, 1.0, 0.1), (6, None, 0.5, None, None, None, 0.0)]
    s = spark.createDataFrame(rows, "id int, direction string, reddit double, twitter double, news double, polymarket double, velocity double")
    got = {r.id: r for r in so.direction_adjustments(so.crowd_sentiment(s)).collect()}
    assert got[1].score == pytest.approx((0.9 * 0.25 + 0.25 + 0.8 * 0.35) / 0.85) and got[1].contrarian and (got[1].reason, got[1].confidence_modifier) == ("with_extreme_crowd", -0.2)
    assert got[2].score == pytest.approx(-0.95) and got[2].contrarian and got[2].reason == "against_extreme_crowd" and got[2].data_quality == "partial"
    assert got[3].score == pytest.approx(0.4) and got[3].confidence_modifier == -0.1 and not got[3].contrarian
    assert (got[4].score, got[4].reason, got[4].data_quality) == (0.0, "no_data", "unavailable")
    assert got[5].reason == "extreme_crowd" and got[6].reason == "" and got[6]["class"] == "neutral"
    assert so.crowd_sentiment(s.limit(0)).agg(F.count("*")).first()[0] == 0


def test_losses_in_turn_across_months(spark):
    rng = random.Random(9)
    rows = [(k, day(rng.randrange(300)) if rng.random() < 0.97 else None, i, rng.choice([-1.0, -1.0, -1.0, 1.0, None]) if k < 3 else -2.0) for i in range(300) for k in range(4)]
    t = spark.createDataFrame(rows, "kol int, exit timestamp, l_orderkey int, net_pnl double").selectExpr("*", "0 as l_linenumber", "0 as ticker", "0 as holding_days", "net_pnl as return_pct").repartition(5)
    got = {r.kol: r.max_losses for r in bt.consecutive_losses(t).collect()}
    for k in range(4):
        run = most = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or NOW, r[2])):
            run = run + 1 if r[3] is not None and r[3] < 0 else 0
            most = max(most, run)
        assert got[k] == most
