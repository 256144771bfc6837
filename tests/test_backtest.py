import datetime as dt
import re

import pytest

from opineflow.operators.backtest import credibility, per_action_backtest, settle

DAY = dt.date(2026, 3, 2)


def outcome(spark, direction, closes, horizon=None, clock=dt.datetime(2026, 3, 2, 9)):
    actions = spark.createDataFrame([(1, "k", "T", direction, clock, "pending", horizon)], "action_id long, creator_id string, ticker string, direction string, clock timestamp_ntz, status string, time_horizon string")
    bars = spark.createDataFrame([("T", DAY + dt.timedelta(i), float(c)) for i, c in enumerate(closes)], "ticker string, date date, close double")
    return per_action_backtest(actions, bars)


@pytest.mark.parametrize(
    ("direction", "horizon", "closes", "reason", "ret", "days"),
    [
        ("bullish", None, [100, 105, 112, 121, 130], "target_reached", 0.21 - 0.003, 3),
        ("bullish", None, [100, 96, 89, 95], "stop_loss", -0.11 - 0.003, 2),
        ("bearish", None, [100, 92, 79], "target_reached", 0.21 - 0.003, 2),
        ("bullish", "short_term", [100] + [101] * 35, "time_exit", 0.01 - 0.003, 30),
        ("bullish", None, [100, 101], "end_of_period", 0.01 - 0.003, 1),
    ],
)
def test_exits(spark, direction, horizon, closes, reason, ret, days):
    row = outcome(spark, direction, closes, horizon).first()
    assert (row.skip, row.exit_reason, row.holding_days) == (None, reason, days)
    assert row.return_pct == pytest.approx(ret, abs=1e-4)


@pytest.mark.parametrize(("direction", "closes", "clock", "skip"), [("neutral", [1, 2], dt.datetime(2026, 3, 2), "non_directional"), ("bullish", [], dt.datetime(2026, 3, 2), "no_price_data"), ("bullish", [100, 101], dt.datetime(2026, 4, 2), "no_entry_bar"), ("bullish", [100, 101], dt.datetime(2026, 3, 3), "insufficient_bars")])
def test_skips(spark, direction, closes, clock, skip):
    assert outcome(spark, direction, closes, clock=clock).first().skip == skip


def test_settle_and_credibility(spark):
    done = outcome(spark, "bullish", [100, 125])
    assert settle(done).first().new_status == "verified"
    assert credibility(done).first().credibility == 73  # round(40 + 55 * 3 / 5)


def test_equal_cases_are_worked_out_once(spark):
    at = dt.datetime(2026, 3, 2, 9)
    rows = [(i, "k", "T", "bullish", at + dt.timedelta(minutes=i), "pending", "short_term") for i in range(50)]
    rows += [(50, "k", "T", "bullish", None, "pending", None), (51, None, None, "bearish", at, "pending", None), (52, "k", "T", None, at, None, None), (53, "k", "T", "bearish", at, "pending", "short_term")]
    actions = spark.createDataFrame(rows, "action_id long, creator_id string, ticker string, direction string, clock timestamp_ntz, status string, time_horizon string")
    bars = spark.createDataFrame([("T", DAY + dt.timedelta(i), c) for i, c in enumerate([100.0, 125.0, 90.0])], "ticker string, date date, close double")
    done = per_action_backtest(actions, bars)
    got = {r.action_id: r for r in done.collect()}
    assert len(got) == 54 and {(got[i].exit_reason, got[i].return_pct, got[i].max_drawdown) for i in range(50)} == {("target_reached", 0.247, 0.0)}
    assert [got[i].skip for i in (50, 51, 52, 53)] == ["no_entry_bar", "no_price_data", "non_directional", None] and got[53].exit_reason == "stop_loss"
    assert re.search(r"Aggregate \[ticker#\d+, day#\d+, sign#\d+, days#\d+\]", done._jdf.queryExecution().optimizedPlan().toString())
