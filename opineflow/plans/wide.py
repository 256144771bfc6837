"""Registered queries of market partitions, tickers and action records, with their twins in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import backtest as bt
from opineflow.operators import records as rc
from opineflow.operators import tickers as tk
from opineflow.plans import bindings as b
from opineflow.plans import queries as base
from opineflow.sources import market as ms
from opineflow.sources.tables import table
from opineflow.streaming.live import folders

_WITH = base._WITH
_register = base._register
_BARS = "ticker string, close double, high double, low double"


def _folder(s: SparkSession, name: str) -> str:
    return folders(s, name)[0]


def _daily_table(s: SparkSession, d: str) -> str:
    path = _folder(s, "daily")
    ms.write_partitions(b.bars(s, d).withColumn("date", F.date_format("date", "yyyyMMdd")), path, "date")
    return path


def _stocks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("market"), F.when(F.col("c_nationkey") % 5 == 0, "D").otherwise("L").alias("list_status"))


def _calendar(s: SparkSession, days: DataFrame) -> str:
    """The days on which something happened, open on weekdays."""
    path = _folder(s, "calendar")
    days = days.select(F.date_format("day", "yyyyMMdd").alias("cal_date"), (F.weekday("day") < 5).alias("is_open"), F.explode(F.array(F.lit("SSE"), F.lit("HKEX"))).alias("exchange"))
    ms.write_partitions(days, path, "exchange")
    return path


def _to_sync(s: SparkSession, d: str) -> DataFrame:
    have = s.read.schema(f"{_BARS}, date string").parquet(_daily_table(s, d)).where("int(date) % 3 <> 0").select("date")
    days = table(s, d, "events", "ts").agg(F.date_sub(F.min("ts"), 17).alias("a"), F.max("ts").cast("date").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    return ms.days_to_sync(ms.calendar(s, _calendar(s, days), "SSE"), have, "2024-01-02")


def _ledger(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "lines")
    e = table(s, d, "events", "event_id", "event_type")
    whole = F.to_json(F.struct("event_id", "event_type"))
    n = F.col("event_id") % 10  # torn, blank, with more after it, two in one, a list, closed brackets
    odd = F.when(n == 0, F.substring(whole, 1, 9)).when(n == 1, F.lit(" ")).when(n == 2, F.concat(whole, F.lit(" trailing"))).when(n == 3, F.concat(whole, whole)).when(n == 4, F.concat(F.lit("["), whole, F.lit("]"))).when(n == 5, F.concat(whole, F.lit("] x"))).when(n == 6, F.concat_ws(",", whole, whole))
    e.select(odd.otherwise(whole).alias("value")).write.text(path)
    return ms.line_counts(ms.json_lines(s, path, "event_id long, event_type string"))


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "prices")
    bars = b.bars(s, d).select(F.concat(F.lit("00"), "ticker").alias("ticker"), "date", "close")
    bars.write.option("header", True).csv(path)
    return ms.csv_prices(s, path)


def _equity(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "equity")
    bt.daily_totals(b.trades(s, d)).select("kol", "day", "total").write.option("header", True).csv(path)
    return bt.equity_snapshots(s.read.schema("kol long, day date, total double").option("header", True).csv(path))


def _tiers(s: SparkSession, d: str) -> DataFrame:
    a = b.actions(s, d).select("action_id", "creator_id", "status")
    return rc.first_wins([a.where("action_id % 3 = 0"), a.where("action_id % 2 = 0").withColumn("status", F.lit("later"))], "action_id")


def _named(s: SparkSession, d: str) -> DataFrame:
    n = F.col("action_id") % 9
    return b.actions(s, d).withColumn("creator_id", F.when(n == 0, F.lit(" Unknown ")).when(n == 1, F.lit("NONE")).when(n == 2, F.lit("  ")).when(n == 3, None).otherwise(F.concat(F.lit(" "), "creator_id")))


def _typed(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("long", "short", "add", "reduce", "watch", "close_long")])
    return b.actions(s, d).withColumn("action_type", F.element_at(kinds, (F.col("action_id") % 6 + 1).cast("int")))


def _errors(s: SparkSession, d: str) -> DataFrame:
    i = F.col("action_id")
    rows = b.actions(s, d).select(
        "action_id", F.when(i % 5 != 0, F.concat(F.lit("in"), i.cast("string"))).alias("intent_id"), F.when(i % 7 == 0, "").otherwise("p").alias("policy_id"),
        F.when(i % 3 == 0, F.array().cast("array<long>")).otherwise(F.array(i)).alias("evidence_span_ids"), F.when(i % 11 != 0, F.col("clock")).alias("executable_at"),
    )
    return rc.action_errors(rows).select("action_id", F.array_join("errors", ";").alias("errors"))


def _settled(s: SparkSession, d: str) -> DataFrame:
    return rc.settled_record(b.actions(s, d), base._results(s, d))


def _snapshot(s: SparkSession, d: str, day: str, add: int) -> DataFrame:
    record = _settled(s, d).select("creator_id", (F.col("credibility") + F.when(F.col("creator_id") == "kol_2", add).otherwise(0)).alias("credibility"))
    return rc.snapshot_before(b.actions(s, d), day, record)


def _styled(s: SparkSession, d: str) -> DataFrame:
    i = F.col("action_id")
    return b.actions(s, d).withColumns({"margin": i % 13 == 0, "is_entry": i % 2 == 0, "entry_style": F.when(i % 3 == 0, "left_side").when(i % 3 == 1, "right_side")})


def _codes(s: SparkSession, d: str) -> DataFrame:
    forms = ["600519", "{n}.hk", "300{m}", "AAPL.OQ", "BRK.N", "000{m}.SZ", "600{m}.ss", "{n}", "MC.PA", "D05.SI", "2330.TW", "7203.T", "600519.L", "TOOLONG", " tsla ", "920{m}", "a b", "{n}.KS", "VOD.LN", ""]
    case = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    n, m = (F.col("p_partkey") % 99999).cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    return table(s, d, "part", "p_partkey").select("p_partkey", F.replace(F.replace(case, F.lit("{n}"), n), F.lit("{m}"), m).alias("raw"))


_FORMS = "list_extract(['600519', '{n}.hk', '300{m}', 'AAPL.OQ', 'BRK.N', '000{m}.SZ', '600{m}.ss', '{n}', 'MC.PA', 'D05.SI', '2330.TW', '7203.T', '600519.L', 'TOOLONG', ' tsla ', '920{m}', 'a b', '{n}.KS', 'VOD.LN', ''], p_partkey % 20 + 1)"
_CODES = f"codes as (select p_partkey, replace(replace({_FORMS}, '{{n}}', cast(p_partkey % 99999 as varchar)), '{{m}}', lpad(cast(p_partkey % 1000 as varchar), 3, '0')) as raw from part)"
_VENUES = ", ".join([f"('{g}', '{c}', '{m}', '^[A-Z]{{1,8}}$')" for g, (c, m) in tk.LETTER_VENUES.items()] + [f"('{g}', '{c}', '{m}', '^[A-Z0-9]{{1,8}}$')" for g, (c, m) in tk.MIXED_VENUES.items()] + [f"('{g}', '{c}', '{m}', '^{tk.SHAPES[c]}$')" for g, (c, m) in tk.SUFFIXES.items()])


def _tickers(s: SparkSession, d: str) -> DataFrame:
    return _codes(s, d).select("p_partkey", tk.normalized(F.col("raw")).alias("t")).select("p_partkey", "t.symbol", "t.market")


def _matches(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    digits = F.lpad((k % 50).cast("string"), 4, "0")
    pairs = table(s, d, "part", "p_partkey").select("p_partkey", F.when(k % 3 == 0, F.concat(digits, F.lit(".HK"))).otherwise(digits).alias("a"), F.when(k % 4 == 0, F.concat((k % 50).cast("string"), F.lit(".SH"))).otherwise((k % 25).cast("string")).alias("b"))
    return pairs.select("p_partkey", tk.tickers_match(F.col("a"), F.col("b")).alias("same"))


_WORDS = ["Buy", "Over-weight", "EQUAL_WEIGHT", "  Market   Perform ", "sell", "Underweight", "not rated", "", "In-Line", "Accumulate"]


def _ratings(s: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % len(_WORDS) + 1).cast("int"))
    months = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 14)
    symbol = F.element_at(F.array(F.lit("0700.hk"), F.lit("600519"), F.lit("000001.sz"), F.lit("AAPL"), F.lit(None).cast("string")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", tk.rating_token(raw).alias("token"), tk.rating_direction(raw).alias("direction"), tk.rating_conviction(raw).alias("conviction"), tk.horizon_of_months(months).alias("horizon"), tk.market_of(symbol).alias("market"), tk.currency_of(symbol).alias("currency"))


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_RATINGS_SQL = f"""with r as (select p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(list_extract([{_words(_WORDS)}], p_partkey % {len(_WORDS)} + 1)), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')), '') as token,
    case when p_size % 7 <> 0 then p_size % 14 end as months, list_extract(['0700.hk', '600519', '000001.sz', 'AAPL', null], p_partkey % 5 + 1) as symbol from part)
    select p_partkey, token, case when token in ({_words(tk.BULLISH)}) then 'bullish' when token in ({_words(tk.NEUTRAL)}) then 'neutral' when token in ({_words(tk.BEARISH)}) then 'bearish' end as direction,
    case when token in ({_words(tk.STRONG)}) then 0.7::double when token in ({_words(tk.TILT)}) then 0.6::double when token in ({_words(tk.NEUTRAL)}) then 0.4::double end as conviction,
    case when months <= 2 then 'short_term' when months <= 6 then 'medium_term' else 'long_term' end as horizon,
    case when symbol is null then null when upper(symbol) like '%.HK' then 'HK' when regexp_matches(upper(symbol), '\\.(SZ|SS)$|^[0-9]{{6}}$') then 'CN' else 'US' end as market,
    case when upper(symbol) like '%.HK' then 'HKD' when regexp_matches(upper(symbol), '\\.(SZ|SS)$|^[0-9]{{6}}$') then 'CNY' else 'USD' end as currency from r"""


def _periods(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("2024-01-01/2024-03-01"), F.when(k % 3 == 0, F.concat(F.lit(" [window="), (k % 200).cast("string"), F.lit("d]"))).when(k % 3 == 1, F.concat(F.lit(" [window="), (k % 200).cast("string"), F.lit("d truncated]"))).otherwise(""))
    w = tk.window_suffix(text)
    return table(s, d, "orders", "o_orderkey").select("o_orderkey", w["days"].alias("days"), w["truncated"].alias("truncated"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.format_string('{"order": %d}', k)
    raw = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 8 == 2, F.lit("no answer")).when(k % 8 == 6, F.concat(body, F.lit(" and that is all"))).otherwise(F.substring(body, 1, 8))
    return table(s, d, "orders", "o_orderkey").select("o_orderkey", tk.unfenced_json(raw).alias("answer"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    start = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    n = F.col("l_partkey") % 10
    return table(s, d, "lineitem", "l_orderkey", "l_shipdate", "l_quantity", "l_partkey").select("l_orderkey", F.when(n != 0, start).alias("start"), F.when(n == 2, start - 1).when(n != 1, start + F.col("l_quantity").cast("int")).alias("end"))


def _preferences(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(s, d, "documents", "doc_id", "lang").select(i.alias("id"), F.when(i % 17 == 0, " ").otherwise(F.concat(F.lit(" Ask  "), (i % 60).cast("string"))).alias("prompt"), (i % 4).alias("chosen"), (i % 3).alias("rejected"))
    return rc.preference_errors(rows, rows.where("id % 25 = 0").select("id"))


def _feeds(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "ts", "event_type").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return rc.change_feed(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("kind", F.lit("snapshot")), 40)


def _versions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(s, d, "orders", "o_orderkey").select(k.alias("content_id"), F.when(k % 5 == 0, None).when(k % 5 == 1, "failed").otherwise("done").alias("status"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("prompt_version"), F.when(k % 2 == 0, "aa").alias("config_hash"))
    return rc.needs_reprocess(rows, "v2", "aa")


_ANCHORS = "t as (select *, lag(direction) over (partition by creator_id, ticker order by clock, action_id) as before from actions), an as (select creator_id, action_id from t where before is null or before <> direction)"
_RECORD = f"{_ANCHORS}, rec as (select creator_id, count(*) as settled, count(*) filter (r.return_pct > 0) as wins from an join results r using (action_id, creator_id) where r.return_pct is not null and r.holding_days > 0 group by 1), cred as (select c.creator_id, coalesce(settled, 0) as settled, coalesce(wins, 0) as wins, greatest(0, least(99, cast(round_even(40 + 55 * (coalesce(wins, 0) + 2) / (coalesce(settled, 0) + 4), 0) as integer))) as credibility from (select distinct creator_id from actions) c left join rec using (creator_id))"
_SNAP = "{0} as (select s.*, credibility + case when creator_id = 'kol_2' then {2} else 0 end as credibility from (select creator_id, ticker, arg_max(action_id, (clock, action_id)) as action_id, arg_max(direction, (clock, action_id)) as direction, max(clock) as clock from actions where clock < timestamp '{1}' group by 1, 2) s left join cred using (creator_id))"

_register("daily_partitions", lambda s, d: ms.daily(s, _daily_table(s, d), _BARS, "ticker,date,close", "T1, T4", start="20240105", end="2024-01-20"), f"{_WITH} select ticker, strftime(date, '%Y%m%d') as date, close from bars where ticker in ('T1', 'T4') and date between date '2024-01-05' and date '2024-01-20'")
_register("stock_list", lambda s, d: ms.stock_list(_stocks(s, d), "ticker,name", market="BUILDING"), "select c_custkey as ticker, c_name as name from customer where c_nationkey % 5 <> 0 and c_mktsegment = 'BUILDING'")
_register("trade_calendar", lambda s, d: ms.calendar(s, _calendar(s, table(s, d, "orders", "o_orderdate").select(F.col("o_orderdate").cast("date").alias("day")).distinct()), "HKEX", "1994-01-01", "19961231", "1"), "select distinct strftime(cast(o_orderdate as date), '%Y%m%d') as cal_date, true as is_open, 'HKEX' as exchange from orders where isodow(o_orderdate) < 6 and cast(o_orderdate as date) between date '1994-01-01' and date '1996-12-31'")
_register("market_days_to_sync", _to_sync, "select strftime(x, '%Y%m%d') as cal_date from (select unnest(range(date '2024-01-03', max(cast(ts as date)) + 1, interval 1 day)) as x from events) where isodow(x) < 6 and cast(x as date) not in (select cast(ts as date) from events where cast(strftime(ts, '%Y%m%d') as integer) % 3 <> 0)")
_register("table_readiness", lambda s, d: ms.table_readiness(b.bars(s, d), 20), f"{_WITH} select ticker, count(distinct date) as days, min(date) as first_day, max(date) as last_day, count(distinct date) >= 20 as ready from bars group by 1")
_register("json_line_counts", _ledger, "select count(*) filter (event_id % 10 > 6) as good, count(*) filter (event_id % 10 in (0, 2, 3, 4, 5, 6)) as bad from events")
_register("csv_prices", _csv, f"{_WITH} select '00' || ticker as ticker, date, close from bars")
_register("equity_curve_snapshots", _equity, f"{_WITH}, {base._TOTALS} select kol, day, total, max(total) over (partition by kol order by day) as peak, round_even((total - coalesce(lag(total) over (partition by kol order by day), 1000000.0::double)) * 100, 0) / 100 as pnl from totals")
_register("actions_first_wins", _tiers, f"{_WITH} select action_id, creator_id, case when action_id % 3 = 0 then status else 'later' end as status, cast(case when action_id % 3 = 0 then 0 else 1 end as integer) as tier from actions where action_id % 3 = 0 or action_id % 2 = 0")
_register("attributed_actions", lambda s, d: rc.attributed(_named(s, d)).groupBy("creator_id").agg(F.count("*").alias("n")), f"{_WITH} select creator_id, count(*) as n from actions where action_id % 9 > 3 group by 1")
_register("index_query_page", lambda s, d: rc.page(rc.index_query(b.actions(s, d), ticker="t3", direction="Bullish", since="2024-01-05", until="2024-01-25"), [F.desc("clock"), F.desc("action_id")], 15, 5), f"{_WITH}, f as (select * from actions where ticker = 'T3' and direction = 'bullish' and clock between timestamp '2024-01-05' and timestamp '2024-01-25') select *, (select count(*) from f) as total from f order by clock desc, action_id desc limit 15 offset 5")
_register("timeline_range", lambda s, d: rc.timeline_range(b.actions(s, d).withColumn("ticker_normalized", F.concat("ticker", F.lit(".US"))), "2024-01-31", "1W", ["T1", "T2.US"], ["bullish", "bearish"], least_confidence=0.3).select("action_id"), f"{_WITH} select action_id from actions where clock between timestamp '2024-01-24' and timestamp '2024-01-31' and ticker in ('T1', 'T2') and direction in ('bullish', 'bearish') and confidence >= 0.3::double")
_register("pending_review", lambda s, d: rc.pending_review(b.actions(s, d), F.col("confidence") < 0.5, 30).select("action_id"), f"{_WITH} select action_id from (select * from actions where status = 'pending' order by clock desc, action_id desc limit 30) where confidence < 0.5::double")
_register("nulls_last_page", lambda s, d: rc.page(b.actions(s, d).select("action_id", "time_horizon"), [F.asc_nulls_last("time_horizon"), F.asc("action_id")], 20, 10), f"{_WITH} select action_id, time_horizon, (select count(*) from actions) as total from actions order by time_horizon nulls last, action_id limit 20 offset 10")
_register("opinion_projection", lambda s, d: rc.opinions(b.actions(s, d)), f"{_WITH} select action_id as id, clock, upper(ticker) as ticker, case when direction in ('bearish', 'risk_warning') then 'bearish' when direction = 'bullish' then 'bullish' else 'neutral' end as direction, round(confidence, 2) as confidence, case when status in ('verified', 'failed') then status else 'pending' end as verification, creator_id as author from actions")
_register("backtest_records", lambda s, d: rc.backtest_records(_typed(s, d)), f"{_WITH} select action_id, creator_id, ticker, direction, case action_id % 6 when 0 then 'long' when 1 then 'short' when 2 then 'long' when 3 then 'close_long' when 5 then 'close_long' end as record_type, clock from actions where direction in ('bullish', 'bearish') and action_id % 6 <> 4")
_register("action_errors", _errors, f"{_WITH} select action_id, array_to_string(list_filter([case when action_id % 5 = 0 then 'missing intent_id' end, case when action_id % 7 = 0 then 'missing policy_id' end, case when action_id % 3 = 0 then 'missing or empty evidence_span_ids' end, case when action_id % 11 = 0 then 'missing execution_timing.action_executable_at' end], lambda e: e is not null), ';') as errors from actions")
_register("settled_record", _settled, f"{_WITH}, {base._OUTCOME}, {_RECORD} select * from cred")
_register("snapshot_before", lambda s, d: _snapshot(s, d, "2024-01-10", 0), f"{_WITH}, {base._OUTCOME}, {_RECORD}, {_SNAP.format('o', '2024-01-10', 0)} select * from o")
_register("snapshot_diff", lambda s, d: rc.snapshot_diff(_snapshot(s, d, "2024-01-10", 0), _snapshot(s, d, "2024-01-11", 5)), f"{_WITH}, {base._OUTCOME}, {_RECORD}, {_SNAP.format('o', '2024-01-10', 0)}, {_SNAP.format('n', '2024-01-11', 5)}, j as (select n.creator_id, n.ticker, o.direction as old_direction, n.direction as new_direction, o.credibility as old_score, n.credibility as new_score, case when o.direction is null then 'new_call' when o.direction <> n.direction then 'flip' when o.credibility is distinct from n.credibility then 'score_change' end as change from n left join o using (creator_id, ticker) where n.creator_id in (select creator_id from o)) select * from j where change is not null")
_register("trading_style", lambda s, d: rc.trading_style(_styled(s, d)), f"""{_WITH}, t as (select *, case when lag(direction) over w = direction then 0 else 1 end as turn from actions window w as (partition by creator_id, ticker order by clock, action_id)),
  e as (select *, sum(turn) over (partition by creator_id, ticker order by clock, action_id) as episode from t),
  g as (select creator_id, ticker, episode, count(*) filter (direction in ('bullish', 'bearish')) as directional, count(*) filter (direction = 'bearish') as short_side, count(*) filter (action_id % 13 = 0) as margin, arg_min(case action_id % 3 when 0 then 'left_side' else 'right_side' end, (clock, action_id)) filter (action_id % 2 = 0 and action_id % 3 < 2) as vote from e group by 1, 2, 3),
  p as (select creator_id, cast(sum(directional) as bigint) as directional, cast(sum(short_side) as bigint) as short_side, cast(sum(margin) as bigint) as margin_mentions, count(*) filter (vote = 'left_side') as left_votes, count(*) filter (vote = 'right_side') as right_votes from g group by 1)
  select *, case when left_votes + right_votes < 5 then 'unknown' when left_votes / (left_votes + right_votes) >= 0.6::double then 'left_side' when right_votes / (left_votes + right_votes) >= 0.6::double then 'right_side' else 'mixed' end as entry_style from p""")
_register("direction_steadiness", lambda s, d: rc.direction_steadiness(b.actions(s, d)), f"{_WITH}, {base._TURNS}, e as (select creator_id, ticker, count(*) as n, count(*) filter (before <> direction) as c from t group by 1, 2), p as (select creator_id, round(avg(1 - c / (n - 1)) filter (n > 1), 6) as steadiness from e group by 1) select *, cast(case when steadiness is null then 3 when steadiness > 0.85 then 5 when steadiness > 0.70 then 4 when steadiness > 0.55 then 3 when steadiness > 0.40 then 2 else 1 end as integer) as band from p")
_register("context_window", lambda s, d: rc.around(table(s, d, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", F.col("turn") == 2, 1, 2), "with n as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as p from conversations) select n.conv_id, a.turn as located_at, cast(n.p - a.p as integer) as distance, n.turn, n.role from n a join n on n.conv_id = a.conv_id and n.p between a.p - 1 and a.p + 2 where a.turn = 2")
_register("even_sample", lambda s, d: rc.even_sample(bt.daily_totals(b.trades(s, d)), "kol", "day").select("kol", "day"), f"{_WITH}, d as (select distinct kol, cast(exit as date) as day from trades), n as (select *, row_number() over (partition by kol order by day) - 1 as no, count(*) over (partition by kol) as n from d), k as (select kol, day, row_number() over (partition by kol order by day desc) as r from n where no % greatest(1, n // 30) = 0) select kol, day from k where r <= 30")
_register("leaders", lambda s, d: rc.leaders(b.actions(s, d).groupBy("creator_id").agg(F.count("*").alias("views"), F.round(F.avg("confidence"), 4).alias("score")), "score", 10, 5), f"{_WITH} select creator_id, count(*) as views, round(avg(confidence), 4) as score from actions group by 1 having count(*) >= 10 order by score desc, creator_id limit 5")
_register("focus_areas", lambda s, d: rc.focus_areas(b.actions(s, d)), f"{_WITH} select creator_id, ticker, count(*) as n, cast(row_number() over (partition by creator_id order by count(*) desc, ticker) as integer) as rank from actions group by 1, 2 qualify rank <= 5")
_register("hash_sample", lambda s, d: rc.hash_sample(table(s, d, "documents", "doc_id"), "doc_id", 25, 7), "select doc_id from documents order by md5('7:' || doc_id), doc_id limit 25")
_register("capped_select", lambda s, d: rc.capped_select(table(s, d, "documents", "doc_id", "source"), "source", "doc_id", 3, 40), "with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents) select doc_id, source from r where n <= 3 order by doc_id limit 40")
_register("change_feed", _feeds, "select event_id, ts as \"at\", case when event_id % 2 = 0 then event_type else 'snapshot' end as kind, cast(case when event_id % 2 = 0 then 0 else 1 end as integer) as tier from events where event_id % 2 = 0 or event_id % 3 = 0 order by ts desc, event_id limit 40")
_register("ticker_normalize", _tickers, f"""with {_CODES}, v(suffix, canonical, market, shape) as (values {_VENUES}),
  c as (select p_partkey, upper(trim(raw)) as code from codes), x as (select *, regexp_extract(code, '^(.+)\\.([^.]+)$', 1) as base, regexp_extract(code, '^(.+)\\.([^.]+)$', 2) as suffix from c),
  y as (select x.*, v.canonical, v.market as vm from x left join v on v.suffix = x.suffix and regexp_matches(x.base, v.shape))
  select p_partkey, case when canonical = '' then base when canonical = 'HK' then case when length(base) < 4 then lpad(base, 4, '0') else base end || '.HK' when canonical is not null then base || '.' || canonical when regexp_matches(code, '^(60|68)[0-9]{{4}}$') then code || '.SH' when regexp_matches(code, '^(00|30)[0-9]{{4}}$') then code || '.SZ' when regexp_matches(code, '^[A-Z]{{1,5}}$') then code end as symbol,
    case when canonical is not null then vm when regexp_matches(code, '^(60|68|00|30)[0-9]{{4}}$') then 'CN' when regexp_matches(code, '^[A-Z]{{1,5}}$') then 'US' end as market from y""")
_register("tickers_match", _matches, "select p_partkey, p_partkey % 50 = case when p_partkey % 4 = 0 then p_partkey % 50 else p_partkey % 25 end and not (p_partkey % 3 = 0 and p_partkey % 4 = 0) as same from part")
_register("rating_tokens", _ratings, _RATINGS_SQL)
_register("number_grounding", lambda s, d: table(s, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", tk.number_in_text((F.col("o_orderkey") % 100).cast("double"), F.col("o_totalprice").cast("string")).alias("found")), "select o_orderkey, contains(cast(o_totalprice as varchar), cast(o_orderkey % 100 as varchar)) as found from orders")
_register("stable_ids", lambda s, d: table(s, d, "pages", "page_id", "url").select("page_id", tk.stable_id("cnt_", F.lit("url"), F.col("url")).alias("content_id")), "select page_id, 'cnt_' || sha256(concat_ws(':', 'url', url))[1:16] as content_id from pages")
_register("window_suffix", _periods, "select o_orderkey, case when o_orderkey % 3 < 2 then cast(o_orderkey % 200 as integer) end as days, case when o_orderkey % 3 < 2 then o_orderkey % 3 = 1 end as truncated from orders")
_register("unfenced_json", _answers, "select o_orderkey, case when o_orderkey % 4 < 2 then '{\"order\": ' || o_orderkey || '}' end as answer from orders")
_register("merged_spans", lambda s, d: rc.merged_spans(_spans(s, d), "l_orderkey"), "with s as (select l_orderkey, cast(cast(l_shipdate as date) - date '1990-01-01' as integer) as \"start\", cast(cast(l_shipdate as date) - date '1990-01-01' as integer) + case when l_partkey % 10 = 1 then 0 else cast(l_quantity as integer) end as \"end\" from lineitem where l_partkey % 10 not in (0, 2)), f as (select *, case when \"start\" > max(\"end\") over (partition by l_orderkey order by \"start\", \"end\" rows between unbounded preceding and 1 preceding) is not false then 1 else 0 end as fresh from s), i as (select *, sum(fresh) over (partition by l_orderkey order by \"start\", \"end\" rows unbounded preceding) as island from f) select l_orderkey, min(\"start\") as \"start\", max(\"end\") as \"end\", count(*) as spans from i group by l_orderkey, island")
_register("preference_errors", _preferences, "with r as (select doc_id as id, case when doc_id % 17 = 0 then ' ' else ' Ask  ' || (doc_id % 60) end as prompt, doc_id % 4 as chosen, doc_id % 3 as rejected from documents), f as (select *, min(id) over (partition by sha256(regexp_replace(lower(trim(prompt)), '\\s+', ' ', 'g'))) as first_id from r) select id, array_to_string(list_filter([case when trim(prompt) = '' then 'empty_prompt' end, case when chosen = rejected then 'same_answers' end, case when id <> first_id then 'duplicate_prompt' end, case when id % 25 = 0 then 'eval_leak' end], lambda e: e is not null), ',') as errors from f")
_register("needs_reprocess", _versions, "select o_orderkey as content_id, case when o_orderkey % 5 = 0 then 'never' when o_orderkey % 5 = 1 then 'failed' when o_orderkey % 3 = 0 then 'prompt' else 'config' end as why from orders where o_orderkey % 5 < 2 or o_orderkey % 3 = 0 or o_orderkey % 2 = 1")
_register("last_samples", lambda s, d: rc.last_samples(table(s, d, "events", "event_id", "event_type", "ts", "value"), "event_type", "ts", "event_id", 100), "with r as (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) select event_type, count(*) as n, round(avg(value), 4) as mean from r where n <= 100 group by 1")
