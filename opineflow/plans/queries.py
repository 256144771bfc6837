"""The engine's registered queries over the bound tables, each with its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import backtest as bt
from opineflow.operators import catalog as ct
from opineflow.operators import content as tx
from opineflow.operators import market as mk
from opineflow.operators import scoring as sc
from opineflow.operators import timeline as tl
from opineflow.plans import bindings as b
from opineflow.sources.tables import table
from opineflow.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
#: Aliases of the registry for entity mentions.
REGISTRY = {"the": "T0", "and": "T1", "that": "T2", "with": "T3", "from": "T4", "this": "T5", "der": "T6", "und": "T6", "les": "T7", "que": "T8", "los": "T9"}
_WITH = f"with {b.VIEWS_SQL}"
_DIR = ", ".join(f"count(*) filter (direction = '{d}') as n_{d}" for d in tl.DIRECTIONS)
_LATEST = "l as (select creator_id, ticker, arg_max(action_id, (clock, action_id)) as action_id, arg_max(direction, (clock, action_id)) as direction, max(clock) as clock from actions group by 1, 2)"
_TURNS = "t as (select *, lag(direction) over (partition by creator_id, ticker order by clock, action_id) as before from actions)"
_STATS = "select {0}, count(*) as n, round(avg(confidence), 4) as avg_confidence, round(count(*) filter (status = 'verified') / nullif(count(*) filter (status in ('verified', 'failed')), 0), 4) as success_rate from actions group by 1"
_OUTCOME = f"""series as (select * from bars where close > 0),
  a as (select *, case when direction = 'bullish' then 1.0::double when direction in ('bearish', 'risk_warning') then -1.0::double end as sign,
    case time_horizon when 'short_term' then 30 when 'medium_term' then 90 else 180 end as days from actions),
  e as (select a.action_id, min(s.date) as entry_date, arg_min(s.close, s.date) as entry_close from a join series s on s.ticker = a.ticker and s.date >= cast(a.clock as date) group by 1),
  g as (select a.action_id, s.date, a.sign * (s.close / e.entry_close - 1) as gross, s.date >= e.entry_date + a.days as late from a join e using (action_id) join series s on s.ticker = a.ticker and s.date > e.entry_date where a.sign is not null),
  h as (select action_id, min(date) filter (gross <= {bt.STOP} or gross >= {bt.TARGET} or late) as hit, max(date) as last from g group by 1),
  x as (select h.action_id, coalesce(hit, last) as exit_date, hit, arg_max(g.gross, g.date) as gross, min(g.gross) as low from h join g on g.action_id = h.action_id and g.date <= coalesce(hit, last) group by 1, 2, 3),
  results as (select a.action_id, a.creator_id, a.ticker, a.direction, a.clock, a.status,
    case when a.sign is null then 'non_directional' when a.ticker not in (select ticker from series) then 'no_price_data' when e.entry_date is null then 'no_entry_bar' when x.action_id is null then 'insufficient_bars' end as skip,
    case when x.action_id is null then null when gross <= {bt.STOP} then 'stop_loss' when gross >= {bt.TARGET} then 'target_reached' when hit is not null then 'time_exit' else 'end_of_period' end as exit_reason,
    case when x.action_id is not null then e.entry_date end as entry_date, exit_date, round(gross - {bt.COST}, 4) as return_pct, cast(exit_date - case when x.action_id is not null then e.entry_date end as integer) as holding_days, case when x.action_id is not null then round(least(0.0::double, low), 4) end as max_drawdown
    from a left join e using (action_id) left join x using (action_id))"""
_SETTLED = "s as (select action_id, status as old_status, case when status <> 'pending' then status when exit_reason in ('stop_loss', 'target_reached', 'time_exit') then case when return_pct > 0 then 'verified' else 'failed' end else 'pending' end as new_status from results)"
_TOTALS = "d as (select kol, cast(exit as date) as day, round_even(sum(cast(round_even(net_pnl * 10000, 0) as bigint)) / 100.0::double, 0) / 100 as pnl from trades group by 1, 2), totals as (select *, 1000000.0::double + sum(cast(round_even(pnl * 100, 0) as bigint)) over (partition by kol order by day) / 100.0::double as total from d)"
_ADJ = """daily as (select 'T' || (event_id % 11) as ticker, cast(ts as date) as date, arg_min(value, event_id) as open, arg_max(value, event_id) as close, max(value) as high, min(value) as low from events group by 1, 2), adj as (select ticker, date, 1 + (day(date) % 5) / 10.0::double as adj_factor from bars where day(date) % 3 <> 0),
  j as (select d.*, lag(d.close) over (partition by d.ticker order by d.date) as pre_close, first_value(adj_factor ignore nulls) over (partition by d.ticker order by d.date rows between current row and unbounded following) as factor from daily d left join adj using (ticker, date)),
  k as (select *, last_value(factor) over (order by date, ticker rows between unbounded preceding and unbounded following) as base from j where factor is not null)"""
_FEEDBACK = "fb as (select doc_id, lang, cast(1 + doc_id % 5 as integer) as rating, quality as ticker_correct, 1 - toxic as direction_correct from documents join labels using (doc_id))"
_WORDS = "w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as alias from documents), r(alias, ticker) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in REGISTRY.items()) + "), m as (select doc_id, ticker, count(*) as mentions, arg_max(alias, (length(alias), alias)) as longest_alias from w join r using (alias) group by 1, 2)"

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"{name} is registered already")
    _queries[name] = query
    if sql:
        _oracles[name] = sql


def _results(s: SparkSession, d: str) -> DataFrame:
    return bt.per_action_backtest(b.actions(s, d), b.bars(s, d))


def _bars_and_factors(how: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        daily = b.daily(s, d)
        return mk.adjusted_bars(daily, b.adj_factors(daily), how)

    return query


def _adjusted_sql(scale: str) -> str:
    prices = ", ".join(f"round_even({c} * {scale} * 100, 0) / 100 as {c}" for c in ("open", "high", "low", "close", "pre_close"))
    return f"{_WITH}, {_ADJ}, p as (select ticker, date, {prices} from k), q as (select *, round_even((close - pre_close) * 100, 0) / 100 as change from p) select *, round_even(change / nullif(pre_close, 0) * 100 * 100, 0) / 100 as pct_chg from q"


def _mentions(s: SparkSession, d: str) -> DataFrame:
    registry = s.createDataFrame(list(REGISTRY.items()), "alias string, ticker string")
    return tx.entity_mentions(table(s, d, "documents", "doc_id", "text"), registry)


def _feedback(s: SparkSession, d: str) -> DataFrame:
    return sc.feedback(table(s, d, "documents", "doc_id", "lang"), table(s, d, "labels"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nation = table(s, d, "nation", "n_nationkey", "n_regionkey").select(node("region", "n_regionkey").alias("parent"), node("nation", "n_nationkey").alias("child"))
    supplier = table(s, d, "supplier", "s_suppkey", "s_nationkey").select(node("nation", "s_nationkey").alias("parent"), node("supplier", "s_suppkey").alias("child"))
    return nation.unionByName(supplier)


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").schema
    return live.drain_to_folder(live.windowed_counts(live.event_stream(s, d, schema, "events.parquet")), *live.folders(s, "windowed"))


_register("timeline_summary", lambda s, d: tl.timeline_summary(b.actions(s, d)), f"{_WITH} select creator_id, count(*) as total, {_DIR}, string_agg(distinct ticker, ',' order by ticker) as tickers, min(clock) as first_at, max(clock) as last_at, round(avg(confidence), 4) as avg_confidence, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'pending') as pending from actions group by 1")
_register("timeline_filter_page", lambda s, d: tl.timeline_page(b.actions(s, d), "kol_1", ["bullish", "bearish"], 0.5, 20, 5), f"{_WITH} select * from actions where creator_id = 'kol_1' and direction in ('bullish', 'bearish') and confidence >= 0.5 order by clock desc, action_id desc limit 20 offset 5")
_register("per_kol_top_n", lambda s, d: tl.top_per_creator(b.actions(s, d), 5), f"{_WITH} select *, cast(row_number() over (partition by creator_id order by clock desc, action_id desc) as integer) as rank from actions qualify rank <= 5")
_register("distinct_values", lambda s, d: tl.distinct_values(b.actions(s, d), "ticker"), f"{_WITH} select distinct ticker from actions where ticker is not null")
for _by in ("direction", "status", "ticker", "creator_id"):
    _register(f"opinion_stats_{_by}", lambda s, d, by=_by: tl.opinion_stats(b.actions(s, d), by), f"{_WITH} {_STATS.format(_by)}")
_register("opinion_stats_top_tickers", lambda s, d: tl.top_values(b.actions(s, d), "ticker", 5), f"{_WITH} {_STATS.format('ticker')} order by n desc, ticker limit 5")
_register("latest_stance", lambda s, d: tl.latest_stance(b.actions(s, d)), f"{_WITH}, {_LATEST} select * from l")
_register("stance_episodes", lambda s, d: tl.stance_episodes(b.actions(s, d)), f"{_WITH}, {_TURNS}, u as (select *, cast(sum(case when before is null or before <> direction then 1 else 0 end) over (partition by creator_id, ticker order by clock, action_id) as integer) as episode from t), r as (select creator_id, ticker, episode, arg_min(direction, (clock, action_id)) as direction, arg_min(action_id, (clock, action_id)) as anchor_id, min(clock) as opened_at, max(clock) as last_at, count(*) - 1 as restatements from u group by 1, 2, 3) select *, episode = max(episode) over (partition by creator_id, ticker) as standing from r")
_register("history_flips", lambda s, d: tl.stance_flips(b.actions(s, d)), f"{_WITH}, {_TURNS} select creator_id, ticker, action_id, clock, before as from_direction, direction as to_direction from t where before <> direction")
_register("stance_snapshot_diff", lambda s, d: tl.stance_diff(b.actions(s, d), "2024-01-15"), f"{_WITH}, {_LATEST}, o as (select creator_id, ticker, arg_max(direction, (clock, action_id)) as old_direction from actions where clock < timestamp '2024-01-15' group by 1, 2) select l.creator_id, l.ticker, l.action_id, l.direction as new_direction, old_direction, case when old_direction is null then 'new_call' else 'flip' end as change from l left join o using (creator_id, ticker) where l.creator_id in (select creator_id from o) and (old_direction is null or old_direction <> l.direction)")
_register("shared_tickers", lambda s, d: tl.shared_tickers(b.actions(s, d)), f"{_WITH}, {_LATEST} select x.creator_id as left_id, y.creator_id as right_id, count(*) as shared, round(count(*) filter (x.direction = y.direction) / count(*), 4) as overlap from l x join l y on x.ticker = y.ticker and x.creator_id < y.creator_id group by 1, 2")
_register("consistency_weighted", lambda s, d: tl.consistency(b.actions(s, d)), f"{_WITH}, t as (select *, lag(direction) over (partition by creator_id, ticker order by clock, action_id) as before from actions where direction in ('bullish', 'bearish', 'neutral')), e as (select creator_id, ticker, count(*) as n, sum(case when before is null or before = direction then 0.0::double when before = 'neutral' or direction = 'neutral' then 0.3::double else 1.0::double end) as w from t group by 1, 2) select creator_id, round(100 * avg(greatest(0.0::double, 1 - w / (n - 1))), 2) as consistency from e where n >= 2 group by 1")
_register("adjusted_bars_qfq", _bars_and_factors("qfq"), _adjusted_sql("(factor / base)"))
_register("adjusted_bars_hfq", _bars_and_factors("hfq"), _adjusted_sql("factor"))
_register("asof_entry_bar", lambda s, d: mk.asof_bars(b.actions(s, d), b.bars(s, d)), f"{_WITH} select a.action_id, p.date as last_date, p.close as last_close, n.date as next_date, n.close as next_close from actions a asof left join bars p on p.ticker = a.ticker and p.date <= cast(a.clock as date) asof left join bars n on n.ticker = a.ticker and n.date >= cast(a.clock as date)")
_register("trading_days", lambda s, d: mk.neighbour_days(mk.calendar_of(table(s, d, "orders", "o_orderdate"), "o_orderdate")), "with c as (select distinct cast(o_orderdate as date) as date, isodow(o_orderdate) < 6 as is_open from orders) select date, is_open, last_value(case when is_open then date end ignore nulls) over (order by date rows between unbounded preceding and 1 preceding) as prev_day, first_value(case when is_open then date end ignore nulls) over (order by date rows between 1 following and unbounded following) as next_day, count(*) filter (is_open) over (order by date rows between unbounded preceding and current row) as open_days from c")
_register("per_action_backtest", _results, f"{_WITH}, {_OUTCOME} select * from results")
_register("settle_transitions", lambda s, d: bt.settle(_results(s, d)), f"{_WITH}, {_OUTCOME}, {_SETTLED} select * from s")
_register("settle_report", lambda s, d: bt.settle_report(_results(s, d)), f"{_WITH}, {_OUTCOME}, {_SETTLED} select old_status, new_status, count(*) as n from s group by 1, 2")
_register("credibility_leaderboard", lambda s, d: bt.credibility(_results(s, d)), f"{_WITH}, {_OUTCOME}, c as (select creator_id, count(*) filter (return_pct is not null and holding_days > 0) as settled, count(*) filter (return_pct > 0 and holding_days > 0) as wins from results group by 1) select *, greatest(0, least(99, cast(round_even(40 + 55 * (wins + 2) / (settled + 4), 0) as integer))) as credibility from c")
_register("drawdown_runs", lambda s, d: bt.drawdown(bt.daily_totals(b.trades(s, d))), f"{_WITH}, {_TOTALS}, p as (select *, max(total) over (partition by kol order by day) as peak from totals), q as (select *, case when peak > 0 then 1 - total / peak else 0 end as dd from p), i as (select *, sum(case when dd > 0 then 0 else 1 end) over (partition by kol order by day) as island from q), r as (select kol, island, max(dd) as dd, count(*) filter (dd > 0) as run from i group by 1, 2) select kol, round(max(dd), 6) as max_drawdown, max(run) as longest_run from r group by 1")
_register("consecutive_losses", lambda s, d: bt.consecutive_losses(b.trades(s, d)), f"{_WITH}, i as (select *, sum(case when net_pnl < 0 then 0 else 1 end) over (partition by kol order by exit, l_orderkey, l_linenumber, ticker, holding_days, net_pnl, return_pct rows unbounded preceding) as island from trades), r as (select kol, island, count(*) filter (net_pnl < 0) as run from i group by 1, 2) select kol, max(run) as max_losses from r group by 1")
_register("backtest_metrics", lambda s, d: bt.backtest_metrics(bt.daily_totals(b.trades(s, d))), f"{_WITH}, {_TOTALS}, r as (select kol, pnl / total as r from totals), q as (select kol, quantile_cont(r, 0.05) as v from r group by 1) select kol, count(*) as days, round(stddev_samp(r) * sqrt(252), 6) as volatility, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 4) as sharpe, round(max(v), 6) as value_at_risk, round(avg(r) filter (r <= v), 6) as expected_shortfall from r join q using (kol) group by 1")
_register("kol_attribution", lambda s, d: bt.trade_attribution(b.trades(s, d)), f"{_WITH} select kol, count(*) as n, round(count(*) filter (net_pnl > 0) / count(*), 4) as win_rate, round(sum(case when net_pnl > 0 then net_pnl else 0 end) / nullif(sum(case when net_pnl < 0 then -net_pnl else 0 end), 0), 4) as profit_factor, round(avg(net_pnl) filter (net_pnl > 0), 2) as avg_win, round(avg(net_pnl) filter (net_pnl < 0), 2) as avg_loss, round(avg(holding_days), 2) as avg_days from trades group by 1")
_register("perf_alerts", lambda s, d: sc.perf_alerts(table(s, d, "events", "event_type", "value"), "event_type", "value", 100, 200), "select event_type, case when value > 200 then 'critical' when value > 100 then 'warning' else 'ok' end as level, count(*) as n from events group by 1, 2")
_register("failure_rate_alert", lambda s, d: sc.failure_rate(table(s, d, "events", "event_type", "ts"), 0.2), "select cast(ts as date) as day, count(*) as n, round(count(*) filter (event_type = 'error') / count(*), 4) as rate, count(*) filter (event_type = 'error') / count(*) > 0.2 as alert from events group by 1")
_register("sizing_bands", lambda s, d: sc.sizing_bands(b.actions(s, d)), f"{_WITH} select direction, case when direction not in ('bullish', 'bearish') then 'none' when confidence < 0.35 then 'small' when confidence < 0.70 then 'medium' else 'large' end as size_band, case time_horizon when 'short_term' then 30 when 'medium_term' then 90 else 180 end as window_days, count(*) as n, round(avg(confidence), 4) as avg_confidence from actions group by 1, 2, 3")
_register("sentiment_fusion", lambda s, d: sc.sentiment_fusion(table(s, d, "events", "user_id", "ts", "event_type", "value")), "with e as (select user_id, cast(ts as date) as day, event_type, least(1.0::double, value / 250) * 2 - 1 as v from events), p as (select user_id, day, avg(v) filter (event_type = 'purchase') as a, avg(v) filter (event_type = 'view') as b, avg(v) filter (event_type = 'click') as c from e group by 1, 2), q as (select user_id, day, round((coalesce(a * 0.4::double, 0) + coalesce(b * 0.2::double, 0) + coalesce(c * 0.4::double, 0)) / nullif(case when a is not null then 0.4::double else 0 end + case when b is not null then 0.2::double else 0 end + case when c is not null then 0.4::double else 0 end, 0), 6) as score from p) select *, case when score > 0.15 then 'bullish' when score < -0.15 then 'bearish' else 'neutral' end as class from q where score is not null")
_register("quality_gate", lambda s, d: sc.quality_gate(table(s, d, "documents", "doc_id", "text"), table(s, d, "labels")), "with q as (select doc_id, toxic, round(0.5::double * least(1.0::double, length(text) / 1000) + 0.5::double * coalesce(quality, 0), 4) as score from documents left join labels using (doc_id)) select doc_id, score, case when toxic = 1 then 'reject' when score < 0.3 then 'reject' when score < 0.7 then 'review' else 'pass' end as gate from q")
_register("content_hash_dedupe", lambda s, d: tx.hash_dedupe(table(s, d, "documents", "doc_id", "text")), "select sha1(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'))[1:16] as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1".replace("\\\\", "\\"))
_register("block_types", lambda s, d: tx.split_blocks(table(s, d, "documents", "doc_id", "text")), r"with l as (select doc_id, i, trim(string_split(text, chr(10))[i + 1]) as body from (select doc_id, text, unnest(range(0, length(string_split(text, chr(10))))) as i from documents)) select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as order_index, case when regexp_matches(body, '^([-*]|[0-9]+[.)]) ') then 'list' when length(body) < 40 and not ends_with(body, '.') then 'heading' else 'paragraph' end as block_type, cast(length(body) as integer) as n_chars from l where body <> ''")
_register("topic_runs", lambda s, d: tx.topic_runs(table(s, d, "conversations")), "with m as (select *, case when lag(role) over w = role then 0 else 1 end as turned from conversations window w as (partition by conv_id order by turn)), r as (select *, cast(sum(turned) over (partition by conv_id order by turn) as integer) as run from m) select conv_id, run, arg_min(role, turn) as role, min(turn) as first_turn, count(*) as turns, cast(sum(length(text)) as bigint) as chars from r group by 1, 2")
_register("text_style", lambda s, d: tx.text_style(table(s, d, "documents", "doc_id", "text")), r"with w as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as words from documents) select doc_id, cast(length(words) as integer) as words, cast(length(list_distinct(words)) as integer) as distinct_words, round(1 - length(list_distinct(words)) / nullif(length(words), 0), 4) as redundancy, cast(length(text) - length(replace(text, '?', '')) as integer) as questions, cast(length(text) - length(replace(text, '!', '')) as integer) as exclamations, cast(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as integer) as digits from w")
_register("entity_mentions", _mentions, f"with {_WORDS} select * from m")
_register("entity_index", lambda s, d: tx.entity_index(_mentions(s, d)), f"with {_WORDS} select ticker, count(*) as texts, cast(sum(mentions) as bigint) as mentions, min(doc_id) as first_doc from m group by 1")
_register("stratified_select", lambda s, d: tx.stratified_select(table(s, d, "documents", "doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 3), "select doc_id, source, n_chars, cast(row_number() over (partition by source order by n_chars desc, doc_id) as integer) as rank from documents qualify rank <= 3")
_register("stratified_sample", lambda s, d: tx.stratified_sample(table(s, d, "documents", "doc_id", "source"), "source", "doc_id", 0.05, 2), "select doc_id, source, count(*) over (partition by source) as n, cast(row_number() over (partition by source order by doc_id) as integer) as rank from documents qualify rank <= least(n, greatest(2, ceil(n * 0.05)))")
_register("integrity_antijoins", lambda s, d: ct.orphans(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey"), table(s, d, "supplier", "s_suppkey").where("s_suppkey % 7 <> 0"), "l_suppkey", "s_suppkey"), "select l_orderkey, l_linenumber, l_suppkey from lineitem anti join (select s_suppkey from supplier where s_suppkey % 7 <> 0) on l_suppkey = s_suppkey")
_register("latest_version", lambda s, d: ct.versions(table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey"), "select o_custkey, o_orderkey, o_orderdate, cast(row_number() over w as integer) as version_no, row_number() over w = count(*) over (partition by o_custkey) as is_latest from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
_register("name_scd2", lambda s, d: ct.name_history(table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "o_orderkey"), "with c as (select o_custkey, o_orderkey, o_orderpriority from orders qualify lag(o_orderpriority) over (partition by o_custkey order by o_orderkey) is distinct from o_orderpriority) select o_custkey, o_orderpriority, o_orderkey as valid_from, lead(o_orderkey) over w as valid_to, lead(o_orderkey) over w is null as is_current from c window w as (partition by o_custkey order by o_orderkey)")
_register("lineage_closure", lambda s, d: ct.lineage_closure(_edges(s, d)), "with recursive e as (select 'region:' || n_regionkey as parent, 'nation:' || n_nationkey as child from nation union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier), walk as (select parent as ancestor, child as descendant from e union select w.ancestor, e.child from walk w join e on e.parent = w.descendant) select distinct ancestor, descendant from walk")
_register("rlhf_stats", lambda s, d: sc.rlhf_stats(_feedback(s, d), s), f"with {_FEEDBACK} select r.rating, count(doc_id) as n, round(avg(ticker_correct), 4) as ticker_accuracy, round(avg(direction_correct), 4) as direction_accuracy, count(*) filter (doc_id is not null and (r.rating >= 4 or r.rating <= 2)) as dpo_ready from (select cast(x as integer) as rating from range(1, 6) t(x)) r left join fb using (rating) group by 1")
_register("preference_pairs", lambda s, d: sc.preference_pairs(_feedback(s, d)), f"with {_FEEDBACK} select lang, arg_min(doc_id, (-rating, doc_id)) as chosen, arg_min(doc_id, (rating, doc_id)) as rejected, max(rating) - min(rating) as margin from fb group by 1 having max(rating) - min(rating) >= 2")
_register("stream_windowed_counts", _stream, "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
