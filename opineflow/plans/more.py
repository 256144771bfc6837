"""Further registered queries: intents, traces, texts, ratings, markets and streams, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import backtest as bt
from opineflow.operators import catalog as ct
from opineflow.operators import content as tx
from opineflow.operators import intents as it
from opineflow.operators import market as mk
from opineflow.operators import passages as ps
from opineflow.operators import ratings as rt
from opineflow.operators import scoring as sc
from opineflow.operators import timeline as tl
from opineflow.plans import bindings as b
from opineflow.plans import queries as base
from opineflow.sources.tables import table
from opineflow.streaming import live

_WITH = base._WITH
_register = base._register
FOR, AGAINST, NEGATOR = ["the ", "and", "with", "der ", "que"], ["that", "from", "this", "und", "los "], "of"
TERMS = ["the", "with", "der"]
_POLICIES = "action_hint"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text")


def runs(s: SparkSession, d: str) -> DataFrame:
    """Intents of three extraction runs, made of document ids."""
    i = F.col("doc_id")
    return table(s, d, "documents", "doc_id").select(
        (i % 50).alias("content_id"), F.concat(F.lit("T"), (i % 7).cast("string")).alias("target"), (F.floor(i / 50) % 3).alias("run"), i.alias("intent_id"), i.alias("span"),
        F.when(i % 5 < 3, "bullish").when(i % 5 == 3, "bearish").otherwise("neutral").alias("direction"), F.when(i % 2 == 0, "add").otherwise("reduce").alias("delta"),
        (i % 10 / F.lit(10.0)).alias("conviction"), (i % 100 / F.lit(100.0)).alias("confidence"), F.when(i % 3 != 0, "short_term").alias("horizon"),
    )


_RUNS = """with runs as (select doc_id % 50 as content_id, 'T' || (doc_id % 7) as target, (doc_id // 50) % 3 as run, doc_id as intent_id, doc_id as span,
    case when doc_id % 5 < 3 then 'bullish' when doc_id % 5 = 3 then 'bearish' else 'neutral' end as direction, case when doc_id % 2 = 0 then 'add' else 'reduce' end as delta,
    (doc_id % 10) / 10.0::double as conviction, (doc_id % 100) / 100.0::double as confidence, case when doc_id % 3 <> 0 then 'short_term' end as horizon from documents)"""


def _policy(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame([("bullish", "verified", "add"), ("bullish", None, "open"), ("bearish", None, "close"), (None, "failed", "review")], "direction string, status string, action_hint string")
    rows = b.actions(s, d).select("action_id", "direction", "status")
    return it.apply_rules(rows, rules, [["direction", "status"], ["direction"], ["status"]], _POLICIES)


def _traces(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("intent_id"))
    spans = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("action_id"), F.col("l_linenumber").alias("span_id"), F.col("l_partkey").alias("policy_id"))
    intents = table(s, d, "customer", "c_custkey").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("intent_id"))
    return it.broken_traces(orders, spans, intents, table(s, d, "part", "p_partkey").where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("policy_id")))


def _upserted(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders", "o_orderkey", "o_orderstatus").withColumn("version", F.lit(1))
    updates = orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("version", F.lit(1) + (F.col("o_orderkey") % 2).cast("int"))
    return ct.upsert(orders, updates, "o_orderkey", "version")


def _views(s: SparkSession, d: str) -> DataFrame:
    t = b.trades(s, d)
    return t.select("kol", F.when(F.col("l_linenumber") % 3 == 0, "neutral").otherwise("bullish").alias("direction"), (F.col("return_pct") > 0).alias("right_7d"), (F.col("holding_days") > 25).alias("right_30d"), (100 * F.col("return_pct")).alias("excess"))


def _timed(s: SparkSession, d: str) -> DataFrame:
    market = F.element_at(F.array(F.lit("HK"), F.lit("CN"), F.lit("US"), F.lit("XX")), (F.col("event_id") % 4 + 1).cast("int"))
    events = table(s, d, "events", "event_id", "ts").select("event_id", market.alias("market"), F.col("ts").cast("timestamp_ntz").alias("local"))
    return mk.session_timing(events, mk.trading_calendar("2023-12-25", "2024-02-15", s))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    lines = _docs(s, d).select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return ps.overlap(table(s, d, "benchmark", "item_id", "text"), lines).agg(F.count("*").alias("items"), F.count_if("leaked").alias("overlap"))


def _pairs_json(s: SparkSession, d: str) -> DataFrame:
    return sc.preference_pairs(base._feedback(s, d)).select(F.to_json(F.struct("lang", "chosen", "rejected", "margin")).alias("line"))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    return live.event_stream(s, d, table(s, d, "events").schema, "events.parquet")


def _live_stances(s: SparkSession, d: str) -> DataFrame:
    return live.drain_to_folder(live.live_latest(b.actions_of(_event_stream(s, d))), *live.folders(s, "stances"))


def _first_arrivals(s: SparkSession, d: str) -> DataFrame:
    """Each event once, by its id: the stream holds all of them twice."""
    e = _event_stream(s, d).select("event_id", F.col("ts").cast("timestamp").alias("at"))
    rows = live.drain_appended(live.first_arrivals(e.unionByName(e), ["event_id"], "at", "60 days"), *live.folders(s, "arrivals"))
    return rows.select("event_id")


def _text(v: str) -> str:
    """A literal for DuckDB."""
    return "'" + v.replace("'", "''") + "'"


def _rewrite_sql(column: str, steps) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(to)}, 'g')"
    return column


def _present_sql(words: list[str], negated: bool) -> str:
    no = "" if negated else "not "
    return " + ".join(f"cast(contains(low, {_text(w)}) and {no}contains(low, {_text(f'{NEGATOR} {w}')}) as integer)" for w in words)


_PLUS, _MINUS = f"({_present_sql(FOR, False)} + {_present_sql(AGAINST, True)})", f"({_present_sql(AGAINST, False)} + {_present_sql(FOR, True)})"
_SIGNALS = " + ".join(f"((length(text) - length(replace(lower(text), {_text(w)}, ''))) // {len(w)})" for w in TERMS)
_BM25 = ", ".join(f"({_text(t)})" for t in TERMS)
_HOURS = "h(market, first, last) as (values " + ", ".join(f"('{m}', time '{a}', time '{z}')" for m, a, z in mk.SESSIONS) + ")"

_register("action_meta", lambda s, d: tl.action_meta(b.actions(s, d)), f"{_WITH} select count(*) as total, count(distinct ticker) as tickers, count(distinct creator_id) as creators, min(clock) as first_at, max(clock) as last_at from actions")
_register("direction_overlap", lambda s, d: tl.direction_cosine(b.actions(s, d)), f"{_WITH}, {base._LATEST}, v as (select creator_id, ticker, case when direction = 'bullish' then 1 when direction in ('bearish', 'risk_warning') then -1 end as s from l where direction in ('bullish', 'bearish', 'risk_warning')), n as (select creator_id, count(*) as n from v group by 1), p as (select x.creator_id as left_id, y.creator_id as right_id, sum(x.s * y.s) as dot from v x join v y on x.ticker = y.ticker and x.creator_id < y.creator_id group by 1, 2) select left_id, right_id, round(dot / sqrt(l2.n * r2.n), 6) as cosine from p join n l2 on l2.creator_id = left_id join n r2 on r2.creator_id = right_id")
_register("intent_dedupe", lambda s, d: it.merge_intents(runs(s, d)), f"{_RUNS} select content_id, target, direction, delta, min(intent_id) as intent_id, array_to_string(list_sort(list(distinct span)), ',') as spans, max(conviction) as conviction, max(confidence) as confidence, arg_min(horizon, intent_id) filter (horizon is not null) as horizon from runs group by 1, 2, 3, 4")
_register("contradiction_collapse", lambda s, d: it.collapse_contradictions(runs(s, d)), f"{_RUNS}, r as (select content_id, target, intent_id, direction, min(direction) over w <> max(direction) over w as collapsed, count(*) over w as n, row_number() over (partition by content_id, target order by conviction desc, confidence desc, intent_id) as place from runs window w as (partition by content_id, target)) select content_id, target, intent_id, direction, collapsed, n from r where not collapsed or place = 1")
_register("consensus_vote", lambda s, d: it.consensus(runs(s, d), 3), f"{_RUNS}, v as (select content_id, target, direction, count(distinct run) as votes, arg_max(intent_id, (confidence, conviction, intent_id)) as intent_id, max(confidence) as confidence from runs group by 1, 2, 3), o as (select *, count(*) filter (direction in ('bullish', 'bearish')) over (partition by content_id, target) as opposed from v) select content_id, target, direction, votes, intent_id, confidence from o where votes >= case when opposed = 2 then 3 else 2 end")
_register("duplicate_actions", lambda s, d: it.first_of_duplicates(b.actions(s, d)), f"{_WITH} select creator_id, ticker, direction, cast(clock as date) as day, min(action_id) as action_id, count(*) as copies from actions group by 1, 2, 3, 4")
_register("policy_map", _policy, f"{_WITH} select action_id, direction, status, case when direction = 'bullish' and status = 'verified' then 'add' when direction = 'bullish' then 'open' when direction = 'bearish' then 'close' when status = 'failed' then 'review' end as action_hint from actions")
_register("trace_integrity", _traces, "with w as (select l_orderkey as k, bool_and(p_partkey is not null) as ok from lineitem left join (select p_partkey from part where p_partkey % 20 <> 0) on p_partkey = l_partkey group by 1) select case when c_custkey is null then 'intent_missing' when ok is null then 'no_evidence' when not ok then 'span_unresolved' else 'ok' end as code, count(*) as n from orders left join (select c_custkey from customer where c_custkey % 10 <> 0) on c_custkey = o_custkey left join w on k = o_orderkey group by 1")
_register("count_reconcile", lambda s, d: ct.reconcile(table(s, d, "customer", "c_nationkey"), table(s, d, "supplier", "s_nationkey"), "c_nationkey", "s_nationkey"), "with a as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1) select coalesce(a.k, b.k) as key, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right, coalesce(a.n, 0) = coalesce(b.n, 0) as agrees from a full join b on a.k is not distinct from b.k")
_register("upsert_merge", _upserted, "select o_orderkey, cast(case when o_orderkey % 3 = 0 then 1 + o_orderkey % 2 else 1 end as integer) as version, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders")
_register("html_to_markdown", lambda s, d: table(s, d, "pages", "page_id", "html").select("page_id", ps.rewrite(F.col("html"), ps.MARKDOWN_STEPS).alias("markdown")), f"select page_id, {_rewrite_sql('html', ps.MARKDOWN_STEPS)} as markdown from pages")
_register("clean_text", lambda s, d: table(s, d, "pages", "page_id", "html").select("page_id", ps.rewrite(F.col("html"), ps.PLAIN_STEPS).alias("body")), f"select page_id, {_rewrite_sql('html', ps.PLAIN_STEPS)} as body from pages")
_register("text_rhythm", lambda s, d: ps.text_rhythm(_docs(s, d)), "with d as (select doc_id, length(text) as chars, length(text) - length(regexp_replace(text, '[,;:]', '', 'g')) as pauses, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: length(trim(x, ' '))), lambda n: n > 0) as l from documents), e as (select *, length(l) as n, list_sum(l) as s, list_sum(list_transform(l, lambda x: x * x)) as q from d) select doc_id, cast(n as integer) as sentences, round(s / nullif(n, 0), 3) as mean_chars, round(q / nullif(n, 0) - (s / nullif(n, 0)) * (s / nullif(n, 0)), 2) as variance, round(length(list_filter(range(1, n), lambda i: l[i + 1] < 0.7::double * l[i] or l[i + 1] > 1.3::double * l[i])) / nullif(n - 1, 0), 4) as alternation, round(pauses / nullif(chars, 0), 4) as pause_density from e")
_register("sentiment_rules", lambda s, d: ps.sentiment_rules(_docs(s, d), FOR, AGAINST, NEGATOR), f"with t as (select doc_id, lower(text) as low from documents), p as (select doc_id, {_PLUS} as plus, {_MINUS} as minus from t), q as (select doc_id, round((plus - minus) / nullif(plus + minus, 0), 4) as score from p) select *, case when score > 0.15 then 'bullish' when score < -0.15 then 'bearish' else 'neutral' end as class from q")
_register("passage_signals", lambda s, d: ps.passage_signals(_docs(s, d), TERMS, 100, 5000), f"select doc_id, cast({_SIGNALS} as integer) as signals, cast(length(regexp_extract_all(text, '[0-9]+')) as integer) as numbers, case when length(text) < 100 or length(text) > 5000 then 'noise' when {_SIGNALS} >= 5 then 'signal' else 'plain' end as kind from documents")
_register("fts_search", lambda s, d: ps.search(_docs(s, d), TERMS, 20), f"with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as w from documents), c as (select cast(count(*) as double) as n, avg(length(w)) as mean from w), t(term) as (values {_BM25}), h as (select doc_id, length(w) as len, term, length(list_filter(w, lambda x: x = term)) as tf from w, t), f as (select term, count(*) as df from h where tf > 0 group by 1) select doc_id, round(sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / c.mean))), 6) as score, count(*) as matched from h join f using (term), c where tf > 0 group by 1 order by score desc, doc_id limit 20")
_register("related_content", lambda s, d: ps.related_content(base._mentions(s, d), 1), f"with {base._WORDS} select doc_id, count(*) as shared from m where doc_id <> 1 and ticker in (select ticker from m where doc_id = 1) group by 1")
_register("coverage_by_group", lambda s, d: ps.coverage(table(s, d, "documents", "doc_id", "lang"), base._mentions(s, d), "lang", 2), f"with {base._WORDS}, g as (select lang, count(*) as blocks, count(x.doc_id) as hits from documents d left join (select distinct doc_id from m) x on x.doc_id = d.doc_id group by 1), q as (select *, round(hits / blocks, 4) as rate from g) select *, row_number() over (order by rate, lang) <= 2 as worst from q")
_register("eval_rates", lambda s, d: rt.group_rates(table(s, d, "documents", "doc_id", "source").join(table(s, d, "labels"), "doc_id", "left"), "source", compliant="quality = 1", grounded="toxic = 0"), "select source, count(*) as n, round(count(*) filter (quality = 1) / nullif(count(quality), 0), 4) as compliant, round(count(*) filter (toxic = 0) / nullif(count(toxic), 0), 4) as grounded from documents left join labels using (doc_id) group by 1")
_register("train_eval_overlap", _overlap, "with l as (select trim(unnest(string_split(text, chr(10))), ' ') as line from documents) select count(*) as items, count(*) filter (trim(text, ' ') in (select line from l)) as overlap from benchmark")
_register("dpo_export", _pairs_json, f"with {base._FEEDBACK}, p as (select lang, arg_min(doc_id, (-rating, doc_id)) as chosen, arg_min(doc_id, (rating, doc_id)) as rejected, max(rating) - min(rating) as margin from fb group by 1 having max(rating) - min(rating) >= 2) select cast(json_object('lang', lang, 'chosen', chosen, 'rejected', rejected, 'margin', margin) as varchar) as line from p")
_register("budget_breaker", lambda s, d: rt.budget_breaker(table(s, d, "events", "event_id", "event_type", "ts", "value"), 500_000), "with e as (select event_id, event_type, sum(cast(round(value * 100) as bigint)) over (partition by event_type order by ts, event_id) as spent from events) select event_type, count(*) filter (spent < 500000) + max(case when spent >= 500000 then 1 else 0 end) as done, arg_min(event_id, spent) filter (spent >= 500000) as tripped_by from e group by 1")
_register("rating_engine", lambda s, d: rt.accuracy_rating(_views(s, d)), f"{_WITH}, v as (select kol, case when l_linenumber % 3 = 0 then 1.0::double else 1.5::double end as w, case when return_pct > 0 then 100 else 0 end + case when holding_days > 25 then 10 else 0 end + greatest(-20.0::double, least(20.0::double, 200 * return_pct)) as p from trades), r as (select kol, count(*) as views, greatest(0.0::double, least(100.0::double, sum(p * w) / sum(w))) as a from v group by 1) select kol, views, round(a, 3) as accuracy, case when a >= 90 then 5 when a >= 75 then 4 when a >= 60 then 3 when a >= 40 then 2 else 1 end as stars from r")
_register("rating_from_backtest", lambda s, d: rt.backtest_rating(bt.trade_attribution(b.trades(s, d)), bt.backtest_metrics(bt.daily_totals(b.trades(s, d)))), f"{_WITH}, {base._TOTALS}, r as (select kol, pnl / total as r from totals), m as (select kol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 4) as sharpe from r group by 1), w as (select kol, round(count(*) filter (net_pnl > 0) / count(*), 4) as win from trades group by 1) select kol, round(3 * win + 0.4::double * greatest(0.0::double, least(5.0::double, 2.5::double + coalesce(sharpe, 0))), 3) as rating from w left join m using (kol)")
_register("strategy_ranking", lambda s, d: rt.rank_strategies(b.trades(s, d), 1_000_000.0), f"{_WITH}, e as (select kol, count(*) as n, round(sum(net_pnl) / 1000000.0::double, 6) as total_return from trades group by 1), r as (select *, cast(row_number() over (order by total_return desc, kol) as integer) as rank from e) select *, rank = 1 as best from r")
_register("sign_alternation", lambda s, d: rt.sign_alternation(b.trades(s, d), "exit", "l_orderkey", "l_linenumber", "ticker", "holding_days", "net_pnl", "return_pct"), f"{_WITH}, t as (select kol, return_pct as r, lag(return_pct) over (partition by kol order by exit, l_orderkey, l_linenumber, ticker, holding_days, net_pnl, return_pct) as b from trades) select kol, round(count(*) filter (r * b < 0) / nullif(count(b), 0), 4) as alternation from t group by 1")
_register("market_session_timing", _timed, f"""with {_HOURS}, e as (select event_id, case event_id % 4 when 0 then 'HK' when 1 then 'CN' when 2 then 'US' else 'XX' end as market, ts as local from events),
  s as (select e.*, first, case when first is null then 'unknown' when isodow(local) > 5 then 'non_trading_day' when cast(local as time) < first then 'pre_market' when cast(local as time) <= last then 'regular' else 'after_close' end as session from e left join h using (market))
  select event_id, market, session, case when session in ('regular', 'unknown') then local + interval 5 minute when session = 'pre_market' then cast(local as date) + first else cast(cast(local as date) + cast(greatest(1, case when isodow(local) >= 5 then 8 - isodow(local) else 1 end) as integer) as date) + first end as executable_at from s""")
_register("daily_scan_filters", lambda s, d: mk.daily_scan(b.bars(s, d), ["T1", "T4"], "20240105", "2024-01-20"), f"{_WITH} select * from bars where ticker in ('T1', 'T4') and date between date '2024-01-05' and date '2024-01-20'")
_register("asof_anchor_window", lambda s, d: mk.anchor_windows(b.actions(s, d), b.bars(s, d), 2), f"{_WITH}, n as (select *, row_number() over (partition by ticker order by date) as no from bars), p as (select a.action_id, a.ticker, coalesce(n.no, 1) as at from actions a asof left join n on n.ticker = a.ticker and n.date <= cast(a.clock as date)) select action_id, count(*) as bars, min(date) as first_date, max(date) as last_date, max(close) as high, min(close) as low from p join n on n.ticker = p.ticker and n.no between p.at - 2 and p.at + 2 group by 1")
_register("stream_latest_stance", _live_stances, f"{_WITH}, {base._LATEST} select * from l")
_register("stream_first_arrivals", _first_arrivals, "select event_id from events")
