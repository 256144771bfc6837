"""Registered queries of scores, metrics, reports and catalog joins, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import backtest as bt
from opineflow.operators import evaluation as ev
from opineflow.plans import bindings as b
from opineflow.plans import queries as base
from opineflow.sources.tables import table

_WITH = base._WITH
_register = base._register


def _k():
    return F.col("o_orderkey")


def _extractions(s: SparkSession, d: str) -> DataFrame:
    direction = F.element_at(F.array(*[F.lit(x) for x in ("bullish", "bearish", "neutral", "sideways")]), (_k() % 4 + 1).cast("int"))
    return table(s, d, "orders", "o_orderkey").select(
        _k().alias("id"), F.when(_k() % 9 == 0, "NONE").when(_k() % 9 == 1, "N/A").otherwise(F.concat(F.when(_k() % 5 == 0, "$").otherwise(""), F.lit("TK"), (_k() % 9).cast("string"))).alias("ticker"), direction.alias("direction"),
        F.when(_k() % 3 == 0, F.array((_k() % 50).cast("double"))).otherwise(F.array().cast("array<double>")).alias("prices"), (_k() % 11 / F.lit(10.0)).alias("conviction"),
        F.when(_k() % 13 == 0, " ").otherwise("why").alias("rationale"), F.concat(F.lit("about tk"), (_k() % 6).cast("string"), F.lit(" at "), (_k() % 25).cast("string")).alias("evidence"),
    )


_REWARD_SQL = """with e as (select o_orderkey as id, o_orderkey as k, case when o_orderkey % 9 = 0 then 'NONE' when o_orderkey % 9 = 1 then 'N/A' else 'TK' || (o_orderkey % 9) end as ticker,
    list_extract(['bullish', 'bearish', 'neutral', 'sideways'], o_orderkey % 4 + 1) as direction, (o_orderkey % 11) / 10.0::double as conviction, upper('about tk' || (o_orderkey % 6) || ' at ' || (o_orderkey % 25)) as ev from orders),
  g as (select *, direction in ('bullish', 'bearish') as committal, case when ticker = 'NONE' or contains(ev, ticker) then 0.7::double else 0.0::double end + case when k % 3 <> 0 or contains(ev, cast(k % 50 as varchar)) then 0.3::double else 0.0::double end as grounding from e),
  c as (select *, conviction - case when not committal then 0.3::double when grounding >= 0.99::double then 0.8::double when grounding >= 0.7::double then 0.6::double else 0.45::double end as over from g),
  h as (select *, case when over <= 1e-9 then 1.0::double else greatest(0.0::double, 1 - over) end as calibration from c),
  r as (select *, case when committal then (0.5::double * grounding + 0.4::double * calibration) / (0.5::double + 0.4::double) else (0.4::double * calibration + 0.1::double) / (0.4::double + 0.1::double) end - case when committal and ticker = 'N/A' then 0.5::double else 0 end - case when k % 13 = 0 then 0.2::double else 0 end as reward from h)
  select id, committal, round(grounding, 4) as grounding, round(calibration, 4) as calibration, round(case when direction = 'sideways' then 0.0::double else greatest(0.0::double, least(1.0::double, reward)) end, 6) as reward from r"""


def _golds(s: SparkSession, d: str) -> DataFrame:
    word = lambda k: F.element_at(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral")), (k % 3 + 1).cast("int"))
    i = table(s, d, "lineitem", "l_orderkey", "l_partkey")
    return i.select(F.col("l_orderkey").alias("id"), word(F.col("l_orderkey")).alias("direction"), word(F.col("l_partkey")).alias("gold_direction"), F.concat(F.lit("$t"), (F.col("l_orderkey") % 4).cast("string")).alias("ticker"), F.concat(F.lit("T"), (F.col("l_partkey") % 4).cast("string")).alias("gold_ticker"))


def _priced(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part", "p_partkey", "p_size", "p_retailprice")
    kind = F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("watch")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("price"), F.lit(45.0).alias("high_52wk"), F.lit(5.0).alias("low_52wk"), kind.alias("action_type"), (F.col("p_partkey") % 60).cast("double").alias("target_low"), (F.col("p_partkey") % 90).cast("double").alias("target_high"))


def _quality(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id").select(F.col("doc_id").alias("id"))
    notes = docs.where("id % 3 <> 0").select((F.col("id") + F.when(F.col("id") % 10 == 1, 10_000_000).otherwise(0)).alias("id"), F.when(F.col("id") % 7 != 0, "x").alias("label"))
    return ev.annotation_quality(docs, notes, docs.where("id % 4 = 0"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "user_id", "event_type", "value")
    return e.select(F.col("event_type").alias("model"), (F.col("user_id") % 40).alias("content_id"), F.col("event_id").alias("repeat"), (F.col("event_id") % 3).cast("string").alias("answer"), F.col("value").alias("latency"), (F.col("event_id") % 5 > 1).alias("grounded"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("total 1,"), F.lpad((_k() % 1000).cast("string"), 3, "0"), F.lit(".50 less ("), (_k() % 30).cast("string"), F.lit(") and "), (_k() % 7).cast("string"))
    gold = F.array(F.concat(F.lit("1"), F.lpad((_k() % 500).cast("string"), 3, "0"), F.lit(".50")), F.concat(F.lit("-"), (_k() % 30).cast("string")), (_k() % 5).cast("string"))
    return ev.number_recall(table(s, d, "orders", "o_orderkey").select(_k().alias("id"), text.alias("text"), gold.alias("gold")))


def _assets(s: SparkSession, d: str) -> DataFrame:
    contents = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(_k().alias("content_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("title"))
    stages = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("stage"), F.when(F.col("l_returnflag") == "R", "ready").when(F.col("l_returnflag") == "A", "partial").otherwise("failed").alias("status"))
    sources = table(s, d, "customer", "c_custkey", "c_name", "c_nationkey").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"), F.col("c_nationkey").alias("group_id"))
    groups = table(s, d, "nation", "n_nationkey", "n_name").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"))
    return ev.asset_index(contents, stages, sources, groups)


def _missing(s: SparkSession, d: str) -> DataFrame:
    t = lambda name, where="true": table(s, d, name).where(where)
    return ev.missing_keys({
        "order_customer": (t("orders"), "o_custkey", t("customer", "c_custkey % 8 <> 0"), "c_custkey"), "line_order": (t("lineitem"), "l_orderkey", t("orders", "o_orderkey % 6 <> 0"), "o_orderkey"),
        "line_part": (t("lineitem"), "l_partkey", t("part", "p_partkey % 5 <> 0"), "p_partkey"), "customer_nation": (t("customer"), "c_nationkey", t("nation", "n_nationkey <> 3"), "n_nationkey"), "label_document": (t("labels"), "doc_id", t("documents", "doc_id % 4 <> 0"), "doc_id"),
    })


def _bundles(s: SparkSession, d: str) -> DataFrame:
    actions = table(s, d, "orders", "o_orderkey", "o_custkey").select(_k().alias("action_id"), F.col("o_custkey").alias("intent_id"))
    intents = table(s, d, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("intent_id"), F.col("c_mktsegment").alias("intent"))
    spans = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").where("l_linenumber <= 3 and l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("action_id"), F.col("l_linenumber").alias("span_id"), F.col("l_suppkey").alias("policy_id"))
    return ev.audit_bundles(actions, intents, spans)


def _proxies(s: SparkSession, d: str) -> DataFrame:
    views = table(s, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_nationkey") % 3 == 0, "CN").when(F.col("c_nationkey") % 3 == 1, "US").otherwise("HK").alias("market"))
    rows = [("BUILDING", "CN", "B-CN"), ("BUILDING", None, "B"), ("MACHINERY", "US", "M-US"), ("FURNITURE", None, "F")]
    return ev.sector_proxy(views, s.createDataFrame(rows, "sector string, market string, symbol string"))


def _accounts(s: SparkSession, d: str) -> DataFrame:
    profiles = table(s, d, "supplier", "s_suppkey").select(F.concat(F.lit("c"), (F.col("s_suppkey") % 40).cast("string")).alias("creator_id"), F.array(F.struct(F.lit("web").alias("platform"), F.concat(F.lit("User"), (F.col("s_suppkey") % 40).cast("string")).alias("account")), F.struct(F.lit("chat").alias("platform"), F.concat(F.lit("u"), (F.col("s_suppkey") % 40).cast("string")).alias("account"))).alias("accounts"))
    posts = table(s, d, "events", "event_id", "user_id").select(F.col("event_id").alias("post_id"), F.when(F.col("event_id") % 2 == 0, "web").otherwise("chat").alias("platform"), F.concat(F.when(F.col("event_id") % 2 == 0, "USER").otherwise("U"), (F.col("user_id") % 60).cast("string")).alias("account"))
    return ev.account_identity(posts, profiles)


def _stops(s: SparkSession, d: str) -> DataFrame:
    views = table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").select(_k().alias("view_id"), (F.col("o_custkey") % 20).alias("kol"), F.when(_k() % 4 != 0, F.col("o_totalprice")).alias("stop_loss"))
    checks = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("view_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("validation_id"), F.col("l_shipdate").alias("at"), (F.col("l_quantity") > 25).alias("hit"))
    # of one day's checks the last key decides, then the smaller quantity
    return ev.first_validations(views, checks.groupBy("view_id", "at", "validation_id").agg(F.min("hit").alias("hit")))


def _subtitles(s: SparkSession, d: str) -> DataFrame:
    n = (_k() % 50).cast("string")
    body = F.concat(F.lit("1\r\n00:00:"), F.lpad(n, 2, "0"), F.lit(",500 --> 00:01:"), F.lpad(n, 2, "0"), F.lit(",250\r\nhello "), n, F.lit("\r\nagain\r\n\r\n2\r\n01:00:00.000 --> 01:00:01.000\r\n \r\n\r\n3\r\n02:00:00,001 --> 02:00:02,000\r\nlast"))
    return ev.subtitle_segments(table(s, d, "orders", "o_orderkey").select(_k().alias("id"), body.alias("content")))


def _chats(s: SparkSession, d: str) -> DataFrame:
    n = (_k() % 100).cast("string")
    text = F.concat(F.lit("title\n### Ann Lee 2024-01-02 09:30\nfirst "), n, F.lit("\nmore\n### Bob 2024-01-02 09:31\n### not a head\nsecond"))
    return ev.chat_messages(table(s, d, "orders", "o_orderkey").select(_k().alias("id"), text.alias("content")))


#: What the codes of parts become: shares of four venues, coins and names that only look like them.
_SUFFIXES = (".hk", ".SZ", ".ss", ".SH", "", " ", ".N", "X")
_COINS = ("BTC-USD", "eth", "SOLUSDT", "DOGE/USD", "BTCX", "ETHER")


def _codes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.lpad(k.cast("string"), 6, "6")).when(k % 3 == 1, F.element_at(F.array(*map(F.lit, _COINS)), (k % 6 + 1).cast("int"))).otherwise(F.substring("p_name", 1, 4))
    return table(s, d, "part", "p_partkey", "p_name").select("p_partkey", F.concat(code, F.element_at(F.array(*map(F.lit, _SUFFIXES)), (k % 8 + 1).cast("int"))).alias("ticker"))


_ROUTES_SQL = f"""with c as (select p_partkey, case p_partkey % 3 when 0 then lpad(cast(p_partkey as varchar), 6, '6') when 1 then {list(_COINS)}[p_partkey % 6 + 1] else left(p_name, 4) end || {list(_SUFFIXES)}[p_partkey % 8 + 1] as ticker from part),
    t as (select *, upper(trim(ticker)) as u from c) select p_partkey, ticker, case when u like '%.HK' then 'hk' when right(u, 3) in ('.SH', '.SZ', '.SS') or length(u) = 6 and translate(u, '0123456789', '') = '' then 'cn'
        when u in ({", ".join(f"'{c}{x}'" for c in ("BTC", "ETH", "SOL", "DOGE") for x in ("", "USD", "USDT", "-USD", "-USDT", "/USD", "/USDT", "-", "/"))}) then 'crypto' else 'us' end as provider from t"""


_register("reward_scores", lambda s, d: ev.reward_scores(_extractions(s, d)), _REWARD_SQL)
_register("reference_match", lambda s, d: ev.reference_match(_golds(s, d)), "with p as (select l_orderkey as id, l_orderkey % 3 as a, l_partkey % 3 as g, l_orderkey % 4 = l_partkey % 4 as t from lineitem) select id, max(cast(a = g as integer) + cast(t as integer) + cast((a < 2) = (g < 2) as integer)) as score from p group by 1")
_register("price_checks", lambda s, d: ev.price_checks(_priced(s, d)), "with p as (select p_partkey as id, p_size * 1.0::double as price, p_partkey % 60 as lo, p_partkey % 90 as hi, p_partkey % 3 as k, (p_size - 5.0::double) / 40 as share from part) select id, case when share < 0.1::double then 'near_52wk_low' when share > 0.9::double then 'near_52wk_high' else 'in_range' end as position, array_to_string(list_filter([case when lo >= hi then 'inverted_range' end, case when k = 0 and lo <= price then 'long_target_below_price' end, case when k = 1 and hi >= price then 'short_target_above_price' end, case when hi > 67.5 then 'far_above_range' end, case when lo < 2.5 then 'far_below_range' end], lambda e: e is not null), ',') as warnings from p")
_register("full_metrics", lambda s, d: ev.full_metrics(bt.daily_totals(b.trades(s, d))), f"""{_WITH}, {base._TOTALS}, p as (select *, max(total) over (partition by kol order by day) as peak, row_number() over (partition by kol order by day) as no from totals),
  r as (select *, case when no > 1 then pnl / total end as r from p),
  e as (select kol, cast(max(day) - min(day) as integer) as days, arg_max(total, day) / 1000000.0::double - 1 as tr, stddev_samp(r) as sd, count(*) filter (r < 0) as nd, stddev_samp(r) filter (r < 0) as dn, max(1 - total / peak) as dd from r group by 1),
  m as (select *, case when days >= 365 then pow(1 + tr, 1.0::double / (days / 365.25::double)) - 1 else tr end as an, coalesce(sd * sqrt(252.0::double), 0) as vol from e), q as (select *, case when nd > 1 then dn * sqrt(252.0::double) else vol end as down from m)
  select kol, days, round(tr, 6) as total_return, round(an, 6) as annualized, round(vol, 6) as volatility, round(case when vol > 0 then an / vol else 0 end, 4) as sharpe, round(case when down > 0 then an / down else 0 end, 4) as sortino, round(case when dd > 0 then an / dd else 0 end, 4) as calmar, round(dd, 6) as max_drawdown from q""")
_register("annotation_quality", _quality, "with a as (select doc_id + case when doc_id % 10 = 1 then 10000000 else 0 end as id, doc_id % 7 <> 0 as labelled from documents where doc_id % 3 <> 0) select (select count(*) from documents) as sources, count(*) filter (id in (select doc_id from documents)) as done, count(*) filter (id not in (select doc_id from documents)) as dangling, count(*) filter (not labelled) as incomplete, count(*) filter (id in (select doc_id from documents where doc_id % 4 = 0)) as overlap from a")
_register("model_report", lambda s, d: ev.model_report(_runs(s, d)), "with r as (select event_type as model, user_id % 40 as c, event_id % 3 as answer, row_number() over (partition by event_type, user_id % 40 order by event_id) as n from events), t as (select model, c, min(answer) = max(answer) as same from r where n <= 2 group by 1, 2 having count(*) = 2), s as (select model, round(count(*) filter (same) / count(*), 4) as determinism from t group by 1), e as (select event_type as model, count(*) as runs, round(avg(value), 3) as latency, round(count(*) filter (event_id % 5 > 1) / count(*), 4) as grounded from events group by 1) select e.*, determinism from e left join s using (model)")
_register("number_recall", _numbers, "select o_orderkey as id, cast(3 as integer) as gold, cast(cast(o_orderkey % 500 = o_orderkey % 1000 as integer) + 1 + cast(o_orderkey % 5 = o_orderkey % 7 as integer) as integer) as found from orders")
_register("confidence_buckets", lambda s, d: ev.confidence_buckets(b.actions(s, d).select("confidence", (F.col("status") == "verified").alias("accepted"))), f"{_WITH} select case when confidence >= 0.9::double then 'high' when confidence >= 0.7::double then 'medium' else 'low' end as bucket, count(*) as n, round(count(*) filter (status = 'verified') / count(*), 4) as precision from actions group by 1")
_register("asset_index_rebuild", _assets, "select o_orderkey as content_id, l_linenumber as stage, case l_returnflag when 'R' then 'ready' else 'partial' end as status, o_orderpriority as title, c_name as source_name, n_name as group_name from orders join lineitem on l_orderkey = o_orderkey left join (select * from customer where c_custkey % 9 <> 0) on c_custkey = o_custkey left join (select * from nation where n_nationkey % 4 <> 0) on n_nationkey = c_nationkey where l_returnflag in ('R', 'A')")
_register("missing_keys", _missing, "select 'order_customer' as \"check\", count(*) as missing from orders where o_custkey % 8 = 0 union all select 'line_order', count(*) from lineitem where l_orderkey % 6 = 0 or l_orderkey not in (select o_orderkey from orders) union all select 'line_part', count(*) from lineitem where l_partkey % 5 = 0 or l_partkey not in (select p_partkey from part) union all select 'customer_nation', count(*) from customer where c_nationkey = 3 union all select 'label_document', count(*) from labels where doc_id % 4 = 0 or doc_id not in (select doc_id from documents)")
_register("audit_bundles", _bundles, "with s as (select l_orderkey, string_agg(l_linenumber || ':' || l_suppkey, ',' order by l_linenumber, l_suppkey) as spans from lineitem where l_linenumber <= 3 and l_orderkey % 2 = 0 group by 1) select o_orderkey as action_id, o_custkey as intent_id, c_mktsegment as intent, coalesce(spans, '') as spans from orders left join (select * from customer where c_custkey % 3 <> 0) on c_custkey = o_custkey left join s on l_orderkey = o_orderkey")
_register("sector_proxy", _proxies, "select c_custkey as id, c_mktsegment as sector, case c_nationkey % 3 when 0 then 'CN' when 1 then 'US' else 'HK' end as market, case when c_mktsegment = 'BUILDING' then case when c_nationkey % 3 = 0 then 'B-CN' else 'B' end when c_mktsegment = 'MACHINERY' and c_nationkey % 3 = 1 then 'M-US' when c_mktsegment = 'FURNITURE' then 'F' end as symbol from customer")
_register("account_identity", _accounts, "with k as (select distinct s_suppkey % 40 as k from supplier) select event_id as post_id, case when k is not null then 'c' || k end as creator_id from events left join k on k = user_id % 60")
_register("stop_loss_quality", _stops, "with c as (select l_orderkey, l_shipdate as t, l_linenumber * 1000000 + l_partkey as v, min(l_quantity > 25) as hit from lineitem where l_orderkey % 3 <> 0 group by 1, 2, 3), f as (select l_orderkey, arg_min(hit, (t, v)) as hit from c group by 1) select o_custkey % 20 as kol, count(*) as views, count(hit) as validated, count(*) filter (hit) as hits from orders left join f on l_orderkey = o_orderkey where o_orderkey % 4 <> 0 group by 1")
_register("price_routes", lambda s, d: ev.price_routes(_codes(s, d), "ticker"), _ROUTES_SQL)
_register("subtitle_segments", _subtitles, "select o_orderkey as id, cast(n as integer) as n, case when n = 0 then o_orderkey % 50 + 0.5::double else 7200.001::double end as start, case when n = 0 then 60 + o_orderkey % 50 + 0.25::double else 7202.0::double end as \"end\", case when n = 0 then 'hello ' || (o_orderkey % 50) || ' again' else 'last' end as text from orders, (values (0), (2)) v(n)")
_register("chat_messages", _chats, "with k as (select o_orderkey as id, o_orderkey % 100 as n, length(cast(o_orderkey % 100 as varchar)) as w from orders) select id, cast(6 as integer) as start, cast(47 + w as integer) as \"end\", 'Ann Lee' as name, '2024-01-02 09:30' as sent_at, 'first ' || n || chr(10) || 'more' as body from k union all select id, cast(47 + w as integer), cast(93 + w as integer), 'Bob', '2024-01-02 09:31', '### not a head' || chr(10) || 'second' from k")
_register("perf_percentiles", lambda s, d: ev.exact_percentiles(table(s, d, "events", "event_type", "value"), "event_type", "value"), "select event_type, count(*) as n, min(value) as least, max(value) as most, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99 from events group by 1")
