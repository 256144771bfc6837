"""Registered queries of grounding, composition, reports, sentences and gaps, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import composition as cp
from opineflow.operators import gaps as gp
from opineflow.operators import tickers as tk
from opineflow.plans import queries as base
from opineflow.plans import rules as rl
from opineflow.sources.tables import table

_register, _q, _pick, _pick_sql = base._register, rl._q, rl._pick, rl._pick_sql

SYMBOLS = ("9992.HK", "TSLA", "", "OPT", "MADEUP_1", "300750.SZ", "ES", "NOPE")
TYPES = ("stock", "company", "sector", "index")
HINTS = ("open_position", "add_position", "reduce_position", "watch_only", "hold_position", "avoid_or_watch_risk", "sell_all", "close_position")
STANCES = ("bullish", "bearish", "mixed", "risk_warning")
PROXIES = (("OPT", "CN", "515880.SH", "通信"), ("ES", None, "159566.SZ", "储能"), ("OPT", None, "512480.SH", "半导体"))


def _parts(s: SparkSession, d: str) -> dict[str, DataFrame]:
    lines = rl._lines(s, d)
    at, i, c = F.col("content_id") + F.col("order_index"), F.col("order_index"), F.col("content_id")
    here = lines.withColumn("content_id", F.col("content_id").cast("string"))
    spans = lines.where((i % 3 == 0) & (c % 5 != 0)).select(c.cast("string").alias("content_id"), F.concat(F.lit("s"), "block_id").alias("span_id"), "block_id", (i % 7).cast("int").alias("start"), (i % 7 + 3).cast("int").alias("end"), F.lit("mention").alias("text"))
    docs = table(s, d, "documents", "doc_id").where("doc_id % 4 <> 0").select(F.col("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    span = lambda n: F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("place") * 2 + n).cast("string"))
    anchors = docs.select(F.col("doc_id").cast("string").alias("content_id"), "place", _pick(SYMBOLS, F.col("doc_id") + F.col("place")).alias("symbol"), F.array(span(1), span(0)).alias("span_ids"))
    intents = lines.where(i % 2 == 0).select(
        F.col("block_id").alias("intent_id"), c.cast("string").alias("content_id"), F.when(at % 11 == 0, "").otherwise("name").alias("target"), _pick(TYPES, at * 3).alias("target_type"), _pick(SYMBOLS, at * 5).alias("symbol"),
        F.when(at % 3 == 0, "CN").when(at % 3 == 1, "HK").alias("market"), _pick(STANCES, at * 7).alias("direction"), F.array(F.col("block_id"), F.concat_ws("-", c, i + 1)).alias("block_ids"),
    )
    mapped = lines.where(i % 2 == 0).select(
        F.concat(F.lit("p"), "block_id").alias("policy_id"), F.when(at % 13 == 0, "gone").otherwise(F.col("block_id")).alias("intent_id"), _pick(HINTS, c * 3 + i).alias("hint"), _pick(("none", "small", "medium", "large"), at).alias("sizing"), F.lit("short_term").alias("holding"), (at % 2 == 0).alias("review"),
    )
    proxies = s.createDataFrame(list(PROXIES), "sector string, market string, symbol string, name string")
    return {"blocks": here.select("content_id", "block_id", "text"), "spans": spans, "anchors": anchors, "intents": intents, "mapped": mapped, "proxies": proxies}


_PARTS = f"""{rl._LINES}, spans as (select content_id, 's' || block_id as span_id, block_id, order_index % 7 as start, order_index % 7 + 3 as stop, 'mention' as own, text from b where order_index % 3 = 0 and content_id % 5 <> 0),
    anchors as (select doc_id as content_id, p.place, {_pick_sql(SYMBOLS, "doc_id + place")} as symbol, unnest(['s' || doc_id || '-' || (place * 2 + 1), 's' || doc_id || '-' || (place * 2)]) as span_id, unnest([0, 1]) as pos from documents, range(0, 4) p(place) where doc_id % 4 <> 0),
    n as (select *, content_id + order_index as k from b where order_index % 2 = 0),
    intents as (select block_id as intent_id, content_id, case when k % 11 = 0 then '' else 'name' end as target, {_pick_sql(TYPES, "k * 3")} as target_type, {_pick_sql(SYMBOLS, "k * 5")} as symbol, case k % 3 when 0 then 'CN' when 1 then 'HK' end as market, {_pick_sql(STANCES, "k * 7")} as direction, block_id as b1, content_id || '-' || (order_index + 1) as b2 from n),
    mapped as (select 'p' || block_id as policy_id, case when k % 13 = 0 then 'gone' else block_id end as intent_id, {_pick_sql(HINTS, "content_id * 3 + order_index")} as hint, {_pick_sql(("none", "small", "medium", "large"), "k")} as sizing, k % 2 = 0 as review from n),
    g1 as (select i.intent_id, a.span_id, min((a.place, a.pos)) as o from intents i join anchors a on a.content_id = i.content_id and a.symbol = i.symbol and a.symbol <> '' join spans s on s.content_id = a.content_id and s.span_id = a.span_id group by 1, 2),
    g2 as (select i.intent_id, s.span_id, min((case when s.block_id = i.b1 then 0 else 1 end, 0)) as o from intents i join spans s on s.content_id = i.content_id and s.block_id in (i.b1, i.b2) group by 1, 2),
    g as (select *, 'symbol' as how from g1 union all select *, 'block' from g2 where intent_id not in (select intent_id from g1)),
    ground as (select intent_id, string_agg(span_id, ',' order by o, span_id) as evidence_ids, any_value(how) as grounded_by from g group by 1),
    w as (select span_id, content_id, trim(regexp_replace(coalesce(nullif(trim(regexp_replace(regexp_extract(substr(text, 1, s), '[^。！？；\\n]*$') || substr(text, s + 1, e - s) || regexp_extract(substr(text, e + 1, 120), '^[^。！？；\\n]*[。！？；\\n]?'), '^\\s+|\\s+$', '', 'g')), ''), own), '\\s+', ' ', 'g'), '|- ') as snippet
        from (select *, least(start, length(text)) as s, greatest(least(start, length(text)), least(stop, length(text))) as e from spans))"""


def _composed(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    out = cp.compose_actions(p["mapped"], p["intents"], p["proxies"], p["anchors"], p["spans"], p["blocks"], ("NOPE",))
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def _composed_sql() -> str:
    lists = lambda pairs: " ".join(f"when {_q(k)} then {_q(v)}" for k, v in pairs.items())
    proxies = ", ".join(f"({_q(a)}, {_q(b) if b else 'null'}, {_q(c)})" for a, b, c, _ in PROXIES)
    return f"""with {_PARTS}, px(sector, market, symbol) as (values {proxies}),
    j as (select m.*, i.intent_id is not null as found, i.content_id, i.target, i.target_type, i.symbol, i.market, i.direction, coalesce(o.symbol, f.symbol) as to_symbol, case when o.symbol is not null then o.market when f.symbol is not null then 'CN' end as to_market,
        coalesce(ground.evidence_ids, '') as evidence_ids, ground.grounded_by, i.content_id in (select content_id from spans) as anchored
        from mapped m left join intents i using (intent_id) left join px o on i.target_type = 'sector' and o.sector = i.symbol and o.market = i.market left join px f on i.target_type = 'sector' and f.sector = i.symbol and f.market is null left join ground using (intent_id)),
    r as (select *, case when hint = 'sell_all' then 'non_executable_action_hint' when not found then 'intent_not_found' when symbol = '' and target = '' then 'no_ticker_symbol' when target_type = 'sector' and to_symbol is null then 'sector_proxy_not_configured' when symbol = '' then 'unresolved_target_symbol'
        when target_type <> 'sector' and symbol <> 'NOPE' and not regexp_matches(symbol, '^([0-9]{{4,6}}\\.(HK|SH|SZ)|[A-Z]{{1,5}})$') then 'pseudo_ticker_symbol' when anchored and evidence_ids = '' then 'evidence_not_grounded' end as reason from j),
    t as (select policy_id, snippet, min(pos) as pos from (select policy_id, content_id, unnest(string_split(evidence_ids, ',')) as span_id, generate_subscripts(string_split(evidence_ids, ','), 1) as pos from r where reason is null and evidence_ids <> '') join w using (content_id, span_id) where snippet <> '' group by 1, 2),
    u as (select policy_id, left(string_agg(snippet, ' | ' order by pos), 500) as evidence_text from (select * from t qualify row_number() over (partition by policy_id order by pos) <= 3) group by 1)
    select policy_id, intent_id, hint, reason, case when reason is null then coalesce(to_symbol, symbol) end as ticker, case when reason is null then coalesce(to_market, market, 'CN') end as market,
        case when reason is null then case when to_symbol is not null then 'etf' else case target_type {lists(cp.INSTRUMENTS)} else 'unspecified' end end end as instrument, case when reason is null then case hint {lists({**cp.TRADES, **cp.OPINIONS})} end end as action,
        case when reason is null then case when hint in ('close_position', 'reduce_position') then 'bearish' when hint = 'hold_position' then 'neutral' when direction in ('bullish', 'bearish', 'neutral', 'watchlist', 'risk_warning') then direction else 'neutral' end end as direction,
        case when reason is null then case sizing when 'small' then 0.05::double when 'medium' then 0.1::double when 'large' then 0.2::double end end as position_pct, case when reason is null then 'short_term' end as time_horizon,
        case when reason is null then case when hint in ('watch_only', 'watch_or_no_trade', 'avoid_or_watch_risk') then 'opinion' else 'trade' end end as tier, case when reason is null then review end as review,
        case when reason is null then evidence_ids end as evidence_ids, case when reason is null then grounded_by end as grounded_by, case when reason is null then coalesce(evidence_text, '') end as evidence_text from r left join u using (policy_id)"""


def _grounded(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    rows = cp.grounded(p["intents"].select("content_id", "intent_id", "symbol", "block_ids"), p["anchors"], p["spans"])
    return rows.select("intent_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), "grounded_by")


def _windows(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    return cp.sentence_windows(p["spans"], p["blocks"]).select("span_id", "snippet")


_register("sentence_windows", _windows, f"with {_PARTS} select span_id, snippet from w")
_register("grounded_intents", _grounded, f"with {_PARTS} select i.intent_id, coalesce(evidence_ids, '') as evidence_ids, grounded_by from intents i left join ground using (intent_id)")
_register("compose_actions", _composed, _composed_sql())

RATINGS = ("Buy", "Not-Rated", "hold", "superb", "", "Under-Weight", "增持", "OUTPERFORM", "unrated", "equal_weight")
CODES = ("", "700.hk", "TSLA ", "", "600519")
SPELLINGS = ("TCEHY/0700.HK", "", " / ", "tsla", "BABA/9988.HK/BABA.N", "600519.SS")


def _reports(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    reports = o.select(
        k.cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("content_id"), _pick(CODES, k).alias("stock_code"), _pick(SPELLINGS, k).alias("ticker"), F.when(k % 3 == 0, " Co ").otherwise("").alias("company"), _pick(RATINGS, k * 3).alias("rating"), _pick(RATINGS, k).alias("rating_prior"),
        F.when(k % 2 == 0, "upgrade").alias("rating_action"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("target_price"), F.when(k % 4 == 0, "EUR").alias("currency"), F.when(k % 5 > 0, (k % 9).cast("double")).alias("horizon_months"), F.col("o_orderdate").cast("date").alias("day"),
    )
    c = table(s, d, "customer", "c_custkey")
    each = c.select(F.col("c_custkey"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    name = lambda kind: F.concat(F.lit(kind), F.col("c_custkey").cast("string"), F.lit("-"), F.col("place").cast("string"))
    anchors = each.select(F.col("c_custkey").cast("string").alias("content_id"), "place", _pick(("0700.hk", "TCEHY", " tsla", "600519", "BABA"), F.col("c_custkey") + F.col("place")).alias("symbol"), F.when(F.col("place") > 0, name("t")).alias("span_id"), F.array(F.struct(name("b").alias("block_id"), name("s").alias("span_id"))).alias("occurrences"))
    out = cp.report_intents(reports, anchors)
    return out.withColumns({"block_ids": F.array_join("block_ids", ","), "span_ids": F.array_join("span_ids", ",")})


def _report_sql() -> str:
    words = lambda values: ", ".join(map(_q, values))
    token = lambda c: f"nullif(trim(regexp_replace(regexp_replace(lower({c}), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')), '')"
    stance = lambda c: f"case when {token(c)} in ({words(tk.BULLISH)}) then 'bullish' when {token(c)} in ({words(tk.NEUTRAL)}) then 'neutral' when {token(c)} in ({words(tk.BEARISH)}) then 'bearish' end"
    market = "case when target like '%.HK' then 'HK' when regexp_matches(target, '\\.(SZ|SS)$|^[0-9]{6}$') then 'CN' else 'US' end"
    return f"""with o as (select o_orderkey as k, cast(o_orderkey as varchar) as report_id, cast(o_custkey as varchar) as content_id, {_pick_sql(CODES, "o_orderkey")} as code, {_pick_sql(SPELLINGS, "o_orderkey")} as ticker, {_pick_sql(RATINGS, "o_orderkey * 3")} as rating, {_pick_sql(RATINGS, "o_orderkey")} as prior, o_totalprice, cast(o_orderdate as date) as day from orders),
    p as (select *, upper(trim(code)) as up, list_filter(list_transform(string_split(ticker, '/'), lambda x: upper(trim(x))), lambda x: x <> '') as parts from o),
    t as (select *, coalesce(nullif(up, ''), list_filter(parts, lambda x: contains(x, '.'))[-1], parts[1]) as target, list_filter(list_prepend(up, parts), lambda x: x <> '') as segments from p),
    s as (select *, case when {token("rating")} is null then 'no_rating' when {token("rating")} in ({words(cp.NOT_RATED)}) then 'not_rated' when {stance("rating")} is null then 'unmapped_rating' when target is null then 'no_ticker' end as skip from t),
    a as (select cast(c_custkey as varchar) as content_id, q.place, upper(trim({_pick_sql(("0700.hk", "TCEHY", " tsla", "600519", "BABA"), "c_custkey + place")})) as symbol, c_custkey || '-' || place as n from customer, range(0, 3) q(place)),
    l as (select report_id, string_agg('b' || n, ',' order by place) as block_ids, string_agg('s' || n || case when place > 0 then ',t' || n else '' end, ',' order by place) as span_ids from s join a on a.content_id = s.content_id and (a.symbol = target or list_contains(segments, a.symbol) and list_contains(segments, target)) group by 1)
    select s.report_id, skip, case when skip is null then 'bri_' || left(sha1(content_id || '|' || target || '|' || rating || '|' || day), 24) end as intent_id, case when skip is null then s.target end as symbol, case when skip is null then case when k % 3 = 0 then 'Co' else s.target end end as target,
        case when skip is null then {market} end as market, case when skip is null then {stance("rating")} end as direction, case when skip is null then case when {token("rating")} in ({words(tk.STRONG)}) then 0.7::double when {token("rating")} in ({words(tk.TILT)}) then 0.6::double else 0.4::double end end as conviction,
        case when skip is null then case when k % 2 = 0 then 'upgrade' else 'unknown' end end as rating_action, case when skip is null then {stance("prior")} end as prior_direction, case when skip is null and k % 2 = 0 then o_totalprice end as target_price,
        case when skip is null and k % 2 = 0 then case when k % 4 = 0 then 'EUR' when {market} = 'HK' then 'HKD' when {market} = 'CN' then 'CNY' else 'USD' end end as currency, case when skip is null then k % 2 = 0 and k % 4 <> 0 end as currency_inferred,
        case when skip is null then case when k % 5 = 0 then 'long_term' when k % 9 <= 2 then 'short_term' when k % 9 <= 6 then 'medium_term' else 'long_term' end end as horizon, case when skip is null then coalesce(block_ids, '') end as block_ids, case when skip is null then coalesce(span_ids, '') end as span_ids
    from s left join l using (report_id)"""


_register("report_intents", _reports, _report_sql())

NAMES = ("曹操出行很好", "NVDA beats", "AB.CD rises", "我们买了速腾聚创科技", "", "K5 CAGR5", "关税", "公司 QCOM", "其他机器人企业", "市值 BYD.HK 与比亚迪电子今天", "银行", "TSMC, ASML, QCOM, INTC, MRVL, ARM", "港股新能源汽车股份控股集团")
NOISE = gp.Noise(tokens=("THE", "AND", "OF", "TO", "DE", "PDF"), prefixes=("其他",), parts=("净利润",), suffixes=("企业",))


def _gap_parts(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    lines = docs.select(F.col("doc_id").alias("content_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "body"))
    blocks = lines.select("content_id", F.concat_ws("-", "content_id", "i").alias("block_id"), "i", F.concat("body", F.lit(" "), _pick(NAMES, F.col("content_id") * 5 + F.col("i"))).alias("text"))
    anchored = ((F.col("content_id") % 5 == 0) & (F.col("i") % 6 == 0)) | ((F.col("content_id") % 5 == 1) & (F.col("i") % 2 == 0))
    return gp.gap_candidates(blocks.select("content_id", "block_id", "text"), blocks.where(anchored).select("content_id", "block_id"), NOISE)


def _gap_sql() -> str:
    has = lambda c, words: "(" + " or ".join(f"contains({c}, {_q(w)})" for w in words) + ")"
    name = "x"
    for word in gp.FILLERS:
        name = f"replace({name}, {_q(word)}, '')"
    ends = ", ".join(f"case when contains(name, {_q(c)}) then length(name) - strpos(reverse(name), {_q(c[::-1])}) + 1 else 0 end" for c in gp.SUFFIX_CUES)
    lead = " or ".join(f"starts_with(alias, {_q(p)})" for p in NOISE.prefixes)
    tail = " or ".join(f"ends_with(alias, {_q(p)})" for p in NOISE.suffixes)
    return f"""l as (select doc_id as content_id, unnest(string_split(coalesce(text, ''), chr(10))) as body, unnest(range(0, length(string_split(coalesce(text, ''), chr(10))))) as i from documents),
    b as (select content_id, content_id || '-' || i as block_id, body || ' ' || {_pick_sql(NAMES, "content_id * 5 + i")} as text, content_id % 5 = 0 and i % 6 = 0 or content_id % 5 = 1 and i % 2 = 0 as hit from l),
    c as (select content_id, count(*) as n, count(*) filter (hit) as hits, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as chars, bool_or({has("text", gp.ELSEWHERE)}) as elsewhere from b group by 1),
    y as (select content_id, case when hits = 0 then case when chars >= 40 and not elsewhere then 'zero_anchor' end when hits / n < 0.2 then 'low_hit_rate' end as reason from c),
    s as (select b.content_id, block_id, text, reason from b join y using (content_id) where not hit and reason is not null and (reason = 'zero_anchor' or {has("text", gp.MONEY)})),
    p as (select block_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') as q from s), k as (select block_id, q, unnest(range(1, len(q) + 1)) as i from p),
    u as (select block_id, i, case when q[i + 1] = '.' and regexp_full_match(coalesce(q[i + 2], ''), '[A-Z]{{1,4}}') then q[i] || '.' || q[i + 2] else q[i] end as alias from k
        where regexp_full_match(q[i], '[A-Z][A-Z0-9]{{1,4}}') and not (i > 2 and coalesce(q[i - 1] = '.', false) and regexp_full_match(q[i], '[A-Z]{{1,4}}') and regexp_full_match(coalesce(q[i - 2], ''), '[A-Z][A-Z0-9]{{1,4}}'))),
    v as (select block_id, alias, 'upper_token' as kind, 0 as side, min(i) as i from u where alias not in ({", ".join(map(_q, NOISE.tokens))}) and not starts_with(alias, 'CAGR') and not regexp_full_match(alias, '[A-Z][0-9]') group by 1, 2),
    z as (select block_id, unnest(regexp_extract_all(text, '[一-鿿]{{2,8}}')) as x, unnest(range(0, len(regexp_extract_all(text, '[一-鿿]{{2,8}}')))) as i from s), a as (select block_id, i, {name} as name from z), e as (select *, greatest({ends}) as stop from a),
    f as (select block_id, case when stop > 0 then left(name, stop) else name end as alias, 'cn_phrase' as kind, 1 as side, min(i) as i from e group by 1, 2),
    g as (select * from f where length(alias) >= 2 and alias not in ({", ".join(map(_q, gp.CUES))}) and not ({lead}) and not ({tail}) and not {has("alias", NOISE.parts)} and {has("alias", gp.CUES)}),
    h as (select * from (select * from v union all select * from g) qualify row_number() over (partition by block_id order by side, i) <= 5),
    cand as (select content_id, block_id, alias, kind, round(case when kind = 'upper_token' then least(0.8::double, 0.58::double + case when contains(alias, '.') then 0.12::double else 0 end + case when regexp_matches(alias, '[0-9]') then 0.08::double else 0 end)
        else 0.8::double + case when length(alias) <= 4 then 0.05::double else 0 end - case when length(alias) > 6 then 0.05::double else 0 end end, 2) as score, reason,
        regexp_replace(case when strpos(text, alias) = 0 then left(text, 64) else substr(text, greatest(strpos(text, alias) - 33, 0) + 1, least(strpos(text, alias) - 1, 32) + length(alias) + 32) end, '^\\s+|\\s+$', '', 'g') as snippet from h join s using (block_id))"""


_register("gap_candidates", _gap_parts, f"with {_gap_sql()} select * from cand")
_register(
    "gap_support",
    lambda s, d: gp.gap_support(_gap_parts(s, d), s.createDataFrame([("nvda",), ("速腾聚创科技",)], "alias string")).withColumn("examples", F.array_join(F.transform("examples", lambda e: F.concat_ws(":", e.block_id, e.reason)), ",")),
    f"""with {_gap_sql()} select alias, kind, max(score) as score, count(*) as blocks, count(distinct content_id) as contents, array_to_string((list(block_id || ':' || reason order by content_id, block_id))[1:3], ',') as examples from cand where lower(alias) not in ('nvda', '速腾聚创科技') group by 1, 2""",
)
