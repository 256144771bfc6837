"""Registered queries of creators' scores, quality cards and crowd sentiment, with their twins in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import scorers as so
from opineflow.plans import bindings as b
from opineflow.plans import queries as base
from opineflow.sources.tables import table

_WITH = base._WITH
_register = base._register
NOW = dt.datetime(2024, 4, 10, tzinfo=dt.UTC)
_TIES = ("l_orderkey", "l_linenumber", "ticker", "holding_days", "return_pct")


def _scored(s: SparkSession, d: str) -> DataFrame:
    k = F.col("kol")
    trades = b.trades(s, d).select(k.cast("long").alias("creator_id"), (F.col("return_pct") * (k % 4 + 1) + (k % 8 - 3) / F.lit(20.0)).alias("return_pct"), (F.col("holding_days") * (k % 3) / F.lit(2.0)).alias("holding_days"), "l_orderkey", "l_linenumber", "ticker", "exit")
    e = table(s, d, "events", "event_id", "user_id", "ts").where("user_id % 60 % 5 <> 0")
    reason = F.when(F.col("event_id") % 3 == 0, "why").when(F.col("event_id") % 3 == 1, "")
    opinions = e.select((F.col("user_id") % 60).alias("creator_id"), F.col("ts").alias("clock"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 100 / F.lit(100.0)).alias("confidence"), reason.alias("rationale"))
    return so.creator_scores(trades, opinions, NOW, "exit", _TIES)


_register("creator_scores", _scored, f"""{_WITH}, t as (select kol as creator_id, return_pct * (kol % 4 + 1) + (kol % 8 - 3) / 20.0::double as r, holding_days * (kol % 3) / 2.0::double as days, l_orderkey, l_linenumber, ticker, exit, holding_days, return_pct from trades),
  u as (select *, lag(r > 0) over (partition by creator_id order by exit, l_orderkey, l_linenumber, ticker, days, r) <> (r > 0) as swap from t),
  k as (select creator_id, count(*) as n, count(*) filter (r > 0) as wins, avg(r) as mean, case when min(r) = max(r) then 0 else stddev_pop(r) end as spread, avg(days) as days, count(*) filter (swap) as cost from u group by 1),
  o as (select user_id % 60 as creator_id, count(*) as said, count(*) filter (ts > timestamp '2024-01-11') as fresh, avg(case when event_id % 6 <> 0 then event_id % 100 / 100.0::double else 0.5::double end) as confidence, count(*) filter (event_id % 3 = 0) as reasoned from events where user_id % 60 % 5 <> 0 group by 1),
  j as (select coalesce(k.creator_id, o.creator_id) as creator_id, k.* exclude (creator_id), o.* exclude (creator_id), case when abs(mean) > 0.01 then spread / abs(mean) else 10 end as cv, mean / nullif(spread, 0) as sharpe from k full join o on k.creator_id = o.creator_id),
  s as (select creator_id, n, case when n is null then 2.5::double else wins / n * 5 end as accuracy,
    case when n is null then 2.5::double else case when days <= 5 then 5.0::double when days <= 15 then 5.0::double - (days - 5) * 0.2::double else greatest(1.0::double, 3.0::double - (days - 15) * 0.1::double) end * coalesce(0.7::double + 0.3::double * fresh / said, 1.0::double) end as timeliness,
    case when mean * 100 > 10 then 5.0::double when mean * 100 > 5 then 4.0::double when mean * 100 > 0 then 3.0::double when mean * 100 > -5 then 2.0::double else 1.0::double end as gain,
    case when cv < 1 then 5.0::double when cv < 2 then 4.0::double when cv < 3 then 3.0::double when cv < 5 then 2.0::double else 1.0::double end as steady, sharpe, n > 2 and cost / nullif(n - 1, 0) > 0.8 as swings,
    case when said is null then case when n >= 50 then 5.0::double when n >= 20 then 4.0::double when n >= 10 then 3.0::double else 2.0::double end else least(5.0::double, confidence * 5 + reasoned / said * 0.5::double) end as depth from j),
  f as (select creator_id, coalesce(n, 0) as n, accuracy, timeliness, case when n is null then 2.5::double when sharpe > 2 then least(5.0::double, gain + 0.5::double) when sharpe < 0 then greatest(1.0::double, gain - 0.5::double) else gain end as return_score,
    case when coalesce(n, 0) < 3 then 2.5::double when swings then greatest(1.0::double, steady - 1) else steady end as consistency, depth from s),
  w as (select *, 0.3::double * accuracy + 0.15::double * timeliness + 0.3::double * return_score + 0.15::double * consistency + 0.1::double * depth as whole from f)
  select creator_id, round(accuracy, 4) as accuracy, round(timeliness, 4) as timeliness, round(return_score, 4) as return_score, round(consistency, 4) as consistency, round(depth, 4) as depth, round(whole, 4) as overall,
    case when round(whole, 9) >= 4.5 then 'excellent' when round(whole, 9) >= 3.5 then 'good' when round(whole, 9) >= 2.5 then 'average' when round(whole, 9) >= 1.5 then 'below_average' else 'poor' end as grade, n from w""")  # fmt: skip


_PROSE = {"bullish": "calm", "bearish": "Volatile days", "neutral": "uncertain ground", "watchlist": "steady"}


def _rated(s: SparkSession, d: str) -> DataFrame:
    a = b.actions(s, d)
    k = F.col("action_id")
    prose = F.create_map(*[F.lit(x) for kv in _PROSE.items() for x in kv])
    views = a.select(F.concat("creator_id", F.lit("_"), (k % 9).cast("string")).alias("kol"), k.alias("view_id"), F.when(k % 8 != 0, F.col("ticker")).alias("ticker"), "direction", F.col("clock").alias("view_date"), F.when(k % 5 == 0, prose[F.col("direction")]).alias("rationale"))
    triggers = a.where(k % 2 == 0).select(k.alias("view_id"), F.when(k % 7 == 0, "below the STOP line").when(k % 11 == 0, "cut loss").when(k % 3 == 0, "price over 10").alias("trigger"))
    e = table(s, d, "events", "event_id", "value").where("event_id % 6 <> 0")
    checks = e.select(F.col("event_id").alias("view_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("validation_id"), F.col("value"))
    moved = F.round((F.col("value") - 50) / 8, 2) * F.when(F.col("validation_id") == 1, 1).otherwise(-1)
    checks = checks.select("view_id", "validation_id", F.when(F.col("view_id") % 10 != 1, F.col("value") > 50).alias("right_7d"), F.when(F.col("view_id") % 4 != 1, F.col("value") > 90).alias("right_30d"), moved.alias("return_7d"), F.when(F.col("view_id") % 5 != 2, moved / 2).alias("excess"))
    return so.creator_ratings(views, triggers, checks)


_register("creator_ratings", _rated, f"""{_WITH}, t as (select action_id as view_id, case when action_id % 2 = 0 then case when action_id % 7 = 0 then 'stop' when action_id % 11 = 0 then 'loss' end end is not null as stop from actions),
  v as (select creator_id || '_' || (action_id % 9) as kol, action_id as view_id, case when action_id % 8 <> 0 then ticker end as ticker, direction, clock, action_id % 5 = 0 and direction in ('bearish', 'neutral') as risky, stop from actions join t on view_id = action_id),
  c as (select event_id as view_id, i as validation_id, case when event_id % 10 <> 1 then value > 50 end as r7, case when event_id % 4 <> 1 then value > 90 end as r30, round((value - 50) / 8, 2) * case i when 1 then 1 else -1 end as ret from events, (values (1), (2)) x(i) where event_id % 6 <> 0),
  p as (select kol, count(*) as validated, sum(w * pts) / sum(w) as points, sum(early) as early from (select kol, case when direction in ('bullish', 'bearish') then 1.5::double else 1.0::double end as w, case when r7 then 100 else 0 end + case when r30 then 10 else 0 end + greatest(-20.0::double, least(20.0::double, 2 * case when c.view_id % 5 <> 2 then ret / 2 else 0 end)) as pts,
     case when direction = 'bullish' and ret > 5 then 1.0::double when direction = 'bearish' and ret < -5 then 1.0::double when direction = 'neutral' and abs(ret) < 3 then 0.5::double else 0.0::double end as early from c join v using (view_id) where r7 is not null) group by 1),
  m as (select kol, count(*) as timely from v join c using (view_id) where stop and validation_id = 1 and ret < -5 group by 1),
  z as (select kol, ticker, direction, lag(direction) over (partition by kol, ticker order by clock, view_id) as was from v where ticker is not null),
  y as (select kol, ticker, count(*) as n, sum(case when was is null or was = direction then 0 when was in ('bullish', 'bearish') and direction in ('bullish', 'bearish') then 10 when was = 'neutral' or direction = 'neutral' then 3 else 0 end) as cost from z group by 1, 2),
  x as (select kol, coalesce(avg(case when n > 1 then greatest(0.0::double, 1 - cost / 10 / (n - 1)) end) * 100, 100.0::double) as consistency from y group by 1),
  g as (select kol, count(*) as views, count(*) filter (stop) as stops, count(*) filter (direction = 'risk_warning') as warnings, count(*) filter (direction = 'risk_warning' or risky or stop) as aware from v group by 1),
  f as (select kol, views, coalesce(validated, 0) as validated, case when points is null then 0.0::double else greatest(0.0::double, least(100.0::double, points)) end as accuracy,
    case when stops = 0 then least(50.0::double, warnings * 5.0::double) else least(40.0::double, stops / views * 100) + coalesce(timely, 0) / stops * 60 end as stop_loss_quality, coalesce(consistency, 50.0::double) as consistency,
    case when validated is null then 50.0::double else least(100.0::double, early / validated * 150) end as market_sensitivity, least(100.0::double, aware / views * 80 + least(20, warnings * 5)) as risk_awareness from g left join p using (kol) left join m using (kol) left join x using (kol)),
  w as (select *, round(0.35::double * accuracy + 0.25::double * stop_loss_quality + 0.2::double * consistency + 0.1::double * market_sensitivity + 0.1::double * risk_awareness, 9) as whole from f)
  select kol, views, validated, round(accuracy, 3) as accuracy, round(stop_loss_quality, 3) as stop_loss_quality, round(consistency, 3) as consistency, round(market_sensitivity, 3) as market_sensitivity, round(risk_awareness, 3) as risk_awareness, round(whole, 2) as total,
    case when whole >= 90 then 5 when whole >= 75 then 4 when whole >= 60 then 3 when whole >= 40 then 2 else 1 end as stars, case when whole >= 90 then 'gold' when whole >= 75 then 'silver' when whole >= 60 then 'bronze' else 'none' end as medal from w""")  # fmt: skip


def _cards(s: SparkSession, d: str) -> DataFrame:
    """Cards of whole texts: shares of letters, length, figures, capitals, years, and labels as what can be traced."""
    docs = table(s, d, "documents", "doc_id", "text").join(table(s, d, "labels", "doc_id", "quality"), "doc_id", "left")
    n, count = F.char_length("text"), lambda p: F.regexp_count("text", F.lit(p))
    share = lambda x, y: F.coalesce(F.least(F.lit(1.0), F.try_divide(x, y)), F.lit(0.0))
    lines = count("\n") + 1
    return docs.select(
        "doc_id", share(count("[A-Za-z ]"), n).alias("readability"), share(n, F.lit(1000.0)).alias("semantic_completeness"), share(count("[0-9]"), lines * 2).alias("financial_relevance"),
        share(count("[A-Z]") * 20, n).alias("entity_resolution"), share(count("[0-9][0-9]"), lines).alias("temporal_resolution"), F.when(F.col("doc_id") % 50 != 0, F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.55).otherwise(0.65)).alias("evidence_traceability"),
    )


def _card_sql() -> str:
    count = lambda p: f"(length(coalesce(text, '')) - length(regexp_replace(text, '{p}', '', 'g')))"
    share = lambda x, y: f"coalesce(least(1.0::double, {x} / nullif({y}, 0)), 0.0::double)"
    lines = "(length(text) - length(replace(text, chr(10), '')) + 1)"
    return f"""c as (select doc_id, {share(count("[A-Za-z ]"), "length(text)")} as readability, {share("length(text)", "1000.0::double")} as semantic_completeness, {share(count("[0-9]"), lines + " * 2")} as financial_relevance,
    {share(count("[A-Z]") + " * 20", "length(text)")} as entity_resolution, {share(count("[0-9][0-9]") + " // 2", lines)} as temporal_resolution, case when doc_id % 50 <> 0 then case quality when 1 then 0.9::double when 0 then 0.55::double else 0.65::double end end as evidence_traceability from documents left join labels using (doc_id))"""


def _gate_sql() -> str:
    parts = []
    for name, p in so.POLICIES.items():
        reasons = [f"case when {c} < {p.critical}::double then '{c}:critical' end" for c in so.CARD[:2]]
        reasons.append(f"case when financial_relevance < {p.critical}::double then 'financial_relevance:critical' when financial_relevance < {p.financial}::double then 'financial_relevance:pass' end")
        reasons += [f"case when {c} < {p.warn}::double then '{c}:warning' end" for c in so.CARD[3:5]]
        reasons.append(f"case when evidence_traceability < {p.warn}::double then 'evidence_traceability:warning' when evidence_traceability < {p.evidence}::double then 'evidence_traceability:pass' end")
        critical = " + ".join(f"cast({c} < {p.critical}::double as integer)" for c in so.CARD[:3])
        parts.append(f"""select *, '{name}' as policy, concat_ws(',', {", ".join(reasons)}) as why, {critical} as critical, case when score < {p.reviews}::double and financial_relevance < {p.reject_financial}::double then 'reject'
          when score >= {p.passes}::double and financial_relevance >= {p.financial}::double and evidence_traceability >= {p.evidence}::double and {critical} = 0 then 'pass' else 'review' end as gate, readability < {p.warn}::double as unclear from s""")
    weakest = " ".join(f"when {c} = least({', '.join(so.CARD)}) then '{c}'" for c in so.CARD)
    return f"""with {_card_sql()}, s as (select *, round_even(({" + ".join(so.CARD)}) / 6 * 100, 0) / 100 as score from c), g as ({" union all ".join(parts)})
      select doc_id, policy, score, gate, case when score is null then 'incomplete' when gate = 'pass' then '' when why <> '' then why when gate = 'reject' then 'low_score_and_relevance' else 'below_pass' end as reasons,
        case when gate = 'reject' then 'drop' when gate = 'pass' then 'extract_intent' when unclear or critical > 0 then 'reprocess_source' else 'manual_review' end as next_step, critical, case when score is not null then case {weakest} end end as weakest from g"""


def _gates(s: SparkSession, d: str) -> DataFrame:
    cards, out = _cards(s, d), None
    for name, policy in so.POLICIES.items():
        one = so.gate_decisions(cards, policy).select("doc_id", F.lit(name).alias("policy"), "score", "gate", F.array_join("reasons", ",").alias("reasons"), "next_step", "critical", "weakest")
        out = one if out is None else out.unionByName(one)
    return out


_register("quality_card_gate", _gates, _gate_sql())


def _crowd(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    each = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        (of("click") / 40 - 1).alias("reddit"), of("view").alias("v"), F.round(of("purchase") / 50, 1).alias("news"), F.least(F.lit(1.0), of("error") / 100).alias("polymarket"),
        ((F.max_by("value", "event_id") - F.min_by("value", "event_id")) / 100).alias("velocity"), F.max("event_id").alias("last"),
    )
    each = each.withColumns({"twitter": F.col("v") / 200, "direction": F.element_at(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral"), F.lit("watchlist")), (F.col("last") % 4 + 1).cast("int"))})
    each = each.withColumn("velocity", F.when(F.col("velocity") != 0, F.col("velocity")))
    return so.direction_adjustments(so.crowd_sentiment(each)).select("user_id", "day", "score", "class", "extreme", "contrarian", "data_quality", "direction", "confidence_modifier", "reason")


_register("crowd_sentiment", _crowd, """with e as (select user_id, cast(ts as date) as day, avg(value) filter (event_type = 'click') / 40 - 1 as reddit, avg(value) filter (event_type = 'view') / 200 as twitter, round(avg(value) filter (event_type = 'purchase') / 50, 1) as news,
    least(1.0::double, avg(value) filter (event_type = 'error') / 100) as polymarket, (arg_max(value, event_id) - arg_min(value, event_id)) / 100 as velocity, max(event_id) as last from events group by 1, 2),
  n as (select *, case when reddit between 0 and 1 then (reddit - 0.5) * 2 else greatest(-1, least(1, reddit)) end as a, case when twitter between 0 and 1 then (twitter - 0.5) * 2 when twitter is not null then greatest(-1, least(1, twitter)) end as b,
    case when news between 0 and 1 then (news - 0.5) * 2 when news is not null then greatest(-1, least(1, news)) end as c, (polymarket - 0.5) * 2 as p, ['bullish', 'bearish', 'neutral', 'watchlist'][last % 4 + 1] as direction from e),
  t as (select *, case when reddit is null then 0 else 0.25 end + case when twitter is null then 0 else 0.25 end + case when news is null then 0 else 0.35 end + case when polymarket is null then 0 else 0.15 end as w,
    cast(reddit is not null as integer) + cast(twitter is not null as integer) + cast(news is not null as integer) + cast(polymarket is not null as integer) as sources from n),
  s as (select *, round(coalesce((coalesce(case when reddit is not null then a end * 0.25, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.35, 0) + coalesce(p * 0.15, 0)) / nullif(w, 0), 0), 9) as score from t),
  r as (select *, case direction when 'bullish' then score when 'bearish' then -score end as along, abs(score) > 0.7 as extreme from s)
  select user_id, day, score, case when score > 0.15 then 'bullish' when score < -0.15 then 'bearish' else 'neutral' end as class, extreme, (score > 0.7 and velocity > 0.3) or (score < -0.7 and velocity < -0.3) as contrarian,
    case when sources >= 3 then 'complete' when sources > 0 then 'partial' else 'unavailable' end as data_quality, direction,
    case when sources = 0 then 0.0::double when along > 0.7 then -0.2::double when along < -0.7 then 0.1::double when along < -0.3 then -0.1::double else 0.0::double end as confidence_modifier,
    case when sources = 0 then 'no_data' when along > 0.7 then 'with_extreme_crowd' when along < -0.7 then 'against_extreme_crowd' when along < -0.3 then 'against_crowd' when direction = 'neutral' and extreme then 'extreme_crowd' else '' end as reason from r""")  # fmt: skip
