"""Registered queries of anchors and creator bands, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import anchoring as an
from opineflow.operators import creators as cr
from opineflow.plans import queries as base
from opineflow.sources.tables import table

_WITH = base._WITH
_register = base._register

#: (phrase, day and exclusive end in SQL, confidence, rule) after the published day p; a null day is no date.
_PHRASES = (
    ("2024-02-30, 2024年3月5日", "date '2024-03-05'", "null", 1.0, "full_date"),
    ("4月31日, 4月30日", "date '2024-04-30'", "null", 0.9, "month_day_from_published_year"),
    ("下周三", "cast(date_trunc('week', p) as date) + 9", "null", 0.85, "relative_weekday_from_published_at"),
    ("昨天", "p - 1", "null", 0.85, "relative_day_from_published_at"),
    ("上周", "cast(date_trunc('week', p) as date) - 7", "cast(date_trunc('week', p) as date)", 0.8, "relative_week_from_published_at"),
    ("这个月", "cast(date_trunc('month', p) as date)", "cast(date_trunc('month', p) + interval 1 month as date)", 0.8, "relative_month_from_published_at"),
    ("10/15 CPI", "date '2024-10-15'", "null", 0.75, "numeric_month_day_with_event_cue"),
    ("10/15", "null", "null", 0.0, ""),
)
#: What of each phrase is the date itself.
_RAW = ("2024年3月5日", "4月30日", "下周三", "昨天", "上周", "这个月", "10/15", "10/15")


def _dated(s: SparkSession, d: str) -> DataFrame:
    n, phrases = len(_PHRASES), F.array(*[F.lit(p[0]) for p in _PHRASES])
    rows = table(s, d, "documents", "doc_id", "lang")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 300).cast("int"))
    return rows.select("doc_id", F.concat("lang", F.lit(": "), F.element_at(phrases, (F.col("doc_id") % n + 1).cast("int")), F.lit(" / "), "lang").alias("text"), day.alias("published_at"))


def _phrase_sql() -> str:
    rows = ", ".join(f"({i}, '{p[0]}', '{raw}', {p[3]}::double, '{p[4]}')" for i, (p, raw) in enumerate(zip(_PHRASES, _RAW)))
    days = " ".join(f"when {i} then {p[1]}" for i, p in enumerate(_PHRASES))
    ends = " ".join(f"when {i} then {p[2]}" for i, p in enumerate(_PHRASES))
    return f"""with f(k, phrase, raw, confidence, rule) as (values {rows}), t as (select doc_id, lang, doc_id % {len(_PHRASES)} as k, date '2024-01-01' + cast(doc_id % 300 as integer) as p from documents),
    s as (select t.doc_id, cast(length(lang) + 1 + strpos(phrase, raw) as integer) as start, raw, case k {days} end as day, case k {ends} end as end_day, confidence, rule from t join f using (k))
    select doc_id, start, cast(start + length(raw) as integer) as "end", raw, day, end_day, confidence, rule from s where day is not null"""


_register("temporal_spans", lambda s, d: an.temporal_spans(_dated(s, d), "doc_id", "text", "published_at"), _phrase_sql())
_register(
    "entity_spans",
    lambda s, d: an.entity_spans(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", list(base.REGISTRY.items())),
    f"""with t as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') as parts from documents),
    u as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from t),
    w as (select doc_id, part, sum(length(part)) over (partition by doc_id order by i) as last from u), r(alias, ticker) as (values {", ".join(f"('{k}', '{v}')" for k, v in base.REGISTRY.items())})
    select doc_id, alias, ticker, cast(last - length(alias) as integer) as start, cast(last as integer) as "end" from w join r on part = alias""",
)


def _band_sql(value: str, borders: tuple) -> str:
    return f"case when {value} is null then 3.0::double " + " ".join(f"when {value} > {x} then {5 - i}.0::double" for i, x in enumerate(borders)) + " else 1.0::double end"


_register(
    "creator_bands",
    lambda s, d: cr.creator_bands(base._results(s, d)),
    f"""{_WITH}, {base._OUTCOME}, q as (select creator_id, ticker, coalesce(return_pct, 0) as r, coalesce(holding_days, 10) as days, lag(direction) over w as b, direction, row_number() over w as i from results window w as (partition by creator_id, ticker order by clock, action_id)),
    c as (select creator_id, ticker, count(*) as n, count(*) filter (i > 1 and b is distinct from direction) as turns from q group by 1, 2), y as (select creator_id, avg(1 - turns / (n - 1)) as steady from c where n > 1 group by 1),
    k as (select creator_id, count(*) as n, avg(case when r > 0 then 1.0::double else 0 end) as hit, avg(greatest(0, 10 - days)) as lead, avg(r) as m, stddev_pop(r) as sd from q group by 1),
    z as (select k.*, case when n >= 3 then least(1.0::double, steady + case when n < 2 then 0 when abs(m) <= 0.01 then 0 when sd / abs(m) < 1 then 0.2 when sd / abs(m) < 2 then 0.1 else 0 end) end as st from k left join y using (creator_id)),
    v as (select creator_id, {_band_sql("hit", cr.ACCURACY)} as accuracy, {_band_sql("lead", cr.LEAD_DAYS)} as timeliness, {_band_sql("m * 100", cr.RETURN_PCT)} as return_score, {_band_sql("st", cr.CONSISTENCY)} as consistency, n from z)
    select creator_id, accuracy, timeliness, return_score, consistency, round(0.3 * accuracy + 0.2 * timeliness + 0.3 * return_score + 0.2 * consistency, 2) as overall, round(least(1.0::double, n / 30.0::double), 4) as confidence, n from v""",
)
