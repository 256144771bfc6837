"""Registered queries of page layout and of the company registry, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import layout as ly
from opineflow.operators import registry as rg
from opineflow.plans import queries as base
from opineflow.sources.tables import table

_register = base._register

#: Cells of pages, one row a line: rows stand 18 apart, 33 where a block ends, and their cells lie up to 1 up or down.
_CELL = {
    "cy": "l_linenumber * 18 + 15 * cast(floor((l_linenumber + l_orderkey % 3) / 3) as int) + (i - 1) * (l_partkey % 3) / 2.0{d}",
    "h": "case when l_linenumber = 1 and l_orderkey % 4 = 0 then 18.0{d} else 12.0{d} end",
    "text": "case when (l_partkey + i) % 17 = 0 then null when (l_partkey + i) % 13 = 0 then '' else concat('p', cast(l_partkey % 100 as {s}), case when l_partkey % 7 = 0 then ' of a line that is too long for any title' else '' end) end",
}


def _regions(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    cells = i.select("*", F.explode(F.expr("sequence(cast(0 as int), cast(l_partkey % 3 as int))")).alias("i"))
    cells = cells.select(F.col("l_orderkey").alias("page_id"), F.col("i").alias("place"), *[F.expr(e.format(d="D", s="string")).alias(c) for c, e in _CELL.items()])
    x = F.col("place") * 50.0
    return ly.layout_regions(cells.select("page_id", "place", "text", x.alias("x0"), (F.col("cy") - F.col("h") / 2).alias("y0"), (x + 40).alias("x1"), (F.col("cy") + F.col("h") / 2).alias("y1")))


_register("layout_regions", _regions, f"""with c as (select l_orderkey as page_id, i as place, {", ".join(e.format(d="::double", s="varchar") + " as " + c for c, e in _CELL.items())}, i * 50.0::double as x0 from lineitem, unnest(range(0, l_partkey % 3 + 1)) u(i)),
  k as (select *, cy - lag(cy) over w as step, median(h) over (partition by page_id) as med from c where text <> '' window w as (partition by page_id order by cy, place, text)),
  n as (select *, sum(case when step is null or step > 9 then 1 else 0 end) over (partition by page_id order by cy, place, text rows unbounded preceding) as r from k),
  w as (select page_id, r, avg(cy) as cy, count(*) as n, list(text order by x0, place, text) as texts, any_value(med) as med, min(x0) as x0, min(cy - h / 2) as y0, max(x0 + 40) as x1, max(cy + h / 2) as y1 from n group by 1, 2),
  t as (select *, n >= 2 and (coalesce(lag(n >= 2) over d, false) or coalesce(lead(n >= 2) over d, false)) as tab from w window d as (partition by page_id order by cy, r)),
  b as (select *, case when lag(tab) over d is null or lag(tab) over d <> tab or (not tab and cy - lag(cy) over d > 1.7::double * med) then 1 else 0 end as begins from t window d as (partition by page_id order by cy, r)),
  g as (select *, cast(sum(begins) over (partition by page_id order by cy, r rows unbounded preceding) as integer) as region from b),
  f as (select page_id, region, any_value(tab) as tab, any_value(med) as med, list(texts order by cy, r) as grid, max(length(texts)) as wide, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as rows, cast(sum(n) as bigint) as cells from g group by 1, 2),
  p as (select *, list_transform(grid, lambda q: '| ' || array_to_string(list_concat(q, list_transform(range(0, wide - length(q)), lambda z: '')), ' | ') || ' |') as lines, array_to_string(list_transform(grid, lambda q: array_to_string(q, ' ')), chr(10)) as plain from f)
  select page_id, region, case when tab then 'table' when cells = 1 and length(plain) <= 40 and y1 - y0 >= 1.3::double * med then 'title' else 'text' end as type,
    case when tab then lines[1] || chr(10) || '| ' || array_to_string(list_transform(range(0, wide), lambda z: '---'), ' | ') || ' |' || chr(10) || array_to_string(lines[2:], chr(10)) else plain end as text, x0, y0, x1, y1, rows, cells from p""")  # fmt: skip

#: Names and codes of firms, of each shape the rules tell apart; {k} is a key, {s} the type of strings.
_STEM = "concat(chr(cast(65 + {k} % 26 as int)), 'o', chr(cast(97 + {k} % 7 as int)), 'rn', cast({k} % 9 as {s}))"
_NAMES = ("concat({m}, ' Inc.')", "concat({m}, '_A')", "concat('&- MS  ', {m}, ' Holdings')", "concat({m}, '股份有限公司')", "concat({m}, '行业')", "concat('Weekly ', {m})", "concat('9', {m})", "concat('Samsung ', {m})", "concat({m}, ' a b c d e f g')", "'Target'", "concat({m}, '? ')", "{m}", "''")
_CODES = ("concat(cast({k} % 900 as {s}), '.hk')", "concat('60', lpad(cast({k} % 300 as {s}), 4, '0'))", "concat('60', lpad(cast({k} % 300 as {s}), 4, '0'), '.SS')", "concat('A', chr(cast(65 + {k} % 26 as int)))", "concat('A', chr(cast(65 + {k} % 9 as int)), '.N')", "'prc'", "'12'", "concat('  ', lpad(cast({k} % 5000 as {s}), 4, '0'), '.HK')", "null", "chr(cast(65 + {k} % 26 as int))", "'BAD'")
_REJECTED, _AMBIGUOUS = ("bad",), ("Target", "AA", "AC", "AE")


def _choice(forms: tuple, key: str) -> str:
    return f"case {key} % {len(forms)} " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


def _firms_sql(s: str) -> tuple[str, str, str]:
    stem = _STEM.format(k="k", s=s)
    return _choice(_NAMES, "k").format(m=stem), _choice(_CODES, "(k + floor(k / 13))" if s == "string" else "(k + k // 13)").format(k="k", s=s), stem


def _keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer", "c_custkey").select(F.col("c_custkey").cast("long").alias("k")).unionByName(table(s, d, "supplier", "s_suppkey").select((F.col("s_suppkey") * 5 + 2).cast("long").alias("k")))


def _judged(s: SparkSession, d: str) -> DataFrame:
    name, code, _ = _firms_sql("string")
    return rg.judged_pairs(_keys(s, d).select(F.expr(name).alias("name"), F.expr(code).alias("code")), _REJECTED, prefixes=("GS", "MS"))


def _company_registry(s: SparkSession, d: str) -> DataFrame:
    known = _keys(s, d).where("k % 10 = 3").select(F.expr(_firms_sql("string")[2]).alias("alias"))
    return rg.company_registry(_judged(s, d), known, _REJECTED, _AMBIGUOUS)


def _judged_sql() -> str:
    name, code, stem = _firms_sql("varchar")
    clean = r"regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(name, '[_~]', ' ', 'g'), '\s+', ' ', 'g'), '^[-&—·. ]+', '')), '^(GS|MS) ', '')), '[\s–—-]+[AH]$', '')"
    noise = "|".join(rg.ASCII_NOISE)
    return rf"""keys as (select cast(c_custkey as bigint) as k from customer union all select cast(s_suppkey * 5 + 2 as bigint) from supplier), known as (select distinct {stem} as alias from keys where k % 10 = 3),
  raw as (select distinct {name} as name, {code} as code from keys), p as (select name, upper(trim(code)) as code, trim({clean}) as c from raw where name <> '' and code <> ''),
  q as (select name, code, case when length(c) between 2 and 40 and not regexp_matches(c, '^[0-9]|[%?!;:|]') and case when regexp_matches(c, '[一-鿿]') then not regexp_matches(c, '行业|-') else regexp_matches(c, '^[A-Za-z][A-Za-z0-9&.,() -]*$') and len(string_split(c, ' ')) <= 6 and not regexp_matches(lower(c), '(^| )({noise})( |$)') end then c end as clean,
    case when code in ('PRC', 'BAD') then null when regexp_matches(code, '^[0-9]+\.HK$') then lpad(split_part(code, '.', 1), cast(greatest(4, length(split_part(code, '.', 1))) as integer), '0') || '.HK' when regexp_matches(code, '^60[0-9]{{4}}(\.SS)?$') then code[1:6] || '.SH' when regexp_matches(code, '^[A-Z]{{2,5}}(\.N)?$') then split_part(code, '.', 1) end as symbol from p),
  r as (select *, case when symbol is null then null when ends_with(symbol, 'HK') then 'HK' when ends_with(symbol, '.SH') then 'CN' else 'US' end as market, case when symbol is null then 'code_rejected' when regexp_matches(code, '^[0-9]{{6}}$') and (contains(name, 'Samsung') or contains(name, 'LG')) then 'korean' end as why from q),
  e as (select symbol, bool_and(regexp_matches(code, '^[A-Z]+$')) as letters, coalesce(min(clean) <> max(clean), false) as several from r where why is null group by 1),
  j as (select name, code, r.symbol, market, clean, coalesce(why, case when letters and not several then 'bare_alpha' end, 'kept') as status from r left join e on r.symbol = e.symbol)"""


_register("company_pairs", _judged, f"with {_judged_sql()} select * from j")
_register("company_registry", _company_registry, rf"""with {_judged_sql()}, a as (select symbol, market, trim(unnest([symbol, code, case when regexp_matches(symbol, '^[0-9]+\.') then split_part(symbol, '.', 1) end, clean, regexp_replace(trim(regexp_replace(clean, ' (Inc\.|Holdings)$', '')), '股份有限公司$', '')])) as alias from j where status = 'kept'),
  b as (select * from a where length(alias) >= 2 and not regexp_matches(alias, '^([0-9]{{1,3}}|(19|20)[0-9]{{2}})$') and upper(alias) not in ('BAD', {", ".join(repr(c) for c in rg.NO_CODES)})),
  g as (select alias, min(symbol) as symbol, min(symbol) = max(symbol) as one, min_by(market, symbol) as market from b group by 1),
  s as (select *, case when not one then 'conflict' when alias in (select alias from known) then 'known' else 'kept' end as status from g)
  select alias, case when one then symbol end as symbol, case when one then market end as market, status, status = 'kept' and alias in {_AMBIGUOUS} as requires_context from s""")  # fmt: skip
