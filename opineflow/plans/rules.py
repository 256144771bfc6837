"""Registered queries of gates, intents and topics, with their twins in SQL: lines of the documents with phrases between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.operators import emotion as em
from opineflow.operators import gates as gt
from opineflow.operators import intent_rules as ir
from opineflow.operators import passages as ps
from opineflow.operators import topics as tp
from opineflow.plans import queries as base
from opineflow.sources.tables import table

_register = base._register

#: Numbers that stand in the documents too (telephone numbers, addresses), words that do, and names that don't.
GATED = (("700", "0700.HK", False), ("2498", "2498.HK", False), ("555", "0555.HK", False), ("233", "0233.HK", False), ("252", "0252.HK", False), ("12", "0012.HK", False), ("KEY", "KEY", True), ("SE", "SE", True), ("ET", "ET", True),
         ("The", "THE", True), ("Of", "OF", True), ("DE", "DE", True), ("Apple", "AAPL", False), ("Apple", "APLE", False), ("89", "0089.HK", True))
TITLES_OUT = ("Morning Notes", "Call it a week")
CONTEXTS = ("(700) 收盘", "700.HK", "700 HK Equity", "股票代码 700", "and 700 more", "tel 700 9", "+61-2-9324 2498", "2498 4455", "（2498）", "2498 涨了", "Morning Notes (700)", "KEY DEFINITIONS", "(KEY)", "KeyCorp (KEY US)", "KEY.N",
            "Ticker: KEY", "KEY US Equity", "UBS Europe SE", "SE.OQ", "4:00 PM ET", "代码：ET", "(ET)", "Apple Apples apple", "(89) 89", "89.HK", "The (The) Of", "")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(words, at):
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))


def _pick_sql(words, at: str) -> str:
    return f"[{', '.join(map(_q, words))}][cast(({at}) % {len(words)} + 1 as integer)]"


def _gated(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(CONTEXTS, F.col("doc_id"))).alias("text"))


def _gate_sql(rejected: bool) -> str:
    rows = ", ".join(f"({_q(a)}, {_q(t)}, {str(u).lower()})" for a, t, u in GATED)
    has = lambda text, words: "(" + " or ".join(f"contains({text}, {_q(w)})" for w in words) + ")"
    space = r"\s\x{00a0}\x{3000}"
    number = rf"""not (regexp_matches(right(b, 24), '[0-9][{space}\-–—.]\n?$') or regexp_matches(right(b, 16), '[+＋]\(?[0-9]{{1,4}}\)?[{space}\-–—.]') or regexp_matches(a, '^[{space}\-–—.][0-9]{{4}}') or {has("lower(right(b, 24) || left(a, 24))", gt.PHONE_WORDS)})
        and not {has("b || a", TITLES_OUT)} and (regexp_matches(b, '[（(\[【]$') or regexp_matches(a, '^[）)\]】]') or regexp_matches(left(a, 6), '(?i)^\.(HK|SH|SZ|SS|TW|T|US|N|O|OQ)([^A-Za-z0-9]|$)')
        or regexp_matches(left(a, 8), '^ (HK|CH|US|TT|JP|KS)([^A-Za-z0-9]|$)') or {has("right(b, 12) || left(a, 12)", gt.TERMS)})"""
    word = rf"""(regexp_matches(b, '[（(\[【]$') and (regexp_matches(a, '^[）)\]】]') or regexp_matches(left(a, 16), '^[{space}]+(US|UN|UW|HK|CH|TT|JP|GR|LN|SS|SZ)[{space}]*[）)\]】]'))
        or regexp_matches(left(a, 6), '(?i)^\.(HK|SH|SZ|SS|TW|T|US|N|O|OQ)([^A-Za-z0-9]|$)') or regexp_matches(right(b, 12), '(?i)(ticker|symbol|股票代码|代码)[{space}]*[:：]?[{space}]*$')
        or regexp_matches(left(a, 16), '^ (US|UN|UW|HK|CH|TT|JP|GR|LN) Equity([^A-Za-z0-9]|$)'))"""
    return rf"""with t as (select doc_id, coalesce(text, '') || ' ' || {_pick_sql(CONTEXTS, "doc_id")} as text from documents), p as (select doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') as parts from t),
    u as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from p), w as (select doc_id, part, sum(length(part)) over (partition by doc_id order by i) as last from u),
    r(alias, ticker, unsure) as (values {rows}), h as (select doc_id, alias, ticker, unsure, cast(last - length(alias) as integer) as start, cast(last as integer) as "end" from w join r on part = alias),
    c as (select h.*, regexp_matches(alias, '^[0-9]+$') as num, substr(text, greatest(start - 40, 0) + 1, least(start, 40)) as b, substr(text, "end" + 1, 40) as a from h join t using (doc_id)),
    g as (select *, (not num or ({number})) and (not unsure or ({word})) as ok from c)
    select doc_id, alias, ticker, start, "end", case when num and unsure then 'both' when num then 'number' when unsure then 'word' else 'open' end as gate from g where {"not ok" if rejected else "ok"}"""


_register("gated_entity_spans", lambda s, d: gt.gated_spans(_gated(s, d), "doc_id", "text", GATED, TITLES_OUT), _gate_sql(False))
_register("gated_out_spans", lambda s, d: gt.gated_spans(_gated(s, d), "doc_id", "text", GATED, TITLES_OUT, rejected=True), _gate_sql(True))

REGISTRY = (("泡泡玛特", "9992.HK", "HK", "ticker"), ("上证", "000001.SH", "CN", "index"), ("光模块", "OPTICAL_MODULE", "CN", "sector"), ("比特币", "BTC", "CRYPTO", "crypto"), ("腾讯", "0700.HK", "HK", "ticker"), ("腾讯控股", "0700.HK", "HK", "ticker"), ("新能源", "", "CN", "sector"), ("黄金", "GC", "US", "commodity"), ("宁德时代", "300750.SZ", "CN", "ticker"))
HEADINGS = ("## 泡泡玛特", "### 腾讯控股分析", "## 大盘", "## 光模块与上证", "# 总览", "## 新能源 黄金", "##无空格")
PHRASES = ("看好腾讯, 加仓", "风险变高", "", "继续持有宁德时代", "走弱, 减仓上证", "60进攻+20防守+20现金", "观察左侧破位", "看好但注意风险", "比特币值得关注", "该卖", "透支, 回落的风险", "等跌到以下再买入 新能源", "修复空间有限, 谨慎", "短线机会 翻倍 低估 优质 推荐 受益",
           "2026年 长期看空", "下周入场 持有", "资产配置 不及预期", "Q: 买入?", "清仓卖就卖", "[] 盯 [] 跟踪", "卖出卖出", "黄金 抄底", "下跌 回避 亏损 落后 高估", "全年 埋伏 买不了吃亏")


def _lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("content_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("order_index", "body"))
    titled = (F.col("content_id") % 3 != 0) & (F.col("order_index") % 4 == 1)
    words = _pick(PHRASES, F.col("content_id") * 31 + F.col("order_index") * 7)
    text = F.when(titled, _pick(HEADINGS, F.col("content_id") + F.col("order_index"))).otherwise(F.concat("body", F.lit(" "), words))
    return rows.select("content_id", F.concat_ws("-", "content_id", "order_index").alias("block_id"), "order_index", F.when(titled, "heading").otherwise("paragraph").alias("block_type"), text.alias("text"))


_LINES = f"""l as (select doc_id as content_id, unnest(string_split(coalesce(text, ''), chr(10))) as body, unnest(range(0, length(string_split(coalesce(text, ''), chr(10))))) as order_index from documents),
    b as (select content_id, content_id || '-' || order_index as block_id, cast(order_index as integer) as order_index, content_id % 3 <> 0 and order_index % 4 = 1 as titled,
        case when content_id % 3 <> 0 and order_index % 4 = 1 then {_pick_sql(HEADINGS, "content_id + order_index")} else body || ' ' || {_pick_sql(PHRASES, "content_id * 31 + order_index * 7")} end as text from l)"""


def _flat(rows: DataFrame) -> DataFrame:
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e.block_id, e.start, e["end"], e.text)), ",")
    return rows.withColumns({"flags": F.array_join("flags", ","), "block_ids": F.array_join("block_ids", ","), "evidence": evidence})


def _intent_sql() -> str:
    hits = lambda words, text="text": "(" + " + ".join(f"contains({text}, {_q(w)})::int" for w in words) + ")"
    order = sorted(range(len(REGISTRY)), key=lambda i: (ir.PRIORITY.get(REGISTRY[i][3], 5), -len(REGISTRY[i][0])))
    names = ", ".join(f"({_q(n)}, {_q(s)}, {_q(m)}, {_q(ir.TARGET_TYPES.get(k, 'stock'))}, {order.index(i)})" for i, (n, s, m, k) in enumerate(REGISTRY))
    words = ", ".join(f"({_q(w)})" for w in (*ir.BULLISH, *ir.BEARISH))
    acts = " ".join(f"when contains(text, {_q(w)}) then 'explicit_action {'add' if w in ir.ADDING else 'reduce'}'" for w in ir.ACTIONS)
    watch = " ".join(f"when contains(text, {_q(w)}) then '{'opinion' if w == '看好' else 'watch'} none'" for w in ir.WATCHING)
    flags = [("kind = 'monitoring'", "nondirectional_monitoring"), ("kind = 'allocation'", "nondirectional_allocation"), ("name is null", "unknown_target"), (f"{hits(ir.RISK_NOTES)} > 0", "risk_warning"), (f"{hits(('等跌到', '以下再'))} > 0", "wait_for_better_entry"),
             ("contains(text, '修复空间') and contains(text, '有限')", "limited_upside"), (f"{hits(ir.HOLDING)} > 0 and {hits(ir.HOLD_AND_ADD)} > 0", "hold_and_add_compound"), (f"{hits(ir.RELATIVE_TIMES)} > 0", "relative_time_unresolved")]
    listed = ", ".join(f"case when {c} then '{f}' end" for c, f in flags)
    horizon = " ".join(f"when {hits(w)} > 0 then '{h}'" for h, w in ir.HORIZONS)
    count = lambda c: f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}"
    down = f"({hits(ir.BEARISH_STANCE)} + case when {hits(ir.BULLISH)} > 0 then {hits(ir.CAUTION)} else 0 end)"
    return rf"""with {_LINES},
    h as (select *, titled and regexp_matches(trim(text), '^##+\s') as opens from b),
    s as (select *, last_value(case when opens then order_index end ignore nulls) over w as opened, last_value(case when opens then trim(text) end ignore nulls) over w as heading, bool_or(opens) over (partition by content_id) as headed from h
        window w as (partition by content_id order by order_index rows between unbounded preceding and current row)),
    k as (select content_id, block_id, order_index, text, heading, case when headed then opened else order_index end as section from s where not opens and (opened is not null or not headed)
        and not (length(trim(text)) < 4 or regexp_matches(trim(text), '^Q[:：]\s*') or regexp_matches(trim(text), '^[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日\s+[0-9]{{1,2}}:[0-9]{{2}}$') or regexp_matches(trim(text), '^>\s*\*'))),
    v(word) as (values {words}),
    o as (select content_id, section, order_index, block_id, word, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(word)) = word)) as start from k join v on contains(text, word)),
    e as (select content_id, section, string_agg(block_id || ':' || start || ':' || (start + length(word)) || ':' || word, ',' order by order_index, start, start + length(word), word) as evidence from o group by 1, 2),
    bi as (select content_id, section, string_agg(block_id, ',' order by order_index) as block_ids from (select distinct content_id, section, order_index, block_id from o) group by 1, 2),
    t as (select content_id, section, any_value(heading) as heading, string_agg(text, ' ' order by order_index) as text from k group by 1, 2),
    r(name, symbol, market, type, place) as (values {names}),
    c as (select content_id, section, name, symbol, market, type, row_number() over (partition by content_id, section order by case when name = title then 0 when contains(title, name) then 1 else 2 end, place) as n
        from (select *, trim(regexp_replace(coalesce(heading, ''), '^#{{1,6}}\s+', '')) as title from t) join r on contains(title, name) or contains(text, name)),
    x as (select t.content_id, t.section, t.text, e.evidence, bi.block_ids, c.name, c.symbol, c.market, c.type,
        case when {hits(ir.ACTIONS)} > 0 or {hits(ir.STANCES)} > 0 then null when len(regexp_extract_all(text, '[0-9]+\s*(?:成|%|％)?\s*(?:进攻|防守|现金)')) >= 2 or {hits(ir.ALLOCATION)} > 0 then 'allocation'
            when {hits(ir.MONITORING)} + case when {count('[]')} >= 2 or {count('□')} >= 2 then 2 else 0 end >= 2 then 'monitoring' end as kind,
        case when {hits(ir.BULLISH)} > {down} then 'bullish' when {down} > {hits(ir.BULLISH)} then 'bearish' when {hits(ir.BULLISH)} > 0 then 'mixed' when {hits(ir.CAUTION)} > 0 then 'neutral' end as stance,
        case {acts} when {hits(ir.HOLDING)} > 0 then 'explicit_action hold' {watch} when contains(text, '卖就卖') or contains(text, '该卖') then 'opinion exit' else 'opinion none' end as act
        from t join e using (content_id, section) join bi using (content_id, section) left join c on c.content_id = t.content_id and c.section = t.section and c.n = 1),
    y as (select *, list_filter([{listed}], lambda f: f is not null) as fl from x where kind is not null or stance is not null)
    select content_id, section, coalesce(name, 'unknown') as target, coalesce(type, 'unknown') as target_type, symbol, market, case when kind is not null then 'neutral' else stance end as direction,
        case when kind is not null then 'watch' else split_part(act, ' ', 1) end as actionability, case when kind is not null then 'none' else split_part(act, ' ', 2) end as delta,
        case when {hits(ir.BULLISH)} + {hits(ir.BEARISH)} >= 5 then 0.75::double when {hits(ir.BULLISH)} + {hits(ir.BEARISH)} >= 3 then 0.65::double else 0.55::double end as conviction,
        round(greatest(0.35::double, least(0.95::double, case when coalesce(symbol, '') <> '' then 0.85::double when type in ('sector', 'index') then 0.75::double else 0.7::double end - 0.05::double * len(fl))), 3) as confidence,
        case {horizon} else 'unknown' end as horizon, array_to_string(fl, ',') as flags, block_ids, evidence from y"""


_register("rule_intents", lambda s, d: _flat(ir.rule_intents(_lines(s, d), REGISTRY)), _intent_sql())

SYMBOLS = ("9992.HK", "0700.HK", "", "300750.SZ", "MADEUP")
STANCES = ("bullish", "bearish", "neutral")


def _proposed(s: SparkSession, d: str) -> DataFrame:
    rows = _lines(s, d).where("block_type = 'paragraph'")
    at = F.col("content_id") + F.col("order_index")
    names = [r[0] for r in REGISTRY]
    intents = rows.select("content_id", F.col("block_id").alias("intent_id"), _pick(STANCES, at).alias("direction"), F.concat(_pick(names, at * 5), F.when(at % 2 == 0, "公司").otherwise("")).alias("target"), _pick(SYMBOLS, at * 3).alias("symbol"), F.lit("US").alias("market"), F.lit("stock").alias("target_type"))
    spans = rows.select(F.col("block_id").alias("intent_id"), F.when(at % 7 == 0, "block_level").otherwise("intent_keyword").alias("span_type"), _pick(PHRASES, F.col("content_id") * 31 + F.col("order_index") * 7).alias("text"))
    ids = table(s, d, "documents", "doc_id").where("doc_id % 4 <> 0")
    entry = lambda r: F.struct(F.lit(r[1]).alias("symbol"), F.array(F.lit(r[0]), F.lit(None).cast("string")).alias("names"), F.lit(r[2]).alias("market"), F.lit(r[3]).alias("type"))
    every = F.array(*map(entry, REGISTRY))
    n = len(REGISTRY)
    anchors = ids.select(F.col("doc_id").alias("content_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place")).select("content_id", "place", F.element_at(every, ((F.col("content_id") + F.col("place") * 2) % n + 1).cast("int")).alias("e"))
    return ir.checked_intents(intents, spans, anchors.select("content_id", "place", "e.*"))


def _checked_sql() -> str:
    hits = lambda words: "(" + " + ".join(f"contains(quote, {_q(w)})::int" for w in words) + ")"
    names = ", ".join(f"({i}, {_q(n)}, {_q(s)}, {_q(m)}, {_q(ir.TARGET_TYPES.get(k, 'stock'))})" for i, (n, s, m, k) in enumerate(REGISTRY))
    n = len(REGISTRY)
    return f"""with {_LINES}, r(i, name, symbol, market, type) as (values {names}),
    q as (select content_id, block_id as intent_id, {_pick_sql(STANCES, "content_id + order_index")} as direction, {_pick_sql([x[0] for x in REGISTRY], "(content_id + order_index) * 5")} || case when (content_id + order_index) % 2 = 0 then '公司' else '' end as target,
        {_pick_sql(SYMBOLS, "(content_id + order_index) * 3")} as symbol, case when (content_id + order_index) % 7 = 0 then null else {_pick_sql(PHRASES, "content_id * 31 + order_index * 7")} end as quote from b where not titled),
    a as (select doc_id as content_id, p.place, r.* from documents, range(0, 4) p(place) join r on r.i = (doc_id + place * 2) % {n} where doc_id % 4 <> 0),
    m as (select q.intent_id, a.symbol, a.market, a.type, row_number() over (partition by q.intent_id order by case when q.symbol <> '' and a.symbol = q.symbol then 0 else 1 end, a.place) as k
        from q join a on a.content_id = q.content_id and (q.symbol <> '' and a.symbol = q.symbol or contains(q.target, a.name) or contains(a.name, q.target))),
    z as (select q.*, m.symbol as to_symbol, m.market as to_market, m.type as to_type, m.intent_id is not null as found, case when quote is null then 'evidence_not_verbatim'
        when direction = 'bullish' and {hits(ir.BEARISH)} > {hits(ir.BULLISH)} or direction = 'bearish' and {hits(ir.BULLISH)} > {hits(ir.BEARISH)} then 'direction_conflicts_evidence'
        when q.content_id % 4 <> 0 and m.intent_id is null then 'target_not_anchored' end as rejected from q left join m on m.intent_id = q.intent_id and k = 1)
    select content_id, intent_id, direction, target, case when rejected is null and found then to_symbol else symbol end as symbol, case when rejected is null and found and to_symbol <> symbol then to_market else 'US' end as market,
        case when rejected is null and found and to_symbol <> symbol then to_type else 'stock' end as target_type, rejected from z"""


_register("checked_intents", _proposed, _checked_sql())

RULES = (
    tp.TopicRule("popmart", "泡泡玛特", "single_stock", ("泡泡玛特", "POP MART", "9992.HK", "9992HK"), ("泡泡玛特", "9992.HK"), 0.95),
    tp.TopicRule("buffett", "巴菲特/价值投资", "investment_philosophy", ("巴菲特", "Buffett", "伯克希尔", "股东信", "价值投资"), ("巴菲特", "伯克希尔"), 0.85),
    tp.TopicRule("laopu_gold", "老铺黄金", "single_stock", ("老铺黄金", "老铺"), ("老铺黄金",), 0.75, ("short_keyword",)),
    tp.TopicRule("satellite_chem", "卫星化学", "single_stock", ("卫星化学", "卫星"), ("卫星化学",), 0.75, ("short_keyword",)),
    tp.TopicRule("nev", "新能源", "industry", ("新能源", "NEV", "蔚来", "小鹏", "理想", "比亚迪", "CATL"), ("新能源行业",), 0.90),
)
OWN = tuple(tp.anchor_rules([("0700.HK", "腾讯", "stock", ["腾讯控股", "Tencent"]), ("CN.CHIP", "半导体", "sector", []), ("SPX", "标普", "index", ["S&P"]), ("OF", "Of", "stock", []), ("X", "x", "stock", [])]))
TALK = ("泡泡玛特 pop mart", "popcorn", "Buffett 股东信", "老铺, 卫星", "卫星化学 NEV", "never 9992.hk", "", "理想和小鹏", "腾讯 tencent", "半导体", "S&P 标普", "x", "9992.HKX", "卫星 老铺")


def _talk(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations", "conv_id", "turn", "text")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(TALK, F.floor((F.col("conv_id") * 5 + F.col("turn")) / 2)))
    blocks = turns.select(F.col("conv_id").alias("content_id"), F.concat_ws("-", "conv_id", "turn").alias("block_id"), F.col("turn").alias("order_index"), text.alias("text"))
    return blocks


def _topics(s: SparkSession, d: str) -> DataFrame:
    symbols = F.array(*[F.lit(r.entities[0]) for r in OWN])
    held = table(s, d, "conversations", "conv_id").distinct().select(F.col("conv_id").alias("content_id"), F.explode(F.slice(symbols, (F.col("conv_id") % 3 + 1).cast("int"), 2)).alias("symbol"))
    return tp.assign_topics(_talk(s, d), RULES, OWN, held)


def _topic_sql() -> str:
    rules = [(i, r, n) for n, (i, r) in enumerate([(None, r) for r in RULES] + [(i, r) for i, r in enumerate(OWN)])]
    fits = lambda w: f"regexp_matches(lower(text), {_q('(^|[^a-z])' + ''.join(chr(92) + c if c in '.&' else c for c in w.lower()) + '([^a-z]|$)')})" if not any("一" <= c <= "鿿" for c in w) else f"contains(lower(text), {_q(w.lower())})"
    held = lambda i: "" if i is None else f" and {i} between content_id % 3 and content_id % 3 + 1"
    when = " union all ".join(f"select b.*, {n} as rule, {_q(r.key)} as topic_key, {_q(r.title)} as title, {_q(r.type)} as topic_type, {_q(r.entities[0])} as identity, {r.confidence}::double as confidence, {_q(','.join(r.flags))} as rule_flags from b where ({' or '.join(map(fits, r.keywords))}){held(i)}" for i, r, n in rules)
    return f"""b as (select conv_id as content_id, conv_id || '-' || turn as block_id, turn as order_index, coalesce(text, '') || ' ' || {_pick_sql(TALK, "(conv_id * 5 + turn) // 2")} as text from conversations),
    f as ({when}), g as (select block_id, topic_key, rule, title, topic_type, identity, confidence, rule_flags from f qualify row_number() over (partition by block_id order by confidence desc, rule) = 1),
    t as (select b.*, g.* exclude (block_id) from b left join g using (block_id)),
    n as (select *, cast(row_number() over w - 1 as integer) as index, topic_key is not null and lag(topic_key) over w is distinct from topic_key as fresh from t window w as (partition by content_id order by order_index, block_id)),
    u as (select *, cast(sum(fresh::int) over (partition by content_id order by order_index, block_id) as integer) as run from n)"""


_register("topic_assignment", lambda s, d: _topics(s, d).select("content_id", "block_id", "topic_key", "title", "topic_type", "confidence"), f"with {_topic_sql()} select content_id, block_id, topic_key, title, topic_type, confidence from t")
_register(
    "topic_blocks",
    lambda s, d: tp.topic_blocks(_topics(s, d)).withColumns({"block_ids": F.array_join("block_ids", ","), "flags": F.array_join("flags", ",")}),
    f"""with {_topic_sql()} select content_id, run, topic_key, any_value(title) as title, any_value(topic_type) as topic_type, any_value(identity) as identity, any_value(confidence) as confidence, min(index) as start_index, max(index) as end_index,
    string_agg(block_id, ',' order by index) as block_ids, string_agg(text, chr(10) || chr(10) order by index) as raw_text,
    case when count(*) > 1 then any_value(rule_flags) when any_value(rule_flags) = '' then 'single_block_topic' else any_value(rule_flags) || ',single_block_topic' end as flags from u where topic_key is not null group by content_id, run, topic_key""",
)
_register(
    "topic_split",
    lambda s, d: tp.split_by_topic(_topics(s, d), least_blocks=4, most_groups=2),
    f"""with {_topic_sql()}, c as (select *, (count(*) filter (trim(text) <> '') over (partition by content_id) >= 4 or sum(length(text)) over (partition by content_id) >= {tp.LEAST_CHARS}) and max(run) over (partition by content_id) >= 2 as cut from u),
    i as (select content_id, identity, count(*) as n, min(index) as first, arg_min(title, index) as label from c where cut and topic_key is not null group by 1, 2 qualify row_number() over (partition by content_id order by count(*) desc, min(index)) <= 2),
    j as (select *, cast(row_number() over (partition by content_id order by first) as integer) as part from i)
    select c.content_id, c.block_id, cast(case when not cut then 0 else coalesce(part, max(part) over (partition by c.content_id) + 1) end as integer) as part, case when cut then coalesce(label, '{tp.REST}') end as label from c left join j using (content_id, identity)""",
)

LEXICON = (("开心", "joy"), ("相信", "trust"), ("担心", "fear"), ("风险", "fear"), ("惊喜", "surprise"), ("难过", "sadness"), ("讨厌", "disgust"), ("生气", "anger"), ("期待", "anticipation"), ("看好", "bullish"), ("涨", "bullish"), ("跌", "bearish"), ("风险", "bearish"),
           ("happy", "joy"), ("Fear", "fear"), ("loss", "sadness"), ("hope", "anticipation"), ("bullish", "bullish"), ("risk", "bearish"))
MOODS = ("非常看好", "不看好它", "未来看好", "无论涨跌", "没有担心, 只有惊喜惊喜", "Not happy", "a very HAPPY day, no loss", "稍微难过", "xxxxxxxxxxxxxxx看好", "不xxxxxxxxxx涨", "风险风险", "", "不生气 不惊喜", "相信 期待 讨厌", "hope and fear", "可能 非常 开心", "NOT看好", "non-risk", "很很很担心")


def _moods(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    lines = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "body"))
    return lines.select("id", "pos", F.concat(F.substring("body", 1, 60), F.lit(" "), _pick(MOODS, F.col("id") * 7 + F.col("pos") * 3)).alias("text"))


def _emotion_sql() -> str:
    words = dict(LEXICON)
    lex = ", ".join(f"({_q(w.lower())}, {str(w.isascii()).lower()}, {_q(e)}, {i})" for i, (w, e) in enumerate(words.items()))
    no = " or ".join("(" + " and ".join([f"contains(p, {_q(w)})", *(f"not contains(p, {_q(x)})" for x in em.NOT_NEGATIONS.get(w, ()))]) + ")" for w in em.NEGATIONS)
    weigh = " ".join(f"when contains(b, {_q(w)}) then {v}::double" for w, v in em.WEIGHTS.items())
    turn = " ".join(f"when {_q(a)} then {_q(z)}" for a, z in em.OPPOSITES.items())
    listed = lambda names: ", ".join(map(_q, names))
    return f"""with l as (select doc_id as id, unnest(string_split(coalesce(text, ''), chr(10))) as body, unnest(range(0, length(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
    t as (select id, cast(pos as integer) as pos, left(body, 60) || ' ' || {_pick_sql(MOODS, "id * 7 + pos * 3")} as text from l), x(word, latin, emotion, place) as (values {lex}),
    h as (select id, pos, x.*, strpos(case when latin then lower(text) else text end, word) - 1 as i0, case when latin then lower(text) else text end as u from t join x on contains(case when latin then lower(text) else text end, word)),
    w as (select *, substr(u, greatest(i0 - 10, 0) + 1, least(i0, 10)) as p, substr(u, greatest(i0 - 15, 0) + 1, least(i0, 15)) as b from h), n as (select *, ({no}) as turned from w),
    e as (select id, pos, place, case when turned then case emotion {turn} else 'neutral' end else emotion end as emotion, case when turned then 1.0::double else case {weigh} else 1.0::double end end as w from n),
    s as (select id, pos, emotion, round(sum(w), 9) as w, count(*) as n, min(place) as place from e group by 1, 2, 3),
    f as (select id, pos, arg_max(emotion, (w, -place)) as emotion, round((coalesce(sum(w) filter (emotion in ({listed(em.FOR)})), 0) - coalesce(sum(w) filter (emotion in ({listed(em.AGAINST)})), 0)) / sum(w), 6) as score,
        round(least(1.0::double, sum(w) / 5), 6) as intensity, round(least(1.0::double, sum(w) / 3), 6) as confidence, cast(sum(n) as integer) as words from s group by 1, 2),
    m as (select t.id, t.pos, coalesce(emotion, 'neutral') as emotion, coalesce(score, 0.0::double) as score, coalesce(intensity, 0.0::double) as intensity, coalesce(confidence, 0.3::double) as confidence, coalesce(words, 0) as words from t left join f using (id, pos))"""


_register("paragraph_emotions", lambda s, d: em.paragraph_emotions(_moods(s, d), LEXICON), f"{_emotion_sql()} select * from m")
_register(
    "emotion_arc_stats",
    lambda s, d: ps.emotion_arcs(em.paragraph_emotions(_moods(s, d), LEXICON).select("id", "pos", "score")),
    f"""{_emotion_sql()}, q as (select id, score, lag(score) over w as b, lead(score) over w as a from m window w as (partition by id order by pos))
    select id, count(*) as n, count(*) filter ((b is not null or a is not null) and score > coalesce(b, -9) and score > coalesce(a, -9)) as peaks, count(*) filter (sign(score) * sign(b) < 0) as sign_changes, round(greatest(0.0::double, least(1.0::double, 1 - coalesce(var_pop(abs(score - b)), 0))), 4) as rhythm from q group by 1""",
)
