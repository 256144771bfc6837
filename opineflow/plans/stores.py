"""Registered queries of intake, versioned tables, objects, snapshots and chats, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opineflow.plans import bindings as b
from opineflow.plans import queries as base
from opineflow.plans import rules as rl
from opineflow.sources import intake
from opineflow.sources.tables import table
from opineflow.sources.versioned import VersionedTable, get_objects, object_store, put_objects, snapshot_strictly_before, write_snapshot
from opineflow.streaming import live

_register, _q, _pick, _pick_sql, _WITH = base._register, rl._q, rl._pick, rl._pick_sql, base._WITH

FOLDERS = ("kol_a/weekly_strategy/", "kol_b/x/", "feishu/", "upload/", "_inbox/直播/", "kol_a/研报/", "kol_c/内部直播/三月/", "", "kol/", "kol-b/")
#: Forms of names: month, day, hour and minute run past what they may be.
FORMS = ("'2024' || lpad(cast(page_id % 14 as {s}), 2, '0') || lpad(cast(page_id % 33 as {s}), 2, '0') || '_' || lpad(cast(page_id % 26 as {s}), 2, '0') || lpad(cast(page_id % 61 as {s}), 2, '0') || ' '",
         "'a2024' || lpad(cast(page_id % 14 as {s}), 2, '0') || lpad(cast(page_id % 33 as {s}), 2, '0') || 'b'", "'2024.' || cast(page_id % 14 as {s}) || '-' || cast(page_id % 33 as {s}) || ' '", "'img '")
_NAME = lambda s: "case page_id % 4 " + " ".join(f"when {i} then {f.format(s=s)}" for i, f in enumerate(FORMS)) + " end"


def _local(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    name = F.concat(_pick(FOLDERS, F.floor(k / 4)), F.expr(_NAME("string")), F.lit("n"), k.cast("string"), _pick((".png", ".PDF", ".jpeg"), k))
    content = F.when(k % 3 == 0, F.coalesce("html", F.lit(""))).otherwise(F.concat(F.lit("same"), (k % 10).cast("string")))
    pages = table(s, d, "pages", "page_id", "html")
    files = pages.select(name.alias("rel_path"), F.sha2(content, 256).alias("content_hash"), F.timestamp_seconds(k + 1_700_000_000).alias("modified"))
    known = pages.where(k % 6 == 0).select(_pick(("kol_a", "feishu", "kol", "kol_c"), F.floor(k / 6)).alias("grp"), F.concat(F.lit("local_"), F.substring(F.sha2(content, 256), 1, 24)).alias("content_id"))
    return intake.plan_intake(files, known).withColumn("published_at", F.unix_timestamp("published_at"))


def _local_sql() -> str:
    kinds = " ".join(f"when contains(rel_path, {_q(w)}) then '{t}'" for w, t in intake.WORD_TYPES)
    folder = f"list_filter(segments, lambda x: x in ({', '.join(map(_q, intake.FOLDER_TYPES))}))[1]"
    date = lambda y, m, d: f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as timestamp)"
    forms = {"both": "([0-9]{4})([0-9]{2})([0-9]{2})[_-]([0-9]{2})([0-9]{2})([^0-9]|$)", "plain": "(^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})([^0-9]|$)", "dotted": "(^|[^0-9])([0-9]{4})[.-]([0-9]{1,2})[.-]([0-9]{1,2})([^0-9]|$)"}
    part = lambda f, i: f"regexp_extract(name, '{forms[f]}', {i})"
    return f"""with p as (select page_id, {_pick_sql(FOLDERS, "page_id // 4")} || {_NAME("varchar")} || 'n' || page_id || ['.png', '.PDF', '.jpeg'][page_id % 3 + 1] as rel_path, sha256(case when page_id % 3 = 0 then coalesce(html, '') else 'same' || (page_id % 10) end) as content_hash from pages),
    k as (select distinct ['kol_a', 'feishu', 'kol', 'kol_c'][cast((page_id // 6) % 4 + 1 as integer)] as grp, 'local_' || content_hash[1:24] as content_id from p where page_id % 6 = 0),
    s as (select *, string_split(rel_path, '/') as segments, string_split(rel_path, '/')[-1] as name from p),
    t as (select *, segments[1] in ({", ".join(map(_q, intake.NO_CREATORS))}) as bucket, {date(part("both", 1), part("both", 2), part("both", 3))} as d1, try_cast({part("both", 4)} as integer) as hh, try_cast({part("both", 5)} as integer) as mi,
        {date(part("plain", 2), part("plain", 3), part("plain", 4))} as d2, {date(part("dotted", 2), part("dotted", 3), part("dotted", 4))} as d3, min(segments) over (partition by content_hash) as first from s),
    u as (select *, d1 is not null and hh < 24 and mi < 60 as timed, 'local_' || content_hash[1:24] as content_id, segments[1] as grp from t)
    select rel_path, content_hash, u.content_id, case when not bucket then u.grp end as creator_id, u.grp, case when {folder} is not null then {folder} when list_contains(segments, 'upload') then 'manual_upload' {kinds} else 'unclassified' end as source_type,
        case when u.grp in ('feishu', 'bilibili', 'wechat') then u.grp else 'local' end as platform, case when rel_path like '%.PDF' then 'pdf' else 'image' end as file_type,
        cast(case when timed then epoch(d1) + hh * 3600 + mi * 60 - 28800 when d2 is not null then epoch(d2) - 28800 when d3 is not null then epoch(d3) - 28800 else page_id + 1700000000 end as bigint) as published_at,
        case when timed then 'filename_datetime' when d2 is not null then 'filename_date' when d3 is not null then 'filename_dotted_date' else 'file_mtime' end as published_source,
        case when segments <> first then 'duplicate' when k.grp is not null then 'exists' else 'new' end as status from u left join k on k.grp = u.grp and k.content_id = u.content_id"""


_register("local_intake", _local, _local_sql())

DAYS = ("2024-01-05", "", "2024-02-30", "2024-3-7", "05.01.2024", " 2024-12-31 ", "2024-13-01")
PATHS = ("/data/", "/Volumes/IN/", "/Volumes/OUT/", " ")


def _broker(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(s, d, "orders", "o_orderkey", "o_custkey")
    path = F.when(k % 4 == 3, F.lit(" ")).otherwise(F.concat(_pick(PATHS, k), F.col("o_custkey").cast("string"), F.lit(".pdf")))
    files = o.where((k % 4 < 2) & (F.col("o_custkey") % 3 != 0)).select(path.alias("path"), F.sha2((F.col("o_custkey") % 20).cast("string"), 256).alias("content_hash"))
    known = s.range(20).where("id % 4 = 0").select(F.concat(F.lit("broker_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24)).alias("content_id"))
    rows = intake.plan_broker_intake(o.select(k.alias("line_no"), path.alias("filepath"), _pick(DAYS, k * 3).alias("date")), files, known, ["IN"])
    return rows.withColumn("published_at", F.unix_timestamp("published_at"))


_register(
    "broker_intake",
    _broker,
    f"""with p as (select o_orderkey as k, o_custkey, case when o_orderkey % 4 = 3 then ' ' else {_pick_sql(PATHS, "o_orderkey")} || o_custkey || '.pdf' end as path, trim({_pick_sql(DAYS, "o_orderkey * 3")}) as day from orders),
    f as (select distinct path, sha256(cast(o_custkey % 20 as varchar)) as h from p where k % 4 < 2 and o_custkey % 3 <> 0),
    a as (select p.*, h, case when regexp_full_match(day, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast(split_part(day, '-', 1) || '-' || lpad(split_part(day, '-', 2), 2, '0') || '-' || lpad(split_part(day, '-', 3), 2, '0') as date) end as d from p left join f using (path)),
    e as (select *, case when trim(path) = '' then 'F0_BROKER_META_INVALID' when day = '' then 'F0_BROKER_DATE_MISSING' when d is null then 'F0_BROKER_DATE_INVALID' when h is null and path like '/Volumes/OUT/%' then 'F0_BROKER_VOLUME_MISSING' when h is null then 'F0_BROKER_FILE_MISSING' end as code from a),
    g as (select *, case when code is null then min(k) over (partition by h, code is null) end as first from e)
    select k as line_no, case when code is null then 'broker_' || h[1:24] end as content_id, case when code is null then cast(epoch(cast(d as timestamp)) - 28800 as bigint) end as published_at,
        case when code is not null then 'failed' when k <> first then 'duplicate' when h in (select sha256(cast(i as varchar)) from range(0, 20, 4) r(i)) then 'exists' else 'new' end as status, code as error_code, case when code is not null then code = 'F0_BROKER_VOLUME_MISSING' end as retryable from g""",
)

_ACTION = "action_id long, creator_id string, ticker string, direction string, status string, month string"


def _patched(s: SparkSession, d: str) -> DataFrame:
    """Actions kept by month; some get another status, some go, one creator's come again."""
    a = b.actions(s, d).select("action_id", "creator_id", "ticker", "direction", "status", F.date_format("clock", "yyyy-MM").alias("month"))
    t = VersionedTable(s, live.folders(s, "actions")[0], _ACTION, "month")
    t.replace(a.where("creator_id <> 'kol_3'"))
    t.append(a.where("creator_id = 'kol_3'"))
    t.patch(a.where("action_id % 5 = 0").select("action_id", F.lit("settled").alias("status")), "action_id")
    t.delete(a.where("action_id % 11 = 0").select("action_id"), "action_id")
    return t.read()


def _objects(s: SparkSession, d: str) -> DataFrame:
    """The documents' texts by digest, put twice, and what the store gives for the texts of both and for pages it doesn't hold."""
    store = object_store(s, live.folders(s, "objects")[0])
    docs = table(s, d, "documents", "doc_id", "text")
    put_objects(store, docs.where("doc_id % 2 = 0"), "text")
    put_objects(store, docs, "text")
    wanted = docs.where("text is not null").select(F.sha2("text", 256).alias("digest")).unionByName(table(s, d, "benchmark", "text").select(F.sha2(F.concat(F.lit("no "), "text"), 256).alias("digest")))
    return get_objects(store, wanted, "digest").select("digest", "state", F.octet_length("content").cast("long").alias("bytes"))


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Latest stances at three month ends, one of them written twice, and the last one strictly before a day."""
    t = VersionedTable(s, live.folders(s, "stances")[0], "creator_id string, ticker string, direction string, action_id long, snapshot_date date", "snapshot_date")
    a = b.actions(s, d)
    for day in ("2024-01-08", "2024-01-10", "2024-01-12", "2024-01-10"):
        last = F.max_by(F.struct("direction", "action_id"), F.struct("clock", "action_id")).alias("l")
        write_snapshot(t, a.where(F.col("clock") < F.lit(day).cast("date")).groupBy("creator_id", "ticker").agg(last).select("creator_id", "ticker", "l.*"), day)
    return snapshot_strictly_before(t, "2024-01-12")


def _chats(s: SparkSession, d: str) -> DataFrame:
    e = live.event_stream(s, d, table(s, d, "events").schema, "events.parquet")
    messages = e.select(F.concat(F.lit("chat "), (F.col("user_id") % 5).cast("string")).alias("chat"), (F.col("event_id") % 50).alias("id"), F.col("ts").cast("date").cast("timestamp").alias("at"), F.col("event_type").alias("text"))
    rows = live.drain_appended(live.chat_sync(messages), *live.folders(s, "chats"))
    return rows.groupBy("chat", "id", "status").agg(F.count("*").alias("n"))


_register("patched_actions", _patched, f"{_WITH} select action_id, creator_id, ticker, direction, case when action_id % 5 = 0 then 'settled' else status end as status, strftime(clock, '%Y-%m') as month from actions where action_id % 11 <> 0")
_register("object_store", _objects, "select distinct sha256(text) as digest, 'ok' as state, cast(octet_length(encode(text)) as bigint) as bytes from documents where text is not null union all select distinct sha256('no ' || text), 'missing', null from benchmark")
_register("persisted_snapshot", _snapshots, f"{_WITH} select creator_id, ticker, arg_max(direction, (clock, action_id)) as direction, arg_max(action_id, (clock, action_id)) as action_id, date '2024-01-10' as snapshot_date from actions where clock < timestamp '2024-01-10' group by 1, 2")
_register(
    "stream_chat_sync",
    _chats,
    """with m as (select 'chat ' || (user_id % 5) as chat, cast(event_id % 50 as varchar) as id, cast(ts as date) as day from events), k as (select chat, id, count(distinct day) as fresh, count(*) as n from m group by 1, 2)
    select chat, id, 'new' as status, fresh as n from k union all select chat, id, 'repeated', n - fresh from k where n > fresh""",
)
